"""Operators for training-data pipelines over code and text. Nothing outside this subpackage imports it."""
