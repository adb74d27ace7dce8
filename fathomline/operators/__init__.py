"""Fathomline operators."""
