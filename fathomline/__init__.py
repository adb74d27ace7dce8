"""Fathomline: retrieval, code-structure and dataset-maintenance analytics on Spark."""

__version__ = "0.1.0"
