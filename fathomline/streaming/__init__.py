"""Fathomline streaming."""
