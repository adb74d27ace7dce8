"""Fathomline functions."""
