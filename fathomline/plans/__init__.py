"""Fathomline plans."""
