"""Fathomline sources."""
