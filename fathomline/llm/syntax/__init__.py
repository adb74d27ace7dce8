"""Syntax of source files: a generalised LL recogniser, token scanners and dialect grammars."""
