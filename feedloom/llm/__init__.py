"""Operators for large training corpora (no other subpackage imports this one)."""
