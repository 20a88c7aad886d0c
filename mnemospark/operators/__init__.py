"""Relational operators on review logs."""
