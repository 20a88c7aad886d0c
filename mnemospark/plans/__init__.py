"""Whole evaluations, queries and their SQL."""
