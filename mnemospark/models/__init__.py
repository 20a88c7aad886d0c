"""Memory models."""
