"""Online models on streams."""
