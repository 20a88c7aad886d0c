"""Review-log analytics on Spark."""
