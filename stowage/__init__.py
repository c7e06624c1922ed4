"""Archive analytics on Spark."""
