"""Reading-library analytics on Spark."""
