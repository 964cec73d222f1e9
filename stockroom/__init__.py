"""Storage-inventory analytics on Spark."""
