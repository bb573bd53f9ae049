"""Analytics of head-to-head contests on Spark."""
