"""Returns and revenue analytics for order data, written for Spark."""
