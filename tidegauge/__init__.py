"""Model monitoring on Spark."""
