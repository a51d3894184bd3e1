"""River-relative terrain analytics on Spark."""
