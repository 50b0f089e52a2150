"""Property-graph analytics as ordinary Spark DataFrame jobs."""
