"""Document-graph analytics as PySpark jobs."""
