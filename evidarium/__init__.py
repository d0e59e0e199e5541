"""Evidence-catalog analytics as Spark jobs."""
