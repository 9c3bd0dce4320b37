"""Evidence-review analytics as Spark jobs."""
