"""Time-stamped media analytics as Spark jobs."""
