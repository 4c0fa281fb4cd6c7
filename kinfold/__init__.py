"""Identity resolution and object timelines as Spark jobs."""
