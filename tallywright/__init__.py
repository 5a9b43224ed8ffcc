"""Survey evidence and claim datasets as Spark jobs."""
