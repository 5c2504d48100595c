"""brookwell: knowledge retrieval and learning analytics as Spark jobs."""
