"""Source-corpus compression, retrieval and scoring as Spark jobs."""
