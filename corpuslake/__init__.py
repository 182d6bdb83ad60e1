"""corpuslake: document retrieval and corpus preparation as Spark jobs."""
