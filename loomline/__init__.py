"""Session analytics and corpus preparation as Spark jobs."""
