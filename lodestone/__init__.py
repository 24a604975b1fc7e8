"""Full-text search and corpus preparation as Spark DataFrame programs."""
