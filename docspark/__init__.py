"""Turn collections of office files and converted pages into Markdown with Spark."""
