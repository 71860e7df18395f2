"""tidemark: Spark jobs for collecting, refining, deduplicating, publishing and searching notices."""
