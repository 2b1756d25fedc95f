"""textloom: text-corpus retrieval and curation as Spark jobs."""
