"""Governed-retrieval corpora as Spark jobs."""
