"""Spark jobs for splitting, indexing, retrieving and scoring long structured documents."""
