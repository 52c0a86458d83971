"""Tabular and document intelligence as Spark jobs."""
