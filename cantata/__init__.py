"""Symbolic-music score processing as Spark jobs."""
