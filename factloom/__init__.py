"""Spark jobs that pull structured facts out of large collections of contract texts."""
