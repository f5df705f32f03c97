"""Publishing and analysis of hourly sensor readings, written as Spark jobs."""

from hourmark.runtime import prepare, session

__all__ = ["prepare", "session"]
