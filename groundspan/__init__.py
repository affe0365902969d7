"""Grounded retrieval over timestamped text, written as Spark DataFrame jobs."""

from groundspan.settings import Settings

__all__ = ["Settings"]
