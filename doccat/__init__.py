"""A document catalogue and full-text search on Spark."""

from doccat.config import Settings

__all__ = ["Settings"]
