"""Spark jobs over versioned archives of changing objects."""

from palimpsest.session import build_session

__all__ = ["build_session"]
