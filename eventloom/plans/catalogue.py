"""The registered queries of the engine, with their SQL."""

from . import composite, days, listings, names, order, webpages  # noqa: F401  (they register themselves)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
