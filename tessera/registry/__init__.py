"""Registered queries and their SQL."""

from tessera.registry import extended, landed, listing, scoring  # noqa: F401
from tessera.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
