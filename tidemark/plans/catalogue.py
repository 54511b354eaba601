"""Every registered query, with the SQL that checks it."""

from __future__ import annotations

from . import accounts, decisions, desk, evidence, ingestion, series, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
