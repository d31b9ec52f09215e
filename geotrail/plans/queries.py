"""All queries of the reference's own operators."""

from __future__ import annotations

from . import columns, found, groups, records, relations, served
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "columns", "found", "groups", "records", "relations", "served"]
