"""All registered queries."""

from __future__ import annotations

from . import market_queries, series_queries, strategy_queries, sweep_queries, text_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
