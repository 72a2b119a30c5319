"""Queries over the project's tables, by subject."""

from . import annotate, arrays, cards, evaluation, events, exchange, fits, reports, rules, store
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "annotate", "arrays", "cards", "evaluation", "events", "exchange", "fits", "reports", "rules", "store"]
