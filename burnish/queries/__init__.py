"""Registered queries over the star-schema tables, each with its SQL twin where SQL can say it."""

from burnish.queries import clean, dirt, grading, profiling, reports, sources
from burnish.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "clean", "dirt", "grading", "profiling", "reports", "sources"]
