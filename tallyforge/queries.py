"""Registered queries."""

from .plans import runs, scoring, wording

QUERIES = scoring.QUERIES | wording.QUERIES | runs.QUERIES
SQL = scoring.SQL | wording.SQL | runs.SQL
