"""Rows and plans of frames, for the tests."""

from __future__ import annotations


def rows(df):
    """All rows as sorted plain tuples; NULL sorts first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: [(v is not None, str(v)) for v in t])


def plan_of(df) -> str:
    """The executed physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()
