"""Small helpers for comparing DataFrames in tests."""

from __future__ import annotations


def rows(df, *order):
    out = df.orderBy(*order) if order else df
    return [tuple(r) for r in out.collect()]
