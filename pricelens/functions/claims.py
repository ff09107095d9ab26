"""Paths, grades and citations of research claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A claim belongs to row i when its path is $[i] or starts with "$[i].".
ROW_PATH = r"^\$\[(0|[1-9][0-9]*)\](\.|\z)"


def claim_row(path: Column) -> Column:
    """Index of the row a claim is about, NULL when it is about no single row."""
    index = F.regexp_extract(path, ROW_PATH, 1)
    return F.when(index != "", index.try_cast("int"))


def high_share(high: Column, graded: Column) -> Column:
    """Share of the graded claims that are graded high, NULL when none is graded."""
    return F.round(F.try_divide(high, graded), 2)
