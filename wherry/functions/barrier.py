"""A step that the optimizer does not merge with what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns that are computed once, however many filters and scores name them.

    Filters are pushed below a projection, and take its expressions along; they are not pushed
    below a generator that makes the columns they need.
    """
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
