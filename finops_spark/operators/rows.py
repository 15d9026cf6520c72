"""Small helpers on one-row results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*one_row_tables: DataFrame) -> DataFrame:
    """Put several one-row tables with distinct columns into one row.

    A union with gaps and a ``max`` over it: no join between aggregates.
    """
    names = [c for t in one_row_tables for c in t.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row_tables)
    return stacked.agg(*[F.max(n).alias(n) for n in names])
