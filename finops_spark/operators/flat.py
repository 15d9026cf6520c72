"""Stuck-feed detection: rolling population deviation below a threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finops_spark.errors import SchemaError
from finops_spark.functions.scalar import require
from finops_spark.operators.ordered import SPLIT_ROWS, with_bounded_window


def rolling_stdev(
    df: DataFrame,
    key: str = "asset",
    order_by: Sequence[str] = ("date",),
    value: str = "price",
    window: int = 5,
    split_hot: bool = True,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Add ``rolling_stdev``: population deviation of the last ``window`` rows of
    the key, NULL until that many exist."""
    require(df, [key, *order_by, value], "price table")
    if window < 2:
        raise SchemaError(f"window must be at least 2, got {window}")

    def columns(w):
        frame = w.rowsBetween(-(window - 1), 0)
        full = F.count(value).over(frame) == window
        return {"rolling_stdev": F.when(full, F.stddev_pop(value).over(frame))}

    return with_bounded_window(df, [key], order_by, window - 1, 0, columns, split_hot, split_rows)


def flag_flat(
    df: DataFrame,
    key: str = "asset",
    order_by: Sequence[str] = ("date",),
    value: str = "price",
    window: int = 5,
    threshold: float = 0.01,
    split_hot: bool = True,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Rows whose rolling deviation is strictly below ``threshold``."""
    needed = df.select(key, *order_by, value)
    rolled = rolling_stdev(needed, key, order_by, value, window, split_hot, split_rows)
    return rolled.filter(F.col("rolling_stdev") < threshold).select(key, *order_by, "rolling_stdev")
