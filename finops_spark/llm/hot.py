"""Groups by a hash in which a few keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finops_spark.llm.common import store

#: At most so many of the most common keys are treated apart; the sketch that finds them
#: holds five times as many, so every key with over 1 in 7,500 of the rows is among them.
COMMON_KEYS = 2_000


def common_keys(rows: DataFrame, key: str) -> DataFrame:
    """The most common values of a bigint column, at most COMMON_KEYS rows. The sketch may add
    or miss a key; that changes only the way its rows take, never the result."""
    top = rows.agg(F.expr(f"approx_top_k({key}, {COMMON_KEYS}, {5 * COMMON_KEYS})").alias("top"))
    return store(top.select(F.explode("top.item").alias(key)).where(F.col(key).isNotNull()).distinct(), "common-keys")


def with_first(rows: DataFrame, key: str, more: list[str], place: Column) -> DataFrame:
    """``rows`` with ``_first``, the least ``place`` of all rows that agree in ``key`` and ``more``,
    and ``_single``, whether it is the only row of its group.

    Common keys are summed up ahead and their rows take no part in the shuffle; the others are
    sorted by place within their group, which a window reads as a stream."""
    common = common_keys(rows, key)
    ahead = rows.join(F.broadcast(common), key, "left_semi")
    names = [key, *more]
    totals = store(ahead.groupBy(*names).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")), "common-totals")
    # one total for each common key, but for keys that differ in ``more`` only
    from_common = rows.join(F.broadcast(common), key, "left_semi").join(F.broadcast(totals) if not more or totals.count() <= 4 * COMMON_KEYS else totals, names)
    from_common = from_common.withColumn("_single", F.col("_n") == 1).drop("_n")
    group = Window.partitionBy(*names).orderBy(place)
    rest = rows.join(F.broadcast(common), key, "left_anti")
    rest = rest.withColumns({"_first": F.first(place).over(group.rowsBetween(Window.unboundedPreceding, 0)), "_single": F.lag(F.lit(1)).over(group).isNull() & F.lead(F.lit(1)).over(group).isNull()})
    return from_common.select(rest.columns).unionByName(rest)
