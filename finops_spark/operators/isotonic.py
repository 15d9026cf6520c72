"""Pooling of adjacent violators in blocks.

Rows in score order are pooled inside ranges first: each task keeps a stack of blocks (first and
last score, weighted sum, weight) and merges the last two while they fall. Pooling is associative,
so the blocks of all ranges may be pooled again in other ranges, whose borders lie elsewhere;
that is repeated until no border between two ranges has a fall. A task never holds more than
about BLOCK_ROWS blocks, and what is left is the fitted curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finops_spark.session import store

# Blocks that a range holds on average.
BLOCK_ROWS = 500_000
_SCHEMA = "lo double, hi double, total double, weight double"
_NAMES = ["lo", "hi", "total", "weight"]


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one range, sorted by ``lo``, as blocks whose means do not fall."""
    stack: list[list[float]] = []
    for batch in batches:
        for block in zip(*(batch.column(n).to_pylist() for n in _NAMES), strict=True):
            stack.append(list(block))
            while len(stack) > 1 and stack[-2][2] * stack[-1][3] > stack[-1][2] * stack[-2][3]:
                _, hi, total, weight = stack.pop()
                last = stack[-1]
                last[1], last[2], last[3] = hi, last[2] + total, last[3] + weight
    for at in range(0, len(stack), 50_000):
        columns = zip(*stack[at : at + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], _NAMES)


def pool_violators(points: DataFrame, score: str, target: str, weight: str, block_rows: int | None = None) -> DataFrame:
    """(lo, hi, total, weight): the blocks of the isotonic fit of ``target`` on distinct scores; a block's value is total / weight.

    An empty table has no blocks. Scores, targets and weights must not be NULL or NaN; weights are positive."""
    size = block_rows or BLOCK_ROWS
    start = F.col(target).cast("double") * F.col(weight).cast("double")
    blocks = store(points.select(F.col(score).cast("double").alias("lo"), F.col(score).cast("double").alias("hi"), start.alias("total"), F.col(weight).cast("double").alias("weight")), "isotonic-points")
    held = blocks.count()
    for turn in range(held + 1):  # every turn but the last merges two blocks at least
        parts = max(1, -(-held // size))
        # one more range in every other turn puts the borders elsewhere
        ranged = blocks.repartitionByRange(parts + turn % 2 if parts > 1 else 1, "lo").sortWithinPartitions("lo")
        pooled = ranged.mapInArrow(_pool, _SCHEMA).withColumn("part", F.spark_partition_id())
        blocks = store(pooled, "isotonic-blocks")
        mean = F.col("total") / F.col("weight")
        ends = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"), F.min("lo").alias("lo"))
        before = F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("lo"))  # one row for each range
        state = ends.withColumn("falls", before > F.col("first")).agg(F.sum("n").alias("n"), F.count_if("falls").alias("falls")).first()
        held = state["n"] or 0
        if not state["falls"]:
            break
    return blocks.drop("part")
