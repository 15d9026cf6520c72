"""Keyed, order-dependent work that stays balanced when one key is huge.

``Window.partitionBy(key)`` puts all rows of a key into one task. That is the
right plan while no key is large, and it is what these helpers use then. When a
key holds more rows than one task should, its rows (and only those) are cut into
ranges of the order, every row gets its exact position within the key, and windows
run over fixed-size blocks of positions. Rows next to a block edge are also sent to
the neighbouring block, so a frame that looks at most ``before`` rows back and
``after`` rows ahead sees exactly the rows it would see unsplit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from finops_spark.session import store

# A key with more rows than this is split, whatever the size of the table.
SPLIT_ROWS = 4_000_000


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[f"_hot_{key}"])
    return condition


def hot_keys(df: DataFrame, keys: Sequence[str], split_rows: int = SPLIT_ROWS) -> DataFrame | None:
    """The keys with more than ``split_rows`` rows (as ``_hot_<key>``), or None when there are none.

    One count by key with map-side sums, written out: it is read several times.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > split_rows)
    hot = store(sizes.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]), "hot-keys")
    return None if hot.isEmpty() else hot


def _positions_split(rows: DataFrame, keys: Sequence[str], order_by: Sequence[str], name: str) -> DataFrame:
    """Zero-based position within its key of every row of large keys.

    The rows are range-partitioned by key, order columns and a hash of the whole row, so that
    one key, and rows tied in its order, spread over many ranges; only copies of one row stay
    together. The ranges are sorted and written as files in their order, so that several files of
    one range, and several pieces of one file, follow each other, too; rows are numbered within a
    piece of a file and shifted by the rows of their key in the pieces before it.
    """
    tie = F.xxhash64(*[F.col(c) for c in rows.columns])
    ranged = rows.withColumn("_tie", tie).repartitionByRange(*keys, *order_by, "_tie")
    stored = store(ranged.sortWithinPartitions(*keys, *order_by, "_tie"), "ranges")
    # Files carry the number of their range and their own within it, with more digits beyond 99,999 and 999.
    file = F.col("_metadata.file_name")
    number = F.lpad(F.regexp_extract(file, "part-([0-9]+)", 1), 12, "0")
    within_range = F.lpad(F.regexp_extract(file, "-c([0-9]+)[.]", 1), 12, "0")
    placed = stored.select("*", F.concat(number, within_range, file).alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    piece = ["_file", "_start"]
    sizes = placed.groupBy(*keys, *piece).agg(F.count(F.lit(1)).alias("_rows"))
    # One row for each piece of a key.
    earlier = Window.partitionBy(*keys).orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys],
        F.col("_file").alias("_f"),
        F.col("_start").alias("_s"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift"),
    )
    within = Window.partitionBy(*keys, *piece).orderBy(*order_by, "_tie")
    ranked = placed.withColumn("_rank", F.row_number().over(within))
    same = _same_keys(ranked, shifts, keys) & (ranked["_file"] == shifts["_f"]) & (ranked["_start"] == shifts["_s"])
    joined = ranked.join(shifts, same).withColumn(name, F.col("_rank") - 1 + F.col("_shift"))
    return joined.select(*rows.columns, name)


def _apart(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys, and rows of large ones."""
    same = _same_keys(df, hot, keys)
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    name: str = "row_idx",
    split_hot: bool = True,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Zero-based position of each row within its key."""
    hot = hot_keys(df, keys, split_rows) if split_hot else None
    plain, large = (df, None) if hot is None else _apart(df, keys, hot)
    w = Window.partitionBy(*keys).orderBy(*order_by)
    numbered = plain.withColumn(name, F.row_number().over(w).cast("long") - 1)
    return numbered if large is None else numbered.unionByName(_positions_split(large, keys, order_by, name))


def with_bounded_window(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    before: int,
    after: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    split_hot: bool = True,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Add window columns whose frames reach at most ``before`` / ``after`` rows.

    ``build`` gets the window (partition and order) and returns the columns. Pass
    ``split_hot=False`` where keys are bounded anyway, such as one row a day.
    """
    hot = hot_keys(df, keys, split_rows) if split_hot else None
    plain, large = (df, None) if hot is None else _apart(df, keys, hot)
    whole = plain.withColumns(build(Window.partitionBy(*keys).orderBy(*order_by)))
    if large is None:
        return whole
    block_rows = max(split_rows, before, after)
    placed = _positions_split(large, keys, order_by, "_pos")
    home = F.expr(f"_pos div {block_rows}")
    offset = F.col("_pos") % block_rows
    targets = F.array(home)
    if before:
        targets = F.concat(
            targets, F.when(offset >= block_rows - before, F.array(home + 1)).otherwise(F.array().cast("array<bigint>"))
        )
    if after:
        targets = F.concat(
            targets, F.when(offset < after, F.array(home - 1)).otherwise(F.array().cast("array<bigint>"))
        )
    spread = placed.withColumn("_home", home).withColumn("_block", F.explode(targets))
    computed = spread.withColumns(build(Window.partitionBy(*keys, "_block").orderBy("_pos")))
    split = computed.filter(F.col("_block") == F.col("_home")).drop("_pos", "_home", "_block")
    return whole.unionByName(split)


def literal_bucket(column: str, cuts: Sequence[float]) -> Column:
    """How many of the sorted literal ``cuts`` lie at or below ``column``.

    Up to 255 cuts become a balanced tree of comparisons, which compiles to eight
    of them; more are searched by halving in an array.
    """
    numbers = [f"cast('{float(c)!r}' AS double)" for c in cuts]

    def node(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN `{column}` >= {numbers[mid]} THEN {node(mid + 1, hi)} ELSE {node(lo, mid)} END"

    if len(cuts) < 256:
        return F.expr(node(0, len(cuts)))
    bits = len(cuts).bit_length()
    numbers += ["cast('inf' AS double)"] * (2**bits - 1 - len(cuts))
    sorted_cuts = F.expr(f"array({', '.join(numbers)})")
    return F.aggregate(
        F.array(*[F.lit(1 << b) for b in reversed(range(bits))]),
        F.lit(0),
        lambda at, step: F.when(F.element_at(sorted_cuts, at + step) <= F.col(column), at + step).otherwise(at),
    )
