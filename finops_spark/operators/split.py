"""Stratified splits with exact counts, and time-series folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finops_spark.errors import SplitError
from finops_spark.functions.scalar import require
from finops_spark.operators.ordered import SPLIT_ROWS, with_position
from finops_spark.session import store

# Shares of the two standard layouts.
THREE_WAY = {"train": "0.6", "calibration": "0.2", "test": "0.2"}
TWO_WAY = {"train": "0.8", "test": "0.2"}

# Rows are counted by class and by the top bits of their hash before any cut is placed.
_RANGE_BITS = 20
# Classes up to which their cuts are broadcast: one short row each.
_BROADCAST_CLASSES = 100_000


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share) of each class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # The total is a scalar subquery over the counts: no task holds all classes.
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def _part_ends(n: Column, exact: Mapping[str, Decimal]) -> list[Column]:
    """Number of rows of a class of ``n`` up to the end of each part but the last."""
    ends, end = [], F.lit(0).cast("long")
    for share in list(exact.values())[:-1]:
        end = end + F.floor(n.cast("decimal(20,0)") * F.lit(share)).cast("long")
        ends.append(end)
    return ends


def hash_cuts(hashed: DataFrame, label: str, exact: Mapping[str, Decimal]) -> DataFrame:
    """(label, k, cut, take, ties): for each class and each part end the hash ``cut`` at which it
    lies, and how many of the ``ties`` rows with exactly this hash still belong before it.

    Counts by class and hash range, combined on the map side, tell in which range an end
    falls; only the hashes of these few ranges are then counted one by one.
    """
    placed = hashed.withColumn("_range", F.shiftright("_h", 64 - _RANGE_BITS))
    cells = placed.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("_cell"))
    by_class = Window.partitionBy(label)
    upto = by_class.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({"_upto": F.sum("_cell").over(upto), "_n": F.sum("_cell").over(by_class)})
    ends = _part_ends(F.col("_n"), exact)
    each = cells.select("*", F.posexplode(F.array(*ends)).alias("k", "_end"))
    inside = each.filter((F.col("_upto") - F.col("_cell") < F.col("_end")) & (F.col("_end") <= F.col("_upto"))).select(
        F.col(label).alias("_label"), F.col("_range").alias("_r"), "k", (F.col("_end") - F.col("_upto") + F.col("_cell")).alias("_need")
    )
    inside = store(inside, "part-ends")
    ranges = inside.select("_label", "_r").distinct()
    here = placed.select(label, "_range", "_h").join(ranges, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_r")), "left_semi")
    singly = here.groupBy(label, "_range", "_h").agg(F.count(F.lit(1)).alias("ties"))
    at = singly.join(inside, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_r")))
    below = F.sum("ties").over(Window.partitionBy(label, "k").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ties")
    at = at.withColumn("take", F.col("_need") - below)
    return at.filter((F.col("take") > 0) & (F.col("take") <= F.col("ties"))).select(label, "k", F.col("_h").alias("cut"), "take", "ties")


def _tie_ranks(ties: DataFrame, label: str) -> DataFrame:
    """Add ``_tie``, the zero-based place of each row among those of its class and hash.

    Rows with one hash are copies of each other, so any order will do, but there may be very
    many: they are numbered within the pieces of a stored table and shifted by earlier pieces.
    """
    placed = store(ties, "ties").withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumn("_piece", F.shiftright("_id", 33))
    group = [label, "_h"]
    sizes = placed.groupBy(*group, "_piece").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        F.col(label).alias("_sl"), F.col("_h").alias("_sh"), F.col("_piece").alias("_sp"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift")
    )
    numbered = placed.withColumn("_in", F.row_number().over(Window.partitionBy(*group, "_piece").orderBy("_id")) - 1)
    same = F.col(label).eqNullSafe(F.col("_sl")) & (F.col("_h") == F.col("_sh")) & (F.col("_piece") == F.col("_sp"))
    return numbered.join(shifts, same).withColumn("_tie", F.col("_in") + F.col("_shift")).drop("_id", "_piece", "_in", "_sl", "_sh", "_sp", "_shift")


def stratified_split(
    df: DataFrame,
    label: str,
    shares: Mapping[str, str] = THREE_WAY,
    seed: int = 42,
    name: str = "split",
    allow_empty: bool = False,
) -> DataFrame:
    """Add ``split``: within each class the first floor(share * n) rows by seeded
    hash go to the first part, and so on; the last part takes the rest. A part that
    gets no row at all raises, unless ``allow_empty``.

    Shares are decimal text: 0.6 * n in binary can fall just short of a whole. Rows
    are not moved: each compares its hash with the cuts of its class.
    """
    require(df, [label], "table to split")
    exact = {k: Decimal(str(v)) for k, v in shares.items()}
    if sum(exact.values()) != 1:
        raise SplitError(f"shares {dict(shares)} do not add up to 1")
    names = list(exact)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ends = [F.lit(0).cast("long"), *_part_ends(F.col("_n"), exact), F.col("_n")]
    totals = sizes.agg(F.count(F.lit(1)).alias("classes"), *[F.coalesce(F.sum(b - a), F.lit(0)).alias(f"p{i}") for i, (a, b) in enumerate(zip(ends, ends[1:]))]).first()
    empty = [p for i, p in enumerate(names) if totals[f"p{i}"] == 0]
    if empty and not allow_empty:
        raise SplitError(f"no rows for the parts {empty}")
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns]))
    cuts = store(hash_cuts(hashed, label, exact), "cuts")
    pick = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"_{c}{k}") for k in range(len(names) - 1) for c in ("cut", "take", "ties")]
    wide = cuts.groupBy(F.col(label).alias("_label")).agg(*pick)
    if totals["classes"] <= _BROADCAST_CLASSES:
        wide = F.broadcast(wide)
    joined = hashed.join(wide, F.col(label).eqNullSafe(F.col("_label")), "left")
    shared = F.lit(False)
    for k in range(len(names) - 1):
        shared = shared | ((F.col("_h") == F.col(f"_cut{k}")) & (F.col(f"_take{k}") < F.col(f"_ties{k}")))
    shared = F.coalesce(shared, F.lit(False))

    def parted(rows: DataFrame, tie: Column) -> DataFrame:
        part: Column = F.lit(names[-1])
        for k in reversed(range(len(names) - 1)):
            before = (F.col("_h") < F.col(f"_cut{k}")) | ((F.col("_h") == F.col(f"_cut{k}")) & (tie < F.col(f"_take{k}")))
            part = F.when(before, F.lit(names[k])).otherwise(part)
        return rows.withColumn(name, part).select(*df.columns, name)

    # Only copies of one row that an end divides have to be told apart.
    if cuts.filter(F.col("take") < F.col("ties")).isEmpty():
        return parted(joined, F.lit(0))
    return parted(joined.filter(~shared), F.lit(0)).unionByName(parted(_tie_ranks(joined.filter(shared), label), F.col("_tie")))


def split_part(df: DataFrame, part: str, name: str = "split") -> DataFrame:
    return df.filter(F.col(name) == part).drop(name)


def split_summary(df: DataFrame, label: str, name: str = "split") -> DataFrame:
    """(split, n, positives, positive_rate)."""
    return df.groupBy(name).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(label).cast("long")).alias("positives"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
    )


def stratification_check(
    df: DataFrame, label: str, parts: Sequence[str] = tuple(THREE_WAY), tolerance: float = 0.02, name: str = "split"
) -> DataFrame:
    """(split, label, n, share, overall_share, deviation, passed).

    Fails where a class is missing from a part or its share is off by more than
    the tolerance (compared as decimals of 12 places).
    """
    by_class = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col(name) == p).alias(f"_p{i}") for i, p in enumerate(parts)]
    )
    # Totals are a scalar subquery over the counts: no task holds all classes.
    sums = by_class.agg(F.struct(F.sum("_all").alias("all"), *[F.sum(f"_p{i}").alias(f"p{i}") for i in range(len(parts))]))
    counted = by_class.withColumn("_sums", sums.scalar())
    totals = {f"_t{i}": F.col(f"_sums.p{i}") for i in range(len(parts))}
    totals["overall_share"] = F.col("_all") / F.col("_sums.all")
    entries = [
        F.struct(
            F.lit(p).alias("split"),
            F.col(f"_p{i}").alias("n"),
            F.coalesce(F.try_divide(F.col(f"_p{i}"), F.col(f"_t{i}")), F.lit(0.0)).alias("share"),
        )
        for i, p in enumerate(parts)
    ]
    sized = counted.withColumns(totals).select(label, "overall_share", F.explode(F.array(*entries)).alias("e"))
    deviation = F.abs(F.col("e.share") - F.col("overall_share"))
    within = F.round(deviation, 12) <= F.lit(float(tolerance))
    return sized.select(
        F.col("e.split").alias(name),
        label,
        F.col("e.n").alias("n"),
        F.col("e.share").alias("share"),
        "overall_share",
        deviation.alias("deviation"),
        ((F.col("e.n") > 0) & within).alias("passed"),
    )


def enforce_stratification(report: DataFrame, label: str, name: str = "split") -> None:
    failed = report.filter(~F.col("passed")).limit(5).collect()
    if failed:
        what = "different classes" if any(r["n"] == 0 for r in failed) else "Deviation above tolerance"
        raise SplitError(f"{what}: {[(r[name], r[label], r['share'], r['overall_share']) for r in failed]}")


# --- time-series folds --------------------------------------------------------------


def _check_fold_parameters(n_splits, valid_size, gap, train_size, initial_train_size) -> None:
    if n_splits <= 0:
        raise SplitError(f"folds need n_splits of 1 or more; {n_splits} given")
    if valid_size <= 0:
        raise SplitError(f"folds need valid_size of 1 or more; {valid_size} given")
    if gap < 0:
        raise SplitError(f"a gap of {gap} rows cannot be left out")
    for name, size in (("train_size", train_size), ("initial_train_size", initial_train_size)):
        if size is not None and size <= 0:
            raise SplitError(f"folds need {name} of 1 or more; {size} given")


def first_train_end(
    n: Column,
    n_splits: int = 5,
    valid_size: int = 1,
    gap: int = 0,
    expanding: bool = True,
    train_size: int | None = None,
    initial_train_size: int | None = None,
) -> Column:
    """Where the training rows of fold 0 end; a series too short for the layout
    raises when it is read."""
    _check_fold_parameters(n_splits, valid_size, gap, train_size, initial_train_size)
    rows = n.cast("long")
    step = _fold_step(valid_size, gap, expanding)
    given = initial_train_size if expanding else train_size
    tail = (n_splits - 1) * step + gap + valid_size
    base = F.lit(given).cast("long") if given else rows - tail
    message = F.concat(F.lit("series too short for the folds: rows "), rows.cast("string"))
    return F.when((base > 0) & (base + tail <= rows), base).otherwise(F.raise_error(message))


def _fold_step(valid_size: int, gap: int, expanding: bool) -> int:
    return valid_size + gap if expanding else valid_size


def fold_bounds(n: Column, expanding: bool = True, **layout) -> Column:
    """Array of (fold, train_lo, train_hi, valid_lo, valid_hi) for ``n`` rows.

    Upper ends are exclusive and folds count from 0. Expanding folds train on all
    rows before the gap and end one validation block and gap later each time;
    sliding ones keep their size and move on by ``valid_size``.
    """
    base = first_train_end(n, expanding=expanding, **layout)
    valid_size, gap = layout.get("valid_size", 1), layout.get("gap", 0)
    step = _fold_step(valid_size, gap, expanding)
    folds = []
    for i in range(layout.get("n_splits", 5)):
        hi = base + i * step
        folds.append(
            F.struct(
                F.lit(i).alias("fold"),
                F.lit(0 if expanding else i * step).cast("long").alias("train_lo"),
                hi.alias("train_hi"),
                (hi + gap).alias("valid_lo"),
                (hi + gap + valid_size).alias("valid_hi"),
            )
        )
    return F.array(*folds)


def training_block(row_idx: Column, base: Column, expanding: bool = True, **layout) -> Column:
    """Start of the stretch between fold bounds that a row lies in.

    All training ranges are unions of such stretches, so statistics are gathered
    once for each stretch and added up for each fold.
    """
    step = _fold_step(layout.get("valid_size", 1), layout.get("gap", 0), expanding)
    last = layout.get("n_splits", 5) - 1

    def edge(origin: Column) -> Column:
        return origin + F.least(F.floor((row_idx - origin) / step), F.lit(last).cast("long")) * step

    ends = F.when(row_idx >= base, edge(base)).otherwise(F.lit(0).cast("long"))
    return ends if expanding else F.greatest(edge(F.lit(0).cast("long")), ends)


def validation_fold(row_idx: Column, base: Column, expanding: bool = True, **layout) -> Column:
    """The one fold a row validates, NULL for other rows."""
    valid_size, gap = layout.get("valid_size", 1), layout.get("gap", 0)
    step = _fold_step(valid_size, gap, expanding)
    since = row_idx - base - gap
    fold = F.floor(since / step)
    used = (since >= 0) & (fold < layout.get("n_splits", 5)) & (since - fold * step < valid_size)
    return F.when(used, fold).cast("int")


def fold_table(
    sizes: DataFrame, key: str = "series_id", n: str = "n_rows", expanding: bool = True, **layout
) -> DataFrame:
    """(key, fold, role, lo, hi): bounds of every fold of every series."""
    bounds = fold_bounds(F.col(n), expanding=expanding, **layout)
    each = sizes.select(key, F.explode(bounds).alias("f"))
    roles = F.array(
        F.struct(F.lit("train").alias("role"), F.col("f.train_lo").alias("lo"), F.col("f.train_hi").alias("hi")),
        F.struct(F.lit("valid").alias("role"), F.col("f.valid_lo").alias("lo"), F.col("f.valid_hi").alias("hi")),
    )
    return each.select(key, F.col("f.fold").alias("fold"), F.explode(roles).alias("r")).select(key, "fold", "r.*")


def assign_folds(
    df: DataFrame, row_idx: str = "row_idx", n: str = "n_rows", expanding: bool = True, **layout
) -> DataFrame:
    """One row for each fold and role that uses the input row.

    The bounds follow from the series length, so no join is needed: each row
    carries its position and length and keeps the folds it belongs to.
    """
    at = F.col(row_idx)
    bounds = fold_bounds(F.col(n), expanding=expanding, **layout)
    roles = F.flatten(
        F.transform(
            bounds,
            lambda f: F.filter(
                F.array(
                    F.struct(f["fold"].alias("fold"), F.lit("train").alias("role"),
                             ((at >= f["train_lo"]) & (at < f["train_hi"])).alias("uses")),
                    F.struct(f["fold"].alias("fold"), F.lit("valid").alias("role"),
                             ((at >= f["valid_lo"]) & (at < f["valid_hi"])).alias("uses")),
                ),
                lambda r: r["uses"],
            ),
        )
    )
    return df.withColumn("_role", F.explode(roles)).select(*df.columns, "_role.fold", "_role.role")


def with_series_rows(df: DataFrame, key: str = "series_id", date: str = "ts", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Add ``row_idx`` and ``n_rows`` within each series, of any length: positions are written once, and the
    counts join rows that Spark may split by itself."""
    placed = store(with_position(df, [key], [date], "row_idx", split_rows=split_rows), "positions")
    sizes = placed.groupBy(F.col(key).alias("_series")).agg(F.count(F.lit(1)).alias("n_rows"))
    return placed.join(sizes, F.col(key).eqNullSafe(F.col("_series"))).drop("_series")
