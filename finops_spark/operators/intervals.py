"""Matching of flags with labelled intervals, and detection quality.

Both ends of an interval are inclusive. Flags and intervals meet on the asset
and on a coarse span of days, so that a long history of one busy asset spreads
over many tasks and a flag is compared only with intervals near it in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finops_spark.errors import IntervalError, SchemaError
from finops_spark.functions.scalar import require, safe_ratio
from finops_spark.operators.ordered import with_position
from finops_spark.operators.rows import side_by_side

SPAN_DAYS = 32


def _span(day: Column, span_days: int) -> Column:
    return F.floor(F.unix_date(day) / F.lit(span_days))


def contained_pairs(flags: DataFrame, intervals: DataFrame, span_days: int = SPAN_DAYS) -> DataFrame:
    """Every (asset, date) with each interval that contains it.

    ``flags``: asset, date (other columns are kept). ``intervals``: asset, seq,
    start_date, end_date, where ``seq`` is the order in the label file.
    """
    require(flags, ["asset", "date"], "flags")
    require(intervals, ["asset", "seq", "start_date", "end_date"], "intervals")
    # An interval is repeated once for each span it touches; a flag has one span.
    spread = intervals.filter(F.col("start_date") <= F.col("end_date")).select(
        F.col("asset").alias("i_asset"),
        "seq",
        "start_date",
        "end_date",
        F.explode(
            F.sequence(_span(F.col("start_date"), span_days), _span(F.col("end_date"), span_days))
        ).alias("i_span"),
    )
    placed = flags.withColumn("_span", _span(F.col("date"), span_days))
    return placed.join(
        spread,
        (F.col("asset") == F.col("i_asset"))
        & (F.col("_span") == F.col("i_span"))
        & F.col("date").between(F.col("start_date"), F.col("end_date")),
        "inner",
    ).drop("i_asset", "_span", "i_span")


def flag_counts(flags: DataFrame) -> DataFrame:
    """Flags by (asset, date); equal flags always match equal intervals."""
    return flags.groupBy("asset", "date").agg(F.count(F.lit(1)).alias("n_flags"))


def credited_pairs(flags: DataFrame, intervals: DataFrame, span_days: int = SPAN_DAYS) -> DataFrame:
    """The pairs of ``contained_pairs`` with ``is_first``: whether the interval is the first, in
    label order, of those that contain the flag. All matching below starts from this one join."""
    pairs = contained_pairs(flag_counts(flags), intervals, span_days)
    first = F.min("seq").over(Window.partitionBy("asset", "date"))
    return pairs.withColumn("is_first", F.col("seq") == first)


def first_matches(flags: DataFrame, intervals: DataFrame, span_days: int = SPAN_DAYS) -> DataFrame:
    """For each flagged (asset, date): the containing interval that comes first
    in label order."""
    pairs = credited_pairs(flags, intervals, span_days).filter("is_first")
    return pairs.select("asset", "date", "n_flags", "seq", "start_date", "end_date")


def split_flags(flags: DataFrame, intervals: DataFrame, span_days: int = SPAN_DAYS) -> DataFrame:
    """Flagged (asset, date) with ``is_hit``: inside at least one interval."""
    counted = flag_counts(flags)
    hit = contained_pairs(counted, intervals, span_days).select("asset", "date").distinct()
    return counted.join(hit.withColumn("is_hit", F.lit(True)), ["asset", "date"], "left").withColumn(
        "is_hit", F.coalesce("is_hit", F.lit(False))
    )


def interval_outcomes(
    flags: DataFrame,
    intervals: DataFrame,
    match: str = "first",
    span_days: int = SPAN_DAYS,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """One row for each interval: ``is_hit``, first flag inside it and latency.

    ``match="first"``: a flag counts for the first containing interval only, and
    intervals of an asset that share a start share the hit. ``match="any"``: an
    interval is hit when any flag lies inside. Latency is in calendar days, or in
    rows when ``calendar`` (asset, date, row_idx) is given.
    """
    return _outcomes(flags, intervals, match, span_days, calendar).drop("credited")


def _outcomes(
    flags: DataFrame, intervals: DataFrame, match: str, span_days: int, calendar: DataFrame | None
) -> DataFrame:
    """``interval_outcomes`` with ``credited``, the flags for which the interval is the first."""
    if match not in ("first", "any"):
        raise SchemaError(f"match must be 'first' or 'any', got {match!r}")
    per_interval = (
        credited_pairs(flags, intervals, span_days)
        .groupBy("seq")
        .agg(F.min("date").alias("first_flag"), F.sum(F.when(F.col("is_first"), F.col("n_flags"))).alias("credited"))
    )
    seen = intervals.join(per_interval, "seq", "left")
    if match == "first":
        shared = F.max("credited").over(Window.partitionBy("asset", "start_date"))
        seen = seen.withColumn("is_hit", shared.isNotNull())
    else:
        seen = seen.withColumn("is_hit", F.col("first_flag").isNotNull())
    if calendar is None:
        latency = F.datediff("first_flag", "start_date")
    else:
        for role, day in (("_from", "start_date"), ("_to", "first_flag")):
            rows = calendar.select("asset", F.col("date").alias(day), F.col("row_idx").alias(role))
            seen = seen.join(rows, ["asset", day], "left")
        latency = F.col("_to") - F.col("_from")
    return seen.select(
        "seq",
        "asset",
        "start_date",
        "end_date",
        "is_hit",
        F.when(F.col("is_hit"), F.col("first_flag")).alias("first_flag"),
        F.when(F.col("is_hit"), latency).alias("latency"),
        F.coalesce("credited", F.lit(0).cast("long")).alias("credited"),
    )


def detection_metrics(
    flags: DataFrame,
    intervals: DataFrame,
    match: str = "first",
    span_days: int = SPAN_DAYS,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, avg_latency; undefined ratios are 0."""
    n_flags = flags.agg(F.count(F.lit(1)).alias("n_flags"))
    interval_side = _outcomes(flags, intervals, match, span_days, calendar).agg(
        F.count(F.lit(1)).alias("n_intervals"),
        F.count_if("is_hit").alias("n_hit"),
        F.coalesce(F.sum("credited"), F.lit(0).cast("long")).alias("tp"),
        F.avg("latency").alias("mean_latency"),
    )
    both = side_by_side(n_flags, interval_side).withColumn("fp", F.col("n_flags") - F.col("tp"))
    return both.select(
        "tp",
        "fp",
        (F.col("n_intervals") - F.col("n_hit")).alias("fn"),
        safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        safe_ratio(F.col("n_hit"), F.col("n_intervals")).alias("recall"),
        F.coalesce("mean_latency", F.lit(0.0)).alias("avg_latency"),
    )


def row_calendar(prices: DataFrame, asset: str = "asset", date: str = "date") -> DataFrame:
    """(asset, date, row_idx): zero-based row of each date within its asset."""
    return with_position(prices.select(F.col(asset).alias("asset"), F.col(date).alias("date")), ["asset"], ["date"])


def intervals_to_dates(intervals: DataFrame, calendar: DataFrame, strict: bool = True) -> DataFrame:
    """Turn row positions into dates; intervals that have dates pass unchanged.

    ``intervals``: asset_id, window_start_idx, window_end_idx and seq, their order (rows of
    a DataFrame have none of their own). With ``strict`` an unknown asset or a position outside the calendar
    raises, and so does an empty label table.
    """
    if {"asset", "start_date", "end_date"} <= set(intervals.columns) and "asset_id" not in intervals.columns:
        return intervals
    require(intervals, ["asset_id", "window_start_idx", "window_end_idx", "seq"], "intervals")
    named = intervals
    at = calendar.select("asset", "date", "row_idx")
    start = at.select(
        F.col("asset").alias("_sa"), F.col("row_idx").alias("_si"), F.col("date").alias("start_date")
    )
    end = at.select(F.col("asset").alias("_ea"), F.col("row_idx").alias("_ei"), F.col("date").alias("end_date"))
    dated = (
        named.join(start, (F.col("asset_id") == F.col("_sa")) & (F.col("window_start_idx") == F.col("_si")), "left")
        .join(end, (F.col("asset_id") == F.col("_ea")) & (F.col("window_end_idx") == F.col("_ei")), "left")
        .select("seq", F.col("asset_id").alias("asset"), "window_start_idx", "window_end_idx", "start_date", "end_date")
    )
    if strict:
        state = dated.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("start_date").isNull() | F.col("end_date").isNull()).alias("bad"),
        ).first()
        if state["n"] == 0:
            raise IntervalError("no labelled intervals")
        if state["bad"]:
            sample = dated.filter(F.col("start_date").isNull() | F.col("end_date").isNull()).limit(5)
            shown = [(r["asset"], r["window_start_idx"], r["window_end_idx"]) for r in sample.collect()]
            raise IntervalError(f"{state['bad']} intervals have an unknown asset or row, such as {shown}")
    return dated.select("seq", "asset", "start_date", "end_date")
