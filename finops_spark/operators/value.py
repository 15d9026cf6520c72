"""Value at stake: fits weighted by balance, and how much of it a ranking captures.

A missed default costs its outstanding balance, a needless contact a fixed amount; these two
are the cost matrix of the fit. A ranking is judged by the balance of the defaults among the
accounts it puts first. Equal scores are one row first, with map-side sums; running totals are
taken inside score ranges and shifted by the totals of the higher ranges. Money is summed as
decimals, so the order of the rows does not show.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finops_spark.errors import FitError, SchemaError
from finops_spark.functions.scalar import missing, require
from finops_spark.operators.curves import MAX_RANGES, score_ranges
from finops_spark.operators.ordered import SPLIT_ROWS, literal_bucket

MONEY = "decimal(28,4)"


def value_weights(train: DataFrame, label: str, value: str, contact_cost: float, name: str = "value_weight") -> DataFrame:
    """Add a weight: the balance for label 1, ``contact_cost`` for label 0, scaled to add up to the number of rows.

    Labels other than 0 and 1, a positive without a balance above zero, and tables without both classes are refused."""
    require(train, [label, value], "training table")
    if contact_cost <= 0:
        raise FitError(f"contact_cost must be above 0, got {contact_cost}")
    one = F.col(label) == 1
    bad_value = missing(train, value) | ~(F.col(value) > 0) | (F.col(value).cast("double") == float("inf"))
    seen = train.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(one).alias("ones"),
        F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1)).alias("other"),
        F.count_if(one & bad_value).alias("bad"),
        F.sum(F.when(one, F.col(value).cast("double"))).alias("balance"),
    ).first()
    if seen["other"] or not 0 < seen["ones"] < seen["n"]:
        raise FitError(f"both classes 0 and 1 are needed: {seen['ones']} of {seen['n']} rows are 1, {seen['other']} neither")
    if seen["bad"]:
        raise FitError(f"{seen['bad']} positives have no {value} above 0")
    scale = seen["n"] / (seen["balance"] + contact_cost * (seen["n"] - seen["ones"]))
    return train.withColumn(name, F.when(one, F.col(value).cast("double") * scale).otherwise(F.lit(contact_cost * scale)))


def value_curve(
    df: DataFrame, label: str = "label", score: str = "score", value: str = "value", max_ranges: int = MAX_RANGES, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """One row for each distinct score: (threshold, n, captured, n_top, captured_top, n_all, captured_all).

    ``n`` accounts have exactly that score and ``captured`` is the value of those with label 1; ``_top`` counts
    all accounts at or above it, ``_all`` the whole table. A missing score, a label other than 0 and 1, and a
    missing or negative value raise when read. An empty table gives no rows."""
    require(df, [label, score, value], "scored table")
    checks = {
        "_s": (missing(df, score), score, "has missing values"),
        "_l": (F.col(label).isNull() | ~F.col(label).cast("double").isin(0.0, 1.0), label, "has values other than 0 and 1"),
        "_v": (missing(df, value) | (F.col(value) < 0), value, "has missing or negative values"),
    }
    sound = df.select(*[F.when(bad, F.raise_error(F.lit(f"{c} {what}"))).otherwise(F.col(c)).alias(a) for a, (bad, c, what) in checks.items()])
    cuts = score_ranges(sound, "_s", max_ranges, split_rows)
    money = F.when(F.col("_l") == 1, F.col("_v")).otherwise(F.lit(0)).cast(MONEY)
    per_score = sound.groupBy(F.col("_s").alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(money).alias("captured"))
    per_score = per_score.withColumn("_range", literal_bucket("threshold", cuts))
    # One row for each range: at most len(cuts) + 1.
    whole = Window.partitionBy(F.lit(0))
    higher = whole.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = per_score.groupBy("_range").agg(F.sum("n").alias("_n"), F.sum("captured").alias("_c")).select(
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_n_above"),
        F.coalesce(F.sum("_c").over(higher), F.lit(0)).alias("_c_above"),
        F.sum("_n").over(whole).alias("n_all"),
        F.sum("_c").over(whole).alias("captured_all"),
    )
    down = Window.partitionBy("_range").orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = per_score.withColumns({"_n_in": F.sum("n").over(down), "_c_in": F.sum("captured").over(down)})
    running = running.join(F.broadcast(totals), F.col("_range") == F.col("_r"))
    return running.select(
        "threshold", "n", "captured", (F.col("_n_above") + F.col("_n_in")).alias("n_top"), (F.col("_c_above") + F.col("_c_in")).alias("captured_top"), "n_all", "captured_all"
    )


def captured_at(curve: DataFrame, percents: Sequence[int]) -> DataFrame:
    """(percent, n_taken, captured, captured_share): the value in the first ``percent`` of all accounts, rounded down.

    Accounts that tie at the border enter in equal parts: each counts with the share of them that is taken. A
    table without captured value has a share of 0, an empty one no value at all."""
    wrong = [p for p in percents if not 0 <= p <= 100]
    if wrong or not percents:
        raise SchemaError(f"percents must be whole numbers from 0 to 100, got {list(percents)}")
    parts = []
    for i, p in enumerate(percents):
        taken = F.floor(F.col("n_all") * F.lit(int(p)) / 100)
        before = F.col("n_top") - F.col("n")
        inside = F.when(F.col("n_top") <= taken, F.col("captured"))
        border = F.when((before < taken) & (taken < F.col("n_top")), F.col("captured").cast("double") * (taken - before) / F.col("n"))
        parts += [F.max(taken).alias(f"k{i}"), F.sum(inside).alias(f"v{i}"), F.max(border).alias(f"b{i}")]
    row = curve.agg(F.max("captured_all").cast("double").alias("_all"), *parts)
    each = [
        F.struct(F.lit(int(p)).alias("percent"), F.coalesce(F.col(f"k{i}"), F.lit(0)).alias("n_taken"), (F.coalesce(F.col(f"v{i}").cast("double"), F.lit(0.0)) + F.coalesce(F.col(f"b{i}"), F.lit(0.0))).alias("captured"))
        for i, p in enumerate(percents)
    ]
    out = row.select("_all", F.explode(F.array(*each)).alias("e")).select("_all", "e.*")
    return out.withColumn("captured_share", F.coalesce(F.try_divide(F.col("captured"), F.col("_all")), F.lit(0.0))).drop("_all")


def compare_rankings(df: DataFrame, scores: Sequence[str], percents: Sequence[int], label: str = "label", value: str = "value") -> DataFrame:
    """(ranking, percent, n_taken, captured, captured_share) of each of several score columns."""
    if not scores:
        raise SchemaError("no score columns")
    tables = [captured_at(value_curve(df, label, s, value), percents).select(F.lit(s).alias("ranking"), "*") for s in scores]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
