"""Alert lines and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finops_spark.functions.scalar import require

# Fixed value: the line format read by downstream log parsers.
EVENT_FORMAT = "EVENT|asset=%s|date=%s|rolling_stdev=%.8f"


def alert_lines(flags: DataFrame, asset: str = "asset", date: str = "date") -> DataFrame:
    """One text line for each flag, in a column ``line`` beside its sort keys."""
    require(flags, [asset, date, "rolling_stdev"], "flags")
    line = F.format_string(
        EVENT_FORMAT, F.col(asset).cast("string"), F.col(date).cast("string"), F.col("rolling_stdev")
    )
    return flags.select(F.col(asset).alias("asset"), F.col(date).alias("date"), line.alias("line"))


def alert_summary(flags: DataFrame, asset: str = "asset") -> DataFrame:
    """One row: number of flags and number of assets with at least one."""
    per_asset = flags.groupBy(asset).agg(F.count(F.lit(1)).alias("n"))
    return per_asset.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total_events"),
        F.count(F.lit(1)).alias("unique_assets"),
    )


def affected_assets(flags: DataFrame, asset: str = "asset") -> DataFrame:
    """The flagged assets with their flag counts, as a table rather than a list,
    because the number of assets has no bound."""
    return flags.groupBy(asset).agg(F.count(F.lit(1)).alias("events"))
