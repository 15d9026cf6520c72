"""Writers. Output stays as many files as there are tasks; nothing is coalesced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finops_spark.operators.alerts import alert_lines


def write_alerts(flags: DataFrame, path: str, level: str = "INFO") -> None:
    """Alert lines ordered by asset and date, each with a time and level prefix.

    The order is global across the part files; an earlier run is overwritten.
    """
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    lines = alert_lines(flags).orderBy("asset", "date")
    lines.select(F.concat_ws("|", stamp, F.lit(level), F.col("line")).alias("value")).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """Any report table (calibration, threshold, errors, repair, metadata) as JSON."""
    df.write.mode("overwrite").json(path)


def write_predictions(scored: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = scored.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"format must be 'csv' or 'parquet', got {fmt!r}")


def write_sorted(df: DataFrame, path: str, by: list[str]) -> None:
    """A reproducible copy, sorted by the given columns over all part files."""
    df.orderBy(*by).write.mode("overwrite").parquet(path)


def write_series(df: DataFrame, path: str, key: str = "series_id", date: str = "ts") -> None:
    """Series clustered by key and in date order inside each file; no global sort."""
    df.repartition(key).sortWithinPartitions(key, date).write.mode("overwrite").parquet(path)
