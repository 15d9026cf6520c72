"""The monitor and scoring on streams give what the batch forms give."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from finops_spark.operators.flat import flag_flat
from finops_spark.operators.models import ScoringBundle, score_batch
from finops_spark.streaming.monitor import flag_flat_stream, score_stream

SCHEMA = "asset string, ts timestamp, price double"


def prices(spark):
    rng = np.random.default_rng(2)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for a in ("x", "y", "z"):
        p = np.round(rng.normal(10, 1, 60), 2)
        p[20:32] = 7.0
        rows += [(a, start + dt.timedelta(hours=i), float(v)) for i, v in enumerate(p)]
    return spark.createDataFrame(rows, SCHEMA)


def run(stream, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


END = dt.datetime(2024, 3, 1)  # a last row of another asset, which moves the watermark past all others


def fed(spark, tmp_path, parts):
    """A stream that reads one part at a trigger."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def hours(df, lo, hi):
    return df.filter((F.unix_seconds("ts") - 1704067200).between(lo * 3600, hi * 3600 - 1))


def key(table):
    return sorted((r.asset, r.ts, round(r.rolling_stdev, 9)) for r in table.collect())


def test_stream_flags_equal_batch_flags(spark, tmp_path):
    df = prices(spark)
    last = spark.createDataFrame([("end", END, 1.0)], SCHEMA)
    # Several files, read one at a trigger, so windows cross trigger borders.
    stream = fed(spark, tmp_path, [hours(df, 0, 23), hours(df, 23, 41), hours(df, 41, 60), last])
    got = run(flag_flat_stream(stream, 5, 0.01), "flags", tmp_path)
    assert key(got) == key(flag_flat(df, "asset", ["ts"], "price", 5, 0.01)) and got.count() == 24


def test_rows_out_of_order_find_their_place(spark, tmp_path):
    df = prices(spark)
    last = spark.createDataFrame([("end", END, 1.0)], SCHEMA)
    odd, even = df.filter(F.hour("ts") % 2 == 1), df.filter(F.hour("ts") % 2 == 0)
    parts = [hours(even, 0, 26), hours(odd, 0, 26), hours(odd, 26, 60), hours(even, 26, 60), last]
    got = run(flag_flat_stream(fed(spark, tmp_path, parts), 5, 0.01, lateness="2 days"), "shuffled", tmp_path)
    assert key(got) == key(flag_flat(df, "asset", ["ts"], "price", 5, 0.01))


def test_rows_beyond_the_lateness_are_left_out(spark, tmp_path):
    df = prices(spark)
    last = spark.createDataFrame([("end", END, 1.0)], SCHEMA)
    clock = spark.createDataFrame([("clock", dt.datetime(2024, 1, 10), 1.0)], SCHEMA)
    parts = [hours(df, 0, 10), hours(df, 24, 60), clock, hours(df, 10, 24), last]
    got = run(flag_flat_stream(fed(spark, tmp_path, parts), 5, 0.01, lateness="1 hour"), "late", tmp_path)
    kept = hours(df, 0, 10).unionByName(hours(df, 24, 60))
    assert key(got) == key(flag_flat(kept, "asset", ["ts"], "price", 5, 0.01))


def test_too_many_waiting_rows_stop_the_stream(spark, tmp_path):
    stream = fed(spark, tmp_path, [prices(spark)])
    with pytest.raises(Exception, match="allow less lateness"):
        run(flag_flat_stream(stream, lateness="90 days", most_waiting=10), "waiting", tmp_path)


def test_a_silent_asset_starts_anew(spark, tmp_path):
    """Three flat rows, 40 days of silence, two flat rows: one window of five only if the state lives that long."""
    start = dt.datetime(2024, 1, 1)
    rows = lambda a, days: spark.createDataFrame([(a, start + dt.timedelta(days=d), 7.0) for d in days], SCHEMA)
    parts = [rows("a", [0, 1, 2]), rows("clock", [20]), rows("clock", [39]), rows("clock", [41]), rows("a", [42, 43]), rows("clock", [90])]
    for name, expire, flags in (("short", 30.0, 0), ("long", 60.0, 1)):
        folder = tmp_path / name
        folder.mkdir()
        got = run(flag_flat_stream(fed(spark, folder, parts), 5, 0.01, expire_days=expire), name, folder)
        assert got.filter("asset = 'a'").count() == flags


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    df = spark.range(40).select(F.col("id").cast("double").alias("a"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    assembler = VectorAssembler(inputCols=["a"], outputCol="features")
    model = LogisticRegression(labelCol="label").fit(assembler.transform(df))
    bundle = ScoringBundle(PipelineModel(stages=[assembler, model]), 0.3, "logistic", ("a",), ("a",))
    df.select("a").write.parquet(str(tmp_path / "in"))
    got = run(score_stream(spark.readStream.schema("a double").parquet(str(tmp_path / "in")), bundle), "scores", tmp_path)
    want = score_batch(df.select("a"), bundle)
    assert got.exceptAll(want).count() == 0 and got.count() == 40
