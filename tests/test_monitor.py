"""Flat stretches, alert lines, intervals and detection quality."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from finops_spark.errors import GateError, IntervalError, SchemaError
from finops_spark.operators import alerts, intervals, ordered
from finops_spark.operators.ordered import with_position
from finops_spark.operators.flat import flag_flat, rolling_stdev
from finops_spark.plans.monitor import check_prices, run_monitor
from finops_spark.sources.readers import read_intervals, read_prices

D = dt.date
PRICES = {"Asset_A": [100.0] * 10, "Asset_B": [50.0, 55, 49, 52, 51, 80, 82, 79, 81, 80]}


def day(n, month=1):
    return D(2023, month, n)


@pytest.fixture(scope="module")
def prices(spark):
    rows = [(a, day(i + 1), float(p)) for a, ps in PRICES.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "asset string, date date, price double")


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(
        [(0, "Asset_A", day(5), day(10))], "seq long, asset string, start_date date, end_date date"
    )


def flags_of(spark, rows):
    return spark.createDataFrame(rows, "asset string, date date, rolling_stdev double")


def test_constant_stretch_is_flagged(prices):
    found = sorted((r.asset, r.date.day, r.rolling_stdev) for r in flag_flat(prices).collect())
    assert found == [("Asset_A", d, 0.0) for d in range(5, 11)]


def test_rolling_stdev_is_population_and_null_until_full(prices):
    rows = rolling_stdev(prices).filter("asset = 'Asset_B'").orderBy("date").collect()
    assert [r.rolling_stdev for r in rows[:4]] == [None] * 4
    for i in range(4, 10):
        assert rows[i].rolling_stdev == pytest.approx(np.std(PRICES["Asset_B"][i - 4 : i + 1]))


def test_threshold_is_strict(prices):
    limit = float(np.std(PRICES["Asset_B"][5:10]))
    assert flag_flat(prices, threshold=limit).filter("asset = 'Asset_B'").count() == 0
    assert flag_flat(prices, threshold=limit * 1.0001).filter("asset = 'Asset_B'").count() == 1


@pytest.mark.parametrize("split_rows", [7, 40, 333])
def test_split_keys_give_the_same_rows(spark, split_rows):
    """One key holds a third of the rows, with ties in time."""
    rng = np.random.default_rng(1)
    rows = [
        (None if k == 3 else ("hot" if k < 3 else f"k{k}"), int(t), i, float(v))
        for i, (k, t, v) in enumerate(zip(rng.integers(0, 9, 1500), rng.integers(0, 400, 1500), rng.normal(size=1500)))
    ]
    df = spark.createDataFrame(rows, "k string, t long, i long, v double")
    plain = rolling_stdev(df, "k", ["t", "i"], "v", 6, split_hot=False)
    split = rolling_stdev(df, "k", ["t", "i"], "v", 6, split_rows=split_rows)
    assert split.count() == 1500
    want = {r.i: r.rolling_stdev for r in plain.collect()}
    got = {r.i: r.rolling_stdev for r in split.collect()}
    assert got == want
    places = ordered.with_position(df, ["k"], ["t", "i"], split_hot=False)
    moved = ordered.with_position(df, ["k"], ["t", "i"], split_rows=split_rows)
    assert {r.i: r.row_idx for r in places.collect()} == {r.i: r.row_idx for r in moved.collect()}


def test_split_key_by_timestamp(spark):
    df = spark.range(500).select(
        F.lit("a").alias("k"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_interval(0,0,0,0,0,id*id,0)")).alias("t"),
        (F.col("id") * 7 % 11).cast("double").alias("v"),
    )
    a = rolling_stdev(df, "k", ["t"], "v", 4, split_hot=False)
    b = rolling_stdev(df, "k", ["t"], "v", 4, split_rows=50)
    assert a.exceptAll(b).count() == 0 and b.count() == 500


def test_text_order_of_a_large_key(spark):
    df = spark.range(50).select(F.lit("a").alias("k"), F.format_string("%03d", "id").alias("t"), F.col("id").cast("double").alias("v"))
    a = rolling_stdev(df, "k", ["t"], "v", 3, split_hot=False)
    b = rolling_stdev(df, "k", ["t"], "v", 3, split_rows=10)
    assert a.exceptAll(b).count() == 0 and b.count() == 50


@pytest.mark.parametrize("most", ["7", "1"])
def test_ranges_of_several_files_follow_each_other(spark, most):
    """Up to 1,200 files of one range: their numbers get more digits."""
    df = spark.range(1200).select(F.lit("a").alias("k"), (F.col("id") * 7919 % 1201).alias("t"), F.col("id").cast("double").alias("v")).repartition(4)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", most)
    try:
        moved = {r.t: r.row_idx for r in with_position(df, ["k"], ["t"], split_rows=50).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert moved == {t: i for i, t in enumerate(sorted(moved))} and len(moved) == 1200


def test_ties_of_a_large_key_are_split(spark):
    df = spark.range(4000).select(F.lit("a").alias("k"), F.lit(1).alias("t"), F.col("id").alias("v")).repartition(8)
    placed = with_position(df, ["k"], ["t"], split_rows=50)
    assert sorted(r.row_idx for r in placed.collect()) == list(range(4000))
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "_file" in plan  # numbered within pieces of a file, not within the key
    ranges = df.withColumn("_tie", F.xxhash64("k", "t", "v")).repartitionByRange(8, "k", "t", "_tie")
    sizes = [r["count"] for r in ranges.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


def test_alert_lines_and_summary(spark):
    flags = flags_of(
        spark, [("Asset_B", day(5), 0.005), ("Asset_A", day(6), 0.0), ("Asset_A", day(5), 0.0)]
    )
    first = alerts.alert_lines(flags).orderBy("asset", "date").first().line
    assert first == "EVENT|asset=Asset_A|date=2023-01-05|rolling_stdev=0.00000000"
    assert alerts.alert_summary(flags).first().asDict() == {"total_events": 3, "unique_assets": 2}
    assert sorted(r.asset for r in alerts.affected_assets(flags).collect()) == ["Asset_A", "Asset_B"]
    assert alerts.alert_summary(flags.limit(0)).first().asDict() == {"total_events": 0, "unique_assets": 0}


def metrics(spark, flag_rows, interval_rows, **kw):
    flags = flags_of(spark, [(a, d, 0.0) for a, d in flag_rows])
    table = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(interval_rows)], "seq long, asset string, start_date date, end_date date"
    )
    return intervals.detection_metrics(flags, table, **kw).first()


def test_detection_metrics(spark):
    got = metrics(
        spark,
        [("Asset_A", day(6)), ("Asset_A", day(7)), ("Asset_B", day(5))],
        [("Asset_A", day(5), day(10))],
    )
    assert (got.tp, got.fp, got.fn) == (2, 1, 0)
    assert got.precision == pytest.approx(2 / 3)
    assert (got.recall, got.avg_latency) == (1.0, 1.0)


def test_no_flags_or_no_intervals(spark):
    none = metrics(spark, [], [("Asset_A", day(5), day(10))])
    assert (none.precision, none.recall, none.avg_latency, none.fn) == (0.0, 0.0, 0.0, 1)
    unlabelled = metrics(spark, [("Asset_A", day(5))], [])
    assert (unlabelled.tp, unlabelled.fp, unlabelled.recall) == (0, 1, 0.0)


def test_both_ends_are_inside(spark):
    got = metrics(
        spark,
        [("a", day(5)), ("a", day(10)), ("a", day(4)), ("a", day(11))],
        [("a", day(5), day(10))],
    )
    assert (got.tp, got.fp) == (2, 2)


def test_overlapping_intervals_credit_the_first(spark):
    overlap = [("a", day(1), day(10)), ("a", day(5), day(12))]
    first = metrics(spark, [("a", day(6))], overlap)
    any_ = metrics(spark, [("a", day(6))], overlap, match="any")
    assert (first.recall, first.avg_latency) == (0.5, 5.0)
    assert (any_.recall, any_.avg_latency) == (1.0, 3.0)


def test_intervals_with_one_start_share_the_hit(spark):
    got = metrics(spark, [("a", day(8))], [("a", day(5), day(10)), ("a", day(5), day(6))])
    # The second counts as recalled without a latency of its own.
    assert (got.recall, got.avg_latency) == (1.0, 3.0)


def test_long_intervals_cross_spans(spark):
    got = metrics(spark, [("a", D(2024, 3, 1))], [("a", D(2023, 1, 1), D(2024, 12, 31))])
    assert (got.tp, got.recall, got.avg_latency) == (1, 1.0, 425.0)


def test_latency_in_rows(spark, prices):
    sparse = prices.filter("asset = 'Asset_A' and dayofmonth(date) % 2 = 0")
    calendar = intervals.row_calendar(sparse)
    got = metrics(spark, [("Asset_A", day(8))], [("Asset_A", day(4), day(10))], calendar=calendar)
    assert got.avg_latency == 2.0


def test_match_against_brute_force(spark):
    rng = np.random.default_rng(5)
    flags = [(f"a{k}", day(1) + dt.timedelta(int(d))) for k, d in zip(rng.integers(0, 4, 200), rng.integers(0, 150, 200))]
    wins = []
    for k, s, n in zip(rng.integers(0, 5, 40), rng.integers(0, 140, 40), rng.integers(0, 50, 40)):
        start = day(1) + dt.timedelta(int(s))
        wins.append((f"a{k}", start, start + dt.timedelta(int(n))))
    hit, tp = set(), 0
    for a, d in flags:
        for w in wins:
            if w[0] == a and w[1] <= d <= w[2]:
                tp += 1
                hit.add((a, w[1]))
                break
    recalled = [w for w in wins if (w[0], w[1]) in hit]
    late = [min(d for a, d in flags if a == w[0] and w[1] <= d <= w[2]) - w[1] for w in recalled
            if any(a == w[0] and w[1] <= d <= w[2] for a, d in flags)]
    got = metrics(spark, flags, wins)
    assert (got.tp, got.fp) == (tp, len(flags) - tp)
    assert got.recall == pytest.approx(len(recalled) / len(wins))
    assert got.avg_latency == pytest.approx(np.mean([x.days for x in late]))


def test_bad_match_mode(spark, labelled):
    with pytest.raises(SchemaError):
        intervals.interval_outcomes(flags_of(spark, []), labelled, match="best")


def test_positions_become_dates(spark, prices):
    table = spark.createDataFrame(
        [(0, "Asset_A", 4, 9), (1, "Asset_B", 0, 2)], "seq long, asset_id string, window_start_idx long, window_end_idx long"
    )
    out = intervals.intervals_to_dates(table, intervals.row_calendar(prices))
    got = sorted((r.asset, r.start_date.day, r.end_date.day) for r in out.collect())
    assert got == [("Asset_A", 5, 10), ("Asset_B", 1, 3)]


@pytest.mark.parametrize("row", [("nobody", 0, 1), ("Asset_A", 0, 99), ("Asset_A", -1, 3)])
def test_positions_outside_raise(spark, prices, row):
    table = spark.createDataFrame([(0, *row)], "seq long, asset_id string, window_start_idx long, window_end_idx long")
    with pytest.raises(IntervalError):
        intervals.intervals_to_dates(table, intervals.row_calendar(prices))


def test_empty_positions_raise(spark, prices):
    table = spark.createDataFrame([], "seq long, asset_id string, window_start_idx long, window_end_idx long")
    with pytest.raises(IntervalError):
        intervals.intervals_to_dates(table, intervals.row_calendar(prices))


def write_prices(path, header, rows):
    path.write_text("\n".join([header, *rows]) + "\n")
    return str(path)


def test_whole_flow_from_files(spark, tmp_path):
    lines = [f"2023-01-{i + 1:02d},{PRICES['Asset_A'][i]},{PRICES['Asset_B'][i]}" for i in range(10)]
    source = write_prices(tmp_path / "prices.csv", "date,Asset_A,Asset_B", lines)
    labels = write_prices(
        tmp_path / "labels.csv", "asset_id,window_start_idx,window_end_idx,version", ["Asset_A,4,9,1"]
    )
    out = run_monitor(spark, source, labels, alerts_path=str(tmp_path / "alerts"), metrics_path=str(tmp_path / "m"))
    got = out.metrics.first()
    assert (got.precision, got.recall, got.avg_latency) == (1.0, 1.0, 0.0)
    text = spark.read.text(str(tmp_path / "alerts")).collect()
    assert len(text) == 6
    assert all("|INFO|EVENT|asset=Asset_A|date=2023-01-" in r.value for r in text)
    assert spark.read.json(str(tmp_path / "m")).first().recall == 1.0
    dated = write_prices(tmp_path / "dated.csv", "asset,start_date,end_date", ["Asset_A,2023-01-05,2023-01-10"])
    assert run_monitor(spark, source, dated).metrics.first().tp == 6
    assert [r.seq for r in read_intervals(spark, dated).collect()] == [0]


def test_price_file_checks(spark, tmp_path):
    only_date = write_prices(tmp_path / "a.csv", "date", ["2023-01-01"])
    no_date = write_prices(tmp_path / "b.csv", "when,A", ["2023-01-01,1.0"])
    hollow = write_prices(tmp_path / "c.csv", "date,A,B", ["2023-01-01,1.0,", "2023-01-02,2.0,"])
    with pytest.raises(SchemaError):
        read_prices(spark, only_date)
    with pytest.raises(SchemaError):
        read_prices(spark, no_date)
    with pytest.raises(GateError):
        read_prices(spark, hollow)


def test_price_gates(spark, prices):
    check_prices(prices)
    with pytest.raises(GateError):
        check_prices(prices.withColumn("price", F.when(F.col("date") > day(3), F.col("price"))))
    with pytest.raises(GateError):
        check_prices(prices.withColumn("price", F.lit(float("inf"))))
    with pytest.raises(GateError):
        check_prices(prices.unionByName(prices.limit(1)))
    with pytest.raises(GateError):
        check_prices(prices.limit(0))


def test_positions_without_an_order_are_refused(spark, prices):
    table = spark.createDataFrame([("Asset_A", 0, 2)], "asset_id string, window_start_idx long, window_end_idx long")
    with pytest.raises(SchemaError):
        intervals.intervals_to_dates(table, intervals.row_calendar(prices))


def test_lines_are_numbered_over_several_files(spark, tmp_path):
    small = ["asset,start_date,end_date", "Asset_A,2024-01-01,2024-01-09", "Asset_A,2024-01-02,2024-01-03"]
    large = ["asset,start_date,end_date"] + [f"Asset_{i},2024-01-01,2024-01-05" for i in range(500)]
    (tmp_path / "a.csv").write_text("\n".join(small) + "\n")
    (tmp_path / "b.csv").write_text("\n".join(large) + "\n")
    got = {r.asset: r.seq for r in read_intervals(spark, str(tmp_path)).collect() if r.asset != "Asset_A"}
    assert got == {f"Asset_{i}": i + 2 for i in range(500)}
    first = [r.seq for r in read_intervals(spark, str(tmp_path)).collect() if r.asset == "Asset_A"]
    assert sorted(first) == [0, 1]


def test_metrics_join_the_ranges_once(spark, labelled):
    plan = intervals.detection_metrics(flags_of(spark, [("Asset_A", day(3), 0.0)]), labelled)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unix_date(date") + plan.count("explode(") <= 4
    assert plan.count("Generate explode") == 1
