"""Exact splits, precision-recall curve, thresholds and error tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from finops_spark.errors import SplitError
from finops_spark.functions.scalar import equal_width_bin, f_beta, improvement_pct
from finops_spark.operators import curves, error_analysis, split


def labelled(spark, counts):
    df = None
    for label, n in counts.items():
        part = spark.range(n).select(F.col("id").cast("double").alias("feature_1"), F.lit(label).alias("target"))
        df = part if df is None else df.unionAll(part)
    return df


def sizes(df):
    return {(r.split, r.target): r["count"] for r in df.groupBy("split", "target").count().collect()}


def test_three_way_counts_and_seed(spark):
    df = labelled(spark, {0: 500, 1: 500})
    parts = split.stratified_split(df, "target")
    assert sizes(parts) == {(s, t): n for s, n in (("train", 300), ("calibration", 100), ("test", 100)) for t in (0, 1)}
    again = split.stratified_split(df.repartition(5), "target")
    assert parts.exceptAll(again).count() == 0
    other = split.stratified_split(df, "target", seed=43)
    assert parts.exceptAll(other).count() > 0
    whole = split.split_part(parts, "train").unionByName(split.split_part(parts, "test")).unionByName(split.split_part(parts, "calibration"))
    assert whole.exceptAll(df).count() == 0 and whole.count() == 1000


@pytest.mark.parametrize("n", [1, 2, 5, 7, 35, 115])
def test_floors_are_exact(spark, n):
    got = sizes(split.stratified_split(labelled(spark, {0: n}), "target", allow_empty=True))
    assert got.get(("train", 0), 0) == n * 6 // 10
    assert got.get(("calibration", 0), 0) == n * 2 // 10
    assert got.get(("test", 0), 0) == n - n * 6 // 10 - n * 2 // 10


def test_two_way_and_null_class(spark):
    df = labelled(spark, {0: 95, 1: 10}).withColumn("target", F.when(F.col("target") == 0, 0))
    got = sizes(split.stratified_split(df, "target", split.TWO_WAY))
    assert got == {("train", 0): 76, ("test", 0): 19, ("train", None): 8, ("test", None): 2}


@pytest.mark.parametrize("pieces", [1, 9])
def test_many_copies_of_one_row(spark, pieces):
    df = labelled(spark, {0: 300, 1: 100}).unionAll(
        spark.range(600).select(F.lit(-1.0).alias("feature_1"), F.lit(0).alias("target"))
    )
    got = split.stratified_split(df.repartition(pieces), "target")
    assert sizes(got) == {("train", 0): 540, ("calibration", 0): 180, ("test", 0): 180, ("train", 1): 60, ("calibration", 1): 20, ("test", 1): 20}
    assert got.drop("split").exceptAll(df).count() == 0


def test_shares_must_add_up(spark):
    with pytest.raises(SplitError):
        split.stratified_split(labelled(spark, {0: 3}), "target", {"a": "0.5", "b": "0.4"})


def test_distribution_and_check(spark):
    shares = {r.target: r.share for r in split.class_distribution(labelled(spark, {0: 3, 1: 1}), "target").collect()}
    assert shares == {0: 0.75, 1: 0.25}
    rows = [("train", 0)] * 6 + [("train", 1)] * 4 + [("test", 0)] * 4 + [("test", 1)] * 6
    df = spark.createDataFrame(rows, "split string, target int")
    report = split.stratification_check(df, "target", ("train", "test"), 0.01)
    with pytest.raises(SplitError, match="Deviation"):
        split.enforce_stratification(report, "target")
    split.enforce_stratification(split.stratification_check(df, "target", ("train", "test"), 0.1), "target")
    missing = split.stratification_check(df.filter("not (split = 'test' and target = 1)"), "target", ("train", "test"), 1.0)
    with pytest.raises(SplitError, match="different classes"):
        split.enforce_stratification(missing, "target")
    tiny = split.stratified_split(labelled(spark, {0: 1, 1: 1}), "target", allow_empty=True)
    with pytest.raises(SplitError):
        split.enforce_stratification(split.stratification_check(tiny, "target"), "target")


def test_summary(spark):
    parts = split.stratified_split(labelled(spark, {0: 90, 1: 10}), "target", split.TWO_WAY)
    got = {r.split: (r.n, r.positives, r.positive_rate) for r in split.split_summary(parts, "target").collect()}
    assert got == {"train": (80, 8, 0.1), "test": (20, 2, 0.1)}


# --- curve ------------------------------------------------------------------------


def scores(spark, y, s):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")


def brute(y, s, fn_cost=10, fp_cost=1):
    """Confusion counts at every distinct score by definition."""
    rows = {}
    for t in np.unique(s):
        p = s >= t
        tp, fp = int((p & (y == 1)).sum()), int((p & (y == 0)).sum())
        fn, tn = int((y == 1).sum()) - tp, int((y == 0).sum()) - fp
        f2 = 5 * tp / (5 * tp + 4 * fn + fp) if 5 * tp + 4 * fn + fp else 0.0
        rows[t] = (tp, fp, fn, tn, f2, fn_cost * fn + fp_cost * fp)
    return rows


def data(seed, n, digits):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    return y, np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), digits)


@pytest.mark.parametrize("digits,split_rows", [(1, 10**9), (3, 10**9), (1, 10), (3, 10), (9, 60), (9, 2)])
def test_curve_matches_brute_force(spark, digits, split_rows):
    y, s = data(11, 600, digits)
    curve = curves.threshold_curve(scores(spark, y, s), split_rows=split_rows)
    want = brute(y, s)
    got = {r.threshold: (r.tp, r.fp, r.fn, r.tn, r.f_beta, r.total_cost) for r in curve.collect()}
    assert set(got) == set(want)
    for t in want:
        assert got[t] == pytest.approx(want[t])
    order = sorted(want, reverse=True)
    recall = [want[t][0] / y.sum() for t in order]
    precision = [want[t][0] / (want[t][0] + want[t][1]) for t in order]
    ap = sum((r - q) * p for r, q, p in zip(recall, [0.0, *recall], precision))
    assert curves.average_precision(curve).first().average_precision == pytest.approx(ap)
    best = curves.best_thresholds(curve).first()
    ascending = sorted(want)
    assert best.f2_threshold == ascending[int(np.argmax([want[t][4] for t in ascending]))]
    assert best.cost_threshold == ascending[int(np.argmin([want[t][5] for t in ascending]))]
    assert best.agree == (abs(best.f2_threshold - best.cost_threshold) <= 0.05)
    assert (best.tp, best.fp, best.fn, best.tn) == want[best.f2_threshold][:4]
    assert best.cost_per_10k == pytest.approx(want[best.f2_threshold][5] * 10000 / len(y))


def test_hot_score_is_one_row(spark):
    df = spark.range(5000).select((F.col("id") % 2).cast("int").alias("label"), F.lit(0.25).alias("score"))
    rows = curves.threshold_curve(df, split_rows=100).collect()
    assert [(r.threshold, r.tp, r.fp, r.fn, r.tn) for r in rows] == [(0.25, 2500, 2500, 0, 0)]


def test_ties_go_to_the_lowest_threshold(spark):
    # Both thresholds give the same F2 and the same cost.
    df = scores(spark, [1, 1, 0, 0], [0.9, 0.9, 0.1, 0.1])
    best = curves.best_thresholds(curves.threshold_curve(df, fn_cost=0, fp_cost=0)).first()
    assert best.cost_threshold == 0.1 and best.f2_threshold == 0.9


def test_no_positive_labels(spark):
    curve = curves.threshold_curve(scores(spark, [0, 0], [0.2, 0.7]))
    assert curves.average_precision(curve).first().average_precision == 0.0
    assert curves.best_thresholds(curve).first().f2 == 0.0


def test_confusion_at_published_counts(spark):
    counts = {(1, 0.9): 153, (1, 0.1): 247, (0, 0.9): 3392, (0, 0.1): 36208}
    df = spark.createDataFrame([(y, s, n) for (y, s), n in counts.items()], "label int, score double, n int")
    df = df.select("label", "score", F.explode(F.sequence(F.lit(1), "n"))).drop("col")
    got = curves.confusion_at(df, 0.597613).first()
    assert (got.tn, got.fp, got.fn, got.tp) == (36208, 3392, 247, 153)
    assert (round(got.precision, 4), got.recall, round(got.f2, 6), got.cost_per_10k) == (0.0432, 0.3825, 0.148688, 1465.5)


def test_one_class_only(spark):
    got = curves.confusion_at(scores(spark, [0, 0], [0.1, 0.2]), 0.5).first()
    assert (got.tn, got.fp, got.fn, got.tp, got.precision, got.recall, got.f2) == (2, 0, 0, 0, 0.0, 0.0, 0.0)


def test_error_tables(spark):
    rng = np.random.default_rng(2)
    y, s = data(5, 400, 2)
    amounts, hours = np.round(rng.lognormal(3, 1, 400), 2), rng.integers(0, 20, 400)
    rows = [(int(a), float(b), float(c), int(d)) for a, b, c, d in zip(y, s, amounts, hours)]
    df = spark.createDataFrame(rows, "label int, score double, TransactionAmt double, hour_of_day int")
    classed = error_analysis.with_error_class(df, 0.5)
    masks = {"FN": (y == 1) & (s < 0.5), "TP": (y == 1) & (s >= 0.5), "FP": (y == 0) & (s >= 0.5), "TN": (y == 0) & (s < 0.5)}
    assert {r.error_class: r.n for r in error_analysis.class_counts(classed).collect()} == {k: int(m.sum()) for k, m in masks.items()}
    for r in error_analysis.amount_stats(classed).collect():
        a = amounts[masks[r.error_class]]
        assert (r.n, r.amount_column) == (len(a), "TransactionAmt")
        assert (r.mean_amount, r.median_amount, r.std_amount) == pytest.approx((a.mean(), np.median(a), a.std(ddof=1)))
    hist = {(r.error_class, r.hour): r.n for r in error_analysis.hour_histogram(classed).collect()}
    assert len(hist) == 48
    assert all(hist[(k, h)] == int(((hours == h) & masks[k]).sum()) for k in ("FN", "TP") for h in range(24))
    assert error_analysis.amount_stats(classed.drop("TransactionAmt")) is None
    assert error_analysis.hour_histogram(classed.drop("hour_of_day")) is None


def test_scalars(spark):
    edges = [0.0, 0.1, 0.3, 0.6, 0.7, 0.95, 1.0]
    df = spark.createDataFrame([(e,) for e in edges], "p double")
    got = [r.b for r in df.select("p", equal_width_bin(F.col("p")).alias("b")).orderBy("p").collect()]
    assert got == list(np.digitize(edges, np.linspace(0, 1, 11)[1:-1])) == [0, 1, 2, 5, 6, 9, 9]
    row = spark.range(1).select(
        *[improvement_pct(F.lit(a), F.lit(b)).alias(f"i{i}") for i, (a, b) in enumerate([(0.25, 0.2), (0.25, 0.25), (0.2, 0.25), (0.0, 0.0)])],
        f_beta(F.lit(0), F.lit(0), F.lit(0)).alias("f"),
    ).first()
    assert [row.i0, row.i1, row.i2, row.i3, row.f] == pytest.approx([20.0, 0.0, -25.0, 0.0, 0.0])
    assert math.isclose(row.i0, 20.0)


def test_missing_scores_and_labels_are_refused(spark):
    for rows in ([(1, None), (0, 0.5)], [(None, 0.2), (1, 0.5)], [(1, float("nan"))], [(2, 0.5)]):
        with pytest.raises(Exception, match="missing values|other than 0 and 1"):
            curves.threshold_curve(spark.createDataFrame(rows, "label int, score double")).collect()


def test_an_empty_part_raises(spark):
    with pytest.raises(SplitError):
        split.stratified_split(labelled(spark, {0: 1, 1: 1}), "target").collect()


def test_split_moves_no_rows(spark):
    parts = split.stratified_split(labelled(spark, {0: 90, 1: 10}), "target", split.TWO_WAY)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Window" not in plan


def test_copies_across_a_cut(spark):
    table = spark.createDataFrame([(1, "same")] * 100 + [(0, "same")] * 50, "target int, x string").repartition(7)
    got = {(r.split, r.target): r["count"] for r in split.stratified_split(table, "target").groupBy("split", "target").count().collect()}
    assert got == {("train", 1): 60, ("calibration", 1): 20, ("test", 1): 20, ("train", 0): 30, ("calibration", 0): 10, ("test", 0): 10}
