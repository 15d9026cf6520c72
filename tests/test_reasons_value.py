"""Reason codes, value at stake and expected frequencies against plain calculation."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from finops_spark.errors import FitError, GateError, SchemaError
from finops_spark.operators import encode, gates, models, reasons, value

MIXED = "id long, amount double, age double, kind string, label int"


def mixed_rows(n=400):
    rng = random.Random(5)
    out = []
    for i in range(n):
        amount, age, kind = rng.gauss(100, 30), rng.gauss(40, 9), rng.choice(["a", "b", "c", None])
        out.append((i, amount, None if i % 23 == 0 else age, kind, int(amount + (30 if kind == "b" else 0) + rng.gauss(0, 20) > 120)))
    return out


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    train = spark.createDataFrame(mixed_rows(), MIXED)
    pipeline, names = encode.fit_feature_pipeline(train, ["amount", "age"], ["kind"])
    model = models.train_logistic(pipeline.transform(train))
    path = str(tmp_path_factory.mktemp("reasons"))
    models.ScoringBundle(PipelineModel(stages=[pipeline, model]), 0.5, "logistic", tuple(names), ("amount", "age", "kind")).save(spark, path)
    return models.ScoringBundle.load(spark, path)


CODES = {"amount": "R01", "age": "R02", "kind": "R03"}


def test_reasons_of_a_mixed_bundle(spark, bundle):
    data = spark.createDataFrame(mixed_rows(), MIXED).repartition(3)
    explainer = reasons.fit_explainer(bundle, data)
    assert explainer.features == {"amount": (1, 1), "age": (2, 1), "kind": (3, 3)}
    got = {r.id: r for r in reasons.reason_codes(data, bundle, explainer, CODES, top=2).collect()}
    vectors = bundle.pipeline.transform(data).select("id", "features", models.positive_probability().alias("p")).collect()
    x = np.array([r.features.toArray() for r in vectors])
    each = (x - x.mean(0)) * bundle.pipeline.stages[-1].coefficients.toArray()
    assert set(got) == {r.id for r in vectors if r.p >= 0.5}
    for r, c in zip(vectors, each, strict=True):
        if r.p >= 0.5:
            told = {"amount": c[0], "age": c[1], "kind": c[2:].sum()}
            want = sorted(((-v, k) for k, v in told.items() if v > 0))[:2]
            assert [(s.rank, s.feature, s.code) for s in got[r.id].reasons] == [(i, k, CODES[k]) for i, (_, k) in enumerate(want, 1)]
            assert [s.contribution for s in got[r.id].reasons] == pytest.approx([-v for v, _ in want], abs=1e-9)
    assert len({len(r.reasons) for r in got.values()}) > 1  # some have fewer than two


def test_reasons_keep_columns_and_refuse_gaps(spark, bundle):
    data = spark.createDataFrame(mixed_rows(60), MIXED)
    explainer = reasons.fit_explainer(bundle, data)
    out = reasons.reason_codes(data.withColumn("rank", F.lit(1)), bundle, explainer, CODES)
    assert out.columns == ["id", "amount", "age", "kind", "label", "rank", "probability_adverse", "reasons"]
    assert reasons.reason_codes(data.limit(0), bundle, explainer, CODES).count() == 0
    with pytest.raises(SchemaError, match="kind"):
        reasons.reason_codes(data, bundle, explainer, {"amount": "R01", "age": "R02"})
    with pytest.raises(FitError):
        reasons.fit_explainer(bundle, data.limit(0))


def test_slot_runs():
    assert reasons.slot_runs(["a", "k=x", "k=y=z", "j=x", "b"]) == {"a": (1, 1), "k": (2, 2), "j": (4, 1), "b": (5, 1)}
    with pytest.raises(SchemaError):
        reasons.slot_runs(["k=x", "a", "k=y"])


SCORED = "label int, score double, value double"


def scored_rows(n=500):
    rng = random.Random(3)
    return [(int(rng.random() < 0.3), rng.randint(0, 20) / 20, round(rng.random() * 1000, 2)) for _ in range(n)]


@pytest.mark.parametrize("split_rows", [10_000, 50])
def test_value_curve(spark, split_rows):
    rows = scored_rows()
    df = spark.createDataFrame(rows, SCORED).repartition(4)
    curve = value.value_curve(df, split_rows=split_rows)
    money = {s: sum(Decimal(str(v)) for y, x, v in rows if y and x >= s) for s in {x for _, x, _ in rows}}
    got = {r.threshold: r for r in curve.collect()}
    assert set(got) == set(money)
    for s, m in money.items():
        assert got[s].captured_top == m and got[s].n_top == sum(x >= s for _, x, _ in rows)
        assert (got[s].n_all, got[s].captured_all) == (500, money[0.0])


def test_captured_value_shares_ties(spark):
    rows = scored_rows()
    out = {r.percent: r for r in value.captured_at(value.value_curve(spark.createDataFrame(rows, SCORED)), [0, 7, 33, 100]).collect()}
    whole = sum(v for y, _, v in rows if y)
    for p, r in out.items():
        k, left, want = 500 * p // 100, 500 * p // 100, 0.0
        for s in sorted({x for _, x, _ in rows}, reverse=True):
            here = [v if y else 0.0 for y, x, v in rows if x == s]
            want += sum(here) * min(1.0, left / len(here))
            left = max(0, left - len(here))
        assert r.n_taken == k and r.captured == pytest.approx(want) and r.captured_share == pytest.approx(want / whole)


def test_value_curve_edges(spark):
    empty = spark.createDataFrame([], SCORED)
    assert value.value_curve(empty).count() == 0
    assert value.captured_at(value.value_curve(empty), [10]).collect()[0][1:] == (0, 0.0, 0.0)
    for bad in [(1, None, 2.0), (1, 0.5, None), (1, 0.5, -1.0), (2, 0.5, 1.0), (None, 0.5, 1.0), (0, float("nan"), 1.0)]:
        with pytest.raises(Exception, match="missing|other than|negative"):
            value.value_curve(spark.createDataFrame([bad], SCORED)).collect()
    with pytest.raises(SchemaError):
        value.captured_at(value.value_curve(empty), [101])
    both = value.compare_rankings(spark.createDataFrame(scored_rows(), SCORED).withColumn("other", 1 - F.col("score")), ["score", "other"], [50])
    assert {r.ranking for r in both.collect()} == {"score", "other"}


def test_value_weights(spark):
    rows = [(1, 0.0, 300.0), (1, 0.0, 100.0), (0, 0.0, None), (0, 0.0, 7.0)]
    got = [r.value_weight for r in value.value_weights(spark.createDataFrame(rows, SCORED), "label", "value", 50.0).orderBy(F.desc("label"), F.desc("value")).collect()]
    assert got == pytest.approx([2.4, 0.8, 0.4, 0.4]) and sum(got) == pytest.approx(4)
    for bad in ([(1, 0.0, 1.0)], [(1, 0.0, None), (0, 0.0, 1.0)], [(1, 0.0, 0.0), (0, 0.0, 1.0)], [(1, 0.0, 1.0), (None, 0.0, 1.0)]):
        with pytest.raises(FitError):
            value.value_weights(spark.createDataFrame(bad, SCORED), "label", "value", 50.0)


def test_weighted_fit_prefers_value(spark):
    """Of two signs of default the one on large balances weighs more once balances count."""
    rows = [(int(i % 2 == 0), float(i % 2 == 0 and i % 4 == 0), float(i % 2 == 0 and i % 4 == 2), 1000.0 if i % 4 == 0 else 10.0) for i in range(400)]
    rows += [(0, 1.0, 0.0, 10.0)] * 60 + [(0, 0.0, 1.0, 10.0)] * 60
    df = spark.createDataFrame(rows, "label int, a double, b double, value double")
    pipeline, _ = encode.fit_feature_pipeline(df.select("a", "b"), ["a", "b"], [])
    weighted = value.value_weights(pipeline.transform(df), "label", "value", 20.0)
    plain, by_value = (models.train_logistic(weighted, weight=w).coefficients.toArray() for w in (None, "value_weight"))
    assert plain[0] == pytest.approx(plain[1], abs=1e-3) and by_value[0] > 2 * by_value[1]


def off(spark, days, frequency):
    df = spark.createDataFrame([("s", dt.date.fromisoformat(d) if d else None) for d in days], "series_id string, ts date")
    return sorted((str(r.ts), r.kind) for r in gates.frequency_gaps(df, frequency=frequency).collect())


def test_frequency_gaps(spark):
    assert off(spark, ["2023-12-29", "2024-01-01", "2024-01-02", "2024-01-04", "2024-01-06", None, "2024-01-06"], "B") == [
        ("2024-01-03", "missing"), ("2024-01-05", "missing"), ("2024-01-06", "unexpected")]
    assert off(spark, ["2023-12-20", "2023-12-27", "2024-01-04", "2024-01-10"], "W") == [("2024-01-03", "missing"), ("2024-01-04", "unexpected")]
    assert off(spark, ["2023-12-31", "2024-02-29", "2024-03-30"], "ME") == [("2024-01-31", "missing"), ("2024-03-30", "unexpected")]
    assert off(spark, ["2023-12-01", "2024-02-01"], "MS") == [("2024-01-01", "missing")]
    assert off(spark, ["2023-12-30", "2024-01-02"], "D") == [("2023-12-31", "missing"), ("2024-01-01", "missing")]
    assert off(spark, [], "D") == [] and off(spark, [None], "ME") == []
    # a far-off date is only its calendar
    assert len(off(spark, ["1024-01-31", "2024-01-31"], "ME")) == 11_999
    with pytest.raises(SchemaError):
        off(spark, [], "fortnight")


@pytest.mark.parametrize("frequency", ["D", "B", "W", "MS", "ME"])
def test_calendars_are_not_moved(spark, frequency):
    """Days are made after the last shuffle, so no task gathers the calendar of many series."""
    df = spark.createDataFrame([(k, dt.date(2024, 1, 1 + k)) for k in range(9)], "series_id int, ts date")
    plan = gates.frequency_gaps(df, frequency=frequency)._jdf.queryExecution().executedPlan().toString()
    assert -1 < plan.index("Generate") < plan.index("Exchange") and plan.count("Generate") == 1


def test_series_of_a_frequency(spark):
    series = spark.createDataFrame([(k, dt.date(2024, m, 1), 1.0) for k in ("x", None) for m in (1, 2, 3)], "series_id string, ts date, value double")
    gates.enforce_series(series, frequency="MS")
    with pytest.raises(GateError, match="frequency ME"):
        gates.enforce_series(series, frequency="ME")
