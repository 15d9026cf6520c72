"""Features, folds, ridge over folds, and recursive forecasts against numpy."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from finops_spark.errors import FitError, GateError, SchemaError, SplitError
from finops_spark.functions.scalar import calendar
from finops_spark.operators import features, forecast, ridge, split
from finops_spark.plans.forecasting import forecast_from, run_forecasting
from finops_spark.sources.readers import read_series
from finops_spark.sources.writers import write_series

START = dt.date(2020, 1, 1)
LAGS, WINDOWS = [1, 7, 14], [7]


def values_of(n, seed):
    t = np.arange(n)
    rng = np.random.default_rng(seed)
    return 1000 + 60 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 30, n)


def rows_of(name, values):
    return [(name, START + dt.timedelta(i), float(v)) for i, v in enumerate(values)]


@pytest.fixture(scope="module")
def series(spark):
    rows = rows_of("a", values_of(300, 1)) + rows_of("b", values_of(260, 2))
    return spark.createDataFrame(rows, "series_id string, ts date, value double")


def numpy_matrix(v, lags=LAGS, windows=WINDOWS):
    """Features and targets by the definition, row by row."""
    xs, ys, at = [], [], []
    for t in range(len(v) - 1):
        if t < max([*lags, *windows]):
            continue
        x = [v[t - n] for n in lags]
        for w in windows:
            x += [np.mean(v[t - w : t]), np.std(v[t - w : t], ddof=1)]
        d = START + dt.timedelta(t)
        dow = d.weekday()
        x += [dow, d.month, d.day, np.sin(2 * np.pi * dow / 7), np.cos(2 * np.pi * dow / 7)]
        xs.append(x)
        ys.append(v[t + 1])
        at.append(t)
    return np.array(xs, float), np.array(ys), at


def numpy_ridge(x, y, alpha=1.0):
    mean, std = x.mean(0), x.std(0)
    std = np.where(std == 0, 1.0, std)
    z = (x - mean) / std
    b = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return b / std, y.mean() - (b / std) @ mean


def test_feature_matrix_matches_definition(series):
    names = features.feature_names(LAGS, WINDOWS, True)
    got = features.feature_matrix(series, lags=LAGS, windows=WINDOWS, with_calendar=True).orderBy("series_id", "ts")
    assert len(names) == 10
    for name, n, seed in (("a", 300, 1), ("b", 260, 2)):
        x, y, _ = numpy_matrix(values_of(n, seed))
        rows = got.filter(F.col("series_id") == name).collect()
        assert len(rows) == n - 15
        np.testing.assert_allclose([[r[c] for c in names] for r in rows], x, rtol=1e-10, atol=1e-12)
        np.testing.assert_allclose([r.target for r in rows], y)


def test_split_keys_keep_features(series):
    a = features.feature_matrix(series, lags=[1, 3], windows=[5], split_hot=False)
    b = features.with_bounded_window(
        series, ["series_id"], ["ts"], 5, 1,
        lambda w: {**features.lag_columns(w, "value", [1, 3]), **features.rolling_columns(w, "value", [5]), "target": F.lead("value").over(w)},
        split_rows=40,
    ).select(*a.columns).na.drop()
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_windows_do_not_see_the_current_row(spark):
    df = spark.createDataFrame(rows_of("s", [1.0, 2.0, 4.0, 100.0]), "series_id string, ts date, value double")
    rows = features.rolling_features(df, [2], drop_na=False).orderBy("ts").collect()
    assert [r.rolling_mean_2 for r in rows] == [None, None, 1.5, 3.0]
    lags = features.lag_features(df, [1, 2]).orderBy("ts").collect()
    assert [(r.lag_1, r.lag_2) for r in lags] == [(2.0, 1.0), (4.0, 2.0)]


def test_min_periods(spark):
    df = spark.createDataFrame(rows_of("s", range(10)), "series_id string, ts date, value double")
    count = lambda **k: [
        features.rolling_features(df, [3, 5], drop_na=False, **k).filter(f"rolling_mean_{w} is not null").count() for w in (3, 5)
    ]
    assert count() == [7, 5]
    assert count(min_periods=1) == [9, 9]
    assert count(sticky_min_periods=True) == [7, 7]
    with pytest.raises(SchemaError):
        features.rolling_features(df, [5, 3], sticky_min_periods=True)


def test_calendar_counts_from_monday(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 2, 4),)], "ts date").withColumns(calendar("ts"))
    assert [(r.day_of_week, r.month, r.day_of_month) for r in df.orderBy("ts").collect()] == [(0, 1, 1), (6, 2, 4)]


def test_too_short_for_features(series):
    with pytest.raises(FitError):
        features.require_samples(features.feature_matrix(series, lags=[400], windows=[]))


def test_clock_and_amount(spark):
    df = spark.createDataFrame([(0, 0.0), (86400 * 6 + 3 * 3600 + 59, 9.0), (-1, 1.0)], "TransactionDT long, TransactionAmt double")
    got = features.clock_features(df).collect()
    assert [(r.hour_of_day, r.day_of_week) for r in got] == [(0, 1), (3, 0), (23, 0)]
    assert "TransactionDT" not in got[0].asDict()
    logged = features.log_amount(df)
    assert "TransactionAmt" not in logged.columns
    np.testing.assert_allclose([r.log_amount for r in logged.collect()], np.log1p([0.0, 9.0, 1.0]))
    with pytest.raises(SchemaError):
        features.log_amount(df.drop("TransactionAmt"))
    assert features.clock_features(logged.drop("TransactionDT")).columns == ["log_amount"]
    assert features.drop_ids(df.withColumn("card1", F.lit(1))).columns == df.columns


def bounds(spark, n, **layout):
    row = spark.range(1).select(split.fold_bounds(F.lit(n), **layout).alias("f")).first().f
    return [(r.train_lo, r.train_hi, r.valid_lo, r.valid_hi) for r in row]


def test_fold_bounds(spark):
    assert [b[1] for b in bounds(spark, 715, valid_size=90)] == [265, 355, 445, 535, 625]
    assert [b[1] for b in bounds(spark, 100, valid_size=10)] == [50, 60, 70, 80, 90]
    sliding = bounds(spark, 100, valid_size=10, expanding=False)
    assert [b[:2] for b in sliding] == [(i * 10, 50 + i * 10) for i in range(5)]
    gapped = bounds(spark, 100, n_splits=3, valid_size=10, gap=5)
    assert [(b[1], b[2], b[3]) for b in gapped] == [(55, 60, 70), (70, 75, 85), (85, 90, 100)]
    fixed = bounds(spark, 100, n_splits=2, valid_size=10, train_size=30, expanding=False)
    assert fixed == [(0, 30, 30, 40), (10, 40, 40, 50)]
    assert bounds(spark, 100, n_splits=2, valid_size=10, initial_train_size=20)[1] == (0, 30, 30, 40)
    assert bounds(spark, 100, n_splits=4, valid_size=10, gap=5, expanding=False)[-1] == (30, 85, 90, 100)


@pytest.mark.parametrize("bad", [{"n_splits": 0}, {"valid_size": 0}, {"gap": -1}, {"initial_train_size": 0}, {"train_size": -3}])
def test_fold_parameters(spark, bad):
    with pytest.raises(SplitError):
        split.fold_bounds(F.lit(100), **bad)


@pytest.mark.parametrize("layout", [{"n_splits": 5, "valid_size": 20}, {"n_splits": 1, "valid_size": 10, "initial_train_size": 95}])
def test_too_few_rows_for_folds(spark, layout):
    with pytest.raises(Exception, match="too short"):
        bounds(spark, 100, **layout)


@pytest.mark.parametrize("expanding,gap,size", [(True, 0, None), (True, 3, 20), (False, 0, None), (False, 4, 25)])
def test_fold_rows_agree(spark, expanding, gap, size):
    """Blocks, validation folds and explicit assignment describe the same folds."""
    layout = {"n_splits": 4, "valid_size": 10, "gap": gap, "expanding": expanding}
    if size:
        layout["initial_train_size" if expanding else "train_size"] = size
    folds = bounds(spark, 100, **layout)
    rows = spark.range(100).select(F.col("id").alias("row_idx"), F.lit(100).alias("n_rows"))
    used = split.assign_folds(rows, **layout).groupBy("fold", "role").agg(F.collect_set("row_idx").alias("r")).collect()
    got = {(r.fold, r.role): sorted(r.r) for r in used}
    for i, (a, b, c, d) in enumerate(folds):
        assert got[(i, "train")] == list(range(a, b)) and got[(i, "valid")] == list(range(c, d))
    base = split.first_train_end(F.col("n_rows"), **layout)
    at = rows.select(
        "row_idx",
        split.training_block(F.col("row_idx"), base, **layout).alias("block"),
        split.validation_fold(F.col("row_idx"), base, **layout).alias("fold"),
    ).collect()
    for i, (a, b, c, d) in enumerate(folds):
        assert [r.row_idx for r in at if a <= r.block < b] == list(range(a, b))
        assert [r.row_idx for r in at if r.fold == i] == list(range(c, d))


@pytest.mark.parametrize("expanding", [True, False])
def test_cross_validation_matches_numpy(series, expanding):
    names = features.feature_names(LAGS, WINDOWS, True)
    samples = features.feature_matrix(series, lags=LAGS, windows=WINDOWS, with_calendar=True)
    metrics, models = ridge.cross_validate(samples, names, n_splits=4, valid_size=30, gap=2, expanding=expanding)
    got = {(r.series_id, r.fold): r for r in metrics.collect()}
    final = {r.series_id: r for r in models.filter(F.col("fold") == ridge.ALL_ROWS).collect()}
    for name, n, seed in (("a", 300, 1), ("b", 260, 2)):
        x, y, _ = numpy_matrix(values_of(n, seed))
        m = len(x)
        step = 32 if expanding else 30
        first = m - 3 * step - 2 - 30
        rmses = []
        for i in range(4):
            lo, hi = (0, first + i * step) if expanding else (i * step, first + i * step)
            coef, start = numpy_ridge(x[lo:hi], y[lo:hi])
            at = np.arange(hi + 2, hi + 32)
            res = y[at] - (start + x[at] @ coef)
            r = got[(name, i)]
            rmses.append(np.sqrt(np.mean(res**2)))
            assert r.n_samples == 30
            assert r.rmse == pytest.approx(rmses[-1], rel=1e-9)
            assert r.residual_time_correlation == pytest.approx(np.corrcoef(res, at)[0, 1], rel=1e-7)
            if i:
                assert r.running_cv_percent == pytest.approx(np.std(rmses) / np.mean(rmses) * 100, rel=1e-7)
            else:
                assert r.running_cv_percent is None
        coef, start = numpy_ridge(x, y)
        np.testing.assert_allclose(final[name].coefficients, coef, rtol=1e-8)
        assert final[name].intercept == pytest.approx(start, rel=1e-9)
        np.testing.assert_allclose(final[name].feature_mean, x.mean(0), rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(final[name].feature_scale, x.std(0), rtol=1e-8)


def test_ridge_groups_and_constant_feature(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 2))
    y = 3 * x[:, 0] + rng.normal(size=80)
    df = spark.createDataFrame([("g", float(a), 5.0, float(b)) for (a, _), b in zip(x, y)], "k string, u double, c double, target double")
    got = ridge.fit_ridge(df, ["u", "c"], by=["k"], alpha=2.5).first()
    coef, start = numpy_ridge(np.c_[x[:, 0], np.full(80, 5.0)], y, 2.5)
    np.testing.assert_allclose(got.coefficients, coef, atol=1e-10)
    assert got.intercept == pytest.approx(start)
    with pytest.raises(FitError):
        ridge.fit_ridge(df, ["u"], by=["k"], alpha=0)


def test_ridge_agrees_with_mllib(spark):
    """MLlib's normal solver with regParam = alpha * std(y) / n is the same fit."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 2))
    x = (x - x.mean(0)) / x.std(0)
    y = x @ [2.0, -1.0] + rng.normal(size=200)
    df = spark.createDataFrame([("k", float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "k string, u double, v double, target double")
    ours = ridge.fit_ridge(df, ["u", "v"], by=["k"]).first()
    vectors = VectorAssembler(inputCols=["u", "v"], outputCol="x").transform(df)
    theirs = LinearRegression(featuresCol="x", labelCol="target", solver="normal", standardization=False, regParam=float(np.std(y)) / 200).fit(vectors)
    np.testing.assert_allclose(ours.coefficients, theirs.coefficients.toArray(), rtol=1e-4)


def test_constant_residuals_have_no_correlation(spark):
    rows = [("s", 0, i, float(i), float(i) + 1) for i in range(5)]
    got = ridge.fold_metrics(spark.createDataFrame(rows, "series_id string, fold int, row_idx long, y double, y_hat double")).first()
    assert (got.rmse, got.residual_time_correlation) == (1.0, None)


def test_stability_gate(spark):
    def table(values):
        return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "series_id string, fold int, rmse double")

    steady = ridge.fold_stability(table([10, 10, 10]))
    assert steady.first().cv_percent == 0.0 and steady.first().stable
    zero = ridge.fold_stability(table([0, 0])).first()
    assert zero.cv_percent == 0.0
    wild = ridge.fold_stability(table([10, 30]))
    assert wild.first().cv_percent == pytest.approx(50.0)
    with pytest.raises(GateError):
        ridge.enforce_stability(wild)
    ridge.enforce_stability(steady)


@pytest.mark.parametrize("compat", [True, False])
def test_recursive_forecast_matches_numpy(series, compat):
    names = features.feature_names(LAGS, WINDOWS, True)
    samples = features.feature_matrix(series, lags=LAGS, windows=WINDOWS, with_calendar=True)
    models = ridge.fit_ridge(samples, names)
    got = forecast.forecast(series, models, LAGS, WINDOWS, 6, with_calendar=True, compat=compat).collect()
    for name, n, seed in (("a", 300, 1), ("b", 260, 2)):
        v = list(values_of(n, seed))
        x, y, _ = numpy_matrix(np.array(v))
        coef, start = numpy_ridge(x, y)
        rows = sorted((r for r in got if r.series_id == name), key=lambda r: r.step)
        for i, r in enumerate(rows):
            d = START + dt.timedelta(n + i)
            f = [v[-k] for k in LAGS] + [np.mean(v[-7:]), np.std(v[-7:], ddof=0 if compat else 1)]
            f += [d.weekday(), d.month, d.day, np.sin(2 * np.pi * d.weekday() / 7), np.cos(2 * np.pi * d.weekday() / 7)]
            p = start + np.dot(coef, f)
            v.append(p)
            assert r.forecast == pytest.approx(p, rel=1e-8)
            ahead = i + (1 if compat else 2)
            assert r.horizon_days == ahead and r.forecast_date == START + dt.timedelta(n - 1 + ahead)


def test_forecast_needs_history(spark, series):
    models = spark.createDataFrame([("c", [1.0], 0.0)], "series_id string, coefficients array<double>, intercept double")
    short = spark.createDataFrame(rows_of("c", [1.0, 2.0]), "series_id string, ts date, value double")
    with pytest.raises(Exception, match="shorter"):
        forecast.forecast(short, models, [3]).collect()
    with pytest.raises(FitError):
        forecast.require_history(short, 3)
    with pytest.raises(SchemaError):
        forecast.forecast(short, models, [1], steps=0)
    with pytest.raises(SchemaError):
        forecast.history_features(F.col("h"), [1], with_calendar=True)


def write_csv(path, values):
    path.write_text("date,revenue\n" + "\n".join(f"{START + dt.timedelta(i)},{v!r}" for i, v in enumerate(map(float, values))) + "\n")
    return str(path)


def test_whole_flow(spark, tmp_path):
    source = write_csv(tmp_path / "r.csv", values_of(400, 6))
    out = run_forecasting(spark, source, n_splits=3, valid_size=60, max_cv_percent=60.0, output_path=str(tmp_path / "o"))
    assert out.metrics.count() == 3 and out.models.count() == 1
    meta = out.metadata.first()
    assert (meta.n_samples, meta.n_features, meta.folds, str(meta.first_date)) == (400, 10, 3, "2020-01-01")
    ahead = forecast_from(spark, read_series(spark, source, value="revenue"), str(tmp_path / "o"), steps=3)
    assert ahead.count() == 3
    with pytest.raises(GateError):
        run_forecasting(spark, source, n_splits=3, valid_size=60, max_cv_percent=1e-6)


def test_series_files(spark, tmp_path):
    source = write_csv(tmp_path / "r.csv", [1.0, 2.0, 3.0])
    df = read_series(spark, source, value="revenue")
    assert df.columns == ["series_id", "ts", "value"] and df.count() == 3
    write_series(df, str(tmp_path / "sorted"))
    assert [r.value for r in spark.read.parquet(str(tmp_path / "sorted")).collect()] == [1.0, 2.0, 3.0]
    (tmp_path / "f.csv").write_text("d,v\n03/01/2024,1\n02/01/2024,2\n")
    got = read_series(spark, str(tmp_path / "f.csv"), "d", "v", "dd/MM/yyyy").orderBy("ts").collect()
    assert [(str(r.ts), r.value) for r in got] == [("2024-01-02", 2.0), ("2024-01-03", 1.0)]
    (tmp_path / "g.csv").write_text("date,value\n2024-01-01,1\n2024-01-03,x\n")
    with pytest.raises(GateError):
        read_series(spark, str(tmp_path / "g.csv"))
    with pytest.raises(SchemaError):
        read_series(spark, source, value="nothing")


@pytest.mark.skipif("FINOPS_GOLDEN_CSV" not in os.environ, reason="no golden series given")
def test_published_fold_metrics(spark):
    """Published numbers for a 730-day series, given by its path."""
    out = run_forecasting(spark, os.environ["FINOPS_GOLDEN_CSV"])
    rows = out.metrics.orderBy("fold").collect()
    np.testing.assert_allclose([r.rmse for r in rows], [29.059561, 30.809084, 32.123060, 30.058815, 31.353475], atol=1e-6)
    np.testing.assert_allclose(
        [r.residual_time_correlation for r in rows], [0.067362, 0.056805, -0.018448, -0.003732, -0.147891], atol=1e-6
    )
    got = out.stability.first()
    np.testing.assert_allclose([got.rmse_mean, got.rmse_std, got.cv_percent], [30.680799, 1.054926, 3.438391], atol=1e-6)


def test_rows_without_a_series_are_refused(spark):
    rows = [("a" if i else None, dt.date(2024, 1, 1) + dt.timedelta(i), float(i % 7), float(i % 5)) for i in range(60)]
    samples = spark.createDataFrame(rows, "series_id string, ts date, x double, target double")
    with pytest.raises(Exception, match="missing values"):
        ridge.cross_validate(samples, ["x"], n_splits=2, valid_size=5)[0].collect()


def test_series_left_out_of_a_forecast_are_reported(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(5)]
    series = spark.createDataFrame([(k, d, 1.0) for k in ("a", "b", "c") for d in (days if k != "c" else days[:1])], "series_id string, ts date, value double")
    fitted = spark.createDataFrame([("a", [1.0], 0.0), ("c", [1.0], 0.0), ("d", [1.0], 0.0)], "series_id string, coefficients array<double>, intercept double")
    with pytest.raises(Exception, match="no model"):
        forecast.forecast(series, fitted, [3]).collect()
    assert {r.series_id for r in forecast.forecast(series, fitted, [3], strict=False).collect()} == {"a"}
    status = {r.series_id: (r.rows, r.needed, r.has_model, r.used) for r in forecast.forecast_status(series, fitted, [3]).collect()}
    assert status == {"a": (5, 3, True, True), "b": (5, 3, False, False), "c": (1, 3, True, False), "d": (0, 3, True, False)}


def test_fold_metrics_of_two_years_by_closed_form(spark):
    """A daily series of the published shape: 730 days, 715 samples, 10 features, five folds of 90."""
    rng = np.random.default_rng(8)
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(730)]
    v = 1000 + 0.1 * np.arange(730) + 40 * np.sin(2 * np.pi * np.arange(730) / 7) + rng.normal(0, 30, 730)
    series = spark.createDataFrame([("s", d, float(x)) for d, x in zip(days, v)], "series_id string, ts date, value double")
    out = run_forecasting(spark, series, strict=False)

    rows, target = [], []
    for t in range(14, 729):
        past, dow = v[t - 7 : t], days[t].weekday()
        angle = 2 * np.pi * dow / 7
        rows.append([v[t - 1], v[t - 7], v[t - 14], past.mean(), past.std(ddof=1), dow, days[t].month, days[t].day, np.sin(angle), np.cos(angle)])
        target.append(v[t + 1])
    x, y = np.array(rows), np.array(target)
    assert x.shape == (715, 10)
    want = []
    for fold in range(5):
        end = 265 + 90 * fold
        mean, std = x[:end].mean(0), x[:end].std(0)
        z = (x - mean) / std
        w = np.linalg.solve(z[:end].T @ z[:end] + np.eye(10), z[:end].T @ (y[:end] - y[:end].mean()))
        left = y[end : end + 90] - (z[end : end + 90] @ w + y[:end].mean())
        want.append((np.sqrt((left**2).mean()), np.corrcoef(left, np.arange(90))[0, 1]))
    got = out.metrics.orderBy("fold").collect()
    np.testing.assert_allclose([(r.rmse, r.residual_time_correlation) for r in got], want, atol=1e-6)
    assert [r.drifts for r in got] == [abs(c) > 0.05 for _, c in want]
    rmses = np.array([r for r, _ in want])
    s = out.stability.first()
    np.testing.assert_allclose([s.rmse_mean, s.rmse_std, s.cv_percent], [rmses.mean(), rmses.std(), rmses.std() / rmses.mean() * 100], atol=1e-6)


def test_moments_merge_like_one_piece():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (500, 3)) + 1e8
    cuts = [0, 1, 40, 41, 300, 500]
    parts = [x[a:b] for a, b in zip(cuts, cuts[1:])]
    moments = [(len(p), p.mean(0), (p - p.mean(0)).T @ (p - p.mean(0))) for p in parts]
    n, mean, product = ridge.merged_moments(*map(list, zip(*moments)))
    assert n == 500
    np.testing.assert_allclose(mean, x.mean(0), rtol=1e-15)
    np.testing.assert_allclose(product, (x - x.mean(0)).T @ (x - x.mean(0)), rtol=1e-6, atol=1e-5)


def test_a_series_longer_than_a_task_holds(spark):
    """One series is placed by ranges, values lie far from zero; folds and models are those of a plain fit."""
    rng = np.random.default_rng(3)
    n = 900
    x = rng.normal(0, 1, (n, 2)) + np.array([1e7, -3e6])
    y = 2.0 * (x[:, 0] - 1e7) - 0.5 * (x[:, 1] + 3e6) + 5e6 + rng.normal(0, 0.1, n)
    start = dt.date(2000, 1, 1)
    rows = [("long", start + dt.timedelta(i), float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(n)]
    rows += [("short", start + dt.timedelta(i), float(x[i, 1]), float(x[i, 0]), float(y[i])) for i in range(80)]
    samples = spark.createDataFrame(rows, "series_id string, ts date, a double, b double, target double").repartition(5)
    out = {}
    for split_rows in (200, 10_000):
        metrics, fitted = ridge.cross_validate(samples, ["a", "b"], split_rows=split_rows, n_splits=3, valid_size=20)
        out[split_rows] = ({(r.series_id, r.fold): (r.n_samples, r.rmse) for r in metrics.collect()}, {(r.series_id, r.fold): (r.n, *r.coefficients, r.intercept) for r in fitted.collect()})
    for a, b in zip(out[200], out[10_000]):
        assert set(a) == set(b)
        for k in a:
            np.testing.assert_allclose(a[k], b[k], rtol=1e-7)
    for fold, end in enumerate((840, 860, 880)):
        m, s = x[:end].mean(0), x[:end].std(0)
        z = (x[:end] - m) / s
        w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y[:end] - y[:end].mean())) / s
        np.testing.assert_allclose(out[200][1]["long", fold][1:3], w, rtol=1e-6)
        valid = y[end : end + 20] - (x[end : end + 20] - m) @ w - y[:end].mean()
        np.testing.assert_allclose(out[200][0]["long", fold], (20, np.sqrt((valid**2).mean())), rtol=1e-5)
