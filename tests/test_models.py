"""Encoders, classifiers, calibration and the two training flows."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from finops_spark.errors import FitError, GateError, SchemaError
from finops_spark.operators import calibrate, calibration_metrics, encode, models
from finops_spark.plans.calibration import run_calibration
from finops_spark.plans.fraud import run_fraud_scoring, run_fraud_training
from finops_spark.session import spread
from finops_spark.sources.readers import read_transactions


@pytest.fixture(scope="module")
def mixed(spark):
    a, x = list("ABACBACBAC"), list("XYXYZXYZXY")
    rows = [(i, float(i + 1), 10.0 * (i + 1), a[i], x[i]) for i in range(10)]
    return spark.createDataFrame(rows, "i int, num_feat_1 double, num_feat_2 double, cat_feat_1 string, cat_feat_2 string")


def vectors(df):
    return np.array([r.v for r in df.select(vector_to_array("features").alias("v")).collect()])


def test_feature_shapes(spark, mixed):
    train, held, test = (mixed.filter(f"i >= {a} and i < {b}").drop("i") for a, b in ((0, 6), (6, 8), (8, 10)))
    pipeline, names = encode.fit_feature_pipeline(train)
    parts = [vectors(f) for f in encode.transform_splits(pipeline, train, held, test)]
    assert [p.shape for p in parts] == [(6, 8), (2, 8), (2, 8)]
    assert names[:3] == ["num_feat_1", "num_feat_2", "cat_feat_1=A"]
    np.testing.assert_allclose(parts[0][:, :2].mean(0), 0, atol=1e-12)
    np.testing.assert_allclose(parts[0][:, :2].std(0), 1)
    with pytest.raises(SchemaError):
        encode.transform_splits(pipeline, train, test.drop("cat_feat_1"))
    with pytest.raises(FitError):
        encode.fit_feature_pipeline(train.limit(0))


def test_roles(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True)], "a int, b double, c string, d boolean")
    assert encode.column_roles(df) == (["a", "b"], ["c", "d"])
    with pytest.raises(SchemaError):
        encode.column_roles(df.withColumn("e", F.array(F.lit(1))))


def test_unseen_level_is_all_zeros(spark):
    train = spark.createDataFrame([(1.0, "A"), (2.0, "B"), (3.0, "A")], "n double, c string")
    test = spark.createDataFrame([(1.0, "C"), (2.0, "A")], "n double, c string")
    pipeline, _ = encode.fit_feature_pipeline(train)
    np.testing.assert_array_equal(vectors(pipeline.transform(test))[:, 1:], [[0, 0], [1, 0]])


def test_gaps_are_filled_from_training(spark, tmp_path):
    train = spark.createDataFrame([(1.0, "A"), (None, "B"), (3.0, None), (4.0, "A")], "n double, c string")
    pipeline, _ = encode.fit_feature_pipeline(train)
    got = vectors(pipeline.transform(train))
    filled = np.array([1.0, 3.0, 3.0, 4.0])
    np.testing.assert_allclose(got[:, 0], (filled - filled.mean()) / filled.std())
    np.testing.assert_array_equal(got[2, 1:], [1, 0])
    later = spark.createDataFrame([(float("nan"), None)], "n double, c string")
    assert np.isfinite(vectors(pipeline.transform(later))).all()
    pipeline.write().overwrite().save(str(tmp_path / "p"))
    np.testing.assert_array_equal(vectors(PipelineModel.load(str(tmp_path / "p")).transform(train)), got)


def test_constant_column_has_scale_one(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "n double")
    assert encode.fit_numeric(df, ["n"])["n"].scale == 1.0


def test_ordinal_codes(spark):
    train = spark.createDataFrame([("visa", 1), ("amex", 2), ("visa", 3)], "card string, n int")
    new = spark.createDataFrame([("amex", 1), ("new", 2), ("visa", 3)], "card string, n int")
    coded = encode.ordinal_encode(new, encode.fit_ordinal_encoder(train, ["card"]), ["card"])
    assert [(r.card, r.n) for r in coded.orderBy("n").collect()] == [(0.0, 1), (-1.0, 2), (1.0, 3)]
    assert encode.fit_ordinal_encoder(train, []) == []


# --- calibration metrics ---------------------------------------------------------------


def scored(spark, y, p, q=None):
    rows = [(int(a), float(b), float(c)) for a, b, c in zip(y, p, p if q is None else q)]
    return spark.createDataFrame(rows, "label int, p double, p_cal double")


@pytest.mark.parametrize(
    "y,p,want", [([0, 0, 0, 1, 1, 1], [0, 0, 0, 1, 1, 1], 0.0), ([0, 0, 0, 1, 1, 1], [1, 1, 1, 0, 0, 0], 1.0), ([0, 0, 1, 1], [0.1, 0.2, 0.7, 0.8], 0.045)]
)
def test_brier(spark, y, p, want):
    assert calibration_metrics.brier(scored(spark, y, p)).first().brier == pytest.approx(want)


def test_calibration_error(spark):
    exact = scored(spark, [0] * 5 + [1] * 5, [0.0] * 5 + [1.0] * 5)
    assert calibration_metrics.calibration_error(exact, n_bins=2).first().calibration_error == 0.0
    rng = np.random.default_rng(1)
    p = rng.random(300)
    y = (rng.random(300) < p**2).astype(int)
    at = np.digitize(p, np.linspace(0, 1, 11)[1:-1])
    want = np.mean([abs(p[at == b].mean() - y[at == b].mean()) for b in np.unique(at)])
    assert calibration_metrics.calibration_error(scored(spark, y, p)).first().calibration_error == pytest.approx(want)
    with pytest.raises(GateError):
        calibration_metrics.require_rows(scored(spark, [], []))


def test_report(spark):
    y = [0, 0, 0, 1, 1, 1] * 20
    df = scored(spark, y, [0.6 if v else 0.4 for v in y], [0.9 if v else 0.1 for v in y])
    got = calibration_metrics.calibration_report(df, min_improvement_pct=10.0, max_calibration_error=0.1 + 1e-12).first()
    assert (got.brier_base, got.brier_calibrated, got.improvement_pct) == pytest.approx((0.16, 0.01, 93.75))
    assert got.status == "PASS"
    assert calibration_metrics.calibration_report(df, max_calibration_error=0.01).first().status == "FAIL"


@pytest.mark.parametrize("limit,ok", [(93.0, True), (94.0, False)])
def test_improvement_limit(spark, limit, ok):
    df = scored(spark, [0, 1] * 10, [0.4, 0.6] * 10, [0.1, 0.9] * 10)
    assert calibration_metrics.calibration_report(df, min_improvement_pct=limit).first().meets_improvement is ok


# --- calibration curves -------------------------------------------------------------------


def margins(spark, m, y):
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(m, y)], "m double, label int")
    return df.withColumn("margin", array_to_vector(F.array("m")))


def newton_platt(m, y):
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.c_[m, np.ones_like(m)]
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (t - p))
    return 1 / (1 + np.exp(-x @ w))


def test_sigmoid_matches_newton(spark):
    rng = np.random.default_rng(7)
    m = np.round(rng.normal(size=400), 2)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * m + 0.5))).astype(int)
    df = margins(spark, m, y)
    out = calibrate.fit_sigmoid(df).transform(df)
    got = {(r.m, r.label): r.p for r in out.select("m", "label", calibrate.calibrated_probability(out).alias("p")).collect()}
    want = newton_platt(m, y)
    np.testing.assert_allclose([got[(a, b)] for a, b in zip(m, y)], want, atol=1e-6)


def pool_adjacent(values, weights):
    blocks = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([[b[0]] * b[2] for b in blocks])


def test_isotonic_matches_pooling(spark):
    rng = np.random.default_rng(9)
    m = np.round(rng.normal(size=500), 1)
    y = (rng.random(500) < 1 / (1 + np.exp(-m))).astype(int)
    points = np.unique(m)
    want = pool_adjacent([y[m == p].mean() for p in points], [(m == p).sum() for p in points])
    df = margins(spark, m, y)
    out = calibrate.fit_isotonic(df).transform(df)
    got = {r.m: r.calibrated_value for r in out.collect()}
    np.testing.assert_allclose([got[p] for p in points], want, atol=1e-12)
    ends = calibrate.fit_isotonic(df).transform(margins(spark, [-99.0, 99.0], [0, 1])).orderBy("m").collect()
    assert [r.calibrated_value for r in ends] == pytest.approx([want[0], want[-1]])


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    rows = [([float(v) for v in r], int(r[0] + r[1] + 0.3 * e > 0)) for r, e in zip(x, rng.normal(size=300))]
    return spark.createDataFrame(rows, "x array<double>, label int").select(array_to_vector("x").alias("features"), "label")


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibrated_boosting(spark, separable, tmp_path, method):
    base, calibrated = calibrate.train_and_calibrate(separable, separable, method=method, n_trees=5)
    out = calibrated.transform(separable)
    rows = out.select(models.positive_probability().alias("p"), calibrate.calibrated_probability(out).alias("c")).collect()
    assert all(0 <= r.p <= 1 and 0 <= r.c <= 1 for r in rows)
    path = str(tmp_path / method)
    calibrated.write().overwrite().save(path)
    again = PipelineModel.load(path).transform(separable)
    np.testing.assert_allclose([r.c for r in again.select(calibrate.calibrated_probability(again).alias("c")).collect()], [r.c for r in rows])


def test_training_errors(spark, separable):
    with pytest.raises(FitError):
        models.train_gbt(separable.limit(0))
    with pytest.raises(FitError):
        calibrate.calibrate(None, separable, method="magic")
    with pytest.raises(FitError):
        calibrate.fit_sigmoid(margins(spark, [], []))
    with pytest.raises(FitError):
        calibrate.fit_isotonic(margins(spark, [], []))
    with pytest.raises(FitError):
        models.train_logistic(separable.filter("label = 1"))


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -0.5, 0.0]) + 1.5))).astype(int)
    w = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    z, beta = np.c_[x, np.ones(400)], np.zeros(4)
    ridge = np.diag([1, 1, 1, 0]) / 0.1
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta += np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (y - p)) - ridge @ beta)
    df = spark.createDataFrame([([float(v) for v in r], int(b)) for r, b in zip(x, y)], "x array<double>, label int")
    fitted = models.train_logistic(df.select(array_to_vector("x").alias("features"), "label"))
    np.testing.assert_allclose([*fitted.coefficients.toArray(), fitted.intercept], beta, atol=1e-5)


def test_importance_and_selection(spark, separable):
    forest = models.train_forest(separable, n_trees=5, max_depth=4)
    table = models.feature_importance(spark, forest, list("abcde"), top=2).collect()
    assert {r.feature for r in table} == {"a", "b"} and table[0].importance >= table[1].importance
    logistic = models.train_logistic(separable)
    assert models.feature_importance(spark, logistic, list("abcde")).count() == 5
    with pytest.raises(SchemaError):
        models.feature_importance(spark, logistic, ["a"])
    tie = models.selection_table(spark, {"logistic": 0.5, "forest": 0.5}).filter("selected").first()
    assert tie.model == "logistic"
    assert models.selection_table(spark, {"logistic": 0.4, "forest": 0.5}).filter("selected").first().model == "forest"


# --- flows -----------------------------------------------------------------------------------


def test_calibration_flow(spark, tmp_path):
    rng = np.random.default_rng(21)
    lines = ["income,age,segment,default"]
    for _ in range(600):
        u, a, s = rng.normal(), rng.integers(20, 70), rng.choice(["a", "b", "c"])
        lines.append(f"{'' if rng.random() < 0.05 else round(u, 4)},{a},{s},{int(rng.random() < 1 / (1 + np.exp(1 - 2 * u)))}")
    (tmp_path / "credit.csv").write_text("\n".join(lines) + "\n")
    out = run_calibration(spark, str(tmp_path / "credit.csv"), n_trees=5, report_path=str(tmp_path / "r"), model_path=str(tmp_path / "m"))
    report = out.report.first()
    assert report.status in ("PASS", "FAIL") and 0 < report.brier_calibrated < 0.25
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    assert 118 <= out.scored.count() <= 122
    PipelineModel.load(str(tmp_path / "m" / "model"))


@pytest.fixture(scope="module")
def transactions(spark, tmp_path_factory):
    rng = np.random.default_rng(31)
    lines = ["TransactionAmt,TransactionDT,hour_of_day,day_of_week,card_type,merchant_category,V1,is_fraud"]
    for i in range(3000):
        fraud = int(rng.random() < 0.04)
        amount = "" if rng.random() < 0.03 else round(rng.lognormal(3 + fraud, 1), 2)
        card = "" if rng.random() < 0.015 else rng.choice(["amex", "discover", "mastercard", "visa"])
        lines.append(f"{amount},{i * 977},{i % 24},{i % 7},{card},{rng.choice(['food', 'gas', 'web'])},{round(rng.normal() + fraud, 3)},{fraud}")
    path = tmp_path_factory.mktemp("fraud") / "t.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.mark.parametrize("scope", ["train", "all"])
def test_fraud_flow(spark, transactions, tmp_path, scope):
    table = read_transactions(spark, transactions)
    out = run_fraud_training(
        spark, table, fit_scope=scope, min_test_positives=5, forest_trees=5, forest_depth=4, output_path=str(tmp_path / "o")
    )
    assert out.selection.count() == 2 and out.importance.count() > 3
    assert sum(r.n for r in out.error_counts.collect()) == 600 or abs(sum(r.n for r in out.error_counts.collect()) - 600) <= 2
    assert out.error_hours.count() == 48 and out.error_amounts.count() >= 1
    new = spark.createDataFrame(
        [(None, 5000, 1, 2, "visa", "food", 0.3), (20.0, 90000, 3, 4, "unheard", None, 2.5)],
        "TransactionAmt double, TransactionDT long, hour_of_day int, day_of_week int, card_type string, merchant_category string, V1 double",
    )
    scored = run_fraud_scoring(spark, new, str(tmp_path / "o" / "bundle"), str(tmp_path / "p"), "csv")
    rows = scored.collect()
    assert scored.columns == [*new.columns, "fraud_probability", "predicted_fraud"]
    assert all(0 <= r.fraud_probability <= 1 for r in rows)
    assert all(r.predicted_fraud == int(r.fraud_probability >= out.bundle.threshold) for r in rows)
    assert models.scored_summary(scored).first().rows_scored == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).count() == 2
    with_label = run_fraud_scoring(spark, new.withColumn("is_fraud", F.lit(0)), out.bundle).collect()
    assert [r.fraud_probability for r in with_label] == [r.fraud_probability for r in rows]
    with pytest.raises(SchemaError):
        run_fraud_scoring(spark, new.drop("V1"), out.bundle)


def test_fraud_flow_uses_all_cores(spark, transactions, monkeypatch):
    """One file of transactions is one part; fitting and scoring must not run in one task."""
    from finops_spark.plans import fraud

    cores = spark.sparkContext.defaultParallelism
    seen, walked, budgets = [], [], []

    def train(ready, **options):
        sizes = ready.groupBy(F.spark_partition_id()).count().collect()
        seen.append((len(sizes), max(r["count"] for r in sizes), sum(r["count"] for r in sizes)))
        placed = ready.select(F.spark_partition_id().alias("part"), vector_to_array("features").alias("x")).collect()
        walked.extend((r["part"], r["x"][::-1]) for r in placed)
        budgets.append(options["group_mb"])
        return models.train_forest(ready, **options)

    monkeypatch.setattr(fraud, "train_forest", train)
    table = read_transactions(spark, transactions).coalesce(1)
    out = run_fraud_training(spark, table, min_test_positives=5, forest_trees=2, forest_depth=2)
    parts, largest, rows = seen[0]
    assert parts == cores and largest <= rows / cores + cores
    assert walked == sorted(walked) and budgets[0] < 256
    scored = run_fraud_scoring(spark, table, out.bundle)
    assert scored.rdd.getNumPartitions() == cores and scored.count() == table.count()


def test_spread_bounds_parts(spark):
    cores = spark.sparkContext.defaultParallelism
    table = spark.range(1000).coalesce(1)
    assert spread(table, part_rows=1000).rdd.getNumPartitions() == cores
    small = spread(table, part_rows=10)
    assert small.rdd.getNumPartitions() >= 100 and small.rdd.getNumPartitions() % cores == 0
    assert sorted(r.id for r in small.collect()) == list(range(1000))
    assert spread(table.limit(0)).count() == 0


def test_fraud_flow_gates(spark, transactions):
    table = read_transactions(spark, transactions)
    with pytest.raises(GateError):
        run_fraud_training(spark, table)
    with pytest.raises(SchemaError):
        run_fraud_training(spark, table, fit_scope="test")


def test_boolean_columns_become_features(spark):
    from finops_spark.operators.repair import fit_repair

    rows = [(float(i), i % 3 == 0, "ab"[i % 2], i % 2) for i in range(40)]
    table = spark.createDataFrame(rows, "TransactionAmt double, foreign boolean, card_type string, is_fraud int")
    steps = models.fit_transaction_pipeline(table, fit_repair(table, "is_fraud", fill_all=True), use_log=False)
    assert "foreign" in steps.feature_names
    at = steps.feature_names.index("foreign")
    got = {(r.foreign, r.features[at]) for r in models.run_stages(table, steps.base).collect()}
    assert got == {(True, 1.0), (False, 0.0)}


def test_row_bounds_are_off_unless_given(spark):
    from finops_spark.operators.gates import enforce, gate_report, transaction_gates

    table = spark.range(600_001).select((F.col("id") % 100 == 0).cast("int").alias("is_fraud"))
    enforce(gate_report(table, transaction_gates(table)))
    with pytest.raises(GateError):
        enforce(gate_report(table, transaction_gates(table, max_rows=600_000)))


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_levels_without_a_cap(spark, tmp_path, monkeypatch, broadcast_bytes):
    """More levels than an encoder in the driver's memory would take: codes, one-hot slots and a saved pipeline agree."""
    from finops_spark.operators import levels

    monkeypatch.setattr(levels, "BROADCAST_BYTES", broadcast_bytes)
    n = 12_000
    train = spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 2 == 0).alias("even"), F.col("id").cast("double").alias("x"))
    want = {k: i for i, k in enumerate(sorted(f"k{i}" for i in range(n)))}
    new = spark.createDataFrame([("k0", True, 1.0), ("k11999", False, 2.0), ("other", None, 3.0), (None, True, 4.0)], "key string, even boolean, x double")
    coded = encode.ordinal_encode(new, encode.fit_ordinal_encoder(train, ["key"]), ["key"])
    assert sorted((r.key, r.x) for r in coded.collect()) == sorted([(want["k0"], 1.0), (want["k11999"], 2.0), (-1.0, 3.0), (-1.0, 4.0)])

    pipeline, names = encode.fit_feature_pipeline(train, ["x"], ["key", "even"])
    pipeline.write().overwrite().save(str(tmp_path / "pipeline"))
    loaded = type(pipeline).load(str(tmp_path / "pipeline"))
    assert len(names) == n + 3 and names[1] == "key=k0" and list(names)[-2:] == ["even=false", "even=true"]
    for p in (pipeline, loaded):
        slots = {r.x: r.features for r in p.transform(new).select("x", "features").collect()}
        assert {int(i) for i in slots[2.0].indices} == {0, 1 + want["k11999"], 1 + n}
        assert {int(i) for i in slots[3.0].indices} == {0, 1 + n}  # unseen: zeros; the flag is filled with the smaller mode


def test_level_codes_over_ranges(spark):
    """Many levels are numbered over sorted ranges, with the same result."""
    from finops_spark.operators.levels import level_table

    rows = spark.range(3_000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("a"), F.when(F.col("id") < 5, F.col("id").cast("string")).alias("b"))
    plain, split = ({(r["column"], r["level"]): r["code"] for r in level_table(rows, ["a", "b"], n).collect()} for n in (10_000, 100))
    assert plain == split and plain["a", "v10"] == 2 and plain["b", "4"] == 4 and len(plain) == 3_005


@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "humps"])
def test_isotonic_blocks_equal_the_library(spark, kind):
    """Pooling in many small ranges gives the blocks of a fit in one piece, whatever the shape."""
    from pyspark.ml.regression import IsotonicRegression

    from finops_spark.operators.isotonic import pool_violators

    rng = np.random.default_rng(4)
    n = 600
    x = rng.permutation(n).astype(float)
    shape = {"noise": (x / n + rng.normal(0, 0.4, n)), "falling": -x, "rising": x, "humps": np.sin(x / 40)}[kind]
    w = rng.integers(1, 5, n).astype(float)
    table = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, shape, w)], "m double, y double, w double").repartition(4)
    got = pool_violators(table, "m", "y", "w", block_rows=40).orderBy("lo").collect()
    values = [r.total / r.weight for r in got]
    assert values == sorted(values) and sum(r.weight for r in got) == w.sum() and all(a.hi < b.lo for a, b in zip(got, got[1:]))
    model = IsotonicRegression(featuresCol="f", labelCol="y", weightCol="w").fit(table.withColumn("f", array_to_vector(F.array("m"))))
    fitted = dict(zip(model.boundaries, model.predictions))
    for r in got:
        assert abs(fitted[r.lo] - r.total / r.weight) < 1e-9 and abs(fitted[r.hi] - r.total / r.weight) < 1e-9


def test_isotonic_of_nothing(spark):
    from finops_spark.operators.isotonic import pool_violators

    assert pool_violators(spark.createDataFrame([], "m double, y double, w double"), "m", "y", "w").collect() == []
    with pytest.raises(FitError):
        calibrate.fit_isotonic(spark.createDataFrame([(array, 1) for array in []], "margin array<double>, label int").select(array_to_vector("margin").alias("margin"), "label"))
