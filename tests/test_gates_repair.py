"""Gates, profiles, medians, modes and repair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from finops_spark.errors import FitError, GateError, SchemaError
from finops_spark.operators import gates, medians, repair
from finops_spark.operators.gates import enforce, gate_report
from finops_spark.sources.readers import read_labelled, read_scoring_input, read_transactions

HEADER = "TransactionAmt,TransactionDT,hour_of_day,day_of_week,card_type,merchant_category,V1,is_fraud"


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def passed(df, gate):
    return gate_report(df, [gate]).first().passed


@pytest.mark.parametrize("n,ok", [(5, True), (4, False), (10, True), (11, False)])
def test_row_count_bounds_are_inclusive(spark, n, ok):
    assert passed(spark.range(n), gates.row_count(5, 10)) is ok


@pytest.mark.parametrize("values,ok", [([0, 1, 0, 1], True), ([0, 1, 2], False), ([0, -1], False), ([0, None], False)])
def test_binary_label(spark, values, ok):
    df = column(spark, values, "int")
    assert passed(df, gates.binary_label(df, "x")) is ok


def test_label_must_be_integer(spark):
    df = column(spark, [0.0, 1.0])
    with pytest.raises(SchemaError):
        gates.binary_label(df, "x")


@pytest.mark.parametrize("positives,ok", [(10, True), (5, True), (50, True), (4, False), (51, False)])
def test_positive_rate(spark, positives, ok):
    df = spark.range(1000).select((F.col("id") < positives).cast("int").alias("x"))
    assert passed(df, gates.positive_rate("x")) is ok


def test_rate_of_no_rows_fails(spark):
    assert passed(column(spark, [], "int"), gates.positive_rate("x")) is False


def test_missing_and_infinite(spark):
    df = column(spark, [1.0, float("nan"), None, float("inf")])
    got = {r.check: r.observed for r in gate_report(df, [gates.no_missing(df, "x"), gates.no_infinite(df, "x"), gates.finite("x")]).collect()}
    assert got == {"no_missing": 2.0, "no_infinite": 1.0, "finite": 3.0}


def test_text_that_is_no_number_or_date(spark):
    df = column(spark, ["1.5", "abc", "2024-02-30"], "string")
    assert gate_report(df, [gates.finite("x")]).first().observed == 2.0
    assert gate_report(column(spark, ["2024-02-28", "2024-02-30", None], "string"), [gates.parses_as_date("x")]).first().observed == 2.0
    assert passed(column(spark, ["28/02/2024"], "string"), gates.parses_as_date("x", "dd/MM/yyyy"))


def test_enforce_lists_failures(spark):
    with pytest.raises(GateError, match="row_count"):
        enforce(gate_report(spark.range(3), [gates.row_count(5, None)]))
    enforce(gate_report(spark.range(3), [gates.row_count(3, None)]))


def test_report_by_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "asset string, price double")
    rows = gate_report(df, gates.price_gates(df), by=["asset"]).filter("check = 'no_missing'").collect()
    assert {r.asset: r.passed for r in rows} == {"a": False, "b": True}


def test_class_gates(spark):
    df = spark.range(10).select((F.col("id") < 1).cast("int").alias("y"))
    report = {r.check: r.passed for r in gates.class_gates(df, "y", 2, 1).collect()}
    assert report == {"smallest_class": False, "positives": True}


def test_score_gates(spark):
    good = spark.createDataFrame([(0, 0.2), (1, 0.9)], "label int, score double")
    bad = spark.createDataFrame([(0, float("nan")), (2, 0.9)], "label int, score double")
    enforce(gate_report(good, gates.score_gates(good, threshold=0.5)))
    assert [r.passed for r in gate_report(bad, gates.score_gates(bad)).collect()] == [True, False, False]
    with pytest.raises(SchemaError):
        gates.score_gates(good, threshold=1.5)


def test_series_checks(spark):
    def series(days, values=None):
        rows = [("s", d, v) for d, v in zip(days, values or [1.0] * len(days))]
        return spark.createDataFrame(rows, "series_id string, ts string, value double").withColumn("ts", F.to_date("ts"))

    gates.enforce_series(series(["2024-01-01", "2024-01-02", "2024-01-03"]))
    with pytest.raises(GateError, match="duplicate"):
        gates.enforce_series(series(["2024-01-01", "2024-01-01", "2024-01-02"]))
    with pytest.raises(GateError, match="not daily"):
        gates.enforce_series(series(["2024-01-01", "2024-01-03"]))
    gates.enforce_series(series(["2024-01-01", "2024-01-03"]), daily=False)
    with pytest.raises(GateError, match="finite"):
        gates.enforce_series(series(["2024-01-01", "2024-01-02"], [1.0, float("inf")]))
    with pytest.raises(GateError, match="parses_as_date"):
        gates.enforce_series(series(["2024-01-01", None]))


CASES = {
    "normal even": lambda r: r.normal(size=4000),
    "normal odd": lambda r: r.normal(size=4001),
    "two values": lambda r: np.repeat([1.0, 2.0], 2000),
    "one between": lambda r: np.r_[np.ones(2000), np.full(2000, 2.0), [1.5]],
    "edge to inside": lambda r: np.r_[np.ones(2000), [1.25, 1.75], np.full(1998, 2.0)],
    "mass at both ends": lambda r: np.r_[np.zeros(1900), r.normal(size=300) + 5, np.full(1901, 100.0)],
    "constant": lambda r: np.full(3000, 3.0),
    "few": lambda r: np.array([1.0, 2.0, 4.0, 8.0]),
    "heavy middle": lambda r: np.r_[r.normal(size=1000), np.zeros(3000)],
}


@pytest.mark.parametrize("name", CASES)
def test_exact_median_by_narrowing(spark, name):
    values = CASES[name](np.random.default_rng(3))
    df = column(spark, [float(v) for v in values])
    got = medians.exact_medians(df, {"x": F.col("x")}, direct_rows=2, bracket_rows=20)["x"]
    assert got == np.median(values)


def test_median_skips_missing(spark):
    df = column(spark, [1.0, 2.0, None, float("nan"), 4.0])
    assert medians.exact_medians(df, {"x": F.col("x")}) == {"x": 2.0}
    assert medians.exact_medians(column(spark, [None, None]), {"x": F.col("x")}) == {"x": None}


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("B", "y"), ("A", "x"), ("B", None), ("A", "x"), (None, None)], "a string, b string")
    got = {r.column: (r["mode"], r.n) for r in medians.exact_modes(df, ["a", "b"]).collect()}
    assert got == {"a": ("A", 2), "b": ("x", 2)}


def test_null_rate_limit_is_strict(spark):
    df = spark.createDataFrame(
        [(None, None, 1.0), (None, None, 2.0), (None, 3.0, 3.0), (1.0, 4.0, 4.0), (2.0, 5.0, 5.0)],
        "much double, edge double, full double",
    )
    assert repair.fit_repair(df).dropped == ("much",)
    rates = {r.column: r.null_rate for r in repair.null_profile(df).collect()}
    assert rates == {"much": 0.6, "edge": 0.4, "full": 0.0}


def test_fill_with_median_and_mode(spark):
    df = spark.createDataFrame(
        [(1.0, "A"), (2.0, "B"), (None, None), (4.0, "B"), (2.0, "C")], "n double, c string"
    )
    out = repair.fit_repair(df).transform(df).collect()
    assert out[2].n == 2.0 and out[2].c == "B"


def test_integer_column_with_half_median(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    assert sorted(r.n for r in repair.fit_repair(df).transform(df).collect()) == [1.0, 1.5, 2.0]
    whole = spark.createDataFrame([(1,), (3,), (3,), (None,)], "n int")
    fixed = repair.fit_repair(whole).transform(whole)
    assert dict(fixed.dtypes)["n"] == "int" and fixed.filter("n = 3").count() == 3


def test_quotes_in_fill_values(spark):
    df = spark.createDataFrame([("it's \\ odd",), (None,), ("it's \\ odd",)], "c string")
    assert {r.c for r in repair.fit_repair(df).transform(df).collect()} == {"it's \\ odd"}


def test_nothing_to_fill_from(spark):
    numbers = spark.createDataFrame([(None, 1.0), (None, 2.0)], "n double, m double")
    texts = spark.createDataFrame([(None, 1.0), (None, 2.0)], "c string, m double")
    for df in (numbers, texts):
        with pytest.raises(FitError):
            repair.fit_repair(df, max_null_rate=1.0)


def test_booleans_are_not_filled(spark):
    df = spark.createDataFrame([(True, 1.0), (None, 2.0), (False, 3.0)], "b boolean, m double")
    assert repair.fit_repair(df).transform(df).filter("b is null").count() == 1


@pytest.mark.parametrize(
    "schema,values,n", [("TransactionID int", [1, 2, 2, 3], 1), ("transaction_id string", ["A", "B", "A"], 1), ("other int", [1, 1], 0), ("TransactionID int", [None, None, 1], 1)]
)
def test_duplicates(spark, schema, values, n):
    df = spark.createDataFrame([(v,) for v in values], schema)
    assert repair.duplicate_count(df).first().n_duplicates == n


@pytest.mark.parametrize(
    "values,kind,heavy",
    [([1.0, 1.0, 1.0, 10000.0], "double", True), ([2.0, 2.0, 2.0, 10.0], "double", False), ([0.0, 0.0, 0.0, 100.0], "double", False), (["a", "b"], "string", False)],
)
def test_heavy_tail(spark, values, kind, heavy):
    df = spark.createDataFrame([(v,) for v in values], f"TransactionAmt {kind}")
    assert repair.heavy_tail(df).first().is_heavy is heavy
    assert repair.heavy_tail(df.withColumnRenamed("TransactionAmt", "z")).first().is_heavy is False


def test_zero_variance(spark):
    df = spark.createDataFrame([(5.0, 1.0, "t"), (5.0, 2.0, "t"), (5.0, 3.0, "t")], "same double, varies double, text string")
    assert repair.fit_repair(df).dropped == ("same",)
    assert repair.fit_repair(df.limit(1)).dropped == ()


def test_dropped_columns_are_sorted_and_label_is_kept(spark):
    df = spark.range(10).select(
        F.lit(1.0).alias("z_col"), F.lit(None).cast("double").alias("m_col"), F.lit(2.0).alias("a_col"),
        F.col("id").cast("double").alias("k"), F.lit(0).alias("is_fraud"),
    )
    fitted = repair.fit_repair(df, label="is_fraud")
    assert fitted.dropped == ("a_col", "m_col", "z_col")
    assert "is_fraud" in fitted.transform(df).columns


def test_repair_as_a_whole(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None, 5.0, "A", 1.0), (2, 1.0, None, 5.0, None, None), (2, 1.0, 1.0, 5.0, "A", 3.0), (3, 10000.0, None, 5.0, "B", 2.0)],
        "TransactionID int, TransactionAmt double, high_null double, zero_var double, cat string, num double",
    )
    fitted = repair.fit_repair(df)
    assert fitted.dropped == ("high_null", "zero_var")
    assert (fitted.n_duplicates, fitted.heavy_tail, fitted.fills) == (1, True, {"num": 2.0, "cat": "A"})
    assert fitted.transform(df).filter("cat is null or num is null").count() == 0
    report = {(r.section, r.item): r.detail for r in repair.repair_report(df, fitted).collect()}
    assert report[("duplicates", "rows")] == "1" and report[("log_transform", "flag")] == "true"
    # A later batch gets the values learned here, not its own.
    later = df.withColumn("num", F.lit(None).cast("double"))
    assert {r.num for r in fitted.transform(later).collect()} == {2.0}


def transaction_file(path, n, positives, extra=""):
    lines = [HEADER + (",note" if extra else "")]
    lines += [f"{i % 7 + 0.5},{i * 60},{i % 24},{i % 7},visa,food,0.1,{int(i < positives)}{extra}" for i in range(n)]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_transaction_file(spark, tmp_path):
    good = transaction_file(tmp_path / "t.csv", 1000, 20, ",x")
    df = read_transactions(spark, good, min_rows=1000, max_rows=1000)
    assert df.count() == 1000 and dict(df.dtypes)["TransactionDT"] == "bigint" and "note" in df.columns
    with pytest.raises(GateError, match="row_count"):
        read_transactions(spark, good, min_rows=50_000, max_rows=600_000)
    assert read_transactions(spark, good).count() == 1000
    with pytest.raises(GateError, match="positive_rate"):
        read_transactions(spark, transaction_file(tmp_path / "r.csv", 1000, 100), min_rows=None, max_rows=None)
    (tmp_path / "e.csv").write_text(HEADER + "\n")
    with pytest.raises(GateError):
        read_transactions(spark, str(tmp_path / "e.csv"))
    (tmp_path / "m.csv").write_text("TransactionAmt,V1\n1,2\n")
    with pytest.raises(SchemaError):
        read_transactions(spark, str(tmp_path / "m.csv"))
    (tmp_path / "s.csv").write_text(HEADER.replace(",is_fraud", "") + "\n1.0,2,3,4,visa,food,0.5\n")
    assert read_scoring_input(spark, str(tmp_path / "s.csv")).count() == 1


def test_labelled_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,default\n1.5,0\n2.5,1\n")
    (tmp_path / "b.csv").write_text("x,default\n1.5,0\n2.5,\n")
    (tmp_path / "c.csv").write_text("x,default\n")
    assert read_labelled(spark, str(tmp_path / "a.csv")).count() == 2
    with pytest.raises(SchemaError):
        read_labelled(spark, str(tmp_path / "a.csv"), "y")
    for name in ("b.csv", "c.csv"):
        with pytest.raises(GateError):
            read_labelled(spark, str(tmp_path / name))
