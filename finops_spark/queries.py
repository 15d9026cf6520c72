"""The registered queries: every operator over the driver's tables.

Each query reads whole tables. Where an operator needs a shape the tables lack
(nulls, labels, intervals), it is derived from them by plain expressions that
the SQL in ``oracle.py`` repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finops_spark.functions.scalar import above_threshold, calendar, hour_of_seconds, weekday_of_seconds
from finops_spark.operators import alerts, curves, error_analysis, features, forecast, gates, intervals, models
from finops_spark.operators import calibrate, calibration_metrics, drift, encode, medians, reasons, repair, ridge, split, value
from finops_spark.operators.flat import flag_flat, rolling_stdev
from finops_spark.operators.ordered import with_position
from finops_spark.plans.forecasting import run_forecasting
from finops_spark.plans.fraud import run_fraud_scoring, run_fraud_training
from finops_spark.plans.monitor import run_monitor
from finops_spark.session import cut_lineage, shared_folder, spread, store
from finops_spark.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- inputs derived from the tables --------------------------------------------------


def event_flags(spark: SparkSession, folder: str, threshold: float) -> DataFrame:
    """Flat stretches of each user's values, as asset, date, rolling_stdev."""
    flags = flag_flat(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "value", 5, threshold)
    return flags.select(
        F.col("user_id").cast("string").alias("asset"), F.to_date("ts").alias("date"), "rolling_stdev"
    )


def kept_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flags written once, as in the monitor flow: few rows that several steps read."""
    return cut_lineage(event_flags(spark, folder, 60.0))


def event_days(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each user and day with events."""
    events = table(spark, folder, "events")
    return events.select(F.col("user_id").cast("string").alias("asset"), F.to_date("ts").alias("date")).distinct()


def user_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Two overlapping labelled intervals for each user, placed by its first day."""
    users = (
        table(spark, folder, "events")
        .groupBy("user_id")
        .agg(F.to_date(F.min("ts")).alias("first_day"))
        .withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    )
    start = F.date_add("first_day", (F.col("user_id") % 7 + 2 * F.col("k")).cast("int"))
    return users.select(
        (F.col("user_id") * 2 + F.col("k")).alias("seq"),
        F.col("user_id").cast("string").alias("asset"),
        start.alias("start_date"),
        F.date_add(start, (F.col("user_id") % 5 + 3).cast("int")).alias("end_date"),
    )


def holed_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with gaps: some values of four columns become NULL."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"),
        F.when(~F.col("l_linestatus").isin("O", "F") | (F.col("l_quantity") > 25), F.col("l_linestatus")).alias(
            "l_linestatus"
        ),
        F.lit(1).alias("constant"),
    )


def priority_series(spark: SparkSession, folder: str) -> DataFrame:
    """Daily order value by priority; the day count is bounded by the calendar."""
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("ts"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    )


def supplier_series(spark: SparkSession, folder: str) -> DataFrame:
    """Daily revenue by supplier: as many series as there are suppliers."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("series_id"), F.to_date("l_shipdate").alias("ts"))
        .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("value"))
    )


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Two scores in [0, 1] of the label 'returned', with amount and hour."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_quantity") * (1 - F.col("l_discount")) / 50).alias("score"),
        (F.lit(0.2) + F.col("l_quantity") * 0.004 + F.col("l_tax")).alias("p_cal"),
        F.col("l_extendedprice").alias("amount"),
        (F.col("l_partkey") % 24).cast("int").alias("hour_of_day"),
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as transactions: amount, seconds since an origin, two categories."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("TransactionID"),
        F.col("o_totalprice").alias("TransactionAmt"),
        (F.unix_date(F.to_date("o_orderdate")).cast("long") * 86400 + F.col("o_orderkey") * 977).alias("TransactionDT"),
        F.col("o_orderpriority").alias("card_type"),
        F.nullif("o_orderstatus", F.lit("P")).alias("merchant_category"),
        (F.col("o_custkey") % 101).cast("double").alias("V1"),
        ((F.col("o_totalprice") > 300000) & (F.col("o_custkey") % 3 == 0)).cast("int").alias("is_fraud"),
    )


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


# --- stuck-feed monitor -------------------------------------------------------------


def q_flat_feed_flags(spark, folder):
    flags = flag_flat(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "value", 5, 5.0)
    return flags.withColumn("rolling_stdev", F.round("rolling_stdev", 6))


def q_rolling_stdev(spark, folder):
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    rolled = rolling_stdev(events, "user_id", ["ts", "event_id"], "value", 5)
    return rolled.select("user_id", "event_id", F.round("rolling_stdev", 6).alias("rolling_stdev"))


def q_price_panel(spark, folder):
    """Wide daily panel (one column for each priority) turned into long rows."""
    orders = table(spark, folder, "orders")
    wide = (
        orders.groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(*[F.max(F.when(F.col("o_orderpriority") == n, F.col("o_totalprice"))).alias(n) for n in PRIORITIES])
    )
    return wide.unpivot(["date"], PRIORITIES, "asset", "price")


def q_alert_lines(spark, folder):
    return alerts.alert_lines(event_flags(spark, folder, 20.0)).select("asset", "date", "line")


def q_alert_summary(spark, folder):
    return alerts.alert_summary(event_flags(spark, folder, 20.0))


def q_affected_assets(spark, folder):
    return alerts.affected_assets(event_flags(spark, folder, 20.0))


def q_interval_first_match(spark, folder):
    return intervals.first_matches(kept_flags(spark, folder), user_intervals(spark, folder))


def q_interval_flag_split(spark, folder):
    return intervals.split_flags(kept_flags(spark, folder), user_intervals(spark, folder))


def q_interval_outcomes(spark, folder):
    return intervals.interval_outcomes(kept_flags(spark, folder), user_intervals(spark, folder))


def q_interval_outcomes_any(spark, folder):
    days = with_position(event_days(spark, folder), ["asset"], ["date"])
    return intervals.interval_outcomes(
        kept_flags(spark, folder), user_intervals(spark, folder), match="any", calendar=days
    )


def q_interval_metrics(spark, folder):
    out = intervals.detection_metrics(kept_flags(spark, folder), user_intervals(spark, folder))
    return out.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "avg_latency")])


def q_interval_idx_to_date(spark, folder):
    days = intervals.row_calendar(event_days(spark, folder))
    users = table(spark, folder, "events").select("user_id").distinct()
    labelled = users.select(
        F.col("user_id").alias("seq"),
        F.col("user_id").cast("string").alias("asset_id"),
        (F.col("user_id") % 5).alias("window_start_idx"),
        (F.col("user_id") % 5 + 3).alias("window_end_idx"),
    )
    return intervals.intervals_to_dates(labelled, days, strict=False)


# --- profiles, gates and repair -------------------------------------------------------


def q_null_profile(spark, folder):
    return repair.null_profile(holed_lineitem(spark, folder))


def q_value_ranges(spark, folder):
    return repair.value_ranges(holed_lineitem(spark, folder))


def q_medians(spark, folder):
    holed = holed_lineitem(spark, folder)
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    found = medians.exact_medians(holed, {n: F.col(n) for n in names})
    return holed.agg(*[F.count(n).alias(f"{n}_count") for n in names]).select(
        "*", *[F.lit(found[n]).alias(f"{n}_median") for n in names]
    )


def q_modes(spark, folder):
    return medians.exact_modes(holed_lineitem(spark, folder), ["l_returnflag", "l_linestatus"])


def q_repair_fill(spark, folder):
    holed = holed_lineitem(spark, folder)
    return repair.fit_repair(holed).transform(holed)


def q_repair_report(spark, folder):
    holed = holed_lineitem(spark, folder).withColumnRenamed("l_orderkey", "transaction_id")
    return repair.repair_report(holed, repair.fit_repair(holed, max_null_rate=0.3))


def q_duplicate_count(spark, folder):
    return repair.duplicate_count(table(spark, folder, "lineitem"), ["transaction_id", "l_orderkey"])


def q_heavy_tail(spark, folder):
    return repair.heavy_tail(table(spark, folder, "lineitem"), ["l_extendedprice"])


# Two pairs of bounds on the rows of a file: small tables lie outside the first and inside the second.
ROW_BOUNDS, WIDE_ROW_BOUNDS = (50_000, 600_000), (1, 10_000_000_000)


def q_gate_report(spark, folder):
    events = table(spark, folder, "events").withColumn("label", (F.col("event_type") == "error").cast("int"))
    events = events.withColumn("score", F.col("value") / 500).withColumn("day", F.substring(F.col("ts").cast("string"), 1, 10))
    checks = [
        *gates.price_gates(events, "value"),
        *gates.transaction_gates(events, "label", *ROW_BOUNDS),
        gates.row_count(*WIDE_ROW_BOUNDS),
        *gates.target_gates(events, "label"),
        *gates.series_gates(events, "day", "value"),
        *gates.score_gates(events, "label", "score", 0.5),
        gates.within("score", 0.0, 1.0, "probability"),
    ]
    return gates.gate_report(events, checks).withColumn("observed", F.round("observed", 9)).distinct()


def q_missing_gates(spark, folder):
    holed = holed_lineitem(spark, folder)
    return gates.gate_report(holed, gates.no_missing_anywhere(holed))


def q_feed_contract(spark, folder):
    events = table(spark, folder, "events")
    return gates.gate_report(events, gates.price_gates(events, "value"), by=["user_id"])


def q_class_gates(spark, folder):
    return gates.class_gates(transactions(spark, folder), "is_fraud", 2, 100)


def q_duplicate_dates(spark, folder):
    events = table(spark, folder, "events").select("user_id", F.to_date("ts").alias("day"))
    return gates.duplicate_dates(events, "user_id", "day")


def q_date_gaps(spark, folder):
    return gates.date_gaps(priority_series(spark, folder), split_hot=False)


# --- features ----------------------------------------------------------------------------


def q_lag_features(spark, folder):
    return features.lag_features(priority_series(spark, folder), [1, 7, 14], drop_na=False)


def q_rolling_features(spark, folder):
    out = features.rolling_features(priority_series(spark, folder), [7, 14])
    return _rounded(out, 4, "rolling_")


def q_rolling_sticky(spark, folder):
    out = features.rolling_features(priority_series(spark, folder), [3, 7], drop_na=False, sticky_min_periods=True)
    return _rounded(out, 4, "rolling_")


def q_calendar_features(spark, folder):
    days = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ts"))
    return _rounded(days.withColumns(calendar("ts")), 9, "day_of_week_")


def q_feature_matrix(spark, folder):
    out = features.feature_matrix(supplier_series(spark, folder), lags=[1, 7], windows=[7], with_calendar=True)
    return _rounded(_rounded(out, 4, "rolling_"), 9, "day_of_week_")


def q_row_positions(spark, folder):
    events = table(spark, folder, "events").select("user_id", "ts", "event_id")
    return with_position(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "row_idx")


def q_log_amount(spark, folder):
    out = features.log_amount(transactions(spark, folder))
    return out.select("TransactionID", F.round("log_amount", 9).alias("log_amount"))


def q_clock_features(spark, folder):
    return features.drop_ids(features.clock_features(transactions(spark, folder)), ["V1"]).select(
        "TransactionID", "hour_of_day", "day_of_week"
    )


def q_ordinal_encode(spark, folder):
    data = transactions(spark, folder).na.fill({"merchant_category": "none"})
    # Fitted on one part of the classes, so that an unseen level occurs.
    seen = data.filter(F.col("card_type") != "3-MEDIUM")
    names = ["card_type", "merchant_category"]
    coded = encode.ordinal_encode(data, encode.fit_ordinal_encoder(seen, names), names)
    return coded.select("TransactionID", *[F.col(n).cast("int").alias(n) for n in names])


def many_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions with a text column that differs in every row."""
    return transactions(spark, folder).withColumn("device", F.concat(F.lit("d-"), F.col("TransactionID").cast("string")))


def q_ordinal_many_levels(spark, folder):
    """Codes of a text column with a level for every row, one in 31 of them not seen in training."""
    data = many_levels(spark, folder)
    seen = data.filter(F.col("TransactionID") % 31 != 0)
    coded = encode.ordinal_encode(data, encode.fit_ordinal_encoder(seen, ["device"]), ["device"])
    return coded.select("TransactionID", F.col("device").cast("long").alias("code"))


def q_transaction_features(spark, folder):
    """The feature vector of every transaction, by a pipeline fitted on all but one in 31 of them."""
    data = many_levels(spark, folder)
    seen = data.filter(F.col("TransactionID") % 31 != 0)
    fitted = models.fit_transaction_pipeline(seen, repair.fit_repair(seen, "is_fraud", fill_all=True, ids=["TransactionID"]), use_log=True, ids=["TransactionID"])
    x = models.vector_to_array(F.col("features"))
    out = models.run_stages(data, fitted.base)
    return out.select("TransactionID", *[F.round(x[i], 9).alias(n) for i, n in enumerate(fitted.feature_names)])


def q_one_hot(spark, folder):
    data = transactions(spark, folder).select("TransactionID", "card_type", "merchant_category")
    seen = data.filter(F.col("card_type") != "3-MEDIUM")
    pipeline, names = encode.fit_feature_pipeline(seen, [], ["card_type", "merchant_category"])
    out = pipeline.transform(data)
    hot = models.vector_to_array(F.col("features"))
    return out.select(
        "TransactionID", *[hot[i].cast("int").alias("is_" + n.split("=")[1].lower().replace("-", "_").replace(" ", "_")) for i, n in enumerate(names)]
    )


def q_standardize(spark, folder):
    holed = holed_lineitem(spark, folder)
    names = ["l_quantity", "l_discount", "constant"]
    pipeline, _ = encode.fit_feature_pipeline(holed, names, [])
    scaled = models.vector_to_array(F.col("features"))
    out = pipeline.transform(holed)
    return out.select("l_orderkey", "l_linenumber", *[F.round(scaled[i], 6).alias(n) for i, n in enumerate(names)])


# --- splits and folds -------------------------------------------------------------------


def q_class_distribution(spark, folder):
    out = split.class_distribution(transactions(spark, folder), "is_fraud")
    return out.withColumn("share", F.round("share", 9))


def q_split_counts(spark, folder):
    parts = split.stratified_split(transactions(spark, folder), "is_fraud")
    return parts.groupBy("split", "is_fraud").agg(F.count(F.lit(1)).alias("n"))


def q_split_two_way(spark, folder):
    parts = split.stratified_split(table(spark, folder, "lineitem"), "l_returnflag", split.TWO_WAY, seed=7)
    return parts.groupBy("split", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def q_split_union(spark, folder):
    """The parts together are the input again: every order once."""
    parts = split.stratified_split(transactions(spark, folder), "is_fraud")
    train, held_out, test = (split.split_part(parts, p) for p in split.THREE_WAY)
    whole = train.unionByName(held_out).unionByName(test)
    return whole.groupBy("TransactionID", "is_fraud").agg(F.count(F.lit(1)).alias("n"))


def q_split_summary(spark, folder):
    parts = split.stratified_split(transactions(spark, folder), "is_fraud")
    out = split.split_summary(parts, "is_fraud")
    return out.withColumn("positive_rate", F.round("positive_rate", 9))


def q_stratification_check(spark, folder):
    parts = split.stratified_split(transactions(spark, folder), "is_fraud")
    return _rounded(split.stratification_check(parts, "is_fraud"), 9, ("share", "overall_share", "deviation"))


def _series_sizes(spark, folder):
    return priority_series(spark, folder).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"))


def q_folds_expanding(spark, folder):
    return split.fold_table(_series_sizes(spark, folder), n_splits=5, valid_size=30, gap=3)


def q_folds_sliding(spark, folder):
    return split.fold_table(_series_sizes(spark, folder), n_splits=4, valid_size=60, gap=5, expanding=False)


def q_fold_assignment(spark, folder):
    rows = split.with_series_rows(priority_series(spark, folder))
    used = split.assign_folds(rows, n_splits=3, valid_size=60, gap=2)
    return used.groupBy("series_id", "fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_day"), F.max("ts").alias("last_day"),
        F.round(F.sum("value"), 2).alias("total"),
    )


# --- thresholds and errors -----------------------------------------------------------------


def q_pr_curve(spark, folder):
    curve = curves.threshold_curve(scored_lines(spark, folder))
    return _rounded(curve, 9, ("precision", "recall", "f_beta", "cost_per_10k"))


def q_average_precision(spark, folder):
    out = curves.average_precision(curves.threshold_curve(scored_lines(spark, folder)))
    return _rounded(out, 9, "average_precision")


def q_best_thresholds(spark, folder):
    curve = curves.threshold_curve(scored_lines(spark, folder), fn_cost=2.5, fp_cost=1.0, beta=1.0)
    return _rounded(curves.best_thresholds(curve), 9, ("f2", "precision", "recall", "cost_per_10k"))


def q_confusion_at_threshold(spark, folder):
    out = curves.confusion_at(scored_lines(spark, folder), 0.55)
    return _rounded(out, 9, ("precision", "recall", "f2", "cost_per_10k"))


def _classed(spark, folder):
    return error_analysis.with_error_class(scored_lines(spark, folder), 0.55)


def q_error_counts(spark, folder):
    return error_analysis.class_counts(_classed(spark, folder))


def q_error_amount_stats(spark, folder):
    out = error_analysis.amount_stats(_classed(spark, folder))
    return _rounded(out, 4, ("mean_amount", "std_amount"))


def q_error_hour_hist(spark, folder):
    return error_analysis.hour_histogram(_classed(spark, folder))


# --- calibration metrics -----------------------------------------------------------------------


def q_brier(spark, folder):
    return _rounded(calibration_metrics.brier(scored_lines(spark, folder), p="score"), 9, "brier")


def q_calibration_bins(spark, folder):
    out = calibration_metrics.calibration_bins(scored_lines(spark, folder), p="score")
    return _rounded(out, 9, ("mean_p", "mean_y", "gap"))


def q_calibration_error(spark, folder):
    return _rounded(calibration_metrics.calibration_error(scored_lines(spark, folder), p="p_cal"), 9, "calibration_error")


def q_calibration_report(spark, folder):
    out = calibration_metrics.calibration_report(scored_lines(spark, folder), base="score", calibrated="p_cal")
    names = ("brier_base", "brier_calibrated", "calibration_error_base", "calibration_error_calibrated")
    return _rounded(_rounded(out, 9, names), 6, "improvement_pct")


def q_isotonic_fit(spark, folder):
    lines = scored_lines(spark, folder).withColumn("margin", calibrate.array_to_vector(F.array("score")))
    model = calibrate.fit_isotonic(lines)
    points = lines.select("score", "margin").distinct()
    return model.transform(points).select("score", F.round("calibrated_value", 9).alias("calibrated"))


# --- ridge and forecasts --------------------------------------------------------------------------

CV_LAYOUT = {"n_splits": 5, "valid_size": 40}
CV_FEATURES = ["lag_1", "lag_7"]


def _cv_samples(spark, folder):
    return features.feature_matrix(supplier_series(spark, folder), lags=[1, 7], windows=[])


def q_ridge_gram(spark, folder):
    samples = _cv_samples(spark, folder)
    # In thousands, so that sums of squares keep comparable digits.
    for c in (*CV_FEATURES, "target"):
        samples = samples.withColumn(c, F.col(c) / 1000)
    return _rounded(ridge.gram(samples, CV_FEATURES), 3, "s_")


def q_ridge_one_feature(spark, folder):
    fitted = ridge.fit_ridge(_cv_samples(spark, folder), ["lag_1"], alpha=2.0)
    return fitted.select(
        "series_id", "n", F.round(F.col("coefficients")[0], 8).alias("coefficient"), F.round("intercept", 2).alias("intercept")
    )


def q_cv_metrics(spark, folder):
    metrics, _ = ridge.cross_validate(_cv_samples(spark, folder), CV_FEATURES, **CV_LAYOUT)
    out = _rounded(metrics, 2, "rmse")
    return _rounded(_rounded(out, 7, "residual_time_correlation"), 6, "running_cv_percent")


def q_cv_stability(spark, folder):
    metrics, _ = ridge.cross_validate(_cv_samples(spark, folder), CV_FEATURES, **CV_LAYOUT)
    out = ridge.fold_stability(metrics, max_cv_percent=15.0)
    return _rounded(_rounded(out, 2, ("rmse_mean", "rmse_std")), 6, "cv_percent")


def _final_models(spark, folder):
    _, fitted = ridge.cross_validate(_cv_samples(spark, folder), CV_FEATURES, **CV_LAYOUT)
    return fitted.filter(F.col("fold") == ridge.ALL_ROWS)


def q_ridge_final(spark, folder):
    return _final_models(spark, folder).select(
        "series_id", "n", F.round(F.col("coefficients")[0], 8).alias("coef_lag_1"),
        F.round(F.col("coefficients")[1], 8).alias("coef_lag_7"), F.round("intercept", 2).alias("intercept"),
    )


def q_history_features(spark, folder):
    recent = forecast.recent_history(supplier_series(spark, folder), 14)
    x = forecast.history_features(F.col("history"), [1, 7], [7, 14], compat=True)
    names = features.feature_names([1, 7], [7, 14])
    return recent.select("series_id", "last_date", *[F.round(x[i], 5).alias(n) for i, n in enumerate(names)])


def q_forecast_recursive(spark, folder):
    out = forecast.forecast(supplier_series(spark, folder), _final_models(spark, folder), [1, 7], steps=10, compat=True)
    return out.select("series_id", "step", "forecast_date", F.round("forecast", 2).alias("forecast"))


# --- models (no SQL equivalent: iterative or random) -------------------------------------------------


def _labelled_vectors(spark, folder):
    data = transactions(spark, folder).drop("TransactionID").na.fill({"merchant_category": "none"})
    parts = store(split.stratified_split(data, "is_fraud"), "parts", by="split")
    train = split.split_part(parts, "train")
    pipeline, names = encode.fit_feature_pipeline(train.drop("is_fraud"))
    vectors = [
        pipeline.transform(split.split_part(parts, p)).select("features", F.col("is_fraud").alias("label"))
        for p in split.THREE_WAY
    ]
    return vectors, names


def _gbt_calibrated(spark, folder, method):
    (train, held_out, test), _ = _labelled_vectors(spark, folder)
    _, calibrated = calibrate.train_and_calibrate(cut_lineage(spread(train)), held_out, method=method)
    scored = calibrated.transform(test)
    return scored.select(
        "label", models.positive_probability().alias("p"), calibrate.calibrated_probability(scored).alias("p_cal")
    )


def q_gbt_sigmoid(spark, folder):
    return _gbt_calibrated(spark, folder, "sigmoid")


def q_gbt_isotonic_report(spark, folder):
    return calibration_metrics.calibration_report(cut_lineage(_gbt_calibrated(spark, folder, "isotonic")))


def q_model_selection(spark, folder):
    (train, _, test), _ = _labelled_vectors(spark, folder)
    train = cut_lineage(spread(train))
    fitted = {"logistic": models.train_logistic(train), "forest": models.train_forest(train)}
    scores = {}
    for name, model in fitted.items():
        scored = cut_lineage(model.transform(test).select("label", models.positive_probability().alias("score")))
        scores[name] = models.score_average_precision(scored, "label")
    return models.selection_table(spark, scores)


def q_feature_importance(spark, folder):
    (train, _, _), names = _labelled_vectors(spark, folder)
    model = models.train_forest(cut_lineage(spread(train)))
    return models.feature_importance(spark, model, names)


def q_fraud_scoring(spark, folder):
    data = transactions(spark, folder)
    trained = run_fraud_training(spark, data, strict=False, min_test_positives=1)
    return run_fraud_scoring(spark, data.drop("is_fraud"), trained.bundle)


# --- drift and leakage ---------------------------------------------------------------------------


def _drift_batches(spark, folder):
    """Line items shipped before a day, and those from it on, dearer and with fewer flags."""
    lines = table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_returnflag", "l_extendedprice", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"), (F.to_date("l_shipdate") < F.lit("1995-06-17").cast("date")).alias("early"))
    early = lines.filter("early").drop("early")
    late = lines.filter("not early").drop("early").withColumn("l_extendedprice", F.col("l_extendedprice") * 1.5)
    return early, late, drift.fit_bins(early, early.columns, accuracy=1_000_000)


def q_psi_by_feature(spark, folder):
    return _rounded(drift.psi_by_feature(*_drift_batches(spark, folder)), 9, "psi")


def q_psi_alert(spark, folder):
    return _rounded(drift.psi_alert(drift.psi_by_feature(*_drift_batches(spark, folder))), 9, "total_psi")


def q_leakage_audit(spark, folder):
    """Every feature against the label by year; the planted one follows the label."""
    data = transactions(spark, folder).withColumn("year", F.year(F.timestamp_seconds(F.col("TransactionDT") - F.col("TransactionID") * 977)))
    data = data.withColumn("planted", F.col("is_fraud") * 100.0 + F.col("V1") / 10)
    fitted = drift.fit_bins(data, ["TransactionAmt", "V1", "planted", "card_type", "merchant_category"], accuracy=1_000_000)
    out = drift.leakage_audit(data, fitted, "is_fraud", "year")
    return _rounded(_rounded(out, 7, "correlation"), 9, "mutual_information")


# --- expected frequency, reasons, value at stake ---------------------------------------------------


def q_frequency_gaps_business(spark, folder):
    """Order days of each priority against the business days between the first and the last."""
    return gates.frequency_gaps(priority_series(spark, folder), frequency="B")


def q_frequency_gaps_month_end(spark, folder):
    """Monthly order value of each customer, dated at the month's end: months without an order."""
    monthly = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("series_id"), F.last_day("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("value"))
    return gates.frequency_gaps(monthly, frequency="ME")


def q_frequency_gaps_weekly(spark, folder):
    """Shipping days of each supplier against every seventh day from its first one on."""
    return gates.frequency_gaps(supplier_series(spark, folder), frequency="W")


REASONS = {"V1": "R07 activity out of line", "TransactionAmt": "R01 amount too high for the history"}


def q_reason_codes(spark, folder):
    """Reasons, best first, of every transaction that a saved two-feature bundle refuses."""
    data = transactions(spark, folder)
    train = data.select("V1", "TransactionAmt", F.col("is_fraud").alias("label"))
    pipeline, names = encode.fit_feature_pipeline(train, ["V1", "TransactionAmt"], [])
    model = models.train_logistic(pipeline.transform(train))
    path = shared_folder(spark, "bundle")
    models.ScoringBundle(models.PipelineModel(stages=[pipeline, model]), 0.5, "logistic", tuple(names), ("V1", "TransactionAmt")).save(spark, path)
    bundle = models.ScoringBundle.load(spark, path)
    told = reasons.reason_codes(data, bundle, reasons.fit_explainer(bundle, train), REASONS)
    return told.select("TransactionID", F.explode("reasons").alias("r")).select("TransactionID", "r.rank", "r.feature", "r.code")


def q_value_weighted_fit(spark, folder):
    """Logistic regression weighted by the amount at stake, on one standardised feature."""
    data = transactions(spark, folder).select("TransactionAmt", F.col("is_fraud").alias("label"))
    pipeline, _ = encode.fit_feature_pipeline(data.select("TransactionAmt"), ["TransactionAmt"], [])
    weighted = value.value_weights(pipeline.transform(data), "label", "TransactionAmt", contact_cost=20_000.0)
    model = models.train_logistic(weighted, weight="value_weight")
    points = pipeline.transform(data.groupBy("label").agg(F.min("TransactionAmt").alias("TransactionAmt")))
    return model.transform(points).select("label", "TransactionAmt", F.round(models.positive_probability(), 4).alias("p"))


def q_value_curve(spark, folder):
    """Amount of returned lines captured down to every distinct score."""
    curve = value.value_curve(scored_lines(spark, folder), value="amount")
    return curve.withColumns({c: F.col(c).cast("double") for c in ("captured", "captured_top", "captured_all")})


def q_recovered_value(spark, folder):
    """Returned amount in the first lines by score, and by score times amount."""
    scored = scored_lines(spark, folder).withColumn("expected_loss", F.col("score") * F.col("amount"))
    out = value.compare_rankings(scored, ["score", "expected_loss"], [1, 5, 10, 20, 50, 100], value="amount")
    return _rounded(_rounded(out, 2, ("captured",)), 9, ("captured_share",))


# --- reading and writing files in the shared folder ---------------------------------------------


def q_price_file(spark, folder):
    """A wide price file written as CSV and read back as long rows."""
    path = shared_folder(spark, "prices")
    wide = q_price_panel(spark, folder).groupBy("date").pivot("asset", PRIORITIES).agg(F.max("price"))
    wide.write.option("header", True).csv(path)
    return readers.read_prices(spark, path)


def q_interval_file(spark, folder):
    path = shared_folder(spark, "intervals")
    user_intervals(spark, folder).write.option("header", True).csv(path)
    return readers.read_intervals(spark, path)


def q_transaction_file(spark, folder):
    """Transactions with clock columns as CSV, read with their fixed types."""
    path = shared_folder(spark, "transactions")
    clocked = transactions(spark, folder).withColumns(
        {"hour_of_day": hour_of_seconds(F.col("TransactionDT")), "day_of_week": weekday_of_seconds(F.col("TransactionDT"))}
    )
    clocked.write.option("header", True).csv(path)
    return readers.read_transactions(spark, path, strict=False).withColumn(
        "TransactionID", F.col("TransactionID").cast("long")
    )


def q_series_file(spark, folder):
    path = shared_folder(spark, "series")
    supplier_series(spark, folder).write.option("header", True).csv(path)
    return readers.read_series(spark, path, "ts", "value", series="series_id", daily=False)


def q_alert_file(spark, folder):
    """Alert file: the prefix of each line is its time and level."""
    path = shared_folder(spark, "alerts")
    writers.write_alerts(event_flags(spark, folder, 20.0), path)
    return spark.read.text(path).select(F.regexp_extract("value", "^[^|]+[|]INFO[|](.*)$", 1).alias("line"))


def q_report_file(spark, folder):
    path = shared_folder(spark, "report")
    writers.write_report(q_calibration_report(spark, folder), path)
    return spark.read.json(path)


def q_prediction_file(spark, folder):
    path = shared_folder(spark, "predictions")
    scored = scored_lines(spark, folder).withColumn("predicted", above_threshold(F.col("score"), 0.55))
    writers.write_predictions(scored, path)
    return spark.read.parquet(path)


def q_sorted_file(spark, folder):
    """Transactions written in the order of all their columns."""
    path = shared_folder(spark, "sorted")
    data = transactions(spark, folder)
    writers.write_sorted(data, path, data.columns)
    return spark.read.parquet(path)


def _order_breaks(df: DataFrame, by: list[str], across_files: bool) -> DataFrame:
    """(rows, breaks): rows of a stored table that sort before the row ahead of them in their file,
    or, with ``across_files``, files that start before the end of the file ahead of them."""
    number = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("int")
    placed = df.select(F.struct(*by).alias("row"), number.alias("file"), F.monotonically_increasing_id().alias("id"))
    ahead = F.lag("row").over(Window.partitionBy("file").orderBy("id"))
    inside = placed.withColumn("bad", ahead > F.col("row")).groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), F.min("row").alias("lo"), F.max("row").alias("hi")
    )
    if across_files:  # one row for each file
        inside = inside.withColumn("bad", F.col("bad") + F.coalesce((F.lag("hi").over(Window.partitionBy(F.lit(0)).orderBy("file")) > F.col("lo")).cast("long"), F.lit(0)))
    return inside.agg(F.sum("n").alias("n_rows"), F.sum("bad").alias("breaks"))


def q_sorted_file_order(spark, folder):
    path = shared_folder(spark, "sorted")
    data = transactions(spark, folder)
    writers.write_sorted(data, path, data.columns)
    return _order_breaks(spark.read.parquet(path), data.columns, True)


def q_alert_file_order(spark, folder):
    path = shared_folder(spark, "alerts")
    writers.write_alerts(event_flags(spark, folder, 20.0), path)
    asset = F.regexp_extract("value", "asset=([^|]*)", 1).alias("asset")
    lines = spark.read.text(path).select(asset, F.regexp_extract("value", "date=([^|]*)", 1).alias("date"), "_metadata")
    return _order_breaks(lines, ["asset", "date"], True)


def q_series_file_order(spark, folder):
    path = shared_folder(spark, "series")
    writers.write_series(supplier_series(spark, folder), path)
    return _order_breaks(spark.read.parquet(path), ["series_id", "ts"], False)


# --- fits with a closed check --------------------------------------------------------------------


def q_sigmoid_fit(spark, folder):
    """Platt scaling of a score, at every distinct score."""
    lines = scored_lines(spark, folder).withColumn("margin", calibrate.array_to_vector(F.array("score")))
    out = calibrate.fit_sigmoid(lines).transform(lines.select("score", "margin").distinct())
    return out.select("score", F.round(calibrate.calibrated_probability(out), 4).alias("calibrated"))


def q_logistic_one_feature(spark, folder):
    """Balanced, penalised logistic regression on one standardised feature."""
    data = transactions(spark, folder).select("TransactionAmt", F.col("is_fraud").alias("label"))
    pipeline, _ = encode.fit_feature_pipeline(data, ["TransactionAmt"], [])
    model = models.train_logistic(pipeline.transform(data))
    points = pipeline.transform(data.groupBy("label").agg(F.min("TransactionAmt").alias("TransactionAmt")))
    out = model.transform(points)
    return out.select("label", "TransactionAmt", F.round(models.positive_probability(), 4).alias("p"))


def _one_feature(data: DataFrame, column: str):
    """A fitted pipeline of one standardised number, the data's vectors, and a logistic model on them."""
    pipeline, names = encode.fit_feature_pipeline(data, [column], [])
    vectors = pipeline.transform(data)
    return pipeline, vectors, models.train_logistic(vectors), names


def q_selection_one_feature(spark, folder):
    """Choice between two one-feature models, fitted on four fifths of the rows, by average precision on the rest."""
    data = transactions(spark, folder).withColumn("label", F.col("is_fraud"))
    train = data.filter(F.col("TransactionID") % 5 != 0)
    test = data.filter(F.col("TransactionID") % 5 == 0)
    scores = {}
    for name, column in (("by_V1", "V1"), ("by_amount", "TransactionAmt")):
        pipeline, _, model, _ = _one_feature(train.select(column, "label"), column)
        scored = model.transform(pipeline.transform(test.select(column, "label"))).select("label", models.positive_probability().alias("score"))
        scores[name] = models.score_average_precision(scored, "label")
    return models.selection_table(spark, scores).withColumn("pr_auc", F.round("pr_auc", 6))


def q_importance_one_feature(spark, folder):
    data = transactions(spark, folder).select("TransactionAmt", F.col("is_fraud").alias("label"))
    _, _, model, names = _one_feature(data, "TransactionAmt")
    return models.feature_importance(spark, model, names).withColumn("importance", F.round("importance", 3))


def q_bundle_scoring(spark, folder):
    """Every transaction scored by a bundle that was saved and loaded again."""
    data = transactions(spark, folder)
    pipeline, _, model, names = _one_feature(data.select("TransactionAmt", F.col("is_fraud").alias("label")), "TransactionAmt")
    path = shared_folder(spark, "bundle")
    stages = models.PipelineModel(stages=[pipeline, model])
    models.ScoringBundle(stages, 0.5, "logistic", tuple(names), ("TransactionAmt",)).save(spark, path)
    scored = run_fraud_scoring(spark, data.drop("is_fraud"), path)
    return scored.groupBy("card_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("predicted_fraud").cast("long")).alias("predicted"),
        F.round(F.avg("fraud_probability"), 3).alias("mean_probability"),
    )


def _binned(spark, folder):
    """Transactions with one small whole number as their only feature."""
    bin_ = F.least(F.floor(F.col("TransactionAmt") / 50000), F.lit(6)).cast("double")
    data = transactions(spark, folder).select(bin_.alias("bin"), F.col("is_fraud").alias("label"))
    return data.withColumn("features", calibrate.array_to_vector(F.array("bin")))


def q_boosting_stump(spark, folder):
    """Boosting of one tree of depth 1 without subsampling, at every value of its feature."""
    data = _binned(spark, folder)
    model = models.train_gbt(data, n_trees=1, max_depth=1, subsample=1.0)
    out = model.transform(data.select("bin", "features").distinct())
    return out.select("bin", F.round(models.positive_probability(), 6).alias("p"))


def q_forest_stump(spark, folder):
    """A balanced forest of one tree of depth 1, which takes every row, at every value of its feature."""
    data = _binned(spark, folder)
    model = models.train_forest(data, n_trees=1, max_depth=1, bootstrap=False)
    out = model.transform(data.select("bin", "features").distinct())
    return out.select("bin", F.round(models.positive_probability(), 6).alias("p"))


def q_calibrated_stump(spark, folder):
    """A boosted stump calibrated on its own rows: two margins, which the logistic curve meets."""
    data = _binned(spark, folder)
    _, calibrated = calibrate.train_and_calibrate(data, data, n_trees=1, max_depth=1, subsample=1.0)
    out = calibrated.transform(data.select("bin", "features").distinct())
    return out.select("bin", F.round(calibrate.calibrated_probability(out), 4).alias("p_cal"))


def q_monitor_flow(spark, folder):
    """The monitor from daily prices and labels to its metrics, with all gates."""
    events = table(spark, folder, "events")
    prices = events.groupBy(F.col("user_id").cast("string").alias("asset"), F.to_date("ts").alias("date")).agg(F.round(F.avg("value"), 4).alias("price"))
    result = run_monitor(spark, prices, user_intervals(spark, folder), window=3, threshold=40.0)
    return _rounded(result.metrics, 6, ("precision", "recall", "avg_latency"))


def q_forecast_flow(spark, folder):
    """Metadata of a forecasting run over all suppliers, but for its time stamp."""
    result = run_forecasting(spark, supplier_series(spark, folder), lags=[1, 7], windows=[], with_calendar=False, max_cv_percent=15.0, strict=False, **CV_LAYOUT)
    out = result.metadata.drop("created_at", "windows").withColumns({c: F.concat_ws(",", F.col(c).cast("array<string>")) for c in ("features", "lags")})
    return _rounded(_rounded(out, 2, ("rmse_mean", "rmse_std")), 6, "cv_percent")


def q_mixed_vectors(spark, folder):
    """Numbers and texts in one vector: sums of each slot over all rows."""
    data = transactions(spark, folder).select("TransactionAmt", "V1", "card_type", "merchant_category")
    pipeline, names = encode.fit_feature_pipeline(data, ["V1", "TransactionAmt"], ["card_type", "merchant_category"])
    slots = F.posexplode(calibrate.vector_to_array("features"))
    each = pipeline.transform(data).select(slots.alias("i", "x"))
    sums = each.groupBy("i").agg(F.sum(F.col("x") * F.col("x")).alias("s"))
    return sums.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1).alias("slot"), F.round("s", 3).alias("squares"))


def q_labelled_file(spark, folder):
    path = shared_folder(spark, "labelled")
    transactions(spark, folder).drop("merchant_category").write.option("header", True).csv(path)
    return readers.read_labelled(spark, path, "is_fraud").withColumn("TransactionID", F.col("TransactionID").cast("long")).withColumn("V1", F.col("V1").cast("double"))


def q_scoring_file(spark, folder):
    """Scoring input as CSV without a label."""
    path = shared_folder(spark, "scoring")
    clocked = transactions(spark, folder).withColumns(
        {"hour_of_day": hour_of_seconds(F.col("TransactionDT")), "day_of_week": weekday_of_seconds(F.col("TransactionDT"))}
    )
    clocked.drop("is_fraud", "TransactionID").write.option("header", True).csv(path)
    return readers.read_scoring_input(spark, path)


def q_interval_lines(spark, folder):
    """Intervals in several unequal files without an order column: numbered along the files."""
    path = shared_folder(spark, "interval-lines")
    rows = user_intervals(spark, folder).drop("seq")
    rows = rows.repartitionByRange(3, "asset", "start_date", "end_date").sortWithinPartitions("asset", "start_date", "end_date")
    rows.write.option("header", True).csv(path)
    return readers.read_intervals(spark, path)


def q_error_report(spark, folder):
    """Threshold predicate and error classes of every scored row, summed by hour."""
    scored = scored_lines(spark, folder)
    out = scored.withColumn("predicted", above_threshold(F.col("score"), 0.55))
    return out.groupBy("hour_of_day", "predicted").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("positives")
    )


def _rounded(df: DataFrame, digits: int, names) -> DataFrame:
    """Round the named columns (a tuple) or those with a prefix (a string), where
    the last digits of floating sums depend on their order."""
    chosen = [c for c in df.columns if (c in names if isinstance(names, tuple) else c.startswith(names))]
    return df.withColumns({c: F.round(c, digits) for c in chosen if dict(df.dtypes)[c] == "double"})


def registered() -> dict[str, Query]:
    return {name[2:]: f for name, f in globals().items() if name.startswith("q_") and callable(f)}
