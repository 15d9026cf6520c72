"""SQL equivalents of the registered queries, for a single-node check."""

from __future__ import annotations

# --- inputs shared by several statements (see the builders in queries.py) -----------

FLAGS = """flagged AS (
  SELECT CAST(user_id AS VARCHAR) AS asset, CAST(ts AS DATE) AS date, rolling_stdev FROM (
    SELECT user_id, ts,
      CASE WHEN count(value) OVER w = 5 THEN stddev_pop(value) OVER w END AS rolling_stdev
    FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
  WHERE rolling_stdev < {threshold})"""

INTERVALS = """users AS (SELECT user_id, CAST(min(ts) AS DATE) AS first_day FROM events GROUP BY user_id),
placed AS (
  SELECT user_id, k, first_day + CAST(user_id % 7 + 2 * k AS INTEGER) AS start_date
  FROM users, (VALUES (0), (1)) AS v(k)),
labelled AS (
  SELECT user_id * 2 + k AS seq, CAST(user_id AS VARCHAR) AS asset, start_date,
    start_date + CAST(user_id % 5 + 3 AS INTEGER) AS end_date
  FROM placed)"""

COUNTS = "counted AS (SELECT asset, date, count(*) AS n_flags FROM flagged GROUP BY ALL)"

PAIRS = """pairs AS (
  SELECT c.asset, c.date, c.n_flags, l.seq, l.start_date, l.end_date
  FROM counted c JOIN labelled l ON c.asset = l.asset AND c.date BETWEEN l.start_date AND l.end_date)"""

FIRST = """firsts AS (
  SELECT asset, date, n_flags, seq, start_date, end_date FROM pairs
  QUALIFY row_number() OVER (PARTITION BY asset, date ORDER BY seq) = 1)"""

MATCHED = ",\n".join([FLAGS.format(threshold=60.0), INTERVALS, COUNTS, PAIRS, FIRST])

OUTCOMES = """credited AS (SELECT DISTINCT asset, start_date FROM firsts),
first_flags AS (SELECT seq, min(date) AS first_flag FROM pairs GROUP BY seq),
outcomes AS (
  SELECT l.seq, l.asset, l.start_date, l.end_date, c.asset IS NOT NULL AS is_hit,
    CASE WHEN c.asset IS NOT NULL THEN f.first_flag END AS first_flag,
    CAST(CASE WHEN c.asset IS NOT NULL THEN f.first_flag - l.start_date END AS INTEGER) AS latency
  FROM labelled l LEFT JOIN first_flags f ON l.seq = f.seq
  LEFT JOIN credited c ON l.asset = c.asset AND l.start_date = c.start_date)"""

HOLED = """holed AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, nullif(l_discount, 0.0) AS l_discount,
    nullif(l_tax, 0.0) AS l_tax, nullif(l_returnflag, 'N') AS l_returnflag,
    CASE WHEN l_linestatus NOT IN ('O', 'F') OR l_quantity > 25 THEN l_linestatus END AS l_linestatus, 1 AS constant
  FROM lineitem)"""

PRIORITY = """series AS (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ts, round(sum(o_totalprice), 2) AS value
  FROM orders GROUP BY ALL)"""

SUPPLIER = """series AS (
  SELECT l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS ts,
    round(sum(l_extendedprice * (1 - l_discount)), 4) AS value
  FROM lineitem GROUP BY ALL)"""

SCORED = """scored AS (
  SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, l_quantity * (1 - l_discount) / 50 AS score,
    0.2::DOUBLE + l_quantity * 0.004::DOUBLE + l_tax AS p_cal, l_extendedprice AS amount,
    CAST(l_partkey % 24 AS INTEGER) AS hour_of_day
  FROM lineitem)"""

TRANSACTIONS = """transactions AS (
  SELECT o_orderkey AS "TransactionID", o_totalprice AS "TransactionAmt",
    CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS BIGINT) * 86400 + o_orderkey * 977 AS "TransactionDT",
    o_orderpriority AS card_type, nullif(o_orderstatus, 'P') AS merchant_category,
    CAST(o_custkey % 101 AS DOUBLE) AS "V1",
    CAST(o_totalprice > 300000 AND o_custkey % 3 = 0 AS INTEGER) AS is_fraud
  FROM orders)"""

CURVE = """per_score AS (
  SELECT score AS threshold, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label <> 1) AS negatives
  FROM scored GROUP BY score),
running AS (
  SELECT threshold, positives, CAST(sum(positives) OVER d AS BIGINT) AS tp, CAST(sum(negatives) OVER d AS BIGINT) AS fp,
    CAST(sum(positives) OVER () - sum(positives) OVER d AS BIGINT) AS fn,
    CAST(sum(negatives) OVER () - sum(negatives) OVER d AS BIGINT) AS tn
  FROM per_score WINDOW d AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
curve AS (
  SELECT *, tp::DOUBLE / (tp + fp) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
    coalesce({b1}::DOUBLE * tp / nullif({b1}::DOUBLE * tp + {b2}::DOUBLE * fn + fp, 0), 0) AS f_beta,
    {fn_cost}::DOUBLE * fn + fp AS total_cost,
    ({fn_cost}::DOUBLE * fn + fp) * 10000 / (tp + fp + fn + tn) AS cost_per_10k
  FROM running)"""

CURVE_F2 = CURVE.format(b1=5, b2=4, fn_cost=10)
CURVE_F1 = CURVE.format(b1=2, b2=1, fn_cost=2.5)

CLASSED = """classed AS (
  SELECT *, CASE WHEN label = 1 AND score < 0.55 THEN 'FN' WHEN label = 0 AND score >= 0.55 THEN 'FP'
    WHEN label = 1 THEN 'TP' ELSE 'TN' END AS error_class
  FROM scored)"""


def _bin(p: str) -> str:
    # Inner edges are the doubles i * (1 / 10).
    return " + ".join(f"CAST({p} >= {i * (1.0 / 10)!r}::DOUBLE AS INTEGER)" for i in range(1, 10))


def _bins(p: str, name: str = "bins") -> str:
    return f"""{name} AS (
  SELECT bin, count(*) AS n, avg(p) AS mean_p, avg(label) AS mean_y, abs(avg(p) - avg(label)) AS gap
  FROM (SELECT {_bin(p)} AS bin, {p} AS p, label FROM scored) GROUP BY bin)"""


SPLIT = """sized AS (SELECT is_fraud, count(*) AS n FROM transactions GROUP BY is_fraud),
parts AS (
  SELECT is_fraud, unnest(['train', 'calibration', 'test']) AS split,
    unnest([n * 6 // 10, n * 2 // 10, n - n * 6 // 10 - n * 2 // 10]) AS n
  FROM sized)"""

SAMPLES = """windowed AS (
  SELECT series_id, ts, value, lag(value, 1) OVER w AS lag_1, lag(value, 7) OVER w AS lag_7, lead(value) OVER w AS target
  FROM series WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
samples AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS row_idx, count(*) OVER (PARTITION BY series_id) AS n_rows
  FROM windowed WHERE lag_1 IS NOT NULL AND lag_7 IS NOT NULL AND target IS NOT NULL)"""

# Ridge with two standardised features has a closed form: the 2 x 2 system
# [n + a, n r; n r, n + a] over the standardised covariances.
SOLVE = """stats AS (
  SELECT series_id, fold, count(*) AS n, avg(lag_1) AS m1, avg(lag_7) AS m7, avg(target) AS my,
    stddev_pop(lag_1) AS s1, stddev_pop(lag_7) AS s7, covar_pop(lag_1, lag_7) AS c17,
    covar_pop(lag_1, target) AS c1y, covar_pop(lag_7, target) AS c7y
  FROM training GROUP BY series_id, fold),
system AS (
  SELECT *, n + 1.0::DOUBLE AS d, n * c17 / (s1 * s7) AS o, n * c1y / s1 AS b1, n * c7y / s7 AS b7 FROM stats),
models AS (
  SELECT series_id, fold, n, (d * b1 - o * b7) / (d * d - o * o) / s1 AS coef_lag_1,
    (d * b7 - o * b1) / (d * d - o * o) / s7 AS coef_lag_7,
    my - (d * b1 - o * b7) / (d * d - o * o) / s1 * m1 - (d * b7 - o * b1) / (d * d - o * o) / s7 * m7 AS intercept
  FROM system)"""

CV = """folds AS (
  SELECT series_id, fold, n_rows - (5 - fold) * 40 AS train_hi
  FROM (SELECT DISTINCT series_id, n_rows FROM samples), range(5) AS r(fold)),
training AS (
  SELECT s.*, f.fold FROM samples s JOIN folds f ON s.series_id = f.series_id AND s.row_idx < f.train_hi)"""

CV_METRICS = """predicted AS (
  SELECT s.series_id, f.fold, s.row_idx, s.target AS y,
    m.intercept + m.coef_lag_1 * s.lag_1 + m.coef_lag_7 * s.lag_7 AS y_hat
  FROM samples s JOIN folds f ON s.series_id = f.series_id AND s.row_idx >= f.train_hi AND s.row_idx < f.train_hi + 40
  JOIN models m ON m.series_id = s.series_id AND m.fold = f.fold),
metrics AS (
  SELECT series_id, fold, count(*) AS n_samples, sqrt(avg((y - y_hat) * (y - y_hat))) AS rmse,
    corr(y - y_hat, row_idx) AS residual_time_correlation
  FROM predicted GROUP BY series_id, fold)"""

FINAL = "training AS (SELECT *, -1 AS fold FROM samples)"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _split_rows(name: str, columns: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, "
        f"1.0::DOUBLE * (count(*) - count({c})) / count(*) AS null_rate FROM {name}"
        for c in columns
    )


HOLED_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus", "constant",
]


def _gate(check: str, column: str, observed: str, lo, hi) -> str:
    lo_sql = "NULL::DOUBLE" if lo is None else f"{float(lo)}::DOUBLE"
    hi_sql = "NULL::DOUBLE" if hi is None else f"{float(hi)}::DOUBLE"
    tests = [f"o >= {lo_sql}"] * (lo is not None) + [f"o <= {hi_sql}"] * (hi is not None)
    return (
        f"SELECT '{check}' AS \"check\", '{column}' AS \"column\", round(o, 9) AS observed, {lo_sql} AS lo, {hi_sql} AS hi, "
        f"{' AND '.join(tests)} AS passed FROM (SELECT CAST({observed} AS DOUBLE) AS o FROM src)"
    )


def _gates() -> str:
    bad = "count(*) FILTER ({0} IS NULL OR isnan({0}) OR isinf({0}))"
    label_bad = "count(*) FILTER (label IS NULL OR label NOT IN (0, 1))"
    rows = [
        ("not_empty", "*", "count(*)", 1, None),
        ("not_all_missing", "value", "count(*) FILTER (value IS NOT NULL AND NOT isnan(value))", 1, None),
        ("no_missing", "value", "count(*) FILTER (value IS NULL OR isnan(value))", None, 0),
        ("no_infinite", "value", "count(*) FILTER (isinf(value))", None, 0),
        ("row_count", "*", "count(*)", 50000, 600000),
        ("row_count", "*", "count(*)", 1, 10000000000),
        ("binary_label", "label", label_bad, None, 0),
        ("positive_rate", "label", "avg(label)", 0.005, 0.05),
        ("no_missing", "label", "count(*) FILTER (label IS NULL)", None, 0),
        ("parses_as_date", "day", "count(*) FILTER (try_cast(day AS DATE) IS NULL)", None, 0),
        ("finite", "value", bad.format("value"), None, 0),
        ("finite", "score", bad.format("score"), None, 0),
        ("probability", "score", "count(*) FILTER (score IS NULL OR score NOT BETWEEN 0 AND 1)", None, 0),
    ]
    source = """src AS (SELECT value, CAST(event_type = 'error' AS INTEGER) AS label, value / 500 AS score,
  substr(CAST(ts AS VARCHAR), 1, 10) AS day FROM events)"""
    return _with(source) + "\nUNION ALL ".join(_gate(*r) for r in rows)


def _missing_gates() -> str:
    rows = [("no_missing", c, f"count(*) - count({c})", None, 0) for c in HOLED_COLUMNS]
    return _with(HOLED, "src AS (SELECT * FROM holed)") + "\nUNION ALL ".join(_gate(*r) for r in rows)


def _newton(points: str, ridge: float, rounds: int = 30) -> str:
    """Newton steps for a logistic fit with weights over points (x, pos, neg): the
    weighted counts of labels 1 and 0 at x; ``ridge`` penalises the slope."""
    return f"""{points},
newton AS (
  SELECT 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
  UNION ALL
  SELECT step + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (
    SELECT step, a, b, sum(pos - w * p) AS g0, sum(x * (pos - w * p)) - {ridge!r}::DOUBLE * b AS g1,
      sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * x) AS h01, sum(w * p * (1 - p) * x * x) + {ridge!r}::DOUBLE AS h11
    FROM (SELECT n.step, n.a, n.b, x, pos, pos + neg AS w, 1 / (1 + exp(-(n.a + n.b * x))) AS p FROM newton n, points
      WHERE n.step < {rounds})
    GROUP BY step, a, b)),
fit AS (SELECT a, b FROM newton WHERE step = {rounds})"""


def _edges(name: str, source: str, columns) -> str:
    """Decile edges (feature, e) of each column: the values at ranks ceil(i / 10 * n)."""
    parts = [
        f"SELECT '{c}' AS feature, list_sort(list_distinct(list_transform(range(1, 10), lambda i: v[CAST(ceil(i / 10 * len(v)) AS BIGINT)]))) AS e FROM (SELECT list_sort(list(CAST(\"{c}\" AS DOUBLE))) AS v FROM {source} WHERE \"{c}\" IS NOT NULL)"
        for c in columns
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def _long(name: str, source: str, kept: str, numbers, texts) -> str:
    """(kept, feature, x, bin) of every row and feature."""
    parts = [
        f"SELECT {kept}, '{c}' AS feature, CAST(\"{c}\" AS DOUBLE) AS x, CASE WHEN \"{c}\" IS NULL THEN 'missing' ELSE CAST(len(list_filter(e, lambda t: t <= \"{c}\")) AS VARCHAR) END AS bin FROM {source}, edges WHERE feature = '{c}'"
        for c in numbers
    ] + [f"SELECT {kept}, '{c}' AS feature, NULL AS x, coalesce('=' || \"{c}\", 'missing') AS bin FROM {source}" for c in texts]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def _psi(last: str) -> str:
    numbers, texts = ("l_quantity", "l_discount", "l_extendedprice", "l_tax"), ("l_returnflag",)
    return _with(
        """lines AS (SELECT l_quantity, l_discount, l_returnflag, nullif(l_tax, 0) AS l_tax, CAST(l_shipdate AS DATE) >= DATE '1995-06-17' AS late,
    CASE WHEN CAST(l_shipdate AS DATE) >= DATE '1995-06-17' THEN l_extendedprice * 1.5 ELSE l_extendedprice END AS l_extendedprice FROM lineitem)""",
        "early AS (SELECT * FROM lines WHERE NOT late)",
        _edges("edges", "early", numbers),
        _long("rows_", "lines", "late", numbers, texts),
        "cells AS (SELECT feature, bin, count(*) FILTER (NOT late) AS r, count(*) FILTER (late) AS c FROM rows_ GROUP BY ALL)",
        "shares AS (SELECT feature, r, c, greatest(r / sum(r) OVER f, 0.0001) AS p, greatest(c / sum(c) OVER f, 0.0001) AS q FROM cells WINDOW f AS (PARTITION BY feature))",
        """psi AS (SELECT feature, CAST(sum(r) AS BIGINT) AS n_reference, CAST(sum(c) AS BIGINT) AS n_current, count(*) AS bins, sum((q - p) * ln(q / p)) AS psi FROM shares GROUP BY feature)""",
    ) + last


BINNED = """binned AS (SELECT least(floor("TransactionAmt" / 50000), 6)::DOUBLE AS bin, is_fraud AS label FROM transactions),
sizes AS (SELECT count(*)::DOUBLE AS n, sum(is_fraud)::DOUBLE AS np FROM transactions)"""

STUMP = """cells AS (SELECT bin, count(*) AS c, sum({weights}) AS n, sum({weights} * (2 * label - 1)) AS s FROM binned, sizes GROUP BY bin),
cuts AS (SELECT bin AS cut, sum(c) OVER w AS cl, sum(c) OVER () - sum(c) OVER w AS cr, sum(n) OVER w AS nl, sum(n) OVER () - sum(n) OVER w AS nr,
    sum(s) OVER w AS sl, sum(s) OVER () - sum(s) OVER w AS sr FROM cells WINDOW w AS (ORDER BY bin)),
best AS (SELECT * FROM cuts WHERE cl >= {least} AND cr >= {least} ORDER BY {score} DESC, cut LIMIT 1)"""


def _one_feature_fit(one: str = "n / (2 * np)", zero: str = "n / (2 * (n - np))") -> str:
    """Logistic regression of is_fraud on the standardised amount, balanced unless weights are given: stats (m, s), fit (a, b)."""
    return _with(
        TRANSACTIONS,
        """stats AS (SELECT avg("TransactionAmt") AS m, stddev_pop("TransactionAmt") AS s, sum("TransactionAmt") FILTER (is_fraud = 1) AS balance,
    count(*)::DOUBLE AS n, sum(is_fraud)::DOUBLE AS np FROM transactions)""",
        _newton(
            f"""points AS (
  SELECT ("TransactionAmt" - m) / s AS x, CASE WHEN is_fraud = 1 THEN {one} ELSE 0 END AS pos,
    CASE WHEN is_fraud = 0 THEN {zero} ELSE 0 END AS neg
  FROM transactions, stats)""",
            10.0,
        ),
    ).replace("WITH ", "WITH RECURSIVE ", 1)


def _two_feature_fit(rounds: int = 30) -> str:
    """Balanced logistic regression of is_fraud on standardised V1 and amount: points (id, x, y), fit (a, b, c).

    Newton steps; the 3 x 3 system is solved by its cofactors."""
    return _with(
        TRANSACTIONS,
        """stats AS (SELECT avg("V1") AS mx, stddev_pop("V1") AS sx, avg("TransactionAmt") AS my, stddev_pop("TransactionAmt") AS sy,
    count(*)::DOUBLE AS n, sum(is_fraud)::DOUBLE AS np FROM transactions)""",
        """points AS (SELECT "TransactionID" AS id, ("V1" - mx) / sx AS x, ("TransactionAmt" - my) / sy AS y, is_fraud AS label,
    CASE WHEN is_fraud = 1 THEN n / (2 * np) ELSE n / (2 * (n - np)) END AS w FROM transactions, stats)""",
        f"""newton AS (
  SELECT 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c
  UNION ALL
  SELECT step + 1, a + (k00 * g0 + k01 * g1 + k02 * g2) / det, b + (k01 * g0 + k11 * g1 + k12 * g2) / det, c + (k02 * g0 + k12 * g1 + k22 * g2) / det
  FROM (SELECT *, h00 * k00 + h01 * k01 + h02 * k02 AS det
    FROM (SELECT *, h11 * h22 - h12 * h12 AS k00, h02 * h12 - h01 * h22 AS k01, h01 * h12 - h02 * h11 AS k02,
        h00 * h22 - h02 * h02 AS k11, h01 * h02 - h00 * h12 AS k12, h00 * h11 - h01 * h01 AS k22
      FROM (SELECT step, a, b, c, sum(w * (label - p)) AS g0, sum(w * (label - p) * x) - 10 * b AS g1, sum(w * (label - p) * y) - 10 * c AS g2,
          sum(q) AS h00, sum(q * x) AS h01, sum(q * y) AS h02, sum(q * x * x) + 10 AS h11, sum(q * x * y) AS h12, sum(q * y * y) + 10 AS h22
        FROM (SELECT *, w * p * (1 - p) AS q FROM (SELECT n.step, n.a, n.b, n.c, x, y, label, w, 1 / (1 + exp(-(n.a + n.b * x + n.c * y))) AS p
          FROM newton n, points WHERE n.step < {rounds}))
        GROUP BY step, a, b, c)))),
fit AS (SELECT a, b, c FROM newton WHERE step = {rounds})""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


def _frequency(source: str, expected: str) -> str:
    """Days of ``series`` that a rule over (d, lo) expects but that have no row, and the other way round."""
    return _with(
        source,
        "ends AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM series GROUP BY 1)",
        "days AS (SELECT series_id, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM ends)",
        f"wanted AS (SELECT series_id, d FROM days WHERE {expected})",
        "seen AS (SELECT DISTINCT series_id, ts AS d FROM series)",
    ) + """SELECT series_id, d AS ts, 'missing' AS kind FROM (SELECT * FROM wanted EXCEPT SELECT * FROM seen)
UNION ALL SELECT series_id, d, 'unexpected' FROM (SELECT * FROM seen EXCEPT SELECT * FROM wanted)"""


def statements() -> dict[str, str]:
    named = _statements()
    named["report_file"] = named["calibration_report"]
    return named


def _statements() -> dict[str, str]:
    named_metrics = """SELECT tp, n - tp AS fp, n_int - n_hit AS fn, round(coalesce(tp::DOUBLE / nullif(n, 0), 0), 6) AS precision,
  round(coalesce(n_hit::DOUBLE / nullif(n_int, 0), 0), 6) AS recall, round(coalesce(lat, 0), 6) AS avg_latency
FROM (SELECT (SELECT CAST(coalesce(sum(n_flags), 0) AS BIGINT) FROM firsts) AS tp, (SELECT count(*) FROM flagged) AS n,
  (SELECT count(*) FROM outcomes) AS n_int, (SELECT count(*) FROM outcomes WHERE is_hit) AS n_hit,
  (SELECT avg(latency) FROM outcomes) AS lat)"""
    return {
        "flat_feed_flags": """
SELECT user_id, ts, event_id, round(rolling_stdev, 6) AS rolling_stdev FROM (
  SELECT user_id, ts, event_id,
    CASE WHEN count(value) OVER w = 5 THEN stddev_pop(value) OVER w END AS rolling_stdev
  FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
WHERE rolling_stdev < 5.0""",
        "rolling_stdev": """
SELECT user_id, event_id, round(CASE WHEN count(value) OVER w = 5 THEN stddev_pop(value) OVER w END, 6) AS rolling_stdev
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
        "price_panel": """
SELECT d.date, p.asset, max(o.o_totalprice) AS price
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) d
CROSS JOIN (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS asset) p
LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE) = d.date AND o.o_orderpriority = p.asset
GROUP BY d.date, p.asset""",
        "alert_lines": _with(FLAGS.format(threshold=20.0))
        + """SELECT asset, date, printf('EVENT|asset=%s|date=%s|rolling_stdev=%.8f', asset, CAST(date AS VARCHAR), rolling_stdev) AS line
FROM flagged""",
        "alert_summary": _with(FLAGS.format(threshold=20.0))
        + "SELECT count(*) AS total_events, count(DISTINCT asset) AS unique_assets FROM flagged",
        "affected_assets": _with(FLAGS.format(threshold=20.0))
        + "SELECT asset, count(*) AS events FROM flagged GROUP BY asset",
        "interval_first_match": _with(MATCHED) + "SELECT * FROM firsts",
        "interval_flag_split": _with(MATCHED)
        + """SELECT c.asset, c.date, c.n_flags, f.seq IS NOT NULL AS is_hit
FROM counted c LEFT JOIN firsts f ON c.asset = f.asset AND c.date = f.date""",
        "interval_outcomes": _with(MATCHED, OUTCOMES) + "SELECT * FROM outcomes",
        "interval_outcomes_any": _with(
            MATCHED,
            "first_flags AS (SELECT seq, min(date) AS first_flag FROM pairs GROUP BY seq)",
            "days AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS asset, CAST(ts AS DATE) AS date FROM events)",
            "numbered AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS i FROM days)",
        )
        + """SELECT l.seq, l.asset, l.start_date, l.end_date, f.first_flag IS NOT NULL AS is_hit, f.first_flag, b.i - a.i AS latency
FROM labelled l LEFT JOIN first_flags f ON l.seq = f.seq
LEFT JOIN numbered a ON a.asset = l.asset AND a.date = l.start_date
LEFT JOIN numbered b ON b.asset = l.asset AND b.date = f.first_flag""",
        "interval_metrics": _with(MATCHED, OUTCOMES) + named_metrics,
        "interval_idx_to_date": """
WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) - 1 AS i FROM days),
users AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id AS seq, CAST(u.user_id AS VARCHAR) AS asset, a.date AS start_date, b.date AS end_date
FROM users u LEFT JOIN numbered a ON a.user_id = u.user_id AND a.i = u.user_id % 5
LEFT JOIN numbered b ON b.user_id = u.user_id AND b.i = u.user_id % 5 + 3""",
        "null_profile": _with(HOLED) + _split_rows("holed", HOLED_COLUMNS),
        "value_ranges": _with(HOLED)
        + "\nUNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count({c}) AS n_values, CAST(min({c}) AS DOUBLE) AS min_value, "
            f"CAST(max({c}) AS DOUBLE) AS max_value, min({c}) = max({c}) AND count({c}) > 1 AS zero_variance FROM holed"
            for c in HOLED_COLUMNS
            if c not in ("l_returnflag", "l_linestatus")
        ),
        "medians": _with(HOLED)
        + "SELECT "
        + ", ".join(
            f"count({c}) AS {c}_count, median({c}) AS {c}_median"
            for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
        )
        + " FROM holed",
        "modes": _with(HOLED)
        + "\nUNION ALL ".join(
            f"(SELECT '{c}' AS \"column\", {c} AS mode, count(*) AS n FROM holed WHERE {c} IS NOT NULL "
            f"GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"
            for c in ("l_returnflag", "l_linestatus")
        ),
        "repair_fill": _with(HOLED)
        + """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
  coalesce(l_discount, (SELECT median(l_discount) FROM holed)) AS l_discount,
  coalesce(l_tax, (SELECT median(l_tax) FROM holed)) AS l_tax,
  coalesce(l_returnflag, (SELECT l_returnflag FROM holed WHERE l_returnflag IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag
FROM holed""",
        # Above 30 % gaps: returnflag (a third) and linestatus (half) are dropped.
        "repair_report": _with(HOLED)
        + """SELECT * FROM (VALUES ('dropped', 'constant', NULL), ('dropped', 'l_linestatus', NULL), ('dropped', 'l_returnflag', NULL))
  AS v(section, item, detail)
UNION ALL SELECT 'filled', 'l_discount', CAST(median(l_discount) AS VARCHAR) FROM holed
UNION ALL SELECT 'filled', 'l_tax', CAST(median(l_tax) AS VARCHAR) FROM holed
UNION ALL SELECT 'duplicates', 'rows', CAST(count(*) - count(DISTINCT l_orderkey) AS VARCHAR) FROM holed
UNION ALL SELECT 'log_transform', 'flag', 'false'""",
        "duplicate_count": "SELECT count(*) - count(DISTINCT l_orderkey) AS n_duplicates FROM lineitem",
        "heavy_tail": """
SELECT 'l_extendedprice' AS "column", max(l_extendedprice) AS max_value, median(l_extendedprice) AS median_value,
  max(l_extendedprice) / median(l_extendedprice) > 1000 AS is_heavy
FROM lineitem""",
        "gate_report": _gates(),
        "missing_gates": _missing_gates(),
        "feed_contract": """
WITH measured AS (
  SELECT user_id, unnest(['not_empty', 'not_all_missing', 'no_missing', 'no_infinite']) AS "check",
    unnest(['*', 'value', 'value', 'value']) AS "column",
    unnest([count(*), count(value), count(*) - count(value), count(*) FILTER (isinf(value))])::DOUBLE AS observed,
    unnest([1, 1, NULL, NULL])::DOUBLE AS lo, unnest([NULL, NULL, 0, 0])::DOUBLE AS hi
  FROM events GROUP BY user_id)
SELECT *, coalesce(observed >= lo, observed <= hi) AS passed FROM measured""",
        "class_gates": _with(TRANSACTIONS, "sized AS (SELECT is_fraud, count(*) AS n FROM transactions GROUP BY 1)")
        + """SELECT 'smallest_class' AS "check", 'is_fraud' AS "column", min(n)::DOUBLE AS observed, 2.0::DOUBLE AS lo,
  NULL::DOUBLE AS hi, min(n) >= 2 AS passed FROM sized
UNION ALL SELECT 'positives', 'is_fraud', sum(n) FILTER (is_fraud = 1)::DOUBLE, 100.0::DOUBLE, NULL::DOUBLE,
  sum(n) FILTER (is_fraud = 1) >= 100 FROM sized""",
        "duplicate_dates": """
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1""",
        "date_gaps": _with(PRIORITY)
        + """SELECT * FROM (SELECT series_id, lag(ts) OVER w AS previous, ts, CAST(ts - lag(ts) OVER w AS INTEGER) AS gap_days
  FROM series WINDOW w AS (PARTITION BY series_id ORDER BY ts)) WHERE gap_days <> 1""",
        "frequency_gaps_business": _frequency(PRIORITY, "isodow(d) < 6"),
        "frequency_gaps_month_end": _frequency("series AS (SELECT DISTINCT o_custkey AS series_id, last_day(CAST(o_orderdate AS DATE)) AS ts FROM orders)", "d = last_day(d)"),
        "frequency_gaps_weekly": _frequency(SUPPLIER, "(d - lo) % 7 = 0"),
        "reason_codes": _two_feature_fit()
        + """, told AS (
  SELECT id, unnest(['V1', 'TransactionAmt']) AS feature, unnest([b * x, c * y]) AS s, unnest(['R07 activity out of line', 'R01 amount too high for the history']) AS code
  FROM points, fit WHERE 1 / (1 + exp(-(a + b * x + c * y))) >= 0.5)
SELECT id AS "TransactionID", CAST(row_number() OVER (PARTITION BY id ORDER BY s DESC, feature) AS INTEGER) AS rank, feature, code FROM told WHERE s > 0""",
        "value_weighted_fit": _one_feature_fit('"TransactionAmt" * n / (balance + 20000 * (n - np))', "20000 * n / (balance + 20000 * (n - np))")
        + """SELECT is_fraud AS label, v AS "TransactionAmt", round(1 / (1 + exp(-(a + b * (v - m) / s))), 4) AS p
FROM (SELECT is_fraud, min("TransactionAmt") AS v FROM transactions GROUP BY 1), stats, fit""",
        "value_curve": _with(SCORED, "per AS (SELECT score AS threshold, count(*) AS n, sum(CASE WHEN label = 1 THEN CAST(amount AS DECIMAL(28,4)) ELSE 0 END) AS captured FROM scored GROUP BY 1)")
        + """SELECT threshold, n, captured::DOUBLE AS captured, CAST(sum(n) OVER w AS BIGINT) AS n_top, (sum(captured) OVER w)::DOUBLE AS captured_top,
  CAST(sum(n) OVER () AS BIGINT) AS n_all, (sum(captured) OVER ())::DOUBLE AS captured_all FROM per WINDOW w AS (ORDER BY threshold DESC)""",
        "recovered_value": _with(
            SCORED,
            "long AS (SELECT 'score' AS ranking, score AS s, label, amount FROM scored UNION ALL SELECT 'expected_loss', score * amount, label, amount FROM scored)",
            "per AS (SELECT ranking, s, count(*) AS n, sum(CASE WHEN label = 1 THEN CAST(amount AS DECIMAL(28,4)) ELSE 0 END) AS c FROM long GROUP BY ALL)",
            "run AS (SELECT *, sum(n) OVER w AS top, sum(n) OVER (PARTITION BY ranking) AS n_all, sum(c) OVER (PARTITION BY ranking) AS c_all FROM per WINDOW w AS (PARTITION BY ranking ORDER BY s DESC))",
            "taken AS (SELECT *, CAST((n_all * percent) // 100 AS BIGINT) AS k FROM run, (SELECT unnest([1, 5, 10, 20, 50, 100]) AS percent))",
        )
        + """SELECT ranking, CAST(percent AS INTEGER) AS percent, any_value(k) AS n_taken, round(sum(c::DOUBLE * least(n, greatest(0, k - (top - n))) / n), 2) AS captured,
  round(sum(c::DOUBLE * least(n, greatest(0, k - (top - n))) / n) / any_value(c_all)::DOUBLE, 9) AS captured_share FROM taken GROUP BY ranking, percent""",
        "lag_features": _with(PRIORITY)
        + """SELECT *, lag(value, 1) OVER w AS lag_1, lag(value, 7) OVER w AS lag_7, lag(value, 14) OVER w AS lag_14
FROM series WINDOW w AS (PARTITION BY series_id ORDER BY ts)""",
        "rolling_features": _with(PRIORITY)
        + """SELECT * FROM (SELECT *,
  round(CASE WHEN count(value) OVER a >= 7 THEN avg(value) OVER a END, 4) AS rolling_mean_7,
  round(CASE WHEN count(value) OVER a >= 7 THEN stddev_samp(value) OVER a END, 4) AS rolling_std_7,
  round(CASE WHEN count(value) OVER b >= 14 THEN avg(value) OVER b END, 4) AS rolling_mean_14,
  round(CASE WHEN count(value) OVER b >= 14 THEN stddev_samp(value) OVER b END, 4) AS rolling_std_14
FROM series
WINDOW a AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
  b AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
WHERE rolling_std_14 IS NOT NULL""",
        "rolling_sticky": _with(PRIORITY)
        + """SELECT *,
  round(CASE WHEN count(value) OVER a >= 3 THEN avg(value) OVER a END, 4) AS rolling_mean_3,
  round(CASE WHEN count(value) OVER a >= 3 THEN stddev_samp(value) OVER a END, 4) AS rolling_std_3,
  round(CASE WHEN count(value) OVER b >= 3 THEN avg(value) OVER b END, 4) AS rolling_mean_7,
  round(CASE WHEN count(value) OVER b >= 3 THEN stddev_samp(value) OVER b END, 4) AS rolling_std_7
FROM series
WINDOW a AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  b AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
        "calendar_features": """
SELECT o_orderkey, ts, CAST(isodow - 1 AS INTEGER) AS day_of_week, CAST(month(ts) AS INTEGER) AS month,
  CAST(day(ts) AS INTEGER) AS day_of_month, round(sin(2 * pi() * (isodow - 1) / 7), 9) AS day_of_week_sin,
  round(cos(2 * pi() * (isodow - 1) / 7), 9) AS day_of_week_cos
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ts, isodow(CAST(o_orderdate AS DATE)) AS isodow FROM orders)""",
        "feature_matrix": _with(SUPPLIER)
        + """SELECT series_id, ts, value, lag_1, lag_7, round(m, 4) AS rolling_mean_7, round(s, 4) AS rolling_std_7,
  CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day_of_month,
  round(sin(2 * pi() * (isodow(ts) - 1) / 7), 9) AS day_of_week_sin,
  round(cos(2 * pi() * (isodow(ts) - 1) / 7), 9) AS day_of_week_cos, target
FROM (SELECT *, lag(value, 1) OVER w AS lag_1, lag(value, 7) OVER w AS lag_7, lead(value) OVER w AS target,
    CASE WHEN count(value) OVER a >= 7 THEN avg(value) OVER a END AS m,
    CASE WHEN count(value) OVER a >= 7 THEN stddev_samp(value) OVER a END AS s
  FROM series WINDOW w AS (PARTITION BY series_id ORDER BY ts),
    a AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
WHERE lag_7 IS NOT NULL AND s IS NOT NULL AND target IS NOT NULL""",
        "row_positions": """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_idx FROM events""",
        "log_amount": _with(TRANSACTIONS)
        + """SELECT "TransactionID", round(ln(1 + "TransactionAmt"), 9) AS log_amount FROM transactions""",
        "clock_features": _with(TRANSACTIONS)
        + """SELECT "TransactionID", CAST(("TransactionDT" // 3600) % 24 AS INTEGER) AS hour_of_day,
  CAST(("TransactionDT" // 86400 + 1) % 7 AS INTEGER) AS day_of_week FROM transactions""",
        "ordinal_encode": _with(
            TRANSACTIONS,
            "filled AS (SELECT \"TransactionID\", card_type, coalesce(merchant_category, 'none') AS m FROM transactions)",
            "seen AS (SELECT * FROM filled WHERE card_type <> '3-MEDIUM')",
            "cards AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT card_type AS v FROM seen))",
            "kinds AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT m AS v FROM seen))",
        )
        + """SELECT "TransactionID", CAST(coalesce(c.code, -1) AS INTEGER) AS card_type,
  CAST(coalesce(k.code, -1) AS INTEGER) AS merchant_category
FROM filled f LEFT JOIN cards c ON f.card_type = c.v LEFT JOIN kinds k ON f.m = k.v""",
        "ordinal_many_levels": _with(
            TRANSACTIONS,
            """devices AS (SELECT 'd-' || CAST("TransactionID" AS VARCHAR) AS v FROM transactions WHERE "TransactionID" % 31 <> 0)""",
            "codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT v FROM devices))",
        )
        + """SELECT "TransactionID", coalesce(code, -1) AS code FROM transactions LEFT JOIN codes ON v = 'd-' || CAST("TransactionID" AS VARCHAR)""",
        "transaction_features": _with(
            TRANSACTIONS,
            """everyone AS (SELECT *, 'd-' || CAST("TransactionID" AS VARCHAR) AS device FROM transactions)""",
            """seen AS (SELECT * FROM everyone WHERE "TransactionID" % 31 <> 0)""",
            "common AS (SELECT merchant_category AS c FROM seen WHERE merchant_category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
            """filled AS (SELECT *, coalesce(merchant_category, (SELECT c FROM common)) AS kind FROM everyone)""",
            "cards AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT card_type AS v FROM seen))",
            "kinds AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(merchant_category, (SELECT c FROM common)) AS v FROM seen))",
            "devices AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT device AS v FROM seen))",
        )
        + """SELECT "TransactionID", round(ln(1 + "TransactionAmt"), 9) AS log_amount, CAST(("TransactionDT" // 3600) % 24 AS DOUBLE) AS hour_of_day,
  CAST(("TransactionDT" // 86400 + 1) % 7 AS DOUBLE) AS day_of_week, "V1", CAST(coalesce(cards.code, -1) AS DOUBLE) AS card_type,
  CAST(coalesce(kinds.code, -1) AS DOUBLE) AS merchant_category, CAST(coalesce(devices.code, -1) AS DOUBLE) AS device
FROM filled LEFT JOIN cards ON cards.v = card_type LEFT JOIN kinds ON kinds.v = kind LEFT JOIN devices ON devices.v = device""",
        "psi_by_feature": _psi("SELECT feature, n_reference, n_current, bins, round(psi, 9) AS psi, psi > 0.1 AS unstable FROM psi"),
        "psi_alert": _psi("SELECT count(*) AS features, count(*) FILTER (psi > 0.1) AS unstable_features, round(sum(psi), 9) AS total_psi, sum(psi) > 0.2 AS alert FROM psi"),
        "leakage_audit": _with(
            TRANSACTIONS,
            """everyone AS (SELECT t.*, CAST(year(o_orderdate) AS INTEGER) AS period, is_fraud * 100.0::DOUBLE + "V1" / 10 AS planted FROM transactions t JOIN orders ON o_orderkey = "TransactionID")""",
            _edges("edges", "everyone", ("TransactionAmt", "V1", "planted")),
            _long("rows_", "everyone", "period, is_fraud", ("TransactionAmt", "V1", "planted"), ("card_type", "merchant_category")),
            "cells AS (SELECT period, feature, bin, count(*)::DOUBLE AS n, sum(is_fraud)::DOUBLE AS n1 FROM rows_ GROUP BY ALL)",
            "sided AS (SELECT *, sum(n) OVER w AS tn, sum(n1) OVER w AS t1 FROM cells WINDOW w AS (PARTITION BY period, feature))",
            """info AS (SELECT period, feature, sum(CASE WHEN n1 > 0 THEN n1 / tn * ln(n1 * tn / (n * t1)) ELSE 0 END
    + CASE WHEN n > n1 THEN (n - n1) / tn * ln((n - n1) * tn / (n * (tn - t1))) ELSE 0 END) AS mi FROM sided GROUP BY ALL)""",
            """correlations AS (SELECT period, feature, count(*) AS n, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(is_fraud) > 0 THEN corr(x, is_fraud) END AS r FROM rows_ GROUP BY ALL)""",
        )
        + """SELECT period, feature, n, round(r, 7) AS correlation, round(mi, 9) AS mutual_information, coalesce(abs(r) > 0.8, false) AS leaks
FROM correlations JOIN info USING (period, feature)""",
        "one_hot": _with(TRANSACTIONS)
        + """SELECT "TransactionID", CAST(card_type = '1-URGENT' AS INTEGER) AS is_1_urgent, CAST(card_type = '2-HIGH' AS INTEGER) AS is_2_high,
  CAST(card_type = '4-NOT SPECIFIED' AS INTEGER) AS is_4_not_specified, CAST(card_type = '5-LOW' AS INTEGER) AS is_5_low,
  CAST(k = 'F' AS INTEGER) AS is_f, CAST(k = 'O' AS INTEGER) AS is_o
FROM (SELECT *, coalesce(merchant_category, (SELECT merchant_category FROM transactions
    WHERE merchant_category IS NOT NULL AND card_type <> '3-MEDIUM' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS k
  FROM transactions)""",
        "standardize": _with(
            HOLED,
            """filled AS (SELECT l_orderkey, l_linenumber, l_quantity, 
    coalesce(l_discount, (SELECT median(l_discount) FROM holed)) AS l_discount, constant FROM holed)""",
            """fitted AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md,
    stddev_pop(l_discount) AS sd FROM filled)""",
        )
        + """SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity,
  round((l_discount - md) / sd, 6) AS l_discount, 0.0::DOUBLE AS constant
FROM filled, fitted""",
        "class_distribution": _with(TRANSACTIONS)
        + """SELECT is_fraud, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share
FROM transactions GROUP BY is_fraud""",
        "split_counts": _with(TRANSACTIONS, SPLIT) + "SELECT split, is_fraud, CAST(n AS BIGINT) AS n FROM parts",
        "split_two_way": """
WITH sized AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
SELECT unnest(['train', 'test']) AS split, l_returnflag, CAST(unnest([n * 8 // 10, n - n * 8 // 10]) AS BIGINT) AS n FROM sized""",
        "split_union": _with(TRANSACTIONS)
        + """SELECT "TransactionID", is_fraud, count(*) AS n FROM transactions GROUP BY ALL""",
        "split_summary": _with(TRANSACTIONS, SPLIT)
        + """SELECT split, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * is_fraud) AS BIGINT) AS positives,
  round(sum(n * is_fraud)::DOUBLE / sum(n), 9) AS positive_rate
FROM parts GROUP BY split""",
        "stratification_check": _with(TRANSACTIONS, SPLIT)
        + """SELECT split, is_fraud, n, round(share, 9) AS share, round(overall, 9) AS overall_share,
  round(abs(share - overall), 9) AS deviation, n > 0 AND abs(share - overall) <= 0.02 AS passed
FROM (SELECT split, is_fraud, CAST(n AS BIGINT) AS n, n::DOUBLE / sum(n) OVER (PARTITION BY split) AS share,
  sum(n) OVER (PARTITION BY is_fraud)::DOUBLE / sum(n) OVER () AS overall FROM parts)""",
        "folds_expanding": _with(PRIORITY, "sizes AS (SELECT series_id, count(*) AS n FROM series GROUP BY 1)")
        + """SELECT series_id, CAST(fold AS INTEGER) AS fold, unnest(['train', 'valid']) AS role,
  unnest([0, hi + 3]) AS lo, unnest([hi, hi + 33]) AS hi
FROM (SELECT series_id, fold, n - 5 * 33 + fold * 33 AS hi FROM sizes, range(5) AS r(fold))""",
        "folds_sliding": _with(PRIORITY, "sizes AS (SELECT series_id, count(*) AS n FROM series GROUP BY 1)")
        + """SELECT series_id, CAST(fold AS INTEGER) AS fold, unnest(['train', 'valid']) AS role,
  unnest([fold * 60, hi + 5]) AS lo, unnest([hi, hi + 65]) AS hi
FROM (SELECT series_id, fold, n - 4 * 60 - 5 + fold * 60 AS hi FROM sizes, range(4) AS r(fold))""",
        "fold_assignment": _with(
            PRIORITY,
            """numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i,
    count(*) OVER (PARTITION BY series_id) AS n FROM series)""",
            "folded AS (SELECT *, n - 3 * 62 + fold * 62 AS hi FROM numbered, range(3) AS r(fold))",
            """used AS (SELECT *, 'train' AS role FROM folded WHERE i < hi
    UNION ALL SELECT *, 'valid' FROM folded WHERE i >= hi + 2 AND i < hi + 62)""",
        )
        + """SELECT series_id, CAST(fold AS INTEGER) AS fold, role, count(*) AS n, min(ts) AS first_day, max(ts) AS last_day,
  round(sum(value), 2) AS total
FROM used GROUP BY series_id, fold, role""",
        "pr_curve": _with(SCORED, CURVE_F2)
        + """SELECT threshold, positives, tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(f_beta, 9) AS f_beta, total_cost, round(cost_per_10k, 9) AS cost_per_10k FROM curve""",
        "average_precision": _with(SCORED, CURVE_F2)
        + "SELECT round(sum(positives * precision) / sum(positives), 9) AS average_precision FROM curve",
        "best_thresholds": _with(
            SCORED,
            CURVE_F1,
            "f AS (SELECT * FROM curve ORDER BY f_beta DESC, threshold LIMIT 1)",
            "c AS (SELECT * FROM curve ORDER BY total_cost, threshold LIMIT 1)",
        )
        + """SELECT f.threshold AS f2_threshold, round(f.f_beta, 9) AS f2, c.threshold AS cost_threshold,
  c.total_cost AS min_total_cost, abs(f.threshold - c.threshold) <= 0.05 AS agree, f.tp, f.fp, f.fn, f.tn,
  round(f.precision, 9) AS precision, round(f.recall, 9) AS recall, f.total_cost, round(f.cost_per_10k, 9) AS cost_per_10k
FROM f, c""",
        "confusion_at_threshold": _with(
            SCORED,
            """counts AS (SELECT count(*) FILTER (label = 1 AND score >= 0.55) AS tp, count(*) FILTER (label = 0 AND score >= 0.55) AS fp,
    count(*) FILTER (label = 1 AND score < 0.55) AS fn, count(*) FILTER (label = 0 AND score < 0.55) AS tn FROM scored)""",
        )
        + """SELECT *, round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / (tp + fn), 9) AS recall,
  round(5::DOUBLE * tp / (5 * tp + 4 * fn + fp), 9) AS f2, 10.0::DOUBLE * fn + fp AS total_cost,
  round((10.0::DOUBLE * fn + fp) * 10000 / (tp + fp + fn + tn), 9) AS cost_per_10k
FROM counts""",
        "error_counts": _with(SCORED, CLASSED) + "SELECT error_class, count(*) AS n FROM classed GROUP BY 1",
        "error_amount_stats": _with(SCORED, CLASSED)
        + """SELECT error_class, 'amount' AS amount_column, count(*) AS n, round(avg(amount), 4) AS mean_amount,
  median(amount) AS median_amount, round(stddev_samp(amount), 4) AS std_amount
FROM classed WHERE error_class IN ('FN', 'TP') GROUP BY 1""",
        "error_hour_hist": _with(SCORED, CLASSED)
        + """SELECT k.error_class, CAST(h.hour AS INTEGER) AS hour, count(c.label) AS n
FROM (VALUES ('FN'), ('TP')) AS k(error_class) CROSS JOIN range(24) AS h(hour)
LEFT JOIN classed c ON c.error_class = k.error_class AND c.hour_of_day = h.hour
GROUP BY ALL""",
        "error_report": _with(SCORED)
        + """SELECT hour_of_day, CAST(score >= 0.55 AS INTEGER) AS predicted, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives
FROM scored GROUP BY ALL""",
        "brier": _with(SCORED) + "SELECT round(avg((score - label) * (score - label)), 9) AS brier FROM scored",
        "calibration_bins": _with(SCORED, _bins("score"))
        + """SELECT CAST(bin AS INTEGER) AS bin, n, round(mean_p, 9) AS mean_p, round(mean_y, 9) AS mean_y, round(gap, 9) AS gap FROM bins""",
        "calibration_error": _with(SCORED, _bins("p_cal")) + "SELECT round(avg(gap), 9) AS calibration_error FROM bins",
        "calibration_report": _with(
            SCORED,
            _bins("score", "b"),
            _bins("p_cal", "c"),
            """r AS (SELECT avg((score - label) * (score - label)) AS bb, avg((p_cal - label) * (p_cal - label)) AS bc,
    (SELECT avg(gap) FROM b) AS eb, (SELECT avg(gap) FROM c) AS ec FROM scored)""",
            "i AS (SELECT *, (bb - bc) / bb * 100 AS pct FROM r)",
        )
        + """SELECT round(bb, 9) AS brier_base, round(bc, 9) AS brier_calibrated, round(eb, 9) AS calibration_error_base,
  round(ec, 9) AS calibration_error_calibrated, round(pct, 6) AS improvement_pct, 15.0::DOUBLE AS min_improvement_pct,
  0.05::DOUBLE AS max_calibration_error, pct >= 15 AS meets_improvement, ec <= 0.05 AS meets_calibration,
  pct >= 15 AND ec <= 0.05 AS passed, CASE WHEN pct >= 15 AND ec <= 0.05 THEN 'PASS' ELSE 'FAIL' END AS status
FROM i""",
        # Isotonic regression as the max-min of block means over distinct scores.
        "isotonic_fit": _with(
            SCORED,
            "points AS (SELECT score, sum(label) AS y, count(*) AS w, row_number() OVER (ORDER BY score) AS i FROM scored GROUP BY score)",
            "sums AS (SELECT *, sum(y) OVER (ORDER BY i) AS cy, sum(w) OVER (ORDER BY i) AS cw FROM points)",
            """blocks AS (SELECT a.i AS a, b.i AS b, (b.cy - a.cy + a.y)::DOUBLE / (b.cw - a.cw + a.w) AS m
    FROM sums a JOIN sums b ON a.i <= b.i)""",
            """lowest AS (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM blocks)""",
            """best AS (SELECT b AS i, max(m) AS m FROM lowest GROUP BY b)""",
        )
        + "SELECT p.score, round(b.m, 9) AS calibrated FROM points p JOIN best b USING (i)",
        "ridge_gram": _with(
            SUPPLIER,
            SAMPLES,
            "k AS (SELECT series_id, lag_1 / 1000 AS a, lag_7 / 1000 AS b, target / 1000 AS y FROM samples)",
        )
        + """SELECT series_id, count(*) AS n, round(sum(y), 3) AS s_y, round(sum(y * y), 3) AS s_yy, round(sum(a), 3) AS s_0,
  round(sum(a * y), 3) AS s_0_y, round(sum(a * a), 3) AS s_0_0, round(sum(a * b), 3) AS s_0_1, round(sum(b), 3) AS s_1,
  round(sum(b * y), 3) AS s_1_y, round(sum(b * b), 3) AS s_1_1
FROM k GROUP BY series_id""",
        # One standardised feature: the slope is covar / (var + alpha / n).
        "ridge_one_feature": _with(
            SUPPLIER,
            SAMPLES,
            """f AS (SELECT series_id, count(*) AS n, avg(lag_1) AS m, avg(target) AS my,
    covar_pop(lag_1, target) / (var_pop(lag_1) * (1 + 2.0::DOUBLE / count(*))) AS c FROM samples GROUP BY series_id)""",
        )
        + "SELECT series_id, n, round(c, 8) AS coefficient, round(my - c * m, 2) AS intercept FROM f",
        "cv_metrics": _with(SUPPLIER, SAMPLES, CV, SOLVE, CV_METRICS)
        + """SELECT series_id, CAST(fold AS INTEGER) AS fold, n_samples, round(rmse, 2) AS rmse,
  round(residual_time_correlation, 7) AS residual_time_correlation,
  round(CASE WHEN fold > 0 THEN stddev_pop(rmse) OVER w / avg(rmse) OVER w * 100 END, 6) AS running_cv_percent
FROM metrics WINDOW w AS (PARTITION BY series_id ORDER BY fold ROWS UNBOUNDED PRECEDING)""",
        "cv_stability": _with(SUPPLIER, SAMPLES, CV, SOLVE, CV_METRICS)
        + """SELECT series_id, count(*) AS folds, round(avg(rmse), 2) AS rmse_mean, round(stddev_pop(rmse), 2) AS rmse_std,
  round(stddev_pop(rmse) / avg(rmse) * 100, 6) AS cv_percent, stddev_pop(rmse) / avg(rmse) * 100 <= 15 AS stable
FROM metrics GROUP BY series_id""",
        "ridge_final": _with(SUPPLIER, SAMPLES, FINAL, SOLVE)
        + """SELECT series_id, n, round(coef_lag_1, 8) AS coef_lag_1, round(coef_lag_7, 8) AS coef_lag_7,
  round(intercept, 2) AS intercept FROM models""",
        "history_features": _with(
            SUPPLIER, "r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS k FROM series)"
        )
        + """SELECT series_id, max(ts) AS last_date, round(max(value) FILTER (k = 1), 5) AS lag_1, round(max(value) FILTER (k = 7), 5) AS lag_7,
  round(avg(value) FILTER (k <= 7), 5) AS rolling_mean_7, round(stddev_pop(value) FILTER (k <= 7), 5) AS rolling_std_7,
  round(avg(value) FILTER (k <= 14), 5) AS rolling_mean_14, round(stddev_pop(value) FILTER (k <= 14), 5) AS rolling_std_14
FROM r GROUP BY series_id""",
        "forecast_recursive": _with(
            SUPPLIER,
            SAMPLES,
            FINAL,
            SOLVE,
            "r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS k FROM series)",
            "recent AS (SELECT series_id, list(value ORDER BY ts) AS h, max(ts) AS last_date FROM r WHERE k <= 7 GROUP BY 1)",
        ).replace("WITH ", "WITH RECURSIVE ", 1)
        + """, steps AS (
  SELECT series_id, 0 AS step, h, last_date, NULL::DOUBLE AS y FROM recent
  UNION ALL
  SELECT s.series_id, s.step + 1,
    list_append(s.h, m.intercept + m.coef_lag_1 * s.h[-1] + m.coef_lag_7 * s.h[-7]), s.last_date,
    m.intercept + m.coef_lag_1 * s.h[-1] + m.coef_lag_7 * s.h[-7]
  FROM steps s JOIN models m ON s.series_id = m.series_id WHERE s.step < 10)
SELECT series_id, step, last_date + step AS forecast_date, round(y, 2) AS forecast FROM steps WHERE step > 0""",
        "price_file": """
SELECT d.date, p.asset, max(o.o_totalprice) AS price
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) d
CROSS JOIN (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS asset) p
LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE) = d.date AND o.o_orderpriority = p.asset
GROUP BY d.date, p.asset""",
        "interval_file": _with(INTERVALS) + "SELECT seq, asset, start_date, end_date FROM labelled",
        "transaction_file": _with(TRANSACTIONS)
        + """SELECT *, CAST(("TransactionDT" // 3600) % 24 AS INTEGER) AS hour_of_day,
  CAST(("TransactionDT" // 86400 + 1) % 7 AS INTEGER) AS day_of_week FROM transactions""",
        "series_file": _with(SUPPLIER) + "SELECT CAST(series_id AS VARCHAR) AS series_id, ts, value FROM series",
        "alert_file": _with(FLAGS.format(threshold=20.0))
        + "SELECT printf('EVENT|asset=%s|date=%s|rolling_stdev=%.8f', asset, CAST(date AS VARCHAR), rolling_stdev) AS line FROM flagged",
        "prediction_file": _with(SCORED) + "SELECT *, CAST(score >= 0.55 AS INTEGER) AS predicted FROM scored",
        "sorted_file": _with(TRANSACTIONS) + "SELECT * FROM transactions",
        # Smoothed targets as weights: t of label 1 and 1 - t of label 0.
        "sigmoid_fit": _with(
            SCORED,
            """totals AS (SELECT count(*) FILTER (label = 1)::DOUBLE AS np, count(*) FILTER (label = 0)::DOUBLE AS nn FROM scored)""",
            _newton(
                """points AS (
  SELECT score AS x, sum(CASE WHEN label = 1 THEN (np + 1) / (np + 2) ELSE 1 / (nn + 2) END) AS pos,
    sum(CASE WHEN label = 1 THEN 1 - (np + 1) / (np + 2) ELSE 1 - 1 / (nn + 2) END) AS neg
  FROM scored, totals GROUP BY score)""",
                0.0,
            ),
        ).replace("WITH ", "WITH RECURSIVE ", 1)
        + "SELECT x AS score, round(1 / (1 + exp(-(a + b * x))), 4) AS calibrated FROM points, fit",
        "logistic_one_feature": _one_feature_fit()
        + """SELECT is_fraud AS label, v AS "TransactionAmt", round(1 / (1 + exp(-(a + b * (v - m) / s))), 4) AS p
FROM (SELECT is_fraud, min("TransactionAmt") AS v FROM transactions GROUP BY 1), stats, fit""",
        # A probability with one feature follows the feature, up or down, so its ranking is that of the feature.
        "selection_one_feature": _with(
            TRANSACTIONS,
            """long AS (SELECT 'by_V1' AS model, "TransactionID" AS id, "V1" AS x, is_fraud AS y FROM transactions
  UNION ALL SELECT 'by_amount', "TransactionID", "TransactionAmt", is_fraud FROM transactions)""",
            """way AS (SELECT model, sign(avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0)) AS up FROM long WHERE id % 5 <> 0 GROUP BY model)""",
            """per AS (SELECT model, x * up AS s, sum(y) AS pos, count(*) AS n FROM long JOIN way USING (model) WHERE id % 5 = 0 GROUP BY 1, 2)""",
            """curve AS (SELECT model, pos, sum(pos) OVER w / sum(n) OVER w AS prec, sum(pos) OVER (PARTITION BY model) AS every
  FROM per WINDOW w AS (PARTITION BY model ORDER BY s DESC))""",
            """ap AS (SELECT model, round(sum(pos * prec) / max(every), 6) AS pr_auc FROM curve GROUP BY model)""",
        )
        + "SELECT model, pr_auc, pr_auc = max(pr_auc) OVER () AS selected FROM ap",
        "importance_one_feature": _one_feature_fit() + """SELECT 'TransactionAmt' AS feature, round(abs(b), 3) AS importance FROM fit""",
        "bundle_scoring": _one_feature_fit()
        + """SELECT card_type, count(*) AS n, CAST(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS predicted, round(avg(p), 3) AS mean_probability
FROM (SELECT card_type, 1 / (1 + exp(-(a + b * ("TransactionAmt" - m) / s))) AS p FROM transactions, stats, fit) GROUP BY 1""",
        # Labels -1 and 1: the best cut has the largest sum of squares between its sides; probability = logistic(2 * mean).
        "boosting_stump": _with(TRANSACTIONS, BINNED, STUMP.format(weights="1.0::DOUBLE", score="sl * sl / nl + sr * sr / nr", least=5))
        + """SELECT bin, round(1 / (1 + exp(-2 * CASE WHEN bin <= cut THEN sl / nl ELSE sr / nr END)), 6) AS p FROM cells, best""",
        "forest_stump": _with(
            TRANSACTIONS,
            BINNED,
            STUMP.format(weights="CASE WHEN label = 1 THEN sizes.n / (2 * np) ELSE sizes.n / (2 * (sizes.n - np)) END", score="sl * sl / nl + sr * sr / nr", least=1),
        )
        + """SELECT bin, round(CASE WHEN bin <= cut THEN (nl + sl) / (2 * nl) ELSE (nr + sr) / (2 * nr) END, 6) AS p FROM cells, best""",
        "calibrated_stump": _with(
            TRANSACTIONS,
            BINNED,
            STUMP.format(weights="1.0::DOUBLE", score="sl * sl / nl + sr * sr / nr", least=5),
            "goals AS (SELECT (np + 1) / (np + 2) AS hi, 1 / (n - np + 2) AS lo FROM sizes)",
        )
        + """SELECT bin, round(CASE WHEN bin <= cut THEN ((nl + sl) * hi + (nl - sl) * lo) / (2 * nl) ELSE ((nr + sr) * hi + (nr - sr) * lo) / (2 * nr) END, 4) AS p_cal
FROM cells, best, goals""",
        "monitor_flow": _with(
            "daily AS (SELECT CAST(user_id AS VARCHAR) AS asset, CAST(ts AS DATE) AS date, round(avg(value), 4) AS price FROM events GROUP BY ALL)",
            """flagged AS (SELECT asset, date, rolling_stdev FROM (SELECT asset, date, CASE WHEN count(price) OVER w = 3 THEN stddev_pop(price) OVER w END AS rolling_stdev
    FROM daily WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE rolling_stdev < 40)""",
            INTERVALS,
            COUNTS,
            PAIRS,
            FIRST,
            OUTCOMES,
        )
        + named_metrics,
        "forecast_flow": _with(SUPPLIER, SAMPLES, CV, SOLVE, CV_METRICS)
        + """SELECT * FROM (SELECT series_id, count(*) AS n_samples, min(ts) AS first_date, max(ts) AS last_date FROM series GROUP BY series_id)
JOIN (SELECT series_id, count(*) AS folds, round(avg(rmse), 2) AS rmse_mean, round(stddev_pop(rmse), 2) AS rmse_std,
  round(stddev_pop(rmse) / avg(rmse) * 100, 6) AS cv_percent, stddev_pop(rmse) / avg(rmse) * 100 <= 15 AS stable FROM metrics GROUP BY series_id) USING (series_id),
  (SELECT 'lag_1,lag_7' AS features, 2 AS n_features, '1,7' AS lags, false AS with_calendar, 1.0::DOUBLE AS alpha)""",
        "mixed_vectors": _with(
            TRANSACTIONS,
            """filled AS (SELECT * REPLACE (coalesce(merchant_category, (SELECT merchant_category FROM transactions
  WHERE merchant_category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS merchant_category) FROM transactions)""",
        )
        + """SELECT 'V1' AS slot, round(sum(pow(("V1" - m) / s, 2)), 3) AS squares FROM transactions, (SELECT avg("V1") AS m, stddev_pop("V1") AS s FROM transactions)
UNION ALL SELECT 'TransactionAmt', round(sum(pow(("TransactionAmt" - m) / s, 2)), 3) FROM transactions, (SELECT avg("TransactionAmt") AS m, stddev_pop("TransactionAmt") AS s FROM transactions)
UNION ALL SELECT 'card_type=' || card_type, round(count(*)::DOUBLE, 3) FROM filled GROUP BY card_type
UNION ALL SELECT 'merchant_category=' || merchant_category, round(count(*)::DOUBLE, 3) FROM filled GROUP BY merchant_category""",
        "labelled_file": _with(TRANSACTIONS) + "SELECT * EXCLUDE (merchant_category) FROM transactions",
        "scoring_file": _with(TRANSACTIONS)
        + """SELECT * EXCLUDE (is_fraud, "TransactionID"), CAST(("TransactionDT" // 3600) % 24 AS INTEGER) AS hour_of_day,
  CAST(("TransactionDT" // 86400 + 1) % 7 AS INTEGER) AS day_of_week FROM transactions""",
        "interval_lines": _with(INTERVALS)
        + "SELECT row_number() OVER (ORDER BY asset, start_date, end_date) - 1 AS seq, asset, start_date, end_date FROM labelled",
        "sorted_file_order": _with(TRANSACTIONS) + "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS breaks FROM transactions",
        "alert_file_order": _with(FLAGS.format(threshold=20.0)) + "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS breaks FROM flagged",
        "series_file_order": _with(SUPPLIER) + "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS breaks FROM series",
    }
