"""Quality rules with robust multivariate outliers, with DataFrame functions only.

Each document has four shares that junk pushes up, or a word length that is off. Within
each cell (language and source) their centre and spread are estimated by minimum
covariance determinant: from each of four deterministic starts, concentration steps take
the three quarters of the documents that lie nearest by Mahalanobis distance and estimate
again from these, until the determinant stops falling. Of the four ends a cell takes the
one of least determinant. A document beyond the limit is rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finops_spark.llm.common import SPACED_WORD, store

WINDOW = 8
#: Transformed statistics, and the deviation each has at least, for cells whose own is (near) 0, so that
#: one in which a share is 0 throughout does not reject the first document that has a little of it.
#: Alone, half as long words again, or from 0, 0.7 % symbols, 18 % duplicate lines or 18 % repeated words reach LIMIT there.
FEATURES = {"length": 0.1, "symbols": 0.02, "lines": 0.1, "repeats": 0.1}
#: Share of the documents that the estimate rests on.
CORE = 0.75
#: Squared distance beyond which a document is rejected: chi-square of 4 degrees at 0.999.
LIMIT = 18.467
#: Cells of fewer documents are judged with their language, and those with all documents.
LEAST_DOCUMENTS = 50
#: Scatter matrices that the steps start from, all about the medians: squared median deviations, covariances of
#: two bounded scores of the standardised values, and covariances of their spatial signs.
STARTS = ("medians", "tanh", "clipped", "signs")
#: Steps go on in a cell while they lower the logarithm of its determinant by more than this.
FALL = 1e-3
#: Distances and features are counted in bins of this width to find medians and quantiles.
_BIN = 1 / 64
_FARTHEST = 1e6


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every row.

    n_lines counts lines with a word; n_dup_lines those equal to an earlier one."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("text")).select(
        "doc_id",
        "lang",
        "source",
        F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0)).alias("w"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    hashed = base.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    starts = F.when(F.size("h") >= WINDOW, F.sequence(F.lit(1), F.size("h") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    hashed = hashed.withColumn("win", F.transform(starts, lambda i: F.xxhash64(F.slice("h", i, WINDOW)))).drop("h")
    return hashed.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("win")) == F.size("win"), 0).otherwise(_covered("win")).cast("bigint")).drop("win")


def _covered(windows: str) -> Column:
    """Words under windows whose hash occurs twice or more in the array: neighbours in the
    sorted order of (hash, start) tell which; their starts, sorted again, how much they cover."""
    at = F.sort_array(F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.aggregate(
        F.array(at),
        F.lit(0),
        lambda none, s: F.aggregate(
            F.sort_array(
                F.filter(
                    F.transform(
                        s,
                        lambda x, i: F.when(
                            F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)), x["i"]
                        ).otherwise(-1),
                    ),
                    lambda i: i >= 0,
                )
            ),
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(WINDOW))).alias("n"), i.alias("last")),
            lambda a: a["n"],
        ),
    )


def features() -> dict[str, Column]:
    share = lambda a, b: F.sqrt(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)))
    return {
        "length": F.coalesce(F.log(F.try_divide(F.col("word_chars").cast("double"), F.col("n_words"))), F.lit(0.0)),
        "symbols": share("n_symbols", "word_chars"),
        "lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
    }


def with_cells(stats: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Add ``cell``: language and source, or language, or all, whichever is the first with ``least`` documents;
    and ``feeds``, the cells whose estimates the row enters: all that some row is judged with and that hold it."""
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    counts = stats.where(~F.col("base_failed")).groupBy(lang.alias("_lang"), source.alias("_source")).count()
    counts = counts.withColumn("_in_lang", F.sum("count").over(Window.partitionBy("_lang")))
    named = F.when(F.col("count") >= least, F.to_json(F.array("_lang", "_source"))).when(F.col("_in_lang") >= least, F.to_json(F.array("_lang"))).otherwise("[]")
    cells = store(counts.select("_lang", "_source", named.alias("cell")), "quality-cells")
    used = cells.select(F.col("cell").alias("_used")).distinct()
    above = F.explode(F.array_distinct(F.array("cell", F.to_json(F.array("_lang")), F.lit("[]")))).alias("_used")
    feeds = cells.select("_lang", "_source", "cell", above).join(used, "_used", "left_semi")
    feeds = store(feeds.groupBy("_lang", "_source", "cell").agg(F.collect_set("_used").alias("feeds")), "quality-feeds")
    joined = stats.join(feeds, (lang == F.col("_lang")) & (source == F.col("_source")), "left")
    return joined.withColumn("cell", F.coalesce("cell", F.lit("[]"))).drop("_lang", "_source")


def _quantile(binned: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """The least ``bin`` with ``share`` of the rows of its keys at or below it, from counts ``n`` by bin."""
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    reached = binned.withColumn("_sum", F.sum("n").over(up)).withColumn("_all", F.sum("n").over(every))
    return reached.where(F.col("_sum") >= F.lit(share) * F.col("_all")).groupBy(*keys).agg(F.min("bin").alias(name))


def _medians(long: DataFrame, name: str) -> DataFrame:
    counts = store(long.groupBy("cell", "f", "bin").agg(F.count(F.lit(1)).alias("n")), "quality-bins")
    return _quantile(counts, ["cell", "f"], 0.5, name)


def _bin(x: Column) -> Column:
    return F.round(x / _BIN).cast("bigint")


def _pairs() -> list[tuple[str, str]]:
    names = list(FEATURES)
    return [(f, g) for i, f in enumerate(names) for g in names[: i + 1]]


def start_estimates(core: DataFrame) -> DataFrame:
    """cell, start, m_<f>, c_<f>_<g>: medians and the scatter matrix of each of STARTS."""
    names = list(FEATURES)
    long = core.select("cell", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("x")) for f in names])).alias("s")).select("cell", "s.f", "s.x")
    middle = store(_medians(long.withColumn("bin", _bin(F.col("x"))), "middle"), "quality-medians")
    spread = _medians(long.join(middle, ["cell", "f"]).withColumn("bin", _bin(F.abs(F.col("x") - F.col("middle") * _BIN))), "spread")
    both = middle.join(spread, ["cell", "f"]).groupBy("cell")
    pick = lambda f, x: F.max(F.when(F.col("f") == f, x))
    least = {f: F.greatest(1.4826 * F.col("spread") * _BIN, F.lit(x)) for f, x in FEATURES.items()}
    middles = [pick(f, F.col("middle") * _BIN).alias(f"m_{f}") for f in names]
    base = store(both.agg(*middles, *[pick(f, least[f]).alias(f"s_{f}") for f in names]), "quality-base")
    z = core.join(base, "cell").select("cell", *[((F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}")).alias(f) for f in names])
    length = sum((F.pow(F.col(f), 2) for f in names), F.lit(0.0))
    bounded = {"tanh": F.tanh, "clipped": lambda x: F.greatest(F.least(x, F.lit(2.0)), F.lit(-2.0))}
    scatter = [F.covar_pop(h(F.col(f)), h(F.col(g))).alias(f"{kind}_{f}_{g}") for kind, h in bounded.items() for f, g in _pairs()]
    scatter += [F.avg(F.coalesce(F.try_divide(F.col(f) * F.col(g), length), F.lit(0.0))).alias(f"signs_{f}_{g}") for f, g in _pairs()]
    wide = z.groupBy("cell").agg(*scatter).join(base, "cell")
    unit = lambda kind, f, g: F.lit(float(f == g)) if kind == "medians" else F.col(f"{kind}_{f}_{g}")
    starts = [F.struct(F.lit(kind).alias("start"), *[(unit(kind, f, g) * F.col(f"s_{f}") * F.col(f"s_{g}")).alias(f"c_{f}_{g}") for f, g in _pairs()]) for kind in STARTS]
    return wide.select("cell", *[f"m_{f}" for f in names], F.inline(F.array(*starts)))


def moments(core: DataFrame, factor: float) -> DataFrame:
    """cell, start, m_<f>, c_<f>_<g>: mean and covariance, the latter times ``factor``."""
    cells = [F.avg(f).alias(f"m_{f}") for f in FEATURES]
    return core.groupBy("cell", "start").agg(*cells, *[(F.covar_pop(f, g) * factor).alias(f"c_{f}_{g}") for f, g in _pairs()])


def factors(estimates: DataFrame) -> DataFrame:
    """Add the Cholesky factor l_<f>_<g> of the covariance in which no pivot is below the least deviation, and ``log_det``."""
    names = list(FEATURES)
    out = estimates
    for f, g in _pairs():
        rest = F.col(f"c_{f}_{g}")
        for h in names[: names.index(g)]:
            rest = rest - F.col(f"l_{f}_{h}") * F.col(f"l_{g}_{h}")
        value = F.sqrt(F.greatest(rest, F.lit(FEATURES[f] ** 2))) if f == g else rest / F.col(f"l_{g}_{g}")
        out = out.withColumn(f"l_{f}_{g}", value)
    diagonal = sum((2 * F.log(F.col(f"l_{f}_{f}")) for f in names), F.lit(0.0))
    return out.select("cell", "start", *[f"m_{f}" for f in names], *[f"l_{f}_{g}" for f, g in _pairs()], diagonal.alias("log_det"))


def distances(rows: DataFrame, fitted: DataFrame, *also: str) -> DataFrame:
    """Rows with the columns ``also`` of their cell's estimates and ``d2``, the squared Mahalanobis distance
    from the centre; NULL without an estimate."""
    names = list(FEATURES)
    out = rows.join(fitted, "cell", "left")
    total = F.lit(0.0)
    for i, f in enumerate(names):
        rest = F.col(f) - F.col(f"m_{f}")
        for g in names[:i]:
            rest = rest - F.col(f"l_{f}_{g}") * F.col(f"_z_{g}")
        out = out.withColumn(f"_z_{f}", rest / F.col(f"l_{f}_{f}"))
        total = total + F.pow(F.col(f"_z_{f}"), 2)
    return out.withColumn("d2", F.least(total, F.lit(_FARTHEST))).select(*rows.columns, *also, "d2")


def core_factor(share: float) -> float:
    """How much the covariance of the nearest ``share`` of normal data in four dimensions has to grow."""
    below = lambda x: 1 - math.exp(-x / 2) * (1 + x / 2)  # noqa: E731  chi-square, 4 degrees
    low, high = 0.0, 100.0
    while high - low > 1e-12:
        low, high = ((low + high) / 2, high) if below((low + high) / 2) < share else (low, (low + high) / 2)
    return share / (1 - math.exp(-low / 2) * (1 + low / 2 + low * low / 8))


def fit_cells(rows: DataFrame) -> DataFrame:
    """cell, start, centre, factor and log_det of every cell over ``rows`` (cell and features): from all starts at
    once, concentration steps until no determinant falls; the least of a cell's determinants wins.

    A step reads only the cells and starts whose determinant fell in the step before."""
    keys = ["cell", "start"]
    best = store(factors(start_estimates(rows)).withColumn("log_det", F.lit(math.inf)), "quality-fit")
    fell = best
    while not fell.isEmpty():
        near = distances(rows, fell, "start").where("start is not null").withColumn("bin", _bin(F.log1p("d2")))
        counts = store(near.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")), "quality-bins")
        cut = _quantile(counts, keys, CORE, "cut")
        fit = factors(moments(near.join(cut, keys).where("bin <= cut"), core_factor(CORE)))
        before = best.select(*keys, F.col("log_det").alias("_before"))
        fell = store(fit.join(before, keys).where(F.col("log_det") < F.col("_before") - FALL).drop("_before"), "quality-fell")
        best = store(best.join(fell, keys, "left_anti").unionByName(fell), "quality-fit")
    rest = [c for c in best.columns if c not in ("cell", "start", "log_det")]
    order = F.array_position(F.array(*map(F.lit, STARTS)), F.col("start")).alias("_order")  # ties: the earlier start
    least = best.groupBy("cell").agg(F.min(F.struct("log_det", order, "start", *rest)).alias("fit"))
    return store(least.select("cell", "fit.*").drop("_order"), "quality-least")


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. Such documents
    are not kept and do not enter the estimates. Of the others those are kept whose squared
    distance is at most LIMIT. NULL texts have no words; NULL lang or source are a value of
    their own; repeated rows and rows without a doc_id are judged like others. ``distance``
    is the squared distance, NULL for failed rows."""
    stats = statistics(docs).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    stats = store(stats.withColumns(features()), "quality-statistics")
    celled = store(with_cells(stats), "quality-rows")
    fitted = fit_cells(celled.where(~F.col("base_failed")).select(F.explode("feeds").alias("cell"), *FEATURES))
    judged = distances(celled.drop("feeds"), fitted)
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= LIMIT, F.lit(True))).alias("kept"),
        distance.alias("distance"),
    )
