"""Spelling variants of corpus words by asymmetric q-chunks.

Of two words one edit apart, the shorter one (or the smaller of equally long ones) is cut
into two disjoint chunks, its halves. One edit falls into one half; the other is found
unchanged in the longer word, at its own place if it is the first and moved by the difference
of the lengths, so by one place at most, if it is the second. The longer word contributes
its positional grams of the lengths and places a chunk can have within this shift. Chunk and
gram meet by an equality join and the pair is verified with the edit distance.

A chunk that too many words share is not joined: the rest of the word, which holds the edit,
is cut into halves in turn, and the chunk grows by one of these. The rest is at most one
character in the end, and words that agree in all else are truly one edit apart, so no group
of words is ever paired in vain, and none is cut off.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finops_spark.llm.common import store

#: Runs of these letters are words (fixed value of the contract).
LETTERS = r"[A-Za-zÀ-ÿ]"
#: A run whose hash this number divides loses a character: the noise of the contract.
NOISE = 31
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: A chunk is joined while its words with it as chunk times those with it as gram are at most this many.
MOST_PAIRS = 4_096
#: Characters of the words that a task counts before it hands its counts on.
COUNTED_CHARS = 16_000_000
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def noisy(doc_id: int | None, run: str) -> str:
    """The lower-cased run, without one character where the contract's hash says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least ``least_length`` characters that occur ``least_count`` times or more in whole texts.

    Counts are summed within a task, up to COUNTED_CHARS characters of words, then by Spark."""
    runs = re.compile(f"{LETTERS}{{{max(1, least_length)},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            words = list(found.items())
            for at in range(0, len(words), 20_000):
                part = words[at : at + 20_000]
                yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in part], pa.string()), "n": pa.array([n for _, n in part], pa.int64())})
            found.clear()

        held = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                in_text = Counter(runs.findall((text.as_py() or "").translate(_ASCII_LOWER)))
                for run, n in in_text.items():
                    word = noisy(doc, run)
                    if len(word) >= least_length:
                        held += 0 if word in found else len(word) + 60
                        found[word] += n
                if held > COUNTED_CHARS:
                    yield from told()
                    held = 0
        yield from told()

    rows = docs.select(F.col("doc_id").cast("bigint"), "text").where("text is not null")
    return rows.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _signed(words: DataFrame) -> DataFrame:
    """Add the key of every chunk (or gram): the ``before`` first and ``after`` last characters of the word.

    ``of`` is the length of the word that is cut: the word's own for chunks, for grams that or one less."""
    kept = [F.col("word").substr(F.lit(1), F.col("before")), F.col("word").substr(F.col("len") - F.col("after") + 1, F.col("after"))]
    return words.withColumn("key", F.xxhash64("of", "before", "after", *kept))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice, with either half of the rest kept too. The ends are columns, so no plan grows with the halvings."""
    rest = F.col("of") - F.col("before") - F.col("after")
    first = F.floor(rest / 2).cast("int")
    halves = F.array(
        F.struct((F.col("before") + first).alias("before"), F.col("after").alias("after")), F.struct(F.col("before").alias("before"), (F.col("after") + rest - first).alias("after"))
    )
    return rows.select("word", "len", "of", F.explode(halves).alias("_half")).select("word", "len", "of", "_half.before", "_half.after")


def near_pairs(words: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(u, v): every pair of distinct words one inserted, deleted or replaced character apart, once."""
    sized = words.select("word", F.char_length("word").alias("len")).where("len > 0")
    whole = [F.lit(0).alias("before"), F.lit(0).alias("after")]
    chunks = sized.select("word", "len", F.col("len").alias("of"), *whole)
    grams = sized.select("word", "len", F.explode(F.array(F.col("len"), F.col("len") - 1)).alias("of"), *whole).where("of > 0")
    found = []
    while True:
        chunks, grams = store(_signed(_halved(chunks)), "chunks"), store(_signed(_halved(grams)), "grams")
        sizes = chunks.select("key", F.lit(1).alias("c"), F.lit(0).alias("g")).unionByName(grams.select("key", F.lit(0).alias("c"), F.lit(1).alias("g")))
        sizes = sizes.groupBy("key").agg(F.sum("c").alias("c"), F.sum("g").alias("g")).where("c > 0 and g > 0")
        # what is left to cut: at most one character once the longest word has been halved often enough
        hot = store(sizes.where(F.col("c") * F.col("g") > most_pairs).select("key").join(chunks.where("of - before - after > 1").select("key").distinct(), "key", "left_semi"), "hot-chunks")
        any_hot = not hot.isEmpty()
        cold = (lambda side: side.join(hot, "key", "left_anti")) if any_hot else (lambda side: side)
        met = cold(chunks).select("key", F.col("word").alias("u"), F.col("of").alias("a")).join(cold(grams).select("key", F.col("word").alias("v"), "of", F.col("len").alias("b")), "key")
        met = met.where((F.col("a") == F.col("of")) & ((F.col("a") < F.col("b")) | (F.col("u") < F.col("v"))))
        found.append(store(met.where(F.levenshtein("u", "v", 1) == 1).select("u", "v").distinct(), "near-words"))
        if not any_hot:
            break
        chunks, grams = (side.join(hot, "key", "left_semi").drop("key") for side in (chunks, grams))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct() if len(found) > 1 else pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every ``word`` of (word, form): the last form reached. Each step at least doubles what a
    word has passed over; counts grow along forms, so there is no circle and few steps."""
    now = store(forms.select("word", F.col("form").alias("root")), "form-links")
    while True:
        further = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        if now.join(further, F.col("root") == F.col("_at"), "left_semi").isEmpty():
            return now
        now = store(now.join(further, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root")), "form-links")


def group_variants(counts: DataFrame, ratio: int = RATIO, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``counts`` (distinct word, n)."""
    counts = store(counts.select("word", "n"), "word-counts")
    pairs = near_pairs(counts, most_pairs)
    both = pairs.select(F.col("u").alias("word"), F.col("v").alias("near")).unionByName(pairs.select(F.col("v").alias("word"), F.col("u").alias("near")))
    with_n = both.join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = with_n.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = counts.join(best, "word", "left").withColumn("_n", -F.col("best.less"))
    formed = F.col("_n") >= F.lit(ratio) * F.col("n")
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, F.col("_n")).alias("form_n"))
    judged = store(judged, "word-forms")
    last = roots(judged.where("form is not null"))
    out = judged.join(last.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Words of ``docs`` (doc_id, text; other columns are not read) with their forms; see ``group_variants``.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z only; a run whose hash with
    its doc_id NOISE divides loses one character. A NULL or empty text has no words, an empty table
    gives no rows. A NULL doc_id is written as nothing before the colon. Repeated rows count each
    time; texts of any length are read whole. Of near words that are equally common the smallest
    in code-point order is the form."""
    return group_variants(word_counts(docs))


SQL = r"""
WITH RECURSIVE bytes AS (SELECT i AS c0 FROM range(0, 256) t(i)
), step AS (
  SELECT c0, CAST(c0 AS UBIGINT) AS c, 0 AS k FROM bytes
  UNION ALL SELECT c0, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY c0) AS t FROM step WHERE k = 8
), run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS r FROM documents
), many AS (SELECT d, r, count(*) AS n FROM run WHERE length(r) >= 7 GROUP BY d, r
), hashed AS (
  SELECT r, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(d || ':' || r)), '..'), lambda x: CAST('0x' || x AS UBIGINT))),
      lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS h FROM many, crc
), word AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, n FROM hashed
), counts AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM word WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, length(word) AS len, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM counts)
), near AS (
  SELECT x.word AS u, y.word AS v FROM cut x JOIN cut y ON x.len = y.len AND x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT word, a || b FROM cut WHERE a || b IN (SELECT word FROM counts)
  UNION SELECT a || b, word FROM cut WHERE a || b IN (SELECT word FROM counts)
), best AS (
  SELECT u, count(*) AS n_near, first(v ORDER BY c.n DESC, encode(v)) AS v, max(c.n) AS vn FROM near JOIN counts c ON c.word = v GROUP BY u
), judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN vn >= 10 * n THEN v END AS form, CASE WHEN vn >= 10 * n THEN vn END AS form_n FROM counts LEFT JOIN best ON u = word
), chain AS (
  SELECT word, word AS tip, 0 AS k FROM judged
  UNION ALL SELECT chain.word, form, k + 1 FROM chain JOIN judged ON judged.word = chain.tip WHERE form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN (SELECT word, last(tip ORDER BY k) AS root FROM chain GROUP BY word) USING (word)
"""
