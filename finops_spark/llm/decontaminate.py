"""Benchmark decontamination, with DataFrame functions only.

The n-grams of the benchmark are hashed into a bit table that travels to every task.
Documents are scanned once: each window of words is hashed and looked up, and only the
windows that hit leave the scan, with their words, to be verified against the n-grams
themselves. Spans of verified hits are then removed, or whole documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finops_spark.llm.common import EMPTY_SHA256, ascii_lower, store

#: Java pattern of a word in lower-cased text: digits, letters a-z and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words in a text as written.
OTHER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Bits of the table for each n-gram, and the largest table (8 MB). Beyond it more windows
#: have to be verified; none is lost.
BITS_PER_GRAM, MOST_BITS = 64, 26
#: Up to so many distinct n-grams (some 100 MB) the verifying join may broadcast them; beyond, it shuffles.
BROADCAST_GRAMS = 1_000_000


def words_of(text: Column) -> Column:
    """The words of a text; none for NULL."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _starts(n: Column, k: int) -> Column:
    return F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))


def item_grams(items: DataFrame, n: int) -> DataFrame:
    """(item, k, gram): every window of ``n`` words of an item, or all its words if they are fewer."""
    words = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    words = words.withColumn("k", F.least(F.size("w"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)
    grams = F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))
    return words.select("item", "k", F.explode(grams).alias("gram")).distinct()


def _hash(words: Column) -> Column:
    return F.xxhash64(F.transform(words, lambda w: F.xxhash64(w)))


def bit_table(grams: DataFrame, bits: int) -> DataFrame:
    """One row with an array of 2^(bits-6) words: the bit of every n-gram's hash is set."""
    hashes = grams.select(_hash(F.split("gram", " ")).alias("h"))
    used = hashes.groupBy(F.expr(f"shiftrightunsigned(h, {64 - (bits - 6)})").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63L as int))")).alias("bits"))
    every = grams.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("word"))
    full = every.join(used, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda s: s["bits"]).alias("table"))


def _windows_in_table(k: int, shift: int) -> Column:
    """(start, k, gram) of the windows of k words whose bit is set; from columns w (words), h (their hashes) and table."""
    hashes = F.transform(_starts(F.size("h"), k), lambda i: F.xxhash64(F.slice("h", i, k)))

    def start_if_set(h: Column, i: Column) -> Column:
        word = F.element_at("table", (F.shiftrightunsigned(h, shift) + 1).cast("int"))
        return F.when(F.getbit(word, h.bitwiseAND(63).cast("int")) == 1, i + 1).otherwise(0)

    starts = F.filter(F.transform(hashes, start_if_set), lambda s: s > 0)
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(k).alias("k"), F.array_join(F.slice("w", s, k), " ").alias("gram")))


def scan(docs: DataFrame, grams: DataFrame, sizes: list[int], n_grams: int) -> DataFrame:
    """(doc_id, n_words, windows): for every row the windows (start, k, gram) whose hash is in the table."""
    bits = min(MOST_BITS, max(16, (max(1, n_grams) * BITS_PER_GRAM).bit_length()))
    table = store(bit_table(grams, bits), "gram-bits").scalar()
    worded = docs.select("doc_id", words_of(F.col("text")).alias("w")).withColumn("table", table)
    worded = worded.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    found = [_windows_in_table(k, 64 - (bits - 6)) for k in sizes]
    none = F.array().cast("array<struct<start:int,k:int,gram:string>>")
    return worded.select("doc_id", F.size("w").cast("bigint").alias("n_words"), (F.concat(*found) if found else none).alias("windows"))


def find_hits(docs: DataFrame, items: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per row: doc_id, n_words), (verified hits: doc_id, start, k, gram), (item, k, gram)."""
    grams = store(item_grams(items, n), "item-grams")
    distinct = grams.select("k", "gram").distinct()
    sizes = {r.k: r["count"] for r in distinct.groupBy("k").count().collect()}  # at most n rows
    scanned = store(scan(docs, distinct, sorted(sizes), sum(sizes.values())), "gram-windows")
    windows = scanned.select("doc_id", F.inline("windows"))
    small = sum(sizes.values()) <= BROADCAST_GRAMS
    hits = windows.join(F.broadcast(distinct) if small else distinct, ["k", "gram"], "left_semi")
    return scanned.select("doc_id", "n_words"), store(hits, "gram-hits"), grams


def hit_report(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word inside any occurrence of an item's window is hit; items whose windows
    occur are listed by id. A NULL or empty text has no words; an item without words has
    no window, one without an id makes hits but is not listed. Repeated rows of a document
    are reported alike; rows without a doc_id are reported as clean. Other columns are
    ignored.
    """
    rows, hits, grams = find_hits(docs, items, n)
    covered = F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.expr("start + k - 1"))))))
    words = hits.groupBy("doc_id").agg(covered.cast("bigint").alias("n_hit"))
    by_gram = hits.select("doc_id", "k", "gram").distinct().join(grams, ["k", "gram"])
    listed = by_gram.groupBy("doc_id").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = rows.join(words, "doc_id", "left").join(listed, "doc_id", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("bigint").alias("n_items"),
        F.when(F.col("items").isNull(), EMPTY_SHA256).otherwise(F.sha2(F.array_join("items", ","), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def remove_documents(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Rows of ``docs`` without a hit; rows without a doc_id stay."""
    _, hits, _ = find_hits(docs, items, n)
    return docs.join(hits.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """All rows of ``docs``; in ``text`` the hit words of each document are cut out together
    with the other characters behind them."""
    _, hits, _ = find_hits(docs, items, n)
    spans = hits.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.expr("start + k - 1"))))).alias("_hit"))
    joined = docs.join(spans, "doc_id", "left")
    # each word of the text as written, together with the other characters up to the next one
    pieces = F.regexp_extract_all("text", F.lit(f"[^{OTHER}]+[{OTHER}]*"), F.lit(0))
    kept = F.filter(pieces, lambda p, i: ~F.array_contains("_hit", i + 1))
    ahead = F.regexp_extract("text", f"^[{OTHER}]*", 0)
    text = F.when(F.col("_hit").isNull(), F.col("text")).otherwise(F.concat(ahead, F.array_join(kept, "")))
    return joined.withColumn("text", text).select(docs.columns)


SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), gram AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)
), size AS (
  SELECT DISTINCT k FROM gram
), win AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, size WHERE len(w) >= k)
), hit AS (
  SELECT doc_id, k, i, item_id FROM win JOIN gram USING (k, g)
), word AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
