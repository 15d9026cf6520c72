"""Line dedup across documents, with DataFrame functions only.

Lines become rows (hash of the key, document, position). They are range-partitioned by
hash and sorted within each range by document, newest first, then position; one streaming
pass over the sorted rows meets the document that keeps a line first and marks the lines of
all later ones. What returns is a compressed bitmap of the kept lines for each document
that loses any. The few most common keys, which would make ranges uneven, are counted
ahead and take no part in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finops_spark.llm.common import ascii_lower, store
from finops_spark.llm.hot import common_keys

#: White space that is stripped from a line's ends: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Lines in one word of a bitmap.
WORD = 64


def lines_of(text: str = "text"):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def key_rows(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, doc_id, pos) for every line whose key has ``least_chars`` code points; h1 and h2 are independent hashes."""
    lines = docs.where("doc_id is not null").select("doc_id", F.posexplode(lines_of()).alias("pos", "line"))
    keys = lines.select("doc_id", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.char_length("key") >= least_chars)
    keys = keys.withColumn("key", ascii_lower(F.col("key")))
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc_id", "pos")


def dropped_lines(rows: DataFrame, least_docs: int) -> DataFrame:
    """(doc_id, pos) of the lines to drop, from the rows of ``key_rows``."""
    common = common_keys(rows, "h1")
    ahead = rows.join(F.broadcast(common), "h1", "left_semi")
    totals = ahead.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("last"))
    totals = store(totals.where(F.col("docs") >= least_docs), "common-line-totals")  # one row for each common key
    from_common = rows.join(F.broadcast(totals), ["h1", "h2"]).where("doc_id < last").select("doc_id", "pos")

    rest = rows.join(F.broadcast(common), "h1", "left_anti").repartitionByRange("h1").sortWithinPartitions("h1", "h2", F.desc("doc_id"), "pos")
    same = Window.partitionBy("h1", "h2")
    ranked = rest.withColumn("nth", F.dense_rank().over(same.orderBy(F.desc("doc_id"))))
    ranked = ranked.withColumn("docs", F.max("nth").over(same))
    from_rest = ranked.where((F.col("nth") > 1) & (F.col("docs") >= least_docs)).select("doc_id", "pos")
    return from_common.unionByName(from_rest)


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """One row for each document that loses lines: doc_id, keep.

    ``keep`` is a sparse bitmap, sorted (word, bits) pairs: bit b of word w stands for line
    64 w + b and is 1 if it stays; words that are not listed keep all their lines."""
    rows = store(key_rows(docs, least_chars), "line-keys")
    drops = dropped_lines(rows, least_docs)
    one = F.expr(f"shiftleft(1L, pos % {WORD})")
    words = drops.groupBy("doc_id", F.expr(f"pos div {WORD}").cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(one)).alias("bits"))
    return words.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """All rows and columns of ``docs`` with ``kept_text``, n_lines (before) and n_dropped added.

    A line's key is the line without ASCII white space at both ends and with A-Z in lower
    case. Keys of at least ``least_chars`` code points that occur in at least ``least_docs``
    documents lose their lines in all but the largest doc_id that holds them; there, and
    for all other keys, lines stay. A NULL or empty text is one empty line; a document
    may become empty but stays a row. Rows without a doc_id lose nothing and count for
    nothing. Repeated rows of a document count once and are treated alike. Columns of the
    three names are replaced.
    """
    bitmaps = keep_bitmaps(docs, least_chars, least_docs)
    plain = docs.drop("kept_text", "n_lines", "n_dropped")
    joined = plain.join(bitmaps.select(F.col("doc_id").alias("_doc"), F.col("keep").alias("_keep")), F.col("doc_id") == F.col("_doc"), "left")
    joined = joined.withColumn("_lines", lines_of()).withColumn("n_lines", F.size("_lines").cast("bigint"))
    listed = F.map_from_entries("_keep")
    every = F.sequence(F.lit(0), F.expr(f"cast((n_lines - 1) div {WORD} as int)"))
    joined = joined.withColumn("_words", F.when(F.col("_keep").isNotNull(), F.transform(every, lambda w: F.coalesce(F.try_element_at(listed, w), F.lit(-1).cast("bigint")))))
    kept = F.filter("_lines", lambda line, i: (F.getbit(F.element_at("_words", (F.floor(i / WORD) + 1).cast("int")), i % WORD) == 1))
    joined = joined.withColumn("_kept", F.when(F.col("_keep").isNotNull(), kept))
    return joined.withColumns(
        {
            "n_dropped": F.when(F.col("_keep").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("n_lines") - F.size("_kept")),
            "kept_text": F.when(F.col("_keep").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join("_kept", "\n")),
        }
    ).select(*plain.columns, "kept_text", "n_lines", "n_dropped")


SQL = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, coalesce(keyed.doc_id < shared.last, false) AS dropped FROM keyed LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
