"""Removal of repeated word sequences by level-wise doubling.

A sequence of 20 words can only be repeated if the parts of 5 words in it are, and those of
10. So levels go 5, 10, 20: at each the windows that stand alone are left, and only those
repeated are looked at in twice the length. At the lower levels a window of 20 is
represented by the least hash of the parts it holds; equal windows have equal least hashes,
and neighbouring windows mostly share the part that has it, so a run of windows is one row.
(Equal windows of one document are never in one run: the part stands at the same place in each.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finops_spark.llm.common import shuffles_freed, store
from finops_spark.llm.hot import with_first

#: Words of a window; the lower levels are its half and its quarter.
LENGTH = 20
#: Words of documents whose candidate windows are hashed in one array.
WORDS_AT_ONCE = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_EVERY = 2**31 - 1


def words_of(text: str | None) -> list[bytes]:
    """Words between space and U+0009 to U+000D, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, k: int, odd: np.uint64 = _ODD) -> np.ndarray:
    """A 64-bit hash of every k consecutive entries."""
    n = len(hashes) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ hashes[i : i + n]) * odd
        h ^= h >> np.uint64(32)
    return h


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Where the least of every ``width`` consecutive entries stands, the last one if several are; by doubling spans."""
    at = np.arange(len(h))
    lower = lambda left, right: np.where(h[right] <= h[left], right, left)
    span = 1
    while 2 * span <= width:
        at, span = lower(at[:-span], at[span:]), 2 * span
    return lower(at[: len(at) - (width - span)], at[width - span :]) if width > span else at


def runs_of(values: np.ndarray) -> np.ndarray:
    """Positions where a run of equal entries starts."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]])


def by_document(table: DataFrame) -> DataFrame:
    """A hint for ``table`` (a row of ids and ranges for each document): its join goes by doc_id at every size,
    with ``table`` as the hashed side, so that texts are not sorted and a hot doc_id may be split."""
    return table.hint("shuffle_hash")


def quarter_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, two hashes of the whole word sequence (d1, d2), and runs of windows by their
    least quarter hash: ``least`` and the first window ``lo`` of each run."""
    quarter = LENGTH // 4
    schema = "doc_id bigint, n_words int, d1 bigint, d2 bigint, least array<bigint>, lo array<int>"
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["doc_id", "n_words", "d1", "d2", "least", "lo"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                whole = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64)
                least = lo = np.zeros(0, np.int64)
                if len(words) >= LENGTH:
                    parts = window_hashes(word_hashes(words), quarter)
                    at = least_of(parts, LENGTH - quarter + 1)
                    lo = runs_of(at)
                    least = parts[at[lo]].view(np.int64)
                for column, value in zip(columns, (doc, len(words), int(whole[0]), int(whole[1]), least, lo.astype(np.int32)), strict=True):
                    column.append(value)
                if len(columns[0]) == 1_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
                    columns = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(read, schema)


def copies(runs: DataFrame) -> DataFrame:
    """doc_id of documents of LENGTH words or more whose whole word sequence has a smaller doc_id, too: nothing of them stays."""
    whole = runs.where(F.col("n_words") >= LENGTH).select("doc_id", "d1", "d2")
    return with_first(whole, "d1", ["d2"], F.col("doc_id")).where("doc_id > _first").select("doc_id").distinct()


def merged(ranges: DataFrame) -> DataFrame:
    """(doc_id, ranges): the (lo, hi) of each document, both inside, sorted and joined where they touch."""
    order = Window.partitionBy("doc_id").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = ranges.withColumn("new", F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0))
    grouped = cut.withColumn("nth", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = grouped.groupBy("doc_id", "nth").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))


def half_runs(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Runs of candidate windows by their least half hash: (least, doc_id, lo, h, check), where h and check
    hold two hashes of each window of the run at full length."""
    half = LENGTH // 2
    schema = "least bigint, doc_id bigint, lo int, h array<bigint>, check array<int>"
    names = ["least", "doc_id", "lo", "h", "check"]

    def hashed(pieces: list[np.ndarray], owners: list[tuple[int, int]]) -> pa.RecordBatch:
        """All ranges in one array: ``pieces`` are their word hashes, ``owners`` their documents and first words."""
        sizes = np.fromiter((len(p) - LENGTH + 1 for p in pieces), np.int64, len(pieces))
        flat = np.concatenate(pieces)
        doc, lo = np.array(owners, np.int64).T
        nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # windows that cross the end of a piece are left out here; the others lie within theirs
        at = nth + np.repeat(np.cumsum(sizes + LENGTH - 1) - (sizes + LENGTH - 1), sizes)
        parts = window_hashes(flat, half)
        place = least_of(parts, LENGTH - half + 1)[at]
        starts = runs_of(place)
        offsets = pa.array(np.r_[starts, len(place)], pa.int32())
        full = window_hashes(flat, LENGTH).view(np.int64)[at]
        check = window_hashes(flat, LENGTH, _OTHER).astype(np.uint32).view(np.int32)[at]
        columns = [
            pa.array(parts[place[starts]].view(np.int64)),
            pa.array(np.repeat(doc, sizes)[starts]),
            pa.array((np.repeat(lo, sizes) + nth)[starts].astype(np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(full)),
            pa.ListArray.from_arrays(offsets, pa.array(check)),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces: list[np.ndarray] = []
            owners: list[tuple[int, int]] = []
            held = 0
            for doc, text, ranges in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("ranges").to_pylist(), strict=True):
                hashes = word_hashes(words_of(text.as_py()))
                for r in ranges:
                    pieces.append(hashes[r["lo"] : r["hi"] + LENGTH])
                    owners.append((doc, r["lo"]))
                held += len(hashes)
                if held > WORDS_AT_ONCE:
                    yield hashed(pieces, owners)
                    pieces, owners, held = [], [], 0
            if pieces:
                yield hashed(pieces, owners)

    rows = docs.select(F.col("doc_id").cast("bigint"), "text").join(by_document(candidates), "doc_id")
    return rows.select("doc_id", "text", "ranges").mapInArrow(read, schema)


def removed_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, ranges): the windows of each document to remove, as ranges of their first words, both inside."""
    place = F.struct("doc_id", "lo")
    runs = store(quarter_runs(docs), "quarter-runs")
    same = store(copies(runs), "copies")
    # level 5: runs of windows whose least quarter is found elsewhere, too
    alone = runs.select("doc_id", "n_words", F.arrays_zip("least", F.col("lo").alias("lo")).alias("runs"), "lo").join(by_document(same), "doc_id", "left_anti")
    ends = F.transform("runs", lambda r, i: F.struct(r["least"].alias("least"), r["lo"].alias("lo"), (F.coalesce(F.get("lo", i + 1), F.col("n_words") - (LENGTH - 1)) - 1).alias("hi")))
    level = alone.select("doc_id", F.inline(ends))
    level = with_first(level, "least", [], place).where("not _single").select("doc_id", "lo", "hi")
    candidates = store(merged(level), "windows-5")
    # level 10: the same with the least half, among windows that survived
    level = store(half_runs(docs, candidates), "half-runs")
    level = with_first(level, "least", [], place).where("not _single")
    # level 20: the windows themselves; all but the first of equal ones go
    level = level.select("doc_id", F.col("lo").alias("at"), F.posexplode(F.arrays_zip("h", "check")).alias("nth", "w"))
    level = level.select("doc_id", (F.col("at") + F.col("nth")).cast("int").alias("lo"), F.col("w.h").alias("h"), F.col("w.check").alias("check"))
    level = store(with_first(store(level, "windows-20"), "h", ["check"], place).where(place > F.col("_first")).select("doc_id", "lo", F.col("lo").alias("hi")), "repeated-windows")
    whole = same.select("doc_id", F.lit(0).alias("lo"), F.lit(_EVERY).alias("hi"))
    return merged(level.unionByName(whole))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_removed and ``kept_text`` (kept words joined by one space).

    Words are separated by ASCII white space and compared as they are. Every word goes that lies
    in a window of LENGTH words whose sequence also starts earlier: in a smaller doc_id, or in
    the same document before. Windows are judged on the input. A NULL or empty text has no words;
    a text of fewer than LENGTH words loses none. Rows without a doc_id lose nothing and count
    for nothing; repeated rows of a document are treated alike. Columns of the three names are
    replaced. Texts of any length are read whole, one at a time.
    """
    with shuffles_freed(docs.sparkSession):
        ranges = store(removed_ranges(docs), "removed")
    ranges = ranges.select(F.col("doc_id").alias("_doc"), F.col("ranges").alias("_ranges"))
    plain = docs.drop("n_words", "n_removed", "kept_text")
    joined = plain.join(by_document(ranges), F.col("doc_id") == F.col("_doc"), "left")

    @F.pandas_udf("n_words bigint, n_removed bigint, kept_text string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            yield pd.DataFrame([kept_words(t, s) for t, s in zip(texts, spans, strict=True)], columns=["n_words", "n_removed", "kept_text"])

    return joined.withColumn("_cut", cut("text", "_ranges")).select(*plain.columns, "_cut.n_words", "_cut.n_removed", "_cut.kept_text")


def kept_words(text: str | None, ranges) -> tuple[int, int, str]:
    words = words_of(text)
    kept = np.ones(len(words), bool)
    for r in ranges if ranges is not None else ():
        kept[r["lo"] : min(r["hi"], len(words)) + LENGTH] = False
    left = words if kept.all() else [w for w, k in zip(words, kept.tolist(), strict=True) if k]
    return len(words), len(words) - len(left), b" ".join(left).decode("utf-8", "surrogatepass")


def digest_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``; see ``dedup_substrings``."""
    out = dedup_substrings(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM doc WHERE len(w) >= 20)
), seen AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM win
), word AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM doc
), mark AS (
  SELECT word.*, max(CASE WHEN again THEN word.i END) OVER (PARTITION BY doc_id ORDER BY word.i) AS last FROM word LEFT JOIN seen USING (doc_id, i)
), cut AS (
  SELECT doc_id, count(*) FILTER (last > i - 20) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (last IS NULL OR last <= i - 20) AS kept FROM mark GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN cut USING (doc_id)
"""
