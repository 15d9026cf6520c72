"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart have a common variant at most r bits from either. So
every distinct fingerprint emits all its variants within r = 2 bits, equal variants meet, and
the fingerprints that meet are linked. The shuffle goes by the variants' leading bits: a
fingerprint is sent once to each prefix that any of its variants has, and its variants with
that prefix are made, sorted and compared in the task that got it.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finops_spark.llm.common import store
from finops_spark.llm.components import connected_components

BITS, SHINGLE, SEED = 64, 4, 42
#: Fingerprints link at RADIUS bits or fewer; variants lie within half of it.
RADIUS = 4
#: Variants that a prefix has on average; decides how many leading bits deal them out.
VARIANTS_OF_A_PREFIX = 16_000_000
#: Variants that a task holds at a time; where a prefix has more it is worked off by longer prefixes.
VARIANTS_AT_ONCE = 2_000_000


def fingerprint(text: str | None) -> int:
    """64 bits; bit i is 1 if it is set in over half the shingles' hashes. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()[SHINGLE - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed bigint."""

    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", of("text").alias("fp"))


@functools.cache
def _masks(width: int, flips: int) -> np.ndarray:
    """All words with ``flips`` of the lowest ``width`` bits set."""
    return np.array([sum(1 << b for b in c) for c in itertools.combinations(range(width), flips)], np.uint64)


def linked(values: np.ndarray, prefix: int, width: int, half: int) -> np.ndarray:
    """Links (pairs of values) of all fingerprints with an equal variant that begins with ``prefix`` (``width`` bits).

    In every group of equal variants the first fingerprint is linked to the others, which keeps
    what is connected without forming all pairs; equal links are made one."""
    low = BITS - width
    spent = np.bitwise_count((values >> np.uint64(low)) ^ np.uint64(prefix))
    values, spent = values[spent <= half], spent[spent <= half]
    if len(values) < 2:
        return np.zeros((0, 2), np.uint64)
    variants = sum(int((spent == used).sum()) * len(_masks(low, f)) for used in range(half + 1) for f in range(half - used + 1))
    if variants > VARIANTS_AT_ONCE and low > 8:
        parts = [linked(values, prefix << 4 | more, width + 4, half) for more in range(16)]
        return np.unique(np.concatenate(parts), axis=0)
    keys, owners = [], []
    for used in range(half + 1):
        at = np.flatnonzero(spent == used)
        masks = np.concatenate([_masks(low, f) for f in range(half - used + 1)])
        tail = values[at] & np.uint64((1 << low) - 1)
        keys.append((tail[:, None] ^ masks[None]).ravel())
        owners.append(np.repeat(at.astype(np.int32), len(masks)))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    same = np.r_[False, key[1:] == key[:-1]]
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
    first, other = owner[start[same]].astype(np.int64), owner[same].astype(np.int64)
    pair = np.unique(np.minimum(first, other) << 32 | np.maximum(first, other))
    pair = np.stack([values[pair >> 32], values[pair & 0xFFFFFFFF]], 1)
    return pair[np.bitwise_count(pair[:, 0] ^ pair[:, 1]) <= 2 * half]  # verified


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` that connect all those within ``radius`` bits."""
    half = radius // 2
    n = max(1, distinct.count())
    ball = sum(len(_masks(BITS, f)) for f in range(half + 1))
    width = int(np.clip(np.ceil(np.log2(n * ball / VARIANTS_OF_A_PREFIX)), 8, 24))
    flips = np.concatenate([_masks(width, f) for f in range(half + 1)])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for part in np.array_split(fps, len(fps) // 20_000 + 1):
                prefix = (part >> np.uint64(BITS - width))[:, None] ^ flips[None]
                yield pa.RecordBatch.from_pydict({"prefix": prefix.ravel().astype(np.int32), "fp": np.repeat(part, len(flips)).view(np.int64)})

    def met(table: pa.Table) -> pa.Table:
        pair = linked(table.column("fp").to_numpy().view(np.uint64), table.column("prefix")[0].as_py(), width, half)
        return pa.table({"a": pair[:, 0].view(np.int64), "b": pair[:, 1].view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(sent, "prefix int, fp bigint")
    return dealt.groupBy("prefix").applyInArrow(met, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in at most ``radius`` bits (an even number) are linked;
    component_id is the smallest doc_id that can be reached, itself included. Texts without words,
    empty or NULL, have fingerprint zero and are linked like any other. Rows without a doc_id take
    part but never name a component (which is NULL if it has no id at all); repeated rows stay.
    Equal fingerprints are one node, so copies of any number cost one."""
    rows = store(fingerprints(docs), "fingerprints")
    nodes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    parts = connected_components(links(nodes, radius))
    named = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = store(named, "fingerprint-roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    answer = store(named.join(least, "root").select(F.col("fp").alias("_fp"), "component_id"), "fingerprint-components")
    out = rows.join(answer, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
