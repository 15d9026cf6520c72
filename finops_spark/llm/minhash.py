"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

Every distinct shingle set has ORDERS signatures of VALUES min-hash values each. In each order
the signatures are sorted; sets with the longest common prefix then stand next to each other.
A region is a run of signatures with a common prefix of LEAST_DEPTH values; two sets of the
sought similarity share one in nearly every case (1 in 10^5 pairs at 0.85 shares none).

First each set is paired with its neighbours in its regions, each takes its likeliest partners,
those with the longest common prefixes over all orders, and these pairs are confirmed on the full
sets; this joins most of what belongs together. Then the
regions are read again with the components found: a region of at most REGION sets pairs all
that are still apart. What these pairs add is confirmed in the same way. Pairs within a component
are never formed, so large groups of copies cost no more than their number.

The sets of all larger regions that still hold several components go through one exact join in
the end: two linked sets have one of their rarest shingles in common (prefix filter), at a place
that leaves enough shingles behind it. So no crowd is cut, and none is compared all with all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finops_spark.llm.common import store
from finops_spark.llm.components import connected_components

SHINGLE = 5
#: Sets are linked from this share of common shingles on, in hundredths.
SHARE = 85
ORDERS, VALUES = 16, 12
LEAST_DEPTH = 4
#: Sets of a region that are compared with each other by signature; those of larger regions are joined exactly.
REGION = 64
#: Neighbours of a set, of at most two in each order, that are confirmed before anything else.
PARTNERS = 3
#: Regions with more sets than this are dealt out by longer prefixes, which meet through their first sets, and count as crowded.
CROWDED = 200_000
#: Classes of shingles that are counted for the order of rarity; a power of two, 2 MB of counts.
CLASSES = 1 << 18
#: Bits by which sets are told apart before they are compared in full; a multiple of 64.
PARITIES = 512
#: Pairs whose signatures agree in a smaller share than this are not confirmed: five deviations below SHARE.
LEAST_AGREEMENT = SHARE / 100 - 5 * (SHARE / 100 * (1 - SHARE / 100) / (ORDERS * VALUES)) ** 0.5
_BYTES = 2 * VALUES
_random = np.random.default_rng(11)
_FLIPS = _random.integers(0, 2**64, ORDERS * VALUES, np.uint64)
_ODD = _random.integers(0, 2**64, ORDERS * VALUES, np.uint64) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of SHINGLE words, of the whole sequence if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[SHINGLE - 1 :] or [len(joined)]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends)))


def signature(shingles: np.ndarray) -> bytes:
    """The least of each hash function over the set, 16 bits of each."""
    least = np.full(ORDERS * VALUES, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 1_024):
        part = shingles[at : at + 1_024, None] ^ _FLIPS
        part *= _ODD
        least = np.minimum(least, part.min(0))
    return (least >> np.uint64(20)).astype("<u2").tobytes()


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the number of shingles in each of PARITIES classes of hashes is odd; sets differ in no fewer shingles than in these bits."""
    odd = np.bincount((shingles >> np.uint64(32)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def node_of(shingles: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; None for the empty one."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, signature) of every row; node and signature are NULL for an empty set."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                rows = []
                for text in part.column("text"):
                    shingles = shingle_set(text.as_py())
                    rows.append((len(shingles), node_of(shingles), signature(shingles) if len(shingles) else None))
                sizes, nodes, signs = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "node", "signature"])

    return docs.select("doc_id", "text").mapInArrow(signed, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles bigint, node binary, signature binary")


@F.pandas_udf(T.DoubleType())
def agreement(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of equal values of two signatures."""
    a, b = (np.frombuffer(b"".join(map(bytes, s)), "<u2").reshape(len(s), -1) for s in (left, right))
    return pd.Series((a == b).mean(1) if len(left) else np.zeros(0))


@F.pandas_udf(T.BooleanType())
def similar(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether two full shingle sets overlap enough."""
    out = []
    for a, b in zip(left, right, strict=True):
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        out.append(100 * common >= SHARE * (len(x) + len(y) - common))
    return pd.Series(out, dtype=bool)


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes of ``wanted`` (node, first), made again from the texts of their first doc_ids.

    Texts go through a step that no filter is pushed below: no other set is made. A few are held at once."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                sets = [shingle_set(text.as_py()) for text in batch.column("text").slice(at, 200)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    firsts = wanted.select(F.col("first").alias("_first")).distinct()
    near = docs.select("doc_id", "text").join(firsts, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    sets = near.select("text").mapInArrow(made, "node binary, shingles binary")
    sets = sets.join(wanted.select(F.col("node").alias("_node")), F.col("node") == F.col("_node"), "left_semi")
    return store(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "full-sets")


def forest(nodes: DataFrame) -> DataFrame:
    """(ord, key, node, comp): the place of each node in each order; ``key`` is its signature there."""
    keys = F.array(*[F.struct(F.lit(o).cast("tinyint").alias("ord"), F.substring("signature", _BYTES * o + 1, _BYTES).alias("key")) for o in range(ORDERS)])
    return nodes.select("node", "comp", F.explode(keys).alias("k")).select("k.ord", "k.key", "node", "comp")


def _prefix(values: int) -> Column:
    return F.substring("key", 1, 2 * values)


def read_regions(nodes: DataFrame, pair: Callable, most: int | None = None) -> DataFrame:
    """(a, b, prefix): what ``pair`` (keys, nodes, comps of one region, sorted) yields for all regions of all orders.
    With ``most``, a region of more sets than this is not paired: if they are not all of one component, each gives (node, region, -1).

    A region is one stream of sorted rows in one task. Where it has over CROWDED sets its sets are
    first dealt out by their whole key and a share of their node, then one of each lot by half
    the key, then one of each of these by the region's own prefix."""
    rows = forest(nodes)
    sizes = rows.groupBy("ord", _prefix(LEAST_DEPTH).alias("p")).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > CROWDED)
    crowded = store(sizes.select(F.col("ord").alias("_ord"), F.col("p").alias("_p"), F.ceil(F.col("_size") / CROWDED).alias("_lots")), "crowded-regions")
    lot, group = F.lit(0).cast("bigint").alias("lot"), _prefix(LEAST_DEPTH).alias("group")
    dealt_out = None
    if crowded.isEmpty():
        placed = rows.select("ord", group, lot, "key", "node", "comp")
    else:  # at most one region of an order for every CROWDED sets
        here = rows.join(F.broadcast(crowded), (F.col("ord") == F.col("_ord")) & (_prefix(LEAST_DEPTH) == F.col("_p")), "left")
        placed = here.where("_lots is null").select("ord", group, lot, "key", "node", "comp")
        rest = here.where("_lots is not null").select("ord", "key", "node", "comp", F.pmod(F.xxhash64("node"), F.col("_lots")).alias("lot"))
        dealt_out = rest.select(F.col("node").alias("a"), _prefix(LEAST_DEPTH).alias("b"), F.lit(-1).alias("prefix"))
        for values in (VALUES, (LEAST_DEPTH + VALUES) // 2, LEAST_DEPTH):
            rest = rest.select("ord", _prefix(values).alias("group"), "lot", "key", "node", "comp")
            placed = placed.unionByName(rest)
            first = F.min(F.struct("key", "node", "comp")).alias("f")
            rest = store(rest.groupBy("ord", "group", "lot").agg(first).select("ord", "f.*", lot), "first-of-lots")
    dealt = placed.repartition("ord", "group", "lot").sortWithinPartitions("ord", "group", "lot", "key", "node")

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("ord", "group", "lot")
        now, held = None, ([], [], [])
        out: tuple[list, list, list] = ([], [], [])

        def sent() -> pa.RecordBatch:
            told = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.binary(), pa.int32()), strict=True)], ["a", "b", "prefix"])
            for column in out:
                column.clear()
            return told

        def told() -> Iterator[pa.RecordBatch]:
            keys, sets, comps = held
            if len(keys) < 2:
                return
            if most is None or len(keys) <= most:
                rows = pair(*held)
            else:
                rows = ((n, k[: 2 * LEAST_DEPTH], -1) for k, n in zip(keys, sets, strict=True)) if len(set(comps)) > 1 else ()
            for row in rows:
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                if len(out[0]) > 50_000:
                    yield sent()

        for batch in batches:
            of = zip(*(batch.column(n).to_pylist() for n in names), strict=True)
            for region, key, node, comp in zip(of, *(batch.column(n).to_pylist() for n in ("key", "node", "comp")), strict=True):
                if region != now:
                    yield from told()
                    now, held = region, ([], [], [])
                for column, value in zip(held, (key, node, comp), strict=True):
                    column.append(value)
        yield from told()
        yield sent()

    met = dealt.mapInArrow(regions, "a binary, b binary, prefix int")
    return met if most is None or dealt_out is None else met.unionByName(dealt_out)


def _ordered(a: bytes, b: bytes, prefix: int) -> tuple[bytes, bytes, int]:
    return (a, b, prefix) if a < b else (b, a, prefix)


def neighbours(keys: list, nodes: list, comps: list) -> Iterator[tuple[bytes, bytes, int]]:
    """Each set with the next one: of all sets one of these two has the longest prefix in common with it."""
    for i in range(len(nodes) - 1):
        x, y = keys[i], keys[i + 1]
        prefix = next((k for k in range(LEAST_DEPTH, VALUES) if x[2 * k : 2 * k + 2] != y[2 * k : 2 * k + 2]), VALUES)
        yield _ordered(nodes[i], nodes[i + 1], prefix)


def strangers(keys: list, nodes: list, comps: list, depth: int = LEAST_DEPTH) -> Iterator[tuple[bytes, bytes, int]]:
    """Pairs of sets of different components, in regions cut until they have at most REGION sets. Sets that agree
    in a whole key, and are more, are compared with the next REGION ones."""
    if len(set(comps)) == 1:
        return
    if len(keys) > REGION and depth < VALUES:
        at = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i][2 * depth : 2 * depth + 2] != keys[at][2 * depth : 2 * depth + 2]:
                if i - at > 1:
                    yield from strangers(keys[at:i], nodes[at:i], comps[at:i], depth + 1)
                at = i
        return
    for i, a in enumerate(nodes):
        for j in range(i + 1, min(len(nodes), i + REGION)):
            if comps[i] != comps[j]:
                yield _ordered(a, nodes[j], depth)


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes allow a link, the smaller set being SHARE of the larger one at least,
    and whose signatures agree in LEAST_AGREEMENT or more."""
    sides = [nodes.select(F.col("node").alias(side), F.col("signature").alias(f"_{side}"), F.col("size").alias(f"_size_{side}")) for side in "ab"]
    sized = pairs.join(sides[0], "a").join(sides[1], "b").where(100 * F.least("_size_a", "_size_b") >= SHARE * F.greatest("_size_a", "_size_b"))
    return sized.where(agreement("_a", "_b") >= LEAST_AGREEMENT).select("a", "b")


def partners(side_by_side: DataFrame) -> DataFrame:
    """The pairs (a, b) of each set with its PARTNERS likeliest neighbours; a set has few neighbours, so few rows are ranked."""
    both = side_by_side.unionByName(side_by_side.select(F.col("b").alias("a"), F.col("a").alias("b"), "prefix"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("prefix"), "b"))
    best = both.withColumn("_rank", rank).where(F.col("_rank") <= PARTNERS)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough. Only sets in pairs are made again: one text of each
    is found by the set's first doc_id, and its set goes to the pairs it is in."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return overlapping(full_sets(docs, store(nodes.join(ends, "node", "left_semi").select("node", "first"), "wanted")), pairs)


def overlapping(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets, of ``sets`` (node, shingles), overlap enough."""
    sides = [sets.select(F.col("node").alias(side), F.col("shingles").alias(f"_{side}")) for side in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").where(similar("_a", "_b")).select("a", "b")


def _class(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(CLASSES - 1)).astype(np.int64)


def class_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of ``sets`` are of each class: an order of rarity, of a fixed size at any number of sets."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for s in batch.column("shingles"):
                np.add.at(n, _class(np.frombuffer(s.as_buffer(), np.uint64)), 1)
        c = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n[c])], ["c", "n"])

    told = sets.select("shingles").mapInArrow(counted, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CLASSES, np.int64)
    counts[told.column("c").to_numpy()] = told.column("n").to_numpy()
    return counts


def exact_links(docs: DataFrame, crowd: DataFrame) -> DataFrame:
    """(a, b): all links between sets of different components among ``crowd`` (node, first, comp), by a prefix filter.

    In one order of all shingles, here by the rarity of their class, the larger one of two linked sets of n shingles has one of the smaller one's first
    n - 2 SHARE n / (100 + SHARE) + 1 among its own first n - SHARE n + 1, and where the first common one
    stands enough of both sets is left. At most (100 - SHARE) / (100 + SHARE) of all their shingles are in
    one of them only, so no more of their parities differ. Shingles of one set, or of one component, link nothing. Of a
    shingle's sets those of its largest component meet the others only."""
    sets = full_sets(docs, crowd)

    often = class_counts(sets)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                arrays = [np.frombuffer(s.as_buffer(), np.uint64) for s in part.column("shingles")]
                first = [s[np.lexsort((s, often[_class(s)]))[: len(s) - -(-SHARE * len(s) // 100) + 1]] for s in arrays]
                nodes = [node for node, f in zip(part.column("node").to_pylist(), first, strict=True) for _ in range(len(f))]
                sizes = np.repeat([len(s) for s in arrays], [len(f) for f in first])
                columns = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.concatenate(first).view(np.int64)), pa.array(np.concatenate([np.arange(len(f)) for f in first]), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "s", "at"])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [parities(np.frombuffer(s.as_buffer(), np.uint64)).tolist() for s in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bits, pa.list_(pa.int64()))], ["node", "bits"])

    first = sets.mapInArrow(rarest, "node binary, n bigint, s bigint, at bigint")
    marked = store(crowd.select("node", "comp").join(sets.mapInArrow(folded, "node binary, bits array<bigint>"), "node"), "crowd-parities")
    first = store(first.join(marked, "node").select("s", "node", "comp", "n", "at", "bits"), "rare-shingles")
    comps = first.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("_n")).groupBy("s").agg(F.count(F.lit(1)).alias("_comps"), F.max(F.struct("_n", "comp")).alias("_most"))
    first = store(first.join(comps.where("_comps > 1"), "s").select("s", "node", "comp", "n", "at", "bits", (F.col("comp") == F.col("_most.comp")).alias("main")), "rare-shingles")
    small = first.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * (2 * SHARE) / (100 + SHARE))).select("s", *[F.col(c).alias(f"_{c}") for c in ("node", "comp", "n", "at", "bits", "main")])
    left = F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at"))
    both = F.col("n") + F.col("_n")
    differ = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("_bits")[i])) for i in range(PARITIES // 64)), F.lit(0))
    may = (F.struct("_n", "_node") < F.struct("n", "node")) & (F.col("comp") != F.col("_comp")) & (100 * F.col("_n") >= SHARE * F.col("n")) & ((100 + SHARE) * left >= SHARE * both) & ((100 + SHARE) * differ <= (100 - SHARE) * both)
    met = [small.where(~F.col("_main")).join(first, "s").where(may), small.where("_main").join(first.where(~F.col("main")), "s").where(may)]
    pairs = met[0].unionByName(met[1]).select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()
    return overlapping(sets, store(pairs, "rare-pairs"))


def merged(named: DataFrame, links: DataFrame) -> DataFrame:
    """``named`` (node, first, comp) with the components made one that ``links`` (a, b), between nodes, join."""
    comps = [named.select(F.col("node").alias(side), F.col("comp").alias(f"_of_{side}")) for side in "ab"]
    more = store(links.join(comps[0], "a").join(comps[1], "b").select(F.col("_of_a").alias("a"), F.col("_of_b").alias("b")).distinct(), "more-links")
    if more.isEmpty():
        return named.select("node", "first", "comp")
    over = store(connected_components(more), "components")
    return store(named.join(over.withColumnRenamed("node", "_comp"), F.col("comp") == F.col("_comp"), "left").select("node", "first", F.coalesce("root", "comp").alias("comp")), "components-so-far")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are separated by ASCII white space, A-Z are lower-cased; the set of a text are its distinct
    shingles of five words, or its whole word sequence if it has fewer. Sets are linked if 100 times
    the common shingles are at least SHARE times the united ones; component_id is the smallest doc_id
    that can be reached, itself included. A NULL, empty or wordless text has no shingles and is linked
    with nothing. Rows without a doc_id take part but never name a component (NULL if it has no id at
    all) and are never kept; repeated rows stay. Equal sets are one node, so copies of any number cost
    one. Texts are read whole; an empty table gives no rows."""
    rows = store(signatures(docs), "shingle-signatures")
    filled = rows.where("node is not null")
    nodes = store(filled.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("signature").alias("signature"), F.first("n_shingles").alias("size")), "shingle-sets")
    met = read_regions(nodes.withColumn("comp", F.lit(None).cast("binary")), neighbours)
    side_by_side = store(met.groupBy("a", "b").agg(F.sum("prefix").alias("prefix")), "neighbours")
    best = store(likely(partners(side_by_side), nodes), "likeliest")
    parts = store(connected_components(store(confirmed(docs, nodes, best), "links")), "components")
    named = nodes.join(parts.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").withColumn("comp", F.coalesce("root", "node"))
    named = store(named.select("node", "first", "signature", "comp"), "components-so-far")
    # what is still apart: other neighbours, and all others of a small region
    read = store(read_regions(named, strangers, REGION), "regions-read")
    others = read.where("prefix >= 0").select("a", "b").unionByName(side_by_side.select("a", "b")).distinct()
    comps = [named.select(F.col("node").alias(f"_{side}"), F.col("comp").alias(f"_of_{side}")) for side in "ab"]
    apart = others.join(best, ["a", "b"], "left_anti").join(comps[0], F.col("a") == F.col("_a")).join(comps[1], F.col("b") == F.col("_b")).where("_of_a <> _of_b")
    apart = store(likely(store(apart.select("a", "b"), "still-apart"), nodes), "still-apart")
    named = merged(named, confirmed(docs, nodes, apart))
    # the sets of crowded regions, exactly
    marked = read.where("prefix < 0").select(F.col("a").alias("node"), F.col("b").alias("region")).join(named, "node")
    several = marked.groupBy("region").agg(F.min("comp").alias("_least"), F.max("comp").alias("_most")).where("_least <> _most")
    crowd = store(marked.join(several, "region", "left_semi").select("node", "first", "comp").distinct(), "crowd")
    if not crowd.isEmpty():
        named = merged(named, exact_links(docs, crowd))
    least = store(named.groupBy("comp").agg(F.min("first").alias("component_id")).withColumnRenamed("comp", "_comp"), "component-ids")
    answer = store(named.join(least, F.col("comp") == F.col("_comp")).select(F.col("node").alias("_node"), "component_id"), "set-components")
    linked = filled.join(answer, F.col("node") == F.col("_node")).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM doc WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), link AS (
  SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * common.n >= 85 * (p.n + q.n - common.n)
), way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, way.b FROM reach JOIN way ON way.a = reach.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc.doc_id, coalesce(size.n, 0) AS n_shingles, component_id, doc.doc_id = component_id AS kept
FROM doc JOIN least ON a = doc.doc_id LEFT JOIN size ON size.doc_id = doc.doc_id
"""
