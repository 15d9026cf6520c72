"""Trie of rebuilt conversations from composable fingerprints; no rebuilt text is ever made.

The fingerprint of a sequence of turns is the pair (R^length, sum of x_i R^i) modulo a prime,
where x_i is a number of the i-th turn and R a fixed base. Such pairs form a monoid:
(p, s) followed by (q, t) is (p q, s + p t). A rebuilt conversation is a head of one
conversation and a suffix of another, so the fingerprint of each of its prefixes comes from
prefix sums of the two by a few products. Equal depth and equal fingerprints make a node.

Turns are stored once, by a 64-bit reference. The texts of each reference are compared, and in
each node the last turn's reference and the parent of all members; equal parents and equal last
turns are equal sequences, by induction. Should any differ, another base and other references
are taken, until all agree.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finops_spark.llm.common import EMPTY_SHA256, store
from finops_spark.operators.ordered import with_position

#: Conversations whose ids agree but for the remainder by this share the head of the one without remainder.
FAMILY = 100
#: Heads have fewer turns than this.
HEADS = 6
#: Primes below 2^31, so that products of two remainders fit a bigint (fixed values), with a base for each.
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587)
BASES = (1_103_515_245, 1_664_525_013, 1_220_703_125)
#: Positions of a conversation whose sums one task forms; longer conversations are summed up in blocks.
BLOCK = 1_000_000
#: Member ids that stand in one row while the digests of nodes are formed.
IDS_OF_A_ROW = 1_024
_SUMS = [f"s{i}" for i in range(len(PRIMES))]


def head_length(conv_id: Column) -> Column:
    """Turns that a conversation takes from the head of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def family(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def _power(i: int, exponent: Column, salt: int, inverse: bool = False) -> Column:
    """R^exponent modulo prime i for an exponent of 0 to 2^32 - 1, by its four bytes."""
    p = PRIMES[i]
    base = pow(BASES[i] + salt, -1 if inverse else 1, p)
    out = F.lit(1).cast("bigint")
    for byte in range(4):
        powers = F.expr(f"array({', '.join(f'{pow(base, k << 8 * byte, p)}L' for k in range(256))})")
        part = F.get(powers, F.shiftright(exponent.cast("bigint"), 8 * byte).bitwiseAND(F.lit(255).cast("bigint")).cast("int"))
        out = F.when(exponent < F.lit(1 << 8 * byte), out).otherwise(out * part % p) if byte else part
    return out


def ordered_turns(conversations: DataFrame, salt: int) -> DataFrame:
    """(conv_id, pos, ref, chars): the turns by position from 0, without their texts.

    Turns are ordered by ``turn``, NULL first; only where several differing rows of a conversation
    share one are role and text compared."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), role.alias("role"), text.alias("text"))
    ref = F.xxhash64(F.lit(salt), "role", "text")
    narrow = store(rows.select("conv_id", "turn", ref.alias("ref"), F.char_length("text").alias("chars")), "turns")
    tied = store(narrow.groupBy("conv_id", "turn").agg(F.min("ref").alias("lo"), F.max("ref").alias("hi")).where("lo < hi").select("conv_id", "turn"), "tied-turns")
    if tied.isEmpty():
        return with_position(narrow, ["conv_id"], ["turn"], "pos")
    same = lambda side: (side["conv_id"] == tied["conv_id"]) & side["turn"].eqNullSafe(tied["turn"])
    texts = rows.join(tied, same(rows), "left_semi").withColumn("ref", ref)
    ranked = with_position(texts, ["conv_id", "turn"], ["role", "text"], "nth").select("conv_id", "turn", "ref", F.char_length("text").alias("chars"), "nth")
    others = narrow.join(tied, same(narrow), "left_anti").withColumn("nth", F.lit(0).cast("bigint"))
    return with_position(others.unionByName(ranked), ["conv_id"], ["turn", "nth"], "pos").drop("turn", "nth")


def references_hold(conversations: DataFrame, salt: int) -> bool:
    """Whether no two different turns have one reference; copies are made one before they move."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(role.alias("role"), text.alias("text")).distinct()
    refs = turns.select(F.xxhash64(F.lit(salt), "role", "text").alias("ref"))
    return refs.groupBy("ref").count().where("count > 1").isEmpty()


def running_sums(rows: DataFrame, key: str, order: str, values: list[str], names: list[str], descending: bool = False) -> DataFrame:
    """``rows`` with, as ``names``, the sums of ``values`` over all rows of the key up to each row in the order of
    ``order`` (0, 1, ...), or from it on. A key of more than BLOCK rows is summed up in blocks that different tasks hold."""
    blocked = rows.withColumn("_block", F.floor(F.col(order) / BLOCK))
    way = F.desc(order) if descending else F.asc(order)
    w = Window.partitionBy(key, "_block").orderBy(way).rowsBetween(Window.unboundedPreceding, 0)
    inside = blocked.withColumns({n: F.sum(v).over(w) for v, n in zip(values, names, strict=True)})
    large = blocked.groupBy(key).agg(F.max("_block").alias("_last")).where("_last > 0").select(key)
    totals = blocked.join(large, key, "left_semi").groupBy(key, "_block").agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values)])
    before = Window.partitionBy(key).orderBy(F.desc("_block") if descending else F.asc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(F.col(key).alias("_key"), F.col("_block").alias("_of"), *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_t{i}") for i in range(len(values))])
    shifts = store(shifts, "block-sums")
    if not shifts.isEmpty():
        inside = inside.join(shifts, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_of")), "left").withColumns({n: F.col(n) + F.coalesce(F.col(f"_t{i}"), F.lit(0)) for i, n in enumerate(names)})
    return inside.select(*rows.columns, *names)


def members(turns: DataFrame, salt: int) -> DataFrame:
    """(conv_id, depth, fingerprint s0.., parent's p0.., ref, chars, last): a row for every rebuilt conversation
    and depth; ``last`` marks its full length."""
    at = F.col("pos") + 1
    terms = [(F.pmod(F.xxhash64(F.lit(i), "ref"), F.lit(p)) * _power(i, at, salt) % p).alias(f"x{i}") for i, p in enumerate(PRIMES)]
    placed = turns.select("conv_id", "pos", "ref", "chars", *terms)
    names = [f"x{i}" for i in range(len(PRIMES))]
    own = running_sums(placed, "conv_id", "pos", names, [f"c{i}" for i in range(len(PRIMES))])
    own = store(own.withColumns({f"c{i}": F.col(f"c{i}") % p for i, p in enumerate(PRIMES)}), "turn-sums")
    sums = F.struct(*[F.col(f"c{i}").alias(s) for i, s in enumerate(_SUMS)])
    # few rows a conversation: its length, and what it has at the head
    first = F.sort_array(F.collect_list(F.when(F.col("pos") < HEADS - 1, F.struct("pos", sums.alias("sums"), "ref", "chars"))))
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    bases = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_base"), F.col("first").alias("head"))
    h = head_length(F.col("conv_id"))
    joined = convs.withColumn("h", h).join(bases, family(F.col("conv_id")) == F.col("_base"), "left").withColumn("head", F.slice(F.coalesce("head", F.expr("slice(first, 1, 0)")), 1, F.col("h")))
    zero = F.struct(*[F.lit(0).cast("bigint").alias(s) for s in _SUMS])
    at_end = lambda array, n: F.when(n > 0, F.get(array, n - 1)["sums"]).otherwise(zero)
    joined = joined.withColumns({"m": F.size("head"), "before": at_end(F.col("head"), F.size("head")), "cut": at_end(F.col("first"), F.least(F.col("h"), F.size("first")))})
    # the suffix starts at turn h + 1 and is moved to m + 1
    moves = [_power(i, F.col("h") - F.col("m"), salt, inverse=True).alias(f"_move{i}") for i in range(len(PRIMES))]
    whole = joined.select("conv_id", "head", "h", "m", "before", "cut", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"), *moves)
    whole = store(whole, "rebuilt")
    empty = F.struct(F.lit(-1).cast("bigint").alias("pos"), zero.alias("sums"), F.lit(0).cast("bigint").alias("ref"), F.lit(0).alias("chars"))
    heads = whole.select("conv_id", "length", F.explode(F.concat(F.array(empty), F.transform("head", lambda t, i: F.struct(i.cast("bigint").alias("pos"), t["sums"].alias("sums"), t["ref"].alias("ref"), t["chars"].alias("chars"))))).alias("t"), "head")
    parent = at_end(F.col("head"), F.col("t.pos").cast("int"))
    heads = heads.select("conv_id", (F.col("t.pos") + 1).alias("depth"), "t.sums.*", *[F.when(F.col("t.pos") >= 0, parent[s]).alias(f"p{i}") for i, s in enumerate(_SUMS)], F.col("t.ref").alias("ref"), F.col("t.chars").alias("chars"), "length")
    mine = own.join(whole.drop("head").withColumnRenamed("conv_id", "_conv"), F.col("conv_id") == F.col("_conv")).where("pos >= h")

    def moved(i: int, value: Column) -> Column:
        p = PRIMES[i]
        return (F.col(f"before.{_SUMS[i]}") + F.pmod(value - F.col(f"cut.{_SUMS[i]}"), F.lit(p)) * F.col(f"_move{i}")) % p

    tails = mine.select(
        "conv_id", (F.col("m") + F.col("pos") + 1 - F.col("h")).alias("depth"), *[moved(i, F.col(f"c{i}")).alias(s) for i, s in enumerate(_SUMS)],
        *[moved(i, F.col(f"c{i}") - F.col(f"x{i}")).alias(f"p{i}") for i in range(len(PRIMES))], "ref", "chars", "length",
    )
    return heads.unionByName(tails).withColumn("last", F.col("depth") == F.col("length")).drop("length")


def _joined(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str) -> DataFrame:
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & (left[a] == right[b])
    return left.join(right, condition, how)


def ends_digest(ends: DataFrame, node: list[str]) -> DataFrame:
    """(node columns, ends_sha256) of (node columns, conv_id): SHA-256 of the ids, ascending, joined by commas.

    Ids are gathered in rows of an id range each, so of IDS_OF_A_ROW at most; the rows of a node
    then stream through its digest in order, whatever their number."""
    names = [f"_n{i}" for i in range(len(node))]
    keyed = ends.select(*[F.col(c).alias(n) for c, n in zip(node, names, strict=True)], "conv_id", F.floor(F.col("conv_id") / IDS_OF_A_ROW).alias("_range"))
    rows = keyed.groupBy(*names, "_range").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))
    dealt = rows.repartition(*names).sortWithinPartitions(*names, "_range").select(*names, "ids")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(done: list) -> pa.RecordBatch:
            columns = [pa.array([k[i] for k, _ in done], pa.int64()) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([d for _, d in done], pa.string())], [*names, "ends_sha256"])

        now, digest, done = None, hashlib.sha256(), []
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True)
            for key, ids in zip(keys, batch.column(len(names)), strict=True):
                if key != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.as_py().encode())
                else:
                    digest.update(b"," + ids.as_py().encode())
            if len(done) > 10_000:
                yield told(done)
                done = []
        yield told(done + ([(now, digest.hexdigest())] if now is not None else []))

    return dealt.mapInArrow(digested, ", ".join(f"{n} bigint" for n in names) + ", ends_sha256 string")


def build_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role and text; other columns are not read. A NULL role or
    text is empty, a NULL turn comes first, turns that tie are ordered by role, then text; repeated
    rows are turns of their own; a negative conv_id takes SQL's remainder. Rows without a conv_id belong to no conversation and are left out.
    A table without conversations has no node, not even a root. Sums over subtrees need no walk:
    a node's weight is given to its smallest member, whose rebuilt conversation passes through all
    the node's ancestors."""
    for salt in itertools.count():
        if references_hold(conversations, salt):
            rows = store(members(ordered_turns(conversations, salt), salt), "members")
            node, parent = ["depth", *_SUMS], [f"p{i}" for i in range(len(PRIMES))]
            values = ["ref", *parent]
            grouped = rows.groupBy(*node).agg(
                F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.count_if("last").alias("n_ends"),
                *[F.min(v).alias(v) for v in values], *[F.max(v).alias(f"_most_{v}") for v in values],
            )
            differ = " or ".join(f"{v} <> _most_{v}" for v in values)
            grouped = store(grouped.withColumn("_bad", F.coalesce(F.expr(differ), F.lit(False))).drop(*[f"_most_{v}" for v in values]), "nodes")
            if grouped.where("_bad").isEmpty():
                break
    nodes = grouped.drop("_bad", "ref", "n_ends")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("_d"), *parent).agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({p: f"_{p}" for p in parent})
    tops = [("depth", "_d"), *[(s, f"_{p}") for s, p in zip(_SUMS, parent, strict=True)]]
    nodes = _joined(nodes, children, tops, "left").drop("_d", *[f"_{p}" for p in parent]).withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # what each node adds, summed from the deepest of its smallest member up
    weighed = nodes.withColumns({"w": (F.col("n_convs") - 1) * F.col("chars"), "leaf": (F.col("n_children") == 0).cast("bigint")})
    chained = store(running_sums(weighed, "conv_id", "depth", ["w", "leaf"], ["below", "leaves"], descending=True), "weighed-nodes")
    tip = F.max(F.struct("depth", "below", "leaves"))
    top = F.min(F.struct("depth", "below", "leaves"))
    chains = chained.groupBy("conv_id").agg(top["depth"].alias("from"), top["below"].alias("all_below"), tip["depth"].alias("to"), top["leaves"].alias("all_leaves"))
    chains = chains.select(F.col("conv_id").alias("_conv"), "from", "all_below", "all_leaves")
    # a member that is not the smallest has its own chain wholly below the node
    passed = rows.select("conv_id", *node).join(chains, (F.col("conv_id") == F.col("_conv")) & (F.col("depth") < F.col("from")))
    added = passed.groupBy(*[F.col(c).alias(f"_{c}") for c in node]).agg(F.sum("all_below").alias("_more_below"), F.sum("all_leaves").alias("_more_leaves"))
    out = _joined(chained, added, [(c, f"_{c}") for c in node], "left")
    out = _joined(out, ends_digest(rows.where("last").select(*node, "conv_id"), node), [(c, f"_n{i}") for i, c in enumerate(node)], "left")
    up = nodes.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("_up"), *[F.col(s).alias(f"_up_{s}") for s in _SUMS])
    # the parent's smallest member is the node's own but where a chain begins
    out = store(out.select("conv_id", "depth", *parent, "n_convs", "n_children", (F.col("leaves") + F.coalesce("_more_leaves", F.lit(0))).alias("n_leaves"), (F.col("below") + F.coalesce("_more_below", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")), "trie")
    out = _joined(out, up, [("depth", "_up"), *[(p, f"_up_{s}") for p, s in zip(parent, _SUMS, strict=True)]], "left")
    return out.select("conv_id", F.col("depth").cast("bigint"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL = r"""
WITH RECURSIVE bytes AS (SELECT i AS c0 FROM range(0, 256) t(i)
), step AS (
  SELECT c0, CAST(c0 AS UBIGINT) AS c, 0 AS k FROM bytes
  UNION ALL SELECT c0, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY c0) AS t FROM step WHERE k = 8
), conv AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), headed AS (
  SELECT c, turns, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(CAST(c AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS UBIGINT))),
      lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) % 6 AS h FROM conv, crc
), built AS (
  SELECT x.c, list_concat(list_slice(coalesce(b.turns, []), 1, CAST(x.h AS BIGINT)), list_slice(x.turns, CAST(x.h AS BIGINT) + 1, len(x.turns))) AS turns FROM headed x LEFT JOIN conv b ON b.c = x.c - x.c % 100
), prefix AS (
  SELECT c, d, len(turns) = d AS ends, list_slice(turns, 1, d) AS p FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)
), keyed AS (
  SELECT c, d, ends, CASE WHEN d > 0 THEN length(p[d].t) ELSE 0 END AS chars, sha256(CAST(d AS VARCHAR) || CAST(to_json(p) AS VARCHAR)) AS k FROM prefix
), linked AS (
  SELECT keyed.*, lag(k) OVER (PARTITION BY c ORDER BY d) AS up FROM keyed
), node AS (
  SELECT k, min(c) AS conv_id, d AS depth, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS w,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM linked GROUP BY k, d
), kids AS (SELECT up, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up
), under AS (
  SELECT k AS top, k AS at_node FROM node
  UNION ALL SELECT node.up, at_node FROM under JOIN node ON node.k = under.top WHERE node.up IS NOT NULL
), sums AS (
  SELECT top, CAST(sum(w) AS BIGINT) AS saved_tokens, count(*) FILTER (kids.n IS NULL) AS n_leaves FROM under JOIN node ON node.k = at_node LEFT JOIN kids ON kids.up = at_node GROUP BY top
)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, node.ends_sha256
FROM node LEFT JOIN node parent ON parent.k = node.up LEFT JOIN kids ON kids.up = node.k JOIN sums ON sums.top = node.k
"""
