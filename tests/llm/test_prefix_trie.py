"""The trie of rebuilt conversations against brute force."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finops_spark.llm import prefix_trie

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("depth", T.StringType()), ("ref", T.StringType()), ("pos", T.StringType()))])
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def expected(rows):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt = turns.get(int(c / 100) * 100, [])[:h] + own[h:]  # towards zero, as SQL's remainder
        for d in range(len(rebuilt) + 1):
            members[tuple(rebuilt[:d])].append(c)
        ends[tuple(rebuilt)].append(c)
    children = collections.Counter(node[:-1] for node in members if node)
    saved, leaves = collections.Counter(), collections.Counter()
    for node, held in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:d]] += not children[node]
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n], digest(ends[n])) for n, m in members.items())


def got(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    out = prefix_trie.build_trie(table)
    assert out.columns == list(COLUMNS) and all(t == "bigint" for c, t in out.dtypes if c != "ends_sha256")
    return sorted(tuple(-1 if v is None else v for v in r) for r in out.collect())


def awkward():
    """Families with and without a head, copies, shared first turns, ties, NULLs, an odd order, a long conversation."""
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 60), *range(205, 230), *range(300, 330), 1_000_007, 1_000_001]:
        for t in range(rng.choice([1, 2, 3, 4, 8])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["Hello", "hello", "é😀", "", None, f"text {rng.randint(0, 3)}"])))
    rows += [(300, None, "user", "first"), (300, None, "user", "first"), (301, 5, "b", "x"), (301, 5, "a", "y"), (301, 5, None, "y")]
    rows += [(400 + k, t, "user", f"same {t}") for k in range(20) for t in range(7)]
    rows += [(500, t, "user", f"long {t}") for t in range(60)] + [(501, t, "user", f"long {t}") for t in range(58)]
    rows += [(None, 0, "user", "no conversation"), (None, None, None, None), (-5, 0, "user", "Hello"), (-100, 0, "user", "Hello")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_awkward_conversations(spark, monkeypatch, small):
    if small:  # sums in blocks of turns, digests from rows of few ids
        monkeypatch.setattr(prefix_trie, "BLOCK", 4)
        monkeypatch.setattr(prefix_trie, "IDS_OF_A_ROW", 2)
    rows = awkward()
    assert got(spark, rows) == expected(rows)


def test_collisions_take_another_base(spark, monkeypatch):
    """Fingerprints that collide, and references that do, are noticed and taken anew."""
    rows = [r for r in awkward() if r[0] is not None and 0 <= r[0] < 8]
    tried = []
    plain, holds = prefix_trie.members, prefix_trie.references_hold

    def colliding(turns, salt):
        tried.append(salt)
        return plain(turns, salt) if salt > 1 else plain(turns, salt).withColumns({s: F.lit(0).cast("bigint") for s in ("s0", "s1", "s2")})

    monkeypatch.setattr(prefix_trie, "members", colliding)
    monkeypatch.setattr(prefix_trie, "references_hold", lambda table, salt: salt > 0 and holds(table, salt))
    assert got(spark, rows) == expected(rows)
    assert tried == [1, 2]


def test_no_conversations(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
