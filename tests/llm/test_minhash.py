"""MinHash near-duplicates against brute force over full shingle sets."""

import random

import numpy as np
import pytest
import tables

from finops_spark.llm import minhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = [w.decode("utf-8", "surrogatepass") for w in (text or "").translate(ASCII_LOWER).encode("utf-8", "surrogatepass").split()]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    sets = [(doc, shingles(text)) for doc, text, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, a) in enumerate(sets):
        key = find(i)
        if doc is not None and a:
            least[key] = min(doc, least.get(key, doc))
    out = []
    for i, (doc, a) in enumerate(sets):
        component = least.get(find(i)) if a else doc
        out.append((doc if doc is not None else -1, len(a), -1 if component is None else component, doc is not None and doc == component))
    return sorted(out)


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2], r[3]) for r in df.collect())


def test_awkward_documents(spark):
    assert got(minhash.near_duplicates(tables.documents(spark))) == expected(tables.rows())


def test_no_documents(spark):
    assert got(minhash.near_duplicates(tables.documents(spark, []))) == []
    assert got(minhash.near_duplicates(tables.documents(spark, [(1, None, None, None), (2, " \n", None, None)]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def crowd():
    """A crowd of versions of one text on both sides of the limit, some that chain, and versions of another."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 5, 8, 9, 10, 12])):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        rows.append((1_000 - i, " ".join(words), None, None))
    other = [f"v{k}" for k in range(400)]
    for i in range(40):  # each is near the next only
        rows.append((2_000 + i, " ".join(other[4 * i : 4 * i + 200]), None, None))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_a_crowd_of_versions(spark, monkeypatch, small):
    if small:  # regions are cut by more values and dealt out in lots
        monkeypatch.setattr(minhash, "CROWDED", 20)
        monkeypatch.setattr(minhash, "REGION", 12)
    rows = crowd()
    assert got(minhash.near_duplicates(tables.documents(spark, rows))) == expected(rows)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 4_000, np.uint64)
    for share in (0.5, 0.85, 0.95):
        n = int(4_000 * share)
        b = np.r_[a[:n], rng.integers(0, 2**64, 4_000 - n, np.uint64)]
        x, y = (np.frombuffer(minhash.signature(s), "<u2") for s in (a, b))
        true = n / (8_000 - n)
        assert abs((x == y).mean() - true) < 5 * (true * (1 - true) / len(x)) ** 0.5
        assert minhash.signature(a) == minhash.signature(a[::-1].copy())


def test_strangers_are_of_different_components():
    keys = [bytes([0, 0] * 4 + [i // 30, 0] + [0] * 14) for i in range(120)]
    nodes = [i.to_bytes(16) for i in range(120)]
    pairs = set(minhash.strangers(keys, nodes, [n[-1:] if n[-1] % 2 else b"" for n in nodes]))
    assert all((int.from_bytes(a) % 2 or int.from_bytes(b) % 2) and a < b for a, b, _ in pairs)
    assert {(int.from_bytes(a) // 30, int.from_bytes(b) // 30) for a, b, _ in pairs} == {(k, k) for k in range(4)}
    assert list(minhash.strangers(keys, nodes, [b"x"] * 120)) == []


@pytest.mark.parametrize("crowded", [20, 200_000])
def test_crowded_regions_have_an_exact_way(spark, monkeypatch, crowded):
    """The exact join alone finds every link, without neighbours and pairs of small regions."""
    monkeypatch.setattr(minhash, "neighbours", lambda keys, nodes, comps: iter(()))
    monkeypatch.setattr(minhash, "strangers", lambda keys, nodes, comps: iter(()))
    monkeypatch.setattr(minhash, "REGION", 1)
    monkeypatch.setattr(minhash, "CROWDED", crowded)
    rows = crowd()
    assert got(minhash.near_duplicates(tables.documents(spark, rows))) == expected(rows)


def test_parities_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(2)
    for n in (1, 30, 3_000):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.r_[a[n // 5 :], rng.integers(0, 2**64, n // 4, np.uint64)])
        x, y = (np.unpackbits(minhash.parities(s).view(np.uint8)) for s in (a, b))
        assert len(x) == minhash.PARITIES and int((x != y).sum()) <= len(np.setxor1d(a, b))
