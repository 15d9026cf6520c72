"""Spelling variants against brute force."""

import collections
import itertools
import random
import re
import zlib

import pytest
import tables

from finops_spark.llm import spelling


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def expected(counts, ratio=10):
    by_length = collections.defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    links = collections.defaultdict(set)
    for w in counts:
        for v in itertools.chain(by_length[len(w)], by_length[len(w) + 1]):
            if near(w, v):
                links[w].add(v)
                links[v].add(w)
    form = {}
    for w, n in counts.items():
        best = min(links[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(links[w]), counts.get(form[w])))
    return out


@pytest.mark.parametrize("most_pairs", [4_096, 3])
def test_groups_of_random_words(spark, most_pairs):
    """Words of two letters are all near many others, so chunks are hot; one length has an odd middle."""
    rng = random.Random(most_pairs)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(150)} | {"prefixes" + c for c in "abcdefghé"} | {"é" * 30, "é" * 31, "x" * 5_000, "x" * 5_001}
    counts = {w: int(10 ** rng.uniform(0, 5)) for w in sorted(words)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.group_variants(table, most_pairs=most_pairs).collect()
    assert len(got) == len(words)
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == expected(counts)
    assert any(r["root"] not in (r["word"], r["form"]) for r in got)  # forms that have forms


def brute_counts(rows):
    found = collections.Counter()
    for doc, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


@pytest.mark.parametrize("chars", [16_000_000, 200])
def test_awkward_documents(spark, monkeypatch, chars):
    monkeypatch.setattr(spelling, "COUNTED_CHARS", chars)
    extra = [(200 + i, "Überprüfung überprüfung ÜBERPRÜFUNG × a×b÷cdefgh Straße Maßnahme maßnahme", None, None) for i in range(40)]
    rows = tables.rows() + extra
    got = spelling.spelling_variants(tables.documents(spark, rows)).collect()
    want = expected(brute_counts(rows))
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == want and len(got) == len(want) > 20


def test_no_documents(spark):
    assert spelling.spelling_variants(tables.documents(spark, [])).collect() == []
    assert spelling.spelling_variants(tables.documents(spark, [(1, None, None, None), (2, "", None, None)])).collect() == []


def test_plans_do_not_grow_with_the_halvings(spark, monkeypatch):
    sizes, write = [], spelling.store

    def told(df, name):
        if name == "chunks":
            sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(spelling, "store", told)
    words = ["a" * 39 + chr(97 + i) for i in range(12)] + ["b" * 40]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    assert spelling.near_pairs(table, most_pairs=1).count() == 66
    assert len(sizes) > 4 and max(sizes) < 2 * sizes[1]
