"""Operators on awkward tables, against brute force written from their contracts."""

import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import tables
from pyspark.sql import functions as F

from finops_spark.llm import byte_bpe, components, decontaminate, language, line_dedup, quality, simhash, substring_dedup, token_counts, toxicity, warc

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return tables.documents(spark).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return tables.documents(spark, [])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected_hits(n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(ASCII_LOWER))
    items = [(0, tables.PASSAGE), (1, "Le La PASSAGE3 passage4 passage5"), (None, " ".join(tables.PASSAGE.split()[:12])), (11, " ".join(tables.PASSAGE.upper().split()[5:20])), (12, "nowhere to be found at all in any of these texts"), (7, "passage38 passage39")]
    out = collections.Counter()
    for doc, text, _, _ in tables.rows():
        w = split(text)
        hit, listed = set(), set()
        for item, passage in items if doc is not None else ():
            p = split(passage)
            k = min(n, len(p))
            grams = {tuple(p[i : i + k]) for i in range(len(p) - k + 1)}
            found = {j for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in grams for j in range(i, i + k)}
            hit |= found
            if found and item is not None:
                listed.add(str(item))
        out[(doc, len(w), len(hit), len(listed), sha(",".join(sorted(listed))), bool(hit))] += 1
    return out


def test_benchmark_hits(spark, docs, empty):
    items = tables.benchmark(spark)
    report = decontaminate.hit_report(docs, items)
    assert counted(report) == expected_hits()
    assert any(k[2] and k[3] for k in expected_hits())
    assert decontaminate.hit_report(docs, tables.benchmark(spark, empty=True)).where("contaminated").count() == 0
    assert decontaminate.hit_report(empty, items).count() == 0
    clean = decontaminate.remove_documents(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in expected_hits().items() if not k[5])
    cut = decontaminate.remove_spans(docs, items)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.where("text like '%passage%' and doc_id is not null").count() == 0


def test_benchmark_hits_without_a_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", 0)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 7)
    monkeypatch.setattr(decontaminate, "BITS_PER_GRAM", 1)
    assert counted(decontaminate.hit_report(docs, tables.benchmark(spark))) == expected_hits()


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = collections.Counter()
    for doc, text, _, _ in tables.rows():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[(doc, len((text or "").encode()), n, n > 2048)] += 1
    assert counted(token_counts.count_tokens(docs, path)) == want
    assert token_counts.count_tokens(empty, path).count() == 0


def expected_lines():
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)
    holders = collections.defaultdict(set)
    for doc, text, _, _ in tables.rows():
        if doc is not None:
            for line in (text or "").split("\n"):
                holders[key(line)].add(doc)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    out = collections.Counter()
    for doc, text, _, _ in tables.rows():
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or gone.get(key(x), doc) == doc]
        out[(doc, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    return out


@pytest.mark.parametrize("common", [2000, 1])
def test_line_dedup(docs, empty, monkeypatch, common):
    from finops_spark.llm import hot

    monkeypatch.setattr(hot, "COMMON_KEYS", common)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*(c for c in docs.columns if c != "kept_text"), "kept_text", "n_lines", "n_dropped"]
    assert counted(out.select("doc_id", "kept_text", "n_lines", "n_dropped")) == expected_lines()
    assert any(k[3] for k in expected_lines())
    if common == 1:
        assert line_dedup.dedup_lines(empty).count() == 0


def test_line_bitmaps_of_a_long_document(spark):
    many = "\n".join(f"a line of its own, number {i}" if i % 3 else "one line that is in all of them" for i in range(1000))
    docs = tables.documents(spark, [(i, many if i != 2 else "One line that is in all of them", "en", "s") for i in (1, 2, 3, 4)])
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: (1000, 1000), 2: (1, 1), 3: (1000, 1000), 4: (1000, 0)}
    assert line_dedup.dedup_lines(docs.where("doc_id != 3")).where("doc_id = 1").head().n_dropped == 334


def test_toxicity(spark, docs, empty):
    labelled = docs.select("doc_id", "text").where("doc_id < 60").withColumn("toxic", (F.col("doc_id") % 11 == 0).cast("int"))
    model = toxicity.fit_toxicity(labelled, most=50)
    out = toxicity.score_toxicity(docs, model)
    assert out.columns == [*(c for c in docs.columns if c != "score" and c != "predicted"), "score", "sentences", "predicted"] or set(out.columns) == {*docs.columns, "sentences"}
    rows = out.collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.score == 0 for r in rows if not re.search(r"\w", r.text or ""))
    flagged = {r.doc_id for r in rows if r.predicted and r.doc_id is not None and r.doc_id < 60}
    assert flagged == {i for i in range(60) if i % 11 == 0}
    assert all(any("passage" in r.text[s.start : s.end] for s in r.sentences) for r in rows if r.doc_id in flagged)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(labelled.limit(0))).count() == 0
    assert toxicity.bounded_sample(labelled, 7).groupBy("toxic").count().where("count > 7").count() == 0


def test_toxicity_sample_keeps_the_labels_shares(spark):
    """30 of 330 are toxic and no word tells them: the bias comes from 1 in 11, whatever the sample takes of each label."""
    rows = spark.range(330).select(F.col("id").alias("doc_id"), F.lit("the same words in all").alias("text"), (F.col("id") < 30).cast("int").alias("toxic"))
    for most in (10, 50, 1000):
        assert abs(toxicity.fit_toxicity(rows, most).bias - (math.log(0.1) - 5)) < 1e-6


def plain_substrings(rows, length=20):
    first = {}
    for doc, text in sorted({(d, t or "") for d, t, _, _ in rows if d is not None}):
        w = words_of(text)
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), (doc, i))
    out = collections.Counter()
    for doc, text, _, _ in rows:
        w = words_of(text)
        gone = set()
        for i in range(len(w) - length + 1) if doc is not None else ():
            if first[tuple(w[i : i + length])] < (doc, i):
                gone |= set(range(i, i + length))
        out[(doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))] += 1
    return out


@pytest.mark.parametrize("small", [False, True])
def test_substring_dedup(docs, empty, monkeypatch, small):
    from finops_spark.llm import hot

    if small:  # other routes: few common keys, many arrays
        monkeypatch.setattr(hot, "COMMON_KEYS", 3)
        monkeypatch.setattr(substring_dedup, "WORDS_AT_ONCE", 50)
    want = plain_substrings(tables.rows())
    assert counted(substring_dedup.digest_report(docs)) == want and any(k[2] for k in want)
    if not small:
        out = substring_dedup.dedup_substrings(docs)
        assert set(out.columns) == {*docs.columns, "n_removed"}
        assert substring_dedup.digest_report(empty).count() == 0


def test_language(docs, empty):
    model = language.fit_language_model(docs.where("doc_id < 40"))
    assert model.languages == ["en", "fr"]
    out = language.predict_language(docs, model)
    assert set(out.columns) == {*docs.columns, "ambiguous"}
    rows = [r for r in out.collect() if r.doc_id is not None]
    assert all(r.lang_pred == r.lang for r in rows if r.doc_id < 60)
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) and 0 <= r.score <= 1 for r in rows)
    assert language.predict_language(empty, model).count() == 0
    nothing = language.predict_language(docs, language.fit_language_model(empty))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_byte_bpe(docs, empty):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for doc, text, _, _ in tables.rows():
        ids = library.encode_ordinary(text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want[(doc, len(ids), hashlib.sha256(packed).hexdigest(), sha(text or ""))] += 1
    assert counted(byte_bpe.token_digests(docs, BYTE, public_tokenizers.PATTERN)) == want
    assert byte_bpe.token_digests(empty, BYTE, public_tokenizers.PATTERN).count() == 0
    coded = byte_bpe.encode_documents(docs, BYTE, public_tokenizers.PATTERN)
    assert set(coded.columns) == {*docs.columns, "decoded"}
    assert coded.where("cast(decoded as string) != coalesce(text, '')").count() == 0


def test_quality(docs, empty):
    want = collections.Counter()
    for doc, text, _, _ in tables.rows():
        w = words_of(text)
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        want[(doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed)] += 1
    out = quality.judge(docs)
    assert counted(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
    rows = {r.doc_id: r for r in out.collect()}
    assert not any(r.kept and r.base_failed for r in rows.values())
    assert not rows[115].kept and sum(r.kept for i, r in rows.items() if i is not None and i < 60 and not r.base_failed) >= 55
    assert quality.judge(empty).count() == 0


def test_quality_factor_of_normal_data(spark):
    """A spread of known size is estimated within a tenth, though a tenth of the rows lie far away."""
    rows = spark.range(20_000).select(
        F.lit("a").alias("cell"), *[(F.randn(i) * 0.5 + F.when(F.rand(9) < 0.1, 8.0).otherwise(1.0)).alias(f) for i, f in enumerate(quality.FEATURES)]
    ).persist()
    fit = quality.fit_cells(rows).head()
    for f, least in quality.FEATURES.items():
        assert abs(fit[f"m_{f}"] - 1.0) < 0.06
        assert abs(fit[f"l_{f}_{f}"] ** 2 - least**2 - 0.25) < 0.06


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quality_determinant_is_the_least_of_all_subsets(spark, seed):
    """12 rows, 3 of them far off: no subset of 9 has a smaller determinant than the estimate's."""
    import itertools

    import numpy as np

    draw = np.random.default_rng(seed)
    mix = draw.normal(size=(4, 4)) + 2 * np.eye(4)
    x = draw.normal(size=(12, 4)) @ mix
    x[9:] += 40 * draw.normal(size=4)
    names = list(quality.FEATURES)
    rows = spark.createDataFrame([("a", *map(float, r)) for r in x], ["cell", *names]).coalesce(1)
    got = quality.fit_cells(rows).head()
    factor = quality.core_factor(quality.CORE)
    dets = {s: np.linalg.slogdet(np.cov(x[list(s)].T, bias=True) * factor)[1] for s in itertools.combinations(range(12), 9)}
    least = min(dets, key=dets.get)
    assert least == tuple(range(9)) and abs(got.log_det - dets[least]) < 1e-6
    assert all(abs(got[f"m_{f}"] - x[:9, i].mean()) < 1e-9 for i, f in enumerate(names))


def test_quality_limit_rejects_plain_outliers(spark):
    """Against a cell without duplicates: word length, duplicate lines with repeats, or repeats alone."""
    rows = spark.range(400).select(F.lit("a").alias("cell"), (1.6 + 0.04 * F.randn(3)).alias("length"), *[F.lit(0.0).alias(f) for f in ("symbols", "lines", "repeats")])
    cases = [("a", 1.6, 0.0, 0.2, 0.2), ("a", 2.1, 0.0, 0.0, 0.0), ("a", 1.6, 0.0, 0.5**0.5, 0.29**0.5), ("a", 1.6, 0.0, 0.0, 0.29**0.5), ("a", 1.6, 0.2, 0.0, 0.0)]
    far = quality.distances(spark.createDataFrame(cases, rows.schema).coalesce(1), quality.fit_cells(rows.persist())).collect()
    assert {tuple(r)[:5]: r.d2 > quality.LIMIT for r in far} == {c: i > 0 for i, c in enumerate(cases)}


def test_quality_of_small_cells(spark):
    """A few documents of a source are judged with their language or, if it is rare, with all documents."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["word", "and", "the", "house", "goes"]) for _ in range(60)), "en", "large") for i in range(120)]
    rows += [(1000 + i, " ".join(rng.choice(["#####$$$$$ABCDEFGH", "QWERTYUIOP&&&"]) for _ in range(60)), "en" if i < 30 else "xx", "small") for i in range(35)]
    rows += [(2000, rows[0][1], "en", "small"), (2001, rows[1][1], "xx", "other")]
    kept = {r.doc_id: r.kept for r in quality.judge(tables.documents(spark, rows)).collect()}
    assert len(kept) == len(rows) and not any(k for i, k in kept.items() if 1000 <= i < 2000)
    assert kept[2000] and kept[2001] and sum(kept[i] for i in range(120)) >= 110
    cells = quality.with_cells(tables.documents(spark, rows).drop("cell").withColumn("base_failed", F.lit(False)))
    assert {(r.lang, r.source): (r.cell, sorted(r.feeds)) for r in cells.collect()} == {
        ("en", "large"): ('["en","large"]', ['["en","large"]', '["en"]', "[]"]),
        ("en", "small"): ('["en"]', ['["en"]', "[]"]),
        ("xx", "small"): ("[]", ["[]"]),
        ("xx", "other"): ("[]", ["[]"]),
    }


def expected_archives(pages):
    by = collections.defaultdict(list)
    for page, _, html in pages:
        by[html or ""].append(page)
    out = collections.Counter()
    for page, _, html in pages:
        body = html or ""
        ids = [p for p in by[body] if p is not None]
        first = min(ids) if ids and len(by[body]) > 1 and len(body.encode()) >= 100 else None
        again = first is not None and first != page
        out[(page, len(body.encode()), sha(body), "revisit" if again else "response", first if again else None, True)] += 1
    return out


def test_archives(spark):
    big = "<p>é" * 50
    pages = [(i, f"http://x/{i}", big) for i in (5, 3, 9)] + [(20, "u", None), (21, None, ""), (22, "u v", "short"), (23, "u", "short"), (24, "u", "a" * 2_000_000)]
    pages += [(None, "u", big), (None, None, None), (3, "http://x/3", big), (30, "u", "b" * 100), (31, "u", "b" * 100), (32, "u", "c" * 99), (33, "u", "c" * 99)]
    table = spark.createDataFrame([(*p, "other") for p in pages], "page_id long, url string, html string, digest string")
    assert counted(warc.archive_report(table)) == expected_archives(pages)
    assert warc.archive_report(table.limit(0)).count() == 0


def test_archives_of_many_empty_pages(spark):
    """Pages too short for revisits, half of all, take no part in the search for first payloads."""
    pages = [(i, "u", ("", None, "p" * 120, f"{i:0200d}")[i % 4]) for i in range(400)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    assert counted(warc.archive_report(table)) == expected_archives(pages)
    assert sorted(tuple(r) for r in warc.decide(table).select("page_id", "first").collect()) == [(i, 2) for i in range(2, 400, 4)]
    assert warc.decide(table.where("page_id % 4 < 2")).count() == 0


def test_revisits_are_compared_with_their_response(spark, tmp_path):
    body, other = b"x" * 300, b"y" * 300
    digest, wrong = hashlib.sha256(body).hexdigest(), hashlib.sha256(other).hexdigest()
    records = [
        (warc.member(1, "u", body, digest, None, False), True),
        (warc.member(2, "u", body, digest, 1, True), True),
        (warc.member(3, "u", other, wrong, 1, True), False),  # another payload than its response
        (warc.member(4, "u", body[:-1], digest, 1, True), False),  # another length
        (warc.member(5, "u", body, digest, 77, True), False),  # no such response
        (warc.member(6, "u", body, digest, 2, True), False),  # refers to a revisit
        (warc.member(7, "u", body, wrong, None, False), False),  # a damaged response
        (warc.member(8, "u", body, wrong, 7, True), False),  # and its revisit
        (warc.member(9, "u", body, digest, None, True), False),  # refers to nothing
    ]
    (tmp_path / "part-0").write_bytes(b"".join(m for m, _ in records))
    read = warc.read_archives(spark, str(tmp_path)).persist()
    out = warc.with_checked_revisits(read)
    assert out.columns == read.columns
    assert sorted((r.page_id, r.digest_ok) for r in out.collect()) == [(i, ok) for i, (_, ok) in enumerate(records, 1)]


def test_a_record_of_over_16_mib(spark):
    import random

    body = random.Random(1).randbytes(9 << 20).hex()
    out = warc.archive_report(spark.createDataFrame([(1, "u", body), (2, "u", "x" * 200)], "page_id long, url string, html string"))
    assert {(r.page_id, r.payload_bytes, r.digest_ok) for r in out.collect()} == {(1, 18 << 20, True), (2, 200, True)}


def test_simhash(docs, empty):
    rows = tables.rows()
    prints = {(d, t): simhash.fingerprint(t) for d, t, _, _ in rows}
    values = sorted(set(prints.values()))
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for (doc, _), v in prints.items():
        if doc is not None:
            least[find(v)] = min(doc, least.get(find(v), doc))
    want = collections.Counter((d, f"{prints[d, t]:016x}", least.get(find(prints[d, t]))) for d, t, _, _ in rows)
    assert counted(simhash.near_duplicates(docs)) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (41, 40), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(42)}, **{i: 100 for i in range(100, 150)}, 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    tables.benchmark(spark).coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        now = stage(spark, now, str(tmp_path))
        now = corpus_pipeline.store(now, name)
        after = now.collect()
        seen[name] = (before, after)
        if name != "byte_bpe":
            assert now.columns == docs.columns
    before, after = seen["language_id"]
    lost = [r for r in before if r not in after]
    assert all(not re.search(r"[^\W\d_]", r.text or "") for r in lost if r.doc_id is not None and r.doc_id < 100) and {110, 111, 112, 113} <= {r.doc_id for r in lost}
    before, after = seen["line_dedup"]
    assert len(before) == len(after) and sum(r.n_chars for r in after) < sum(len(r.text) for r in before)
    before, after = seen["simhash"]
    by = collections.defaultdict(list)
    for r in simhash.near_duplicates(spark.createDataFrame(before, docs.schema)).collect():
        by[r.component_id].append(r.doc_id)
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(d for c, ds in by.items() for d in ds if d is not None and d == c)
    before, after = seen["decontaminate"]
    assert not any("passage38 passage39" in r.text for r in after if r.doc_id is not None) and len(before) > len(after)
    before, after = seen["byte_bpe"]
    assert collections.Counter(r.decoded_sha256 for r in after) == collections.Counter(sha(r.text) for r in before)
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == collections.Counter(map(tuple, after))


def test_held_out_queries(spark):
    from finops_spark.llm.registry import op4_toxicity, op6_language_id

    folder = "/root/testdata/sf0.001"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op6_language_id(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(rows) == len(langs)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)
    scored = op4_toxicity(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in scored) and len(scored) == len(langs)
