"""Parts that need no Spark: against the libraries, exact round trips, brute force."""

import base64
import random
import re

import numpy as np
import public_tokenizers
import pytest
import regex
import tables
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from finops_spark.llm import language, simhash, substring_dedup, toxicity, warc
from finops_spark.llm.byte_bpe import PrefixTable, vocabulary
from finops_spark.llm.token_counts import merge_table

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = regex.compile(public_tokenizers.PATTERN)
TEXTS = [t for _, t, _, _ in tables.rows() if t]
odd_text = st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60) | st.text(alphabet="aAsStT' \n\t'12éΣßﬁ\x85,.<|>", max_size=60)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_match_the_library(tokenizer):
    texts = [*TEXTS, "<|endoftext|>a <|STARTOFTEXT|><|startoftext|>", "a" * 300, ""]
    assert merge_table(WORD).counts(texts) == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(deadline=None, max_examples=200)
@given(odd_text)
def test_counts_of_odd_texts(tokenizer, text):
    assert merge_table(WORD).counts([text]) == [len(tokenizer.encode(text, add_special_tokens=False).ids)]


def test_ids_match_the_library(encoding):
    found = vocabulary(BYTE).encode([*TEXTS, ""], PATTERN)
    assert [np.frombuffer(i, "<u4").tolist() for i in found] == [encoding.encode_ordinary(t) for t in [*TEXTS, ""]]
    assert [vocabulary(BYTE).decode(i).decode() for i in found] == [*TEXTS, ""]


def test_long_runs_are_counted_and_forgotten(tokenizer, encoding):
    """Runs without white space, repeated in a text and over calls, are right each time and never remembered."""
    long = ["语言模型" * 400, "QUJD" * 3_000 + "=", "<|endoftext|>" * 40, "https://a.b/" + "c" * 500]
    texts = [f"{x} and {x} {y}" for x, y in zip(long, long[1:] + long[:1], strict=True)]
    table, words = merge_table(WORD), vocabulary(BYTE)
    for _ in range(2):
        assert table.counts(texts) == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        found = words.encode(texts, PATTERN)
        assert [np.frombuffer(i, "<u4").tolist() for i in found] == [encoding.encode_ordinary(t) for t in texts]
    assert max(map(len, table._known)) <= 64 and max(map(len, words._known)) <= 64


@settings(deadline=None, max_examples=300)
@given(odd_text)
def test_odd_texts_round_trip(text):
    (ids,) = vocabulary(BYTE).encode([text], PATTERN)
    assert vocabulary(BYTE).decode(ids) == text.encode()


@settings(deadline=None, max_examples=200)
@given(st.binary(max_size=80), st.data())
def test_appends_and_edits_equal_a_new_table(data, draw):
    words = vocabulary(BYTE)
    at = draw.draw(st.integers(0, len(data)))
    stop = draw.draw(st.integers(at, len(data)))
    table = PrefixTable(words, data[:at])
    table.append(data[at:])
    assert table.last == PrefixTable(words, data).last
    table.edit(at, stop, b" the new")
    again = PrefixTable(words, data[:at] + b" the new" + data[stop:])
    assert (table.data, table.last) == (again.data, again.last)
    assert words.decode(np.array(table.ids(), "<u4").tobytes()) == table.data


def test_an_edit_near_the_start_of_a_long_piece_stops_early():
    words = vocabulary(BYTE)
    table = PrefixTable(words, b"".join(bytes([97 + i % 7, 101, 110]) for i in range(4000)))
    assert table.edit(10, 12, b"zz") < 1500


def test_a_limit_on_what_is_remembered_changes_nothing(monkeypatch):
    from finops_spark.llm import byte_bpe, token_counts

    want = (merge_table(WORD).counts(TEXTS), vocabulary(BYTE).encode(TEXTS, PATTERN))
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    small = [c for t in TEXTS for c in token_counts.MergeTable(WORD).counts([t])]
    fresh = byte_bpe.Vocabulary(BYTE)
    assert (small, [i for t in TEXTS for i in fresh.encode([t], PATTERN)]) == want


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_definition():
    for text in [*TEXTS[:70], None, "", "One", "Two words", "a b c d"]:
        if text is None or len(text) < 20_000:
            assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("at_once", [2_000_000, 3_000])
def test_ball_hashing_links_all_within_the_radius(monkeypatch, at_once):
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", at_once)
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for flips in (1, 2, 3, 4, 5, 6):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), flips)))
    values = np.array(sorted(values), np.uint64)
    width, pairs = 4, set()
    for prefix in range(1 << width):
        near = values[np.bitwise_count((values >> np.uint64(60)) ^ np.uint64(prefix)) <= 2]
        pairs |= set(map(tuple, simhash.linked(near, prefix, width, 2).tolist()))
    close = {(int(a), int(b)) for i, a in enumerate(values) for b in values[i + 1 :] if int(a ^ b).bit_count() <= 4}
    assert all((min(p), max(p)) in close for p in pairs)

    def groups(links):
        root = {int(v): int(v) for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(int(v)) for v in values]

    assert groups(pairs) == groups(close)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 5), min_size=20, max_size=80), st.integers(1, 16))
def test_least_of_windows(values, width):
    h = np.array(values, np.uint64)
    got = substring_dedup.least_of(h, width)
    want = [max(range(i, i + width), key=lambda j: (-values[j], j)) for i in range(len(values) - width + 1)]
    assert got.tolist() == want


def test_archive_reader_takes_any_step_and_finds_damage():
    import hashlib

    pages = [(1, "http://a/ b", b"x" * 300_000), (None, None, b""), (3, "http://c", "é\r\n\r\nWARC/1.1".encode())]
    digest = [hashlib.sha256(p).hexdigest() for _, _, p in pages]
    data = b"".join(warc.member(i, u, p, d, None, False) for (i, u, p), d in zip(pages, digest, strict=True)) + warc.member(9, "u", pages[0][2], digest[0], 1, True)
    for step in (1 << 16, 777):
        found = list(warc.ArchiveReader(data, step).records())
        assert [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["digest_ok"]) for r in found] == [
            *[(i, len(p), d, "response", None, True) for (i, _, p), d in zip(pages, digest, strict=True)],
            (9, 300_000, digest[0], "revisit", 1, True),
        ]
    import gzip

    parts = gzip.decompress(warc.member(3, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False))
    (bad,) = warc.ArchiveReader(gzip.compress(parts.replace(b"payload", b"PAYLOAD"))).records()
    assert not bad["digest_ok"]
    with pytest.raises(ValueError):
        list(warc.ArchiveReader(data[:-9]).records())
    with pytest.raises(ValueError):
        list(warc.ArchiveReader(gzip.compress(parts[:-12])).records())


def test_codewords_differ():
    for n in (0, 1, 2, 3, 5, 6, 7, 20):
        code = language.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == (n if n > 1 else n)
        assert all(set(c) == {-1, 1} for c in code.T.tolist())


def test_language_model_on_words_and_its_text_form():
    rng = random.Random(1)
    texts = [tables.sentence(rng, w, 30) for w in (tables.ENGLISH, tables.FRENCH) for _ in range(30)]
    counts, _ = language.ngram_counts(texts)
    model = language.model_from_counts(["en", "fr"], np.stack([counts[:30].sum(0), counts[30:].sum(0)]))
    new = [tables.sentence(rng, tables.ENGLISH, 12), tables.sentence(rng, tables.FRENCH, 12), "", "12 !", None or ""]
    names, scores, unsure = language.load_model(language.save_model(model)).predict(new)
    assert names == ["en", "fr", "und", "und", "und"] and (scores[:2] > 0.9).all() and not unsure.any()


def test_toxic_sentences_are_found():
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(300):
        parts = [tables.sentence(rng, tables.ENGLISH, 12) for _ in range(rng.randint(2, 12))]
        if i % 3 == 0:
            parts[rng.randrange(len(parts))] = f"the of {rng.choice(['vilest', 'nastyword', 'grossly'])} and this."
        texts.append(" ".join(parts))
        labels.append(float(i % 3 == 0))
    model = toxicity.train(texts[:200], np.array(labels[:200]))
    scores = np.array([model.score(t) for t in texts[200:]])
    assert ((scores >= 0.7) == (np.array(labels[200:]) > 0)).mean() > 0.97
    spans, p = model.sentence_scores("That was with this. You vilest one! And the rest.")
    assert int(np.argmax(p)) == 1 and spans[1][0] < 25
    for empty in ("", "...", "!!"):
        assert model.score(empty) == 0.0
    assert toxicity.train([], np.array([])).score("any text") < 1e-6
    assert toxicity.train(["a"], np.array([1.0])).score("any text") > 0.99


def test_toxic_counts_weigh_the_labels():
    rng = random.Random(3)
    texts = [tables.sentence(rng, tables.ENGLISH, 12) for _ in range(120)]
    labels = np.array([float(i % 2 == 0) for i in range(120)])
    texts = [f"{t} vilest" if (y > 0) == (i % 12 > 1) else t for i, (t, y) in enumerate(zip(texts, labels, strict=True))]
    plain, rare = (toxicity.train(texts, labels, counts=np.where(labels > 0, 1.0, n)) for n in (1.0, 20.0))
    assert rare.score("the vilest of this") < plain.score("the vilest of this") - 0.1
