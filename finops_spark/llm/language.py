"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary n-gram classifier (naive
Bayes over hashed letter bigrams and trigrams) tells the languages with a 1 from those
with a 0. Decoding sums, over the bits, a loss of the classifier's margin weighted by how
well that bit separates its two sides, and takes the language of least loss; a small
lead over the second language marks the text as ambiguous.
"""

from __future__ import annotations

import dataclasses
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finops_spark.llm.common import blocks

UNKNOWN = "und"
#: Hash buckets of n-grams; a power of two.
BUCKETS = 1 << 13
#: Lead over the second language, in probability, below which a text is ambiguous.
LEAD = 0.2
#: Up to so many languages every two-way division of them is a bit; beyond, random divisions.
EXHAUSTIVE = 6
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x BUCKETS) counts of lower-case letter bigrams and trigrams, with one space
    for anything that is not a letter, and whether each text has a letter."""
    counts = np.zeros((len(texts), BUCKETS), np.float32)
    letters = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        if len(codes):
            letter = is_letter(codes)
            letters[i] = letter.any()
            if letters[i]:
                codes = np.where(letter, codes, np.uint32(32))
                # a run of other characters is one space, and the text stands between two
                keep = letter | np.r_[True, letter[:-1]]
                c = np.r_[np.uint64(32), codes[keep].astype(np.uint64), np.uint64(32)]
                two = c[:-1] * _MIX[0] + c[1:] * _MIX[1]
                three = two[:-1] + c[2:] * _MIX[2] + np.uint64(1)
                h = np.concatenate([two, three])
                h ^= h >> np.uint64(32)
                h *= _MIX[0]
                counts[i] = np.bincount((h >> np.uint64(64 - 13)).astype(np.int64), minlength=BUCKETS)
    return counts, letters


_LETTER_TABLE = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def is_letter(codes: np.ndarray) -> np.ndarray:
    if codes.max() < 0x10000:
        return _LETTER_TABLE[codes]
    return np.fromiter((chr(c).isalpha() for c in codes.tolist()), bool, len(codes))


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """(languages x bits) of -1 and 1, no bit constant, no bit twice.

    Up to EXHAUSTIVE languages: all divisions in two. More: the best of some random
    codes of 15 bits for each doubling of the number, by least distance of two words."""
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= EXHAUSTIVE:
        bits = [(1, *rest) for rest in itertools.product((-1, 1), repeat=languages - 1) if -1 in rest]
        return np.array(bits, np.int8).T
    rng = np.random.default_rng(seed)
    width = 15 * int(np.ceil(np.log2(languages)))
    best, spread = None, -1
    while spread < 0:
        for _ in range(30):
            code = rng.choice(np.array([-1, 1], np.int8), (languages, width))
            if (np.abs(code.astype(int).sum(0)) == languages).any():
                continue
            product = code.astype(int) @ code.T.astype(int) - 2 * width * np.eye(languages, dtype=int)
            if (least := int((width - product.max()) // 2)) > spread and least > 0:
                best, spread = code, least
    return best


@dataclasses.dataclass
class LanguageModel:
    """languages; codes (languages x bits); weights (BUCKETS x bits); trust (bits)."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """(texts x languages) probabilities from the losses of all bits."""
        if not self.codes.shape[1]:
            return np.ones((len(counts), len(self.languages)))
        grams = np.maximum(counts.sum(1, keepdims=True), 1)
        # the mean margin of a gram times the root of their number: longer texts are surer, but not without bound
        margins = (counts @ self.weights) / np.sqrt(grams)
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None])
        total = (loss * self.trust).sum(2)
        odds = np.exp(total.min(1, keepdims=True) - total)
        return odds / odds.sum(1, keepdims=True)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        counts, letters = ngram_counts(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        p = self.scores(counts)
        best = p.argmax(1)
        top = p[np.arange(len(p)), best]
        second = np.partition(p, -2, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, top, 0.0), letters & (top - second < LEAD)


def fit_language_model(labelled: DataFrame) -> LanguageModel:
    """Learn from the columns ``text`` and ``lang`` of every given row; rows without
    either are passed over, texts without a letter add nothing.

    Each task adds up its n-grams by language, Spark adds up the tasks, and the driver
    gets BUCKETS counts for each language: languages are few, whatever the rows."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            at = 0
            for part in blocks(texts, 1 << 20):
                counts, _ = ngram_counts(part)
                names = np.array(langs[at : at + len(part)], object)
                at += len(part)
                for name in set(names.tolist()):
                    # a document counts by the root of its length: a few huge texts don't outweigh the others
                    rows = counts[names == name]
                    rows = rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))
                    totals[name] = totals.get(name, 0) + np.round(rows.sum(0) * 1024).astype(np.int64)
        for name, total in totals.items():
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(full), "bucket": full.astype(np.int32), "n": total[full]})

    usable = labelled.where("text is not null and lang is not null").select("lang", "text")
    rows = usable.mapInArrow(summed, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in rows})
    totals = np.zeros((len(languages), BUCKETS))
    place = {name: i for i, name in enumerate(languages)}
    for r in rows:
        totals[place[r.lang], r.bucket] = r.n / 1024
    return model_from_counts(languages, totals)


def model_from_counts(languages: list[str], totals: np.ndarray) -> LanguageModel:
    codes = codewords(len(languages))
    share = (totals + 0.5) / (totals + 0.5).sum(1, keepdims=True)
    weights = np.zeros((BUCKETS, codes.shape[1]), np.float32)
    trust = np.ones(codes.shape[1])
    for bit in range(codes.shape[1]):
        one, zero = share[codes[:, bit] > 0].mean(0), share[codes[:, bit] < 0].mean(0)
        weights[:, bit] = np.log(one / zero)
        # a bit counts by how far its two sides lie apart (Jensen-Shannon divergence)
        middle = (one + zero) / 2
        trust[bit] = (one * np.log(one / middle) + zero * np.log(zero / middle)).sum() / 2
    if len(trust):
        trust /= trust.mean()
    return LanguageModel(languages, codes, weights, trust)


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add lang_pred, score (0 to 1) and ambiguous to every row.

    A NULL text, an empty one, or one without a letter is ``und`` with score 0 and not
    ambiguous; so is every row if nothing was learned. Columns of these names are
    replaced, all others stay; whole texts are read.
    """
    packed = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits numbers

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = packed.value
        for texts in batches:
            parts = [pd.DataFrame(dict(zip(("lang_pred", "score", "ambiguous"), known.predict(p), strict=True))) for p in blocks(texts, 1 << 20)]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": [], "score": [], "ambiguous": []})

    names = ("lang_pred", "score", "ambiguous")
    return docs.withColumn("_told", told("text")).withColumns({n: F.col(f"_told.{n}") for n in names}).drop("_told")


def save_model(model: LanguageModel) -> str:
    """The model as text, for keeping beside its predictions."""
    return json.dumps({"languages": model.languages, "codes": model.codes.tolist(), "weights": model.weights.tolist(), "trust": model.trust.tolist()})


def load_model(text: str) -> LanguageModel:
    d = json.loads(text)
    shape = (len(d["languages"]), -1)
    return LanguageModel(d["languages"], np.array(d["codes"], np.int8).reshape(shape), np.array(d["weights"], np.float32), np.array(d["trust"]))
