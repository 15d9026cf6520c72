"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag has a label. A sentence has the
probability sigmoid(bias + the weights of its distinct words and their beginnings); the document is toxic
unless none of its sentences is (noisy-or). Weights are trained on document labels;
afterwards the sentence probabilities locate what made a document toxic.
"""

from __future__ import annotations

import array
import dataclasses
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words are hashed to so many weights.
BUCKETS = 1 << 18
#: At most so many labelled documents of either label are learned from: those with the smallest id hashes.
SAMPLE = 2_000
#: Words of the training sample that get a weight: at least so many documents hold them.
LEAST_DOCUMENTS = 4
#: Standard errors between the labels that make a word worth a weight; among 100,000 words chance gives a few.
CLEAR = 4.5
#: Step of a round, and the pull of a weight to 0.
RATE, SHRINK = 0.1, 5e-5
PREFIXES = (5, 7)
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")
_WORD = re.compile(r"[^\W_]+")


def buckets(word: str) -> list[int]:
    """Of a word: itself and, as languages inflect, its beginnings of PREFIXES letters."""
    parts = [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) > n)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for p in parts]


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of every sentence that holds a word; together they cover all words."""
    return [m.span() for m in _SENTENCE.finditer(text) if _WORD.search(m.group())]


@dataclasses.dataclass
class ToxicityModel:
    """A bias and one weight for each bucket; ``words`` remembers buckets of words in a worker."""

    bias: float
    weights: np.ndarray

    def __post_init__(self):
        self._known: dict[str, float] = {}

    def _weight(self, word: str) -> float:
        value = self._known.get(word)
        if value is None:
            if len(self._known) > 400_000:
                self._known.clear()
            value = self._known[word] = float(sum(self.weights[b] for b in buckets(word)))
        return value

    def sentence_scores(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Spans of the sentences and the probability that each is toxic."""
        spans, logits = [], []
        for start, end in sentences(text):
            words = set(_WORD.findall(text[start:end].lower()))
            spans.append((start, end))
            logits.append(self.bias + sum(map(self._weight, words)))
        return spans, 1 / (1 + np.exp(-np.clip(logits, -40, 40))) if logits else np.zeros(0)

    def score(self, text: str) -> float:
        """Noisy-or over the sentences; 0 for a text without one."""
        _, p = self.sentence_scores(text)
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def bounded_sample(labelled: DataFrame, most: int = SAMPLE) -> DataFrame:
    """For each label at most ``most`` rows, those of the smallest id hashes."""
    return counted_sample(labelled, most)[0]


def counted_sample(labelled: DataFrame, most: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """The rows of ``bounded_sample``, and how many rows each label has in all.

    A first pass finds, with one counter for each of 4,096 hash ranges, below which hash
    enough rows lie, so that only about as many as are wanted reach the exact cut."""
    hashed = labelled.withColumn("_h", F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")))
    hashed = hashed.withColumn("_range", F.shiftrightunsigned("_h", 52))
    counts = hashed.groupBy("toxic", "_range").count().collect()  # two labels x 4,096 ranges at most
    limits, totals = {}, {}
    for label in {r.toxic for r in counts}:
        held, totals[label] = 0, sum(r["count"] for r in counts if r.toxic == label)
        for r in sorted((r for r in counts if r.toxic == label), key=lambda r: r["_range"]):
            limits[label] = r["_range"]
            held += r["count"]
            if held >= most:
                break
    near = F.lit(False)
    for label, limit in limits.items():
        near = near | ((F.col("toxic") == label) & (F.col("_range") <= limit))
    order = Window.partitionBy("toxic").orderBy("_range", "_h", "doc_id", "text")
    return hashed.where(near).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_h", "_range", "_n"), totals


def fit_toxicity(labelled: DataFrame, most: int = SAMPLE, rounds: int = 300) -> ToxicityModel:
    """Learn from columns doc_id, text and toxic (0 or 1); NULL texts and labels are passed over.

    ``most`` bounds the documents of each label that are gathered for the fit; each counts for
    as many as its label has for one that is gathered, so the fit keeps the labels' own shares."""
    sample, totals = counted_sample(labelled.where("text is not null and toxic in (0, 1)").select("doc_id", "text", "toxic"), most)
    rows = sample.collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id, r.text))
    labels = np.array([r.toxic for r in rows], float)
    weight = {label: n / (labels == label).sum() for label, n in totals.items()}
    return train([r.text for r in rows], labels, rounds, np.array([weight[r.toxic] for r in rows], float))


def runs_of(values: np.ndarray) -> np.ndarray:
    """Positions where a run of equal entries starts."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def telling(found: np.ndarray, sentence: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Buckets whose share of documents differs between the labels by CLEAR standard errors.

    A document of which most sentences came before is a copy and does not count, or
    copies would make all their words look telling."""
    cuts = np.flatnonzero(np.diff(sentence, prepend=-1))
    seen: set[bytes] = set()
    fresh = np.zeros(len(labels), bool)
    documents = owner[sentence[cuts]] if len(cuts) else cuts
    ends = np.r_[cuts[1:], len(found)]
    for first in runs_of(documents):
        last = np.searchsorted(documents, documents[first], "right")
        keys = [found[a:b].tobytes() for a, b in zip(cuts[first:last], ends[first:last], strict=True)]
        fresh[documents[first]] = 2 * sum(k in seen for k in keys) <= len(keys)
        seen.update(keys)
    kept = fresh[owner[sentence]]
    held = np.unique(owner[sentence[kept]].astype(np.int64) * BUCKETS + found[kept])
    doc, word = held // BUCKETS, held % BUCKETS
    toxic, every = np.bincount(word[labels[doc] > 0], minlength=BUCKETS), np.bincount(word, minlength=BUCKETS)
    n1, n = labels.sum(), len(labels)
    share = every / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1 / n**2) * (1 / n1 + 1 / (n - n1)))
    apart = np.abs(toxic / n1 - (every - toxic) / (n - n1)) / spread
    return np.flatnonzero((apart >= CLEAR) & (every >= LEAST_DOCUMENTS))


def train(texts: list[str], labels: np.ndarray, rounds: int = 300, counts: np.ndarray | None = None) -> ToxicityModel:
    """Full-batch Adam on the shrunk noisy-or likelihood, a weight for each telling bucket.

    ``counts`` says for how many documents each text stands in the likelihood (1 if None). With one label only, or none, every document gets that label's share."""
    weights = np.zeros(BUCKETS, np.float32)
    counts = np.ones(len(labels)) if counts is None else counts
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel(40.0 if len(labels) and labels.min() == 1 else -40.0, weights)
    flat, of, documents = array.array("i"), array.array("i"), array.array("i")
    for d, text in enumerate(texts):
        for start, end in sentences(text):
            found = [b for w in sorted(set(_WORD.findall(text[start:end].lower()))) for b in buckets(w)]
            flat.extend(found)
            of.extend([len(documents)] * len(found))
            documents.append(d)
    flat, sentence, owner = (np.frombuffer(x, np.int32) if x else np.zeros(0, np.int32) for x in (flat, of, documents))
    column = telling(flat, sentence, owner, labels)
    place = np.full(BUCKETS, -1)
    place[column] = np.arange(len(column))
    rows, cols = sentence[place[flat] >= 0], place[flat][place[flat] >= 0]
    if not len(column):
        share = float(np.clip(np.average(labels, weights=counts), 1e-6, 1 - 1e-6))
        return ToxicityModel(float(np.log(share / (1 - share))) - 5, weights)
    # either label weighs as much as in the given data; the sample only bounds the work
    every = counts.sum()
    w, bias = np.zeros(len(column)), -5.0
    step_w, size_w, step_b, size_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        logit = np.clip(bias + np.bincount(rows, w[cols], len(owner)), -30, 30)
        p = 1 / (1 + np.exp(-logit))
        clean = np.minimum(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(labels)), -1e-9)
        # slope of the log likelihood in each sentence's logit
        slope = np.where(labels > 0, np.exp(clean) / -np.expm1(clean), -1.0)[owner] * p * counts[owner]
        grad_w, grad_b = np.bincount(cols, slope[rows], len(w)) / every - SHRINK * w, slope.sum() / every
        step_w, size_w = 0.9 * step_w + 0.1 * grad_w, 0.99 * size_w + 0.01 * grad_w**2
        step_b, size_b = 0.9 * step_b + 0.1 * grad_b, 0.99 * size_b + 0.01 * grad_b**2
        fix, grow = 1 - 0.9**t, 1 - 0.99**t
        w += RATE * (step_w / fix) / (np.sqrt(size_w / grow) + 1e-4)
        bias += RATE * (step_b / fix) / (np.sqrt(size_b / grow) + 1e-4)
    weights[column] = w
    return ToxicityModel(float(bias), weights)


def score_toxicity(docs: DataFrame, model: ToxicityModel, limit: float = 0.7) -> DataFrame:
    """Add score (0 to 1), predicted (1 from ``limit`` on) and sentences, the spans
    (start, end, probability) of every sentence that alone reaches half of ``limit``.

    A NULL or empty text, or one without a word, scores 0. Whole texts are read; columns
    of these names are replaced, all others stay.
    """
    packed = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights

    @F.pandas_udf("score double, sentences array<struct<start:int,end:int,probability:double>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = packed.value
        for texts in batches:
            rows = []
            for text in texts:
                spans, p = known.sentence_scores(text or "")
                score = float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))
                rows.append((score, [{"start": a, "end": b, "probability": float(q)} for (a, b), q in zip(spans, p, strict=True) if 2 * q >= limit]))
            yield pd.DataFrame(rows, columns=["score", "sentences"])

    out = docs.withColumn("_scored", scored("text")).withColumns({n: F.col(f"_scored.{n}") for n in ("score", "sentences")})
    return out.withColumn("predicted", (F.col("score") >= limit).cast("int")).drop("_scored")
