"""Token counts by rank-synchronous array merging.

All pre-tokens of a batch lie in one ragged array of symbol ids. In each round every
sequence finds its lowest merge rank, all its pairs of that rank are joined at once
(left to right where they overlap), and sequences without a pair leave with the
number of symbols they have left. The vocabulary is a file of the ``tokenizers``
library of the kind: NFC, white space, lower case, split pattern, byte alphabet,
merges with an end-of-word mark.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finops_spark.llm.common import blocks

#: Characters with the Unicode property White_Space, which the vocabulary's \s stands for (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[^{WHITE}]+")
_NONE = np.int64(2**62)
#: Runs whose counts a worker remembers; beyond it the older half stays.
REMEMBERED = 600_000
#: Longer runs are forgotten after their block, so that memory is bounded in characters, too.
LONGEST = 64


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if visible Latin-1, else the next free code from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


class MergeTable:
    """The merges of one vocabulary file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.size = np.int64(max(vocab.values()) + 1)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.lines = regex.compile(f"\n|{split['pattern']['Regex']}")
        special = [regex.escape(t["content"]) for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(special)) if special else None
        self._known: dict[str, int] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE)

    def symbols_left(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols each non-empty byte sequence keeps when no merge applies any more."""
        counts = np.zeros(len(pieces), np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ids, owner = self.inner[flat], np.repeat(np.arange(len(pieces)), lengths)
        ends = np.cumsum(lengths) - 1
        ids[ends] = self.final[flat[ends]]
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank = np.full(len(ids), _NONE)
            rank[:-1] = np.where(owner[1:] == owner[:-1], self.rank_of(ids[:-1], ids[1:]), _NONE)
            sizes = np.diff(np.r_[starts, len(ids)])
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == _NONE
            counts[owner[starts[done]]] = sizes[done]
            hit = (rank == np.repeat(lowest, sizes)) & (rank != _NONE)
            # overlapping pairs of one rank (as in "aaa"): every second one counts, from the left
            place = np.arange(len(ids))
            first = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            hit &= (place - first) % 2 == 0
            ids[hit] = self.made[rank[hit]]
            stay = ~np.r_[False, hit[:-1]] & np.repeat(~done, sizes)
            ids, owner = ids[stay], owner[stay]
        return counts

    def _pieces(self, chunk: str) -> tuple[list[bytes], int]:
        """Byte sequences of a run without white space, and the special tokens in it."""
        parts = self.special.split(chunk) if self.special else [chunk]
        found: list[bytes] = []
        for part in parts:
            found += [m.encode() for m in self.pattern.findall(normalized(part))]
        return found, len(parts) - 1

    def _learn(self, fresh: list[str]) -> None:
        """Count the tokens of new runs, all in one array."""
        known = self._known
        pieces: list[bytes] = []
        owners: list[int] = []
        if self.special:
            special = [c for c in fresh if self.special.search(c)]
            fresh = special + list(set(fresh).difference(special)) if special else fresh
            for i, chunk in enumerate(special):
                found, known[chunk] = self._pieces(chunk)
                pieces += found
                owners += [i] * len(found)
        else:
            special = []
        # the rest in one string, a line each; nothing in the normal form or the pattern crosses a line
        at = len(special)
        for match in self.lines.findall(normalized("\n".join(fresh[at:]))):
            if match == "\n":
                at += 1
            else:
                pieces.append(match.encode())
                owners.append(at)
        if pieces:
            sums = np.bincount(owners, self.symbols_left(pieces), len(fresh)).astype(np.int64).tolist()
            for chunk, n in zip(fresh, sums, strict=True):
                known[chunk] = known.get(chunk, 0) + n
        else:
            known.update(dict.fromkeys(fresh, 0) | {c: known[c] for c in special})

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. No token crosses white space, so distinct runs without it are counted once."""
        chunked = [_CHUNK.findall(t) for t in texts]
        if len(self._known) > REMEMBERED:  # the oldest are the most common ones
            self._known = dict(itertools.islice(self._known.items(), REMEMBERED // 2))
        if fresh := list(set().union(*chunked).difference(self._known)):
            self._learn(fresh)
        sums = [sum(map(self._known.__getitem__, chunks)) for chunks in chunked]
        for chunk in fresh:
            if len(chunk) > LONGEST:
                del self._known[chunk]
        return sums


def normalized(text: str) -> str:
    """The vocabulary's normal form: NFC, then each character lower-cased on its own."""
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    # only the capital sigma depends on its place when a whole string is lower-cased
    return "σ".join(part.lower() for part in text.split("Σ"))


@functools.lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def token_count(text: Column, vocabulary: str) -> Column:
    """Number of tokens of a text column; NULL counts as empty, so 0."""

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = merge_table(vocabulary)
        for texts in batches:
            yield pd.Series([n for part in blocks(texts) for n in table.counts(part)], dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    A NULL or empty text has 0 bytes and 0 tokens. A NULL doc_id and repeated rows
    are kept as they are; other columns are ignored. A text of any length is counted
    whole: it costs memory in proportion to itself.
    """
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        token_count(F.col("text"), vocabulary).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
