"""Byte-level BPE by prefix dynamic programming.

For each prefix of a byte string the last token of its encoding is unique: it is the
token that ends there and fits the last token of the prefix before it. So one table
of last tokens holds the encodings of all prefixes, an append continues the table,
and an edit recomputes it only until it agrees with the old one again.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finops_spark.llm.common import blocks

#: Pieces and token pairs that a worker remembers; beyond it the older half stays (of the pairs: none).
REMEMBERED = 600_000
#: Longer pieces are forgotten after their block, so that memory is bounded in characters, too.
LONGEST = 64
_NEVER = 1 << 60
#: Bytes up to which looking up every substring is quicker than the automaton.
_SHORT = 48


class Vocabulary:
    """Ranks of a file with one base64 token and its rank a line."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        self.matcher = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            self.matcher.add_word(token.decode("latin-1"), (rank, len(token)))
        self.matcher.make_automaton()
        self.longest = max(map(len, self.ranks))
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._fits: dict[int, bool] = {}
        self._known: dict[str, bytes] = {}

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        token = self.tokens[rank]
        if len(token) == 1:
            return None
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], _NEVER))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def edge(self, rank: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one edge of a token while it is being merged:
        (symbol, rank of the merge that ends it), from the token itself down to a byte."""
        spines = self._right if side else self._left
        if rank not in spines:
            spine, at, ends = [], rank, _NEVER
            while True:
                spine.append((at, ends))
                if (parts := self.halves(at)) is None:
                    break
                at, ends = parts[side], at
            spines[rank] = spine
        return spines[rank]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives exactly these two tokens,
        that is, no merge across the border comes before the merges that use up its sides.
        At equal rank the merge further left comes first."""
        key = left << 20 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2 * REMEMBERED:
                self._fits.clear()
            known = self._fits[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        ranks, tokens = self.ranks, self.tokens
        for x, x_ends in self.edge(left, 1):
            born_x = x if len(tokens[x]) > 1 else -1
            for y, y_ends in self.edge(right, 0):
                born_y = y if len(tokens[y]) > 1 else -1
                if born_x >= y_ends or born_y >= x_ends:
                    continue  # never side by side
                merge = ranks.get(tokens[x] + tokens[y])
                if merge is not None and merge < x_ends and merge <= y_ends:
                    return False
        return True

    def extend(self, last: list[int], data: bytes) -> None:
        """Continue the table ``last`` (one entry for each prefix, -1 for the empty one) over all of ``data``."""
        done = len(last) - 1
        known, fits = self._fits.get, self.fits
        if len(data) <= _SHORT:
            rank = self.ranks.get
            for end in range(done + 1, len(data) + 1):
                if (whole := rank(data[:end])) is not None:
                    last.append(whole)
                    continue
                for start in range(1, end):
                    token = rank(data[start:end])
                    if token is not None:
                        before = last[start]
                        fit = known(before << 20 | token)
                        if fit or fit is None and fits(before, token):
                            last.append(token)
                            break
            return
        last += [-1] * (len(data) - done)
        for end, (token, size) in self.matcher.iter(data.decode("latin-1"), max(0, done + 1 - self.longest)):
            end += 1
            if last[end] < 0 and end > done:
                if end == size:
                    last[end] = token
                else:
                    before = last[end - size]
                    fit = known(before << 20 | token)
                    if fit or fit is None and fits(before, token):
                        last[end] = token

    def path(self, last: list[int]) -> list[int]:
        """The tokens of the longest prefix in a table."""
        found, at = [], len(last) - 1
        while at:
            found.append(last[at])
            at -= len(self.tokens[last[at]])
        return found[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        last = [-1]
        self.extend(last, data)
        return self.path(last)

    def _learn(self, fresh: list[bytes]) -> None:
        """Encode new pieces in byte order: each takes over the table of the prefix it shares with the one before."""
        last, before = [-1], b""
        for data in sorted(fresh):
            if (whole := self.ranks.get(data)) is not None:
                ids = [whole]
            else:
                shared, most = 0, min(len(data), len(before))
                while shared < most and data[shared] == before[shared]:
                    shared += 1
                del last[shared + 1 :]
                self.extend(last, data)
                before, ids = data, self.path(last)
            self._known[data.decode()] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str], pattern: regex.Pattern) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, each match of the pattern on its own."""
        pieces = [pattern.findall(text) for text in texts]
        if len(self._known) > REMEMBERED:  # the oldest are the most common ones
            self._known = dict(itertools.islice(self._known.items(), REMEMBERED // 2))
        fresh = set().union(*pieces).difference(self._known)
        self._learn([p.encode() for p in fresh])
        ids = [b"".join(map(self._known.__getitem__, p)) for p in pieces]
        for piece in fresh:
            if len(piece) > LONGEST:
                del self._known[piece]
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class PrefixTable:
    """The encodings of all prefixes of one piece, kept while the piece changes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.vocabulary.extend(self.last, self.data)

    def ids(self, length: int | None = None) -> list[int]:
        """Tokens of the first ``length`` bytes; of all of them by default."""
        return self.vocabulary.path(self.last[: (len(self.data) if length is None else length) + 1])

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace data[start:stop]; returns how many entries were computed again.

        An entry depends on at most ``longest`` bytes and entries before it, so once
        that many in a row agree with the old table, the rest of it holds."""
        tail, kept = self.data[stop:], self.last[stop + 1 :]
        self.data = self.data[:start] + new
        del self.last[start + 1 :]
        self.vocabulary.extend(self.last, self.data)
        computed, at, agree, step = len(new), 0, 0, self.vocabulary.longest
        while at < len(tail):
            if agree >= step:
                self.data += tail[at:]
                self.last += kept[at:]
                break
            part = tail[at : at + step]
            self.data += part
            self.vocabulary.extend(self.last, self.data)
            for token, old in zip(self.last[-len(part) :], kept[at : at + len(part)], strict=True):
                agree = agree + 1 if token == old else 0
            computed, at = computed + len(part), at + len(part)
        return computed


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit token ids) and ``decoded``
    (binary: the bytes those ids stand for) to every row; NULL text is empty.
    Other columns stay; a column named ids or decoded is replaced."""

    @F.pandas_udf("ids binary, decoded binary")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, compiled = vocabulary(ranks), regex.compile(pattern)
        for texts in batches:
            ids = [i for part in blocks(texts) for i in words.encode(part, compiled)]
            yield pd.DataFrame({"ids": ids, "decoded": [words.decode(i) for i in ids]})

    return docs.withColumn("_coded", coded("text")).withColumns({"ids": F.col("_coded.ids"), "decoded": F.col("_coded.decoded")}).drop("_coded")


def token_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids and decoded bytes are made and hashed in the same task, so only digests leave
    it. NULL and empty texts have 0 tokens and the digest of nothing; a NULL doc_id and
    repeated rows stay; other columns are ignored.
    """

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digested(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, compiled = vocabulary(ranks), regex.compile(pattern)
        for texts in batches:
            rows = []
            for part in blocks(texts):
                for ids in words.encode(part, compiled):
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(words.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digested("text").alias("d")).select("doc_id", "d.*")
