"""Byte-level BPE by prefix dynamic programming: the last token of every prefix, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F


#: Pieces whose encoding a worker remembers, and token pairs whose compatibility it remembers; then it starts afresh.
KEEP_PIECES = 400_000
KEEP_PAIRS = 2_000_000
#: Texts up to this many characters are split at once, longer ones in runs of as many pieces.
RUN = 1 << 18
#: Ids that a task hands on at once (a longer text goes alone).
OUT_TOKENS = 1 << 20


class Vocabulary:
    """Tokens by rank. A rank is both a token's id and its priority: the pair that makes the lowest rank merges first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks), default=0)
        self.starts = {t[:i] for t in ranks for i in range(1, len(t) + 1)}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Plain merging, lowest rank first, leftmost on ties: what decides whether two tokens can be neighbours."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` can stand after ``last``: merging their bytes gives just these two (last < 0: at the start)."""
        key = (last, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEEP_PAIRS:
                self.pairs.clear()
            if last < 0:
                known = self.merge(self.tokens[token]) == [token]
            else:
                known = self.merge(self.tokens[last] + self.tokens[token]) == [last, token]
            self.pairs[key] = known
        return known

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece. A piece that is a token as a whole is that token."""
        whole = self.ranks.get(piece)
        return (whole,) if whole is not None else tuple(PrefixTable(self, piece).ids())

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


class PrefixTable:
    """The last token of the encoding of every prefix of a piece.

    An encoding is valid if and only if each two neighbours are compatible, and a prefix has one valid encoding. So a
    prefix's last token is the one token that ends there and follows the last token of what is before it. The table of
    a longer piece starts with that of a shorter one: appending needs only new entries, and after a change the entries
    are the old ones again once as many in a row agree as the longest token has bytes.
    """

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def _find(self, end: int) -> int:
        """The last token of the prefix of ``end`` bytes, from the entries before it."""
        v = self.vocabulary
        for start in range(max(0, end - v.longest), end):
            token = v.ranks.get(self.piece[start:end])
            if token is not None and v.follows(self.last[start], token):
                return token
        raise ValueError(f"no token ends at byte {end}: the vocabulary lacks single bytes")

    def append(self, more: bytes) -> PrefixTable:
        if self.piece:
            for b in more:
                self.piece += bytes((b,))
                self.last.append(self._find(len(self.piece)))
            return self
        v, ranks, starts, follows = self.vocabulary, self.vocabulary.ranks, self.vocabulary.starts, self.vocabulary.follows
        self.piece, last, size = more, [-1] * (len(more) + 1), len(more)
        for at in range(size):
            before = last[at]
            if at and before < 0:
                raise ValueError(f"no token ends at byte {at}: the vocabulary lacks single bytes")
            for end in range(at + 1, min(size, at + v.longest) + 1):
                part = more[at:end]
                if part not in starts:
                    break
                token = ranks.get(part)
                if token is not None and last[end] < 0 and follows(before, token):
                    last[end] = token
        if size and last[size] < 0:
            raise ValueError(f"no token ends at byte {size}: the vocabulary lacks single bytes")
        self.last = last
        return self

    def replace(self, start: int, stop: int, by: bytes) -> int:
        """Put ``by`` in the place of bytes start..stop; returns how many entries had to be found anew."""
        old, shift = self.last, len(by) - (stop - start)
        self.piece = self.piece[:start] + by + self.piece[stop:]
        self.last, same, found = old[: start + 1], 0, 0
        for end in range(start + 1, len(self.piece) + 1):
            token = self._find(end)
            self.last.append(token)
            found += 1
            same = same + 1 if end - shift > stop and old[end - shift] == token else 0
            if same >= self.vocabulary.longest:
                self.last += old[end - shift + 1 :]
                break
        return found

    def ids(self) -> list[int]:
        out, at = [], len(self.piece)
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(self.vocabulary.tokens[token])
        return out[::-1]


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file whose lines are a token in base 64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


@lru_cache(maxsize=2)
def _vocabulary(data: bytes) -> Vocabulary:
    return Vocabulary(parse_ranks(data))


class Encoder:
    """Encodes whole texts: each match of ``pattern`` by itself; remembers the pieces it meets, up to a bound."""

    def __init__(self, data: bytes, pattern: str):
        self.vocabulary = _vocabulary(data)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}

    def runs(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, in runs of bounded length."""
        if len(text) <= RUN:
            yield self._ids(self.pattern.findall(text))
            return
        matches = self.pattern.finditer(text)
        while pieces := [m.group() for m in islice(matches, RUN)]:
            yield self._ids(pieces)

    def _ids(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > KEEP_PIECES:
            known.clear()
        for piece in set(pieces).difference(known):
            known[piece] = self.vocabulary.encode(piece.encode())
        return [i for piece in pieces for i in known[piece]]


@lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str) -> Encoder:
    return Encoder(data, pattern)


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """Encode every text of ``docs`` by the ranks in ``path``; without special tokens.

    Returns doc_id and ids (array<int>); with ``digests`` instead n_tokens, ids_sha256 (of the decimal ids joined by
    commas) and decoded_sha256 (of the bytes that the ids decode to), and no arrays. The driver reads the file (a
    vocabulary of about 1 MB) and sends it with the task. Null counts as empty: no ids. Other columns are not read;
    repeated rows give repeated rows.
    """
    data = read_file(path)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data, pattern)
        decimal = [str(i) for i in range(len(encoder.vocabulary.tokens))]
        for batch in batches:
            counts, firsts, seconds = [], [], []
            for text in batch.column(1):
                n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                for ids in encoder.runs(text.as_py() or ""):
                    if ids:
                        of_ids.update(("," * (n > 0) + ",".join([decimal[i] for i in ids])).encode())
                        of_bytes.update(encoder.vocabulary.decode(ids))
                        n += len(ids)
                counts.append(n)
                firsts.append(of_ids.hexdigest())
                seconds.append(of_bytes.hexdigest())
            columns = [pa.array(counts, pa.int64()), pa.array(firsts, pa.string()), pa.array(seconds, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data, pattern)
        for batch in batches:
            start, held, arrays = 0, 0, []
            for at, text in enumerate(batch.column(1), 1):
                parts = [np.array(ids, np.int32) for ids in encoder.runs(text.as_py() or "")]
                arrays.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
                held += len(arrays[-1])
                if held >= OUT_TOKENS or at == batch.num_rows:
                    ids = batch.column(0).slice(start, at - start)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(arrays, pa.list_(pa.int32()))], names=["doc_id", "ids"])
                    start, held, arrays = at, 0, []

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(summed if digests else listed, f"doc_id {kind}, {more}")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Decode (doc_id, ids) to (doc_id, text): null ids give null; bytes that are no UTF-8 become U+FFFD."""
    data = read_file(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(data)
        for batch in batches:
            texts = [None if x is None else vocabulary.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
