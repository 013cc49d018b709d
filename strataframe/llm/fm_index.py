"""Benchmark decontamination: an FM-index over the words of each shard of documents, searched for all benchmark passages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import lower_ascii, spare, stash

#: Words are runs of digits, lower-case letters and bytes beyond ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A passage is this many consecutive words of an item.
WINDOW = 10
#: Words in one index; a longer text is cut into pieces that overlap by a passage.
SHARD_WORDS = 1 << 20
#: Every so many words of a document the index stores where it is.
SAMPLE = 8
#: Passages sent to the tasks at once; more go in further passes over the documents.
BLOCK = 1 << 20
#: Occurrences located at once.
SLICE = 1 << 20

_CLASS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

HITS = StructType(
    [
        StructField("n_words", LongType()),
        StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
        StructField("items", ArrayType(StringType())),
    ]
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def split_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text; a character beyond ASCII lies wholly in bytes of 0x80 and more."""
    return text.translate(_CLASS).split() if text else []


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions in the order of the suffixes of ``symbols``, whose last one is found nowhere else.

    The first three symbols of all suffixes are sorted at once; after that only those still tied, by ranks that cover
    twice as many symbols each round.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    known = 3 if 3 * bits <= 62 else 2
    key = symbols.astype(np.int64)
    for step in range(1, known):
        key <<= bits
        key[: n - step] |= symbols[step:]
    order = np.argsort(key)
    key = key[order]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        alone = head & np.append(head[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order
        tied = order[slots]
        key = rank[tied] * np.int64(n) + rank[tied + known]
        again = np.argsort(key)
        tied, key = tied[again], key[again]
        order[slots] = tied
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        head[slots] = fresh
        rank[tied] = np.maximum.accumulate(np.where(fresh, slots, 0))
        known *= 2


class Wavelet:
    """Wavelet matrix of a symbol sequence: a bit vector for each bit of the symbols, with counts for every 64 positions."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.levels = range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1)
        self.words, self.ones, self.zeros = [], [], []
        counts = np.bincount(seq, minlength=n_symbols)
        for level in self.levels:
            bit = (seq >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(seq) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=ones[1:])
            self.words.append(words)
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        symbols = np.arange(n_symbols)
        reversed_bits = sum((symbols >> level & 1) << at for at, level in enumerate(self.levels))
        last = np.argsort(reversed_bits, kind="stable")  # the order of symbols after the last level
        first = np.empty(n_symbols, np.int64)
        first[last] = np.cumsum(counts[last]) - counts[last]
        self.before = np.cumsum(counts) - counts  # symbols smaller than this one
        #: Added to a position after the last level: the row of the suffix that begins with the symbol.
        self.shift = self.before - first
        self.counts = counts

    def _rank(self, at: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[at][word] + np.bitwise_count(self.words[at][word] & below)

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """``before[symbol]`` plus the count of the symbol ahead of position i."""
        for at, level in enumerate(self.levels):
            one = self._rank(at, i)
            i = np.where(symbol >> level & 1, self.zeros[at] + one, i - one)
        return i + self.shift[symbol]

    def back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one symbol longer than that of row i."""
        symbol = np.zeros(len(i), np.int64)
        for at, level in enumerate(self.levels):
            one = self._rank(at, i)
            bit = (self.words[at][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            symbol |= bit << level
            i = np.where(bit, self.zeros[at] + one, i - one)
        return i + self.shift[symbol]


class FmIndex:
    """Index of several word sequences: ``find`` gives every place where a passage stands."""

    def __init__(self, pieces: Sequence[Sequence[bytes]], sample: int = SAMPLE):
        self.ids: dict[bytes, int] = {}
        number = self.ids.setdefault
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        n = int((sizes + 1).sum())
        symbols = np.zeros(n, np.int64)
        for start, piece in zip(self.starts, pieces):
            symbols[start : start + len(piece)] = [number(w, len(self.ids) + 1) for w in piece]
        ends = np.flatnonzero(symbols == 0)
        keys = symbols + (len(ends) - 1)
        keys[ends] = np.arange(len(ends))  # ends differ, so that no comparison passes one
        order = suffix_order(keys)
        self.wavelet = Wavelet(symbols[order - 1].astype(np.int32), len(self.ids) + 1)
        place = order - self.starts[np.searchsorted(self.starts, order, "right") - 1]
        stored = place % sample == 0  # the first word of a piece always is, so no walk passes an end
        self.stored, self.rank = stored, np.cumsum(stored) - 1
        self.where = order[stored]

    def ranges(self, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search: numbers of the passages (rows of word numbers) that occur, with their ranges of rows."""
        alive = np.arange(len(passages))
        last = passages[:, -1]
        low = self.wavelet.before[last]
        high = low + self.wavelet.counts[last]
        for column in range(passages.shape[1] - 2, -1, -1):
            symbol = passages[alive, column]
            both = self.wavelet.step(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = both[: len(alive)], both[len(alive) :]
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows, by walking back to the nearest stored one."""
        out = np.empty(len(rows), np.int64)
        left, walked = np.arange(len(rows)), 0
        while len(left):
            found = self.stored[rows]
            out[left[found]] = self.where[self.rank[rows[found]]] + walked
            left, rows = left[~found], rows[~found]
            rows, walked = self.wavelet.back(rows), walked + 1
        return out

    def find(self, passages: Sequence[Sequence[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passage, piece, offset) of all occurrences, in slices; all passages have the same number of words."""
        number = self.ids.get
        coded = np.array([[number(w, 0) for w in p] for p in passages], np.int64)
        known = np.flatnonzero(coded.all(axis=1))
        if not len(known):
            return
        which, low, high = self.ranges(coded[known])
        which, ends = known[which], np.cumsum(high - low)
        for begin in range(0, int(ends[-1]) if len(ends) else 0, SLICE):
            at = np.arange(begin, min(begin + SLICE, int(ends[-1])))
            of = np.searchsorted(ends, at, "right")
            place = self.locate(high[of] - (ends[of] - at))
            piece = np.searchsorted(self.starts, place, "right") - 1
            yield which[of], piece, place - self.starts[piece]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


def _search(texts: Sequence[bytes | None], passages: dict[int, tuple[list[list[bytes]], list[list[str]]]], shard: int) -> list[dict]:
    """Per text: its number of words, merged spans of words and items of the passages found."""
    n_words, spans, items = [0] * len(texts), {}, {}
    longest = max(passages, default=1)

    def settle(pieces: list, origin: list) -> None:
        index = FmIndex(pieces)
        for length, (words, owners) in passages.items():
            for which, piece, offset in index.find(words):
                doc = np.array([o[0] for o in origin])[piece]
                start = np.array([o[1] for o in origin])[piece] + offset
                for d, s in np.unique(np.stack([doc, start], 1), axis=0).tolist():
                    spans.setdefault(d, []).append((s, s + length))
                for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                    items.setdefault(d, set()).update(owners[w])
                for d in set(doc.tolist()):
                    spans[d] = _merge(spans[d])

    pieces, origin, held = [], [], 0
    for doc, text in enumerate(texts):
        words = split_words(text)
        n_words[doc] = len(words)
        for begin in range(0, len(words), shard):
            piece = words[begin : begin + shard + longest - 1]
            if held and held + len(piece) > shard:
                settle(pieces, origin)
                pieces, origin, held = [], [], 0
            pieces.append(piece)
            origin.append((doc, begin))
            held += len(piece)
    if pieces and passages:
        settle(pieces, origin)
    return [
        {"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans.get(d, [])], "items": sorted(items.get(d, ()))}
        for d, n in enumerate(n_words)
    ]


def benchmark_passages(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item, words) of all passages of ``benchmark`` (item_id, text): ``window`` consecutive words, or all
    of an item that has fewer. An item without words has none; a null item_id is the item ``''``."""
    w = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), w.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return items.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i"), F.lit(window)).alias("words")).distinct()


def locate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: Sequence[str] | None = None, shard: int = SHARD_WORDS, block: int = BLOCK) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, all by default) with a struct ``hits``: n_words, spans of hit words
    ``[start, end)`` merged, and the ids of the items found, as strings in their order.

    Every task indexes its texts in shards of ``shard`` words, in memory, and searches all passages; nothing is
    shuffled. Passages go to the tasks ``block`` at a time; a larger benchmark takes a pass over the documents for each
    block. A null or empty text has no words and no hits. Repeated rows come out as often as they came in. Empty tables
    of documents give an empty result, an empty benchmark no hits. A column that is called ``hits`` already keeps its
    name, and the new one gets a ``_`` in front.
    """
    spark = docs.sparkSession
    keep = list(docs.columns if keep is None else keep)
    name = spare(docs, "hits")
    pairs = stash(benchmark_passages(benchmark, window), "passages")
    blocks = max(1, -(-pairs.count() // block))
    out = None
    for number in range(blocks):
        of: dict[int, tuple[list[list[bytes]], list[list[str]]]] = {}
        seen: dict[tuple, list[str]] = {}
        dealt = pairs.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == number)
        for item, words in dealt.toLocalIterator():
            seen.setdefault(tuple(w.encode() for w in words), []).append(item)
        for words, owners in seen.items():
            listed = of.setdefault(len(words), ([], []))
            listed[0].append(list(words))
            listed[1].append(owners)
        sent = spark.sparkContext.broadcast(of)
        rest = keep if number == blocks - 1 else list(docs.columns)
        out = _pass(docs if out is None else out, sent, rest, name, shard)
        if number < blocks - 1:
            out = stash(out, "located")
    return out


def _pass(docs: DataFrame, sent, keep: list[str], name: str, shard: int) -> DataFrame:
    earlier = name in docs.columns
    text, found = spare(docs, "_bytes"), spare(docs, "_found")
    columns = [*keep, *([name] if earlier else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _search(batch.column(batch.num_columns - 1).to_pylist(), sent.value, shard)
            if earlier:
                for old, new in zip(batch.column(len(columns) - 1).to_pylist(), rows):
                    spans = _merge([(s["start"], s["end"]) for s in old["spans"] + new["spans"]])
                    new |= {"spans": [{"start": a, "end": b} for a, b in spans], "items": sorted({*old["items"], *new["items"]})}
            arrays = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(rows, _ARROW)], [*keep, found])

    given = docs.select(*[docs[c] for c in columns], F.col("text").cast("string").cast("binary").alias(text))
    schema = StructType([*docs.select(*keep).schema.fields, StructField(found, HITS)])
    return given.mapInArrow(run, schema).withColumnRenamed(found, name)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the hit words and what stands between them cut out of the texts; each span leaves one space.

    Texts without hits stay as they are, null included. Rows, columns and their order are kept.
    """
    name = spare(docs, "hits")
    located = locate(docs, benchmark, window)

    @F.pandas_udf("string")
    def cut(text, spans):
        import re

        import pandas as pd

        word = re.compile(WORD.encode())
        out = []
        for t, s in zip(text, spans):
            raw = t.encode()
            at = [m.span() for m in word.finditer(raw.lower())]
            begin, kept = 0, []
            for span in s:
                kept.append(raw[begin : at[span["start"]][0]])
                begin = at[span["end"] - 1][1]
            out.append(b" ".join([*kept, raw[begin:]]).decode())
        return pd.Series(out, dtype=object)

    hit = F.size(f"{name}.spans") > 0
    clean = located.where(hit).withColumn("text", cut("text", f"{name}.spans"))
    return located.where(~hit).unionByName(clean).select(*docs.columns)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest of ``locate``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    plain = docs.select("doc_id", "text")
    found = locate(plain, benchmark, keep=["doc_id"])
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
