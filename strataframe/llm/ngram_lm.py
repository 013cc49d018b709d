"""Stupid-backoff language-model scores, computed relationally from n-gram count tables."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import stash

#: Longest n-gram, and factor of each step back.
ORDER = 3
ALPHA = 0.4
#: The most frequent n-grams, at most so many, go to all tasks (3 MB): hot keys move no rows.
HOT = 1 << 17
#: Texts whose n-grams a task lists at once.
ROWS = 1000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Words:
    """Words of a batch of texts as dense numbers, and the digests of n-grams."""

    def __init__(self, texts):
        known: dict[bytes, int] = {}
        number = known.setdefault
        parts = [np.zeros(0, np.int64)]
        for t in texts:
            found = _WORD.findall((t.as_py() or "").encode().translate(_LOWER))
            parts.append(np.array([number(w, len(known)) for w in found], np.int64))
        self.ids = np.concatenate(parts)
        self.sizes = np.array([len(p) for p in parts[1:]], np.int64)
        self.digests = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))

    def starts(self, order: int) -> np.ndarray:
        """Where an n-gram of ``order`` words begins."""
        left = np.repeat(np.cumsum(self.sizes), self.sizes) - np.arange(len(self.ids))
        return np.flatnonzero(left >= order)

    def grams(self, starts: np.ndarray, order: int) -> np.ndarray:
        """Digests of the n-grams at ``starts``: made of the first words' digest and the last word's."""
        out = self.digests[self.ids[starts]]
        for k in range(1, order):
            out = _mixed(out, self.digests[self.ids[starts + k]])
        return out

    def counted(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """One start of each different n-gram, and how often it occurs; those with the same first words together."""
        starts = self.starts(order)
        code = self.ids[starts]
        for k in range(1, order):
            if k > 1:
                code = np.unique(code, return_inverse=True)[1]
            code = code * len(self.digests) + self.ids[starts + k]
        _, at, n = np.unique(code, return_index=True, return_counts=True)
        return starts[at], n


def _mixed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    x = (first * np.uint64(0x9E3779B97F4A7C15)) ^ last
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _counted(docs: DataFrame, order: int) -> DataFrame:
    """How often n-grams of ``order`` words occur, one row per n-gram and batch of texts.

    (h, n) for words; (ctx, suf, n) for two words, whose digests these are; else (h, ctx, suf, n) with the digests of
    the first and the last words. Rows with the same first words lie together, so that they pack well when shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _Words(batch.column(0))
            starts, n = words.counted(order)
            h = words.grams(starts, order) if order != 2 else None
            below = [words.grams(starts, order - 1), words.grams(starts + 1, order - 1)] if order > 1 else []
            columns = [c.view(np.int64) for c in ([h] if h is not None else []) + below] + [n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    names = ["h", "n"] if order == 1 else ["ctx", "suf", "n"] if order == 2 else ["h", "ctx", "suf", "n"]
    return docs.select(F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _occurring(docs: DataFrame, order: int, known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """What the texts hold: (row, h, n, part), ``row`` the digest of doc_id and text.

    One row per text with the number of its words (n) and the gains of its n-grams that are in ``known`` (part), and
    rows with null part for its other n-grams, with how often they occur (words counted, longer ones one by one).
    """
    digests, gains = known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            words, rows = _Words(batch.column(1)), batch.column(0).to_numpy()
            owner = np.repeat(np.arange(len(rows)), words.sizes)
            code, n = np.unique(owner * max(1, len(words.digests)) + words.ids, return_counts=True)
            texts, h = np.divmod(code, max(1, len(words.digests)))
            parts = [(texts, words.digests[h] if len(h) else h.view(np.uint64), n)]
            for k in range(2, order + 1):
                starts = words.starts(k)
                parts.append((owner[starts], words.grams(starts, k), np.ones(len(starts), np.int64)))
            texts, h, n = (np.concatenate(x) for x in zip(*parts))
            h = h.view(np.int64)
            at = np.minimum(np.searchsorted(digests, h), max(0, len(digests) - 1))
            hit = digests[at] == h if len(digests) else np.zeros(len(h), bool)
            part = np.bincount(texts[hit], n[hit] * gains[at[hit]], len(rows)) if hit.any() else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(rows), pa.array(words.sizes), pa.array(part)], names=names)
            cold = pa.array(rows[texts[~hit]]), pa.array(h[~hit]), pa.array(n[~hit])
            yield pa.RecordBatch.from_arrays([*cold, pa.nulls(len(cold[0]), pa.float64())], names=names)

    names = ["row", "h", "n", "part"]
    return docs.select(_row(), F.col("text").cast("string")).mapInArrow(run, "row bigint, h bigint, n bigint, part double")


def _row():
    return F.xxhash64("doc_id", "text").alias("row")


def _with_digest(pairs: DataFrame) -> DataFrame:
    """(h, ctx, suf, c) of (ctx, suf, c) rows of two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = (batch.column(i).to_numpy().view(np.uint64) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(_mixed(first, last).view(np.int64)), *batch.columns], names=["h", "ctx", "suf", "c"])

    return pairs.select("ctx", "suf", "c").mapInArrow(run, "h bigint, ctx bigint, suf bigint, c bigint")


def count_ngrams(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> list[DataFrame]:
    """Count tables of 1 to ``order`` words over all texts: h, c, log_s, gain; partitioned by h and stored.

    log_s is the log of the relative frequency after the first words, gain what the n-gram adds to the score of its
    last words: log_s - log(alpha) - log_s of the shorter one. Every n-gram counts, however rare.
    """
    words = _counted(docs, 1).groupBy("h").agg(F.sum("n").alias("c"))
    words = stash(words, "words")
    total = words.agg(F.sum("c").alias("all"))
    first = words.crossJoin(F.broadcast(total))  # one row
    first = first.select("h", "c", (F.log("c") - F.log("all")).alias("log_s")).withColumn("gain", F.col("log_s"))
    tables = [stash(first, "grams_1")]
    for k in range(2, order + 1):
        keys = ["ctx", "suf"] if k == 2 else ["h", "ctx", "suf"]
        # Batches are counted already: dealt out as they are, in the order in which they pack well.
        counts = _counted(docs, k).repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("c"))
        counts = stash(_with_digest(counts) if k == 2 else counts, f"counts_{k}")
        below = tables[-1]
        hot, cold = hot_and_cold(below)
        context = lambda t: t.select(F.col("h").alias("ctx"), F.col("c").alias("before"))
        suffix = lambda t: t.select(F.col("h").alias("suf"), F.col("log_s").alias("shorter"))
        full = split_join(counts, context(hot), context(cold), "ctx")
        full = split_join(full, suffix(hot), suffix(cold), "suf")
        log_s = F.log("c") - F.log("before")
        table = full.select("h", "c", log_s.alias("log_s"), (log_s - math.log(alpha) - F.col("shorter")).alias("gain"))
        tables.append(stash(table, f"grams_{k}"))
    return tables


def hot_and_cold(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The HOT most frequent n-grams of a table at most, and the others."""
    hot = stash(table.orderBy(F.desc("c"), "h").limit(HOT), "hot")
    return hot, table.join(F.broadcast(hot.select("h")), "h", "left_anti")


def split_join(rows: DataFrame, hot: DataFrame, cold: DataFrame, key: str) -> DataFrame:
    """Inner join by broadcast with the hot part, by shuffle with the cold one."""
    found = rows.join(F.broadcast(hot), key)
    other = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return found.unionByName(other)


def score(docs: DataFrame, tables: list[DataFrame], alpha: float = ALPHA) -> DataFrame:
    """Stupid-backoff score of every text: doc_id, n_words, log_score (natural log, summed), mean_log_score.

    A word scores the relative frequency of the longest n-gram in the tables that ends with it, times ``alpha`` for
    each step back from the longest possible at its place. Written per order, a text's score is the sum of the gains
    of all its n-grams that are in the tables; so each order is one join on the n-gram's digest and one sum per text.
    Words that no table holds are not scored. Null, empty and wordless texts: 0 words, score 0, mean null. One row per
    row of ``docs``; rows that repeat get the same.
    """
    every = tables[0].select("h", "c", "gain")
    for table in tables[1:]:
        every = every.union(table.select("h", "c", "gain"))
    hot, cold = hot_and_cold(every)
    known = hot.toArrow().sort_by("h")
    met = _occurring(docs, len(tables), (known["h"].to_numpy(), known["gain"].to_numpy())).join(cold.select("h", "gain"), "h", "left")
    whole = F.col("part").isNotNull()
    sums = met.groupBy("row").agg(
        F.sum(F.coalesce("part", F.col("n") * F.col("gain"), F.lit(0.0))).alias("gain"), F.sum(F.when(whole, F.col("n"))).alias("words")
    )
    sums = stash(sums, "scores")
    rows = docs.select("doc_id", _row())
    again = rows.groupBy("row").agg(F.count(F.lit(1)).alias("times"))
    sums = sums.join(again, "row").select("row", F.col("gain") / F.col("times"), (F.col("words") / F.col("times")).cast("long"))
    joined = rows.join(sums.toDF("row", "gain", "words"), "row", "left")
    words = F.coalesce("words", F.lit(0).cast("long"))
    back, longest = F.lit(0).cast("long"), len(tables)
    for k in range(1, longest):  # steps back at the place of each word, as if no longer n-gram were known
        back = back + F.greatest(words - k, F.lit(0))
    total = F.coalesce("gain", F.lit(0.0)) + back * math.log(alpha)
    return joined.select("doc_id", words.alias("n_words"), total.alias("log_score"), F.when(words > 0, total / words).alias("mean_log_score"))
