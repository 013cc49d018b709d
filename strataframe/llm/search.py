"""Exact BM25 top-k: inverted index in shards, block-max pruning per shard, exact merge under global statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import running_sums, stash

K1, B = 1.2, 0.75
TOP = 10
#: Documents of a shard at most, and of a block whose largest impact is kept for each term.
SHARD, BLOCK = 4096, 32
#: Query terms that are sent to the shards at once (16 bytes each); a longer query goes alone.
QUERY_TERMS = 3_000_000
#: Scores are compared after rounding to so many digits; equal ones are ordered by doc_id.
DIGITS = 6
KEEP_WORDS = 500_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Terms:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """64-bit digest of every word of a text, A-Z lower-cased."""
        found = _WORD.findall((text or "").encode().translate(_LOWER))
        if len(self.known) > KEEP_WORDS:
            self.known.clear()
        for word in set(found).difference(self.known):
            self.known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter([self.known[w] for w in found], np.uint64, len(found))


SHARD_COLUMNS = "doc_ids binary, terms binary, entries binary, blocks binary, peaks binary, starts binary, docs binary, impacts binary"


def _shard(ids: list, texts: list, terms_of: _Terms, mean: float) -> dict[str, np.ndarray]:
    """Inverted index of some documents.

    ``terms`` are sorted; term i owns the block entries entries[i]:entries[i + 1]; entry e is a block of BLOCK
    documents, its largest impact, and the postings starts[e]:starts[e + 1] (document in the shard, impact).
    """
    each = [np.unique(terms_of(t), return_counts=True) for t in texts]
    term = np.concatenate([e[0] for e in each])
    tf = np.concatenate([e[1] for e in each]).astype(np.float64)
    doc = np.repeat(np.arange(len(each), dtype=np.int32), [len(e[0]) for e in each])
    length = np.array([e[1].sum() for e in each], np.float64)
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
    order = np.argsort(term, kind="stable")
    term, doc, impact = term[order], doc[order], impact[order]
    block = doc // BLOCK
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
    starts = np.flatnonzero(new)
    terms, entries = np.unique(term[starts], return_index=True)
    peaks = np.maximum.reduceat(impact, starts) if len(starts) else impact
    return {
        "doc_ids": np.array(ids, np.int64), "terms": terms, "entries": np.append(entries, len(starts)), "blocks": block[starts],
        "peaks": peaks, "starts": np.append(starts, len(term)), "docs": doc, "impacts": impact,
    }


KINDS = {"doc_ids": np.int64, "terms": np.uint64, "entries": np.int64, "blocks": np.int32, "peaks": np.float64, "starts": np.int64, "docs": np.int32, "impacts": np.float64}


def build_index(docs: DataFrame) -> DataFrame:
    """One row per shard with the arrays of ``_shard`` as bytes, stored; every row of ``docs`` with an id is indexed.

    A shard is what one task reads, SHARD documents or 64 MB of text at most. Impacts hold the corpus's mean length, so
    shards agree; the document frequencies stay with the queries.
    """
    known = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string"))
    length = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    mean = known.agg(F.avg(length)).first()[0] or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_of = _Terms()
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                part = batch.slice(at, SHARD)
                made = _shard(part.column(0).to_pylist(), part.column(1).to_pylist(), terms_of, mean)
                yield pa.RecordBatch.from_arrays([pa.array([made[c].astype(k).tobytes()], pa.binary()) for c, k in KINDS.items()], names=list(KINDS))

    return stash(known.mapInArrow(run, SHARD_COLUMNS), "index")


def _frequencies(index: DataFrame) -> DataFrame:
    """(term, df) over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, entries, starts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                first = np.frombuffer(starts, np.int64)[np.frombuffer(entries, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.diff(first))], names=["term", "df"])

    parts = index.select("terms", "entries", "starts").mapInArrow(run, "term bigint, df bigint")
    return parts.groupBy("term").agg(F.sum("df").alias("df"))


def _query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n) of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_of = _Terms()
        for batch in batches:
            for query, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms, n = np.unique(terms_of(text.as_py()), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), query)), pa.array(terms.view(np.int64)), pa.array(n)], names=["query_id", "term", "n"])

    return queries.select("query_id", F.col("text").cast("string")).mapInArrow(run, "query_id bigint, term bigint, n bigint")


class Searcher:
    """The shard's side of a search."""

    def __init__(self, row: dict):  # anything with a buffer
        for name, kind in KINDS.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.count = len(self.doc_ids)
        self.scored = 0  # documents whose scores were worked out, over all searches

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents (places in the shard) and their scores; those without a common term don't count.

        The sum of a block's weighted peaks bounds the score of its documents. Blocks are scored from the largest bound
        down, a few, then twice as many each time; the k-th best score so far is a threshold that rises with each
        stretch, and ends the search at the first block that falls short of it.
        """
        at = np.searchsorted(self.terms, terms)
        found = at < len(self.terms)
        found[found] = self.terms[at[found]] == terms[found]
        at, weights = at[found], weights[found]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0)
        entry, owner = _ranges(self.entries[at], self.entries[at + 1])
        weight, block = weights[owner], self.blocks[entry]
        bound = np.bincount(block, weight * self.peaks[entry], -(-self.count // BLOCK))
        # Blocks in falling order of their bounds; each stretch of scored blocks can raise the threshold for the next.
        ranked = np.argsort(-bound, kind="stable")
        ranked = ranked[: np.count_nonzero(bound > 0)]
        scores, threshold, done, wanted = np.zeros(self.count), 0.0, 0, 2 + k // 4
        while done < len(ranked) and bound[ranked[done]] >= threshold - 2 * 10.0**-DIGITS:
            stretch = ranked[done : done + wanted]
            stretch = stretch[bound[stretch] >= threshold - 2 * 10.0**-DIGITS]
            chosen = np.zeros(len(bound), bool)
            chosen[stretch] = True
            scores += self._scores(entry, weight, chosen[block])
            threshold = np.partition(scores, -k)[-k] if self.count > k else 0.0
            done, wanted = done + len(stretch), 2 * wanted
        self.scored += min(done * BLOCK, self.count)
        scores = np.round(scores, DIGITS)
        hits = np.flatnonzero(scores > 0)
        if len(hits) > k:
            hits = hits[scores[hits] >= np.partition(scores[hits], -k)[-k]]
        order = np.lexsort((self.doc_ids[hits], -scores[hits]))[:k]
        return hits[order], scores[hits][order]

    def _scores(self, entry: np.ndarray, weight: np.ndarray, use: np.ndarray) -> np.ndarray:
        entry, weight = entry[use], weight[use]
        posting, owner = _ranges(self.starts[entry], self.starts[entry + 1])
        return np.bincount(self.docs[posting], self.impacts[posting] * weight[owner], self.count)


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, and which range each is of."""
    sizes = stops - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes), owner


#: A shard is a row of many megabytes: with these settings readers and Python workers hold one, not all shards of a file.
ONE_ROW = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")


@contextmanager
def _one_shard_at_a_time(spark: SparkSession) -> Iterator[None]:
    kept = {name: spark.conf.get(name) for name in ONE_ROW}
    try:
        for name in ONE_ROW:
            spark.conf.set(name, "1")
        yield
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def _search_block(index: DataFrame, block: pa.Table, k: int) -> DataFrame:
    """Best k of every shard for the queries of one block: query_id, doc_id, score."""
    ids, first = np.unique(block["query_id"].to_numpy(), return_index=True)
    terms, weights = block["term"].to_numpy().view(np.uint64), block["weight"].to_numpy()
    shared = index.sparkSession.sparkContext.broadcast((ids, np.append(first, len(terms)), terms, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, first, terms, weights = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                shard = Searcher({c: batch.column(c)[at].as_buffer() for c in KINDS})  # not copied
                out = [[], [], []]
                for i, query in enumerate(ids):
                    hits, scores = shard.top(terms[first[i] : first[i + 1]], weights[first[i] : first[i + 1]], k)
                    for column, values in zip(out, (np.full(len(hits), query), shard.doc_ids[hits], scores)):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "doc_id", "score"])

    return index.mapInArrow(run, "query_id bigint, doc_id bigint, score double")


def top_k(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """The k documents with the highest BM25 score for every query: query_id, rank, doc_id, score.

    ``queries`` has query_id and text, ``docs`` doc_id and text (ids are integers; rows without one are left out). A
    query is its words, repeats included: score = sum of n * idf * impact, idf = ln(1 + (N - df + 0.5) / (df + 0.5)).
    Exact: all rows are indexed, bounds only rule out what can't reach the k-th score. Scores are rounded to 6 digits;
    equal ones go by doc_id. A query without words, or without a word that a document has, has no result; rows that
    repeat a doc_id are results of their own; a repeated query_id joins its texts. Queries go to the shards in blocks
    of bounded size.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    total = docs.where("doc_id is not null").count()
    df = F.col("df")
    asked = _query_terms(queries.where("query_id is not null")).groupBy("query_id", "term").agg(F.sum("n").alias("n"))
    asked = asked.join(_frequencies(index), "term")
    asked = stash(asked.select("query_id", "term", (F.col("n") * F.log(1 + (total - df + 0.5) / (df + 0.5))).alias("weight")), "asked")
    sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = running_sums(sizes, ["query_id"], {"n": "upto"}, "queries")
    blocks = stash(sizes.select("query_id", F.floor((F.col("upto") - 1) / QUERY_TERMS).alias("block")), "query_blocks")
    best = None
    for block in [r["block"] for r in blocks.select("block").distinct().orderBy("block").collect()]:
        chosen = asked.join(blocks.where(F.col("block") == block).select("query_id"), "query_id", "left_semi")
        sent = chosen.toArrow().sort_by([("query_id", "ascending"), ("term", "ascending")])
        with _one_shard_at_a_time(spark):
            part = stash(_search_block(index, sent, k), "found")
        best = part if best is None else best.union(part)
    if best is None:
        best = spark.createDataFrame([], "query_id bigint, doc_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
