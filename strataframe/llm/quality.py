"""Quality classifier: similarity-weighted votes of labelled texts in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import spare
from .language import fold

#: Hashed byte trigrams are counted in so many bins, and reduced to so many latent dimensions.
BINS = 4096
LATENT = 64
#: Distances at which a text's bytes are compared with themselves, and the weight of these terms beside the trigrams.
LAGS = range(2, 34)
LAG_WEIGHT = 2.0
TERMS = BINS + len(LAGS) + 1
#: Bound of the labelled texts that are kept as voters.
SAMPLE = 4000
NEIGHBOURS = 25
#: A neighbour's weight is exp(SHARPNESS * cosine).
SHARPNESS = 12.0
THRESHOLD = 0.3
#: Bytes of a text whose trigrams are counted at once, and texts that are scored at once.
CHUNK = 1 << 20
BLOCK = 256


def terms(text: str | None) -> np.ndarray:
    """Term vector of a whole text: roots of the shares of its byte trigrams by bin, and of the bytes that repeat at each lag.

    Shares, so length does not count; repeated words show at the lags, whatever the words are. Zero for an empty text.
    """
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    data = np.frombuffer(b" " + text.encode() + b" ", np.uint8)
    counts, same = np.zeros(BINS, np.int64), np.zeros(len(LAGS), np.int64)
    for at in range(0, len(data) - 2, CHUNK):
        part = data[at : at + CHUNK + 2].astype(np.uint32)
        mixed = ((part[:-2] * np.uint32(0x9E3779B1)) ^ (part[1:-1] * np.uint32(0x85EBCA77)) ^ (part[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
        counts += np.bincount(mixed >> np.uint32(20), minlength=BINS)
        for i, lag in enumerate(LAGS):
            piece = data[at : at + CHUNK + lag]
            same[i] += np.count_nonzero(piece[lag:] == piece[:-lag])
    out[:BINS] = np.sqrt(counts / counts.sum())
    lags = LAG_WEIGHT * np.sqrt(same / len(data))
    out[BINS:-1] = lags
    out[-1] = 2 * lags.max()
    return out


def term_rows(texts: list[str | None]) -> np.ndarray:
    return np.array([terms(t) for t in texts], np.float32).reshape(-1, TERMS)


class Voters:
    """Labelled texts as unit vectors of the latent space, with the map into it. A few MB, whatever the corpus."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, latent: int = LATENT, seed: int = 0):
        self.centre = rows.mean(axis=0)
        spread = rows.std(axis=0) + 1e-4
        self.scale = (1 / np.sqrt(spread)).astype(np.float32)
        x = (rows - self.centre) * self.scale
        latent = min(latent, *x.shape)
        probe = x @ np.random.default_rng(seed).normal(size=(x.shape[1], latent + 10)).astype(np.float32)
        for _ in range(3):  # range finder with power iterations, then a small exact decomposition
            probe = x @ (x.T @ np.linalg.qr(probe)[0])
        basis = np.linalg.qr(probe)[0]
        _, values, right = np.linalg.svd(basis.T @ x, full_matrices=False)
        keep = values[:latent] > 1e-4 * max(values[0], 1e-12)
        self.map = np.ascontiguousarray(right[:latent][keep].T, dtype=np.float32)
        self.labels = labels.astype(np.float32)
        self.base = float(self.labels.mean())
        self.units = self.latent(rows)

    def latent(self, rows: np.ndarray) -> np.ndarray:
        z = ((rows - self.centre) * self.scale) @ self.map
        return (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Share of the neighbours' weight that has label 1; the sample's share for an empty text."""
        out = np.full(len(texts), self.base)
        some = [i for i, t in enumerate(texts) if t]
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(some), BLOCK):
            block = some[at : at + BLOCK]
            cosine = self.latent(term_rows([texts[i] for i in block])) @ self.units.T
            # To five digits, then by voter number: which texts share a block decides nothing.
            rounded = np.round(cosine.astype(np.float64) * 1e5).astype(np.int64)
            near = np.argpartition(np.arange(len(self.labels)) - rounded * len(self.labels), k - 1, axis=1)[:, :k]
            weight = np.exp(SHARPNESS * (np.take_along_axis(rounded, near, axis=1) / 1e5 - 1))
            out[block] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 0) -> Voters | None:
    """Voters from texts with a label (labels: doc_id, quality); None if there is none.

    At most ``sample`` labelled ids are used, chosen by a digest of the id; of an id with several labels the mean
    counts, of one with several texts the largest by digest and text. Null labels and null or empty texts are left out.
    The driver receives the sample's sparse term vectors.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("label").alias("label"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [terms(t) for t in batch.column(1).to_pylist()]
            used = [np.flatnonzero(r) for r in rows]
            values = pa.array([r[u] for r, u in zip(rows, used)], pa.list_(pa.float32()))
            columns = [batch.column(0), batch.column(2), pa.array(used, pa.list_(pa.int32())), values]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "terms", "values"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = texts.mapInArrow(count, f"doc_id {kind}, label double, terms array<int>, values array<float>").toArrow()
    got = got.sort_by("doc_id")
    if not got.num_rows:
        return None
    rows = np.zeros((got.num_rows, TERMS), np.float32)
    for i, (used, values) in enumerate(zip(got["terms"].to_pylist(), got["values"].to_pylist())):
        rows[i, used] = values
    return Voters(rows, np.asarray(got["label"]).round(), seed=seed)


def with_scores(docs: DataFrame, voters: Voters | None, score: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score``: the share of label 1 among the nearest voters, 1 if there are none.

    Every whole text is compared with every voter in blocks. Null and empty texts get the voters' share of label 1.
    Rows are scored one by one, so repeated rows agree; no other column is looked at.
    """
    order = [*docs.columns, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            values = voters.score(texts) if voters else np.ones(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=order)

    at = docs.columns.index("text")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """Fit outside the held-out fold and score every row: doc_id, held_out, score, predicted (1 from ``threshold`` on).

    A row without id is in no fold and counts as held out.
    """
    out = F.coalesce(fold(F.col("doc_id"), parts) == held_out, F.lit(True))
    voters = fit(docs, labels.where(~out).select("doc_id", "quality"))
    scored = with_scores(docs.select("doc_id", F.col("text").cast("string").alias("text")), voters)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, parts: int = 5, held_out: int = 0) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, same columns; fitted as in ``classify``."""
    out = F.coalesce(fold(F.col("doc_id"), parts) == held_out, F.lit(True))
    voters = fit(docs, labels.where(~out).select("doc_id", "quality"))
    name = spare(docs, "_score")
    return with_scores(docs, voters, name).where(F.col(name) >= threshold).drop(name)
