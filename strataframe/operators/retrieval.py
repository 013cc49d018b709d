"""Cosine retrieval against a gallery.

A gallery under the size bound goes to every task; a larger one is cut into shards, and so are the queries. Tasks multiply
blocks of bounded size and keep per-query results only, never a row of scores as long as the gallery.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..contracts import BROADCAST_LIMIT, ContractError, fits_broadcast
from ..functions import arrays as A

#: Queries and gallery rows of one matrix product (16 MB of scores).
BLOCK_QUERIES, BLOCK_GALLERY = 1024, 2048
#: Bytes of the vectors in a shard of queries or gallery: rows are sent once for each shard of the other side.
SHARD_BYTES = 32 << 20
#: Scores that agree to so many digits are ties.
TIE_DIGITS = 9


def unit_rows(column: pd.Series) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype(float)
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)


def best_ids(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest per row, smaller id first on ties; ``ids`` ascending."""
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return ids[order], np.take_along_axis(scores, order, axis=1)


def best_of(queries: np.ndarray, gallery: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK_GALLERY) -> tuple[np.ndarray, np.ndarray]:
    """``best_ids`` of all products, a block of the gallery at a time; scores that agree to TIE_DIGITS digits are ties."""
    head = max(k, min(256, block))
    scores = queries @ gallery[:head].T
    order, _ = best_ids(np.round(scores, TIE_DIGITS), np.arange(scores.shape[1]), k)
    found, scores = ids[order], np.take_along_axis(scores, order, axis=1)
    for start in range(head, len(ids), block):
        part = queries @ gallery[start : start + block].T
        row, at = np.nonzero(part > scores[:, -1:] - 10.0**-TIE_DIGITS)
        if not len(row):
            continue
        some, place = np.unique(row, return_inverse=True)
        rows = np.concatenate([np.repeat(np.arange(len(some)), k), place])
        values = np.concatenate([scores[some].ravel(), part[row, at]])
        named = np.concatenate([found[some].ravel(), ids[start + at]])
        order = np.lexsort((named, -np.round(values, TIE_DIGITS), rows))
        pick = order[np.searchsorted(rows[order], np.arange(len(some)))[:, None] + np.arange(k)]
        found[some], scores[some] = named[pick], values[pick]
    return found, scores


def local_gallery(gallery: DataFrame, gid: str, vec: str):
    rows = gallery.select(F.col(gid).alias("id"), A.as_double(vec).alias("v")).orderBy("id").collect()
    ids = np.array([r["id"] for r in rows])
    return ids, unit_rows(pd.Series([r["v"] for r in rows]))


def _width(df: DataFrame, vec: str) -> int:
    row = df.select(F.size(vec).alias("d")).first()
    if row is None:
        raise ContractError("empty gallery")
    return int(row["d"])


def _shard_pairs(query: DataFrame, gallery: DataFrame, qid: str, gid: str, vec: str, tile: int, extra: Sequence[str] = ()):
    """Shards of queries beside shards of the gallery. A shard has up to SHARD_BYTES of vectors, or fewer rows where that
    keeps all cores busy, but not fewer than ``tile``: a row is sent as often as the other side has shards."""
    most = max(tile, SHARD_BYTES // (8 * _width(gallery, vec) + 16))
    rows_g, rows_q = gallery.count(), query.count()
    n_g = max(1, -(-rows_g // most))
    wanted = -(-2 * query.sparkSession.sparkContext.defaultParallelism // n_g)
    n_q = max(1, -(-rows_q // most), min(wanted, -(-rows_q // tile)))
    q = query.select(
        F.col(qid).alias("qid"), A.as_double(vec).alias("v"), *extra, F.pmod(F.xxhash64(qid), F.lit(n_q)).alias("qt")
    ).withColumn("gt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_g - 1).cast("bigint"))))
    g = gallery.select(
        F.col(gid).alias("id"), A.as_double(vec).alias("v"), F.pmod(F.xxhash64(gid), F.lit(n_g)).alias("gt")
    ).withColumn("qt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint"))))
    return q.groupBy("qt", "gt").cogroup(g.groupBy("qt", "gt"))


def top_k(
    query: DataFrame,
    gallery: DataFrame,
    k: int = 5,
    qid: str = "id",
    gid: str = "id",
    vec: str = "emb",
    limit: int = BROADCAST_LIMIT,
    tile: int = 8192,
) -> DataFrame:
    """``qid, rank, id, score``: the ``k`` most similar gallery rows of each query, smaller id first on ties."""
    spark = query.sparkSession
    schema = "qid long, hits array<struct<score:double,id:long>>"

    def pack(qids, ids, scores):
        hits = [[{"score": float(s), "id": int(i)} for i, s in zip(r, c)] for r, c in zip(ids, scores)]
        return pd.DataFrame({"qid": qids, "hits": hits})

    if fits_broadcast(gallery, 8 * _width(gallery, vec) + 16, limit):
        shared = spark.sparkContext.broadcast(local_gallery(gallery, gid, vec))

        def scan(batches):
            ids, g = shared.value
            for pdf in batches:
                for start in range(0, len(pdf), BLOCK_QUERIES):
                    part = pdf.iloc[start : start + BLOCK_QUERIES]
                    yield pack(part["qid"].to_numpy(), *best_of(unit_rows(part["v"]), g, ids, k))

        packed = query.select(F.col(qid).alias("qid"), A.as_double(vec).alias("v")).mapInPandas(scan, schema)
    else:

        def tile_best(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(g):
                return pd.DataFrame({"qid": [], "hits": []})
            g = g.sort_values("id")
            gv, ids, out = unit_rows(g["v"]), g["id"].to_numpy(), []
            for start in range(0, len(q), BLOCK_QUERIES):
                part = q.iloc[start : start + BLOCK_QUERIES]
                out.append(pack(part["qid"].to_numpy(), *best_of(unit_rows(part["v"]), gv, ids, k)))
            return pd.concat(out)

        packed = _shard_pairs(query, gallery, qid, gid, vec, tile).applyInPandas(tile_best, schema)
    each = packed.select("qid", F.explode("hits").alias("h")).select("qid", "h.score", "h.id")
    merged = each.groupBy("qid").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.round("score", TIE_DIGITS)).alias("_s"), "id", (-F.col("score")).alias("s")))), 1, k).alias("hits")
    )
    return merged.select("qid", F.posexplode("hits").alias("_r", "h")).select(
        "qid", (F.col("_r") + 1).alias("rank"), F.col("h.id").alias("id"), (-F.col("h.s")).alias("score")
    )


def correct_ranks(
    query: DataFrame,
    gallery: DataFrame,
    qid: str = "id",
    correct: str = "correct_id",
    gid: str = "id",
    vec: str = "emb",
    limit: int = BROADCAST_LIMIT,
    tile: int = 8192,
) -> DataFrame:
    """``qid, rank``: one plus the number of other gallery rows strictly more similar than the correct one.

    A query whose correct item is not in the gallery has no rank; it is an error, as leaving it out would raise the hit
    rates.
    """
    wanted = gallery.select(F.col(gid).alias(correct), A.as_double(vec).alias("_c"))
    missing = F.raise_error(F.concat(F.lit("correct item not in the gallery: "), F.coalesce(F.col(correct).cast("string"), F.lit("null"))))
    found = query.join(wanted, correct, "left").withColumn("_c", F.coalesce("_c", missing.cast("array<double>")))
    q = found.select(
        F.col(qid).alias(qid),
        A.as_double(vec).alias(vec),
        F.col(correct).cast("bigint").alias("correct"),
        A.cosine(A.as_double(vec), F.col("_c")).alias("target"),
    )

    def beaten(part: pd.DataFrame, ids: np.ndarray, g: np.ndarray) -> np.ndarray:
        v, target, right = unit_rows(part["v"]), part["target"].to_numpy()[:, None], part["correct"].to_numpy()[:, None]
        n = np.zeros(len(part), np.int64)
        for start in range(0, len(ids), BLOCK_GALLERY):
            better = v @ g[start : start + BLOCK_GALLERY].T > target
            better &= ids[None, start : start + BLOCK_GALLERY] != right
            n += better.sum(axis=1)
        return n

    if fits_broadcast(gallery, 8 * _width(gallery, vec) + 16, limit):
        shared = query.sparkSession.sparkContext.broadcast(local_gallery(gallery, gid, vec))

        def scan(batches):
            ids, g = shared.value
            for pdf in batches:
                for start in range(0, len(pdf), BLOCK_QUERIES):
                    part = pdf.iloc[start : start + BLOCK_QUERIES]
                    yield pd.DataFrame({"qid": part["qid"].to_numpy(), "n": beaten(part, ids, g)})

        counts = q.select(F.col(qid).alias("qid"), F.col(vec).alias("v"), "correct", "target").mapInPandas(scan, "qid long, n long")
        return counts.select("qid", (F.col("n") + 1).alias("rank"))

    def tile_count(qs: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(g):
            return pd.DataFrame({"qid": qs["qid"] if len(qs) else [], "n": 0})
        gv, ids = unit_rows(g["v"]), g["id"].to_numpy()
        parts = [qs.iloc[s : s + BLOCK_QUERIES] for s in range(0, len(qs), BLOCK_QUERIES)]
        return pd.concat([pd.DataFrame({"qid": p["qid"].to_numpy(), "n": beaten(p, ids, gv)}) for p in parts])

    counts = _shard_pairs(q, gallery, qid, gid, vec, tile, ["correct", "target"]).applyInPandas(tile_count, "qid long, n long")
    return counts.groupBy("qid").agg((F.sum("n") + 1).alias("rank"))


def retrieval_metrics(ranks: DataFrame, n_gallery: int, ks: Sequence[int] = (1, 5)) -> DataFrame:
    """Hit rate at each k, median rank and chance; ranks are small integers, so they are folded before the median."""
    folded = ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("_c"))
    hits = [(F.sum(F.when(F.col("rank") <= k, F.col("_c")).otherwise(0)) / F.sum("_c")).alias(f"top{k}") for k in ks]
    return folded.agg(
        *hits,
        F.percentile(F.col("rank").cast("double"), 0.5, F.col("_c")).alias("median_rank"),
        F.sum("_c").alias("n_query"),
    ).withColumn("chance_top1", F.lit(1.0 / n_gallery))


def evaluate_retrieval(query: DataFrame, gallery: DataFrame, ks: Sequence[int] = (1, 5), correct: str | None = "correct_id", qid: str = "id", gid: str = "id", vec: str = "emb", **options) -> DataFrame:
    """Ranks and metrics in one call. Without a ``correct`` column query i matches gallery i, so the tables must be of
    equal size."""
    n = gallery.count()
    if correct is None:
        if query.count() != n:
            raise ContractError("identity matching needs as many queries as gallery rows")
        correct = "_same"
        query = query.withColumn(correct, F.col(qid))
    return retrieval_metrics(correct_ranks(query, gallery, qid, correct, gid, vec, **options), n, ks)
