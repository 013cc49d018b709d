"""Calibration on batches, decoding on streams, and replay of stored trials."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..contracts import BROADCAST_LIMIT, ContractError, fits_broadcast
from ..functions import arrays as A
from ..operators import metrics, pooling, retrieval, ridge, segment, selecting
from ..operators.sampling import shuffled
from ..session import checkpoint
from . import sinks

# Fixed value: seconds between replayed trials.
REPLAY_SPACING = 1.2


def calibrate(trials: DataFrame, gallery: DataFrame, features=None, alpha: float = 1000.0, average: bool = True, clamp: float = 15.0):
    """Fit the frozen parts of a decoder from labelled trials ``(trial, code, ch, x)``: channel scaler and ridge map.

    Repeats of a code are averaged first, codes outside the gallery are dropped (fewer than two left is an error).
    ``features`` maps scaled channel rows to ``(trial, code, x)``; by default channels are concatenated by name.
    Returns scaler table, ridge map and a one-row report.
    """
    features = features or concat_channels
    known = selecting.keep_known_codes(trials, gallery)
    if average:
        known = pooling.mean_pool(known, ["code", "ch"]).withColumn("trial", F.col("code"))
    scaler = segment.fit_epoch_scaler(known, ["ch"])
    scaled = segment.apply_epoch_scaler(known, scaler, ["ch"], clamp=clamp)
    rows = features(scaled).join(gallery.select(F.col("id").alias("code"), A.as_double("emb").alias("y")), "code")
    model = ridge.fit_ridge_map(rows, alpha)
    report = metrics.calibration_report(trials.select("trial", "code").distinct(), gallery)
    return scaler, model, report


def concat_channels(scaled: DataFrame) -> DataFrame:
    """Channel rows of a trial joined end to end in channel order."""
    packed = scaled.groupBy("trial", "code").agg(F.sort_array(F.collect_list(F.struct("ch", "x"))).alias("_s"))
    return packed.select("trial", "code", F.flatten(F.transform("_s", lambda s: s["x"])).alias("x"))


def retrieve_udf(spark: SparkSession, gallery: DataFrame, k: int = 5, limit: int = BROADCAST_LIMIT):
    """A stateless column function: predicted embedding to its ``k`` best gallery ids. For streams, whose gallery must
    fit the broadcast bound; a larger one is decoded per micro-batch with ``retrieval.top_k``."""
    width = int(gallery.select(F.size("emb")).first()[0])
    if not fits_broadcast(gallery, 8 * width + 16, limit):
        raise ContractError("gallery exceeds the broadcast bound; use retrieval.top_k in foreachBatch")
    shared = spark.sparkContext.broadcast(retrieval.local_gallery(gallery, "id", "emb"))

    @F.pandas_udf("array<bigint>")
    def best(emb: pd.Series) -> pd.Series:
        ids, g = shared.value
        if not len(emb):
            return pd.Series([], dtype=object)
        found, _ = retrieval.best_ids(retrieval.unit_rows(emb) @ g.T, ids, k)
        return pd.Series([[int(i) for i in r] for r in found])

    return best


def decode_stream(features: DataFrame, model: ridge.RidgeMap, gallery: DataFrame, ks: Sequence[int] = (1, 5), limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Predicted ids of each trial ``(trial, code, x)`` and whether the code is among the first k. Works on batches and
    streams alike."""
    best = retrieve_udf(features.sparkSession, gallery, max(ks), limit)
    predicted = ridge.apply_ridge_map(features, model).withColumn("top", best("prediction"))
    return predicted.select(
        "trial", "code", "top", *[F.array_contains(F.slice("top", 1, k), F.col("code")).alias(f"hit{k}") for k in ks]
    )


DECODED = "trial long, code long, top array<long>"


def decode_batch(batch: DataFrame, model: ridge.RidgeMap, gallery: DataFrame, ks: Sequence[int] = (1, 5), limit: int = BROADCAST_LIMIT) -> DataFrame:
    """As ``decode_stream``, for a table and a gallery of any size: beyond ``limit`` it is matched in tiles. Trials have
    unique numbers."""
    known = ridge.apply_ridge_map(batch.select("trial", "code", "x"), model).select("trial", "code", F.col("prediction").alias("emb"))
    best = retrieval.top_k(known, gallery, max(ks), qid="trial", limit=limit)
    top = best.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"]).alias("top"))
    joined = known.join(top, F.col("trial") == F.col("qid"))
    return joined.select(
        "trial", "code", "top", *[F.array_contains(F.slice("top", 1, k), F.col("code")).alias(f"hit{k}") for k in ks]
    )


def decode_online(
    trials: DataFrame,
    model: str,
    gallery: DataFrame,
    out: str,
    ks: Sequence[int] = (1, 5),
    max_trials: int | None = None,
    idle: float | None = None,
    trigger: str | None = "0 seconds",
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Decode a stream of trials ``(trial, code, x)`` with a stored model; ``trial, code, top, hit…, batch``.

    ``model`` is the folder of a ``ridge_table``. It is read for every micro-batch, so that a later calibration takes
    effect at once; the gallery is stored when the run begins. Decisions go to ``out`` (``data``, and ``state`` to go on from), each trial once also after a failed
    batch. The run ends after ``max_trials`` trials, or when none has come for ``idle`` seconds.
    """
    spark = trials.sparkSession
    gallery = checkpoint(gallery)  # read by every micro-batch
    schema = StructType(list(spark.createDataFrame([], DECODED).schema.fields))
    for k in ks:
        schema = schema.add(f"hit{k}", "boolean")
    sink = sinks.BatchFolders(spark, f"{out}/data", schema, max_trials, ["trial"])

    def step(batch: DataFrame) -> DataFrame:
        return decode_batch(batch, ridge.ridge_from_table(spark.read.parquet(model)), gallery, ks, limit)

    return sinks.run_live(trials, f"{out}/state", sink, step, idle, trigger)


def running_accuracy(decoded: DataFrame, ks: Sequence[int] = (1, 5)) -> DataFrame:
    """Hit rates over all trials so far; on a stream in update or complete mode."""
    return decoded.agg(
        F.count(F.lit(1)).alias("n_trials"), *[F.avg(F.col(f"hit{k}").cast("double")).alias(f"top{k}") for k in ks]
    )


def write_replay(trials: DataFrame, path: str, seed: int = 0, per_file: int = 64, max_trials: int | None = None, id: str = "trial") -> None:
    """Store trials for replay: seeded order, onsets ``REPLAY_SPACING`` apart, files in order of onset."""
    order = shuffled(trials.select(id).distinct(), seed, [id])
    if max_trials is not None:
        order = order.where(F.col("position") <= max_trials)
    rows = trials.join(order, id).withColumn("onset_ts", (F.col("position") - 1) * REPLAY_SPACING)
    rows = rows.withColumn("block", F.floor((F.col("position") - 1) / per_file))
    files = max(1, -(-order.count() // per_file))
    rows.repartitionByRange(files, "block").sortWithinPartitions("position").write.mode("overwrite").parquet(path)


def read_replay(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Stored trials as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)

