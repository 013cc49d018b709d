"""Exact dedup against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import lower_ascii, stash

#: A digest with more than this share of a batch is joined by broadcast; at most 1/share digests can be so.
HOT_SHARE = 1 / 2048


class DigestIndex:
    """A table (digest, keep_id, group_size) of every text seen so far, bucketed and sorted by digest.

    A join on the digest reads the buckets in place, without moving the index. The table lies under the warehouse or
    at ``path``; ``create`` starts one, ``open`` takes up one that an earlier session wrote.
    """

    COLUMNS = "digest STRING, keep_id BIGINT, group_size BIGINT"

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @classmethod
    def create(cls, spark: SparkSession, name: str | None = None, buckets: int | None = None, path: str | None = None):
        name = name or f"digest_index_{uuid.uuid4().hex}"
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        place = f" LOCATION '{path}'" if path else ""
        spark.sql(
            f"CREATE TABLE {name} ({cls.COLUMNS}) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS{place}"
        )
        return cls(spark, name)

    @classmethod
    def open(cls, spark: SparkSession, name: str, buckets: int, path: str):
        return cls.create(spark, name, buckets, path)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame) -> DataFrame:
        """Append what is new in ``docs`` (doc_id, text, anything more) and say for each row what becomes of it.

        Returns doc_id, keep_id, group_size, kept, text_sha256, one row per row of ``docs``. Texts are equal when
        identical after lower-casing A-Z; null counts as empty. Within the batch the largest doc_id of equal texts
        stays (null ids come last; of rows that also repeat the id, one stays); if the index holds the text already,
        none does and keep_id is the earlier one. group_size is the number of rows with the text in the batch that
        brought it. An empty batch changes nothing.
        """
        rows = docs.select(
            "doc_id",
            F.monotonically_increasing_id().alias("_row"),
            F.sha2(lower_ascii(F.col("text")).cast("binary"), 256).alias("digest"),
        )
        rows = stash(rows, "digests")
        groups = (
            rows.groupBy("digest")
            .agg(F.max(F.struct("doc_id", "_row")).alias("_best"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.col("_best.doc_id").alias("keep_id"), "group_size", F.col("_best._row").alias("_stays"))
        )
        groups = stash(groups, "groups")
        known = self.table()
        fresh = stash(groups.join(known.hint("merge"), "digest", "left_anti"), "fresh")
        seen = groups.select("digest", F.col("group_size").alias("_size")).join(known.hint("merge"), "digest")
        seen = stash(seen.withColumn("_stays", F.lit(None).cast("long")), "seen")
        new = fresh.select("digest", "keep_id", "group_size", F.col("group_size").alias("_size"), "_stays")
        fresh.select("digest", "keep_id", "group_size").repartition("digest").write.insertInto(self.name)
        return _told(rows, new.unionByName(seen))


def _told(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Tell each row its group: by broadcast where the group is a large part of the batch, by a sorted merge elsewhere."""
    limit = max(1000.0, HOT_SHARE * rows.count())
    hot = F.broadcast(groups.where(F.col("_size") > limit))
    cold = groups.where(F.col("_size") <= limit)
    joined = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(cold, "digest"))
    kept = F.coalesce(F.col("_row") == F.col("_stays"), F.lit(False))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``DigestIndex.add`` of one batch to an index of its own."""
    return DigestIndex.create(docs.sparkSession).add(docs)
