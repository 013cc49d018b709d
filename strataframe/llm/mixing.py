"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import apply_decisions, content, running_sums, spare, stash, word_count

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words, and the most often a source is repeated.
SHARE = 1.5
REPEATS = 2


def _shuffle_key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))


def targets(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Target of each source of (source, size) rows: source, rank, before, source_size, target.

    ``share`` of all words is dealt by weight; a target stops at ``repeats`` times the source's size and the excess is
    dealt again. The level at which it settles has a closed form: with sources ordered by cap / weight it is the
    largest of (budget - caps before) / (weights from here on).
    """
    named = F.when(F.col("source").isNull(), 1).otherwise(0)
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("nameless", named)
    sizes = sizes.withColumn("one", F.lit(1).cast("long"))
    order = running_sums(sizes, ["nameless", "source"], {"one": "rank", "source_size": "upto"}, "sources")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    order = order.select(
        "source", "rank", "source_size", (F.col("upto") - F.col("source_size")).alias("before"),
        weight.cast("long").alias("weight"), (F.lit(repeats) * F.col("source_size")).alias("cap"),
    ).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = running_sums(order, ["ratio", "rank"], {"cap": "caps", "weight": "upto"}, "levels")
    total = level.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all"))
    open_level = (F.lit(share) * F.col("total") - (F.col("caps") - F.col("cap"))) / (F.col("all") - (F.col("upto") - F.col("weight")))
    level = level.crossJoin(F.broadcast(total)).withColumn("open", open_level)  # one row
    top = level.agg(F.max("open").alias("level"))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return level.crossJoin(F.broadcast(top)).select("source", "rank", "before", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """Take documents so that each source gives about its target number of words.

    Returns doc_id, content (digest of the text), size, source_size, target, taken, copies, one row per row of
    ``docs``. Documents are shuffled within their source by the digest of (seed, doc_id); a copy's virtual finish time
    is (words of its source up to its end, earlier rounds included) / target. All copies are put in one order of
    finish time and taken until the sum of the targets is reached, so taken is ``copies`` times the size and at most
    ``repeats`` times it. Null text: size 0, nothing taken. A null source is a source, the last. Rows with the same id
    are rows of their own; ties are broken by size. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", "source", content(F.col("text")).alias("content"), word_count(F.col("text")).alias("size"))
    rows = stash(rows.withColumn("_key", _shuffle_key(seed)).withColumn("_nameless", F.col("source").isNull()), "sizes")
    deal = stash(targets(rows, weights, share, repeats), "targets")
    order = ["_nameless", "source", "_key", "doc_id", "size", "content"]
    upto = running_sums(rows, order, {"size": "_upto"}, "order")
    few = deal.count() <= 10_000
    same = deal.withColumnRenamed("source", "_source")
    upto = upto.join(F.broadcast(same) if few else same, F.col("source").eqNullSafe(F.col("_source")))
    cum = F.col("_upto") - F.col("before")
    upto = stash(upto.withColumn("_cum", cum).drop("_source", "_key", "_nameless", "_upto", "before"), "cumulative")
    finish = [(F.lit(i) * F.col("source_size") + F.col("_cum")) / F.col("target") for i in range(repeats)]
    used = upto.where("size > 0 and target > 0")
    copies = used.select("rank", "_cum", "size", F.explode(F.array(*finish)).alias("_finish"))
    queue = running_sums(copies, ["_finish", "rank", "_cum"], {"size": "_mixed"}, "queue")
    budget = deal.agg(F.sum("target").alias("_budget"))
    last = (
        queue.crossJoin(F.broadcast(budget))  # one row
        .where(F.col("_mixed") <= F.col("_budget") + 1e-6)
        .agg(F.max(F.struct("_finish", "rank", "_cum")).alias("_last"))
    )
    place = [F.struct(f.alias("_finish"), F.col("rank"), F.col("_cum")) for f in finish]
    count = sum((F.coalesce(p <= F.col("_last"), F.lit(False)).cast("long") for p in place), F.lit(0).cast("long"))
    count = F.when((F.col("size") > 0) & (F.col("target") > 0), count).otherwise(F.lit(0).cast("long"))
    return upto.crossJoin(F.broadcast(last)).select(  # one row
        "doc_id", "content", "size", "source_size", "target", (count * F.col("size")).alias("taken"), count.alias("copies")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as ``mix`` takes it, with the columns of ``docs``."""
    name = spare(docs, "_copies")
    taken = mix(docs, **options).groupBy("doc_id", "content").agg(F.sum("copies").alias("copies")).where("copies > 0")
    rows = apply_decisions(docs, taken, "inner", {"copies": name})
    return rows.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(name)))).drop(name)
