"""Connected components of an edge table by alternating star contractions, all as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, stash


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Return (node, root) for every node of ``edges`` (columns u, v, both long); root is the component's least node.

    Each round hangs the larger neighbours of every node on the least of them, then does so for the smaller ones; the
    number of rounds grows with the logarithm of the longest chain. A round is stored in the shared folder. Loops and
    repeated edges are ignored; an empty table gives an empty result.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = stash(pairs, "edges")
    state = _state(pairs)
    for _ in range(max_rounds):
        if not state[0]:
            break
        before, pairs = pairs, stash(_small_star(_large_star(pairs)), "edges")
        discard(before)
        last, state = state, _state(pairs)
        if last == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _state(pairs: DataFrame) -> tuple:
    digest = F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF))
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(digest)).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def shared_blocks(rows: DataFrame, needed: Column | None = None) -> DataFrame:
    """The rows (key, id, ...) of those keys that several ids have, with ``members``; ``needed`` must hold for one of a key's rows.

    Where the rows have a ``root``, ids with the same one are connected already, and count as one of the several.
    """
    apart = "root" if "root" in rows.columns else "id"
    block = Window.partitionBy("key")
    some = F.lit(True) if needed is None else F.max(needed).over(block)
    sized = rows.select("*", F.count(F.lit(1)).over(block).alias("members"), F.min(apart).over(block).alias("_low"), F.max(apart).over(block).alias("_high"), some.alias("_needed"))
    return sized.where("_low < _high and _needed").drop("_low", "_high", "_needed")


def connecting_links(
    shared: DataFrame,
    near: Column,
    pairwise: Column,
    verified: Callable[[DataFrame], DataFrame],
    large: int,
    rounds: int,
    finer: tuple[Callable[[DataFrame], DataFrame], Column] | None = None,
) -> DataFrame:
    """Links (u, v) that connect what all verified links of ``shared_blocks`` rows connect.

    Small blocks are compared in pairs. In a block of more than ``large`` rows all are compared with one of them,
    another in each of a few rounds, and rows that are connected by then need no comparison; only rows of such blocks
    that are still apart are compared in pairs at last. So a family of many similar items costs its size, not its
    square. ``near`` and ``pairwise`` are conditions on the columns of two rows (a_..., b_...) that save a look at the
    items themselves: for any two, and for pairs of which some block must have both. ``finer`` adds columns to the rows that
    are compared in pairs at last, and has one more condition for them.
    """
    if "root" not in shared.columns:  # else what is connected from the start
        shared = shared.withColumn("root", F.col("id"))
    few = shared.where(F.col("members") <= large).drop("members")
    links = stash(verified(_pairs(few, few, pairwise).where("u < v")), "links")
    crowd = shared.where(F.col("members") > large).drop("members")
    crowd = stash(_open(_rooted(crowd, links)), "open")
    for number in range(rounds):
        if crowd.isEmpty():
            return links
        heads = crowd.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(number)), *[c for c in crowd.columns if c != "key"])).alias("head"))
        heads = heads.select("key", *[f"head.{c}" for c in crowd.columns if c != "key"])
        more = stash(verified(_pairs(crowd, heads, near)), "star")
        links = links.union(more)
        before, crowd = crowd, stash(_open(_rooted(crowd, more)), "open")
        discard(before)
    if finer is not None and not crowd.isEmpty():
        crowd, pairwise = finer[0](crowd), pairwise & finer[1]
    rest = stash(_pairs(crowd, crowd, pairwise).where("u < v"), "rest")
    return links.union(verified(rest))


def _pairs(left: DataFrame, right: DataFrame, near: Column) -> DataFrame:
    """Distinct (u, v) of rows with the same key that may be similar; those known to be of one group (root) are left out."""
    a = left.select("key", *[F.col(c).alias(f"a_{c}") for c in left.columns if c != "key"])
    b = right.select("key", *[F.col(c).alias(f"b_{c}") for c in right.columns if c != "key"])
    return a.join(b, "key").where("a_root <> b_root").where(near).select(F.col("a_id").alias("u"), F.col("b_id").alias("v")).distinct()


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (id, root, ...) with the roots that the links between their ids give."""
    ends = rows.select("id", "root").distinct()
    u, v = ends.select(F.col("id").alias("u"), F.col("root").alias("ru")), ends.select(F.col("id").alias("v"), F.col("root").alias("rv"))
    between = links.join(u, "u").join(v, "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    found = connected_components(between).select(F.col("node").alias("root"), F.col("root").alias("_new"))
    return rows.join(found, "root", "left").withColumn("root", F.coalesce("_new", "root")).drop("_new")


def _open(rows: DataFrame) -> DataFrame:
    """The rows of those blocks whose items are not yet all of one group."""
    apart = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return rows.join(apart, "key", "left_semi")
