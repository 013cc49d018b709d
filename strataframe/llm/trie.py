"""Prefix trie of conversations: nodes in minimal perfect hash tables, one for each shard of subtrees.

A prefix of d turns has the XOR of its turns' digests, salted by their places, as its digest, so digests come from
running XORs and a parent's digest from one more XOR. Nodes are the distinct digests. Nodes with more than a shard's
rows below them form the spine; every subtree that hangs from it goes to one shard, and the spine to a last one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from .common import stash
from .turns import carried, numbered, turn_order

#: Rows of conversations below a node of the spine, at least; a shard holds about as many nodes.
SHARD_ROWS = 1 << 18
#: Slots of a hash level for each key that is still without one.
GAMMA = 1.5
SALTS = (1, 2)

NODE = "conv long, depth long, p1 long, p2 long, q1 long, q2 long, n_convs long, bytes long, parent long"
SUMS = "n_children long, n_leaves long, saved_tokens long"


def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit value from two longs, another one for each level (multiply and shift)."""
    salt = np.uint64((2 * level + 1) * 0xD1B54A32D192ED03 % (1 << 64))
    x = a.view(np.uint64) ^ (b.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt)
    for shift in (32, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Slots 0 … n-1 of n different keys of two longs. At each level the keys that meet no other take the place they
    hash to, the others go on to the next; a key's slot is the number of taken places before its own. Keys are kept by
    slot, so that a foreign key is known for one."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.taken, self.first = [], []
        left, done = np.arange(len(a)), 0
        slots = np.empty(len(a), np.int64)
        while len(left):
            size = int(GAMMA * len(left)) + 1
            place = (_mixed(a[left], b[left], len(self.taken)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            before = np.cumsum(alone) - alone + done
            settled = alone[place]
            slots[left[settled]] = before[place[settled]]
            self.taken.append(alone)
            self.first.append(before)
            done += int(alone.sum())
            left = left[~settled]
            if len(self.taken) > 200:
                raise ValueError("keys repeat")
        self.slots = slots
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[slots], self.b[slots] = a, b

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for keys that have none."""
        out = np.full(len(a), -1)
        left = np.arange(len(a))
        for level, (taken, first) in enumerate(zip(self.taken, self.first)):
            if not len(left):
                break
            place = (_mixed(a[left], b[left], level) % np.uint64(len(taken))).astype(np.int64)
            here = taken[place]
            out[left[here]] = first[place[here]]
            left = left[~here]
        same = (out >= 0) & (self.a[out] == a) & (self.b[out] == b)
        return np.where(same, out, -1)


def accumulate(nodes: pa.Table) -> pa.Table:
    """Children, leaves and saved bytes of the subtrees of a shard's nodes (columns ``NODE`` and, of what hangs from
    them in other shards, ``SUMS``); a parent in the shard gives its conversation too."""
    of = {c: nodes.column(c).to_numpy() for c in nodes.column_names if c not in ("parent", "shard")}
    table = PerfectHash(of["p1"], of["p2"])
    slot = table.slots
    flat = {c: np.empty(len(slot), np.int64) for c in ("conv", "depth", "n_convs", "bytes", "n_children", "n_leaves", "saved_tokens")}
    for c, values in flat.items():
        values[slot] = of[c]
    up = np.empty(len(slot), np.int64)
    up[slot] = np.where(of["depth"] > 0, table.find(of["q1"], of["q2"]), -1)
    inside = np.flatnonzero(up >= 0)
    np.add.at(flat["n_children"], up[inside], 1)
    flat["n_leaves"] += flat["n_children"] == 0
    flat["saved_tokens"] += (flat["n_convs"] - 1) * flat["bytes"]
    order = inside[np.argsort(-flat["depth"][inside], kind="stable")]
    bounds = np.flatnonzero(np.diff(flat["depth"][order])) + 1
    for level in np.split(order, bounds):  # from the deepest upwards, so a node is whole before it is added
        np.add.at(flat["n_leaves"], up[level], flat["n_leaves"][level])
        np.add.at(flat["saved_tokens"], up[level], flat["saved_tokens"][level])
    above = up[slot]
    parent = nodes.column("parent").combine_chunks()
    known = pa.array(flat["conv"][np.maximum(above, 0)], mask=above < 0)
    out = {c: nodes.column(c) for c in ("conv", "depth", "p1", "p2", "q1", "q2", "n_convs")}
    out |= {"parent": pa.compute.coalesce(known, parent)}
    out |= {c: pa.array(flat[c][slot]) for c in ("n_children", "n_leaves", "saved_tokens")}
    return pa.table(out)


RESULT = "conv long, depth long, p1 long, p2 long, q1 long, q2 long, n_convs long, parent long, n_children long, n_leaves long, saved_tokens long"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the conversations that end at each node, from rows sorted by node and conversation."""
    node, run = None, None
    names = ["p1", "p2", "depth", "ends_sha256"]
    for batch in batches:
        done = []
        for *key, conv in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if key != node:
                if run is not None:
                    done.append((*node, run.hexdigest()))
                node, run = key, hashlib.sha256(str(conv).encode())
            else:
                run.update(f",{conv}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)
    if run is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, run.hexdigest())], names)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv, depth, digest, bytes) of all turns: place by turn (nulls first, ties by role and text), SHA-256 of role and text,
    UTF-8 bytes of the text. Null roles and texts are empty; rows without conv_id belong to none."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    )
    rows = rows.select(
        "conv", "turn", "role", "text", F.octet_length("text").cast("long").alias("bytes"),
        F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256).alias("digest"),
    )
    ordered = numbered(rows, *turn_order(), "turns", drop=["role", "text"])
    return carried(ordered, "conv", {"depth": F.lit(True)}, {}).select("conv", "depth", "digest", "bytes")


def trie(turns: DataFrame, ids: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All nodes of the trie over sequences ``turns`` (conv, depth from 1, digest, bytes) of the conversations ``ids``
    (conv, each once), which may have no turns.

    A node is a sequence of first turns. Returns conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. No conversations, no nodes. A digest that two different sequences share is
    noticed (all its rows must agree in turn and parent) and ends the run.
    """
    spark = turns.sparkSession
    salted = [F.xxhash64(F.lit(s), "depth", "digest") for s in SALTS]
    ranged = numbered(turns, ["conv", "depth"], [], "rebuilt")
    prefix = carried(ranged, "conv", {}, {"p1": salted[0], "p2": salted[1]}).select(
        "conv", "depth", "p1", "p2", F.col("p1").bitwiseXOR(salted[0]).alias("q1"), F.col("p2").bitwiseXOR(salted[1]).alias("q2"), "digest", "bytes"
    )
    prefix = stash(prefix, "prefixes")
    lengths = stash(ids.join(turns.groupBy("conv").agg(F.max("depth").alias("length")), "conv", "left").select("conv", F.coalesce("length", F.lit(0).cast("long")).alias("length")), "lengths")

    below = prefix.join(lengths, "conv").withColumn("rest", F.col("length") - F.col("depth") + 1)
    one = [F.min(c) == F.max(c) for c in ("q1", "q2", "digest", "bytes")]
    agreed = one[0] & one[1] & one[2] & one[3]
    nodes = below.groupBy("depth", "p1", "p2").agg(
        F.when(agreed, F.min("conv")).otherwise(F.raise_error(F.lit("two sequences share a digest: use other SALTS"))).alias("conv"),
        F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"), F.sum("rest").alias("weight"),
    )
    nodes = stash(nodes, "nodes")
    total, top = lengths.agg(F.sum("length") + F.count(F.lit(1)), F.min("conv")).first()
    shards = int((total or 0) // shard_rows) + 1

    heavy = stash(nodes.where(F.col("weight") > shard_rows), "spine")
    on_spine = prefix.join(heavy.select("depth", "p1", "p2", F.col("conv").alias("hung")), ["depth", "p1", "p2"])
    deepest = on_spine.groupBy("conv").agg(F.max(F.struct("depth", "hung")).alias("_d")).select("conv", "_d.*")
    deepest = stash(deepest.withColumnRenamed("depth", "cut"), "cuts")
    hung = prefix.select("conv", "depth", F.xxhash64("p1", "p2").alias("key")).join(deepest, "conv", "left")
    hung = hung.where(F.col("depth") == F.coalesce("cut", F.lit(0)) + 1)
    hung = hung.select("conv", F.pmod("key", F.lit(shards)).alias("shard"), F.col("depth").alias("begin"), F.coalesce("hung", F.lit(top)).alias("parent"))

    zeros = [F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    named = ["conv", "depth", "p1", "p2", "q1", "q2", "n_convs", "bytes"]
    light = nodes.where(F.col("weight") <= shard_rows).join(hung, "conv")
    light = light.select(*named, F.when(F.col("depth") == F.col("begin"), F.col("parent")).alias("parent"), *zeros, "shard")
    light = stash(light.groupBy("shard").applyInArrow(accumulate, RESULT), "subtrees")

    # A subtree's top has its parent on the spine.
    tops = light.join(hung.select("conv", "begin"), "conv").where(F.col("depth") == F.col("begin"))
    hanging = tops.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    count = lengths.agg(F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    none = F.lit(0).cast("long")
    root = count.select(
        F.lit(top).cast("long").alias("conv"), *[none.alias(c) for c in named[1:6]], "n_convs", none.alias("bytes"),
    )
    spine = heavy.select(*named).unionByName(root.select(*named)).join(hanging, ["depth", "p1", "p2"], "left")
    spine = spine.select(*named, F.lit(None).cast("long").alias("parent"), *[F.coalesce(c, none).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")], F.lit(0).alias("shard"))
    spine = spine.groupBy("shard").applyInArrow(accumulate, RESULT)

    ends = lengths.where("length = 0").select("conv", none.alias("depth"), none.alias("p1"), none.alias("p2"))
    last = prefix.join(lengths, "conv").where(F.col("depth") == F.col("length")).select("conv", "depth", "p1", "p2")
    ends = ends.unionByName(last).select("p1", "p2", "depth", "conv").repartition("p1", "p2", "depth").sortWithinPartitions("p1", "p2", "depth", "conv")
    ends = ends.mapInArrow(_ends, "p1 long, p2 long, depth long, ends_sha256 string")
    out = light.unionByName(spine).join(ends, ["p1", "p2", "depth"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``trie`` of conversations (conv_id, turn, role, text) as they are."""
    ids = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv")).distinct()
    return trie(turn_rows(conversations), ids, shard_rows)


#: Conversations are rebuilt in families of so many, and take up to so many turns less one of the family's first.
FAMILY, TAKEN = 5, 9


def rebuilt_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``trie`` of conversations rebuilt to share beginnings: the first h turns of conversation c - c % 5, then those of
    c after its own first h; h is the checksum of c modulo 9."""
    turns = turn_rows(conversations)
    take = F.crc32(F.col("conv").cast("string")) % TAKEN
    sizes = stash(turns.groupBy("conv").agg(F.max("depth").alias("n")), "sizes")
    base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plans = sizes.select("conv", take.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    plans = stash(plans.join(base, "base", "left").withColumn("lent", F.least("h", F.coalesce("n_base", F.lit(0)))), "plans")
    own = turns.join(plans.select("conv", "h", "lent"), "conv").where(F.col("depth") > F.col("h"))
    own = own.select("conv", (F.col("depth") - F.col("h") + F.col("lent")).alias("depth"), "digest", "bytes")
    lent = turns.where((F.col("depth") < TAKEN) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "base")
    lent = lent.join(plans.select("conv", "base", "h"), "base").where(F.col("depth") <= F.col("h"))
    rows = own.unionByName(lent.select("conv", "depth", "digest", "bytes"))
    return trie(rows, plans.select("conv"), shard_rows)
