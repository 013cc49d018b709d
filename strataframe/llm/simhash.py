"""SimHash near-dedup: word-shingle fingerprints, pigeonhole blocks, Hamming check, connected components."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import apply_decisions, content, stash
from .components import connected_components, connecting_links, shared_blocks

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: The fingerprint is cut into BLOCKS parts; fingerprints within DISTANCE bits agree in BLOCKS - DISTANCE of them.
BLOCKS = 5
#: Blocks with more fingerprints than this are linked through shared one-bit neighbours instead of in pairs.
LARGE_BLOCK = 32
#: Blocks of at most so many shingle sets are compared in pairs at once; larger ones are linked to one of them in rounds.
PAIR_BLOCK, ROUNDS = 4, 4
#: Ids of sets to be compared, up to which they go to all tasks (8 bytes each), so that other sets stay where they are.
FEW_IDS = 1 << 20
#: Bits of a set's sketch, and of that of sets which it leaves; up to so many of the first kind go to all tasks (10 MB).
SKETCH, WIDE_SKETCH, FEW_SKETCHES = 1024, 8192, 1 << 16
#: Shingles whose bits are counted at once.
CHUNK = 1 << 14

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit fingerprint as a signed integer: a bit is 1 if set in over half of the shingles' XXH64."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not found:
        return 0
    count = max(1, len(found) - width + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, count, CHUNK):
        part = found[at : at + CHUNK + width - 1]
        if count == 1:
            hashed = digest(b" ".join(part), SEED)
        else:
            hashed = b"".join([digest(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(width)))])
        bits = np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, content, fp) for every row of ``docs``; whole texts, null and wordless ones have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t.as_py(), width) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], prints], names=["doc_id", "content", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = docs.select("doc_id", content(F.col("text")).alias("content"), F.col("text").cast("string"))
    return whole.mapInArrow(run, f"doc_id {kind}, content bigint, fp bigint")


def block_keys(fp: Column, blocks: int, agree: int) -> list[Column]:
    """One key for each choice of ``agree`` of the ``blocks`` parts: the choice's number and the bits chosen."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), agree)):
        mask = sum(masks[i] for i in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(number).cast("byte").alias("part"), fp.bitwiseAND(F.lit(mask)).alias("bits")))
    return keys


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, large: int = LARGE_BLOCK) -> DataFrame:
    """Edges (u, v) whose components are those of all distinct ``fp`` values at ``distance`` or fewer differing bits.

    Fingerprints that share a block are compared. In a block with more than ``large`` of them no pairs are made: each
    is joined to the fingerprints that share one of its neighbours at up to ``ceil(distance / 2)`` bits (for distance
    1 or 2), which is exact: two fingerprints differ in two bits or fewer if and only if they have such a neighbour in
    common, so linking all of a neighbour's fingerprints to the least of them links what the pairs would.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    keyed = prints.select("fp", F.explode(F.array(*block_keys(F.col("fp"), blocks, blocks - distance))).alias("key"))
    keyed = keyed.select("fp", "key.part", "key.bits").repartition("part", "bits")
    sizes = keyed.groupBy("part", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stash(keyed.join(sizes, ["part", "bits"]), "blocks")
    few = shared.where(F.col("n") <= large)
    other = few.select("part", "bits", F.col("fp").alias("v"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= distance
    pairs = few.join(other, ["part", "bits"]).where((F.col("fp") < F.col("v")) & near).select(F.col("fp").alias("u"), "v")
    crowd = shared.where(F.col("n") > large).select("fp").distinct()
    flips = [F.lit(0).cast("long"), *[F.lit((1 << i) - ((1 << i >> 63) << 64)) for i in range(64)]]
    flipped = F.explode(F.array(*[F.col("fp").bitwiseXOR(x) for x in flips])).alias("near")
    if distance == 1:  # a single differing bit: the pair (with the bit cleared, the bit's number) is shared
        flipped = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(~(1 << i) if i < 63 else (1 << 63) - 1)).alias("b")) for i in range(64)])).alias("near")
    spread = crowd.select("fp", flipped).repartition("near")
    least = spread.groupBy("near").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hubs = spread.join(least, "near").where("fp <> u").select("u", F.col("fp").alias("v"))
    return pairs.union(hubs).distinct()


def grouped(docs: DataFrame, width: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """The rows as (doc_id, content, fp), and the distinct fingerprints as (fp, least doc_id, root of the group)."""
    prints = stash(fingerprints(docs, width), "fingerprints")
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(links(nodes))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left")
    return prints, stash(nodes.select("fp", "least", F.coalesce("root", "fp").alias("root")), "groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Group documents whose fingerprints are linked by 2 or fewer differing bits, directly or through others.

    Returns doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of the group; null if all its ids
    are), one row per row of ``docs``. Null, empty and wordless texts have fingerprint zero and are linked like any
    other. Equal fingerprints are one node, so copies make no pairs. Only doc_id and text are read.
    """
    prints, nodes = grouped(docs)
    heads = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(heads, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def _shingles(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, content, id, fp, size, bits, hashes, keys) of every row.

    ``id`` tells different word lists apart, ``fp`` is the text's fingerprint, ``hashes`` are the different shingles, ``keys`` the smallest of them, so many
    that two sets at the similarity share one: they have at least similarity * size of either in common. ``bits`` tells
    for SKETCH classes of hashes whether a set has an odd number of them: where two sets differ, so do the sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            ids, prints, sets, keys, bits = [], [], [], [], []
            for text in batch.column(2):
                found = _WORD.findall((text.as_py() or "").encode("utf-8", "surrogatepass").translate(_LOWER))
                count = max(1, len(found) - width + 1) if found else 0
                hashed = b"".join([xxhash.xxh64_digest(b" ".join(found[i : i + width]), SEED) for i in range(count)])
                own = np.unique(np.frombuffer(hashed, ">i8").astype(np.int64))
                ids.append(np.frombuffer(xxhash.xxh64_digest(b" ".join(found), SEED), ">i8")[0])
                prints.append(fingerprint(text.as_py()))
                sets.append(own)
                bits.append(_parities(own, SKETCH))
                keys.append(own[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1])
            sizes = [len(x) for x in sets]
            columns = [pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "content", "id", "fp", "size", "bits", "hashes", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = docs.select("doc_id", content(F.col("text")).alias("content"), F.col("text").cast("string"))
    return whole.mapInArrow(run, f"doc_id {kind}, content bigint, id bigint, fp bigint, size bigint, bits array<bigint>, hashes array<bigint>, keys array<bigint>")


def _parities(own: np.ndarray, classes: int) -> np.ndarray:
    """A bit for each class of hashes: whether a set has an odd number of them. As longs."""
    odd = np.bincount(own & (classes - 1), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _wide_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [h.values.to_numpy(zero_copy_only=False) for h in batch.column("hashes")]
        bits = pa.array([_parities(x, WIDE_SKETCH) for x in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in sets], pa.int64()), bits], names=["id", "size", "bits"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()


def _bounded(pairs: DataFrame, sketches: DataFrame, similarity: float, small: bool) -> DataFrame:
    """The pairs (u, v) that may reach the similarity by what ``sketches`` (id, size, bits) say."""
    u, v = (sketches.toDF(end, f"{end}_size", f"{end}_bits") for end in "uv")
    if small:
        u, v = F.broadcast(u), F.broadcast(v)
    differ = F.aggregate(F.zip_with("u_bits", "v_bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, n: a + n)
    total = F.col("u_size") + F.col("v_size")
    both = (total - differ) / 2
    return pairs.join(u, "u").join(v, "v").where(both >= similarity * (total - both) - 1e-9).select("u", "v")


def _print_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) that connect the ids of ``nodes`` (id, fp) whose fingerprints are equal or near, directly or through others."""
    heads = stash(nodes.groupBy("fp").agg(F.min("id").alias("head")), "heads")
    same = nodes.join(heads, "fp").where("id <> head").select(F.col("head").alias("u"), F.col("id").alias("v"))
    u, v = heads.toDF("u", "u_head"), heads.toDF("v", "v_head")
    between = links(heads).join(u, "u").join(v, "v").select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))
    return stash(same.union(between), "print_links")


def _similar(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, content, root): rows with near fingerprints, or sets of shingles at this Jaccard similarity, share a root.

    Both directly or through others. Fingerprints come first; sets are compared only where they left texts apart.
    """
    found = _shingles(docs, width, similarity)
    rows = stash(found.select("doc_id", "content", "id"), "names")
    # Sets are stored once, those of one text for each id.
    nodes = stash(found.dropDuplicates(["id"]).select("id", "fp", "size", "bits", "hashes", "keys"), "nodes")
    told = _print_links(nodes.select("id", "fp"))
    roots = connected_components(told).withColumnRenamed("node", "id")
    keyed = nodes.select("id", "size", "keys").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    shared = stash(shared_blocks(keyed.select(F.explode("keys").alias("key"), "id", "size", "root")), "blocks")
    sets, sketches = nodes.select("id", "hashes"), nodes.select("id", "size", "bits")

    def verified(pairs: DataFrame) -> DataFrame:
        # Sets whose sketches differ in d classes differ in d hashes at least. Pairs that this bound leaves are held against
        # it once more with wider sketches, what is left then is compared in full; only those sets are moved.
        pairs = stash(pairs, "pairs")
        ends = stash(_ends(pairs), "ends")
        told = sketches.join(F.broadcast(ends) if ends.count() <= FEW_IDS else ends, "id", "left_semi")
        likely = stash(_bounded(pairs, told, similarity, ends.count() <= FEW_SKETCHES), "likely")
        ends = stash(_ends(likely), "ends")
        needed = sets.join(F.broadcast(ends) if ends.count() <= FEW_IDS else ends, "id", "left_semi")
        wide = stash(needed.mapInArrow(_wide_sketches, "id bigint, size bigint, bits array<bigint>"), "wide")
        likely = stash(_bounded(likely, wide, similarity, False), "likely")
        ends = stash(_ends(likely), "ends")
        needed = sets.join(F.broadcast(ends) if ends.count() <= FEW_IDS else ends, "id", "left_semi")
        first, second = (needed.toDF(end, f"{end}_hashes") for end in "uv")
        both = F.size(F.array_intersect("u_hashes", "v_hashes"))
        return likely.join(first, "u").join(second, "v").where(both >= similarity * (F.size("u_hashes") + F.size("v_hashes") - both) - 1e-9).select("u", "v")

    near = F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size") - 1e-9
    roots = connected_components(told.union(connecting_links(shared, near, near, verified, PAIR_BLOCK, ROUNDS)))
    return rows.select("doc_id", "content", "id").join(roots, F.col("id") == F.col("node"), "left").select("doc_id", "content", F.coalesce("root", "id").alias("root"))


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """Keep one row of each group of ``near_duplicates``: the smallest doc_id, ties by content; null ids come last.

    With ``similarity`` the groups are those of near fingerprints (of SHINGLE words) together with those of shingle sets (of
    ``width`` words) with at least this Jaccard similarity, most of which fingerprints miss; none is missed here. Texts without words are one group. The columns are those of
    ``docs``. Of rows that repeat both id and text one can stay.
    """
    if similarity is not None:
        rows = _similar(docs, width, similarity)
    else:
        prints, nodes = grouped(docs, width)
        rows = prints.join(nodes.select("fp", "root"), "fp")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("best"))
    return apply_decisions(docs, best.select("best.doc_id", "best.content"), "left_semi")
