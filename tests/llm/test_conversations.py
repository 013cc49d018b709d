"""Structure repair and prefix trie against brute force, on small tables with nulls, ties, repeats and empties."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from strataframe.llm import repair, trie

SCHEMA = "conv_id long, turn long, role string, text string, rid string, depth string"
SEEN = re.compile(r"[^\x20\x09-\x0D]")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def in_order(rows, null):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, null if role is None else role, null if text is None else text))
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in by.items()}


def cheapest(rows):
    """rows: (initial, must go, truncated); cost and least letters by trying everything."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for to in "ua":
                if (state, to) in step:
                    cost, letters = best(i, to, inserted + 1)
                    ways.append((3 + cost, "I" + letters))
        if i < len(rows):
            initial, go, cut = rows[i]
            cost, letters = best(i + 1, state, 0)
            ways.append((4 + cost, "D" + letters))
            if not go:
                for to in "sua":
                    if (state, to) in step and (to == initial or to != "s"):
                        cost, letters = best(i + 1, to, 0)
                        ways.append(((0 if to == initial else 3) + 3 * cut + cost, ("K" if to == initial else "R") + letters))
        return min(ways, default=(10**9, ""))

    return best(0, "", 0)


def report(rows):
    seen, faults, coded, counts = set(), [], [], [0, 0, 0]
    for _, role, text in rows:
        if not SEEN.search(text):
            f = 0
        elif (role, text) in seen:
            f = 1
        elif not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text):
            f = 2
        else:
            f = None
        seen.add((role, text))
        faults.append(f)
        if f is not None:
            counts[f] += 1
        coded.append((role[:1], f in (0, 1), f == 2))
    cost, audit = cheapest(tuple(coded))
    out, i, state = [], 0, ""
    for e in audit:
        if e == "I":
            state = "a" if state == "u" else "u"
            out.append(("user" if state == "u" else "assistant") + ":")
            continue
        _, role, text = rows[i]
        i += 1
        if e == "D":
            continue
        state = role[:1] if e == "K" else "a" if state == "u" else "u"
        out.append((role if e == "K" else "user" if state == "u" else "assistant") + ":" + text)
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def messy(seed, convs=40, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["a.", "b!", "c", "é?", " \n", "", None, f"w{rng.random()}.", f"w{rng.random()}", "x. \n"])
            rows.append((c if c % 13 else None, rng.choice([t, t, t, t + 2, None]), role, text))
    return rows


@pytest.mark.parametrize("chunk,seed", [(1 << 12, 1), (2, 2), (1, 3), (4, 4)])
def test_repair_equals_brute_force(spark, chunk, seed):
    rows = messy(seed)
    got = {r[0]: tuple(r[1:]) for r in repair.structure_report(table(spark, rows), chunk=chunk).collect()}
    assert got == {c: report(x) for c, x in in_order(rows, " ").items()}


@pytest.mark.parametrize("texts", ["good", "tools", "copies"])
def test_long_conversations_settle_over_many_chunks(spark, texts):
    n = 60
    if texts == "good":
        rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for t in range(n)]
    elif texts == "tools":  # the cost vectors never lose their start
        rows = [(1, t, "tool", f"t{t}.") for t in range(n)]
    else:
        rows = [(1, t, "user", "same." if t > 2 else f"t{t}.") for t in range(n)]
    got = repair.structure_report(table(spark, rows), chunk=8).first()
    assert tuple(got[1:]) == report(in_order(rows, " ")[1])


def test_repaired_rows_have_a_legal_order_and_the_digest(spark):
    rows = messy(7, 20)
    edits = defaultdict(list)
    for r in repair.repair(table(spark, rows)).collect():
        edits[r.conv_id].append(r)
    digests = {r.conv_id: r for r in repair.structure_report(table(spark, rows)).collect()}
    assert set(edits) == set(digests)
    for c, own in edits.items():
        kept = sorted((r for r in own if r.edit != "D"), key=lambda r: r.position)
        assert [r.position for r in kept] == list(range(1, len(kept) + 1))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in kept))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == digests[c].repaired_sha256
        assert sorted(r.edit for r in own) == sorted(digests[c].audit)


def test_conversations_without_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.structure_report(none).count() == 0 and repair.repair(none).count() == 0
    ids = spark.createDataFrame([(5,), (None,), (5,)], "conv_id long")
    got = repair.structure_report(none, ids).collect()
    assert sorted(r.conv_id or 0 for r in got) == [0, 5]
    assert all(tuple(r[1:]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for r in got)


def test_damage(spark):
    rows = [(c, t, "assistant", f"t{t}. ok?") for c in range(30) for t in range(8)] + [(None, None, None, None), (7, None, "assistant", "a.b")]
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            want += [row] * (2 if kind == 3 else 1)
    assert sorted(map(tuple, repair.damaged(table(spark, rows)).collect()), key=repr) == sorted(want, key=repr)


def nodes_of(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in children[k])
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], digest(k)) for k, m in members.items())


def talk(seed, convs=30):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", None])) for c in range(convs) for t in range(rng.randint(1, 6))]
    rows += [(100, t, "user", "long") for t in range(60)] + [(101, t, "user", "long") for t in range(50)]  # a deep spine
    return rows + [(None, 0, "user", "lost"), (7, None, "user", "first"), (7, 0, "user", "tie"), (7, 0, "user", "tie")]


@pytest.mark.parametrize("shard_rows", [1 << 18, 40, 3])
def test_trie_equals_brute_force(spark, shard_rows):
    rows = talk(shard_rows)
    sequences = {c: [(r, t) for _, r, t in x] for c, x in in_order(rows, "").items() if c is not None}
    assert sorted(map(tuple, trie.prefix_trie(table(spark, rows), shard_rows).collect())) == nodes_of(sequences)


def test_rebuilt_trie_equals_brute_force(spark):
    rows = [r for r in talk(5) if r[0] != 10]
    own = {c: [(r, t) for _, r, t in x] for c, x in in_order(rows, "").items() if c is not None}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + x[h:]
    assert any(not x for x in built.values())
    assert sorted(map(tuple, trie.rebuilt_trie(table(spark, rows), 20).collect())) == nodes_of(built)


def test_trie_of_nothing(spark):
    assert trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_perfect_hash_is_minimal_and_knows_foreign_keys():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(1 << 62), 1 << 62, (5000, 2))
    table = trie.PerfectHash(keys[:, 0].copy(), keys[:, 1].copy())
    assert sorted(table.slots) == list(range(5000))
    assert (table.find(keys[:, 0].copy(), keys[:, 1].copy()) == table.slots).all()
    assert (table.find(keys[:, 1].copy(), keys[:, 0].copy()) == -1).all()
