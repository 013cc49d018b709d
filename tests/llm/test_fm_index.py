"""Benchmark decontamination against brute force: words, windows, spans and items of every text."""

import re

import numpy as np
import pytest

from strataframe.llm import fm_index as fm

DOCS = "doc_id long, text string, hits string, n_words int"
ITEMS = "item_id long, text string, hits string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    passages = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            passages.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for p, owners in passages.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found |= owners
        out.append((doc, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = ["a", "b", "c", "né", "漢字", "x9", "0"]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, prose(14)) for i in range(12)] + [(20, "A b, c!"), (21, "b"), (22, ""), (23, None), (24, "?!"), (None, prose(11)), (3, prose(10)), (25, items_long(rng))]
    docs = [(i, prose(30) + ". " + (items[i % 12][1] or "").upper().replace("É", "é") + "\n" + prose(5)) for i in range(30)]
    docs += [(40, None), (41, ""), (42, " \n"), (43, "x9"), (44, items[2][1]), (44, items[2][1]), (None, items[2][1] + " " + items[2][1]), (45, prose(700)), (46, "tail zz " + items_long(rng))]
    return docs, items


def items_long(rng):
    return "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 q13"


@pytest.mark.parametrize("shard,block,window", [(fm.SHARD_WORDS, fm.BLOCK, 10), (64, 40, 10), (7, 1 << 20, 3)])
def test_locate_equals_brute_force(spark, shard, block, window):
    docs, items = corpus()
    d = spark.createDataFrame([(*r, "h", 1) for r in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(*r, "h") for r in items], ITEMS)
    out = fm.locate(d, b, window, shard=shard, block=block)
    assert out.columns == ["doc_id", "text", "hits", "n_words", "_hits"]
    got = [(r.doc_id, r["_hits"].n_words, sorted({i for s in r["_hits"]["spans"] for i in range(s.start, s.end)}), r["_hits"]["items"]) for r in out.collect()]
    assert sorted(got, key=repr) == brute(docs, items, window)
    for r in out.collect():
        spans = [(s.start, s.end) for s in r["_hits"]["spans"]]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_decontaminate_cuts_only_what_was_hit(spark):
    text = "One two: q1 q2 Q3 q4 q5 q6 q7 q8 q9 q10, three é q1 q2"
    d = spark.createDataFrame([(1, text, "h", 1), (2, "clean é text", None, None), (3, None, None, None)], DOCS)
    b = spark.createDataFrame([(1, items_long(None), None)], ITEMS)
    out = fm.decontaminate(d, b)
    assert out.columns == d.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "One two:  , three é q1 q2", 2: "clean é text", 3: None}


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", None)], ITEMS)
    assert fm.contamination(none, items).count() == 0
    some = spark.createDataFrame([(1, "a b", None, 1)], DOCS)
    row = fm.contamination(some, spark.createDataFrame([], ITEMS)).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)


def test_suffix_order_is_that_of_sorting():
    rng = np.random.default_rng(1)
    for size, symbols in ((1, 2), (50, 2), (400, 3), (300, 1)):
        x = np.append(rng.integers(1, symbols + 1, size), 0)
        want = sorted(range(len(x)), key=lambda i: x[i:].tolist())
        assert fm.suffix_order(x).tolist() == want
