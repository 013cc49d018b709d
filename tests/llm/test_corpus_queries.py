"""The named corpus queries beside DuckDB, those without SQL against brute force on whole tables, and the pipeline's stages."""

import hashlib
import sys
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from strataframe.llm import bpe, common, simhash  # noqa: E402
from strataframe.llm.queries import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    verdict, _ = compare(spark, SF, name, QUERIES[name], SQL[name], duck(SF))
    assert verdict == "ok"


def test_language_query(spark):
    got = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, SF).collect()}
    docs = rows_of(spark, "documents")
    assert len(got) == len(docs)
    held = [d for d in docs if got[d.doc_id].held_out and d.lang]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.9 * len(held)  # some 130 rows to learn from


def test_encoding_query(spark):
    ranks = bpe.parse_ranks(bpe.read_file(public_tokenizers.path(corpus_pipeline.RANKS)))
    reference = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {d.doc_id: d.text or "" for d in rows_of(spark, "documents")}
    got = QUERIES["op2_byte_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_simhash_query(spark):
    got = QUERIES["op4_simhash"](spark, SF).collect()
    prints = {d.doc_id: simhash.fingerprint(d.text) % (1 << 64) for d in rows_of(spark, "documents")}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    seen, component = set(), {}
    for start in sorted(prints):
        todo = [start] if start not in seen else []
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                component[at] = start
                todo += [i for i, p in prints.items() if i not in seen and (p ^ prints[at]).bit_count() <= 2]
    assert {r.doc_id: r.component_id for r in got} == component


def test_url_query(spark):
    got = QUERIES["op6_url_filter"](spark, SF).collect()
    assert len(got) == len(rows_of(spark, "pages"))
    assert all(r.verdict in ("allow", "block") for r in got)


def test_quality_query(spark):
    labels = {r.doc_id: r.quality for r in rows_of(spark, "labels")}
    got = [r for r in QUERIES["op7_quality_vote"](spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in got) >= 0.85 * len(got)


def test_line_query(spark):
    got = QUERIES["op10_line_dedup"](spark, SF).collect()
    docs = rows_of(spark, "documents")
    assert sorted(r.doc_id for r in got) == sorted(d.doc_id for d in docs)
    exact = {" ".join(x.lower().split()) for d in docs for x in (d.text or "").split("\n")} - {""}
    assert 0 < sum(r.n_kept for r in got) <= len(exact)  # similar lines go as well


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts, before = docs.columns, {}, []
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before.append({r.doc_id: r for r in docs.collect()})
        out = stage(spark, docs, SF)
        if at < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        texts[name] = [r for r in docs.collect()]
        assert texts[name]
    labels = {r.doc_id: r.quality for r in rows_of(spark, "labels")}
    kept = {r.doc_id for r in texts["quality_filter"]}
    assert sum(i in kept for i, q in labels.items() if q) >= 0.97 * sum(labels.values())
    assert sum(i in kept for i, q in labels.items() if not q) <= 0.3 * sum(not q for q in labels.values())
    lines = Counter(" ".join(x.lower().split()) for r in texts["line_dedup"] for x in (r.text or "").split("\n"))
    assert max((n for x, n in lines.items() if x), default=0) == 1
    prints = defaultdict(list)
    for i, r in before[2].items():
        prints[simhash.fingerprint(r.text) % (1 << 64)].append(i)
    left = [simhash.fingerprint(r.text) % (1 << 64) for r in texts["near_dedup"]]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(left) for b in left[:i])
    assert all(any((p ^ q).bit_count() <= 2 for q in left) or len(prints) > len(left) for p in prints)
    times = Counter(r.doc_id for r in texts["source_mix"])
    assert set(times.values()) <= {1, 2} and set(times) <= {r.doc_id for r in texts["near_dedup"]}
    total = sum(len((r.text or "").split()) for r in texts["near_dedup"])
    mixed = sum(len((r.text or "").split()) for r in texts["source_mix"])
    longest = max(len((r.text or "").split()) for r in texts["near_dedup"])
    assert 1.5 * total - 20 * longest <= mixed <= 1.5 * total + 1
    vocabulary = bpe.Vocabulary(bpe.parse_ranks(bpe.read_file(public_tokenizers.path(corpus_pipeline.RANKS))))
    whole = {r.doc_id: r.text or "" for r in texts["source_mix"]}
    assert len(texts["encode"]) == len(texts["source_mix"])
    assert all(vocabulary.decode(r.ids).decode() == whole[r.doc_id] and r.n_tokens == len(r.ids) for r in texts["encode"])


def test_near_dedup_stage_misses_no_similar_texts(spark):
    texts = []
    for family, size in enumerate([3, 20, 60, 200] * 3):
        base = [f"v{family}x{i * i % 97}" for i in range(size)]
        for changes in range(5):
            texts.append(" ".join(f"e{changes}" if i % (size // 4 + 1) == 2 and i // (size // 4 + 1) < changes else w for i, w in enumerate(base)))
    texts += ["", " "]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == set(root)
    assert len(set(root)) < len(set(texts)) - 2


def test_near_dedup_stage_links_near_fingerprints(spark):
    cycle = " ".join(f"w{i}" for i in range(9))
    base = " ".join([cycle] * 50)
    texts = [base, base + " a b c d e f", "quite another text"]  # 9 and 19 different shingles, 9 in common
    assert simhash.fingerprint(texts[0]) == simhash.fingerprint(texts[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {0, 2}


def test_pipeline_query(spark):
    assert entry.queries()["pipeline"](spark, SF).columns == ["doc_id", "n_tokens", "ids"]


def test_stages_free_what_earlier_ones_stored(spark, tmp_path):
    common.release("pipeline")
    docs, held = spark.read.parquet(f"{SF}/documents.parquet").limit(60), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = [path for _, path, owner in common._stashed if owner == "pipeline"]
        out = stage(spark, docs, SF)
        left = [path for _, path, owner in common._stashed if owner == "pipeline"]
        assert not set(before) & set(left)
        held.append(len(left))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert sum(held) > 3
    kept = common.stash(docs.select("doc_id"), "mine")
    common.release("pipeline", keep=docs)
    assert kept.count() == docs.count() and not any(owner == "pipeline" for _, _, owner in common._stashed)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, None, None, None, None), (2, "", None, None, 0)]])
def test_stages_take_empty_and_null_tables(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.schema(out.schema).parquet(str(tmp_path / name))
        assert docs.count() <= len(rows)
    assert docs.columns == ["doc_id", "n_tokens", "ids"]
