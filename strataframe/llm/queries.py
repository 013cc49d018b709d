"""Named queries of the corpus operators and, where SQL can say it, the same result as SQL over the raw tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact, fm_index, language, lines, mixing, ngram_lm, quality, repair, search, simhash, trie, urls
from .common import LOWER, UPPER, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


#: The vocabulary of op2 and of the pipeline.
RANKS = "byte_bpe_multi_50k.tiktoken"


@query("op2_byte_bpe")
def op2_byte_bpe(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, digests=True)


@query(
    "op3_source_mix",
    r"""WITH d AS (SELECT doc_id, source, md5(concat_ws(':', '42', doc_id)) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
  w AS (SELECT *, [3, 1, 2][((rank - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM s),
  r AS (SELECT *, sum(cap) OVER o AS caps, sum(weight) OVER o AS upto, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_w
    FROM w WINDOW o AS (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING)),
  l AS (SELECT *, max((1.5::DOUBLE * total::DOUBLE - (caps - cap)::DOUBLE) / (all_w - (upto - weight))::DOUBLE) OVER () AS level FROM r),
  t AS (SELECT source, rank, source_size, least(cap::DOUBLE, level * weight) AS target FROM l),
  c AS (SELECT d.doc_id, d.size, t.rank, t.source_size, t.target, sum(d.size) OVER (PARTITION BY t.rank ORDER BY k, d.doc_id, d.size
    ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
  q AS (SELECT *, (i * source_size + cum)::DOUBLE / target AS finish FROM c, (VALUES (0), (1)) AS v(i) WHERE size > 0 AND target > 0),
  m AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, cum ROWS UNBOUNDED PRECEDING) AS mixed FROM q),
  n AS (SELECT doc_id, count(*) AS copies FROM m WHERE mixed <= (SELECT sum(target) FROM t) + 1e-6 GROUP BY doc_id)
SELECT c.doc_id, c.size, c.source_size, c.target, (c.size * coalesce(n.copies, 0))::BIGINT AS taken FROM c LEFT JOIN n USING (doc_id)""",
)
def op3_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_simhash")
def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op5_backoff_score",
    rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS l FROM documents),
  w AS (SELECT doc_id, unnest(l) AS b, generate_subscripts(l, 1) AS i FROM d),
  p AS (SELECT *, lag(b) OVER o AS a, lag(b, 2) OVER o AS z FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  u AS (SELECT b, count(*) AS c, sum(count(*)) OVER () AS total FROM w GROUP BY b),
  g AS (SELECT a, b, count(*) AS c FROM p WHERE a IS NOT NULL GROUP BY a, b),
  h AS (SELECT z, a, b, count(*) AS c FROM p WHERE z IS NOT NULL GROUP BY z, a, b),
  s AS (SELECT p.doc_id, CASE WHEN h.c IS NOT NULL THEN ln(h.c / y.c)
    WHEN g.c IS NOT NULL THEN CASE WHEN p.z IS NULL THEN 0 ELSE ln(0.4) END + ln(g.c / x.c)
    ELSE CASE WHEN p.z IS NOT NULL THEN 2 * ln(0.4) WHEN p.a IS NOT NULL THEN ln(0.4) ELSE 0 END + ln(u.c / u.total) END AS s
    FROM p JOIN u ON p.b = u.b LEFT JOIN u x ON p.a = x.b LEFT JOIN g ON p.a = g.a AND p.b = g.b
    LEFT JOIN g y ON p.z = y.a AND p.a = y.b LEFT JOIN h ON p.z = h.z AND p.a = h.a AND p.b = h.b)
SELECT d.doc_id, count(s) AS n_words, round(coalesce(sum(s), 0), 4) AS log_score, round(sum(s) / nullif(count(s), 0), 6) AS mean_log_score
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id""",
)
def op5_backoff_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = ngram_lm.score(docs, ngram_lm.count_ngrams(docs))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


@query("op6_url_filter")
def op6_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op7_quality_vote")
def op7_quality_vote(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op8_bm25_top_k",
    rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS l FROM documents),
  w AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(l) AS t FROM d) GROUP BY doc_id, t),
  f AS (SELECT t, count(*) AS df FROM w GROUP BY t),
  n AS (SELECT doc_id, len(l) AS dl, avg(len(l)) OVER () AS mean, count(*) OVER () AS total FROM d),
  i AS (SELECT w.doc_id, w.t, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)) AS impact,
    ln(1 + (total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM w JOIN n USING (doc_id) JOIN f USING (t)),
  s AS (SELECT q.doc_id AS query_id, i.doc_id, round(sum(q.tf * i.idf * i.impact), 6) AS score FROM w q JOIN i USING (t)
    WHERE q.doc_id % 20 = 0 GROUP BY q.doc_id, i.doc_id),
  r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10""",
)
def op8_bm25_top_k(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    queries = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.top_k(docs, queries)


@query(
    "op9_exact_dedup",
    f"""WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)""",
)
def op9_exact_dedup(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op10_line_dedup")
def op10_line_dedup(spark, sf_dir):
    return lines.line_dedup_report(table(spark, sf_dir, "documents"), distance=None)


@query(
    "op11_fm_decontamination",
    rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{fm_index.WORD}') AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{fm_index.WORD}') AS w FROM benchmark),
  p AS (SELECT item_id, w[i:i + 9] AS g, len(w[i:i + 9]) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
  s AS (SELECT doc_id, i, w[i:i + n - 1] AS g, n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM p)
    WHERE i + n - 1 <= len(w)),
  o AS (SELECT DISTINCT s.doc_id, s.i, s.n, p.item_id FROM s JOIN p ON s.n = p.n AND s.g = p.g),
  h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM o) GROUP BY doc_id),
  t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
)
def op11_fm_decontamination(spark, sf_dir):
    return fm_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text of ASCII characters."""
    bits = "lambda x, y: xor(x >> 1, (x & 1) * 3988292384)"  # the polynomial, a bit at a time
    coded = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {coded}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {bits})), 4294967295)"


def _edit(cost: int | str, letter: str, after: str) -> str:
    """SQL of a cost in nine digits and letters behind it, with an edit put before them."""
    return f"printf('%09d', {after}[:9]::INT + {cost}) || '{letter}' || {after}[10:]"


def _way(state: int) -> str:
    """SQL of the cheapest edit of a row in a state, letters breaking ties."""
    ways = [_edit(repair.DELETE, "D", f"a{state}")]
    for initial, kept in repair.KEPT.items():
        if state in kept:
            ways.append(f"CASE WHEN c = '{repair.INITIALS[initial]}' AND f NOT IN (1, 2) THEN {_edit('t', 'K', f'a{kept[state]}')} END")
    ways.append(f"CASE WHEN f NOT IN (1, 2) THEN {_edit(f'{repair.REROLE} + t', 'R', f'a{repair.TURN[state]}')} END")
    return f"least({', '.join(ways)}) AS e{state}"


def _inserted(state: int) -> str:
    once, twice = repair.TURN[state], repair.TURN[repair.TURN[state]]
    return f"least(e{state}, {_edit(3, 'I', f'e{once}')}, {_edit(6, 'II', f'e{twice}')}) AS a{state}"


@query(
    "op12_structure_repair",
    rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
  r AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k, range(CASE kind WHEN 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
  o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM r),
  v AS (SELECT *, role[:1] AS c, lag(role[:1]) OVER (PARTITION BY conv_id ORDER BY i) AS b,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS f FROM o),
  w AS (SELECT *, CASE f WHEN 3 THEN 3 ELSE 0 END AS t FROM v),
  z AS (SELECT conv_id, max(n) + 1 AS i, '000000000' AS a0, '000000006II' AS a1, '000000003I' AS a2, '000000000' AS a3 FROM w GROUP BY conv_id
    UNION ALL SELECT conv_id, i, {", ".join(_inserted(s) for s in range(4))} FROM (SELECT w.conv_id, w.i, {", ".join(_way(s) for s in range(4))}
      FROM z JOIN w ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = z.i - 1)),
  p AS (SELECT conv_id, a0[:9]::BIGINT AS cost, a0[10:] AS audit FROM z WHERE i = 1),
  x AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS pos FROM p),
  y AS (SELECT conv_id, pos, audit[pos] AS e, sum((audit[pos] <> 'I')::INT) OVER u AS i, sum((audit[pos] <> 'D')::INT) OVER u AS put FROM x
    WINDOW u AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  g AS (SELECT y.*, w.role, w.text, w.c, max((put = 1 AND e = 'K' AND w.c = 's')::INT) OVER (PARTITION BY y.conv_id) AS sys
    FROM y LEFT JOIN w ON y.conv_id IS NOT DISTINCT FROM w.conv_id AND y.i = w.i AND e <> 'I' WHERE e <> 'D'),
  h AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (put - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE e WHEN 'I' THEN '' ELSE text END,
    chr(10) ORDER BY pos)) AS digest FROM g GROUP BY conv_id),
  m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate,
    count(*) FILTER (f = 3) AS truncated, count(*) FILTER (i > 1 AND b || c NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN m ON d.conv_id IS NOT DISTINCT FROM m.conv_id
  LEFT JOIN p ON d.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN h ON d.conv_id IS NOT DISTINCT FROM h.conv_id""",
)
def op12_structure_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return repair.structure_report(repair.damaged(rows), rows)


@query(
    "op13_prefix_trie",
    rf"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
  n AS (SELECT c, max(i) AS n, {_crc32("c::VARCHAR")} % 9 AS h FROM t GROUP BY c),
  p AS (SELECT n.c, n.h, n.c - n.c % 5 AS base, least(n.h, coalesce(b.n, 0)) AS lent FROM n LEFT JOIN n b ON b.c = n.c - n.c % 5),
  r AS (SELECT p.c, t.i AS d, t.role, t.text FROM p JOIN t ON t.c = p.base AND t.i <= p.h
    UNION ALL SELECT p.c, t.i - p.h + p.lent, t.role, t.text FROM p JOIN t ON t.c = p.c AND t.i > p.h),
  x AS (SELECT c, d, strlen(text) AS bytes, sha256(string_agg(len(role) || ':' || role || len(text) || ':' || text, '' ) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM r),
  l AS (SELECT c, 0 AS d, 0 AS bytes, '' AS k FROM p UNION ALL SELECT c, d, bytes, k FROM x),
  y AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM l),
  v AS (SELECT d, k, min(up) AS up, min(c) AS c, count(*) AS n_convs, max(bytes) AS bytes,
    coalesce(sha256(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends)), sha256('')) AS ends_sha256 FROM y GROUP BY d, k),
  w AS (SELECT v.*, (SELECT count(*) FROM v z WHERE z.up = v.k AND z.d = v.d + 1) AS n_children FROM v),
  s AS (SELECT a.d, a.k, sum((w.n_children = 0)::INT) AS n_leaves, sum((w.n_convs - 1) * w.bytes) AS saved
    FROM w JOIN y a ON a.c = w.c AND a.d <= w.d GROUP BY a.d, a.k)
SELECT w.c AS conv_id, w.d::BIGINT AS depth, q.c AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN s USING (d, k) LEFT JOIN v q ON q.d = w.d - 1 AND q.k = w.up""",
)
def op13_prefix_trie(spark, sf_dir):
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))
