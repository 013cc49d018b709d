"""Rubrics, report tables, listings, catalog scans, text scan and the audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.operators import audit as A, report as R, rubric as U, scan as T
from strataframe.sources import cohorts as C, listings as L

from .registry import crossed, nested, query, rounded, table

# ---- verdicts ---------------------------------------------------------------------------------------------------------


def _signals(spark, sf):
    l = table(spark, sf, "lineitem")
    cell = F.concat("l_returnflag", "l_linestatus")
    layout = F.when(cell == "AF", "W,C").when(cell == "NF", "T,C").when(cell == "NO", "W,N").otherwise("T,N")
    late = lambda m: F.avg(F.when(F.col("l_suppkey") % 3 == m, F.col("l_discount")))
    return l.groupBy(cell.alias("cell"), layout.alias("layout"), F.col("l_linenumber").alias("model")).agg(
        (late(0) - 0.045).alias("delta_label"),
        (late(1) * 12).alias("ba_first"),
        (late(2) * 9).alias("ba_last"),
        (F.avg("l_tax") * 15).alias("ba_max"),
        (F.avg("l_discount") * 7).alias("ba_depth"),
        (late(0) * 1.02).alias("c_bar"),
        (late(1) - 0.02).alias("state_drop"),
        (late(2) * 1.001).alias("subject_drop"),
    )


SIGNALS = """WITH g AS (SELECT l_returnflag || l_linestatus AS cell, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'W,C' WHEN 'NF' THEN 'T,C' WHEN 'NO' THEN 'W,N' ELSE 'T,N' END AS layout,
  l_linenumber AS model, avg(l_discount) FILTER (l_suppkey % 3 = 0) AS d0, avg(l_discount) FILTER (l_suppkey % 3 = 1) AS d1, avg(l_discount) FILTER (l_suppkey % 3 = 2) AS d2,
  avg(l_tax) AS tx, avg(l_discount) AS dd FROM lineitem GROUP BY ALL),
s AS (SELECT cell, layout, model, d0 - 0.045 AS delta_label, d1 * 12 AS ba_first, d2 * 9 AS ba_last, tx * 15 AS ba_max, dd * 7 AS ba_depth, d0 * 1.02 AS c_bar,
  d1 - 0.02 AS state_drop, d2 * 1.001 AS subject_drop FROM g),
c AS (SELECT cell, layout, avg(delta_label) AS dl, avg(ba_last) AS bl, avg(ba_max) AS bm, avg(ba_depth) AS bd, avg(c_bar) AS cb, avg(state_drop) AS sd, avg(subject_drop) AS sj FROM s GROUP BY ALL),
v AS (SELECT *, CASE WHEN dl >= 0.005 THEN '+' ELSE '-' END AS delta_label_sign,
  CASE WHEN bm >= 0.6 THEN CASE WHEN bd <= 0.35 AND bm - bl >= 0.04 THEN '+ early' ELSE '+' END WHEN bl <= 0.45 THEN '- deep' ELSE '-' END AS layer_probe,
  CASE WHEN layout LIKE 'T,%' THEN '0' WHEN cb >= 0.05 THEN '+' ELSE '-' END AS c_sign,
  CASE WHEN sd > 0.03 THEN 'state signal' WHEN sj > 0.05 AND layout LIKE 'W,%' THEN 'subject confound' ELSE 'subject axis' END AS role FROM c),
a AS (SELECT s.cell, count(*) AS n, count(*) FILTER ((delta_label >= 0.005) = (delta_label_sign = '+')) AS da, count(*) FILTER ((ba_max >= 0.6) = (layer_probe[1] = '+')) AS la,
  count(*) FILTER (s.layout LIKE 'T,%' OR (c_bar >= 0.05) = (c_sign = '+')) AS ca,
  count(*) FILTER (CASE WHEN state_drop > 0.03 THEN 'state signal' WHEN subject_drop > 0.05 AND s.layout LIKE 'W,%' THEN 'subject confound' ELSE 'subject axis' END = role) AS ra
  FROM s JOIN v USING (cell) GROUP BY s.cell)
SELECT cell, '(' || replace(layout, ',', ', ') || ')' AS layout, delta_label_sign, layer_probe, c_sign AS c_bar, role AS spectral_role,
  CASE WHEN layout = 'W,C' AND delta_label_sign = '+' AND layer_probe[1] = '+' AND c_sign = '+' THEN 'Cross-subject-aligned'
  WHEN layout = 'T,C' AND delta_label_sign = '+' AND layer_probe[1] = '+' THEN 'Label-subject coupled'
  WHEN layout = 'W,N' AND delta_label_sign = '-' AND layer_probe[1] = '-' AND c_sign IN ('-', '0') THEN 'Idiosyncratic within-subject'
  WHEN layout = 'T,N' AND delta_label_sign = '-' AND layer_probe[1] = '-' THEN 'Below linear-probe resolution' ELSE 'Uncategorized' END AS outcome,
  round(dl, 6) AS delta_label_value, round(bm, 6) AS layer_max_ba, round(bl, 6) AS layer_last_ba, round(bd, 6) AS layer_argmax_depth,
  CASE WHEN layout LIKE 'T,%' THEN 'nan'::DOUBLE ELSE round(cb, 6) END AS c_bar_value, round(sd, 6) AS state_drop, round(sj, 6) AS subject_drop,
  da AS delta_agree, n AS delta_total, la AS layer_agree, n AS layer_total, ca AS c_bar_agree, n AS c_bar_total, ra AS role_agree, n AS role_total FROM v JOIN a USING (cell)"""


@query("verdict_matrix", SIGNALS)
def verdict_matrix(spark, sf):
    return rounded(U.verdict_matrix(_signals(spark, sf)))


def _board(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("dataset")).agg(
        F.avg("l_discount").alias("label_frac"),
        F.avg("l_tax").alias("subject_frac"),
        (F.avg("l_quantity") / 50).alias("raw_label_ba"),
        (F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))) / 50).alias("identity_free_label_ba"),
        (F.min("l_discount") * 10).alias("layer_label_ba_last"),
        (F.max("l_discount") * 7).alias("layer_label_ba_max"),
        (F.max("l_tax") * 4).alias("layer_argmax_depth"),
        (F.avg("l_discount") - 0.02).alias("state_drop"),
        (F.avg("l_tax") + 0.01).alias("subject_drop"),
    )
    return R.with_verdict(s.withColumn("status", F.when(F.col("dataset") % 10 == 0, "failed: timeout").otherwise("ok")))


BOARD = """WITH b AS (SELECT l_suppkey AS dataset, avg(l_discount) AS lf, avg(l_tax) AS sf, avg(l_quantity) / 50 AS raw, avg(l_quantity) FILTER (l_linestatus = 'O') / 50 AS free,
  min(l_discount) * 10 AS ll, max(l_discount) * 7 AS lm, max(l_tax) * 4 AS ld, avg(l_discount) - 0.02 AS sd, avg(l_tax) + 0.01 AS sj FROM lineitem GROUP BY l_suppkey)"""


@query(
    "leaderboard",
    BOARD
    + """ SELECT dataset, round(free - raw, 6) AS lift, CASE WHEN lf IS NULL OR sf IS NULL OR raw IS NULL OR free IS NULL THEN 'n/a' WHEN sf > lf AND free >= raw - 1e-9 THEN 'TRAP'
  WHEN sf > lf THEN 'identity-reliant' ELSE 'task-carried' END AS verdict,
  concat_ws(',', CASE WHEN ld <= 0.35 AND lm - ll >= 0.04 THEN '+early' END, CASE WHEN ll <= 0.45 THEN '-deep' END) AS layer_sign,
  concat_ws(';', CASE WHEN sj > 0.05 THEN 'subject confound' END, CASE WHEN sd > 0.03 THEN 'state signal' END) AS oneoverf_role FROM b WHERE dataset % 10 <> 0""",
)
def leaderboard(spark, sf):
    return rounded(R.leaderboard(_board(spark, sf)).select("dataset", "lift", "verdict", "layer_sign", "oneoverf_role"))


@query("leaderboard_failures", "SELECT DISTINCT l_suppkey AS dataset, 'failed: timeout' AS status FROM lineitem WHERE l_suppkey % 10 = 0")
def leaderboard_failures(spark, sf):
    return R.leaderboard_failures(_board(spark, sf))


def _scores(spark, sf):
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("tier"),
        F.concat(F.lit("m"), "l_linenumber").alias("method"),
        F.col("l_linenumber").alias("method_ord"),
        F.col("l_linestatus").alias("cell"),
        (F.col("l_suppkey") % 3).alias("seed"),
    ).agg(F.avg("l_discount").alias("value"))


@query(
    "master_table",
    """WITH v AS (SELECT l_returnflag AS tier, 'm' || l_linenumber AS method, l_linenumber AS method_ord, l_linestatus AS cell, avg(l_discount) AS value FROM lineitem GROUP BY ALL, l_suppkey % 3),
s AS (SELECT tier, method, method_ord, cell, avg(value) AS m, CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END AS sd FROM v GROUP BY ALL),
b AS (SELECT *, method_ord = first_value(method_ord) OVER (PARTITION BY tier, cell ORDER BY m DESC, method_ord) AS best FROM s),
t AS (SELECT *, CASE WHEN best THEN '**' ELSE '' END || printf('%.3f', m) || ' ± ' || printf('%.3f', sd) || CASE WHEN best THEN '**' ELSE '' END AS txt FROM b)
SELECT tier, method, method_ord, coalesce(max(txt) FILTER (cell = 'F'), '—') AS "F", coalesce(max(txt) FILTER (cell = 'O'), '—') AS "O" FROM t GROUP BY ALL""".replace(
        "GROUP BY ALL, l_suppkey % 3", "GROUP BY l_returnflag, l_linenumber, l_linestatus, l_suppkey % 3"
    ),
)
def master_table(spark, sf):
    return rounded(R.master_table(_scores(spark, sf), ["F", "O"]))


@query(
    "frozen_vs_tuned",
    """WITH f AS (SELECT l_linenumber AS model, l_returnflag AS cell, l_linestatus AS source, avg(l_discount) AS lf, avg(l_tax) AS sf, avg(l_quantity) / 100 AS rf FROM lineitem GROUP BY ALL),
w AS (SELECT model, cell, max(lf) FILTER (source = 'F') * 100 AS a, max(sf) FILTER (source = 'F') * 100 AS b, max(rf) FILTER (source = 'F') * 100 AS c,
  max(lf) FILTER (source = 'O') * 100 AS d, max(sf) FILTER (source = 'O') * 100 AS e, max(rf) FILTER (source = 'O') * 100 AS g FROM f GROUP BY ALL)
SELECT model, cell, round(a, 6) AS frozen_label_frac, round(b, 6) AS frozen_subject_frac, round(c, 6) AS frozen_residual_frac, round(d, 6) AS ft_label_frac,
  round(e, 6) AS ft_subject_frac, round(g, 6) AS ft_residual_frac, round(d - a, 6) AS delta_label, round(e - b, 6) AS delta_subject FROM w WHERE a IS NOT NULL""",
)
def frozen_vs_tuned(spark, sf):
    source = F.when(F.col("l_linestatus") == "F", "frozen").otherwise("ft")
    f = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("model"), F.col("l_returnflag").alias("cell"), source.alias("source")).agg(
        F.avg("l_discount").alias("label_frac"), F.avg("l_tax").alias("subject_frac"), (F.avg("l_quantity") / 100).alias("residual_frac")
    )
    return rounded(R.frozen_vs_tuned(f))


@query(
    "null_reference",
    """WITH f AS (SELECT l_linenumber AS model, l_returnflag AS cell, avg(l_discount) * 100 AS lp, avg(l_tax) * 100 AS sp, avg(l_quantity) AS np FROM lineitem GROUP BY ALL)
SELECT model, cell, round(lp, 6) AS label_pct, round(sp, 6) AS subject_pct, CASE WHEN model > 2 THEN round(np, 6) END AS null_subject_pct,
  round(avg(np) FILTER (model > 2) OVER (PARTITION BY cell), 6) AS panel_null_pct FROM f""",
)
def null_reference(spark, sf):
    f = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("model"), F.col("l_returnflag").alias("cell")).agg(
        F.avg("l_discount").alias("label_frac"), F.avg("l_tax").alias("subject_frac"), (F.avg("l_quantity") / 100).alias("null_subject_frac_mean")
    )
    return rounded(R.with_null_reference(f, f.where(F.col("model") > 2)))


@query(
    "ablation_deltas",
    """WITH f AS (SELECT l_returnflag AS cell, l_linenumber AS model, l_suppkey % 3 AS c, avg(l_discount) AS st, avg(l_tax) AS su FROM lineitem GROUP BY ALL),
w AS (SELECT cell, model, max(st) FILTER (c = 0) AS s0, max(st) FILTER (c = 1) AS s1, max(st) FILTER (c = 2) AS s2, max(su) FILTER (c = 0) AS u0, max(su) FILTER (c = 1) AS u1, max(su) FILTER (c = 2) AS u2 FROM f GROUP BY ALL)
SELECT cell, model, round(s0, 6) AS state_orig, round(s1 - s0, 6) AS state_d_aper, round(s2 - s0, 6) AS state_d_per, round(u0, 6) AS subject_orig,
  round(u1 - u0, 6) AS subject_d_aper, round(u2 - u0, 6) AS subject_d_per FROM w""",
)
def ablation_deltas(spark, sf):
    kind = F.element_at(F.lit(["original", "aperiodic_removed", "periodic_removed"]), (F.col("l_suppkey") % 3 + 1).cast("int"))
    f = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("cell"), F.col("l_linenumber").alias("model"), kind.alias("condition")).agg(
        F.avg("l_discount").alias("state_ba"), F.avg("l_tax").alias("subject_ba")
    )
    return rounded(R.ablation_deltas(f))


@query(
    "erasure_table",
    """WITH f AS (SELECT l_suppkey AS cell, 'm' || (l_linenumber % 3) AS model, avg(l_quantity) / 50 AS raw, avg(l_tax) - 0.04 AS delta FROM lineitem GROUP BY ALL)
SELECT cell, printf('%d--%d', round(min(raw) * 100)::INT, round(max(raw) * 100)::INT) AS raw_range,
  coalesce(printf('%+.1f', max(delta * 100) FILTER (model = 'm0' AND cell % 2 = 0)), '—') AS m0, coalesce(printf('%+.1f', max(delta * 100) FILTER (model = 'm1' AND cell % 2 = 0)), '—') AS m1,
  coalesce(printf('%+.1f', max(delta * 100) FILTER (model = 'm2' AND cell % 2 = 0)), '—') AS m2 FROM f GROUP BY cell""",
)
def erasure_table(spark, sf):
    model = F.concat(F.lit("m"), F.col("l_linenumber") % 3)
    f = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), model.alias("model")).agg(
        (F.avg("l_quantity") / 50).alias("label_ba_raw"), (F.avg("l_tax") - 0.04).alias("label_ba_delta")
    )
    return R.erasure_table(f.withColumn("paired", F.col("cell") % 2 == 0), ["m0", "m1", "m2"])


# ---- listings and catalogs -----------------------------------------------------------------------------------------------


@query(
    "catalog_query",
    "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AND o_custkey IN (1, 7, 22, 80, 101, 140)",
)
def catalog_query(spark, sf):
    m = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("task"), F.col("o_custkey").alias("subject")
    )
    return L.catalog_query(m, "1-URGENT", "O", [1, 7, 22, 80, 101, 140]).select("o_orderkey")


def _paths(spark, sf):
    o = table(spark, sf, "orders")
    task = F.when(F.col("o_orderstatus") == "F", "RestingState").otherwise("Movie")
    run = F.when(F.col("o_orderkey") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("run-"), F.col("o_orderkey") % 3, F.lit("_")))
    folder = F.when(F.col("o_orderkey") % 5 == 0, "beh").otherwise("eeg")
    return o.select(
        F.concat(F.lit("ds/sub-"), "o_custkey", F.lit("/"), folder, F.lit("/sub-"), "o_custkey", F.lit("_task-"), task, F.lit("_"), run, F.lit("eeg.set")).alias("path"),
        "o_orderkey",
        F.col("o_totalprice").alias("size"),
    )


PATHS = """WITH p AS (SELECT 'ds/sub-' || o_custkey || '/' || CASE WHEN o_orderkey % 5 = 0 THEN 'beh' ELSE 'eeg' END || '/sub-' || o_custkey || '_task-' || CASE o_orderstatus WHEN 'F' THEN 'RestingState' ELSE 'Movie' END
  || '_' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'run-' || (o_orderkey % 3) || '_' END || 'eeg.set' AS path, o_orderkey, o_totalprice AS size, o_custkey FROM orders)"""


@query("task_recordings", PATHS + " SELECT DISTINCT o_custkey::VARCHAR AS subject, path FROM p WHERE path LIKE '%/eeg/%' AND path LIKE '%_task-RestingState_%'")
def task_recordings(spark, sf):
    return L.recordings_of_task(_paths(spark, sf), "RestingState")


@query("relevant_keys", PATHS + " SELECT o_orderkey FROM p WHERE path LIKE '%task-Movie@_%' ESCAPE '@'")
def relevant_keys(spark, sf):
    return _paths(spark, sf).where(L.is_relevant("path", "Movie")).select("o_orderkey")


@query(
    "sync_summary",
    """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'skip' ELSE 'fetch' END AS status, count(*) AS n_keys, sum(o_custkey)::BIGINT AS n_bytes FROM orders GROUP BY ALL""",
)
def sync_summary(spark, sf):
    remote = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("size"))
    local = remote.where(F.col("key") % 3 == 0).unionByName(remote.where(F.col("key") % 3 == 1).withColumn("size", F.col("size") + 1))
    return L.sync_summary(L.sync_plan(remote, local))


@query(
    "match_stimuli",
    """SELECT l_orderkey, l_linenumber, 'pics/' || p_partkey || '.jpg' AS file FROM lineitem JOIN part ON l_partkey = p_partkey AND p_size > 10""",
)
def match_stimuli(spark, sf):
    files = table(spark, sf, "part").where(F.col("p_size") > 10).select(F.concat(F.lit("pics/"), "p_partkey", F.lit(".jpg")).alias("path"))
    wanted = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("/old/place/"), "l_partkey", F.lit(".jpg")).alias("image"))
    return rounded(L.match_stimuli(files, wanted).select("l_orderkey", "l_linenumber", "file"))


@query(
    "trial_cohort",
    """WITH t AS (SELECT user_id % 20 AS subject_id, event_type AS cls, event_id AS trial, value AS v, value * value / 100 AS w FROM events),
c AS (SELECT subject_id, avg((v + w) / 2) AS mu, sqrt(avg((v * v + w * w) / 2) - avg((v + w) / 2) ** 2) + 1e-8 AS sigma FROM t GROUP BY subject_id)
SELECT trial, subject_id, dense_rank() OVER (ORDER BY cls) - 1 AS label, round(least(greatest((v - mu) / sigma, -15), 15), 4) AS a, round(least(greatest((w - mu) / sigma, -15), 15), 4) AS b FROM t JOIN c USING (subject_id)""",
)
def trial_cohort(spark, sf):
    t = table(spark, sf, "events").select(
        (F.col("user_id") % 20).alias("subject_id"),
        F.col("event_type").alias("cls"),
        F.col("event_id").alias("trial"),
        F.lit("c").alias("ch"),
        F.array(F.col("value"), F.col("value") * F.col("value") / 100).alias("x"),
    )
    out = C.trial_cohort(t).select("trial", "subject_id", "label", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    return rounded(out, 4)


# ---- text scan ------------------------------------------------------------------------------------------------------------

ENDS = r"\r\n|[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
HITS = rf"""WITH l AS (SELECT doc_id AS path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS txt FROM
  (SELECT doc_id, string_split(regexp_replace(text, '{ENDS}', chr(10), 'g'), chr(10)) AS ls FROM documents)),
h AS (SELECT 'citation_smith' AS kind, 'hard' AS severity, * FROM l WHERE regexp_matches(txt, '\bSmith et al')
  UNION ALL SELECT 'identifier_data', 'hard', * FROM l WHERE regexp_matches(txt, '\bdata\b')
  UNION ALL SELECT 'email_pattern', 'hard', * FROM l WHERE regexp_matches(txt, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')
  UNION ALL SELECT 'git_author_real', 'hard', * FROM l WHERE contains(replace(txt, 'Co-Authored-By:Anonymous', ''), 'Co-Authored-By:')
  UNION ALL SELECT 'our_lab', 'soft', * FROM l WHERE regexp_matches(txt, '\bour lab\b')
  UNION ALL SELECT 'our_group', 'soft', * FROM l WHERE regexp_matches(txt, '\bour group\b')
  UNION ALL SELECT 'we_acknowledge', 'soft', * FROM l WHERE regexp_matches(txt, '\bwe acknowledge\b')),
k AS (SELECT kind, severity, path, line, substr(regexp_replace(txt, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), 1, 200) AS snippet FROM h
  WHERE NOT (kind = 'email_pattern' AND path % 10 = 0))"""


def _hits(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    allow = docs.where(F.col("path") % 10 == 0).select(F.lit("email_pattern").alias("kind"), "path")
    return T.scan_lines(docs, T.scan_patterns_for(names=["data"], cited=["Smith"]), allow=allow)


@query("scan_lines", HITS + " SELECT kind, severity, path, line, snippet FROM k")
def scan_lines(spark, sf):
    return rounded(_hits(spark, sf))


@query(
    "scan_report",
    HITS
    + """ SELECT kind, severity, count(*) AS n_hits, count(DISTINCT path) AS n_docs, min(path) AS first_path, arg_min(line, path * 1000000 + line) AS first_line FROM k GROUP BY kind, severity""",
)
def scan_report(spark, sf):
    return rounded(T.scan_report(_hits(spark, sf)))


# ---- audit -------------------------------------------------------------------------------------------------------------------


@query("audit_cell")
def audit_cell(spark, sf):
    return A.audit_cell(crossed(spark, sf), A.AuditConfig("embeddings", "W,C"))


@query("audit_trait_cell")
def audit_trait_cell(spark, sf):
    f = nested(spark, sf).withColumn("recording_id", F.col("subject_id") * 2 + F.col("row_id") % 2)
    return A.audit_cell(f, A.AuditConfig("embeddings", "T,N"))


@query("audit_sweep")
def audit_sweep(spark, sf):
    return rounded(A.sweep(crossed(spark, sf).withColumn("dataset", F.col("row_id") % 3)))
