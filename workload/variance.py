"""Variance decomposition, permutation and bootstrap tests, nulls, label concentration."""

from __future__ import annotations

import math

from strataframe.functions.draws import PRIME, ROUNDS
from strataframe.operators import variance as V

from .registry import CROSSED, NESTED, crossed, nested, query, rounded, u32

FRACTIONS = """
  greatest(1 - ss_label / greatest(ss_total, 1e-18) - ss_subject / greatest(ss_total, 1e-18), 0)"""


def _crossed_sql(view: str, digits: int = 6) -> str:
    return f"""WITH {view},
g AS (SELECT dim, avg(v) AS m, var_pop(v) * count(*) AS ss FROM fl GROUP BY dim),
l AS (SELECT dim, label, count(*) AS n, avg(v) AS m FROM fl GROUP BY dim, label),
s AS (SELECT dim, subject_id, count(*) AS n, avg(v) AS m FROM fl GROUP BY dim, subject_id),
t AS (SELECT (SELECT sum(ss) FROM g) AS ss_total,
  (SELECT sum(l.n * (l.m - g.m) * (l.m - g.m)) FROM l JOIN g USING (dim)) AS ss_label,
  (SELECT sum(s.n * (s.m - g.m) * (s.m - g.m)) FROM s JOIN g USING (dim)) AS ss_subject)
SELECT (SELECT count(*) FROM f) AS n_rows, (SELECT count(DISTINCT subject_id) FROM f) AS n_subjects,
  (SELECT count(DISTINCT label) FROM f) AS n_labels,
  round(ss_total, 6) AS ss_total, round(ss_label, 6) AS ss_label, round(ss_subject, 6) AS ss_subject,
  round(ss_label / greatest(ss_total, 1e-18), {digits}) AS label_frac,
  round(ss_subject / greatest(ss_total, 1e-18), {digits}) AS subject_frac,
  round({FRACTIONS}, {digits}) AS residual_frac,
  (ss_label + ss_subject) / greatest(ss_total, 1e-18) > 1 + 1e-9 AS raw_sum_exceeds_one FROM t"""


@query("crossed_ss_fractions", _crossed_sql(CROSSED))
def crossed_ss_fractions(spark, sf):
    return rounded(V.crossed_ss(crossed(spark, sf)))


@query("crossed_ss_overlap", _crossed_sql(NESTED))
def crossed_ss_overlap(spark, sf):
    return rounded(V.crossed_ss(nested(spark, sf)))


NESTED_DIMS = f"""WITH {NESTED},
g AS (SELECT dim, avg(v) AS m, var_pop(v) * count(*) AS ss FROM fl GROUP BY dim),
l AS (SELECT dim, label, count(*) AS n, avg(v) AS m FROM fl GROUP BY dim, label),
s AS (SELECT dim, label, subject_id, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss
  FROM fl GROUP BY dim, label, subject_id),
k AS (SELECT count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects, count(DISTINCT label) AS n_labels FROM f),
d AS (SELECT g.dim, g.ss AS ss_total,
  (SELECT sum(l.n * (l.m - g.m) * (l.m - g.m)) FROM l WHERE l.dim = g.dim) AS ss_label,
  (SELECT sum(s.n * (s.m - l.m) * (s.m - l.m)) FROM s JOIN l ON s.dim = l.dim AND s.label = l.label WHERE s.dim = g.dim)
    AS ss_subject,
  (SELECT sum(s.ss) FROM s WHERE s.dim = g.dim) AS ss_residual FROM g)"""


@query(
    "nested_ss",
    NESTED_DIMS
    + """ SELECT dim, round(ss_label, 6) AS ss_label, round(ss_subject, 6) AS ss_subject,
  round(ss_residual, 6) AS ss_residual, round(ss_total, 6) AS ss_total, n_labels - 1 AS df_label,
  n_subjects - n_labels AS df_subject, n_rows - n_subjects AS df_residual, n_rows, n_subjects FROM d, k""",
)
def nested_ss(spark, sf):
    return rounded(V.per_dimension(V.nested_ss(nested(spark, sf))))


@query(
    "omega_squared",
    NESTED_DIMS
    + """, e AS (SELECT greatest((ss_label - (n_labels - 1) * ss_residual / (n_rows - n_subjects))
    / greatest(ss_total + ss_residual / (n_rows - n_subjects), 1e-12), 0) AS wl,
  greatest((ss_subject - (n_subjects - n_labels) * ss_residual / (n_rows - n_subjects))
    / greatest(ss_total + ss_residual / (n_rows - n_subjects), 1e-12), 0) AS ws,
  ss_label / greatest(ss_total, 1e-12) AS fl, ss_subject / greatest(ss_total, 1e-12) AS fs,
  ss_residual / greatest(ss_total, 1e-12) AS fr FROM d, k)
SELECT round(avg(wl), 6) AS omega2_label, round(avg(ws), 6) AS omega2_subject, round(avg(fl), 6) AS frac_label,
  round(avg(fs), 6) AS frac_subject, round(avg(fr), 6) AS frac_residual,
  round(avg(ws) / greatest(avg(wl), 1e-9), 6) AS subject_to_label FROM e""",
)
def omega_squared(spark, sf):
    return rounded(V.omega_squared(V.nested_ss(nested(spark, sf))))


@query(
    "variance_components",
    NESTED_DIMS
    + """, z AS (SELECT sum(c * c * 1.0 / nl) AS w FROM (SELECT label, subject_id, count(*) AS c,
    sum(count(*)) OVER (PARTITION BY label) AS nl FROM f GROUP BY label, subject_id)),
y AS (SELECT avg(label) AS m, var_pop(label) AS vy FROM f),
b AS (SELECT dim, regr_slope(v, label) AS slope FROM fl GROUP BY dim),
c AS (SELECT greatest((ss_subject / (n_subjects - n_labels) - ss_residual / (n_rows - n_subjects))
    / ((n_rows - z.w) / (n_subjects - n_labels)), 0) AS vs, slope * slope * vy AS vl,
    ss_residual / (n_rows - n_subjects) AS vr FROM d JOIN b USING (dim), k, z, y)
SELECT round(avg(vs / (vs + vr)), 6) AS icc_subject_mean, round(median(vs / (vs + vr)), 6) AS icc_subject_median,
  round(avg(vs), 6) AS var_subject_mean, round(avg(vl), 6) AS var_label_mean, round(avg(vr), 6) AS var_residual_mean,
  round(avg(vs / (vs + vl + vr)), 6) AS frac_subject_mean, round(avg(vl / (vs + vl + vr)), 6) AS frac_label_mean,
  round(avg(vr / (vs + vl + vr)), 6) AS frac_residual_mean,
  round(avg(vs) / greatest(avg(vl), 1e-12), 6) AS subject_to_label, count(*) AS n_dims FROM c""",
)
def variance_components(spark, sf):
    return rounded(V.variance_components(nested(spark, sf)))


N_PERM = 999
PERM_SQL = f"""WITH RECURSIVE {NESTED},
sd AS (SELECT dim, avg(v) AS m, greatest(stddev_pop(v), 1e-12) AS s FROM fl GROUP BY dim),
subj AS (SELECT subject_id, min(label) AS label, row_number() OVER (ORDER BY min(label), subject_id) - 1 AS place,
  row_number() OVER (ORDER BY subject_id) - 1 AS i, count(*) OVER () AS size FROM f GROUP BY subject_id),
ky AS (SELECT perm, r, {u32("concat_ws(':', 0, perm, r)")} AS k, {u32("concat_ws(':', 0, perm, r)", 1)} % {PRIME - 1} + 1 AS a,
  {u32("concat_ws(':', 0, perm, r)", 2)} % {PRIME} AS b FROM range(1, {N_PERM + 1}) AS t(perm), range(0, {ROUNDS}) AS q(r)),
j AS (SELECT perm, subject_id, i AS at_, 0 AS r, size FROM subj, range(1, {N_PERM + 1}) AS t(perm)
  UNION ALL SELECT perm, subject_id, CASE WHEN ((h * h + a) % {PRIME} >> 8) & 1 = 1 THEN other ELSE at_ END, r + 1, size
  FROM (SELECT *, (a * greatest(at_, other) + b) % {PRIME} AS h FROM (SELECT j.*, a, b, (k % size + size - at_) % size AS other
    FROM j JOIN ky USING (perm, r)))),
lab AS (SELECT 0 AS perm, subject_id, label FROM subj
  UNION ALL SELECT j.perm, j.subject_id, d.label FROM j JOIN subj d ON d.place = j.at_ WHERE j.r = {ROUNDS}),
sm AS (SELECT fl.subject_id, fl.dim, sum((v - m) / s) AS t, count(*) AS n FROM fl JOIN sd USING (dim)
  GROUP BY fl.subject_id, fl.dim),
g AS (SELECT perm, label, dim, sum(t) AS t, sum(n) AS n FROM lab JOIN sm USING (subject_id) GROUP BY perm, label, dim),
a AS (SELECT perm, sum(t * t / n) AS among, count(DISTINCT label) AS a FROM g GROUP BY perm),
w AS (SELECT sum(((v - m) / s) * ((v - m) / s)) AS total FROM fl JOIN sd USING (dim)),
fs AS (SELECT perm, (among / greatest(a - 1, 1)) / ((total - among) / greatest((SELECT count(*) FROM f) - a, 1)) AS fv,
  among / greatest(total, 1e-12) AS r2 FROM a, w)
SELECT round(o.fv, 6) AS pseudo_f, round(o.r2, 6) AS r2,
  round(((SELECT count(*) FROM fs WHERE perm > 0 AND fv >= o.fv * (1 - 1e-12)) + 1) / ({N_PERM} + 1), 6) AS p_value,
  {N_PERM} AS n_perm FROM fs o WHERE perm = 0"""


@query("permanova", PERM_SQL)
def permanova(spark, sf):
    return rounded(V.permanova(nested(spark, sf), n_perm=N_PERM, seed=0))


N_BOOT = 1000
BOOT_SQL = f"""WITH {NESTED},
g AS (SELECT dim, avg(v) AS m FROM fl GROUP BY dim),
s AS (SELECT subject_id, label, fl.dim, count(*) AS n, sum(v - m) AS t, var_pop(v) * count(*) AS ss
  FROM fl JOIN g ON fl.dim = g.dim GROUP BY subject_id, label, fl.dim),
pos AS (SELECT subject_id, row_number() OVER (ORDER BY md5(concat_ws(':', 'position', subject_id)), subject_id) AS pos
  FROM (SELECT DISTINCT subject_id FROM f)),
k AS (SELECT count(*) AS k FROM pos),
picks AS (SELECT boot, (({u32("concat_ws(':', 0, boot, i)")} * k) >> 32) + 1 AS pos
  FROM range(1, {N_BOOT + 1}) AS b(boot), range(0, (SELECT k FROM k)) AS t(i), k),
dr AS (SELECT boot, subject_id, count(*) AS mult FROM picks JOIN pos USING (pos) GROUP BY boot, subject_id
  UNION ALL SELECT 0, subject_id, 1 FROM pos),
bl AS (SELECT boot, label, dim, sum(mult * n) AS n, sum(mult * t) AS t, sum(mult * t * t / n) AS q, sum(mult * ss) AS ss,
  sum(mult) AS subjects FROM dr JOIN s USING (subject_id) GROUP BY boot, label, dim),
bd AS (SELECT boot, dim, sum(ss) + sum(q) - sum(t) * sum(t) / sum(n) AS total,
  sum(t * t / n) - sum(t) * sum(t) / sum(n) AS lab, sum(q) - sum(t) * sum(t) / sum(n) AS sub,
  sum(q) - sum(t * t / n) AS nest, sum(ss) / (sum(n) - sum(subjects)) AS ms, count(*) AS labels, sum(subjects) AS subjects
  FROM bl GROUP BY boot, dim),
st AS (SELECT boot, sum(sub) / greatest(sum(total), 1e-18) AS subject_frac,
  avg(greatest((nest - (subjects - labels) * ms) / greatest(total + ms, 1e-12), 0)) AS ws,
  avg(greatest((lab - (labels - 1) * ms) / greatest(total + ms, 1e-12), 0)) AS wl FROM bd GROUP BY boot)"""


@query(
    "cluster_bootstrap",
    BOOT_SQL
    + """ SELECT round(max(subject_frac) FILTER (boot = 0), 6) AS point, round(avg(subject_frac) FILTER (boot > 0), 6) AS mean,
  round(quantile_cont(subject_frac, 0.025) FILTER (boot > 0), 6) AS ci_low,
  round(quantile_cont(subject_frac, 0.975) FILTER (boot > 0), 6) AS ci_high,
  count(*) FILTER (boot > 0) AS n_valid FROM st""",
)
def cluster_bootstrap(spark, sf):
    return rounded(V.cluster_bootstrap(nested(spark, sf), "subject_frac", n_boot=N_BOOT, seed=0))


@query(
    "cluster_bootstrap_log_ratio",
    BOOT_SQL
    + """, r AS (SELECT boot, ws / greatest(wl, 1e-9) AS v FROM st)
SELECT round(max(v) FILTER (boot = 0), 6) AS point, round(exp(avg(ln(v)) FILTER (boot > 0)), 6) AS mean,
  round(exp(quantile_cont(ln(v), 0.025) FILTER (boot > 0)), 6) AS ci_low,
  round(exp(quantile_cont(ln(v), 0.975) FILTER (boot > 0)), 6) AS ci_high,
  count(*) FILTER (boot > 0) AS n_valid FROM r""",
)
def cluster_bootstrap_log_ratio(spark, sf):
    return rounded(V.cluster_bootstrap(nested(spark, sf), "subject_to_label", n_boot=N_BOOT, seed=0, log=True))


def _normal(text: str) -> str:
    return (
        f"sqrt(-2 * ln(({u32(text)} + 0.5) / 4294967296.0)) * cos({2 * math.pi!r} * ({u32(text, 1)} + 0.5) / 4294967296.0)"
    )


@query(
    "null_control",
    f"""WITH {CROSSED},
c AS (SELECT subject_id, label, count(*) AS n FROM f GROUP BY subject_id, label),
z AS (SELECT draw, subject_id, label, n, dim,
  {_normal("concat_ws(':', 7, draw, subject_id, label, dim)")} / sqrt(n) AS m
  FROM c, range(1, 21) AS t(draw), range(0, 64) AS u(dim)),
g AS (SELECT draw, dim, sum(n * m) / sum(n) AS m FROM z GROUP BY draw, dim),
tot AS (SELECT z.draw, sum(z.n * (z.m - g.m) * (z.m - g.m)) AS ss FROM z JOIN g ON z.draw = g.draw AND z.dim = g.dim
  GROUP BY z.draw),
l AS (SELECT draw, label, dim, sum(n) AS n, sum(n * m) / sum(n) AS m FROM z GROUP BY draw, label, dim),
s AS (SELECT draw, subject_id, dim, sum(n) AS n, sum(n * m) / sum(n) AS m FROM z GROUP BY draw, subject_id, dim),
ls AS (SELECT l.draw, sum(l.n * (l.m - g.m) * (l.m - g.m)) AS ss FROM l JOIN g ON l.draw = g.draw AND l.dim = g.dim GROUP BY l.draw),
sst AS (SELECT s.draw, sum(s.n * (s.m - g.m) * (s.m - g.m)) AS ss FROM s JOIN g ON s.draw = g.draw AND s.dim = g.dim GROUP BY s.draw),
df AS (SELECT ((SELECT count(*) FROM f) - (SELECT count(*) FROM c)) * 64.0 AS df),
w AS (SELECT draw, df * pow(1 - 2 / (9 * df) + {_normal("concat_ws(':', 7, draw, 'residual')")} * sqrt(2 / (9 * df)), 3) AS ss
  FROM df, range(1, 21) AS t(draw)),
nf AS (SELECT draw, ls.ss / (tot.ss + w.ss) AS lf, sst.ss / (tot.ss + w.ss) AS sf FROM tot JOIN ls USING (draw)
  JOIN sst USING (draw) JOIN w USING (draw)),
nn AS (SELECT avg(lf) AS lm, stddev_samp(lf) AS ld, avg(sf) AS sm, stddev_samp(sf) AS sd FROM nf),
real AS ({_crossed_sql(CROSSED, 15)})
SELECT n_rows, n_subjects, n_labels, round(label_frac, 6) AS label_frac, round(subject_frac, 6) AS subject_frac,
  round(residual_frac, 6) AS residual_frac, round(lm, 6) AS null_label_mean, round(ld, 6) AS null_label_std,
  round(sm, 6) AS null_subject_mean, round(sd, 6) AS null_subject_std, round(label_frac / lm, 6) AS excess_label,
  round(subject_frac / sm, 6) AS excess_subject, round((n_labels - 1) / (n_rows - 1), 6) AS df_label_pred,
  round((n_subjects - 1) / (n_rows - 1), 6) AS df_subject_pred, 20 AS n_null_seeds FROM real, nn""",
)
def null_control(spark, sf):
    return rounded(V.null_control(crossed(spark, sf), n_seeds=20, seed=7))


AXES = f"""WITH {CROSSED},
g AS (SELECT dim, avg(v) AS m, var_pop(v) * count(*) AS total_ss FROM fl GROUP BY dim),
l AS (SELECT dim, label, count(*) AS n, avg(v) AS m FROM fl GROUP BY dim, label),
ax AS (SELECT g.dim, sum(l.n * (l.m - g.m) * (l.m - g.m)) AS label_ss, any_value(total_ss) AS total_ss
  FROM g JOIN l ON g.dim = l.dim GROUP BY g.dim),
cum AS (SELECT *, row_number() OVER o AS rank, sum(label_ss) OVER (o ROWS UNBOUNDED PRECEDING)
  / sum(label_ss) OVER () AS cum FROM ax WINDOW o AS (ORDER BY label_ss DESC, dim))"""


@query(
    "label_ss_per_axis",
    AXES + " SELECT dim, round(label_ss, 6) AS label_ss, round(total_ss, 6) AS total_ss FROM ax",
)
def label_ss_per_axis(spark, sf):
    return rounded(V.label_ss_per_axis(crossed(spark, sf)).drop("n"))


@query(
    "label_concentration",
    AXES
    + """ SELECT min(rank) FILTER (cum >= 0.5) AS dims_for_50pct, min(rank) FILTER (cum >= 0.8) AS dims_for_80pct,
  coalesce(min(rank) FILTER (cum >= 0.95), max(rank)) AS dims_for_95pct,
  round(sum(label_ss) * sum(label_ss) / greatest(sum(label_ss * label_ss), 1e-18), 6) AS pr_label,
  round(sum(total_ss) * sum(total_ss) / greatest(sum(total_ss * total_ss), 1e-18), 6) AS pr_total FROM cum""",
)
def label_concentration(spark, sf):
    return rounded(V.concentration(V.label_ss_per_axis(crossed(spark, sf))))


@query(
    "label_top_axes",
    AXES
    + """, e AS (SELECT label_ss / greatest(total_ss, 1e-18) AS eta2,
  row_number() OVER (ORDER BY label_ss / greatest(total_ss, 1e-18) DESC) AS rank FROM ax)
SELECT rank, round(cum, 6) AS cum_fraction, round(eta2, 6) AS eta2 FROM cum JOIN e USING (rank) WHERE rank <= 20""",
)
def label_top_axes(spark, sf):
    return rounded(V.top_axes(V.label_ss_per_axis(crossed(spark, sf)), 20))


@query("label_subspace_pca")
def label_subspace_pca(spark, sf):
    return rounded(V.label_subspace(crossed(spark, sf)))
