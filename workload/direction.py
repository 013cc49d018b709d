"""Direction consistency over subjects."""

from pyspark.sql import functions as F

from strataframe.operators import direction as D, metrics as M

from .registry import CROSSED, crossed, query, rounded, u32

DIRS = f"""WITH {CROSSED},
c AS (SELECT subject_id, label, dim, count(*) AS n, avg(v) AS m FROM fl GROUP BY subject_id, label, dim),
df AS (SELECT a.subject_id, a.dim, b.m - a.m AS d FROM c a JOIN c b ON a.subject_id = b.subject_id AND a.dim = b.dim
  AND a.label = 0 AND b.label = 1 WHERE a.n >= 2 AND b.n >= 2),
nm AS (SELECT subject_id, sqrt(sum(d * d)) AS mag FROM df GROUP BY subject_id HAVING sqrt(sum(d * d)) > 1e-12),
u AS (SELECT df.subject_id, dim, d / mag AS d FROM df JOIN nm ON df.subject_id = nm.subject_id)"""

PAIRS = """, pc AS (SELECT a.subject_id AS i, b.subject_id AS j, sum(a.d * b.d) AS cos FROM u a JOIN u b ON a.dim = b.dim
  AND a.subject_id < b.subject_id GROUP BY a.subject_id, b.subject_id)"""


@query("subject_directions", DIRS + " SELECT subject_id, dim, round(d, 6) AS d FROM u")
def subject_directions(spark, sf):
    d = D.unit_directions(crossed(spark, sf))
    return rounded(d.select("subject_id", F.posexplode("d").alias("dim", "d")))


@query(
    "direction_consistency",
    DIRS
    + PAIRS
    + """ SELECT round(median(cos), 6) AS c_bar, round(quantile_cont(cos, 0.25), 6) AS iqr_low,
  round(quantile_cont(cos, 0.75), 6) AS iqr_high, (SELECT count(*) FROM nm) AS n_subjects_paired FROM pc""",
)
def direction_consistency(spark, sf):
    return rounded(D.direction_consistency(D.unit_directions(crossed(spark, sf))))


BY_SET = f"""WITH {CROSSED},
c AS (SELECT row_id % 3 AS ds, subject_id, label, dim, count(*) AS n, avg(v) AS m FROM fl GROUP BY ALL),
df AS (SELECT a.ds, a.subject_id, a.dim, b.m - a.m AS d FROM c a JOIN c b ON a.ds = b.ds AND a.subject_id = b.subject_id AND a.dim = b.dim
  AND a.label = 0 AND b.label = 1 WHERE a.n >= 2 AND b.n >= 2),
nm AS (SELECT ds, subject_id, sqrt(sum(d * d)) AS mag FROM df GROUP BY ds, subject_id HAVING sqrt(sum(d * d)) > 1e-12),
u AS (SELECT df.ds, df.subject_id, dim, d / mag AS d FROM df JOIN nm ON df.ds = nm.ds AND df.subject_id = nm.subject_id),
pc AS (SELECT a.ds, a.subject_id AS i, b.subject_id AS j, sum(a.d * b.d) AS cos FROM u a JOIN u b ON a.ds = b.ds AND a.dim = b.dim
  AND a.subject_id < b.subject_id GROUP BY ALL)"""


@query(
    "direction_consistency_by_set",
    BY_SET
    + """ SELECT ds AS dataset, round(median(cos), 6) AS c_bar, round(quantile_cont(cos, 0.25), 6) AS iqr_low,
  round(quantile_cont(cos, 0.75), 6) AS iqr_high, (SELECT count(*) FROM nm WHERE nm.ds = pc.ds) AS n_subjects_paired FROM pc GROUP BY ds""",
)
def direction_consistency_by_set(spark, sf):
    rows = crossed(spark, sf).withColumn("dataset", F.col("row_id") % 3)
    return rounded(D.direction_consistency_by(D.unit_directions(rows, by=["dataset"]), "dataset"))


POOLED = f"""WITH {CROSSED},
r AS (SELECT recording_id, subject_id, label, dim, avg(v) AS v FROM fl GROUP BY ALL),
c AS (SELECT subject_id, label, dim, avg(v) AS m FROM r GROUP BY ALL),
df AS (SELECT a.subject_id, a.dim, b.m - a.m AS d FROM c a JOIN c b ON a.subject_id = b.subject_id AND a.dim = b.dim
  AND a.label = 0 AND b.label = 1),
nm AS (SELECT subject_id, sqrt(sum(d * d)) AS mag FROM df GROUP BY subject_id HAVING sqrt(sum(d * d)) > 0),
u AS (SELECT df.subject_id, dim, d / mag AS d FROM df JOIN nm ON df.subject_id = nm.subject_id)"""


@query(
    "mean_pairwise_cosine",
    POOLED
    + PAIRS
    + f""", pos AS (SELECT subject_id, row_number() OVER (ORDER BY md5(concat_ws(':', 'position', subject_id)), subject_id) AS pos FROM nm),
k AS (SELECT count(*) AS k FROM nm),
pk AS (SELECT boot, (({u32("concat_ws(':', 0, boot, i)")} * k) >> 32) + 1 AS pos
  FROM range(1, 2001) AS b(boot), range(0, (SELECT k FROM k)) AS t(i), k),
bs AS (SELECT boot, dim, sum(d) AS s FROM pk JOIN pos USING (pos) JOIN u USING (subject_id) GROUP BY boot, dim),
bd AS (SELECT boot, count(DISTINCT pos) AS distinct_n FROM pk GROUP BY boot),
bv AS (SELECT boot, (sum(s * s) - any_value(k)) / (any_value(k) * (any_value(k) - 1.0)) AS v FROM bs, k GROUP BY boot)
SELECT (SELECT round(avg(cos), 6) FROM pc) AS mean_cosine, (SELECT k FROM k) AS n_subjects,
  round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high, count(*) AS n_valid
FROM bv JOIN bd USING (boot) WHERE distinct_n >= 2""",
)
def mean_pairwise_cosine(spark, sf):
    return rounded(D.mean_cosine_interval(D.pooled_directions(crossed(spark, sf)), n_boot=2000, seed=0))


ANGLES = (
    POOLED
    + """, cm AS (SELECT dim, avg(d) AS m FROM u GROUP BY dim),
cn AS (SELECT sqrt(sum(m * m)) + 1e-12 AS nn FROM cm),
an AS (SELECT subject_id, degrees(acos(least(greatest(sum(d * m / nn), -1), 1))) AS angle
  FROM u JOIN cm ON u.dim = cm.dim, cn GROUP BY subject_id)"""
)


@query("subject_angles", ANGLES + " SELECT subject_id, round(angle, 6) AS angle FROM an")
def subject_angles(spark, sf):
    return rounded(D.subject_angles(D.pooled_directions(crossed(spark, sf))))


@query(
    "angle_histogram",
    ANGLES
    + """ SELECT bin, round(bin * 10.0, 6) AS left_edge, count(angle) AS n FROM range(0, 18) AS t(bin)
LEFT JOIN an ON least(floor(angle / 10), 17) = bin GROUP BY bin""",
)
def angle_histogram(spark, sf):
    return rounded(M.histogram(D.subject_angles(D.pooled_directions(crossed(spark, sf))), "angle", 0.0, 180.0, 18))


@query(
    "contrast_snr",
    POOLED
    + """ SELECT round(avg(mag), 6) AS mean_diff_mag, round(stddev_pop(mag), 6) AS std_diff_mag,
  round(avg(mag) / stddev_pop(mag), 6) AS snr, count(*) AS n_subj FROM nm""",
)
def contrast_snr(spark, sf):
    return rounded(D.contrast_snr(D.pooled_directions(crossed(spark, sf))))
