"""Moments, erasure, ridge, retrieval, dictionaries, spectra and probes on the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strataframe.functions import arrays as A
from strataframe.operators import concepts as CP, dictionary as Y, erasure as E, probes as B, retrieval as R, ridge as G, sampling, spectra as Z
from strataframe.operators import pooling, selecting
from strataframe.plans import moments, overlapping
from strataframe.session import checkpoint

from .registry import CROSSED, NESTED, crossed, nested, query, rounded, table


@query(
    "covariance_matrix",
    f"""WITH {CROSSED} SELECT a.dim AS i, b.dim AS j, round(covar_pop(a.v, b.v), 6) AS c FROM fl a JOIN fl b USING (row_id)
GROUP BY a.dim, b.dim""",
)
def covariance_matrix(spark, sf):
    f = crossed(spark, sf)
    n, mu = moments.mean_vector(f)
    g, _, _ = moments.gram(f, center_left=mu)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(g / n)]
    out = spark.createDataFrame(rows, "i int, r array<double>").select("i", F.posexplode("r").alias("j", "c"))
    return rounded(out)


@query(
    "covariance_shrinkage",
    f"""WITH {CROSSED},
m AS (SELECT dim, avg(v) AS m FROM fl GROUP BY dim),
c AS (SELECT row_id, fl.dim, v - m AS v FROM fl JOIN m ON fl.dim = m.dim),
n AS (SELECT count(DISTINCT row_id) AS n, 64.0 AS d FROM fl),
s AS (SELECT a.dim AS i, b.dim AS j, sum(a.v * b.v) / any_value(n.n) AS c FROM c a JOIN c b USING (row_id), n GROUP BY a.dim, b.dim),
t AS (SELECT sum(c) FILTER (i = j) / 64 AS mu, sum(c * c) AS spread FROM s),
q AS (SELECT sum(r * r) AS q4 FROM (SELECT row_id, sum(v * v) AS r FROM c GROUP BY row_id)),
w AS (SELECT n, mu, (spread - 64 * mu * mu) / 64 AS delta, (q4 / n - spread) / (64 * n) AS beta FROM t, q, n)
SELECT n AS n_rows, round(mu, 6) AS mean_variance, round(least(beta, delta) / delta, 6) AS shrinkage FROM w""",
)
def covariance_shrinkage(spark, sf):
    f = crossed(spark, sf)
    n, mu = moments.mean_vector(f)
    g, _, quartic = moments.gram(f, center_left=mu)
    weight = E.ledoit_wolf_weight(g / n, n, quartic)
    return rounded(
        spark.createDataFrame([(n, float((g / n).trace() / len(g)), weight)], "n_rows long, mean_variance double, shrinkage double")
    )


@query("erased_features")
def erased_features(spark, sf):
    f = crossed(spark, sf)
    eraser = E.fit_eraser(f, E.fit_whitening(f))
    return E.apply_eraser(f, eraser)


@query("subject_subspace_overlap")
def subject_subspace_overlap(spark, sf):
    f = crossed(spark, sf)
    halves = [f.where(F.col("row_id") % 2 == i) for i in (0, 1)]
    erasers = [E.fit_eraser(h, E.fit_whitening(h)) for h in halves]
    overlap = E.subspace_overlap(E.basis_table(spark, erasers[0]), E.basis_table(spark, erasers[1]))
    return rounded(
        spark.createDataFrame([(erasers[0].rank, erasers[1].rank, overlap)], "rank_a int, rank_b int, overlap double")
    )


# ---- retrieval ---------------------------------------------------------------------------------------------------------


def _gallery(spark, sf):
    return table(spark, sf, "embeddings").where(F.col("vec_id") % 2 == 0).select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))


def _query(spark, sf):
    q = table(spark, sf, "embeddings").where(F.col("vec_id") % 2 == 1)
    return q.select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"), (F.col("vec_id") - 1).alias("correct_id"))


SIMS = """WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
nn AS (SELECT vec_id, sqrt(sum(v * v)) + 1e-12 AS nn FROM e GROUP BY vec_id),
u AS (SELECT e.vec_id, dim, v / nn AS v FROM e JOIN nn ON e.vec_id = nn.vec_id),
sim AS (SELECT q.vec_id AS qid, g.vec_id AS id, sum(q.v * g.v) AS s FROM u q JOIN u g ON q.dim = g.dim
  WHERE q.vec_id % 2 = 1 AND g.vec_id % 2 = 0 GROUP BY q.vec_id, g.vec_id)"""

RANKS = SIMS + """, c AS (SELECT qid, s AS target FROM sim WHERE id = qid - 1),
rk AS (SELECT qid, 1 + count(*) FILTER (s > target AND id <> qid - 1) AS rank FROM sim JOIN c USING (qid) GROUP BY qid)"""

TOP = """, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM sim)
SELECT qid, rank, id, round(s, 6) AS score FROM r WHERE rank <= 5"""


@query("retrieve_top_k", SIMS + TOP)
def retrieve_top_k(spark, sf):
    return rounded(R.top_k(_query(spark, sf), _gallery(spark, sf), 5))


@query("retrieve_top_k_tiled", SIMS + TOP)
def retrieve_top_k_tiled(spark, sf):
    # the path for galleries beyond the broadcast bound
    return rounded(R.top_k(_query(spark, sf), _gallery(spark, sf), 5, limit=0, tile=400))


@query("correct_item_rank", RANKS + " SELECT qid, rank FROM rk")
def correct_item_rank(spark, sf):
    return R.correct_ranks(_query(spark, sf), _gallery(spark, sf))


METRICS = """ SELECT round(avg((rank <= 1)::INT), 6) AS top1, round(avg((rank <= 5)::INT), 6) AS top5,
  round(median(rank), 6) AS median_rank, count(*) AS n_query,
  round(1.0 / (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0), 6) AS chance_top1 FROM rk"""


@query("retrieval_metrics", RANKS + METRICS)
def retrieval_metrics(spark, sf):
    return rounded(R.evaluate_retrieval(_query(spark, sf), _gallery(spark, sf)))


@query("retrieval_metrics_tiled", RANKS + METRICS)
def retrieval_metrics_tiled(spark, sf):
    return rounded(R.evaluate_retrieval(_query(spark, sf), _gallery(spark, sf), limit=0, tile=400))


@query("ridge_retrieval")
def ridge_retrieval(spark, sf):
    # features are decoded to the embedding of the row before them, then retrieved among held-out targets
    pairs = _query(spark, sf).join(_gallery(spark, sf).select(F.col("id").alias("correct_id"), F.col("emb").alias("y")), "correct_id")
    split = sampling.subject_split(pairs.select(F.col("id").alias("subject_id")), 0.2, 0).withColumnRenamed("subject_id", "id")
    rows = checkpoint(pairs.join(split, "id").withColumnRenamed("emb", "x"))  # read by the fit and by the test
    model = G.fit_ridge_map(rows.where(F.col("split") == "train"), 1000.0)
    test = checkpoint(G.apply_ridge_map(rows.where(F.col("split") == "test"), model))
    gallery = test.select(F.col("correct_id").alias("id"), F.col("y").alias("emb"))
    queries = test.select("id", "correct_id", F.col("prediction").alias("emb"))
    return rounded(R.evaluate_retrieval(queries, gallery, (1, 5, 10)))


@query("ridge_probe_path")
def ridge_probe_path(spark, sf):
    f = pooling.mean_pool(nested(spark, sf), ["subject_id"]).withColumn("y", (F.col("subject_id") / 5).cast("double"))
    rows = f.join(sampling.subject_split(f, 0.25, 0), "subject_id").withColumnRenamed("subject_id", "row_id")
    return rounded(G.ridge_probe(rows))


# ---- dictionary -----------------------------------------------------------------------------------------------------------


def _atoms(spark, sf):
    return table(spark, sf, "embeddings").where(F.col("vec_id") < 32).select(
        F.col("vec_id").alias("feature"),
        F.col("embedding").cast("array<double>").alias("enc"),
        (F.col("vec_id") % 5 * 0.01).alias("enc_bias"),
        F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 0.5).alias("dec"),
    )


def _dictionary(spark, sf):
    return Y.load_dictionary(_atoms(spark, sf), [0.01] * 64)


CODE = """WITH e AS (SELECT vec_id AS row_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
pre AS (SELECT x.row_id, a.row_id AS feature, sum((x.v - 0.01) * a.v) + any_value(a.row_id % 5 * 0.01) AS pre
  FROM e x JOIN e a ON x.dim = a.dim AND a.row_id < 32 GROUP BY x.row_id, a.row_id),
zr AS (SELECT row_id, feature, greatest(pre, 0) AS z, row_number() OVER (PARTITION BY row_id ORDER BY greatest(pre, 0) DESC, feature) AS r FROM pre),
z AS (SELECT row_id, feature, z FROM zr WHERE r <= 8 AND z > 0)"""

HEALTH = CODE + """, rc AS (SELECT e.row_id, e.dim, e.v, 0.01 + coalesce(sum(z.z * a.v * 0.5), 0) AS h
  FROM e LEFT JOIN z ON z.row_id = e.row_id LEFT JOIN e a ON a.row_id = z.feature AND a.dim = e.dim GROUP BY e.row_id, e.dim, e.v),
n AS (SELECT count(*) AS n FROM embeddings),
fc AS (SELECT feature, count(z.row_id) AS c FROM range(0, 32) AS t(feature) LEFT JOIN z USING (feature) GROUP BY feature)"""


@query("dictionary_encode", CODE + " SELECT row_id, feature, round(z, 6) AS value FROM z")
def dictionary_encode(spark, sf):
    return rounded(Y.encode(crossed(spark, sf), _dictionary(spark, sf), 8))


@query(
    "topk_sparsify",
    """WITH e AS (SELECT vec_id AS row_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY v DESC, dim) AS r FROM e)
SELECT row_id, dim, round(v, 6) AS v FROM r WHERE r <= 4 AND v <> 0""",
)
def topk_sparsify(spark, sf):
    out = Y.topk_arrays(crossed(spark, sf).select("row_id", "x"), 4)
    return rounded(out.select("row_id", F.posexplode("x").alias("dim", "v")).where(F.col("v") != 0))


@query(
    "dictionary_health",
    HEALTH
    + """ SELECT round((SELECT avg((c <= 0)::INT) FROM fc), 6) AS dead_fraction, round((SELECT avg(c) FROM fc) / any_value(n), 6) AS mean_density,
  round((SELECT max(c) FROM fc) / any_value(n), 6) AS max_density, round((SELECT count(*) FROM z) / any_value(n), 6) AS l0_actual,
  round(avg((v - h) * (v - h)), 6) AS recon_mse, round(1 - var_pop(v - h) / (var_pop(v) + 1e-12), 6) AS explained_var FROM rc, n""",
)
def dictionary_health(spark, sf):
    return rounded(Y.dictionary_health(crossed(spark, sf), _dictionary(spark, sf), 8))


@query(
    "auxiliary_loss",
    HEALTH
    + """, da AS (SELECT row_id, feature, pre, row_number() OVER (PARTITION BY row_id ORDER BY pre DESC, feature) AS r FROM pre WHERE feature >= 20),
ax AS (SELECT rc.row_id, rc.dim, rc.v - rc.h AS err, coalesce(sum(greatest(da.pre, 0) * a.v * 0.5), 0) AS back
  FROM rc LEFT JOIN da ON da.row_id = rc.row_id AND da.r <= 4 LEFT JOIN e a ON a.row_id = da.feature AND a.dim = rc.dim
  GROUP BY rc.row_id, rc.dim, rc.v, rc.h)
SELECT round(avg(err * err), 6) AS main_mse, round(avg((err - back) ** 2), 6) AS aux_mse,
  round(avg(err * err) + avg((err - back) ** 2) / 32.0, 6) AS total_loss FROM ax""",
)
def auxiliary_loss(spark, sf):
    return rounded(Y.auxiliary_loss(crossed(spark, sf), _dictionary(spark, sf), 8, 4, [i >= 20 for i in range(32)]))


@query("firing_counts", HEALTH + " SELECT feature, c AS fire_count, round(c / n, 6) AS density FROM fc, n")
def firing_counts(spark, sf):
    f = crossed(spark, sf)
    return rounded(Y.firing_counts(Y.encode(f, _dictionary(spark, sf), 8), _atoms(spark, sf), f.count()))


@query(
    "feature_liveness",
    CODE
    + """ SELECT feature, coalesce(max(z.row_id // 50), 0) AS last_fired_step, 10 - coalesce(max(z.row_id // 50), 0) > 1 AS dead
FROM range(0, 32) AS t(feature) LEFT JOIN z USING (feature) GROUP BY feature""",
)
def feature_liveness(spark, sf):
    fired = Y.encode(crossed(spark, sf), _dictionary(spark, sf), 8).withColumn("step", F.floor(F.col("row_id") / 50))
    return rounded(Y.feature_liveness(fired, _atoms(spark, sf), 10, 1))


@query(
    "subject_latents",
    CODE
    + """ SELECT row_id % 25 AS subject_id, feature, round(sum(z) / any_value(n), 6) AS value FROM z
JOIN (SELECT vec_id % 25 AS s, count(*) AS n FROM embeddings GROUP BY ALL) ON s = row_id % 25 GROUP BY ALL""",
)
def subject_latents(spark, sf):
    f = crossed(spark, sf)
    return rounded(pooling.pool_sparse(Y.encode(f, _dictionary(spark, sf), 8), f))


@query(
    "live_features",
    CODE
    + """, n AS (SELECT count(*) AS n FROM embeddings),
v AS (SELECT feature, sum(z * z) / any_value(n) - (sum(z) / any_value(n)) ** 2 AS variance FROM z, n GROUP BY feature)
SELECT feature, round(variance, 6) AS variance FROM v WHERE variance > 1e-10""",
)
def live_features(spark, sf):
    f = crossed(spark, sf)
    return rounded(selecting.live_features(Y.encode(f, _dictionary(spark, sf), 8), n_rows=f.count()))


# ---- concept probes ---------------------------------------------------------------------------------------------------------


def _concepts(spark, sf):
    s = nested(spark, sf).select("subject_id").distinct()
    s = s.select(
        "subject_id",
        (F.col("subject_id") % 7).cast("double").alias("score"),
        (F.col("subject_id") * F.col("subject_id") % 11).cast("double").alias("age"),
        F.when(F.col("subject_id") % 3 == 0, "M").when(F.col("subject_id") % 3 == 1, "F").otherwise("NA").alias("sex"),
    )
    return selecting.concept_table(s, ["score", "age"])


def _scores(spark, sf):
    pooled = pooling.mean_pool(nested(spark, sf), ["subject_id"])
    latents = pooled.select("subject_id", F.posexplode("x").alias("feature", "value")).withColumn("feature", F.col("feature").cast("bigint"))
    return CP.concept_probes(latents, _concepts(spark, sf))


CONCEPTS = f"""WITH {NESTED},
lt AS (SELECT subject_id, dim AS feature, avg(v) AS x FROM fl GROUP BY ALL),
sb AS (SELECT DISTINCT subject_id FROM f),
cc AS (SELECT subject_id, 'score' AS concept, 'continuous' AS kind, (subject_id % 7)::DOUBLE AS y FROM sb
  UNION ALL SELECT subject_id, 'age', 'continuous', (subject_id * subject_id % 11)::DOUBLE FROM sb
  UNION ALL SELECT subject_id, 'sex', 'binary', CASE subject_id % 3 WHEN 0 THEN 1.0 ELSE 0.0 END FROM sb WHERE subject_id % 3 < 2),
sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY concept ORDER BY md5(concat_ws(':', 0, subject_id)), subject_id)
  <= greatest(1, round_even(count(*) OVER (PARTITION BY concept) * 0.25, 0)) THEN 'test' ELSE 'train' END AS split FROM cc),
j AS (SELECT * FROM lt JOIN sp USING (subject_id)),
ln AS (SELECT feature, concept, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM j WHERE kind = 'continuous' AND split = 'train' GROUP BY ALL),
cs AS (SELECT feature, concept, split, 1 - sum((y - a * x - b) ** 2) / (var_pop(y) * count(*) + 1e-12) AS s FROM j JOIN ln USING (feature, concept) GROUP BY ALL),
rk AS (SELECT feature, concept, split, y, rank() OVER w + (count(*) OVER (PARTITION BY feature, concept, split, x) - 1) / 2.0 AS r
  FROM j WHERE kind = 'binary' WINDOW w AS (PARTITION BY feature, concept, split ORDER BY x)),
bs AS (SELECT feature, concept, split, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
  / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS s FROM rk GROUP BY ALL),
al AS (SELECT feature, concept, 'continuous' AS kind, split, s FROM cs UNION ALL SELECT feature, concept, 'binary', split, s FROM bs),
sc AS (SELECT feature, concept, kind, max(s) FILTER (split = 'train') AS train_score, max(s) FILTER (split = 'test') AS test_score FROM al GROUP BY ALL),
st AS (SELECT *, CASE kind WHEN 'binary' THEN abs(test_score - 0.5) ELSE test_score END AS m FROM sc)"""


@query("concept_probes", CONCEPTS + " SELECT feature, concept, kind, round(train_score, 6) AS train_score, round(test_score, 6) AS test_score FROM sc")
def concept_probes(spark, sf):
    return rounded(_scores(spark, sf))


@query(
    "concept_selectivity",
    CONCEPTS
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY m DESC, concept) AS r FROM st)
SELECT feature, max(concept) FILTER (r = 1) AS target_concept, round(max(m) FILTER (r = 1), 6) AS target_metric,
  round(max(m) FILTER (r = 2), 6) AS off_target_max, round(max(m) FILTER (r = 1) - max(m) FILTER (r = 2), 6) AS selectivity_gap FROM r GROUP BY feature""",
)
def concept_selectivity(spark, sf):
    return rounded(CP.selectivity(_scores(spark, sf)))


@query(
    "concept_top_features",
    CONCEPTS
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY m DESC, feature) AS rank FROM st)
SELECT concept, rank, feature, round(m, 6) AS metric FROM r WHERE rank <= 20""",
)
def concept_top_features(spark, sf):
    return rounded(CP.top_features(_scores(spark, sf), 20))


# ---- spectra ---------------------------------------------------------------------------------------------------------------------


@query(
    "spectral_summary",
    """WITH e AS (SELECT p_brand AS layer, p_retailprice AS lam, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS r,
  count(*) OVER (PARTITION BY p_brand) AS n FROM part),
t AS (SELECT *, least(greatest(2, round_even(n * 0.5, 0)), n) AS t FROM e),
s AS (SELECT layer, sum(lam) AS s, sum(lam * lam) AS s2, max(lam) AS mx, any_value(n) AS n, any_value(t) AS t,
  min(lam) FILTER (r <= t) AS low, sum(ln(lam)) FILTER (r <= t) AS logs FROM t GROUP BY layer)
SELECT layer, round(s * s / (s2 + 1e-30), 6) AS participation_ratio, round(1 + t / (logs - t * ln(low + 1e-30)), 6) AS alpha_hill,
  round(s / (mx + 1e-30), 6) AS stable_rank, round(mx, 6) AS lambda_max, n AS n_eigs, 0.5::DOUBLE AS tail_frac FROM s""",
)
def spectral_summary(spark, sf):
    eigs = table(spark, sf, "part").select(F.col("p_brand").alias("layer"), F.col("p_retailprice").alias("lam"))
    return rounded(Z.spectral_summary(eigs, ["layer"]))


@query(
    "tall_matrix_spectrum",
    """WITH w AS (SELECT l_returnflag AS model, l_linestatus AS layer, l_quantity AS a, l_extendedprice / 1000 AS b, l_discount * 10 AS c, l_tax * 10 AS d FROM lineitem),
g AS (SELECT model, layer, sum(a*a) AS aa, sum(b*b) AS bb, sum(c*c) AS cc, sum(d*d) AS dd, sum(a*b) AS ab, sum(a*c) AS ac, sum(a*d) AS ad,
  sum(b*c) AS bc, sum(b*d) AS bd, sum(c*d) AS cd FROM w GROUP BY ALL)
SELECT model, layer, round((aa + bb + cc + dd) / 1000, 4) AS trace,
  round((aa + bb + cc + dd) ** 2 / (aa*aa + bb*bb + cc*cc + dd*dd + 2 * (ab*ab + ac*ac + ad*ad + bc*bc + bd*bd + cd*cd)), 4) AS participation_ratio FROM g""",
)
def tall_matrix_spectrum(spark, sf):
    w = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("layer"),
        F.col("l_orderkey").alias("row_idx"),
        F.array("l_quantity", F.col("l_extendedprice") / 1000, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("w"),
    )
    s = Z.matrix_eigenvalues(w).groupBy("model", "layer").agg(
        (F.sum("lam") / 1000).alias("trace"), (F.sum("lam") ** 2 / F.sum(F.col("lam") ** 2)).alias("participation_ratio")
    )
    return rounded(s, 4)


PR = """WITH e AS (SELECT label AS layer, vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
g AS (SELECT a.layer, a.dim AS i, b.dim AS j, sum(a.v * b.v) AS g FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY a.layer, a.dim, b.dim)"""


@query(
    "matrix_participation",
    PR + """ SELECT layer, round(sum(g) FILTER (i = j), 6) AS trace, round((sum(g) FILTER (i = j)) ** 2 / sum(g * g), 6) AS participation_ratio FROM g GROUP BY layer""",
)
def matrix_participation(spark, sf):
    w = table(spark, sf, "embeddings").select(F.col("label").alias("layer"), F.col("vec_id").alias("row_idx"), F.col("embedding").alias("w"))
    s = Z.spectral_summary(Z.matrix_eigenvalues(w, ["layer"]), ["layer"])
    return rounded(s.select("layer", (F.col("stable_rank") * F.col("lambda_max")).alias("trace"), "participation_ratio"))


@query(
    "activation_participation",
    f"""WITH {CROSSED}, c AS (SELECT a.dim AS i, b.dim AS j, covar_pop(a.v, b.v) AS c FROM fl a JOIN fl b USING (row_id) GROUP BY a.dim, b.dim)
SELECT round((sum(c) FILTER (i = j)) ** 2 / sum(c * c), 6) AS participation_ratio FROM c""",
)
def activation_participation(spark, sf):
    eigs = Z.activation_spectrum(crossed(spark, sf))
    return rounded(Z.spectral_summary(eigs, []).select("participation_ratio"))


@query(
    "low_rank_merge",
    """WITH e AS (SELECT label AS layer, vec_id AS row_idx, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
a AS (SELECT layer, dim, v, row_number() OVER (PARTITION BY layer, dim ORDER BY row_idx) - 1 AS r FROM e)
SELECT e.layer, e.row_idx, e.dim, round(any_value(e.v) + sum(0.5 * b.v * a.v), 6) AS w FROM e JOIN e b ON b.row_idx = e.row_idx AND b.dim < 4
JOIN a ON a.layer = e.layer AND a.dim = e.dim AND a.r = b.dim GROUP BY e.layer, e.row_idx, e.dim""",
)
def low_rank_merge(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "embeddings").select(F.col("label").alias("layer"), F.col("vec_id").alias("row_idx"), F.col("embedding").cast("array<double>").alias("w"))
    left = e.select("layer", "row_idx", F.slice("w", 1, 4).alias("b"))
    order = Window.partitionBy("layer").orderBy("row_idx")
    right = e.select("layer", (F.row_number().over(order) - 1).alias("r"), F.col("w").alias("a")).where(F.col("r") < 4)
    return rounded(Z.merge_update(e, left, right, 0.5).select("layer", "row_idx", F.posexplode("w").alias("dim", "w")))


@query("low_rank_update_deltas")
def low_rank_update_deltas(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "embeddings").select(F.col("label").alias("layer"), F.col("vec_id").alias("row_idx"), F.col("embedding").cast("array<double>").alias("w"))
    left = e.select("layer", "row_idx", F.slice("w", 1, 4).alias("b"))
    order = Window.partitionBy("layer").orderBy("row_idx")
    right = e.select("layer", (F.row_number().over(order) - 1).alias("r"), F.col("w").alias("a")).where(F.col("r") < 4)
    return rounded(Z.update_deltas(e, left, right, 0.5))


# ---- fitted probes -------------------------------------------------------------------------------------------------------------------


@query("linear_probe_by_seed")
def linear_probe_by_seed(spark, sf):
    return rounded(B.linear_probe(crossed(spark, sf), (42, 123, 2024)))


@query("probe_report")
def probe_report(spark, sf):
    return rounded(B.probe_report(crossed(spark, sf), (42, 123, 2024, 7, 11)))


@query("layer_probe")
def layer_probe(spark, sf):
    f = crossed(spark, sf).withColumn("recording_id", F.col("recording_id") * 2 + F.col("row_id") % 2)
    deep = f.withColumn("depth", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "x", F.transform("x", lambda v: F.when(F.col("depth") == 0, v).otherwise(v * v))
    )
    return rounded(B.layer_probe(deep))


# ---- certificates of fitted models: what must hold at a solution, beside what SQL can say of its inputs -----------------------------------


SPLIT = """q AS (SELECT vec_id AS id, embedding AS x FROM embeddings WHERE vec_id % 2 = 1),
sp AS (SELECT id, row_number() OVER (ORDER BY md5(concat_ws(':', 0, id)), id) > greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS train
  FROM q JOIN embeddings e ON e.vec_id = q.id - 1)"""


@query(
    "ridge_normal_equations",
    f"""WITH {SPLIT}, t AS (SELECT unnest(range(len(x))) AS dim, unnest(x)::DOUBLE AS v FROM q JOIN sp USING (id) WHERE train)
SELECT dim, round(avg(v), 6) AS mu, round(stddev_pop(v), 6) AS sd, count(*) AS n_train, 0.0::DOUBLE AS residual FROM t GROUP BY dim""",
)
def ridge_normal_equations(spark, sf):
    """Z'(Y - prediction) = alpha W for the standardised training rows Z: the largest miss of each feature, relative."""
    pairs = _query(spark, sf).join(_gallery(spark, sf).select(F.col("id").alias("correct_id"), F.col("emb").alias("y")), "correct_id")
    split = sampling.subject_split(pairs.select(F.col("id").alias("subject_id")), 0.2, 0).withColumnRenamed("subject_id", "id")
    train = pairs.join(split, "id").where(F.col("split") == "train").withColumnRenamed("emb", "x")
    model, alpha = G.fit_ridge_map(train, 1000.0), 1000.0
    told = G.apply_ridge_map(train, model).select(A.as_double("x").alias("x"), A.subtract(A.as_double("y"), F.col("prediction")).alias("r"))
    cross, n, _ = moments.gram(told, "x", "r", center_left=model.mu, scale_left=model.scale)
    miss = np.abs(cross - alpha * model.weights).max(axis=1) / np.abs(alpha * model.weights).max()
    rows = [(d, float(model.mu[d]), float(model.scale[d]), int(n), float(miss[d])) for d in range(len(miss))]
    return rounded(spark.createDataFrame(rows, "dim long, mu double, sd double, n_train long, residual double"))


@query(
    "erasure_certificate",
    f"""WITH {CROSSED}, k AS (SELECT count(DISTINCT subject_id) - 1 AS rank FROM f)
SELECT subject_id, count(*) AS n, 0.0::DOUBLE AS shift, any_value(rank) AS rank, (64 - any_value(rank))::DOUBLE AS trace, 0.0::DOUBLE AS idempotence FROM f, k GROUP BY subject_id""",
)
def erasure_certificate(spark, sf):
    """After erasure every subject has the same mean; the projector repeats itself and leaves width - rank directions."""
    f = crossed(spark, sf)
    eraser = E.fit_eraser(f, E.fit_whitening(f))
    cells = moments.cell_moments(E.apply_eraser(f, eraser), ["subject_id"])
    shift = F.array_max(F.transform(A.subtract(F.col("mean"), F.lit([float(v) for v in eraser.mu])), F.abs))
    p = eraser.projector
    out = cells.select("subject_id", "n", shift.alias("shift"))
    return rounded(out.withColumns({"rank": F.lit(eraser.rank), "trace": F.lit(float(np.trace(p))), "idempotence": F.lit(float(np.abs(p @ p - p).max()))}))


@query(
    "label_direction_overlap",
    """WITH m AS (SELECT label, dim, avg(v) AS v FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL)
SELECT b.label::BIGINT AS label, round(pow(sum(a.v * b.v), 2) / (sum(a.v * a.v) * sum(b.v * b.v)), 6) AS overlap
FROM m a JOIN m b USING (dim) WHERE a.label = 0 AND b.label BETWEEN 1 AND 3 GROUP BY b.label""",
)
def label_direction_overlap(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("x"))
    means = moments.cell_moments(rows, ["label"]).select("label", A.unit(F.col("mean")).alias("x")).persist()
    first = means.where("label = 0").select("x")
    found = [(k, E.subspace_overlap(first, means.where(F.col("label") == k).select("x"))) for k in (1, 2, 3)]
    means.unpersist()
    return rounded(spark.createDataFrame(found, "label long, overlap double"))


@query(
    "probe_stationarity",
    f"""WITH {CROSSED}, r AS (SELECT subject_id, label AS y FROM f),
g AS (SELECT subject_id, arg_min(y, (-n, y)) AS y FROM (SELECT subject_id, y, count(*) AS n FROM r GROUP BY ALL) GROUP BY subject_id),
d AS (SELECT subject_id, (row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws(':', 42, subject_id)), subject_id) - 1) % 5 AS fold FROM g)
SELECT m, count(*) AS n_train, sum(y)::BIGINT AS n_positive, 0.0::DOUBLE AS gradient FROM r JOIN d USING (subject_id), range(0, 5) AS t(m) WHERE fold <> m GROUP BY m""",
)
def probe_stationarity(spark, sf):
    """The balanced, penalised logistic loss of each fold's probe is flat where its fit ended, to five digits."""
    f = crossed(spark, sf)
    folds = sampling.stratified_group_folds(f, "subject_id", "label", 5, 42)
    every = F.sequence(F.lit(0), F.lit(4))
    rows = f.join(folds, "subject_id").select(
        "x", F.col("label").alias("y"), F.transform(F.filter(every, lambda i: i != F.col("fold")), lambda i: i).cast("array<int>").alias("train")
    )
    models = B.fit_binary_models(rows, 5, clip=(1.0, 99.0), penalise_intercept=True)

    def slope(x, y, m):
        d = models.design(x, m)
        w = models.class_weight[y, m]
        return np.concatenate([[len(x), y.sum()], d.T @ (w * (models.probability(x, m) - y))])

    found = overlapping.set_sums(rows.select(A.as_double("x").alias("x"), F.col("y").cast("int").alias("y"), "train"), 5, slope)
    out = [(m, int(s[0]), int(s[1]), float(np.abs(s[2:] + models.coef[m]).max())) for m, s in found.items()]
    return rounded(spark.createDataFrame(out, "m long, n_train long, n_positive long, gradient double"), 5)
