"""Cohort building, channel and target selection, hidden-state pooling, user extractors, decoding."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from strataframe import session
from strataframe.operators import pooling as P, ridge, sampling, segment as S, selecting as X, variance as V
from strataframe.plans import moments
from strataframe.sources import cohorts as C
from strataframe.streaming import decode as D

from .registry import NESTED, crossed, nested, query, rounded, table
from .sequences import SIGNAL, signal
from .signals import WINDOWS, windows


@query(
    "select_channels",
    f"""WITH {SIGNAL}, w(pos, u, ch) AS (VALUES (0, 'VIEW', 'View'), (1, 'PURCHASE', 'Purchase'))
SELECT s.row_id, pos, w.ch FROM s JOIN w ON upper(trim(s.ch)) = w.u""",
)
def select_channels(spark, sf):
    return rounded(S.select_channels(signal(spark, sf), ["View", "Purchase"]).select("row_id", "pos", "ch"))


@query(
    "restrict_subjects",
    "SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def restrict_subjects(spark, sf):
    name = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("sub-"), "o_custkey")).otherwise(F.col("o_custkey").cast("string"))
    wanted = table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(name.alias("subject"))
    return rounded(X.restrict_subjects(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), wanted, "c_custkey"))


@query(
    "finite_targets",
    "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 > 2",
)
def finite_targets(spark, sf):
    k = F.col("o_orderkey") % 5
    bad = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, F.lit(None).cast("double")).otherwise(F.col("o_totalprice"))
    return X.finite_targets(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", bad.alias("t")), ["o_totalprice", "t"]).select("o_orderkey")


@query("select_layers", "SELECT vec_id % 7 AS depth, count(*) AS n FROM embeddings WHERE vec_id % 7 IN (0, 2, 6) GROUP BY ALL")
def select_layers(spark, sf):
    deep = table(spark, sf, "embeddings").select((F.col("vec_id") % 7).alias("depth"))
    return X.select_layers(deep, [-1, 0, 2], 7).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query(
    "vocabulary_channels",
    "SELECT c_custkey, c_mktsegment AS ch FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_nationkey = 3)",
)
def vocabulary_channels(spark, sf):
    c = table(spark, sf, "customer")
    vocab = c.where(F.col("c_nationkey") == 3).select(F.col("c_mktsegment").alias("ch"))
    return X.vocabulary_channels(c.select("c_custkey", F.col("c_mktsegment").alias("ch")), vocab)


@query("target_names", "SELECT DISTINCT p_brand AS name FROM part WHERE p_brand IN ('Brand#11', 'Brand#23')")
def target_names(spark, sf):
    return X.check_targets(table(spark, sf, "part").select(F.col("p_brand").alias("name")), ["Brand#11", "Brand#23"])


@query("pooled_trials", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def pooled_trials(spark, sf):
    o = table(spark, sf, "orders")
    parts = [o.where(F.col("o_orderkey") % 3 == i).select("o_orderstatus", "o_totalprice") for i in range(3)]
    return rounded(X.pool_trials(parts).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("distinct_union", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def distinct_union(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return X.distinct_union(a, table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("k")))


@query(
    "split_rows",
    """WITH s AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY md5(concat_ws(':', 1, user_id)), user_id)
  <= greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS test FROM s)
SELECT event_id, CASE WHEN test THEN 'test' ELSE 'train' END AS split FROM events JOIN r USING (user_id)""",
)
def split_rows(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("subject_id"))
    return e.join(sampling.subject_split(e, 0.2, 1), "subject_id").select("event_id", "split")


@query(
    "padded_windows",
    f"""WITH {SIGNAL}, i AS (SELECT recording_id, v, row_number() OVER (PARTITION BY recording_id ORDER BY row_id) - 1 AS k FROM s),
n AS (SELECT recording_id, k // 6 AS epoch, sum(v) AS total FROM i GROUP BY ALL HAVING count(*) = 6)
SELECT recording_id, epoch, 8 AS n, round(total, 6) AS total, 0.0::DOUBLE AS last_v FROM n""",
)
def padded_windows(spark, sf):
    indexed = S.index_samples(signal(spark, sf), ["recording_id"], ["row_id"])
    w = P.pad_windows(S.fixed_windows(indexed, ["recording_id"], 6), 8)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total")
    return rounded(w.select("recording_id", "epoch", F.size("x").alias("n"), total, F.element_at("x", -1).alias("last_v")))


@query(
    "hidden_state_pool",
    "SELECT l_orderkey, round(avg(l_quantity), 6) AS q, round(avg(l_tax), 6) AS t FROM lineitem GROUP BY l_orderkey",
)
def hidden_state_pool(spark, sf):
    h = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.array("l_quantity", "l_tax")).alias("h"))
    return rounded(P.pool_hidden(h).select("l_orderkey", F.col("x")[0].alias("q"), F.col("x")[1].alias("t")))


@query(
    "extracted_features",
    f"""WITH {WINDOWS} SELECT recording_id, epoch, round(avg(v), 8) AS a, round(stddev_pop(v), 8) AS b FROM w GROUP BY ALL""",
)
def extracted_features(spark, sf):
    w = C.channel_windows_to_signal(windows(spark, sf), ["recording_id", "epoch"])
    out = C.extract_features(w, lambda x: np.stack([x.mean(axis=(1, 2)), x.std(axis=(1, 2))], axis=1), 2)
    return rounded(out.select("recording_id", "epoch", F.col("x")[0].alias("a"), F.col("x")[1].alias("b")), 8)


@query(
    "extracted_layers",
    f"""WITH {WINDOWS} SELECT recording_id, epoch, depth, round(CASE depth WHEN 0 THEN avg(v) ELSE max(v) END, 8) AS a
FROM w, (VALUES (0), (1)) AS d(depth) GROUP BY recording_id, epoch, depth""",
)
def extracted_layers(spark, sf):
    w = C.channel_windows_to_signal(windows(spark, sf), ["recording_id", "epoch"])
    out = C.extract_features(w, lambda x: np.stack([x.mean(axis=2), x.max(axis=2)]), 1, layers=True)
    return rounded(out.select("recording_id", "epoch", "depth", F.col("x")[0].alias("a")), 8)


@query(
    "layers_by_sql",
    f"""WITH {WINDOWS} SELECT recording_id, epoch, depth, round(CASE depth WHEN 0 THEN avg(v) ELSE min(v) END, 8) AS a
FROM w, (VALUES (0), (1)) AS d(depth) GROUP BY recording_id, epoch, depth""",
)
def layers_by_sql(spark, sf):
    C.register_layered_extractor(spark, "mean_and_least", lambda x: np.stack([x.mean(axis=2), x.min(axis=2)]), 1)
    C.channel_windows_to_signal(windows(spark, sf), ["recording_id", "epoch"]).createOrReplaceTempView("windows_by_sql")
    out = spark.sql("SELECT recording_id, epoch, depth, x[0] AS a FROM mean_and_least(TABLE(windows_by_sql) PARTITION BY recording_id)")
    return rounded(out, 8)


@query(
    "statistic_by_sql",
    f"""WITH {NESTED}, m AS (SELECT label, subject_id, dim, avg(v) AS m FROM fl GROUP BY ALL),
d AS (SELECT label, dim, var_pop(m) AS v, stddev_pop(m) AS s FROM m GROUP BY label, dim)
SELECT label::BIGINT AS label, round(sum(v), 6) AS spread FROM d GROUP BY label""",
)
def statistic_by_sql(spark, sf):
    """A user's statistic of the subject means of each label, called from SQL."""
    V.register_subject_statistic(spark, "subject_spread", lambda means, sizes: float(means.var(axis=0).sum()))
    moments.cell_moments(nested(spark, sf), ["label", "subject_id"]).createOrReplaceTempView("subject_means_by_sql")
    return rounded(spark.sql("SELECT label, subject_spread(mean, n) AS spread FROM subject_means_by_sql GROUP BY label"))


@query(
    "stimulus_cohort",
    """WITH p AS (SELECT p_type AS image, p_brand AS cls, p_partkey AS row, unnest([0, 1, 2]) AS t,
  unnest([p_size::DOUBLE, p_retailprice / 100, (p_partkey % 7)::DOUBLE]) AS v FROM part WHERE p_size <> 13),
a AS (SELECT image, t, avg(v) AS v, count(*) AS n FROM p GROUP BY ALL),
z AS (SELECT image, t, n, least(greatest((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-8), -15), 15) AS v FROM a WINDOW w AS (PARTITION BY image)),
f AS (SELECT image, arg_min(cls, row) AS cls FROM p GROUP BY image),
c AS (SELECT image, dense_rank() OVER (ORDER BY cls) - 1 AS label FROM f)
SELECT image, label, n AS n_trials, t, round(v, 6) AS v FROM z JOIN c USING (image)""",
)
def stimulus_cohort(spark, sf):
    p = table(spark, sf, "part").where(F.col("p_size") != 13)
    epochs = p.select(
        F.col("p_partkey").alias("epoch"),
        F.lit("c").alias("ch"),
        F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100, (F.col("p_partkey") % 7).cast("double")).alias("x"),
    )
    stimuli = p.select(F.col("p_partkey").alias("row"), F.col("p_type").alias("image_path"), F.col("p_brand").alias("super_category"))
    out = C.stimulus_cohort(epochs, stimuli)
    return rounded(out.select("image", "label", "n_trials", F.posexplode("x").alias("t", "v")))


@query(
    "trait_cohort",
    f"""WITH {SIGNAL}, i AS (SELECT recording_id AS sid, ch, v, row_number() OVER (PARTITION BY recording_id, ch ORDER BY row_id) - 1 AS k FROM s WHERE ch IN ('view', 'click')),
b AS (SELECT sid FROM i GROUP BY sid HAVING count(DISTINCT ch) = 2),
n AS (SELECT sid, ch, k // 4 AS epoch FROM i JOIN b USING (sid) GROUP BY ALL HAVING count(*) = 4),
u AS (SELECT sid, sid % 2 AS label, row_number() OVER (PARTITION BY sid % 2 ORDER BY sid) AS r FROM (SELECT DISTINCT sid FROM n)),
w AS (SELECT i.sid, label, i.ch, n.epoch, k % 4 AS t, v FROM i JOIN n ON n.sid = i.sid AND n.ch = i.ch AND n.epoch = k // 4 JOIN u ON u.sid = i.sid AND r <= 30),
sc AS (SELECT sid, ch, avg(v) AS mu, stddev_pop(v) + 1e-8 AS sigma FROM w GROUP BY ALL)
SELECT sid AS subject_id, label, ch, epoch, t, round(least(greatest((v - mu) / sigma, -15), 15), 6) AS v FROM w JOIN sc USING (sid, ch)""",
)
def trait_cohort(spark, sf):
    s = signal(spark, sf).withColumnRenamed("recording_id", "subject_id")
    indexed = S.index_samples(s, ["subject_id", "ch"], ["row_id"])
    labels = s.select("subject_id", (F.col("subject_id") % 2).alias("label")).distinct()
    out = C.trait_cohort(indexed, labels, 4, ["View", "Click"], max_per_class=30)
    return rounded(out.select("subject_id", "label", "ch", "epoch", F.posexplode("x").alias("t", "v")))


@query("decode_trials")
def decode_trials(spark, sf):
    # codes are labels; the gallery holds one embedding per label, calibration takes two thirds of the rows
    f = crossed(spark, sf)
    code = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("bigint").alias("code"))
    trials = f.join(code, "row_id").select(F.col("row_id").alias("trial"), "code", F.lit("c").alias("ch"), "x")
    gallery = P.mean_pool(trials, ["code"]).select(F.col("code").alias("id"), F.col("x").alias("emb"))
    scaler, model, _ = D.calibrate(trials.where(F.col("trial") % 3 < 2), gallery, average=False)
    test = S.apply_epoch_scaler(trials.where(F.col("trial") % 3 == 2), scaler, ["ch"])
    return rounded(D.running_accuracy(D.decode_stream(D.concat_channels(test), model, gallery, (1, 3)), (1, 3)))


@query(
    "stream_online_decode",
    """WITH f AS (SELECT vec_id AS trial, label AS code, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM f GROUP BY dim),
z AS (SELECT trial, code, dim, (v - m) / s AS z FROM f JOIN m USING (dim)),
g AS (SELECT code AS id, dim, avg(z) AS g FROM z GROUP BY code, dim),
gn AS (SELECT id, sqrt(sum(g * g)) AS n FROM g GROUP BY id),
c AS (SELECT trial, z.code, g.id, sum(z * g) / any_value(gn.n) AS score FROM z JOIN g USING (dim) JOIN gn ON gn.id = g.id GROUP BY trial, z.code, g.id),
r AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY score DESC, id) AS r FROM c)
SELECT trial, code::BIGINT AS code, string_agg(id::VARCHAR, ',' ORDER BY r) FILTER (r <= 3) AS top, max((id = code AND r = 1)::INT) = 1 AS hit1,
  max((id = code AND r <= 3)::INT) = 1 AS hit3 FROM r GROUP BY trial, code""",
)
def stream_online_decode(spark, sf):
    # the stored model standardises; the gallery holds the mean of each label's standardised rows
    trials = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("trial"), F.col("label").cast("bigint").alias("code"), F.col("embedding").cast("array<double>").alias("x")
    )
    total = moments.cell_moments(trials, []).first()
    mean, sd = np.array(total["mean"]), np.sqrt(np.array(total["within"]) / total["n"])
    model = ridge.RidgeMap(mean, sd, np.zeros(len(mean)), np.eye(len(mean)))
    session.ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/online-{uuid.uuid4().hex}"
    ridge.ridge_table(spark, model).coalesce(1).write.parquet(f"{base}/model")
    gallery = P.mean_pool(ridge.apply_ridge_map(trials, model, out="z").select("code", F.col("z").alias("x")), ["code"])
    D.write_replay(trials, f"{base}/replay", seed=0, per_file=256)
    live = D.read_replay(spark, f"{base}/replay", files_per_trigger=4).select("trial", "code", "x")
    done = D.decode_online(live, f"{base}/model", gallery.select(F.col("code").alias("id"), F.col("x").alias("emb")), f"{base}/out", (1, 3), trigger=None)
    return rounded(done.select("trial", "code", F.array_join("top", ",").alias("top"), "hit1", "hit3"))
