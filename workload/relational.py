"""Pooling, filters, encodings, caps, splits, set operations, scores."""

from pyspark.sql import functions as F

from strataframe.operators import metrics as M, pooling as P, sampling, selecting as X

from .registry import CROSSED, crossed, query, rounded, table

SEGMENTS = ["BUILDING", "machinery ", "Automobile"]


@query(
    "recording_mean_pool",
    f"WITH {CROSSED} SELECT recording_id, dim, round(avg(v), 6) AS v, count(*) AS n FROM fl GROUP BY ALL",
)
def recording_mean_pool(spark, sf):
    pooled = P.mean_pool(crossed(spark, sf), ["recording_id"])
    return rounded(pooled.select("recording_id", "n", F.posexplode("x").alias("dim", "v")))


@query(
    "average_repeats",
    """SELECT l_suppkey AS image, l_returnflag AS ch, l_linenumber AS t, round(avg(l_quantity), 6) AS v, count(*) AS n_trials
FROM lineitem GROUP BY ALL""",
)
def average_repeats(spark, sf):
    s = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("image"), F.col("l_returnflag").alias("ch"), F.col("l_linenumber").alias("t"), F.col("l_quantity").alias("v")
    )
    return rounded(P.average_repeats_long(s))


@query(
    "channel_token_pool",
    """WITH t AS (SELECT l_orderkey AS row_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey,
    l_linenumber, l_quantity, l_extendedprice) - 1 AS pos, l_quantity AS q, l_extendedprice AS p FROM lineitem),
b AS (SELECT row_id, floor((max(pos) + 1) / 3) * 3 AS whole FROM t GROUP BY row_id),
r AS (SELECT t.row_id, pos - pos // 3 - 1 AS i, q, p FROM t JOIN b USING (row_id) WHERE pos % 3 <> 0 AND pos < whole)
SELECT row_id, i // 2 AS channel, count(*) AS n, round(avg(q), 6) AS q, round(avg(p), 6) AS p FROM r WHERE i < 4 GROUP BY ALL""",
)
def channel_token_pool(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    tokens = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("row_id"),
        (F.row_number().over(w) - 1).alias("pos"),
        F.array("l_quantity", "l_extendedprice").alias("x"),
    )
    pooled = P.pool_channel_tokens(tokens, n_channels=2, steps=2, group=2)
    return rounded(pooled.select("row_id", "channel", "n", F.col("x")[0].alias("q"), F.col("x")[1].alias("p")))


@query(
    "trait_labels",
    """WITH p AS (SELECT o_orderkey, o_orderdate, c.c_custkey AS sid, upper(trim(c_mktsegment)) AS seg
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
f AS (SELECT sid, seg, row_number() OVER (PARTITION BY sid ORDER BY o_orderdate, o_orderkey) AS r FROM p
  WHERE seg IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE'))
SELECT sid AS subject_id, CASE seg WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END AS label FROM f WHERE r = 1""",
)
def trait_labels(spark, sf):
    sessions = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sessions = sessions.withColumn("participant_id", F.concat(F.lit("sub-"), "c_custkey"))
    return rounded(X.trait_labels(sessions, SEGMENTS, "c_mktsegment", ["o_orderdate", "o_orderkey"]))


@query(
    "first_session",
    """SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""",
)
def first_session(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return rounded(X.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate"))


@query(
    "cap_per_class",
    """SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, c_mktsegment,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer WHERE c_acctbal >= 0) WHERE r <= 50""",
)
def cap_per_class(spark, sf):
    usable = table(spark, sf, "customer").where(F.col("c_acctbal") >= 0).select("c_custkey", "c_mktsegment")
    return rounded(sampling.cap_in_order(usable, "c_mktsegment", "c_custkey", 50))


@query(
    "cap_per_class_split_groups",
    """SELECT l_partkey, l_suppkey, l_returnflag, round(l_extendedprice, 6) AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag
  ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) AS r FROM lineitem) WHERE r <= 1500""",
)
def cap_per_class_split_groups(spark, sf):
    from strataframe.plans.ordered import ranked

    l = table(spark, sf, "lineitem")
    order = ["l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    out = ranked(l, ["l_returnflag"], order, "r", hot_rows=3000).where(F.col("r") <= 1500)
    return rounded(out.select("l_partkey", "l_suppkey", "l_returnflag", F.col("l_extendedprice").alias("price")))


@query(
    "usable_recordings",
    """WITH h AS (SELECT o_custkey AS recording_id, count(*) AS n_times, 0.5 AS sfreq, count(DISTINCT o_orderpriority) AS n_channels
  FROM orders GROUP BY o_custkey),
m AS (SELECT n_channels AS mode FROM h GROUP BY n_channels ORDER BY count(*) DESC, n_channels LIMIT 1)
SELECT recording_id, CASE WHEN n_times / sfreq < 12 THEN printf('too short: %.2fs < 12.0s window+margin', n_times / sfreq)
  WHEN n_channels <> mode THEN printf('n_channels=%d != mode %d', n_channels, mode) END AS reason FROM h, m""",
)
def usable_recordings(spark, sf):
    headers = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("recording_id")).agg(
        F.count("*").alias("n_times"), F.lit(0.5).alias("sfreq"), F.count_distinct("o_orderpriority").alias("n_channels")
    )
    return X.usable_recordings(headers, 12.0).select("recording_id", "reason")


@query(
    "evenly_spaced_cap",
    """WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i,
  count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id FROM r WHERE n <= 20 OR i IN (SELECT CASE WHEN k = 19 THEN r.n - 1
  ELSE floor(k * ((r.n - 1) / 19.0::DOUBLE))::BIGINT END FROM range(0, 20) AS t(k))""",
)
def evenly_spaced_cap(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    return sampling.evenly_spaced(e, ["user_id"], "event_id", 20)


@query(
    "subsample_rows",
    "SELECT event_id FROM (SELECT event_id FROM events ORDER BY md5(concat_ws(':', 3, event_id)), event_id LIMIT 700)",
)
def subsample_rows(spark, sf):
    return sampling.subsample(table(spark, sf, "events").select("event_id"), 700, 3, ["event_id"])


@query(
    "cap_rows_per_subject",
    """WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', 42, vec_id)), vec_id) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, label FROM r WHERE r <= 30 AND n >= 5""",
)
def cap_rows_per_subject(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return rounded(sampling.cap_per_key(e, "label", 30, 5, 42, ["vec_id"]))


@query(
    "holdout_rows",
    """SELECT vec_id, row_number() OVER (ORDER BY md5(concat_ws(':', 0, vec_id)), vec_id)
  <= least(4096, floor((SELECT count(*) FROM embeddings) / 5)) AS holdout FROM embeddings""",
)
def holdout_rows(spark, sf):
    return sampling.holdout_rows(table(spark, sf, "embeddings").select("vec_id"), 4096, 0, ["vec_id"])


@query(
    "subject_split",
    """WITH s AS (SELECT DISTINCT o_custkey AS subject_id FROM orders), r AS (SELECT subject_id,
  row_number() OVER (ORDER BY md5(concat_ws(':', 5, subject_id)), subject_id) AS r, count(*) OVER () AS n FROM s)
SELECT subject_id, CASE WHEN r <= greatest(1, round_even(n * 0.25, 0)) THEN 'test' ELSE 'train' END AS split FROM r""",
)
def subject_split(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"))
    return sampling.subject_split(o, 0.25, 5)


@query(
    "stratified_group_folds",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT user_id, event_type AS y FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r
  FROM c) WHERE r = 1)
SELECT user_id, (row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws(':', 42, user_id)), user_id) - 1) % 5 AS fold FROM m""",
)
def stratified_group_folds(spark, sf):
    return rounded(sampling.stratified_group_folds(table(spark, sf, "events"), "user_id", "event_type", 5, 42))


@query(
    "balanced_group_folds",
    """SELECT event_type, count(*) AS n_rows, 5 AS n_folds, true AS balanced FROM events GROUP BY event_type""",
)
def balanced_group_folds(spark, sf):
    """Rows of each label over the folds of users with mixed labels: folds differ by no more than the largest user does."""
    events = table(spark, sf, "events").select("user_id", "event_type")
    folds = sampling.balanced_group_folds(events, "user_id", "event_type", 5)
    whole = folds.groupBy("user_id").agg(F.max("fold").alias("fold"), F.count(F.lit(1)).alias("times"))
    each = events.join(whole.where("times = 1"), "user_id").groupBy("event_type", "user_id", "fold").agg(F.count(F.lit(1)).alias("n"))
    per = each.groupBy("event_type", "fold").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    spread = F.max("n") - F.min("n") <= F.max("most")
    return rounded(per.groupBy("event_type").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_folds"), spread.alias("balanced")))


@query(
    "group_folds",
    """WITH r AS (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS r FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS fold FROM r""",
)
def group_folds(spark, sf):
    return rounded(sampling.group_folds(table(spark, sf, "events"), "user_id", 5))


@query(
    "stratified_folds",
    """SELECT vec_id, (row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', 42, vec_id)), vec_id) - 1) % 5 AS fold
FROM embeddings""",
)
def stratified_folds(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return rounded(sampling.stratified_folds(e, "label", 5, 42, ["vec_id"]).select("vec_id", "fold"))


@query(
    "presentation_schedule",
    """SELECT p_partkey AS code, r AS repeat, row_number() OVER (ORDER BY md5(concat_ws(':', 9, p_partkey, r)), p_partkey, r) AS position
FROM part, range(1, 5) AS t(r)""",
)
def presentation_schedule(spark, sf):
    return rounded(sampling.presentation_schedule(table(spark, sf, "part").select(F.col("p_partkey").alias("code")), 4, 9))


@query(
    "stimulus_codes",
    """WITH p AS (SELECT 'img/' || lower(p_type) || '/' || p_name || '-' || p_partkey || '.JPG' AS path FROM part)
SELECT path, split_part(path, '/', -1) AS basename, row_number() OVER (ORDER BY split_part(path, '/', -1), path) AS code FROM p""",
)
def stimulus_codes(spark, sf):
    p = table(spark, sf, "part").select(
        F.concat(F.lit("img/"), F.lower("p_type"), F.lit("/"), "p_name", F.lit("-"), "p_partkey", F.lit(".JPG")).alias("path")
    )
    return rounded(X.stimulus_codes(p))


@query(
    "encode_labels",
    """SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS label_code FROM part""",
)
def encode_labels(spark, sf):
    return rounded(X.encode_labels(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand"))


@query(
    "common_channels",
    """WITH c AS (SELECT n_regionkey AS subject_id, c_mktsegment AS ch, min(c_custkey) AS pos FROM customer
  JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT ch, arg_min(pos, subject_id) AS pos FROM c GROUP BY ch
HAVING count(DISTINCT subject_id) = (SELECT count(DISTINCT subject_id) FROM c)""",
)
def common_channels(spark, sf):
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    chans = c.groupBy(F.col("n_regionkey").alias("subject_id"), F.col("c_mktsegment").alias("ch")).agg(F.min("c_custkey").alias("pos"))
    return rounded(X.common_channels(chans))


@query(
    "remaining_work",
    """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def remaining_work(spark, sf):
    done = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return X.remaining(table(spark, sf, "customer").select("c_custkey"), done, ["c_custkey"])


@query(
    "keyed_upsert",
    """WITH n AS (SELECT o_custkey AS id, sum(o_totalprice) AS v FROM orders GROUP BY o_custkey)
SELECT id, round(v, 2) AS v FROM n UNION ALL SELECT c_custkey, round(c_acctbal, 2) FROM customer
WHERE c_custkey NOT IN (SELECT id FROM n)""",
)
def keyed_upsert(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("v"))
    return rounded(X.upsert(old, new, ["id"]), 2)


@query(
    "positional_join",
    """WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders WHERE o_orderstatus <> 'P'),
b AS (SELECT o_orderkey AS stim, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders WHERE o_orderstatus <> 'P')
SELECT o_orderkey, stim FROM a JOIN b USING (i)""",
)
def positional_join(spark, sf):
    kept = table(spark, sf, "orders").where(F.col("o_orderstatus") != "P")
    return X.join_positions(kept.select("o_orderkey"), kept.select(F.col("o_orderkey").alias("stim")), "o_orderkey", "stim")


@query(
    "subject_lookup",
    """SELECT o_orderkey, coalesce(round(c_acctbal, 6), 'nan'::DOUBLE) AS age, CASE WHEN c_custkey IS NULL OR c_custkey % 3 = 0 THEN 'NA'
  WHEN c_custkey % 3 = 1 THEN 'M' ELSE 'F' END AS sex FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0""",
)
def subject_lookup(spark, sf):
    c = table(spark, sf, "customer").where(F.col("c_custkey") % 2 == 0)
    meta = c.select(
        F.concat(F.lit("sub-"), "c_custkey").alias("subject"),
        F.col("c_acctbal").alias("age"),
        F.when(F.col("c_custkey") % 3 == 0, "n/a").when(F.col("c_custkey") % 3 == 1, "M").otherwise("F").alias("sex"),
    )
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("subject"))
    return rounded(X.subject_lookup(rows, meta, "subject", ["age"]).select("o_orderkey", "age", "sex"))


@query(
    "phenotype_left_joins",
    """SELECT c_custkey AS participant_id, round(c_acctbal, 6) AS score, round(t, 2) AS score_orders FROM customer
LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""",
)
def phenotype_left_joins(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("participant_id"), F.col("c_acctbal").alias("score"))
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("Subject")).agg(F.round(F.sum("o_totalprice"), 2).alias("score"))
    return rounded(X.left_join_all(base, {"orders": orders}, "participant_id"))


@query(
    "nearest_electrodes",
    """WITH v AS (SELECT s_suppkey AS ord, s_name AS name, s_acctbal AS x, s_nationkey::DOUBLE AS y, (s_suppkey % 7)::DOUBLE AS z FROM supplier),
c AS (SELECT c_custkey, c_name AS ch, c_acctbal AS x, c_nationkey::DOUBLE AS y, (c_custkey % 7)::DOUBLE AS z FROM customer),
d AS (SELECT ch, name, row_number() OVER (PARTITION BY ch ORDER BY (c.x - v.x) ** 2 + (c.y - v.y) ** 2 + (c.z - v.z) ** 2, ord) AS r
  FROM c, v) SELECT ch, name AS electrode FROM d WHERE r = 1
UNION ALL SELECT upper(name), name FROM v WHERE upper(name) <> name
UNION ALL SELECT 'unplaced', (SELECT name FROM v ORDER BY ord LIMIT 1)""",
)
def nearest_electrodes(spark, sf):
    vocab = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("ord"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("x"),
        F.col("s_nationkey").cast("double").alias("y"),
        (F.col("s_suppkey") % 7).cast("double").alias("z"),
    )
    spots = table(spark, sf, "customer").select(
        F.col("c_name").alias("ch"),
        F.col("c_acctbal").alias("x"),
        F.col("c_nationkey").cast("double").alias("y"),
        (F.col("c_custkey") % 7).cast("double").alias("z"),
    )
    names = spots.select("ch").unionByName(vocab.where(F.upper("name") != F.col("name")).select(F.upper("name").alias("ch")))
    extra = spark.createDataFrame([("unplaced",)], "ch string")
    return X.nearest_electrodes(names.unionByName(extra), vocab, spots)


@query(
    "channel_positions",
    """SELECT c_custkey, round(coalesce(s_acctbal / 1e5, 0), 6) AS x,
  least(greatest(floor((coalesce(s_acctbal / 1e5, 0) + 0.13) / 0.26 * 100), 0), 99)::BIGINT AS x_bin
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
)
def channel_positions(spark, sf):
    montage = table(spark, sf, "supplier").select(
        F.concat(F.lit("E"), "s_suppkey").alias("ch"), (F.col("s_acctbal") / 1e5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")
    )
    chans = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("EEG e"), "c_custkey").alias("ch"))
    return rounded(X.channel_positions(chans, montage).select("c_custkey", "x", "x_bin"))


# ---- scores --------------------------------------------------------------------------------------------------------------


@query(
    "balanced_accuracy",
    """SELECT l_linestatus, round(avg(r), 6) AS balanced_accuracy, count(*) AS n_classes FROM
  (SELECT l_linestatus, l_returnflag = 'N' AS y, avg(CASE WHEN (l_returnflag = 'N') = (l_quantity > 25) THEN 1.0 ELSE 0 END) AS r
   FROM lineitem GROUP BY ALL) GROUP BY l_linestatus""",
)
def balanced_accuracy(spark, sf):
    l = table(spark, sf, "lineitem").select(
        "l_linestatus", (F.col("l_returnflag") == "N").alias("y"), (F.col("l_quantity") > 25).alias("p")
    )
    return rounded(M.balanced_accuracy(l, "y", "p", ["l_linestatus"]))


@query(
    "pearson_by_subject",
    """WITH s AS (SELECT o_custkey, avg(o_totalprice) AS p, avg(o_orderkey % 97) AS q, avg(o_custkey % 5) AS y FROM orders GROUP BY o_custkey)
SELECT 'y' AS target, round(corr(p, y), 6) AS r, count(*) AS n_subjects FROM s
UNION ALL SELECT 'q', round(corr(p, q), 6), count(*) FROM s UNION ALL SELECT 'flat', 'nan'::DOUBLE, count(*) FROM s""",
)
def pearson_by_subject(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_totalprice").alias("p"),
        (F.col("o_orderkey") % 97).alias("q"),
        (F.col("o_custkey") % 5).alias("y"),
        F.lit(1.0).alias("flat"),
    )
    return rounded(M.pearson_by_subject(o, [("p", "y"), ("p", "q"), ("p", "flat")]))


AUC_SQL = """WITH j AS (SELECT source, n_chars % 50 AS score, quality AS y, doc_id FROM documents JOIN labels USING (doc_id))"""


@query(
    "rank_auc",
    AUC_SQL
    + """, r AS (SELECT source, y, rank() OVER w + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0 AS r FROM j
  WINDOW w AS (PARTITION BY source ORDER BY score)),
s AS (SELECT source, sum(r) FILTER (y = 1) AS s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM r GROUP BY source)
SELECT source, CASE WHEN p = 0 OR q = 0 THEN 0.5 ELSE round((s - p * (p + 1) / 2.0) / (p * q), 6) END AS auc, p AS n_pos, q AS n_neg FROM s""",
)
def rank_auc(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    j = j.select("source", (F.col("n_chars") % 50).alias("score"), F.col("quality").alias("y"), F.col("doc_id").alias("row_id"))
    return rounded(M.rank_auc(j, ["source"], "score", "y"))


@query(
    "rank_auc_ordinal",
    AUC_SQL
    + """, r AS (SELECT y, row_number() OVER (ORDER BY score, doc_id) AS r FROM j)
SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
  / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM r""",
)
def rank_auc_ordinal(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    j = j.select((F.col("n_chars") % 50).alias("score"), F.col("quality").alias("y"), F.col("doc_id").alias("row_id"))
    return rounded(M.rank_auc(j, [], "score", "y", ties="ordinal", hot_rows=200))


@query(
    "r2_score",
    """SELECT l_returnflag, round(1 - sum((l_tax - l_discount) ** 2) / (var_pop(l_tax) * count(*) + 1e-12), 6) AS r2, count(*) AS n
FROM lineitem GROUP BY l_returnflag""",
)
def r2_score(spark, sf):
    return rounded(M.r2(table(spark, sf, "lineitem"), "l_tax", "l_discount", ["l_returnflag"]))


@query(
    "seed_summary",
    """WITH b AS (SELECT l_returnflag, l_linenumber AS seed, avg(l_discount) AS ba FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(avg(ba), 6) AS mean, round(stddev_samp(ba), 6) AS std_ddof1, round(stddev_pop(ba), 6) AS std_ddof0,
  round(min(ba), 6) AS min, round(max(ba), 6) AS max, count(*) AS n_seeds, round(avg(ba) FILTER (seed IN (1, 2, 3)), 6) AS mean_first,
  round(stddev_samp(ba) FILTER (seed IN (1, 2, 3)), 6) AS std_first_ddof1 FROM b GROUP BY l_returnflag""",
)
def seed_summary(spark, sf):
    b = table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("seed")).agg(F.avg("l_discount").alias("ba"))
    return rounded(M.seed_summary(b, "ba", ["l_returnflag"], first=(1, 2, 3)))


BANDS = """SELECT l_returnflag AS model, l_linestatus AS block, count(*) AS n_matrices, round(avg(l_quantity / 8), 6) AS alpha_mean,
  round(median(l_quantity / 8), 6) AS alpha_median, round(min(l_quantity / 8), 6) AS alpha_min, round(max(l_quantity / 8), 6) AS alpha_max,
  round(avg((l_quantity / 8 < 2)::INT), 6) AS fraction_lt_2, round(avg((l_quantity / 8 BETWEEN 2 AND 6)::INT), 6) AS fraction_2_6,"""


def _alphas(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("block"), (F.col("l_quantity") / 8).alias("alpha"), F.col("l_tax").alias("log_norm")
    )


@query("health_bands", BANDS + " round(avg((l_quantity / 8 > 6)::INT), 6) AS fraction_gt_6 FROM lineitem GROUP BY ALL")
def health_bands(spark, sf):
    return rounded(M.health_bands(_alphas(spark, sf), ["model", "block"]))


@query("block_summary", BANDS + " round(sum(l_quantity / 8 * l_tax) / sum(l_tax), 6) AS alpha_weighted_mean FROM lineitem GROUP BY ALL")
def block_summary(spark, sf):
    return rounded(M.block_summary(_alphas(spark, sf), ["model", "block"]))


@query(
    "annotation_counts",
    """SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_user_id, count(DISTINCT event_type) AS n_event_type FROM events""",
)
def annotation_counts(spark, sf):
    return M.annotation_counts(table(spark, sf, "events"), ["user_id", "event_type"])


@query(
    "exact_percentiles",
    " UNION ALL ".join(
        f"SELECT l_returnflag, {p}::DOUBLE AS p, round(quantile_cont(l_extendedprice, {p}), 6) AS q FROM lineitem GROUP BY l_returnflag"
        for p in (0.01, 0.5, 0.99)
    ),
)
def exact_percentiles(spark, sf):
    from strataframe.plans.quantiles import exact_percentiles as percentiles

    return rounded(percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.01, 0.5, 0.99]))


@query(
    "layer_summary",
    """WITH d AS (SELECT l_returnflag AS model, l_linenumber AS depth, CASE WHEN l_linenumber = 2 THEN 'nan'::DOUBLE ELSE avg(l_discount) END AS ba
  FROM lineitem GROUP BY l_returnflag, l_linenumber), k AS (SELECT max(depth) AS k FROM d)
SELECT model, round(arg_min(ba, depth), 6) AS label_ba_first, round(arg_max(ba, depth), 6) AS label_ba_last,
  round(max(ba) FILTER (NOT isnan(ba)), 6) AS label_ba_max, round(arg_max(depth, ba) FILTER (NOT isnan(ba)) / max(k), 6) AS argmax_depth
FROM d, k GROUP BY model""",
)
def layer_summary(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("depth")).agg(F.avg("l_discount").alias("label_ba"))
    d = d.withColumn("label_ba", F.when(F.col("depth") == 2, float("nan")).otherwise(F.col("label_ba")))
    d = d.join(F.broadcast(d.agg(F.max("depth").alias("k")))).withColumn("depth_fraction", F.col("depth") / F.col("k"))
    return rounded(M.layer_summary(d, ["model"]))


@query(
    "run_selection",
    """WITH r AS (SELECT p_brand AS opt, p_partkey AS lr, p_retailprice / 2000 AS explained_var, (p_size % 10) / 10.0 AS dead_fraction FROM part),
b AS (SELECT *, max(explained_var) OVER (PARTITION BY opt) AS best FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY opt ORDER BY dead_fraction, explained_var DESC, lr) AS rn FROM b WHERE explained_var >= best - 0.02)
SELECT opt, lr, round(explained_var, 6) AS explained_var, round(dead_fraction, 6) AS dead_fraction FROM k WHERE rn = 1""",
)
def run_selection(spark, sf):
    runs = table(spark, sf, "part").select(
        F.col("p_brand").alias("opt"),
        F.col("p_partkey").alias("lr"),
        (F.col("p_retailprice") / 2000).alias("explained_var"),
        (F.col("p_size") % 10 / 10.0).alias("dead_fraction"),
    )
    return rounded(M.select_run(runs, ["opt"]))


@query(
    "best_run",
    """SELECT p_brand, p_partkey, round(p_retailprice, 6) AS p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand
  ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1""",
)
def best_run(spark, sf):
    return rounded(M.best_by(table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", "p_partkey"))


@query(
    "compare_runs",
    """WITH a AS (SELECT l_suppkey AS name, avg(l_discount) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
b AS (SELECT l_suppkey AS name, avg(l_discount) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT name, round(a.v, 6) AS v_a, round(b.v, 6) AS v_b, round(b.v - a.v, 6) AS v_delta FROM a JOIN b USING (name)""",
)
def compare_runs(spark, sf):
    l = table(spark, sf, "lineitem")
    side = lambda s: l.where(F.col("l_linestatus") == s).groupBy(F.col("l_suppkey").alias("name")).agg(F.avg("l_discount").alias("v"))
    return rounded(M.compare_runs(side("F"), side("O"), ["name"], ["v"]))


@query(
    "standardise_targets",
    """WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderstatus <> 'O')
SELECT o_orderkey, round((o_totalprice - m) / (s.s + 1e-8), 6) AS y FROM orders, s""",
)
def standardise_targets(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("y"), F.when(F.col("o_orderstatus") == "O", "test").otherwise("train").alias("split")
    )
    return rounded(M.standardise_targets(o, ["y"]).drop("split"))


@query(
    "calibration_report",
    """WITH t AS (SELECT l_partkey AS code, count(*) AS c FROM lineitem GROUP BY l_partkey)
SELECT sum(c)::BIGINT AS n_trials, count(*) FILTER (code % 2 = 0) AS n_fit_samples, count(*) FILTER (code % 2 = 0) AS n_images,
  round(avg(c) FILTER (code % 2 = 0), 6) AS mean_trials_per_image FROM t""",
)
def calibration_report(spark, sf):
    gallery = table(spark, sf, "part").where(F.col("p_partkey") % 2 == 0).select(F.col("p_partkey").alias("id"))
    return rounded(M.calibration_report(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("code")), gallery))


@query(
    "best_sampled_images",
    """SELECT l_partkey AS code, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, code LIMIT 40""",
)
def best_sampled_images(spark, sf):
    return X.best_sampled(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("code")), "code", 40)


@query(
    "known_codes",
    """SELECT l_orderkey, l_partkey AS code FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)""",
)
def known_codes(spark, sf):
    gallery = table(spark, sf, "part").where(F.col("p_size") > 25).select(F.col("p_partkey").alias("id"))
    trials = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("code"))
    return X.keep_known_codes(trials, gallery)


@query(
    "concept_table",
    """SELECT c_custkey AS subject_id, 'score' AS concept, 'continuous' AS kind, round(c_acctbal, 6) AS y FROM customer
UNION ALL SELECT c_custkey, 'sex', 'binary', CASE c_custkey % 3 WHEN 0 THEN 1.0 ELSE 0.0 END FROM customer WHERE c_custkey % 3 < 2""",
)
def concept_table(spark, sf):
    sex = F.when(F.col("c_custkey") % 3 == 0, "M").when(F.col("c_custkey") % 3 == 1, "F").otherwise("NA")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_acctbal").alias("score"), sex.alias("sex"))
    return rounded(X.concept_table(c, ["score"]))


@query(
    "eligible_datasets",
    """SELECT c_mktsegment || '-' || c_nationkey AS dataset, count(*) AS n_subjects FROM customer GROUP BY ALL
HAVING count(*) BETWEEN 8 AND 14 AND lower(c_mktsegment || '-' || c_nationkey) NOT LIKE '%machin%'""",
)
def eligible_datasets(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("dataset")).agg(F.count("*").alias("n_subjects"))
    return X.eligible_datasets(c, 8, 14, exclude="machin")
