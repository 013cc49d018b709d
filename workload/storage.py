"""Table sinks and sources: write to the shared folder, read back through the library, compare with the raw table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataframe import contracts
from strataframe.operators import selecting as X
from strataframe.plans import moments
from strataframe.session import ensure_checkpoint_dir
from strataframe.sources import cohorts as C, tables as T

from .registry import CROSSED, crossed, query, rounded, table


def _place(spark, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{name}-{uuid.uuid4().hex}"


@query("stored_activations", f"WITH {CROSSED} SELECT row_id, subject_id, label, round(x[3]::DOUBLE, 6) AS v FROM f WHERE label = 1")
def stored_activations(spark, sf):
    path = _place(spark, "activations")
    T.write_activations(crossed(spark, sf), path, ["label"])
    rows = T.read_activations(spark, path, ["row_id", "subject_id", "label", "x"]).where("label = 1")
    return rounded(rows.select("row_id", "subject_id", "label", F.col("x")[2].alias("v")))


@query(
    "stored_dictionary",
    """WITH m AS (SELECT label, dim, avg(v) AS v FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)
  GROUP BY label, dim)
SELECT label::BIGINT AS feature, round(max(v) FILTER (dim = 0), 6) AS enc_first, round(max(v) FILTER (dim = 63), 6) AS dec_last, 7 AS k,
  count(*) AS width FROM m GROUP BY label""",
)
def stored_dictionary(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("feature"), F.col("embedding").cast("array<double>").alias("x"))
    atoms = moments.cell_moments(rows, ["feature"]).select("feature", F.col("mean").alias("enc"), F.lit(0.5).alias("enc_bias"), F.col("mean").alias("dec"))
    path = _place(spark, "dictionary")
    T.write_dictionary(atoms, [0.25] * 64, 7, path)
    found = T.read_atoms(spark, path)
    fields = found.select("feature", F.col("enc")[0].alias("enc_first"), F.element_at("dec", -1).alias("dec_last"), "k", F.size("enc").alias("width"))
    return rounded(fields)


@query(
    "stored_epochs",
    """SELECT user_id * 1000000 + event_id AS epoch, event_type AS ch, round(value, 6) AS v,
  round(CASE WHEN event_id % 2 = 0 THEN 125 ELSE 250 END, 6)::DOUBLE AS sfreq FROM events""",
)
def stored_epochs(spark, sf):
    rows = table(spark, sf, "events").select(
        (F.col("user_id") * 1_000_000 + F.col("event_id")).alias("epoch"),
        F.col("event_type").alias("ch"),
        F.array("value").alias("x"),
        F.when(F.col("event_id") % 2 == 0, F.lit(125.0)).alias("sfreq"),
    )
    path = _place(spark, "epochs")
    rows.write.parquet(path)
    return rounded(T.read_epochs(spark, path).select("epoch", "ch", F.col("x")[0].alias("v"), "sfreq"))


@query("stored_stimuli", "SELECT p_partkey AS code, p_name AS path FROM part WHERE p_size % 3 = 1 AND p_partkey % 5 <> 0")
def stored_stimuli(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("code"),
        F.col("p_name").alias("path"),
        F.when(F.col("p_size") % 3 == 1, "train").otherwise("test").alias("partition"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit(True)).alias("dropped"),
    )
    path = _place(spark, "stimuli")
    rows.write.parquet(path)
    return T.read_stimuli(spark, path, "train").select("code", "path")


@query(
    "participant_labels",
    """SELECT c_custkey AS subject_id, (c_mktsegment = 'BUILDING')::BIGINT AS label FROM customer
WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')""",
)
def participant_labels(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.concat(F.lit("sub-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("participant_id"),
        F.concat(F.lower("c_mktsegment"), F.lit(" ")).alias("arm"),
    )
    path = _place(spark, "participants")
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return rounded(C.participant_labels(spark, path, ("automobile", "building"), "arm"))


@query("stored_gallery", "SELECT vec_id AS id, round(list_sum(embedding), 4) AS total FROM embeddings")
def stored_gallery(spark, sf):
    path = _place(spark, "gallery")
    T.write_gallery(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("emb")), path)
    total = F.aggregate("emb", F.lit(0.0), lambda a, v: a + v)
    return T.read_gallery(spark, path).select("id", F.round(total, 4).alias("total"))


@query("stored_scores", "SELECT l_suppkey AS model, round(avg(l_discount), 6) AS score FROM lineitem GROUP BY l_suppkey")
def stored_scores(spark, sf):
    path = _place(spark, "scores")
    T.write_scores(rounded(table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg(F.avg("l_discount").alias("score"))), path)
    return spark.read.option("header", True).schema("model long, score double").csv(path)


@query(
    "stored_leaderboard",
    "SELECT n_name AS dataset, 'p' || n_regionkey AS paradigm, n_nationkey::VARCHAR AS n_subjects, NULL::VARCHAR AS c_bar_value FROM nation",
)
def stored_leaderboard(spark, sf):
    rows = table(spark, sf, "nation").select(
        F.col("n_name").alias("dataset"), F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("paradigm"), F.col("n_nationkey").cast("string").alias("n_subjects")
    )
    path = _place(spark, "leaderboard")
    T.write_leaderboard(rows, path)
    return T.read_leaderboard(spark, path).select("dataset", "paradigm", "n_subjects", "c_bar_value")


@query(
    "stored_results",
    """SELECT l_returnflag AS dataset, l_suppkey AS model, round(avg(l_discount), 6) AS score,
  CASE WHEN l_suppkey % 2 = 0 THEN 'n' || count(*) ELSE 'none' END AS note, CASE WHEN l_returnflag = 'R' THEN count(*) ELSE -1 END AS extra
FROM lineitem GROUP BY l_returnflag, l_suppkey""",
)
def stored_results(spark, sf):
    """Results by data set and model as nested JSON, one a line; fields that a result lacks give the default."""
    each = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").alias("model")).agg(
        F.round(F.avg("l_discount"), 6).alias("score"), F.count(F.lit(1)).alias("n")
    )
    probe = F.struct("score", F.when(F.col("model") % 2 == 0, F.concat(F.lit("n"), "n")).alias("note"))
    extra = F.when(F.col("dataset") == "R", F.struct(F.col("n").alias("rows")))
    path = _place(spark, "results")
    each.select("dataset", "model", probe.alias("probe"), extra.alias("later")).write.partitionBy("dataset").json(path)
    lines = T.read_result_variants(spark, path, multiline=False).withColumn("model", T.setting("parts", "model", "long"))
    stored = _place(spark, "result-table")
    T.write_results(lines, stored)
    found = spark.read.parquet(stored)
    return found.select(
        "dataset", "model", T.setting("parts", "probe.score", "double", F.lit(-1.0)).alias("score"),
        T.setting("parts", "probe.note", "string", F.lit("none")).alias("note"), T.setting("parts", "later.rows", "long", F.lit(-1)).alias("extra"),
    )


@query(
    "stored_manifest",
    """SELECT 'run' || user_id AS run, count(*) AS draws, CASE WHEN user_id % 3 = 0 THEN 'default' ELSE min(event_type) END AS mode,
  CASE WHEN user_id % 2 = 0 THEN round(avg(value), 6) END AS lr FROM events GROUP BY user_id""",
)
def stored_manifest(spark, sf):
    """Runs of two kinds with different settings, appended in two jobs."""
    runs = table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("draws"), F.min("event_type").alias("mode"), F.round(F.avg("value"), 6).alias("lr")
    )
    runs = runs.withColumn("run", F.concat(F.lit("run"), "user_id")).withColumn("mode", F.when(F.col("user_id") % 3 > 0, F.col("mode")))
    path = _place(spark, "manifest")
    T.write_manifest(runs.where("user_id % 2 = 0").select("run", F.struct("draws", "mode", "lr").alias("config")), path)
    T.write_manifest(runs.where("user_id % 2 <> 0").select("run", F.to_json(F.struct("mode", "draws")).alias("config")), path)
    rows = T.read_manifest(spark, path)
    return rounded(rows.select(
        "run", T.setting("config", "draws", "long").alias("draws"), T.setting("config", "mode", "string", F.lit("default")).alias("mode"),
        T.setting("config", "lr", "double").alias("lr"),
    ))


@query(
    "contract_violations",
    f"""WITH {CROSSED}
SELECT 'labels' AS kind, subject_id AS id FROM f GROUP BY subject_id HAVING min(label) <> max(label)
UNION ALL SELECT 'width', row_id FROM f WHERE row_id % 11 = 0""",
)
def contract_violations(spark, sf):
    rows = crossed(spark, sf)
    cut = rows.withColumn("x", F.when(F.col("row_id") % 11 == 0, F.slice("x", 1, 63)).otherwise(F.col("x")))
    width = contracts.width_violations(cut, 64).select(F.lit("width").alias("kind"), F.col("row_id").alias("id"))
    return contracts.single_label_violations(rows).select(F.lit("labels").alias("kind"), F.col("subject_id").alias("id")).unionByName(width)


@query(
    "best_sampled_per_class",
    """SELECT l_partkey % 7 AS cls, l_partkey AS code, count(*) AS n FROM lineitem GROUP BY l_partkey
QUALIFY row_number() OVER (PARTITION BY l_partkey % 7 ORDER BY count(*) DESC, l_partkey) <= 6""",
)
def best_sampled_per_class(spark, sf):
    trials = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("code"), (F.col("l_partkey") % 7).alias("cls"))
    return X.best_sampled(trials, "code", 6, by=["cls"])
