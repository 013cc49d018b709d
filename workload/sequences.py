"""Runs, windows, referencing, scalers and marker epochs on the event table."""

from pyspark.sql import functions as F

from strataframe.operators import metrics as M, segment as S

from .registry import query, rounded, table

HOUR = 3600.0


def signal(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("recording_id"),
        F.col("event_type").alias("ch"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
        F.col("value").alias("v"),
    )


def markers(spark, sf):
    return signal(spark, sf).where(F.col("ch") == "purchase").select(F.col("row_id").alias("code"), "recording_id", F.col("ts").alias("onset"))


SIGNAL = """s AS (SELECT event_id AS row_id, user_id AS recording_id, event_type AS ch, epoch_us(ts) / 1e6 AS ts, value AS v
  FROM events)"""
MARKERS = "m AS (SELECT row_id AS code, recording_id, ts AS onset FROM s WHERE ch = 'purchase' AND row_id <> 0)"


@query(
    "segment_runs",
    f"""WITH {SIGNAL},
p AS (SELECT *, lag(ch) OVER (PARTITION BY recording_id ORDER BY row_id) AS prev FROM s),
r AS (SELECT *, sum(CASE WHEN prev = ch THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY row_id) - 1 AS run FROM p)
SELECT recording_id, run, ch, min(row_id) AS first_row, max(row_id) AS last_row, count(*) AS n_rows FROM r GROUP BY ALL""",
)
def segment_runs(spark, sf):
    return rounded(S.runs_to_recordings(signal(spark, sf), ["recording_id"], "row_id", ["ch"]))


@query(
    "segment_runs_split_sessions",
    f"""WITH {SIGNAL},
p AS (SELECT *, lag(recording_id) OVER (ORDER BY row_id) AS pr, lag(ch) OVER (ORDER BY row_id) AS prev FROM s),
r AS (SELECT *, sum(CASE WHEN prev = ch AND pr = recording_id THEN 0 ELSE 1 END) OVER (ORDER BY row_id) - 1 AS run FROM p)
SELECT run, recording_id, ch, min(row_id) AS first_row, max(row_id) AS last_row, count(*) AS n_rows FROM r GROUP BY ALL""",
)
def segment_runs_split_sessions(spark, sf):
    # the whole table is one session, cut into ranges as a hot key would be
    one = signal(spark, sf)
    return rounded(S.runs_to_recordings(one, [], "row_id", ["recording_id", "ch"], hot_rows=2000))


@query(
    "fixed_windows",
    f"""WITH {SIGNAL},
i AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY row_id) - 1 AS k FROM s)
SELECT recording_id, k // 8 AS epoch, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std
FROM i GROUP BY ALL HAVING count(*) = 8""",
)
def fixed_windows(spark, sf):
    indexed = S.index_samples(signal(spark, sf), ["recording_id"], ["row_id"])
    return rounded(S.window_stats(indexed, ["recording_id"], 8))


@query(
    "average_reference",
    f"""WITH {SIGNAL} SELECT row_id, round(v - avg(v) OVER (PARTITION BY recording_id, floor(ts / 86400)), 6) AS v FROM s""",
)
def average_reference(spark, sf):
    day = signal(spark, sf).withColumn("day", F.floor(F.col("ts") / 86400))
    return rounded(S.rereference(day, ["recording_id", "day"]).select("row_id", "v"))


@query(
    "named_reference",
    f"""WITH {SIGNAL} SELECT row_id, round(v - avg(v) FILTER (ch IN ('view', 'click'))
  OVER (PARTITION BY recording_id, floor(ts / 86400)), 6) AS v FROM s""",
)
def named_reference(spark, sf):
    day = signal(spark, sf).withColumn("day", F.floor(F.col("ts") / 86400))
    return rounded(S.rereference(day, ["recording_id", "day"], [" View", "CLICK "]).select("row_id", "v"))


@query(
    "zscore_epochs",
    f"""WITH {SIGNAL} SELECT row_id, round(least(greatest((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-8), -15), 15), 6) AS v
FROM s WINDOW w AS (PARTITION BY recording_id, ch, floor(ts / 604800))""",
)
def zscore_epochs(spark, sf):
    week = signal(spark, sf).withColumn("week", F.floor(F.col("ts") / 604800))
    return rounded(S.zscore_epochs(week, ["recording_id", "ch", "week"]).select("row_id", "v"))


@query(
    "frozen_scaler",
    f"""WITH {SIGNAL}, c AS (SELECT ch, avg(v) AS mu, stddev_pop(v) + 1e-8 AS sigma FROM s GROUP BY ch)
SELECT row_id, ch, round(least(greatest((v - mu) / sigma, -15), 15), 6) AS v FROM s JOIN c USING (ch)""",
)
def frozen_scaler(spark, sf):
    s = signal(spark, sf)
    return rounded(S.apply_scaler(s, S.fit_scaler(s, ["ch"]), ["ch"]).select("row_id", "ch", "v"))


@query(
    "epochs_around_markers",
    f"""WITH {SIGNAL}, {MARKERS},
l AS (SELECT *, lag(ts) OVER (PARTITION BY recording_id ORDER BY row_id) AS prev FROM s),
sp AS (SELECT recording_id, min(ts) AS t0, max(ts) AS t1 FROM s GROUP BY recording_id),
h AS (SELECT m.code, m.recording_id, m.onset, l.ts, l.v, CASE WHEN l.prev >= onset - 3600 THEN l.ts - l.prev END AS gap
  FROM m JOIN l ON l.recording_id = m.recording_id AND l.ts >= onset - 3600 AND l.ts < onset + 86400),
g AS (SELECT code, count(*) AS n, avg(v) AS mean_v, max(gap) AS max_gap FROM h GROUP BY code)
SELECT recording_id, m.code, round(onset, 6) AS onset, coalesce(n, 0) AS n_samples, round(mean_v, 6) AS mean_v,
  round(max_gap, 6) AS max_gap, CASE WHEN t1 < onset + 86400 THEN 'not_ready' WHEN t0 > onset - 3600 THEN 'aged_out'
  WHEN n IS NULL THEN 'empty' WHEN max_gap > 43200 THEN 'dropout' ELSE 'ok' END AS status
FROM m LEFT JOIN g USING (code) LEFT JOIN sp USING (recording_id)""",
)
def epochs_around_markers(spark, sf):
    return rounded(S.epoch_summary(signal(spark, sf), markers(spark, sf), -HOUR, 24 * HOUR, max_gap=12 * HOUR))


@query(
    "epoch_values",
    f"""WITH {SIGNAL}, {MARKERS}
SELECT m.recording_id, m.code, s.ch, count(*) AS n, round(sum(s.v), 6) AS total, round(arg_min(s.v, s.row_id), 6) AS first_v,
  round(arg_max(s.v, s.row_id), 6) AS last_v
FROM m JOIN s ON s.recording_id = m.recording_id AND s.ts >= onset - 3600 AND s.ts < onset + 86400 GROUP BY ALL""",
)
def epoch_values(spark, sf):
    x = S.epoch_matrix(signal(spark, sf), markers(spark, sf), -HOUR, 24 * HOUR)
    return rounded(
        x.select(
            "recording_id",
            "code",
            "ch",
            F.size("x").alias("n"),
            F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"),
            F.col("x")[0].alias("first_v"),
            F.element_at("x", -1).alias("last_v"),
        )
    )


@query(
    "running_hit_rate",
    f"""WITH {SIGNAL},
r AS (SELECT row_id, count(*) OVER w AS n_trials, sum(CASE WHEN ch = 'purchase' THEN 1 ELSE 0 END) OVER w AS hits
  FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY row_id ROWS UNBOUNDED PRECEDING))
SELECT row_id, n_trials, hits::BIGINT AS hits, round(hits / n_trials, 6) AS rate FROM r""",
)
def running_hit_rate(spark, sf):
    out = S.running_rate(signal(spark, sf), ["recording_id"], "row_id", (F.col("ch") == "purchase").cast("int"))
    return rounded(out.select("row_id", "n_trials", "hits", "rate"))


@query(
    "window_estimate",
    """WITH h AS (SELECT user_id, count(*) AS n_times, 4.0 AS sfreq FROM events GROUP BY user_id)
SELECT count(*) AS n_recordings, sum(floor(floor(n_times * 3.0 / sfreq) / 5))::BIGINT AS n_windows,
  round(sum(n_times / sfreq), 6) AS seconds FROM h""",
)
def window_estimate(spark, sf):
    headers = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n_times"), F.lit(4.0).alias("sfreq"))
    return rounded(S.estimate_windows(headers, 5, 3.0))


@query(
    "channel_histogram",
    f"""WITH {SIGNAL} SELECT ch, bin, round(bin * 20.0, 6) AS left_edge, (SELECT count(*) FROM s WHERE s.ch = c.ch AND v BETWEEN 0 AND 200
  AND least(floor(v / 20), 9) = bin) AS n FROM (SELECT DISTINCT ch FROM s) c, range(0, 10) AS t(bin)""",
)
def channel_histogram(spark, sf):
    return rounded(M.histogram(signal(spark, sf), "v", 0.0, 200.0, 10, ["ch"]))


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf):
    return M.value_counts(table(spark, sf, "events"), "event_type")
