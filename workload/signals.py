"""Windows, spectra, filters and tokens on event series; streams over the event table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strataframe.operators import pooling as P, segment as S, signal as G
from strataframe.session import checkpoint
from strataframe.streaming import epochs as SE, sinks

from .registry import query, rounded
from .sequences import MARKERS, SIGNAL, markers, signal

WIN = 32
RATE = 64.0


def windows(spark, sf):
    """Series of each user cut into windows of 32 values; the window is the epoch, the user the recording."""
    indexed = S.index_samples(signal(spark, sf), ["recording_id"], ["row_id"])
    return S.fixed_windows(indexed, ["recording_id"], WIN).withColumn("ch", F.lit("v"))


WINDOWS = f"""{SIGNAL},
i AS (SELECT recording_id, v, row_number() OVER (PARTITION BY recording_id ORDER BY row_id) - 1 AS k FROM s),
n AS (SELECT recording_id, k // {WIN} AS epoch FROM i GROUP BY ALL HAVING count(*) = {WIN}),
w AS (SELECT i.recording_id, n.epoch, k % {WIN} AS t, v FROM i JOIN n ON n.recording_id = i.recording_id AND n.epoch = i.k // {WIN})"""

PSD = f"""{WINDOWS},
c AS (SELECT recording_id, epoch, t, (v - avg(v) OVER (PARTITION BY recording_id, epoch)) * (0.5 - 0.5 * cos(2 * {math.pi!r} * t / {WIN})) AS y FROM w),
d AS (SELECT recording_id, epoch, bin, sum(y * cos(2 * {math.pi!r} * bin * t / {WIN})) AS re, sum(y * sin(2 * {math.pi!r} * bin * t / {WIN})) AS im
  FROM c, range(0, {WIN // 2 + 1}) AS b(bin) GROUP BY ALL),
ww AS (SELECT sum((0.5 - 0.5 * cos(2 * {math.pi!r} * t / {WIN})) ** 2) AS ww FROM range(0, {WIN}) AS b(t)),
p AS (SELECT recording_id, bin, bin * {RATE} / {WIN} AS freq,
  avg((re * re + im * im) / ({RATE} * ww) * CASE WHEN bin IN (0, {WIN // 2}) THEN 1 ELSE 2 END) AS psd FROM d, ww GROUP BY recording_id, bin)"""


@query("window_arrays", f"WITH {WINDOWS} SELECT recording_id, epoch, t, round(v, 6) AS v FROM w")
def window_arrays(spark, sf):
    return rounded(windows(spark, sf).select("recording_id", "epoch", F.posexplode("x").alias("t", "v")))


@query("welch_psd", f"WITH {PSD} SELECT recording_id, bin, round(freq, 6) AS freq, round(psd, 6) AS psd FROM p")
def welch_psd(spark, sf):
    return rounded(G.welch_psd(windows(spark, sf), RATE, ["recording_id"]))


FIT = f"""{PSD},
lg AS (SELECT recording_id, freq, log10(freq) AS f, log10(psd) AS p FROM p WHERE freq BETWEEN 2 AND 30),
l1 AS (SELECT recording_id, regr_slope(p, f) AS a, regr_intercept(p, f) AS b FROM lg GROUP BY recording_id),
fl AS (SELECT lg.*, greatest(p - (b + a * f), 0) AS flat FROM lg JOIN l1 USING (recording_id)),
ct AS (SELECT recording_id, quantile_cont(flat, 0.025) AS cut FROM fl GROUP BY recording_id),
l2 AS (SELECT recording_id, regr_slope(p, f) AS a, regr_intercept(p, f) AS b FROM fl JOIN ct USING (recording_id) WHERE flat <= cut GROUP BY recording_id),
ft AS (SELECT recording_id, any_value(b) AS b, -any_value(a) AS chi, corr(p, b + a * f) ** 2 AS r2 FROM lg JOIN l2 USING (recording_id) GROUP BY recording_id)"""


@query("aperiodic_fit", f"WITH {FIT} SELECT recording_id, round(b, 5) AS b, round(chi, 5) AS chi, round(r2, 5) AS r2 FROM ft")
def aperiodic_fit(spark, sf):
    psd = G.welch_psd(windows(spark, sf), RATE, ["recording_id"])
    return rounded(G.aperiodic_fit(psd, ["recording_id"], (2.0, 30.0)), 5)


PEAKS = f"""{FIT},
r AS (SELECT lg.recording_id, freq, p - (b - chi * f) AS flat FROM lg JOIN ft USING (recording_id)),
m AS (SELECT *, lag(flat) OVER w AS before, lead(flat) OVER w AS after FROM r WINDOW w AS (PARTITION BY recording_id ORDER BY freq)),
k AS (SELECT recording_id, freq AS cf, flat AS amp FROM m WHERE flat > before AND flat >= after AND flat >= 0.1),
h AS (SELECT k.recording_id, cf, amp, min(abs(freq - cf)) FILTER (flat <= amp / 2) AS half FROM k JOIN r USING (recording_id) GROUP BY ALL),
q AS (SELECT *, least(greatest(2 * coalesce(half, 6), 1), 12) AS bw, row_number() OVER (PARTITION BY recording_id ORDER BY amp DESC, cf) AS peak FROM h)"""


@query(
    "spectral_peaks",
    f"""WITH {PEAKS}
SELECT recording_id, peak, round(cf, 5) AS cf, round(amp, 5) AS amp, round(bw, 5) AS bw FROM q WHERE peak <= 6""",
)
def spectral_peaks(spark, sf):
    psd = G.welch_psd(windows(spark, sf), RATE, ["recording_id"])
    fit = G.aperiodic_fit(psd, ["recording_id"], (2.0, 30.0))
    return rounded(G.spectral_peaks(psd, fit, ["recording_id"], (2.0, 30.0)), 5)


@query(
    "representative_recording",
    f"WITH {FIT} SELECT recording_id, round(r2, 5) AS r2, round(b, 5) AS b, round(chi, 5) AS chi FROM ft ORDER BY ft.r2 DESC, recording_id LIMIT 1",
)
def representative_recording(spark, sf):
    psd = G.welch_psd(windows(spark, sf), RATE, ["recording_id"])
    return rounded(G.representative_recording(G.aperiodic_fit(psd, ["recording_id"], (2.0, 30.0))), 5)


# Plain sums over the bins of each window; a bin's factor is that of the line and the peaks of its recording.
ABLATED = f"""{PEAKS},
bins AS (SELECT bin, bin * {RATE} / {WIN} AS freq, CASE WHEN bin IN (0, {WIN // 2}) THEN 1 ELSE 2 END AS times FROM range(0, {WIN // 2 + 1}) AS b(bin)),
x AS (SELECT recording_id, epoch, bin, any_value(freq) AS freq, any_value(times) AS times,
  sum(v * cos(2 * {math.pi!r} * bin * t / {WIN})) AS re, sum(v * sin(2 * {math.pi!r} * bin * t / {WIN})) AS im FROM w, bins GROUP BY recording_id, epoch, bin),
e AS (SELECT recording_id, bin, b - chi * log10(greatest(freq, 2)) AS line, coalesce((SELECT sum(pow(10, amp * exp(-2 * ((freq - cf) / bw) ** 2)) - 1)
  FROM q WHERE q.recording_id = ft.recording_id AND peak <= 6), 0) AS rise FROM ft, bins),
ga AS (SELECT x.*, CASE WHEN line IS NULL THEN 1 ELSE sqrt(greatest((1 - CASE WHEN re * re + im * im > 0
  THEN pow(10, line) * rise / ((re * re + im * im) / {WIN}) ELSE 1 END) * pow(10, -greatest(line, -16)), 0)) END AS gain FROM x LEFT JOIN e USING (recording_id, bin))"""


@query(
    "spectral_ablation",
    f"""WITH {ABLATED}
SELECT recording_id, epoch, t, round(sum(times * gain * (re * cos(2 * {math.pi!r} * bin * t / {WIN}) + im * sin(2 * {math.pi!r} * bin * t / {WIN}))) / {WIN}, 4) AS v
FROM ga, range(0, {WIN}) AS b(t) GROUP BY recording_id, epoch, t""",
)
def spectral_ablation(spark, sf):
    w = windows(spark, sf)
    psd = checkpoint(G.welch_psd(w, RATE, ["recording_id"]))
    fit = G.aperiodic_fit(psd, ["recording_id"], (2.0, 30.0))
    peaks = G.spectral_peaks(psd, fit, ["recording_id"], (2.0, 30.0))
    out = G.spectral_ablate(w, RATE, "both_removed", ["recording_id"], fit, peaks, (2.0, 30.0))
    return rounded(out.select("recording_id", "epoch", F.posexplode("x").alias("t", "v")), 4)


UP, DOWN = 3, 4
REACH = 10 * max(UP, DOWN)


@query(
    "resampled_windows",
    f"""WITH {WINDOWS},
ks AS (SELECT l, CASE WHEN l = 0 THEN 1 ELSE sin({math.pi!r} * l / {max(UP, DOWN)}) / ({math.pi!r} * l / {max(UP, DOWN)}) END
  * (SELECT sum(pow(6.25 * (1 - (l / {REACH}.0) ** 2), k) / pow(factorial(k::INT)::DOUBLE, 2)) FROM range(0, 31) AS s(k)) AS h FROM range({-REACH}, {REACH + 1}) AS b(l)),
kn AS (SELECT l, {UP} * h / sum(h) OVER () AS h FROM ks)
SELECT recording_id, epoch, m AS t, round(sum(v * h), 6) AS v FROM w, range(0, {-(-WIN * UP // DOWN)}) AS b(m), kn
WHERE l = {DOWN} * m - {UP} * w.t GROUP BY recording_id, epoch, m""",
)
def resampled_windows(spark, sf):
    out = G.resample(windows(spark, sf), RATE, RATE * UP / DOWN)
    return rounded(out.select("recording_id", "epoch", F.posexplode("x").alias("t", "v")))


HIGH, LOW, LINE, LONG = 0.5, 28.0, 20.0, 3 * WIN - 2


def _edge(freq) -> str:
    return f"tan(pi() * {freq} / {RATE})"


# The response of the filters as a kernel over the window with its odd reflections, which is cyclic.
FILTERED = f"""{WINDOWS},
gs AS (SELECT bin, freq, {_edge(f"least(freq, {RATE / 2 * (1 - 1e-9)!r})")} AS warped, cos(2 * pi() * freq / {RATE}) - cos(2 * pi() * {LINE} / {RATE}) AS off_,
  tan(pi() * {LINE} / 30 / {RATE}) * sin(2 * pi() * freq / {RATE}) AS across FROM (SELECT bin, bin * {RATE} / {LONG} AS freq FROM range(1, {LONG // 2 + 1}) AS b(bin))),
gf AS (SELECT bin, CASE WHEN bin = {LONG // 2} THEN 1 ELSE 2 END / (1 + pow((warped * warped - {_edge(HIGH)} * {_edge(LOW)}) / (warped * ({_edge(LOW)} - {_edge(HIGH)})), 8))
  * off_ * off_ / (off_ * off_ + across * across) AS g FROM gs),
kl AS (SELECT lag_, sum(g * cos(2 * pi() * bin * lag_ / {LONG})) / {LONG} AS h FROM gf, range(0, {LONG}) AS b(lag_) GROUP BY lag_),
ends AS (SELECT recording_id, epoch, max(v) FILTER (t = 0) AS a, max(v) FILTER (t = {WIN - 1}) AS z FROM w GROUP BY recording_id, epoch),
lw AS (SELECT recording_id, epoch, t + {WIN - 1} AS j, v FROM w
  UNION ALL SELECT recording_id, epoch, {WIN - 1} - t, 2 * a - v FROM w JOIN ends USING (recording_id, epoch) WHERE t > 0
  UNION ALL SELECT recording_id, epoch, {3 * WIN - 3} - t, 2 * z - v FROM w JOIN ends USING (recording_id, epoch) WHERE t < {WIN - 1})"""


@query(
    "filtered_windows",
    f"""WITH {FILTERED}
SELECT recording_id, epoch, b.t, round(sum(v * h), 6) AS v FROM lw, range(0, {WIN}) AS b(t), kl
WHERE lag_ = (b.t + {WIN - 1} - j + {LONG}) % {LONG} GROUP BY recording_id, epoch, b.t""",
)
def filtered_windows(spark, sf):
    out = G.clean(windows(spark, sf), G.FilterPlan(RATE, highpass=HIGH, lowpass=LOW, notch=LINE))
    return rounded(out.select("recording_id", "epoch", F.posexplode("x").alias("t", "v")))


@query(
    "zscored_windows",
    f"""WITH {WINDOWS} SELECT recording_id, epoch, t, round(least(greatest((v - avg(v) OVER k) / (stddev_pop(v) OVER k + 1e-8), -15), 15), 6) AS v
FROM w WINDOW k AS (PARTITION BY recording_id, epoch)""",
)
def zscored_windows(spark, sf):
    return rounded(S.zscore_arrays(windows(spark, sf)).select("recording_id", "epoch", F.posexplode("x").alias("t", "v")))


@query(
    "frozen_window_scaler",
    f"""WITH {WINDOWS}, c AS (SELECT recording_id, avg(v) AS mu, stddev_pop(v) + 1e-8 AS sigma FROM w GROUP BY recording_id)
SELECT recording_id, epoch, t, round(least(greatest((v - mu) / sigma, -15), 15), 6) AS v FROM w JOIN c USING (recording_id)""",
)
def frozen_window_scaler(spark, sf):
    w = windows(spark, sf)
    out = S.apply_epoch_scaler(w, S.fit_epoch_scaler(w, ["recording_id"]), ["recording_id"])
    return rounded(out.select("recording_id", "epoch", F.posexplode("x").alias("t", "v")))


@query(
    "window_average_reference",
    f"""WITH {WINDOWS} SELECT recording_id, epoch, t, round(v - avg(v) OVER (PARTITION BY epoch, t), 6) AS v FROM w""",
)
def window_average_reference(spark, sf):
    # recordings of one window number stand for the channels of an epoch
    out = G.rereference_arrays(windows(spark, sf), ["epoch"])
    return rounded(out.select("recording_id", "epoch", F.posexplode("x").alias("t", "v")))


@query(
    "window_tokens",
    f"""WITH {WINDOWS} SELECT recording_id, epoch, t // 8 AS t_coarse, recording_id * 4 + t // 8 AS token, round(sum(v), 6) AS total FROM w GROUP BY ALL""",
)
def window_tokens(spark, sf):
    tokens = P.tokenize(windows(spark, sf).withColumn("ch_pos", F.col("recording_id")), fine=8)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total")
    return rounded(tokens.select("recording_id", "epoch", "t_coarse", "token", total))


# ---- streams ------------------------------------------------------------------------------------------------------------


def _live(spark, sf):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("recording_id"),
        F.col("event_type").alias("ch"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("v"),
    )


@query(
    "stream_frozen_scaler",
    f"""WITH {SIGNAL}, c AS (SELECT ch, avg(v) AS mu, stddev_pop(v) + 1e-8 AS sigma FROM s GROUP BY ch)
SELECT row_id, ch, round(least(greatest((v - mu) / sigma, -15), 15), 6) AS v FROM s JOIN c USING (ch)""",
)
def stream_frozen_scaler(spark, sf):
    scaler = S.fit_scaler(signal(spark, sf), ["ch"])
    out = sinks.run_to_files(S.apply_scaler(_live(spark, sf), scaler, ["ch"]).select("row_id", "ch", "v"), "scaler")
    return rounded(out)


def _purchases(rows):
    return rows.where(F.col("ch") == "purchase").select(F.col("row_id").alias("code"), "recording_id", F.col("ts").alias("onset"))


def _stored(spark, sf):
    return signal(spark, sf).withColumn("ts", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("bigint")))


STREAMED = f"""{SIGNAL}, {MARKERS},
l AS (SELECT *, lag(ts) OVER (PARTITION BY recording_id ORDER BY ts, row_id) AS prev,
  lag(ts) OVER (PARTITION BY recording_id ORDER BY row_id) AS prev_row FROM s),
sp AS (SELECT recording_id, min(ts) AS t0, max(ts) AS t1 FROM s GROUP BY recording_id),
h AS (SELECT m.code, m.recording_id, m.onset, l.ts, l.v, CASE WHEN l.prev >= onset - 3600 THEN l.ts - l.prev END AS gap,
  CASE WHEN l.prev_row >= onset - 3600 AND l.prev_row < onset + 86400 THEN l.ts - l.prev_row END AS row_gap
  FROM m JOIN l ON l.recording_id = m.recording_id AND l.ts >= onset - 3600 AND l.ts < onset + 86400),
g AS (SELECT code, count(*) AS n, avg(v) AS mean_v, max(gap) AS max_gap, max(row_gap) AS row_gap FROM h GROUP BY code)"""


@query(
    "stream_joined_epochs",
    f"""WITH {STREAMED}
SELECT recording_id, m.code, round(onset, 6) AS onset, coalesce(n, 0) AS n_samples, round(mean_v, 6) AS mean_v,
  round(row_gap, 6) AS max_gap, CASE WHEN n IS NULL THEN 'empty' WHEN row_gap > 43200 THEN 'dropout' ELSE 'ok' END AS status
FROM m LEFT JOIN g USING (code)""",
)
def stream_joined_epochs(spark, sf):
    def rows(samples, marks):
        return SE.epoch_rows(SE.join_epochs(samples, marks, -3600.0, 24 * 3600.0, "1 hour"), 12 * 3600.0).drop("samples")

    done = sinks.run_to_files(rows(_live(spark, sf), _purchases(_live(spark, sf))), "joined")
    stored = _stored(spark, sf)
    closed = SE.close_run(done, _purchases(stored), lambda left: rows(stored, left))
    return rounded(closed.withColumn("onset", F.unix_micros("onset") / 1e6))


@query(
    "stream_assembled_epochs",
    f"""WITH {STREAMED}
SELECT recording_id, m.code, round(onset, 6) AS onset, coalesce(n, 0) AS n_samples, round(max_gap, 6) AS max_gap,
  CASE WHEN t1 < onset + 86400 THEN 'not_ready' WHEN t0 > onset - 3600 THEN 'aged_out'
  WHEN n IS NULL THEN 'empty' WHEN max_gap > 43200 THEN 'dropout' ELSE 'ok' END AS status
FROM m LEFT JOIN g USING (code) LEFT JOIN sp USING (recording_id)""",
)
def stream_assembled_epochs(spark, sf):
    live = _live(spark, sf)
    out = SE.assemble_epochs(live, _purchases(_live(spark, sf)), -3600.0, 24 * 3600.0, retention=72 * 3600.0, max_gap=12 * 3600.0, delay="1 hour")
    done = sinks.run_to_files(out.drop("ch", "t", "v"), "assembled")
    samples = signal(spark, sf)
    return rounded(SE.close_run(done, markers(spark, sf), lambda left: S.epoch_summary(samples, left, -3600.0, 24 * 3600.0, max_gap=12 * 3600.0)))


@query(
    "stream_selected_channels",
    f"""WITH {SIGNAL}, w(pos, u, ch) AS (VALUES (0, 'VIEW', 'View'), (1, 'PURCHASE', 'Purchase'))
SELECT s.row_id, pos, w.ch, round(s.v, 6) AS v FROM s JOIN w ON upper(trim(s.ch)) = w.u""",
)
def stream_selected_channels(spark, sf):
    header = signal(spark, sf).select("ch").distinct()
    live = S.select_channels(_live(spark, sf), ["View", "Purchase"], header=header)
    return rounded(sinks.run_to_files(live.select("row_id", "pos", "ch", "v"), "selected"))


@query(
    "stream_running_rate",
    """SELECT count(*) AS n_trials, round(avg((event_type = 'purchase')::INT), 6) AS rate FROM events""",
)
def stream_running_rate(spark, sf):
    live = _live(spark, sf).agg(F.count(F.lit(1)).alias("n_trials"), F.avg((F.col("ch") == "purchase").cast("double")).alias("rate"))
    return rounded(sinks.run_to_files(live, "rate", "complete"))
