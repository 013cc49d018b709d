"""Streams against the batch operators on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import ridge, segment
from strataframe.streaming import decode, epochs as S, sinks


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def write_stream(spark, tmp_path, samples, markers, tail=None):
    s, m = str(tmp_path / "s"), str(tmp_path / "m")
    samples.repartition(1).write.parquet(s)
    markers.repartition(1).write.parquet(m)
    if tail is not None:
        # a later file on each side moves the watermark past every window
        tail[0].repartition(1).write.mode("append").parquet(s)
        tail[1].repartition(1).write.mode("append").parquet(m)
    return S.read_stream(spark, s, S.SAMPLES, 1), S.read_stream(spark, m, S.MARKERS, 1)


def ramp(n, start=0.0, rate=100.0, rec=1, gap_at=None, gap=0.5):
    t = start + np.arange(n) / rate
    if gap_at is not None:
        t = np.where(t >= gap_at, t + gap, t)
    return [(i, rec, "c", float(x), float(i)) for i, x in enumerate(t)]


def frames(spark, samples, markers):
    s = spark.createDataFrame(samples, "row_id long, recording_id long, ch string, t double, v double")
    m = spark.createDataFrame(markers, "code long, recording_id long, o double")
    ts = lambda c: F.timestamp_micros((F.col(c) * 1e6).cast("bigint"))
    return (
        s.select("row_id", "recording_id", "ch", ts("t").alias("ts"), "v"),
        m.select("code", "recording_id", ts("o").alias("onset")),
    )


def test_join_epochs_equals_batch(spark, tmp_path):
    samples, markers = frames(spark, ramp(400), [(7, 1, 0.5), (3, 1, 1.0), (0, 1, 1.5), (9, 1, 20.0)])
    late = frames(spark, [(9000, 2, "c", 90000.0, 0.0)], [(99, 2, 90000.0)])
    s, m = write_stream(spark, tmp_path, samples, markers, late)
    out = run(spark, S.epoch_rows(S.join_epochs(s, m, -0.2, 1.0, "1 second")), "joined").where("recording_id = 1")
    got = {r["code"]: (r["n_samples"], r["mean_v"], r["status"]) for r in out.collect()}
    batch = S.epoch_rows(S.join_epochs(samples, markers, -0.2, 1.0))
    want = {r["code"]: (r["n_samples"], r["mean_v"], r["status"]) for r in batch.collect()}
    assert got == want
    assert got[7][0] == 120 and got[3][0] == 120 and 0 not in got
    assert got[9] == (0, None, "empty")


def test_epoch_is_half_open_and_in_order(spark):
    samples, markers = frames(spark, ramp(200), [(7, 1, 0.5)])
    row = S.epoch_rows(S.join_epochs(samples, markers, 0.0, 1.0)).first()
    assert row["n_samples"] == 100
    assert [s["v"] for s in row["samples"]] == [float(i) for i in range(50, 150)]


def test_assembler_statuses(spark, tmp_path):
    samples = ramp(400, 100.0) + ramp(300, 100.0, rec=2, gap_at=101.2) + ramp(100, 100.0, rec=3)
    marks = [(7, 1, 100.5), (8, 1, 102.0), (5, 1, 97.0), (4, 2, 101.0), (6, 3, 100.9)]
    s, m = frames(spark, samples, marks)
    tail = frames(spark, [(9000, 9, "c", 90000.0, 0.0)], [(99, 9, 90000.0)])
    last = frames(spark, [(9001, 9, "c", 91000.0, 0.0)], [(98, 9, 91000.0)])
    ss, mm = write_stream(spark, tmp_path, s, m, tail)
    last[0].repartition(1).write.mode("append").parquet(str(tmp_path / "s"))
    out = run(spark, S.assemble_epochs(ss, mm, 0.0, 1.0, retention=30.0, max_gap=0.1), "assembled")
    got = {r["code"]: (r["status"], r["n_samples"], len(r["v"])) for r in out.collect()}
    assert got[7] == ("ok", 100, 100) and got[8] == ("ok", 100, 100)
    assert got[5][0] == "aged_out"
    assert got[4][0] == "dropout"
    assert got[6][0] == "not_ready"


def test_scaler_on_stream_equals_batch(spark, tmp_path):
    samples, markers = frames(spark, ramp(300), [(1, 1, 0.0)])
    scaler = segment.fit_scaler(samples, ["ch"])
    s, _ = write_stream(spark, tmp_path, samples, markers)
    live = run(spark, segment.apply_scaler(s, scaler, ["ch"]), "scaled")
    a = [r["v"] for r in live.orderBy("row_id").collect()]
    b = [r["v"] for r in segment.apply_scaler(samples, scaler, ["ch"]).orderBy("row_id").collect()]
    assert a == b


@pytest.fixture(scope="module")
def trials():
    rng = np.random.default_rng(0)
    templates = rng.normal(size=(6, 4, 40))
    emb = rng.normal(size=(6, 8))
    rows = []
    for code in range(1, 7):
        for rep in range(10):
            for ch in range(4):
                x = templates[code - 1, ch] + 0.05 * rng.normal(size=40)
                rows.append((code * 100 + rep, code, f"c{ch}", [float(v) for v in x]))
    for ch in range(4):
        rows.append((99900, 999, f"c{ch}", [0.0] * 40))
    gallery = [(c, [float(v) for v in emb[c - 1]]) for c in range(1, 7)]
    return rows, gallery


def test_calibrate_decode_and_replay(spark, tmp_path, trials):
    rows, gallery = trials
    t = spark.createDataFrame(rows, "trial long, code long, ch string, x array<double>")
    g = spark.createDataFrame(gallery, "id long, emb array<double>")
    train, test = t.where("trial % 100 < 7"), t.where("trial % 100 >= 7 and code <> 999")
    scaler, model, report = decode.calibrate(train, g, alpha=1.0)
    assert report.first().asDict() == {"n_trials": 43, "n_fit_samples": 6, "n_images": 6, "mean_trials_per_image": 7.0}
    feats = decode.concat_channels(segment.apply_epoch_scaler(test, scaler, ["ch"]))
    batch = decode.running_accuracy(decode.decode_stream(feats, model, g, (1, 3)), (1, 3)).first()
    assert batch["n_trials"] == 18 and batch["top1"] >= 0.7 and batch["top3"] >= batch["top1"]
    saved = ridge.ridge_from_table(ridge.ridge_table(spark, model))
    assert np.allclose(saved.weights, model.weights)
    path = str(tmp_path / "replay")
    decode.write_replay(feats, path, seed=1, per_file=6)
    stored = spark.read.parquet(path)
    assert sorted(r["onset_ts"] for r in stored.collect()) == pytest.approx([1.2 * i for i in range(18)])
    live = decode.running_accuracy(decode.decode_stream(decode.read_replay(spark, path), saved, g, (1, 3)), (1, 3))
    final = run(spark, live, "accuracy", "complete").collect()[0]
    assert final["n_trials"] == 18 and final["top1"] == pytest.approx(batch["top1"])


def test_join_has_one_null_row_for_an_empty_marker_and_none_for_others(spark):
    samples, markers = frames(spark, [(1, 1, "c", 10.05, 1.0)], [(7, 1, 10.0), (8, 1, 50.0)])
    rows = {c: [r["row_id"] for r in S.join_epochs(samples, markers, -0.2, 1.0).where(f"code = {c}").collect()] for c in (7, 8)}
    assert rows == {7: [1], 8: [None]}


@pytest.mark.parametrize("files", [1, 3, 10])
def test_assembled_epochs_do_not_depend_on_how_the_input_is_cut(spark, tmp_path, files):
    """Samples out of order within the delay count in whichever batch they come."""
    rng = np.random.default_rng(5)
    rows = ramp(300, rate=10.0)
    jittered = sorted(rows, key=lambda r: r[3] + rng.uniform(0, 3))
    size = -(-len(rows) // files)
    marks = [(7, 1, 5.0), (8, 1, 12.5), (9, 1, 29.5), (3, 1, 0.0)]
    s, m = str(tmp_path / "s"), str(tmp_path / "m")
    for i in range(files):
        part, own = frames(spark, jittered[i * size : (i + 1) * size], marks[i::files] or [(0, 1, 1.0)])
        part.repartition(1).write.mode("append").parquet(s)
        own.repartition(1).write.mode("append").parquet(m)
    allowed = "60 seconds"
    live = S.assemble_epochs(S.read_stream(spark, s, S.SAMPLES, 1), S.read_stream(spark, m, S.MARKERS, 1), -0.5, 1.0, delay=allowed)
    done = sinks.run_to_files(live.drop("ch", "t", "v"), f"cut{files}")
    _, stored = frames(spark, rows, marks)
    seconds = spark.createDataFrame(rows, "row_id long, recording_id long, ch string, ts double, v double")
    tail = lambda left: segment.epoch_summary(seconds, left, -0.5, 1.0, max_gap=0.15)
    whole = S.close_run(done, stored.withColumn("onset", F.unix_micros("onset") / 1e6), tail)
    got = {r["code"]: (r["n_samples"], r["status"]) for r in whole.collect()}
    assert got == {7: (15, "ok"), 8: (15, "ok"), 9: (10, "not_ready"), 3: (10, "aged_out")}


def test_repeated_markers_and_buckets_of_any_width(spark, tmp_path):
    samples, markers = frames(spark, ramp(400, 100.0), [(7, 1, 100.5), (7, 1, 100.5), (8, 1, 102.0)])
    late = frames(spark, [(9000, 2, "c", 90000.0, 0.0)], [(99, 2, 90000.0)])
    seen = []
    for i, width in enumerate((0.01, 0.7, 1000.0)):
        (tmp_path / str(i)).mkdir()
        s, m = write_stream(spark, tmp_path / str(i), samples, markers, late)
        live = S.assemble_epochs(s, m, -0.2, 1.0, retention=30.0, bucket=width)
        out = sinks.run_to_files(live, f"width{i}").where("recording_id = 1").orderBy("onset", "code")
        seen.append([(r.code, r.status, r.n_samples, tuple(r.v)) for r in out.collect()])
    assert seen[0] == seen[1] == seen[2] and [x[:3] for x in seen[0]] == [(7, "ok", 120)] * 2 + [(8, "ok", 120)]
    assert seen[0][0][3] == tuple(float(i) for i in range(30, 150))


def test_close_run_counts_equal_markers(spark):
    _, markers = frames(spark, [], [(7, 1, 1.0), (7, 1, 1.0), (8, 1, 2.0)])
    marks = markers.withColumn("onset", F.unix_micros("onset") / 1e6)
    done = marks.where("code = 7").limit(1).withColumn("status", F.lit("ok"))
    closed = S.close_run(done, marks, lambda left: left.withColumn("status", F.lit("late")))
    assert sorted((r.code, r.status) for r in closed.collect()) == [(7, "late"), (7, "ok"), (8, "late")]


def test_update_sink_merges_by_key(spark, tmp_path):
    for key, v in ((1, 1.0), (2, 5.0), (1, 2.0)):
        spark.createDataFrame([(key, v)], "k long, v double").repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = S.read_stream(spark, str(tmp_path / "in"), "k long, v double", 1).groupBy("k").agg(F.sum("v").alias("total"))
    assert {r["k"]: r["total"] for r in sinks.run_to_files(live, "merged", "update", keys=["k"]).collect()} == {1: 3.0, 2: 5.0}
    with pytest.raises(ValueError, match="keys"):
        sinks.run_to_files(live, "merged", "update")


def gallery_and_model(spark, path, width=6, n=12):
    rng = np.random.default_rng(2)
    g = [(i, [float(v) for v in rng.normal(size=width)]) for i in range(n)]
    model = ridge.RidgeMap(np.zeros(width), np.ones(width), np.zeros(width), np.eye(width))
    ridge.ridge_table(spark, model).coalesce(1).write.parquet(path)
    trials = [(100 + i, i % n, [v + 0.01 for v in g[i % n][1]]) for i in range(30)]
    return spark.createDataFrame(g, "id long, emb array<double>"), spark.createDataFrame(trials, "trial long, code long, x array<double>")


def test_online_decode_stops_at_its_trials_and_goes_on_later(spark, tmp_path):
    g, t = gallery_and_model(spark, str(tmp_path / "model"))
    decode.write_replay(t, str(tmp_path / "replay"), per_file=5)
    live = lambda: decode.read_replay(spark, str(tmp_path / "replay")).select("trial", "code", "x")
    run_ = lambda **o: decode.decode_online(live(), str(tmp_path / "model"), g, str(tmp_path / "out"), (1, 3), **o)
    first = run_(max_trials=8)
    assert first.count() == 8 and first.where("not hit1").count() == 0
    done = run_(trigger=None).orderBy("trial").collect()  # from the stored state; two of the cut batch were not taken
    assert len({r.trial for r in done}) == len(done) == 28 and all(r.top[0] == r.code for r in done)


def test_online_decode_in_tiles_equals_broadcast(spark, tmp_path):
    g, t = gallery_and_model(spark, str(tmp_path / "model"))
    model = ridge.ridge_from_table(spark.read.parquet(str(tmp_path / "model")))
    a, b = (sorted(map(repr, decode.decode_batch(t, model, g, (1, 4), limit).collect())) for limit in (1 << 20, 1))
    assert a == b and len(a) == 30


def test_live_run_stops_when_its_source_dries_up(spark, tmp_path):
    g, t = gallery_and_model(spark, str(tmp_path / "model"))
    decode.write_replay(t, str(tmp_path / "replay"), per_file=10)
    live = decode.read_replay(spark, str(tmp_path / "replay")).select("trial", "code", "x")
    out = decode.decode_online(live, str(tmp_path / "model"), g, str(tmp_path / "out"), (1,), idle=6.0)
    assert out.count() == 30 and not spark.streams.active


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i,) for i in range(6)], "i long")
    sink = sinks.BatchFolders(spark, str(tmp_path / "o"), rows.schema, limit=9, order=["i"])
    sink.write(rows, 0)
    sink.write(rows, 1)
    sink.write(rows, 1)
    again = sinks.BatchFolders(spark, str(tmp_path / "o"), rows.schema, limit=9, order=["i"])
    again.write(rows, 1)
    assert sorted((r.batch, r.i) for r in again.read().collect()) == [(0, i) for i in range(6)] + [(1, i) for i in range(3)]
    assert again.full()


def test_montage_of_assembled_epochs(spark, tmp_path):
    samples = [(2 * i + k, 1, ("Cz", " fp1")[k], 100.0 + i / 100, float(i + 1000 * k)) for i in range(300) for k in range(2)]
    s, m = frames(spark, samples, [(3, 1, 100.0), (4, 1, 90.0)])
    late = frames(spark, [(9000, 2, "c", 90000.0, 0.0)], [(99, 2, 90000.0)])
    ss, mm = write_stream(spark, tmp_path, s, m, late)
    made = S.assemble_epochs(ss, mm, 0.0, 1.0)
    out = {r.code: r for r in sinks.run_to_files(S.montage(made, ["Fp1", "Cz"]), "montage").collect()}
    assert out[3].x == [[1000.0 + i for i in range(100)], [float(i) for i in range(100)]] and out[4].x is None
    with pytest.raises(Exception, match="requested channels not in stream: OZ"):
        sinks.run_to_files(S.montage(made, ["Oz"]), "lacking")


def test_channels_of_a_stream_are_checked_against_its_header(spark, tmp_path):
    samples, markers = frames(spark, [(1, 1, "Cz", 1.0, 0.5), (2, 2, "cz", 1.0, 0.7), (3, 2, "Pz", 1.0, 0.9)], [(1, 1, 1.0)])
    s, _ = write_stream(spark, tmp_path, samples, markers)
    header = spark.createDataFrame([(1, "CZ"), (2, "Cz"), (2, "Pz")], "recording_id long, ch string")
    key = ["recording_id"]
    out = sinks.run_to_files(segment.select_channels(s, ["cz"], key=key, header=header), "picked")
    assert sorted((r.row_id, r.ch, r.pos) for r in out.collect()) == [(1, "cz", 0), (2, "cz", 0)]
    for want, named in ((["Pz"], "PZ"), (["Oz"], "OZ")):
        with pytest.raises(Exception, match=f"not in recording: {named}"):
            sinks.run_to_files(segment.select_channels(s, want, key=key, header=header), "lacking")
    with pytest.raises(Exception, match="no header"):
        sinks.run_to_files(segment.select_channels(s, ["cz"], key=key, header=header.where("recording_id = 1")), "headless")


def test_online_decode_makes_its_gallery_once(spark, tmp_path):
    g, t = gallery_and_model(spark, str(tmp_path / "model"))
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    decode.write_replay(t, str(tmp_path / "replay"), per_file=5)
    live = decode.read_replay(spark, str(tmp_path / "replay")).select("trial", "code", "x")
    done = decode.decode_online(live, str(tmp_path / "model"), g.mapInArrow(counted, g.schema), str(tmp_path / "out"), (1,), trigger=None)
    assert done.where("hit1").count() == 30 and made.value == g.count()


class _Counted(dict):
    """A map state that counts what it is asked for."""

    def __init__(self):
        super().__init__()
        self.asked = 0

    def getValue(self, key):
        self.asked += 1
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return list(self.items())


def test_buffer_asks_the_state_once_for_a_bucket():
    import pandas as pd

    buffer = S.RetentionBuffer(0.0, 1.0, 100.0, None, 0.5)
    buffer.buckets, buffer.pending = _Counted(), _Counted()

    class Handle:
        registerTimer = deleteTimer = staticmethod(lambda at: None)

    class Span:
        held = None
        get = lambda self: self.held
        exists = lambda self: self.held is not None

        def update(self, value):
            self.held = value

    class Now:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at * 1000

    buffer.handle, buffer.span = Handle(), Span()
    t = np.arange(100) / 10
    rows = pd.DataFrame({"t": t, "row_id": np.arange(100.0), "ch": "a", "v": t, "code": np.nan})
    marks = pd.DataFrame({"t": t[:60], "row_id": np.nan, "ch": None, "v": np.nan, "code": np.arange(60.0) + 1})
    assert not list(buffer.handleInputRows((7,), iter([rows, marks]), Now(0)))
    assert buffer.buckets.asked == 0 and buffer.pending.asked == 0  # nothing was there yet
    (out,) = buffer.handleExpiredTimer((7,), Now(50), None)
    assert buffer.buckets.asked <= 20 and len(out) == 60
    assert out["n_samples"].tolist() == [int(((t >= o) & (t < o + 1.0)).sum()) for o in t[:60]] and set(out["status"]) == {"ok"}
