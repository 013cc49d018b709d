import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import pooling as P, segment as S, signal as G

EPOCHS = "recording_id long, epoch long, ch string, x array<double>"


def epochs(spark, x, rec=None):
    """From an array (epochs, channels, samples)."""
    rows = [
        (0 if rec is None else int(rec[e]), e, f"c{c}", [float(v) for v in x[e, c]]) for e in range(x.shape[0]) for c in range(x.shape[1])
    ]
    return spark.createDataFrame(rows, EPOCHS).repartition(3)


def back(df):
    rows = df.orderBy("epoch", "ch").collect()
    chans = len({r["ch"] for r in rows})
    return np.array([r["x"] for r in rows]).reshape(len(rows) // chans, chans, -1)


def test_epoch_zscore(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 4, 200)) * np.array([1, 50, 0.1, 1000])[None, :, None] + 7
    z = back(S.zscore_arrays(epochs(spark, x)))
    assert np.allclose(z.mean(-1), 0, atol=1e-9) and np.allclose(z.std(-1), 1, atol=1e-5)
    x[0, 0, 5] = 1e6
    assert np.abs(back(S.zscore_arrays(epochs(spark, x), clamp=5.0))).max() == 5.0


def test_frozen_scaler_pools_trials_and_keeps_amplitude(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(8, 4, 50)) * np.array([1, 5, 20, 0.5])[None, :, None] + 3
    fit = S.fit_epoch_scaler(epochs(spark, x), ["ch"])
    stats = {r["ch"]: (r["mu"], r["sigma"]) for r in fit.collect()}
    for c in range(4):
        assert stats[f"c{c}"] == pytest.approx((x[:, c].mean(), x[:, c].std() + 1e-8))
    loud = back(S.apply_epoch_scaler(epochs(spark, x * 4), fit, ["ch"]))
    assert loud.std() > 1.5
    spike = x.copy()
    spike[0, 0, 0] = 1000
    assert back(S.apply_epoch_scaler(epochs(spark, spike), fit, ["ch"])).max() == 15.0
    whole = back(S.apply_epoch_scaler(epochs(spark, x), fit, ["ch"]))
    one = back(S.apply_epoch_scaler(epochs(spark, x).where("epoch = 3"), fit, ["ch"]))
    assert np.array_equal(whole[3], one[0])
    with pytest.raises(Exception, match="channel not fitted"):
        S.apply_epoch_scaler(epochs(spark, x).withColumn("ch", F.lit("zz")), fit, ["ch"]).collect()


def test_resample_keeps_tones_and_length(spark):
    t = np.arange(500) / 250
    x = np.stack([np.sin(2 * np.pi * 10 * t), np.cos(2 * np.pi * 4 * t)])[None]
    out = back(G.resample(epochs(spark, x), 250.0, 200.0))
    assert out.shape == (1, 2, 400)
    u = np.arange(400) / 200
    mid = slice(60, 340)
    assert np.abs(out[0, 0, mid] - np.sin(2 * np.pi * 10 * u)[mid]).max() < 0.02
    same = epochs(spark, x)
    assert G.resample(same, 250.2, 249.8) is same


def test_filters_on_tones(spark):
    t = np.arange(1024) / 256
    tones = np.stack([np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 60 * t), np.linspace(-50, 50, 1024) + 5, np.zeros(1024)])[None]
    plan = G.FilterPlan(256.0)
    out = back(G.clean(epochs(spark, tones), plan))[0][:, 256:768]
    rms = np.sqrt((out**2).mean(-1))
    assert rms[0] > 0.6 and rms[1] < 0.15 and rms[2] < 1.0
    assert G.FilterPlan(128.0).lowpass is None and G.FilterPlan(256.0).lowpass == 99.5
    assert len(G.FilterPlan(256.0, harmonics=True).notches) == 2
    assert len(G.FilterPlan(512.0, harmonics=True).notches) == 4
    whole = back(G.clean(epochs(spark, np.concatenate([tones, 2 * tones])), plan))
    assert np.allclose(whole[0], back(G.clean(epochs(spark, tones), plan))[0])


def test_references(spark):
    x = np.random.default_rng(2).normal(size=(2, 4, 30))
    e = epochs(spark, x)
    avg = back(G.rereference_arrays(e, ["recording_id", "epoch"]))
    assert np.allclose(avg.mean(1), 0, atol=1e-12)
    named = back(G.device_clean(e, G.FilterPlan(256.0, None, None, None), [" C1"]))
    assert np.allclose(named, x - x[:, 1:2])


def test_welch_matches_direct_computation(spark):
    x = np.random.default_rng(3).normal(size=(3, 1, 700))
    rows = G.welch_psd(epochs(spark, x), 200.0).orderBy("freq").toPandas()
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(512) / 512)
    want = 0
    for e in x[:, 0]:
        seg = (e[:512] - e[:512].mean()) * w
        want = want + np.abs(np.fft.rfft(seg)) ** 2 / (200 * (w**2).sum()) / 3
    want[1:-1] *= 2
    assert np.allclose(rows.psd, want) and rows.freq.iloc[1] == pytest.approx(200 / 512)
    short = G.welch_psd(epochs(spark, x[:, :, :100]), 200.0, band=(1.0, 45.0)).toPandas()
    assert short.freq.min() >= 1.0 and short.freq.max() <= 45.0


def synthetic_psd(spark, peak=0.6, b=1.0, chi=1.5):
    f = np.arange(1, 101) / 2.0
    p = 10 ** (b - chi * np.log10(f) + peak * np.exp(-((f - 10) ** 2) / (2 * 1.0**2)))
    return spark.createDataFrame([(1, "a", int(2 * v), float(v), float(q)) for v, q in zip(f, p)], "recording_id long, ch string, bin int, freq double, psd double")


def test_aperiodic_fit_and_peak(spark):
    psd = synthetic_psd(spark)
    fit = G.aperiodic_fit(psd)
    r = fit.first()
    assert r["b"] == pytest.approx(1.0, abs=0.1) and r["chi"] == pytest.approx(1.5, abs=0.1) and r["r2"] > 0.9
    peaks = G.spectral_peaks(psd, fit).collect()
    assert peaks[0]["cf"] == pytest.approx(10.0, abs=0.5) and peaks[0]["amp"] == pytest.approx(0.6, abs=0.1)
    zero = psd.withColumn("psd", F.when(F.col("freq") == 5.0, 0.0).otherwise(F.col("psd")))
    assert G.aperiodic_fit(zero).count() == 0


def test_ablation_flattens_and_passes_through(spark):
    rng = np.random.default_rng(4)
    n = 2000
    f = np.fft.rfftfreq(n, 1 / 200)
    shape = np.where(f > 0, np.maximum(f, 0.5) ** -1.0, 0)
    x = np.fft.irfft(shape * (rng.normal(size=(4, 1, n // 2 + 1)) + 1j * rng.normal(size=(4, 1, n // 2 + 1))) * 50, n)
    e = epochs(spark, x)
    out = G.spectral_ablate(e, 200.0, "aperiodic_removed")
    chi = G.aperiodic_fit(G.welch_psd(out, 200.0)).first()["chi"]
    before = G.aperiodic_fit(G.welch_psd(e, 200.0)).first()["chi"]
    assert before > 1.5 and abs(chi) < 0.4
    flat = epochs(spark, np.zeros((2, 1, 600)))
    assert np.array_equal(back(G.spectral_ablate(flat, 200.0)), np.zeros((2, 1, 600)))
    kept = back(G.spectral_ablate(e, 200.0, "periodic_removed"))
    assert np.corrcoef(kept[0, 0], x[0, 0])[0, 1] > 0.9
    with pytest.raises(ValueError, match="unknown mode"):
        G.spectral_ablate(e, 200.0, "none")


def test_representative_recording(spark):
    fit = spark.createDataFrame([(1, "a", 1.0, 1.0, 0.5), (1, "b", 2.0, 1.0, 0.7), (2, "a", 3.0, 2.0, 0.9)], "recording_id long, ch string, b double, chi double, r2 double")
    r = G.representative_recording(fit)
    assert r.first().asDict() == {"recording_id": 2, "r2": 0.9, "b": 3.0, "chi": 2.0}
    psd = spark.createDataFrame([(2, "a", 1, 10.0, 5.0), (1, "a", 1, 10.0, 7.0)], "recording_id long, ch string, bin int, freq double, psd double")
    c = G.fitted_curve(psd, r).first()
    assert c["psd"] == 5.0 and c["fit"] == pytest.approx(1000 / 100)


def test_windows_drop_the_tail_and_tokens_are_channel_major(spark):
    rows = [(r, c, i, float(100 * c + i)) for r in (1, 2) for c in range(2) for i in range(10)]
    s = spark.createDataFrame(rows, "recording_id long, ch long, sample_idx long, v double")
    w = S.fixed_windows(s, ["recording_id", "ch"], 4)
    assert w.count() == 8 and w.where("recording_id = 1 and ch = 1 and epoch = 1").first()["x"] == [104.0, 105.0, 106.0, 107.0]
    tok = P.tokenize(w.where("recording_id = 1 and epoch = 0").withColumn("ch_pos", F.col("ch")), fine=2).orderBy("token").collect()
    assert [t["x"] for t in tok] == [[0.0, 1.0], [2.0, 3.0], [100.0, 101.0], [102.0, 103.0]]
    with pytest.raises(Exception, match="multiple of 3"):
        P.tokenize(w.withColumn("ch_pos", F.col("ch")), fine=3).collect()
    assert P.pad_windows(w, 6).first()["x"][4:] == [0.0, 0.0]


def test_pool_hidden_states(spark):
    df = spark.createDataFrame([(0, [[1.0, 2.0], [3.0, 6.0]])], "row_id long, h array<array<double>>")
    assert P.pool_hidden(df).first()["x"] == [2.0, 4.0]
    deep = spark.createDataFrame([(0, [[[1.0, 2.0]], [[3.0, 6.0]]])], "row_id long, h array<array<array<double>>>")
    assert P.pool_hidden(deep, rank=3).first()["x"] == [2.0, 4.0]


def test_register_tokens_are_dropped(spark):
    # two channels, three steps, groups of four with one register each, two padding tokens at the end
    real = [(0, float(i)) for i in range(6)] + [(0, 99.0)] * 2
    rows, pos = [], 0
    for g in range(2):
        rows.append((0, pos, [-1000.0]))
        pos += 1
        for _, v in real[4 * g : 4 * g + 4]:
            rows.append((0, pos, [v]))
            pos += 1
    df = spark.createDataFrame(rows, "row_id long, pos long, x array<double>")
    out = P.pool_channel_tokens(df, 2, 3).orderBy("channel").collect()
    assert [r["x"] for r in out] == [[1.0], [4.0]]


def test_average_repeats(spark):
    rows = [(i, n, "c0", [float(v)] * 3) for i, (n, v) in enumerate([("b", 2), ("a", 1), ("b", 2), ("a", 1), ("c", 3)])]
    e = spark.createDataFrame(rows, "trial long, image string, ch string, x array<double>")
    out = P.average_repeats(e).orderBy("image").collect()
    assert [(r["image"], r["n_trials"], r["x"][0]) for r in out] == [("a", 2, 1.0), ("b", 2, 2.0), ("c", 1, 3.0)]
