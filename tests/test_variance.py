import numpy as np
import pytest
from helpers import group_ss, planted, table

from strataframe.operators import variance as V


def test_crossed_equals_brute_force_and_ignores_partitioning(spark):
    x, s, y = planted(5, 4, 12, seed=3)
    y = (np.arange(len(y)) % 2).astype(int)
    total = ((x - x.mean(0)) ** 2).sum()
    want = (group_ss(x, y).sum() / total, group_ss(x, s).sum() / total)
    for parts in (1, 7):
        r = V.crossed_ss(table(spark, x, s, y, partitions=parts)).first()
        assert (r["label_frac"], r["subject_frac"]) == pytest.approx(want, abs=1e-10)
        assert (r["n_rows"], r["n_subjects"], r["n_labels"]) == (40, 10, 2)


def test_crossed_overlap_is_flagged(spark):
    x, s, y = planted(4, 3, 6, offset=5.0, sd_noise=0.01)
    r = V.crossed_ss(table(spark, x, s, y)).first()
    assert r["raw_sum_exceeds_one"] and r["residual_frac"] == 0.0


def test_nested_planted_fractions_and_additivity(spark):
    x, s, y = planted()
    nested = V.nested_ss(table(spark, x, s, y))
    dims = V.per_dimension(nested).toPandas()
    parts = dims.ss_label + dims.ss_subject + dims.ss_residual
    assert np.abs(parts - dims.ss_total).max() < 1e-8 * dims.ss_total.max()
    assert (dims.df_label.iloc[0], dims.df_subject.iloc[0], dims.df_residual.iloc[0]) == (1, 38, 360)
    w = V.omega_squared(nested).first()
    assert w["frac_label"] == pytest.approx(0.762, abs=0.03)
    assert w["frac_subject"] == pytest.approx(0.190, abs=0.03)
    assert w["frac_residual"] == pytest.approx(0.048, abs=0.01)
    v = V.variance_components(table(spark, x, s, y)).first()
    assert v["frac_label_mean"] == pytest.approx(0.762, abs=0.03)
    assert v["var_residual_mean"] == pytest.approx(0.25, abs=0.02)


def test_numerically_stable_far_from_zero(spark):
    x, s, y = planted(4, 5, 6, seed=2)
    a = V.omega_squared(V.nested_ss(table(spark, x, s, y))).first()
    b = V.omega_squared(V.nested_ss(table(spark, x + 1e6, s, y))).first()
    assert a["omega2_label"] == pytest.approx(b["omega2_label"], abs=1e-5)


def test_mixed_label_subject_fails(spark):
    x = np.random.default_rng(0).normal(size=(10, 5))
    with pytest.raises(Exception, match="more than one label"):
        V.nested_ss(table(spark, x, [0] * 5 + [1] * 5, [0, 1, 0, 0, 0, 1, 1, 1, 1, 1])).collect()


def test_no_residual_degrees_of_freedom_fails(spark):
    x = np.random.default_rng(0).normal(size=(4, 3))
    with pytest.raises(Exception, match="degrees of freedom"):
        V.omega_squared(V.nested_ss(table(spark, x, [0, 1, 2, 3], [0, 0, 1, 1]))).collect()


def test_intraclass_correlation(spark):
    x, s, y = planted(10, 6, 20, seed=1)
    r = V.variance_components(table(spark, x, s, y), max_dims=15).first()
    assert r["n_dims"] == 15
    assert 0.65 < r["icc_subject_mean"] < 0.92


def test_bootstrap_contains_point_and_accepts_user_statistic(spark):
    x, s, y = planted(8, 5, 20, seed=2)
    df = table(spark, x, s, y)
    r = V.cluster_bootstrap(df, "omega2_subject", n_boot=200, seed=2).first()
    assert r["ci_low"] < r["point"] < r["ci_high"] and r["n_valid"] >= 150
    own = V.cluster_bootstrap(df, lambda pdf: float(pdf["n"].sum()), n_boot=20).first()
    assert own["point"] == 80.0 and own["ci_low"] == 80.0


def test_bootstrap_replicate_equals_resampled_rows(spark):
    x, s, y = planted(3, 4, 5, seed=4)
    df = table(spark, x, s, y)
    stats = V.replicate_statistics(V.bootstrap_replicates(df, 5, 0)).toPandas().set_index("boot")
    total = ((x - x.mean(0)) ** 2).sum()
    assert stats.loc[0, "subject_frac"] == pytest.approx(group_ss(x, s).sum() / total)
    import hashlib

    order = sorted(range(6), key=lambda i: hashlib.md5(f"position:{i}".encode()).hexdigest())
    for b in range(1, 6):
        picks = [order[int(hashlib.md5(f"0:{b}:{i}".encode()).hexdigest()[:8], 16) * 6 >> 32] for i in range(6)]
        rows = np.concatenate([np.flatnonzero(s == p) for p in picks])
        fresh = np.concatenate([np.full((s == p).sum(), i) for i, p in enumerate(picks)])
        z = x[rows]
        assert stats.loc[b, "subject_frac"] == pytest.approx(group_ss(z, fresh).sum() / ((z - z.mean(0)) ** 2).sum())


def pseudo_f(z, y):
    d = ((z[:, None] - z[None]) ** 2).sum(-1)
    n, groups = len(z), np.unique(y)
    total = d[np.triu_indices(n, 1)].sum() / n
    within = sum(d[np.ix_(y == g, y == g)].sum() / 2 / (y == g).sum() for g in groups)
    return ((total - within) / (len(groups) - 1)) / (within / (n - len(groups)))


def test_permanova_statistic_signal_and_null(spark):
    x, s, y = planted(6, 3, 8, offset=1.0, seed=5)
    r = V.permanova(table(spark, x, s, y), n_perm=199).first()
    assert r["pseudo_f"] == pytest.approx(pseudo_f((x - x.mean(0)) / x.std(0), y))
    assert r["p_value"] < 0.05
    rng = np.random.default_rng(0)
    p = []
    for i in range(3):
        noise = rng.normal(size=(64, 30))
        subj = np.repeat(np.arange(16), 4)
        p.append(V.permanova(table(spark, noise, subj, subj % 2), n_perm=99, seed=i).first()["p_value"])
    assert 0.05 < np.mean(p) < 0.95


def test_permutations_keep_the_label_counts(spark):
    subjects = spark.createDataFrame([(i, i % 3) for i in range(31)], "subject_id long, label int")
    out = V.permutation_labels(subjects, 20, 1).toPandas()
    for _, g in out.groupby("perm"):
        assert sorted(g.label.value_counts().to_dict().items()) == [(0, 11), (1, 10), (2, 10)]
    assert out[out.perm == 1].sort_values("subject_id").label.tolist() != out[out.perm == 2].sort_values("subject_id").label.tolist()


def test_null_matches_its_expectation(spark):
    x, s, y = planted(10, 20, 32, offset=0.0, sd_subject=0.0, seed=6)
    r = V.null_control(table(spark, x, s, y), n_seeds=12, seed=1).first()
    assert r["null_subject_mean"] == pytest.approx(r["df_subject_pred"], rel=0.1)
    assert r["null_label_mean"] == pytest.approx(r["df_label_pred"], rel=0.35)
    assert r["excess_subject"] == pytest.approx(1.0, abs=0.25)


def test_null_agrees_with_row_level_noise(spark):
    rng = np.random.default_rng(0)
    s = rng.integers(0, 9, 300)
    y = rng.integers(0, 2, 300)
    fracs = []
    for _ in range(200):
        z = rng.normal(size=(300, 8))
        fracs.append(group_ss(z, s).sum() / ((z - z.mean(0)) ** 2).sum())
    counts = table(spark, np.zeros((300, 1)), s, y).groupBy("subject_id", "label").count().withColumnRenamed("count", "n")
    got = V.null_fractions(counts, 8, 200, 3, "subject_id", "label").toPandas().subject_frac
    assert got.mean() == pytest.approx(np.mean(fracs), rel=0.05)
    assert got.std() == pytest.approx(np.std(fracs), rel=0.25)


@pytest.mark.parametrize("spread", [False, True])
def test_label_concentration(spark, spread):
    rng = np.random.default_rng(7)
    y = np.arange(200) % 2
    x = rng.normal(0, 0.3, size=(200, 50))
    x += 0.5 * (2 * y - 1)[:, None] if spread else 0
    if not spread:
        x[:, 0] += 5 * (2 * y - 1)
    rows = V.label_subspace(table(spark, x, y, y)).toPandas().set_index("basis")
    raw = rows.loc["raw"]
    if spread:
        assert raw.dims_for_80pct >= 25 and raw.pr_label > 35
    else:
        assert raw.dims_for_80pct == 1 and raw.pr_label < 1.5
        assert V.top_axes(V.label_ss_per_axis(table(spark, x, y, y)), 1).first()["cum_fraction"] > 0.9
    c = x - x.mean(0)
    u, sv, vt = np.linalg.svd(c, full_matrices=False)
    ss = group_ss(u * sv, y)
    assert rows.loc["pc"].pr_label == pytest.approx(ss.sum() ** 2 / (ss**2).sum(), rel=1e-6)


def test_constant_label_variance_is_reported_as_missing(spark):
    y = np.arange(8) % 2
    r = V.concentration(V.label_ss_per_axis(table(spark, np.ones((8, 3)), y, y))).first()
    assert r["dims_for_50pct"] == -1 and np.isnan(r["pr_label"])
