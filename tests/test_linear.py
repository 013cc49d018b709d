"""Erasure, ridge, retrieval, dictionaries and spectra against brute force."""

import numpy as np
import pytest
from helpers import identity_cohort, table

from strataframe.contracts import ContractError
from strataframe.operators import dictionary as Y, erasure as E, retrieval as R, ridge as G, spectra as Z
from strataframe.plans import moments


def test_gram_centres_and_merges(spark):
    x, s, y, r = identity_cohort()
    df = table(spark, x, s, y, r)
    n, mu = moments.mean_vector(df)
    g, rows, q = moments.gram(df, center_left=mu)
    c = x - x.mean(0)
    assert n == rows == len(x)
    assert np.allclose(g, c.T @ c) and q == pytest.approx(((c**2).sum(1) ** 2).sum())


def test_eraser_equals_one_hot_construction(spark):
    x, s, y, r = identity_cohort()
    df = table(spark, x, s, y, r)
    w = E.fit_whitening(df, shrinkage=False)
    e = E.fit_eraser(df, w)
    c = x - x.mean(0)
    onehot = np.eye(6)[s]
    cross = c.T @ (onehot - onehot.mean(0)) / len(x)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    white = (vectors / np.sqrt(values)) @ vectors.T
    color = (vectors * np.sqrt(values)) @ vectors.T
    u, sv, _ = np.linalg.svd(white @ cross, full_matrices=False)
    u = u[:, sv > 1e-6 * sv.max()]
    assert e.rank == u.shape[1] == 5
    assert np.allclose(e.projector, np.eye(32) - color @ (u @ u.T) @ white, atol=1e-6)
    out = E.apply_eraser(df, e).toPandas().sort_values("row_id")
    z = np.stack(out["x"])
    means = np.stack([z[s == i].mean(0) for i in range(6)])
    assert np.abs(means - z.mean(0)).max() < 1e-6 * np.abs(x).max()


def test_shrinkage_weight_in_range_and_zero_for_plenty_of_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 10)) * np.linspace(1, 3, 10)
    w = E.fit_whitening(table(spark, x, np.arange(40), np.zeros(40)))
    c = x - x.mean(0)
    cov = c.T @ c / 40
    mu = np.trace(cov) / 10
    delta = ((cov - mu * np.eye(10)) ** 2).sum() / 10
    beta = sum(((np.outer(v, v) - cov) ** 2).sum() for v in c) / 40**2 / 10
    assert w.shrinkage == pytest.approx(min(beta, delta) / delta, rel=1e-9)
    assert np.isfinite(w.cond)


def test_subspace_overlap(spark):
    eye = np.eye(6)
    basis = lambda rows: spark.createDataFrame([([float(v) for v in r],) for r in rows], "x array<double>")
    assert E.subspace_overlap(basis(eye[:2]), basis(eye[:2])) == pytest.approx(1.0)
    assert E.subspace_overlap(basis(eye[:2]), basis(eye[2:5])) == pytest.approx(0.0)
    turn = np.array([[1, 1], [1, -1]]) / np.sqrt(2)
    assert E.subspace_overlap(basis(eye[:2]), basis(turn @ eye[:2])) == pytest.approx(1.0)
    assert E.subspace_overlap(basis(eye[:0]), basis(eye[:2])) == 0.0


def test_ridge_map_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 5)) * 3 + 2, rng.normal(size=(60, 3))
    df = spark.createDataFrame([([float(v) for v in a], [float(v) for v in b]) for a, b in zip(x, y)], "x array<double>, y array<double>")
    m = G.fit_ridge_map(df.repartition(4), 10.0)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(5), z.T @ (y - y.mean(0)))
    assert np.allclose(m.weights, w)
    out = G.apply_ridge_map(df, m).collect()
    assert np.allclose([r["prediction"] for r in out], [((np.array(r["x"]) - x.mean(0)) / x.std(0)) @ w + y.mean(0) for r in out])


@pytest.mark.parametrize("kind", ["continuous", "binary"])
def test_ridge_probe_path(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6))
    y = x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=80)
    y = (y > 0).astype(float) if kind == "binary" else y
    rows = [(i, "test" if i % 4 == 0 else "train", [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id long, split string, x array<double>, y double")
    a = G.ridge_probe(df, kind, lambdas=(0.1, 10.0, 1e4)).first()
    b = G.ridge_probe(df, kind, lambdas=(0.1, 10.0, 1e4), select_on="train_cv", cv_folds=3).first()
    assert a["test_score"] > 0.9 and a["n_train"] == 60 and a["n_test"] == 20
    assert a["test_score"] >= b["test_score"] > 0.85


def emb(spark, m, offset=0):
    return spark.createDataFrame([(i + offset, [float(v) for v in r]) for i, r in enumerate(m)], "id long, emb array<double>")


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_retrieval_perfect_noisy_and_permuted(spark, limit):
    rng = np.random.default_rng(3)
    g = rng.normal(size=(50, 16))
    perfect = R.evaluate_retrieval(emb(spark, g), emb(spark, g), correct=None, limit=limit, tile=17).first()
    assert perfect["top1"] == 1.0 and perfect["median_rank"] == 1.0 and perfect["chance_top1"] == 1 / 50
    order = rng.permutation(50)
    q = spark.createDataFrame([(i, int(order[i]), [float(v) for v in g[order[i]] + 0.01 * rng.normal(size=16)]) for i in range(50)], "id long, correct_id long, emb array<double>")
    assert R.evaluate_retrieval(q, emb(spark, g), limit=limit, tile=17).first()["top1"] == 1.0
    noisy = R.evaluate_retrieval(emb(spark, g + 2 * rng.normal(size=g.shape)), emb(spark, g), (1, 3, 10), correct=None, limit=limit, tile=17).first()
    assert noisy["top1"] <= noisy["top3"] <= noisy["top10"]


def test_retrieval_needs_equal_sizes(spark):
    m = np.eye(12)
    with pytest.raises(ContractError, match="identity matching"):
        R.evaluate_retrieval(emb(spark, m[:10]), emb(spark, m), correct=None)


def test_top_k_prefers_smaller_id_on_ties(spark):
    g = np.array([[1.0, 0], [1, 0], [0, 1], [1, 0]])
    for limit in (1 << 26, 0):
        rows = R.top_k(emb(spark, g[:1]), emb(spark, g), 3, limit=limit, tile=2).orderBy("rank").collect()
        assert [r["id"] for r in rows] == [0, 1, 3]


def test_sparsify_cases(spark):
    z = np.array([[1, 0.5, 9, 0.1, 7]])
    assert Y.sparsify(z, 2).tolist() == [[0, 0, 9, 0, 7]]
    assert not Y.sparsify(z, 0).any() and (Y.sparsify(z, 5) == z).all()
    assert (Y.sparsify(np.random.default_rng(0).normal(size=(4, 3, 20)), 8) != 0).sum(-1).tolist() == [[8] * 3] * 4
    df = spark.createDataFrame([(0, [1.0, 0.5, 9.0, 0.1, 7.0])], "row_id long, x array<double>")
    for k in (0, 2, 5, 9):
        assert Y.topk_arrays(df, k).first()["x"] == Y.sparsify(z, k)[0].tolist()
    tie = spark.createDataFrame([(0, [3.0, 3.0, 3.0])], "row_id long, x array<double>")
    assert Y.topk_arrays(tie, 2).first()["x"] == [3.0, 3.0, 0.0]


def atoms(spark, rng, width=32, size=128):
    enc = rng.normal(size=(size, width)) / np.sqrt(width)
    rows = [(i, [float(v) for v in e], 0.0, [float(v) for v in e]) for i, e in enumerate(enc)]
    return spark.createDataFrame(rows, "feature long, enc array<double>, enc_bias double, dec array<double>")


def test_dictionary_health_and_liveness(spark, tmp_path):
    from strataframe.sources import tables

    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 32))
    df = table(spark, x, np.arange(200) % 5, np.zeros(200))
    a = atoms(spark, rng)
    d = Y.load_dictionary(a)
    z = d.code(d.pre(x), 8)
    h = Y.dictionary_health(df, d, 8).first()
    err = x - d.decode(z)
    assert h["recon_mse"] == pytest.approx((err**2).mean())
    assert h["explained_var"] == pytest.approx(1 - err.var() / x.var())
    assert h["l0_actual"] == pytest.approx((z > 0).sum(1).mean()) and h["l0_actual"] <= 8
    assert h["mean_density"] <= 8 / 128 + 1e-12 and 0 <= h["dead_fraction"] <= 1
    assert np.allclose(np.stack(Y.reconstruct(df, d, 8).orderBy("row_id").toPandas()["x_hat"]), d.decode(z))
    tables.write_dictionary(a, d.dec_bias, 8, str(tmp_path / "d"))
    back, k = tables.read_dictionary(spark, str(tmp_path / "d"))
    assert k == 8 and np.allclose(back.enc, d.enc)
    fired = spark.createDataFrame([(0, 5), (0, 300), (1, 120)], "feature long, step long")
    live = {r["feature"]: r["dead"] for r in Y.feature_liveness(fired, a.where("feature < 3"), 310, 200).collect()}
    assert live == {0: False, 1: False, 2: True}


def test_oversized_dictionary_is_refused(spark):
    with pytest.raises(ContractError, match="exceeds"):
        Y.load_dictionary(atoms(spark, np.random.default_rng(0)), limit=1000)


def matrix(spark, m, layer="a"):
    return spark.createDataFrame([(layer, i, [float(v) for v in r]) for i, r in enumerate(m)], "layer string, row_idx int, w array<double>")


def test_spectra(spark):
    rng = np.random.default_rng(5)
    cases = {
        "rank1": np.outer(rng.normal(size=16), rng.normal(size=8)),
        "identity": np.eye(32),
        "ortho": np.linalg.qr(rng.normal(size=(128, 128)))[0],
        "gauss": rng.normal(size=(64, 256)),
        "tall": rng.normal(size=(300, 6)),
    }
    df = None
    for name, m in cases.items():
        part = matrix(spark, m, name)
        df = part if df is None else df.unionByName(part)
    s = Z.spectral_summary(Z.matrix_eigenvalues(df, ["layer"]), ["layer"]).toPandas().set_index("layer")
    assert s.loc["rank1"].participation_ratio < 1.5 and s.loc["rank1"].stable_rank < 1.5
    assert s.loc["identity"].participation_ratio > 25 and s.loc["ortho"].participation_ratio > 100
    assert s.loc["gauss"].n_eigs == 64 and np.isfinite(s.loc["gauss"].alpha_hill)
    lam = np.linalg.svd(cases["tall"], compute_uv=False) ** 2
    assert s.loc["tall"].participation_ratio == pytest.approx(lam.sum() ** 2 / (lam**2).sum())
    tail = np.sort(lam)[::-1][:3]
    assert s.loc["tall"].alpha_hill == pytest.approx(1 + 3 / np.log(tail / tail[-1]).sum())


def test_matrix_must_be_two_dimensional(spark):
    df = spark.createDataFrame([("a", 0, [[1.0]])], "layer string, row_idx int, w array<array<double>>")
    with pytest.raises(ContractError):
        Z.matrix_eigenvalues(df, ["layer"])


def test_low_rank_merge(spark):
    rng = np.random.default_rng(6)
    w, b, a = rng.normal(size=(7, 5)), rng.normal(size=(7, 2)), rng.normal(size=(2, 5))
    left = spark.createDataFrame([("a", i, [float(v) for v in r]) for i, r in enumerate(b)], "layer string, row_idx int, b array<double>")
    right = spark.createDataFrame([("a", i, [float(v) for v in r]) for i, r in enumerate(a)], "layer string, r int, a array<double>")
    out = Z.merge_update(matrix(spark, w), left, right, 0.5).orderBy("row_idx").toPandas()
    assert np.allclose(np.stack(out["w"]), w + 0.5 * b @ a)


def test_best_of_blocks_holds_no_row_of_scores():
    import tracemalloc

    rng = np.random.default_rng(8)
    g, q = rng.normal(size=(40_000, 8)), rng.normal(size=(200, 8))
    g[30_000:] = g[:10_000]  # ties, the smaller id first
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    ids, scores = R.best_ids(np.round(q @ g.T, R.TIE_DIGITS), np.arange(40_000), 5)
    assert (np.diff(scores) <= 0).all()
    tracemalloc.start()
    got = R.best_of(q, g, np.arange(40_000), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[0] == ids).all() and np.allclose(got[1], scores, rtol=0, atol=1e-9) and peak < q.shape[0] * len(g) * 8 / 4
    few = R.best_of(q, g[:3], np.arange(3), 5)
    assert few[0].shape == (200, 3) and np.allclose(few[1], np.sort(q @ g[:3].T, axis=1)[:, ::-1], rtol=0, atol=1e-9)


def test_shards_of_a_large_gallery_stay_few(spark, monkeypatch):
    rng = np.random.default_rng(2)
    g, q = emb(spark, rng.normal(size=(4000, 4))), emb(spark, rng.normal(size=(4000, 4)))
    before = R.top_k(q, g, 3).collect()
    pairs = R._shard_pairs(q, g, "id", "id", "emb", 10)
    sent = pairs._gd2._df.groupBy("id").count().agg({"count": "max"}).first()[0]
    assert sent <= 2 * spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, R.top_k(q, g, 3, limit=0, tile=10).collect())) == sorted(map(tuple, before))
    monkeypatch.setattr(R, "SHARD_BYTES", 48 * 900)
    assert sorted(map(tuple, R.top_k(q, g, 3, limit=0, tile=10).collect())) == sorted(map(tuple, before))
