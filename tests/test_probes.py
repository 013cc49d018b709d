import numpy as np
import pytest
from helpers import identity_cohort, table
from pyspark.sql import functions as F

from strataframe.contracts import ContractError
from strataframe.operators import audit as A, concepts as C, erasure as E, metrics as M, probes as P, sampling


def newton(x, y, w, penalise, steps=60):
    d = np.hstack([x, np.ones((len(x), 1))])
    lam = np.ones(d.shape[1])
    lam[-1] = 1.0 if penalise else 0.0
    b = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-d @ b))
        b -= np.linalg.solve(d.T @ (d * (w * p * (1 - p))[:, None]) + np.diag(lam), d.T @ (w * (p - y)) + lam * b)
    return b


@pytest.mark.parametrize("penalise", [True, False])
def test_binary_models_solve_their_objective(spark, penalise):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 4)) * [1, 5, 0.1, 2] + 3
    y = (x[:, 0] + 0.5 * rng.normal(size=90) > 3.4).astype(int)
    rows = [([float(v) for v in a], int(b), [m for m in (0, 1) if i % 2 != m]) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x array<double>, y int, train array<int>").repartition(3)
    models = P.fit_binary_models(df, 2, clip=(1.0, 99.0), penalise_intercept=penalise)
    for m in (0, 1):
        part = np.arange(90) % 2 != m
        lo, hi = np.percentile(x[part], [1, 99], axis=0)
        z = np.clip(x[part], lo, hi)
        z = (z - z.mean(0)) / z.std(0)
        t = y[part]
        w = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (len(t) - t.sum())))
        assert np.allclose(models.coef[m], newton(z, t, w, penalise), atol=1e-5)


def cohort(spark, n_subj=4, n_rec=2, n_win=8, label_dim=True, subject_dim=True, seed=0):
    rng = np.random.default_rng(seed)
    x, s, r, y = [], [], [], []
    for i in range(n_subj):
        for k in range(n_rec):
            for w in range(n_win):
                label = w % 2
                v = 0.3 * rng.normal(size=4)
                v[0] += 3 * (2 * label - 1) if label_dim else 0
                v[1] += 4 * (i % 2) if subject_dim else 0
                v[2] += 4 * (i // 2) if subject_dim else 0
                x.append(v)
                s.append(i)
                r.append(2 * (i * n_rec + k) + label)
                y.append(label)
    return table(spark, np.array(x), s, y, r)


def test_label_and_subject_probes_find_planted_signal(spark):
    df = cohort(spark)
    assert P.label_probe(df, n_folds=2)[0][0] > 0.9
    assert P.reidentification_probe(df)[0] > 0.8
    single = cohort(spark, n_rec=1).withColumn("recording_id", F.col("subject_id"))
    assert np.isnan(P.reidentification_probe(single)[0])


def test_layer_probe_localises_signal(spark):
    a = cohort(spark, subject_dim=False).withColumn("depth", F.lit(0))
    b = cohort(spark, label_dim=False, subject_dim=False, seed=1).withColumn("depth", F.lit(1))
    c = cohort(spark, label_dim=False, seed=2).withColumn("depth", F.lit(2))
    out = P.layer_probe(a.unionByName(b).unionByName(c), n_folds=2).toPandas()
    assert out.depth_fraction.tolist() == pytest.approx([1 / 3, 2 / 3, 1.0])
    assert out.label_ba[0] > 0.8 and out.label_ba[2] < 0.75
    assert out.subject_ba[2] > 0.7 and out.subject_ba[0] < 0.6


def test_ablating_nothing_changes_nothing(spark):
    df = cohort(spark)
    r = P.ablation_role(df, df, n_folds=2).first()
    assert r["state_drop_mean"] == 0.0 and r["subject_drop_mean"] == pytest.approx(0.0)


def test_linear_probe_scores_recordings(spark):
    df = cohort(spark, n_subj=6, n_win=6)
    out = P.linear_probe(df, (42, 7), n_splits=3).toPandas()
    assert sorted(out.seed) == [7, 42] and out.balanced_accuracy.min() > 0.9
    loso = P.linear_probe(df, (42,), cv="loso").first()
    assert loso["balanced_accuracy"] > 0.9
    with pytest.raises(ContractError, match="binary"):
        P.linear_probe(df.withColumn("label", F.lit(1)))
    with pytest.raises(ContractError, match="unknown cv"):
        P.linear_probe(df, cv="other")


def test_erasure_collapses_identity_and_keeps_the_label(spark):
    x, s, y, r = identity_cohort(per=20)
    df = table(spark, x, s, y, r)
    out = A.erasure_audit(df, A.AuditConfig(mlp=False, erasure_seeds=(42,)))
    assert out["erasure_rank_subject_axis"] == 5 and not out["erasure_degenerate"]
    assert out["erasure_subj_ba_linear_pre"] > 0.9 and out["erasure_subj_ba_linear_post"] < 0.3
    assert out["erasure_interpretable"] == (out["erasure_label_ba_raw"] >= 0.55)
    assert out["erasure_label_ba_delta"] == pytest.approx(out["erasure_label_ba_erased"] - out["erasure_label_ba_raw"])


def test_identity_probes_of_an_audit_take_all_rows(spark, monkeypatch):
    x, s, y, r = identity_cohort(n_subj=2, per=60, dims=4)
    sizes = []
    monkeypatch.setattr(P, "crossval_multiclass", lambda rows, *a, **k: sizes.append(rows.count()) or [0.5])
    A.erasure_audit(table(spark, x, s, y, r), A.AuditConfig(), with_label=False)
    assert sizes == [240] * 3
    P.subject_probe(table(spark, x, s, y, r), cap=100)
    assert sizes[3:] == [200]


def test_subject_probe_with_one_subject(spark):
    df = table(spark, np.random.default_rng(0).normal(size=(12, 3)), [1] * 12, [0] * 12)
    assert P.subject_probe(df) == (None, 1)


def test_nonlinear_probe_runs(spark):
    x, s, y, r = identity_cohort(per=10)
    e = E.fit_eraser(table(spark, x, s, y, r), E.fit_whitening(table(spark, x, s, y, r)))
    score, n = P.subject_probe(E.apply_eraser(table(spark, x, s, y, r), e), "mlp", n_splits=2)
    assert n == 6 and 0.0 <= score <= 1.0


def test_multiclass_folds_share_their_passes(spark):
    rng = np.random.default_rng(3)
    code = np.arange(120) % 4
    x = rng.normal(size=(120, 3)) + 2.0 * np.eye(4)[code][:, :3]
    fold = np.arange(120) // 4 % 10
    rows = spark.createDataFrame([(int(c), int(f), v.tolist()) for c, f, v in zip(code, fold, x)], "code int, fold int, x array<double>").persist()
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    for kind, most in (("linear", 110), ("mlp", 300)):
        start = jobs()
        scores = P.crossval_multiclass(rows, 10, kind)
        # one search alone takes nearly as many: before, each of the folds had its own
        assert jobs() - start < most and len(scores) == 10 and np.mean(scores) > 0.6
    z = lambda part, train: (part - train.mean(axis=0)) / train.std(axis=0)
    net = P._Classes("linear", 3, 4)
    train = z(x[fold != 0], x[fold != 0])

    def told(asked):
        s = net.loss(train, code[fold != 0], np.ones(len(train)), asked[0], np.ones(4, bool))
        flat = np.where(np.arange(net.size) < 12, asked[0], 0.0)
        return {0: ((s[0] + 0.5 * flat @ flat) / len(train), (s[1:] + flat) / len(train))}

    coef = P._lockstep({0: P._lbfgs(np.zeros(net.size), 500, 1e-14)}, told)[0]
    assert np.abs(told({0: coef})[0][1]).max() < 1e-5
    picked = net.scores(z(x[fold == 0], x[fold != 0]), coef, np.ones(4, bool))[1].argmax(axis=1)
    recall = [(picked == code[fold == 0])[code[fold == 0] == c].mean() for c in range(4)]
    assert P.crossval_multiclass(rows, 10)[0] == pytest.approx(np.mean(recall))
    # a class that only the held-out fold has is neither learned nor scored
    odd = rows.where("fold < 2").withColumn("code", F.expr("IF(fold = 1 AND code = 3, 4, code)"))
    assert len(P.crossval_multiclass(odd, 2)) == 2
    rows.unpersist()


def test_concept_probes_by_hand_and_sparse_equals_dense(spark):
    rng = np.random.default_rng(3)
    n = 40
    z = np.maximum(rng.normal(size=(n, 3)), 0)
    y = 2 * z[:, 0] + 0.1 * rng.normal(size=n)
    b = (z[:, 1] > 0.3).astype(float)
    concepts = [(i, "lin", "continuous", float(y[i])) for i in range(n)] + [(i, "bin", "binary", float(b[i])) for i in range(n)]
    c = spark.createDataFrame(concepts, "subject_id long, concept string, kind string, y double")
    dense = [(i, f, float(z[i, f])) for i in range(n) for f in range(3)]
    schema = "subject_id long, feature long, value double"
    a = C.concept_probes(spark.createDataFrame(dense, schema), c).toPandas().set_index(["feature", "concept"])
    s = C.concept_probes(spark.createDataFrame([d for d in dense if d[2] != 0], schema), c).toPandas().set_index(["feature", "concept"])
    cols = ["train_score", "test_score"]
    assert np.allclose(a.sort_index()[cols], s.sort_index()[cols])
    split = sampling.subject_split(c, 0.25, 0, "subject_id", ["concept"]).where("concept = 'lin'").toPandas().set_index("subject_id").split
    tr, te = [i for i in range(n) if split[i] == "train"], [i for i in range(n) if split[i] == "test"]
    k, m = np.polyfit(z[tr, 0], y[tr], 1)
    want = 1 - ((y[te] - k * z[te, 0] - m) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum()
    assert a.loc[(0, "lin"), "test_score"] == pytest.approx(want) and want > 0.9
    sel = C.selectivity(a.reset_index().pipe(spark.createDataFrame)).toPandas().set_index("feature")
    assert sel.loc[0, "target_concept"] == "lin" and sel.loc[1, "target_concept"] == "bin"


def auc(score, truth):
    pos, neg = score[truth == 1], score[truth == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)) if len(pos) and len(neg) else 0.5


def test_sweep_equals_brute_force_with_ties_gaps_and_signs(spark):
    rng = np.random.default_rng(11)
    n = 70
    z = rng.integers(-2, 3, (n, 4)) * (rng.random((n, 4)) < 0.7)
    z[:, 3] = 0
    concepts = [(i, f"b{k}", "binary", float(rng.integers(0, 2))) for k in range(2) for i in range(n) if rng.random() < 0.9]
    concepts += [(i, "c", "continuous", float(z[i, 0] + rng.normal())) for i in range(5, n)] + [(i, "one", "binary", 1.0) for i in range(n)]
    c = spark.createDataFrame(concepts, "subject_id long, concept string, kind string, y double")
    entries = [(i, f"f{f}", float(z[i, f])) for i in range(n) for f in range(3) if z[i, f]] + [(1000, "f1", 9.0)]
    lat = spark.createDataFrame(entries, "subject_id long, feature string, value double").repartition(3)
    names = spark.createDataFrame([(f"f{f}",) for f in range(4)], "feature string")
    split = {(r.concept, r.subject_id): r.split for r in sampling.subject_split(c, 0.25, 0, "subject_id", ["concept"]).collect()}
    got = C.concept_probes(lat, c, features=names, blocks=5).collect()
    assert len(got) == 16 and {r.feature for r in got} == {"f0", "f1", "f2", "f3"}
    for r in got:
        f = int(r.feature[1])
        own = [(z[i, f], y, split[k, i]) for i, k, _, y in concepts if k == r.concept]
        parts = {s: (np.array([o[0] for o in own if o[2] == s], float), np.array([o[1] for o in own if o[2] == s])) for s in ("train", "test")}
        if r.kind == "binary":
            want = [auc(*parts[s]) for s in ("train", "test")]
        else:
            x, y = parts["train"]
            k, m = np.polyfit(x, y, 1) if x.std() else (0.0, 0.0)
            want = [1 - ((y - k * x - m) ** 2).sum() / ((y - y.mean()) ** 2).sum() if x.std() else 0.0 for x, y in parts.values()]
        assert (r.train_score, r.test_score) == pytest.approx(tuple(want), abs=1e-9), (r.feature, r.concept)


def test_sweep_of_no_concepts_is_empty(spark):
    c = spark.createDataFrame([], "subject_id long, concept string, kind string, y double")
    lat = spark.createDataFrame([(1, 0, 1.0)], "subject_id long, feature long, value double")
    assert C.concept_probes(lat, c).count() == 0


def test_too_few_subjects_give_nan(spark):
    c = spark.createDataFrame([(i, "lin", "continuous", float(i)) for i in range(8)], "subject_id long, concept string, kind string, y double")
    lat = spark.createDataFrame([(i, 0, float(i)) for i in range(8)], "subject_id long, feature long, value double")
    assert np.isnan(C.concept_probes(lat, c).first()["test_score"])


def test_auc_cases(spark):
    rows = [("a", 0.1, 0), ("a", 0.4, 0), ("a", 0.35, 1), ("a", 0.8, 1), ("b", 1.0, 1), ("b", 2.0, 1), ("c", 1.0, 0), ("c", 1.0, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, k string, s double, y int")
    got = {r["k"]: r["auc"] for r in M.rank_auc(df, ["k"], "s", "y").collect()}
    assert got == {"a": 0.75, "b": 0.5, "c": 0.5}
    ordinal = {r["k"]: r["auc"] for r in M.rank_auc(df, ["k"], "s", "y", ties="ordinal").collect()}
    assert ordinal == {"a": 0.75, "b": 0.5, "c": 1.0}


def test_audit_row(spark):
    x, s, y, r = identity_cohort(per=10)
    df = table(spark, x, s, y, r)
    row = A.audit_cell(df, A.AuditConfig("demo", "W,C", n_null_seeds=3, mlp=False, erasure_seeds=(42,), layer_summary={"label_ba_max": 0.7})).first()
    assert row["layout"] == "(W, C)" and row["subject_frac"] > row["label_frac"] and np.isfinite(row["c_bar_value"])
    assert row["layer_label_ba_max"] == 0.7 and np.isnan(row["state_drop"]) and row["erasure_supplied"]
    trait = A.audit_cell(df, A.AuditConfig("demo", "T,N", n_null_seeds=2, run_erasure=False)).first()
    assert np.isnan(trait["c_bar_value"]) and not trait["erasure_supplied"]


def test_sweep_leaderboard_isolates_failures(spark):
    x, s, y, r = identity_cohort(per=8, n_subj=5)
    good = table(spark, x, s, y, r)
    config = A.AuditConfig(n_null_seeds=2, mlp=False, erasure_seeds=(42,))
    bad = good.limit(0)
    rows = A.sweep_leaderboard({"good": good}, config).toPandas().set_index("dataset")
    assert rows.loc["good", "verdict"] in ("TRAP", "identity-reliant", "task-carried")
    both = A.sweep(good.withColumn("dataset", F.lit("a")).unionByName(good.where("subject_id = 0").withColumn("dataset", F.lit("b"))))
    status = {r["dataset"]: r["status"] for r in both.collect()}
    assert status == {"a": "ok", "b": "failed: fewer than two subjects"}
    assert bad.isEmpty()
