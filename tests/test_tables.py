"""Filters, encodings, joins, rubrics, reports, scans and sources on literal inputs."""

import json

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strataframe.contracts import ContractError, fits_broadcast, require_same_count, single_label_violations
from strataframe.operators import metrics as M, report as R, rubric as U, sampling, scan as T, segment as S, selecting as X
from strataframe.sources import cohorts as C, listings as L, tables as B

# ---- participants, stimuli, channels -------------------------------------------------------------------------------


def write_tsv(path, header, rows):
    path.write_text("\n".join("\t".join(r) for r in [header, *rows]) + "\n")
    return str(path)


def labels(df):
    return {r["subject_id"]: r["label"] for r in df.collect()}


def test_participants(spark, tmp_path):
    """The planted group decides the label: its place in the list of groups, whatever the case and blanks around it."""
    groups, rng = ("alpha", "Beta"), np.random.default_rng(3)
    spelled, want = [], {}
    for subject in rng.choice(900, 40, replace=False):
        kind = int(rng.integers(0, 3))
        text = [" ALPHA", "beta  ", "gamma"][kind]
        spelled.append([f"sub-{subject:03d}", "x", text])
        if kind < 2:
            want[int(subject)] = kind
    first = next(s for s in spelled if s[2] != "gamma")
    again = spelled + [[first[0], "x", "beta" if "ALPHA" in first[2] else "alpha"]]  # a second row of a subject does not count
    table = write_tsv(tmp_path / "t.tsv", ["participant_id", "site", "arm"], again)
    assert labels(C.participant_labels(spark, table, groups, "arm")) == want
    odd = write_tsv(tmp_path / "odd.tsv", ["participant_id", "arm"], [["55", "alpha"], ["sub-none", "beta"]])
    assert labels(C.participant_labels(spark, odd, groups, "arm")) == {55: 0}


def test_stimulus_codes_and_schedule(spark):
    df = spark.createDataFrame([("d/c.jpg",), ("a.jpg",), ("e/b.PNG",), ("x.txt",)], "path string")
    assert {r["basename"]: r["code"] for r in X.stimulus_codes(df).collect()} == {"a.jpg": 1, "b.PNG": 2, "c.jpg": 3}
    many = spark.createDataFrame([(f"{i:02d}.jpg",) for i in range(20)], "path string")
    one, two = (sorted(r["path"] for r in X.stimulus_codes(many, max_images=5, seed=3).collect()) for _ in range(2))
    assert one == two and len(one) == 5
    with pytest.raises(ContractError, match="no images"):
        X.stimulus_codes(df.where("path = 'x.txt'"))
    codes = spark.createDataFrame([(i,) for i in range(1, 5)], "code int")
    plan = [[r["code"] for r in sampling.presentation_schedule(codes, 3, seed).orderBy("position").collect()] for seed in (0, 0, 1)]
    assert plan[0] == plan[1] != plan[2] and sorted(plan[0]) == sorted([1, 2, 3, 4] * 3)
    ordered = sampling.presentation_schedule(codes, 3, shuffle=False).orderBy("position").collect()
    assert [r["code"] for r in ordered] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]


def test_channel_selection(spark):
    df = spark.createDataFrame([(1, "FP1 ", 1.0), (1, "cz", 2.0), (1, "O1", 3.0)], "recording_id long, ch string, v double")
    out = S.select_channels(df, ["Cz", "Fp1"], key=["recording_id"]).orderBy("pos").collect()
    assert [(r["ch"], r["v"]) for r in out] == [("Cz", 2.0), ("Fp1", 1.0)]
    for key in ((), ("recording_id",)):
        with pytest.raises(ContractError, match="not in recording"):
            S.select_channels(df, ["Pz"], key=key)


def test_common_and_vocabulary_channels(spark):
    rows = [(1, "b", 0), (1, "a", 1), (1, "c", 2), (2, "a", 0), (2, "c", 1), (2, "b", 2), (3, "c", 0), (3, "a", 1)]
    df = spark.createDataFrame(rows, "subject_id int, ch string, pos int")
    assert [r["ch"] for r in X.common_channels(df).orderBy("pos").collect()] == ["a", "c"]
    vocab = spark.createDataFrame([("a",)], "ch string")
    assert X.vocabulary_channels(df, vocab).count() == 3
    with pytest.raises(ContractError, match="vocabulary"):
        X.vocabulary_channels(df.where("ch = 'b'"), vocab)


# ---- contracts -----------------------------------------------------------------------------------------------------


def test_contract_checks(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "subject_id int, label int")
    assert single_label_violations(df).first()["subject_id"] == 1
    with pytest.raises(ContractError):
        require_same_count(df, df.limit(2), "sizes differ")
    with pytest.raises(ContractError, match=r"\['z'\]|z"):
        X.check_targets(spark.createDataFrame([("a",)], "name string"), ["a", "z"])
    with pytest.raises(ContractError, match="empty"):
        X.select_layers(df.withColumn("depth", F.lit(0)), [], 3)
    with pytest.raises(ContractError, match="out of range"):
        X.select_layers(df.withColumn("depth", F.lit(0)), [5], 3)
    three = spark.range(3).withColumnRenamed("id", "depth")
    assert [r["depth"] for r in X.select_layers(three, [-1, 0], 3).orderBy("depth").collect()] == [0, 2]
    g = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(ContractError, match="only 1"):
        X.keep_known_codes(spark.createDataFrame([(1,), (9,)], "code long"), g)
    with pytest.raises(ContractError, match="different length"):
        X.join_positions(spark.range(3), spark.range(2).withColumnRenamed("id", "b"), "id", "b")
    assert fits_broadcast(spark.range(10), 8, 80) and not fits_broadcast(spark.range(11), 8, 80)


def test_recording_filters(spark):
    rows = [(1, 1000, 100.0, 4), (2, 100, 100.0, 4), (3, 1000, 100.0, 5), (4, None, None, 4)]
    df = spark.createDataFrame(rows, "recording_id int, n_times long, sfreq double, n_channels int")
    got = {r["recording_id"]: r["reason"] for r in X.usable_recordings(df, 6.0).collect()}
    assert got[1] is None and got[2].startswith("too short: 1.00s") and got[3] == "n_channels=5 != mode 4" and got[4] == "unreadable"


def test_restrict_subjects_and_finite_targets(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, float("inf"))], "subject_id long, t double")
    wanted = spark.createDataFrame([("sub-1",), ("3",), ("x",)], "subject string")
    assert sorted(r["subject_id"] for r in X.restrict_subjects(df, wanted).collect()) == [1, 3]
    assert [r["subject_id"] for r in X.finite_targets(df, ["t"]).collect()] == [1]


def test_upsert_keeps_order_and_new_columns(spark):
    old = spark.createDataFrame([("b", 1), ("c", 2)], "model string, v int")
    new = spark.createDataFrame([("c", 9, "x"), ("a", 3, "y")], "model string, v int, note string")
    order = spark.createDataFrame([("a", 0), ("b", 1)], "model string, ord int")
    assert [tuple(r) for r in X.upsert(old, new, ["model"], order).collect()] == [("a", 3, "y"), ("b", 1, None), ("c", 9, "x")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from("aab"), min_size=1, max_size=25))
def test_runs_property(spark, keys):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "row_id long, k string")
    runs = S.runs_to_recordings(df, [], "row_id", ["k"], hot_rows=None).orderBy("first_row").collect()
    flat = [k for r in runs for k in [r["k"]] * r["n_rows"]]
    assert flat == keys and all(a["k"] != b["k"] for a, b in zip(runs, runs[1:]))


# ---- rubric and reports ------------------------------------------------------------------------------------------------


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_signs_and_roles(spark):
    lit = F.lit
    assert one(spark, U.layer_sign(lit(0.7), lit(0.6), lit(0.7), lit(0.2))) == "+ early"
    assert one(spark, U.layer_sign(lit(0.6), lit(0.66), lit(0.66), lit(0.9))) == "+"
    assert one(spark, U.layer_sign(lit(0.5), lit(0.4), lit(0.55), lit(0.5))) == "- deep"
    assert one(spark, U.layer_flags(lit(0.62), lit(0.70), lit(0.2))) == "+early"
    assert one(spark, U.layer_flags(lit(0.40), lit(0.50), lit(0.9))) == "-deep"
    assert one(spark, U.layer_flags(lit(float("nan")), lit(0.5), lit(0.1))) == ""
    for state in (0.0, 0.3):  # either role by itself, both, none: far from the thresholds
        for subject in (0.0, 0.3):
            roles = [r for r, drop in (("subject confound", subject), ("state signal", state)) if drop]
            found = one(spark, U.spectral_roles(lit(state), lit(subject)))
            assert sorted(filter(None, found.split(";"))) == sorted(roles)
    assert one(spark, U.leaderboard_verdict(lit(0.1), lit(0.5), lit(0.6), lit(0.6))) == "TRAP"
    assert one(spark, U.leaderboard_verdict(lit(0.1), lit(0.5), lit(0.6), lit(0.5))) == "identity-reliant"
    assert one(spark, U.leaderboard_verdict(lit(0.5), lit(0.1), lit(0.6), lit(0.5))) == "task-carried"
    assert one(spark, U.leaderboard_verdict(lit(float("nan")), lit(0.1), lit(0.6), lit(0.5))) == "n/a"


def test_verdict_matrix_golden(spark):
    schema = (
        "cell string, layout string, model string, delta_label double, ba_first double, ba_last double, ba_max double, "
        "ba_depth double, c_bar double, state_drop double, subject_drop double"
    )
    rows = [
        ("one", "W,C", "m1", 0.03, 0.60, 0.70, 0.72, 0.8, 0.20, 0.05, 0.02),
        ("one", "W,C", "m2", -0.01, 0.60, 0.68, 0.70, 0.9, 0.10, 0.04, 0.01),
        ("two", "T,C", "m1", 0.02, 0.70, 0.60, 0.72, 0.2, 0.30, 0.01, 0.20),
        ("three", "W,N", "m1", -0.01, 0.50, 0.50, 0.52, 0.5, 0.01, 0.01, 0.10),
        ("four", "T,N", "m1", -0.01, 0.50, 0.40, 0.50, 0.5, None, 0.00, 0.10),
        ("five", "W,C", "m1", -0.01, 0.50, 0.50, 0.50, 0.5, 0.30, None, None),
    ]
    out = U.verdict_matrix(spark.createDataFrame(rows, schema)).toPandas().set_index("cell")
    pick = ["layout", "delta_label_sign", "layer_probe", "c_bar", "spectral_role", "outcome"]
    assert out.loc["one", pick].tolist() == ["(W, C)", "+", "+", "+", "state signal", "Cross-subject-aligned"]
    assert out.loc["two", pick].tolist() == ["(T, C)", "+", "+ early", "0", "subject axis", "Label-subject coupled"]
    assert out.loc["three", pick].tolist() == ["(W, N)", "-", "-", "-", "subject confound", "Idiosyncratic within-subject"]
    assert out.loc["four", pick].tolist() == ["(T, N)", "-", "- deep", "0", "subject axis", "Below linear-probe resolution"]
    assert out.loc["five", "outcome"] == "Uncategorized" and out.loc["five", "role_total"] == 0
    assert out.loc["one", ["delta_agree", "delta_total", "c_bar_agree", "c_bar_total"]].tolist() == [1, 2, 2, 2]
    assert np.isnan(out.loc["two", "c_bar_value"])


def test_leaderboard_order_and_rendering(spark, tmp_path):
    rows = [("a", "0.5", "0.6", "ok"), ("b", "0.5", "0.9", "ok"), ("c", "x", "0.9", "ok"), ("d", None, None, "failed: timeout")]
    df = spark.createDataFrame(rows, "dataset string, raw_label_ba string, identity_free_label_ba string, status string")
    assert [r["dataset"] for r in R.leaderboard(df).collect()] == ["b", "a", "c"]
    assert [r["dataset"] for r in R.leaderboard_failures(df).collect()] == ["d"]
    text = R.render_markdown(R.leaderboard(df), ["dataset", "lift"])
    assert text.splitlines()[2] == "| b | 0.400 |" and "| c | — |" in text
    B.write_leaderboard(df, str(tmp_path / "lb"))
    stored = B.read_leaderboard(spark, str(tmp_path / "lb"))
    assert stored.columns == list(R.LEADERBOARD_FIELDS) and stored.count() == 4
    assert R.leaderboard_diagnostics(stored).count() == 0
    done = X.remaining(df.select("dataset"), stored.where("status = 'ok'"), ["dataset"])
    assert [r["dataset"] for r in done.collect()] == ["d"]


def test_seed_summary_of_one_seed(spark):
    r = M.seed_summary(spark.createDataFrame([(42, 0.5)], "seed int, ba double"), "ba").first()
    assert r["std_ddof1"] == 0.0 and r["mean_first"] == 0.5


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 9.99, 10.0, 180.0, 181.0)], "a double")
    got = [r["n"] for r in M.histogram(df, "a", 0.0, 180.0, 18).orderBy("bin").collect()]
    assert got == np.histogram([0.0, 9.99, 10.0, 180.0, 181.0], bins=np.linspace(0, 180, 19))[0].tolist()


# ---- text scan ---------------------------------------------------------------------------------------------------------------


def test_scan(spark):
    text = "fine\r\nmail me: x.y@example.org\n  our lab and our lab  \rCo-Authored-By:Anonymous\nCo-Authored-By: Someone\n" + "z" * 300 + " we acknowledge"
    docs = spark.createDataFrame([("a.txt", text), ("b.txt", "/store/secret/file and Smith et al")], "path string, text string")
    patterns = T.scan_patterns_for(names=["Smith"], roots=["/store/"], cited=["Smith"])
    hits = {(r["kind"], r["path"], r["line"]): r["snippet"] for r in T.scan_lines(docs, patterns).collect()}
    assert set(hits) == {
        ("email_pattern", "a.txt", 2),
        ("our_lab", "a.txt", 3),
        ("git_author_real", "a.txt", 5),
        ("we_acknowledge", "a.txt", 6),
        ("root_0", "b.txt", 1),
        ("identifier_smith", "b.txt", 1),
        ("citation_smith", "b.txt", 1),
    }
    assert hits[("our_lab", "a.txt", 3)] == "our lab and our lab" and len(hits[("we_acknowledge", "a.txt", 6)]) == 200
    allow = spark.createDataFrame([("our_lab", "a.txt")], "kind string, path string")
    report = {r["kind"]: r["n_hits"] for r in T.scan_report(T.scan_lines(docs, patterns, allow=allow)).collect()}
    assert "our_lab" not in report and report["email_pattern"] == 1


# ---- sources ---------------------------------------------------------------------------------------------------------------------


def test_file_listing_tree_and_sync(spark, tmp_path):
    for name in ("sub-1/eeg/sub-1_task-Rest_eeg.set", "sub-1/eeg/sub-1_task-Rest_run-2_eeg.set", "sub-2/eeg/sub-2_task-Other_eeg.set", "sub-3/beh/sub-3_task-Rest_eeg.set"):
        f = tmp_path / "ds" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"abc")
    files = L.list_files(spark, str(tmp_path / "ds"), "*.set")
    assert files.count() == 4 and files.first()["size"] == 3
    recs = L.recordings_of_task(files, "Rest").collect()
    assert sorted(r["subject"] for r in recs) == ["1", "1"]
    assert L.recordings_of_task(files, "Rest", sessions=True).count() == 1
    keys = ["ds1/README", "ds1/other.txt", "ds1/phenotype/x.tsv", "ds1/sub-1/eeg/sub-1_task-Rest_eeg.set", "ds1/sub-1/", "ds1/sub-1/README"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    assert [r["key"] for r in df.where(L.is_relevant("key", "Rest")).collect()] == [keys[0], keys[2], keys[3]]
    remote = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, size int")
    local = spark.createDataFrame([("a", 1), ("b", 9)], "key string, size int")
    assert sorted(r["key"] for r in L.to_fetch(remote, local).collect()) == ["b", "c"]


def test_parquet_tables(spark, tmp_path):
    e = spark.createDataFrame([(0, "c", [1.0], None), (1, "c", [2.0], 128.0)], "epoch long, ch string, x array<double>, sfreq double")
    e.write.parquet(str(tmp_path / "e"))
    assert [r["sfreq"] for r in B.read_epochs(spark, str(tmp_path / "e")).orderBy("epoch").collect()] == [250.0, 128.0]
    s = spark.createDataFrame([("p", False, 1), ("p", True, 2), ("q", False, 3)], "partition string, dropped boolean, n int")
    s.write.parquet(str(tmp_path / "s"))
    assert [r["n"] for r in B.read_stimuli(spark, str(tmp_path / "s"), "p").collect()] == [1]
    s.drop("dropped").write.parquet(str(tmp_path / "s2"))
    assert B.read_stimuli(spark, str(tmp_path / "s2"), "p").count() == 2
    a = spark.createDataFrame([(1, 2, 0, [1.0])], "row_id long, subject_id long, depth int, x array<double>")
    B.write_activations(a, str(tmp_path / "a"), ["depth"])
    assert B.read_activations(spark, str(tmp_path / "a"), ["row_id", "x"]).columns == ["row_id", "x"]
    with pytest.raises(ContractError, match="missing columns"):
        B.read_activations(spark, str(tmp_path / "a"), ["nope"])
    g = spark.createDataFrame([(1, [1.0])], "id long, emb array<double>")
    B.write_gallery(g, str(tmp_path / "g"))
    assert B.read_gallery(spark, str(tmp_path / "g")).count() == 1
    B.write_scores(g.select("id"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["id"] == "1"


def test_manifest_and_results(spark, tmp_path):
    for k in (8, 16):
        B.append_manifest(spark, str(tmp_path / "m"), f"run{k}", {"k": k, "lr": 0.1})
    rows = B.read_manifest(spark, str(tmp_path / "m"), "k int, lr double").orderBy("run").collect()
    assert [(r["run"], r["config"]["k"]) for r in rows] == [("run16", 16), ("run8", 8)]
    for ds, model, v in (("a", "x", 1), ("a", "y", 2), ("b", "x", 3)):
        d = tmp_path / "r" / f"dataset={ds}" / f"model={model}"
        d.mkdir(parents=True)
        (d / "part.json").write_text(json.dumps({"mean": v, "per_depth": [{"ba": 0.5}]}, indent=1))
    res = B.read_results(spark, str(tmp_path / "r"))
    assert B.lookup_result(res, dataset="a", model="y").first()["mean"] == 2
    with pytest.raises(ContractError, match=r"model 'y' not found \(available: \['x'\]\)"):
        B.lookup_result(res, dataset="b", model="y")


def test_settings_with_drifting_fields_keep_one_schema(spark, tmp_path):
    m = str(tmp_path / "m")
    B.write_manifest(spark.createDataFrame([("a", '{"k": 8, "opt": {"lr": 0.5}}'), ("b", "{}")], "run string, config string"), m)
    B.write_manifest(spark.createDataFrame([("c", {"k": "nine"})], "run string, config map<string,string>"), m)
    B.append_manifest(spark, m, "d", {"k": 4, "new": [1, 2]})
    rows = B.read_manifest(spark, m)
    assert dict(rows.dtypes)["config"] == "variant"
    got = rows.select("run", B.setting("config", "k", "long", F.lit(-1)).alias("k"), B.setting("config", "opt.lr", "double").alias("lr"), B.setting("config", "new[1]", "int").alias("new"))
    assert sorted(map(tuple, got.collect())) == [("a", 8, 0.5, None), ("b", -1, None, None), ("c", -1, None, None), ("d", 4, None, 2)]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.json").write_text('{"dataset": "x", "model": "p", "ba": 0.5}\n{"dataset": "x", "model": "q", "deep": {"ba": [0.25]}}\n')
    found = B.read_result_variants(spark, str(tmp_path / "r"), multiline=False)
    B.write_results(found.select(*[B.setting("parts", c, "string").alias(c) for c in ("dataset", "model")], "parts"), str(tmp_path / "t"))
    out = spark.read.parquet(str(tmp_path / "t")).select("model", B.setting("parts", "ba", "double", B.setting("parts", "deep.ba[0]", "double")).alias("ba"))
    assert sorted(map(tuple, out.collect())) == [("p", 0.5), ("q", 0.25)]


def test_cohorts_and_extraction(spark):
    rng = np.random.default_rng(0)
    recs = [(s, s % 2, rng.normal(size=(3, 2, 8))) for s in range(4)]
    cohort = C.in_memory_cohort(spark, recs)
    C.register_extractor("means", lambda: lambda x: x.mean(axis=2))
    out = C.extract_features(cohort, "means", 2, batch=2).orderBy("recording_id", "window_idx").collect()
    assert np.allclose([r["x"] for r in out], np.concatenate([w for _, _, w in recs]).mean(axis=2))
    deep = C.extract_features(cohort, lambda x: np.stack([x.mean(2), x.std(2)]), 2, layers=True)
    assert deep.groupBy("depth").count().count() == 2
    assert C.feature_table(C.extract_features(cohort, "means", 2)).select("row_id").distinct().count() == 12
    with pytest.raises(ContractError, match="known: \\['means'\\]"):
        C.get_extractor("other")
    with pytest.raises(Exception, match="expected 5"):
        C.extract_features(cohort, "means", 5).collect()
    with pytest.raises(ContractError):
        C.in_memory_cohort(spark, [])


def test_trait_and_stimulus_cohorts(spark):
    rows = [(s, c, i, float(s + i + 10 * (c == "b"))) for s in range(1, 7) for c in ("a", "b") for i in range(8) if not (s == 3 and c == "b")]
    samples = spark.createDataFrame(rows, "subject_id long, ch string, sample_idx long, v double")
    lab = spark.createDataFrame([(s, s % 2) for s in range(1, 7)], "subject_id long, label int")
    out = C.trait_cohort(samples, lab, 4, ["A", "B"], max_per_class=2)
    assert sorted({(r["subject_id"], r["label"]) for r in out.collect()}) == [(1, 1), (2, 0), (4, 0), (5, 1)]
    assert out.count() == 4 * 2 * 2
    with pytest.raises(ContractError, match="no usable"):
        C.trait_cohort(samples, lab, 100)
    epochs = spark.createDataFrame([(i, "c", [float(i), i + 1.0, i + 3.0]) for i in range(4)], "epoch long, ch string, x array<double>")
    stim = spark.createDataFrame([(0, "p1", "cat"), (1, "p2", "ant"), (2, "p1", "dog"), (3, "p3", "cat")], "row long, image_path string, super_category string")
    got = {r["image"]: (r["label"], r["n_trials"]) for r in C.stimulus_cohort(epochs, stim).collect()}
    assert got == {"p1": (1, 2), "p2": (0, 1), "p3": (1, 1)}


def test_erasure_table_rounds_as_printf(spark):
    from strataframe.operators import report

    rows = [(c, "m", 0.5, d / 100, True) for c, d in ((1, 0.25), (2, 0.75), (3, -0.25), (4, 3.0))] + [(5, "m", 0.5, 0.1, False)]
    table = spark.createDataFrame(rows, "cell long, model string, label_ba_raw double, label_ba_delta double, paired boolean")
    got = {r["cell"]: r["m"] for r in report.erasure_table(table, ["m"]).collect()}
    assert got == {1: "+0.2", 2: "+0.8", 3: "-0.2", 4: "+3.0", 5: "—"}
