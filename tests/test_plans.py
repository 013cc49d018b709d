"""Ordered, hashed and quantile plans: split groups give what a plain window gives."""

import hashlib
import itertools

import numpy as np
import pytest
from helpers import table
from pyspark.sql import Window, functions as F

from strataframe.functions import draws
from strataframe.operators import direction as D, nearest, sampling
from strataframe.plans import hashed, ordered, overlapping, quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    key = np.where(rng.random(3000) < 0.6, 0, rng.integers(1, 40, 3000))
    rows = [(i, int(k), float(v), int(w)) for i, (k, v, w) in enumerate(zip(key, np.round(rng.normal(size=3000), 1), rng.integers(0, 3, 3000)))]
    return spark.createDataFrame(rows, "id long, k long, v double, w long").repartition(5).cache()


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


@pytest.mark.parametrize("hot", [None, 50, 700])
def test_running_rank_and_lag(skewed, hot):
    w = Window.partitionBy("k").orderBy("v", "id")
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = skewed.select("id", F.row_number().over(w).cast("bigint").alias("rank"), F.sum("w").over(rows).alias("s"))
    same(plain, ordered.running(skewed, ["k"], ["v", "id"], {"s": F.col("w")}, hot_rows=hot))
    by_id = Window.partitionBy("k").orderBy("id")
    lag = skewed.select("id", F.lag("v").over(by_id).alias("p"))
    same(lag, ordered.lagged(skewed, ["k"], "id", {"p": "v"}, hot_rows=hot))


def test_running_over_the_whole_table(skewed):
    w = Window.orderBy("id")
    plain = skewed.select("id", F.row_number().over(w).cast("bigint").alias("rank"))
    same(plain, ordered.ranked(skewed, [], ["id"], hot_rows=100))


@pytest.mark.parametrize("values", [[f"sub-{i:08d}" for i in range(6000)], [7] * 6000, [None] * 6000])
def test_ranges_split_long_prefixes_and_ties(spark, values):
    """Common prefixes, equal values and nulls are still cut: the range follows all ordering columns."""
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"v {'string' if isinstance(values[0], str) else 'long'}, id long")
    cut, split = ordered.with_ranges(rows.repartition(4), [], ["v", "id"], 500)
    sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
    assert split and len(sizes) > 10 and max(sizes) < 1500
    ranked = ordered.ranked(rows.repartition(4), [], ["v", "id"], hot_rows=500)
    assert [r["rank"] for r in ranked.orderBy("id").collect()] == list(range(1, 6001))


def test_null_parts_keep_their_rows(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, id long")
    assert sorted(r["rank"] for r in hashed.hash_ranked(rows, 1, ["id"], ["k"]).collect()) == [1, 1, 2, 2]


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_percentiles_match_numpy(skewed, accuracy):
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = quantiles.exact_percentiles(skewed, ["k"], "v", probs, accuracy).toPandas()
    data = skewed.toPandas()
    for k, g in data.groupby("k"):
        mine = got[got.k == k].set_index("p").q
        assert [mine[p] for p in probs] == pytest.approx(list(np.quantile(g.v, probs)))
    whole = quantiles.exact_percentiles(skewed, [], "v", [0.1], accuracy).first()["q"]
    assert whole == pytest.approx(np.quantile(data.v, 0.1))


def test_hash_rank_and_exact_sample(skewed):
    got = {r["id"]: r["rank"] for r in hashed.hash_ranked(skewed, 5, ["id"], digits=1).collect()}
    want = sorted(range(3000), key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())
    assert [got[i] for i in want] == list(range(1, 3001))
    for n in (0, 1, 257, 3000, 9999):
        ids = {r["id"] for r in hashed.take_hashed(skewed, 5, ["id"], n, digits=1).collect()}
        assert ids == set(want[:n])


def test_folds_keep_groups_whole_and_balanced(skewed):
    f = sampling.stratified_group_folds(skewed.withColumn("y", F.col("k") % 2), "k", "y", 4).toPandas()
    assert f.k.is_unique and sorted(f.fold.unique()) == [0, 1, 2, 3]
    sizes = f.assign(y=f.k % 2).groupby(["y", "fold"]).size()
    assert sizes.max() - sizes.min() <= 1
    g = sampling.group_folds(skewed, "k", 4, hot_rows=3).toPandas()
    assert len(g) == len(f) and g.groupby("fold").size().max() - g.groupby("fold").size().min() <= 1
    loo = sampling.leave_one_out(skewed, "k")
    assert loo.where("fold <> k").count() == 0


def test_evenly_spaced_matches_linspace(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    for cap in (1, 2, 7, 50, 333, 400):
        got = sampling.evenly_spaced(df, ["k"], "id", cap, hot_rows=100).toPandas()
        for k, g in got.groupby("k"):
            ids = np.arange(k, 1000, 3)
            keep = ids if len(ids) <= cap else ids[np.linspace(0, len(ids) - 1, cap).astype(int)]
            assert sorted(g.id) == sorted(set(keep))


def test_split_sizes_and_degenerate_split(spark):
    df = spark.range(10).select(F.col("id").alias("subject_id"))
    s = sampling.subject_split(df, 0.25, 1)
    assert s.where("split = 'test'").count() == 2
    with pytest.raises(ValueError, match="degenerate"):
        sampling.subject_split(df.limit(1), 0.25)


@pytest.mark.parametrize("tile", [7, 4096])
def test_pairwise_cosine_paths_agree(spark, tile):
    rng = np.random.default_rng(2)
    s = np.repeat(np.arange(30), 6)
    y = np.tile([0, 0, 0, 1, 1, 1], 30)
    x = rng.normal(size=(180, 10)) + 0.7 * y[:, None]
    dirs = D.unit_directions(table(spark, x, s, y)).cache()
    d = np.stack([x[(s == i) & (y == 1)].mean(0) - x[(s == i) & (y == 0)].mean(0) for i in range(30)])
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    upper = (d @ d.T)[np.triu_indices(30, 1)]
    want = [np.median(upper), *np.percentile(upper, [25, 75])]
    direct = D.direction_consistency(dirs, tile=tile).first()
    counted = D.direction_consistency(dirs, tile=tile, bins=256).first()
    for r, tol in ((direct, 1e-12), (counted, 1e-6)):
        assert [r["c_bar"], r["iqr_low"], r["iqr_high"]] == pytest.approx(want, abs=tol)
    assert D.mean_cosine(dirs).first()["mean_cosine"] == pytest.approx(upper.mean())
    sets = dirs.withColumn("ds", F.lit("all")).unionByName(dirs.where("subject_id < 9").withColumn("ds", F.lit("some"))).unionByName(dirs.where("subject_id = 0").withColumn("ds", F.lit(None).cast("string")))
    by = {r.ds: (r.c_bar, r.iqr_low, r.iqr_high, r.n_subjects_paired) for r in D.direction_consistency_by(sets, "ds", tile=tile).collect()}
    some = (d[:9] @ d[:9].T)[np.triu_indices(9, 1)]
    assert by["all"] == pytest.approx((*want, 30), abs=1e-12) and by["some"] == pytest.approx((np.median(some), *np.percentile(some, [25, 75]), 9), abs=1e-12)
    assert np.isnan(by[None][0]) and by[None][3] == 1
    few = D.direction_consistency(dirs.where("subject_id = 0")).first()
    assert np.isnan(few["c_bar"]) and few["n_subjects_paired"] == 1


def test_cell_moments_paths_agree(spark):
    from strataframe.plans import moments

    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 7)) + 1e3
    s = np.where(rng.random(500) < 0.5, 0, rng.integers(0, 40, 500))
    y = rng.integers(0, 2, 500)
    df = table(spark, x, s, y, partitions=6).withColumn("name", F.when(F.col("subject_id") == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), "subject_id")))
    for keys in (["subject_id", "label"], ["name"], []):
        a = moments.cell_moments(df, keys).toPandas()
        b = moments.batch_cell_moments(df, keys).toPandas()
        if keys:
            a, b = (d.fillna({"name": ""}).sort_values(keys).reset_index(drop=True) if "name" in keys else d.sort_values(keys).reset_index(drop=True) for d in (a, b))
            assert a[keys].equals(b[keys])
        assert a.n.tolist() == b.n.tolist()
        assert np.allclose(np.stack(a["mean"]), np.stack(b["mean"]), rtol=1e-12)
        assert np.allclose(np.stack(a["within"]), np.stack(b["within"]), atol=1e-6)
    ragged = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "k long, x array<double>").coalesce(1)
    with pytest.raises(Exception, match="different width"):
        moments.batch_cell_moments(ragged, ["k"]).collect()


@pytest.mark.parametrize("held", [1 << 21, 1])
def test_percentiles_of_overlapping_sets(spark, held):
    rng = np.random.default_rng(4)
    n, width, sets = 400, 3, 5
    x = rng.normal(size=(n, width))
    x[:, 1] = np.maximum(np.round(x[:, 1], 1), 0.0)  # ties and a heavy zero
    x[:, 2] *= 10.0 ** rng.integers(-8, 8, n)
    member = rng.random((n, sets)) < 0.6
    member[:, 3], member[:, 4] = False, np.arange(n) == 7
    y = rng.integers(0, 2, n)
    rows = [([float(v) for v in a], int(t), [int(i) for i in np.flatnonzero(m)]) for a, t, m in zip(x, y, member)]
    df = spark.createDataFrame(rows, "x array<double>, y int, train array<int>").repartition(4)
    probs = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = overlapping.set_percentiles(df, sets, probs, held)
    for m in range(sets):
        own = x[member[:, m]]
        want = np.quantile(own, probs, axis=0) if len(own) else np.zeros((5, width))
        assert np.allclose(got[:, m], want, rtol=1e-12, atol=0), m
    count, pos, mean, variance = overlapping.set_moments(df, sets, lambda a, m: np.clip(a, -1, 1 + m))
    for m in (0, 1, 2, 4):
        own = np.clip(x[member[:, m]], -1, 1 + m)
        assert (count[m], pos[m]) == (len(own), y[member[:, m]].sum())
        assert np.allclose(mean[m], own.mean(0)) and np.allclose(variance[m], own.var(0))


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1000])
def test_keyed_bijections_are_bijections_and_spread(size):
    keys = draws.bijection_keys(3, 400, size)
    at = draws.bijected(np.arange(size), keys, size)
    assert (np.sort(at, axis=1) == np.arange(size)).all()
    assert (draws.bijected(np.arange(size)[::-1], keys[:5], size) == at[:5, ::-1]).all()  # each index by itself
    if size > 2:
        mean = at.mean(axis=0)  # every index lands everywhere: its mean place is the middle
        assert np.abs(mean - (size - 1) / 2).max() < 6 * size / np.sqrt(12 * 400)
        pairs = {tuple(p) for p in at[:, :2]}
        assert len(pairs) > 0.6 * min(400, size * (size - 1))


def best_imbalance(counts, k):
    """Least sum of squared label shares over all ways to deal the groups into folds."""
    share = counts / counts.sum(axis=0)
    best = np.inf
    for deal in itertools.product(range(k), repeat=len(counts)):
        best = min(best, sum((share[np.array(deal) == f].sum(axis=0) ** 2).sum() for f in range(k)))
    return best


def test_balanced_folds_are_close_to_the_best_deal(spark):
    rng = np.random.default_rng(9)
    for trial in range(3):
        counts = rng.integers(0, 6, (8, 2)) + np.array([[0, 1]])
        rows = [(g, y) for g in range(8) for y in range(2) for _ in range(counts[g, y])]
        got = sampling.balanced_group_folds(spark.createDataFrame(rows, "g long, y int"), "g", "y", 3, seed=trial).toPandas().set_index("g").fold
        share = counts / counts.sum(axis=0)
        mine = sum((share[(got.reindex(range(8)) == f).to_numpy()].sum(axis=0) ** 2).sum() for f in range(3))
        largest = (share**2).sum(axis=1).max()
        assert len(got) == 8 and mine <= best_imbalance(counts, 3) + largest


@pytest.mark.parametrize("part_groups", [20_000, 25])
def test_balanced_folds_of_mixed_groups(spark, part_groups):
    rng = np.random.default_rng(1)
    rows = [(g, None if y == 2 else int(y)) for g in range(150) for y in rng.choice(3, rng.integers(1, 12), p=[0.7, 0.2, 0.1])]
    df = spark.createDataFrame(rows, "g long, y int")
    folds = sampling.balanced_group_folds(df, "g", "y", 4, part_groups=part_groups)
    assert sorted(map(tuple, folds.collect())) == sorted(map(tuple, sampling.balanced_group_folds(df.repartition(5), "g", "y", 4, part_groups=part_groups).collect()))
    pdf = df.join(folds, "g").toPandas()
    pdf["y"] = pdf["y"].fillna(2)
    assert pdf.groupby("g").fold.nunique().max() == 1 and folds.count() == 150
    per = pdf.groupby(["y", "fold"]).size().unstack(fill_value=0)
    assert ((per.max(axis=1) - per.min(axis=1)) <= 11).all()


@pytest.mark.parametrize("shape", ["cloud", "flat", "one place", "far"])
def test_nearest_by_grid_equals_brute_force(spark, shape):
    rng = np.random.default_rng(6)
    t, p = rng.normal(size=(200, 3)), rng.normal(size=(90, 3))
    if shape == "flat":
        t[:, 1:], p[:, 1:] = np.round(t[:, 1:]), 0.0
        t[:, 0], p[:, 0] = rng.integers(0, 40, 200), rng.integers(-5, 60, 90) + 0.5  # many ties
    elif shape == "one place":
        t[:] = t[0]
    elif shape == "far":
        p[:30] += 1e4
    targets = spark.createDataFrame([(int(o), f"n{o}", *map(float, v)) for o, v in zip(rng.permutation(200), t)], "ord long, name string, x double, y double, z double")
    order = np.array([r.ord for r in targets.collect()])
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, x double, y double, z double")
    got = {r.id: r.found.ord for r in nearest.nearest(points, targets, "id", "ord").collect()}
    d2 = ((p[:, None] - t[None]) ** 2).sum(-1)
    for i in range(90):
        best = np.flatnonzero(d2[i] <= d2[i].min() * (1 + 1e-12))
        assert got[i] in order[best] and (len(best) > 1 and shape != "flat" or got[i] == order[best].min())
    assert nearest.nearest(points, targets.limit(0), "id", "ord").count() == 0 and nearest.nearest(points.limit(0), targets, "id", "ord").count() == 0


def test_nearest_moves_no_table_whole(spark):
    n = 1_000_000
    cloud = lambda seed: spark.range(n).select("id", *[(F.rand(seed + i) * 100).alias(a) for i, a in enumerate("xyz")])
    few = cloud(1).where("id % 2000 = 0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = nearest.nearest(few, cloud(7).withColumnRenamed("id", "ord"), "id", "ord")
        assert found.count() == 500
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_balanced_folds_of_many_parts_differ_by_no_more_than_a_group(spark):
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 4, (3000, 3))
    rows = [(g, y, int(counts[g, y])) for g in range(3000) for y in range(3) if counts[g, y]]
    df = spark.createDataFrame(rows, "g long, y int, n int").select("g", "y", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    folds = sampling.balanced_group_folds(df, "g", "y", 5, part_groups=60)
    per = df.join(folds, "g").groupBy("y", "fold").count().toPandas().pivot(index="y", columns="fold", values="count")
    assert folds.count() == (counts.sum(axis=1) > 0).sum()
    assert ((per.max(axis=1) - per.min(axis=1)) <= 3).all()


def test_set_sums_keep_counts_whole(spark):
    from strataframe.plans.overlapping import set_sums

    n = 8209
    rows = spark.range(0, n, 1, 61).where("id % 7 <> 3 or id < 4000").select(F.array(F.col("id").cast("double")).alias("x"), (F.col("id") % 2).cast("int").alias("y"), F.transform(F.filter(F.sequence(F.lit(0), F.lit(39)), lambda m: F.pmod(F.xxhash64("id", m), F.lit(5)) > 0), lambda m: m.cast("int")).alias("train"))
    wanted = {r["m"]: r["n"] for r in rows.select(F.explode("train").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = set_sums(rows, 40, lambda x, y, m: np.array([len(x), y.sum()], float))
    assert {m: s[0] for m, s in got.items()} == wanted


def test_ranges_of_hot_groups_stay_few(spark):
    from strataframe.plans import ordered

    df = spark.range(6000).select((F.col("id") * 7919 % 6007).alias("v"))
    cut, split = ordered.with_ranges(df, [], ["v"], 3)
    assert split and cut.select("_range").distinct().count() <= ordered.MOST_RANGES
    got = ordered.ranked(df, [], ["v"], "r", hot_rows=3).orderBy("v").toPandas()
    assert (got.r == np.arange(1, 6001)).all()


def test_percentile_brackets_go_to_the_rows(spark):
    from strataframe.plans.quantiles import exact_percentiles

    df = spark.range(4000).select((F.col("id") % 2).alias("k"), (F.col("id") * 37 % 4001).cast("double").alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = exact_percentiles(df, ["k"], "v", [0.5], accuracy=100)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        got = {r["k"]: r["q"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    pdf = df.toPandas()
    assert got == {k: np.percentile(g.v, 50) for k, g in pdf.groupby("k")}


def test_stretches_are_bounded_in_rows_and_bytes():
    import pyarrow as pa

    from strataframe.plans.moments import stretches

    batches = [pa.RecordBatch.from_pydict({"a": list(range(n))}) for n in (10, 0, 10, 10, 5)]
    assert [sum(b.num_rows for b in s) for s in stretches(batches, 1 << 20, 20)] == [20, 15]
    assert [len(s) for s in stretches(batches, 1, 100)] == [1, 1, 1, 1]
