"""Small fixtures and brute-force references for the tests."""

import numpy as np

SCHEMA = "row_id long, subject_id long, recording_id long, label int, x array<double>"


def table(spark, x, subject, label, recording=None, partitions=3):
    rec = subject if recording is None else recording
    rows = [(i, int(s), int(r), int(y), [float(v) for v in v_]) for i, (v_, s, r, y) in enumerate(zip(x, subject, rec, label))]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def planted(n_subj=20, n_rec=10, dims=200, offset=2.0, sd_subject=1.0, sd_noise=0.5, seed=0):
    rng = np.random.default_rng(seed)
    x, s, y = [], [], []
    for label in (0, 1):
        for i in range(n_subj):
            centre = (2 * label - 1) * offset + rng.normal(0, sd_subject, dims)
            for _ in range(n_rec):
                x.append(centre + rng.normal(0, sd_noise, dims))
                s.append(label * n_subj + i)
                y.append(label)
    return np.array(x), np.array(s), np.array(y)


def group_ss(x, keys):
    grand = x.mean(0)
    return sum((keys == k).sum() * (x[keys == k].mean(0) - grand) ** 2 for k in np.unique(keys))


def identity_cohort(seed=0, n_subj=6, per=40, dims=32):
    rng = np.random.default_rng(seed)
    axis = rng.normal(size=dims)
    axis /= np.linalg.norm(axis)
    x, s, y, r = [], [], [], []
    for i in range(n_subj):
        offset = 3.0 * rng.normal(size=dims)
        for label in (0, 1):
            for w in range(per):
                x.append(offset + 0.4 * (2 * label - 1) * axis + 0.5 * rng.normal(size=dims))
                s.append(i)
                y.append(label)
                r.append(i * 4 + label * 2 + w % 2)
    return np.array(x), np.array(s), np.array(y), np.array(r)
