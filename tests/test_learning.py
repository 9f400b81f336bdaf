"""Clustering and classification against plain NumPy."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlines.operators import clusters as KM
from planlines.operators import models as ML
from planlines.operators import networks as N
from planlines.session import scratch_path, stage


def blobs(n=60, spread=0.5, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 8)) * 3
    return np.concatenate([c + rng.normal(size=(n, 8)) * spread for c in centres])


def vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def square(x, c):
    return ((x[:, None] - c[None]) ** 2).sum(axis=-1)


def plain_lloyd(x, c):
    for _ in range(300):
        near = square(x, c).argmin(axis=1)
        new = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        shift, c = ((new - c) ** 2).sum(), new
        if shift <= 1e-4 * x.var(axis=0).mean():
            break
    return c, square(x, c).min(axis=1).sum()


def plain_silhouette(x, label):
    d, out = np.sqrt(square(x, x)), []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == j].mean() for j in set(label.tolist()) - {label[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_all_fits_advance_as_plain_ones(spark):
    x = blobs()
    rows = KM.packed_rows(vectors(spark, x), "v", "id")
    ks, inits = [3, 5, 7], 4
    begun = KM.starts(rows, [(k, s) for k in ks for s in range(inits)])
    fits = KM.fit_all(rows, ks, inits)
    for fit, start in zip(fits, begun):
        centres, cost = plain_lloyd(x, start)
        assert fit.settled and np.allclose(fit.centres, centres) and np.isclose(fit.cost, cost) and fit.counts.sum() == len(x)
    for k in ks:
        assert KM.best(fits, k).cost == min(f.cost for f in fits if f.k == k)
    chosen, values = KM.pick_k(rows, fits)
    want = {k: plain_silhouette(x, square(x, KM.best(fits, k).centres).argmin(axis=1)) for k in ks}
    assert chosen == max(ks, key=want.get) == 5 and all(np.isclose(values[k], want[k], atol=1e-7) for k in ks)


def test_starts_are_rows_far_apart(spark):
    x = blobs(spread=0.01)
    rows = KM.packed_rows(vectors(spark, x), "v", "id")
    for start in KM.starts(rows, [(5, s) for s in range(5)]):
        assert all((square(x, start) < 1e-18).any(axis=0))  # every start is a row
        assert len({int(row) // 60 for row in square(x, start).argmin(axis=0)}) == 5  # one in each group


def test_clusters_of_few_and_no_rows(spark):
    same = vectors(spark, np.ones((6, 2)))
    rows = KM.packed_rows(same, "v", "id")
    fits = KM.fit_all(rows, [3], 2)
    assert all(f.cost == 0 and f.counts.sum() == 6 for f in fits)
    assert KM.pick_k(rows, fits)[1] == {3: None}  # one cluster holds all
    gaps = same.unionByName(spark.createDataFrame([(9, None)], same.schema))
    assert KM.packed_rows(gaps, "v", "id").count() == 6
    none = KM.packed_rows(same.limit(0), "v", "id")
    assert [len(f.centres) for f in KM.fit_all(none, [2], 2)] == [0, 0]
    assert KM.silhouettes(none.withColumn("c", F.lit(0)), ["c"]).first()["silhouette"] is None
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        KM.fit_all(KM.packed_rows(vectors(spark, blobs()), "v"), [7], 1, max_iter=1)
    assert any("without settling" in str(w.message) for w in seen)


def test_silhouettes_of_several_labellings(spark):
    rng = np.random.default_rng(5)
    x, a, b = rng.random((600, 4)), rng.integers(0, 4, 600), rng.integers(0, 2, 600)
    a[0] = 6  # a cluster of one, and two numbers nobody has
    df = spark.createDataFrame([(v.tolist(), int(p), int(q)) for v, p, q in zip(x, a, b)], "v array<double>, a int, b int")
    rows = KM.packed_rows(df, "v", "a", "b")
    got = {r["label"]: r for r in KM.silhouettes(rows, ["a", "b"]).collect()}
    assert got["a"]["n"] == 600 and np.isclose(got["a"]["silhouette"], plain_silhouette(x, a), atol=1e-7)
    assert np.isclose(got["b"]["silhouette"], plain_silhouette(x, b), atol=1e-7)
    some = KM.silhouettes(rows, ["a"], sample=200).first()
    assert 130 < some["n"] < 270 and abs(some["silhouette"] - got["a"]["silhouette"]) < 0.05


def test_cluster_count_by_silhouette(spark):
    rnd = np.random.default_rng(4)
    centres = [(0, 0), (10, 0), (0, 10)]
    rows = [(i, [float(c + rnd.normal() * 0.3) for c in centres[i % 3]]) for i in range(90)]
    vec = KM.packed_rows(spark.createDataFrame(rows, "id long, v array<double>"), "v")
    assert KM.pick_k(vec, KM.fit_all(vec, [2, 3, 5], inits=2))[0] == 3


def test_artifact_follows_from_its_rows(spark):
    """Every row lies with its nearest centroid, centroids are their rows' means, rates their labels' shares."""
    import __spark_entry__ as entry
    from planlines.plans.inputs import Inputs

    sf = "/root/testdata/sf0.001"
    got = sorted(entry.queries()["cluster_centroids"](spark, sf).collect())
    known = Inputs(spark, sf).labelled_symbols.filter("near_gt is not null").select("embedding", "near_gt").collect()
    x = np.array([r["embedding"] for r in known], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-8
    near, y = np.array([r["centroid"] for r in got]), np.array([r["near_gt"] for r in known])
    label = square(x, near).argmin(axis=1)
    assert len(got) in KM.K_CANDIDATES and {r["k"] for r in got} == {len(got)}
    for c, r in enumerate(got):
        assert r["n_members"] == (label == c).sum()
        if r["n_members"]:
            assert np.allclose(x[label == c].mean(axis=0), r["centroid"], atol=0.02) and np.isclose(r["p_near"], y[label == c].mean())
    value = plain_silhouette(x, label)
    rows = KM.unit_embeddings(Inputs(spark, sf).labelled_symbols.filter("near_gt is not null"))
    fits = KM.fit_all(rows, KM.K_CANDIDATES)  # ten for each
    others = [plain_silhouette(x, square(x, KM.best(fits, k).centres).argmin(axis=1)) for k in KM.K_CANDIDATES]
    assert value >= max(others) - 1e-6
    assert np.isclose(square(x, near).min(axis=1).sum(), KM.best(fits, len(got)).cost)


# networks


def rows_of(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), bool(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, features array<double>, y1 boolean")


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 6)), rng.integers(0, 2, 50).astype(float)
    for sizes in ([6, 8, 1], [6, 1], [6, 5, 4, 1]):
        layers = N.Layers.start(sizes, 3)
        g, _ = layers.gradient(x, y)
        for j in range(0, len(layers.flat), 3):
            values = []
            for e in (1e-6, -1e-6):
                moved = layers.flat.copy()
                moved[j] += e
                values.append(N.Layers(sizes, moved).gradient(x, y)[1])
            assert abs((values[0] - values[1]) / 2e-6 - g[j]) < 1e-4


def plain_network(x, y, role, hidden, seed=0):
    """The same training over whole arrays."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / scale
    layers = N.Layers.start([x.shape[1], hidden, 1], seed)
    adam, rng, best, idle = N.Adam(len(layers.flat)), np.random.default_rng(seed), (-1.0, None), 0
    for epoch in range(200):
        for b in rng.permutation(N.batches_of(len(x))):
            mine = role == b
            g, _ = layers.gradient(z[mine], y[mine])
            layers.flat = layers.flat + adam.step((g + N.PENALTY * layers.penalty()) / mine.sum())
        out = role == -1
        accuracy = ((layers.probability(z[out]) >= 0.5) == (y[out] > 0.5)).mean()
        idle = 0 if accuracy > best[0] + 1e-4 else idle + 1
        if accuracy > best[0]:
            best = accuracy, layers.flat.copy()
        if idle >= 10:
            return best[1], epoch
    raise AssertionError("not settled")


def test_network_equals_a_plain_run(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 5)) * [1, 5, 0.1, 2, 1] + 3
    y = ((x[:, 0] - 3) * (x[:, 1] - 3) > 0).astype(float)
    df = stage(rows_of(spark, x, y))
    role = np.array([r["role"] for r in df.select("id", N.roles("id", N.batches_of(700)).alias("role")).orderBy("id").collect()])
    assert set(role.tolist()) == {-1, 0, 1, 2}
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        net = N.network(df, "features", "y1", "id", hidden=6)
    want, _ = plain_network(x, y, role, 6)
    assert np.allclose(net.getOrDefault(net.weights), want, atol=1e-9)


def test_saved_pipeline_scores_raw_features(spark, tmp_path):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    x = np.column_stack([y * 2 + rng.normal(size=300), 1000 + 50 * rng.normal(size=300), np.full(300, 7.0)])
    df = stage(rows_of(spark, x, y))
    net = N.logistic(df, "features", "y1")
    path = scratch_path(spark, "artifact")
    N.save(path, net, spark.createDataFrame([("logreg", 0.9, 0.8, 3, ["train"], 300, 0)], N.META))
    model, meta = N.load(spark.newSession(), path)
    p = np.array([r["p"] for r in model.transform(df).orderBy("id").collect()])
    flat = np.array(net.getOrDefault(net.weights))
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    assert np.allclose(p, 1 / (1 + np.exp(-(z @ flat[:3] + flat[3])))) and meta.first()["n_train"] == 300
    assert model.transform(df.limit(0)).count() == 0
    gap = spark.createDataFrame([(1, None, True)], df.schema)
    assert model.transform(gap).first()["p"] is None


def test_classifier_learns_and_picks_a_model(spark):
    rnd = np.random.default_rng(0)
    y = rnd.integers(0, 2, 400)
    x = np.column_stack([y * 2 + rnd.normal(size=400), rnd.normal(size=400)])
    df = stage(rows_of(spark, x, y))
    train, valid = df.filter("id < 300"), df.filter("id >= 300")
    results, best = N.candidates(train, valid, "features", "y1", "id")
    assert {r[0] for r in results} == {"logreg", "mlp"} and best is not None and all(r[2] > 0.85 for r in results)
    results, best = N.candidates(train, df.filter("y1"), "features", "y1", "id", names=("logreg",))
    assert best is None and results[0][2] is None
    for rows in (train.filter("y1"), train.limit(0)):  # a class is missing
        results, best = N.candidates(rows, valid, "features", "y1", "id")
        assert best is None and [r[1:] for r in results] == [(None, None)] * 2
    with pytest.raises(ValueError, match="no rows"):
        ML.fit_logreg(train.limit(0), "y1", 0)


def test_copies_weigh_as_rows(spark):
    """Copies are one row with a weight: fits and silhouettes are those of all rows, also where tiles are many."""
    rng = np.random.default_rng(8)
    x, label, n = rng.normal(size=(70, 4)), rng.integers(0, 3, 70), rng.integers(1, 30, 70)
    wide, tags = np.repeat(x, n, axis=0), np.repeat(label, n)
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(wide, tags)], "v array<double>, c int")
    rows = KM.packed_rows(df, "v", "c")
    distinct = KM.collapsed(rows)
    assert distinct.count() == 70 and distinct.agg(F.sum("weight")).first()[0] == n.sum()
    for fit, start in zip(KM.fit_all(rows, [4], 3), KM.starts(rows, [(4, s) for s in range(3)])):
        centres, cost = plain_lloyd(wide, start)
        assert np.allclose(fit.centres, centres) and np.isclose(fit.cost, cost) and fit.counts.sum() == n.sum()
    want = plain_silhouette(wide, tags)
    most = KM.TILE_ROWS
    for held in (most, 9):
        KM.TILE_ROWS = held
        try:
            got = KM.silhouettes(rows, ["c"]).first()
        finally:
            KM.TILE_ROWS = most
        assert got["n"] == n.sum() and np.isclose(got["silhouette"], want, atol=1e-6)
