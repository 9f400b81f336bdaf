"""Jobs that the fourth round's findings name read all of their rows."""

import numpy as np
import pytest

from planlines.operators import clusters as KM
from planlines.plans import queries_symbols as Q
from planlines.plans.inputs import Inputs


def silhouette_of(x, tags):
    far = np.sqrt(np.maximum(((x * x).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * x @ x.T), 0))
    np.fill_diagonal(far, 0)
    counts = np.bincount(tags)
    sums = np.column_stack([far[:, tags == k].sum(axis=1) for k in range(len(counts))])
    own = np.arange(len(x)), tags
    a = sums[own] / np.maximum(counts[tags] - 1, 1)
    mean = sums / counts
    mean[own] = np.inf
    b = mean.min(axis=1)
    return np.where(counts[tags] > 1, (b - a) / np.maximum(a, b), 0.0).mean()


@pytest.fixture
def many_vectors(spark, monkeypatch):
    """6,500 distinct unit vectors around three directions, fits of fixed centroids, and the silhouettes that choose K."""
    rng = np.random.default_rng(4)
    groups = np.eye(64)[:3]
    x = groups[rng.integers(0, 3, 6500)] + 0.08 * rng.normal(size=(6500, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    centres = {2: groups[:2], 3: groups, 5: np.concatenate([groups, x[:2]])}
    monkeypatch.setattr(KM, "K_CANDIDATES", list(centres))
    monkeypatch.setattr(KM, "fit_all", lambda rows, ks: [KM.Fit(k, 0, centres[k], cost=0.0) for k in ks])
    seen, plain = {}, KM.silhouettes

    def silhouettes(*args):
        out = plain(*args)
        seen.update({int(r["label"][1:]): r for r in out.collect()})
        return out

    monkeypatch.setattr(KM, "silhouettes", silhouettes)
    rows = [(i, bool(i % 2), v.tolist()) for i, v in enumerate(x)]
    unit = x.astype(float) / (np.linalg.norm(x.astype(float), axis=1, keepdims=True) + 1e-8)
    want = {k: silhouette_of(unit, ((unit[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)) for k, c in centres.items()}
    return spark.createDataFrame(rows, "crop_id long, near_gt boolean, embedding array<float>"), seen, want


def test_cluster_artifact_scores_all_vectors(spark, many_vectors):
    """K is chosen by the silhouettes of all vectors; before, of about 5,000."""
    labelled, seen, want = many_vectors
    q = Inputs(spark, "/root/testdata/sf0.001")
    q.labelled_symbols = labelled
    assert Q.cluster_artifact(q).collect() == [(6500, 64, 0)]
    assert {k: r["n"] for k, r in seen.items()} == dict.fromkeys(want, 6500)
    assert {k: r["silhouette"] for k, r in seen.items()} == pytest.approx(want, abs=1e-7)


def test_symbol_mining_scores_all_vectors(spark, monkeypatch, many_vectors):
    """The K of the mined clusters is the one whose silhouette of all vectors is highest; before, of about 5,000."""
    labelled, seen, want = many_vectors
    monkeypatch.setattr(Q, "_mined", lambda q: labelled)
    rows = Q.symbol_mining(Inputs(spark, "/root/testdata/sf0.001")).collect()
    best = max(want, key=want.get)
    assert {r["k"] for r in rows} == {best} and len(rows) == best and sum(r["n_members"] for r in rows) == 6500
    assert {k: r["n"] for k, r in seen.items()} == dict.fromkeys(want, 6500)
