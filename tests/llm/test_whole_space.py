"""The latent space of the decontamination is that of all passages."""

import numpy as np
import pytest

from planlines.llm import latent


@pytest.fixture
def share_of_best(spark, monkeypatch):
    """``work`` on 600 passages of 60 topics; the share of what 64 dimensions can hold of them that its latent space holds."""
    monkeypatch.setattr(latent, "SAMPLE_PASSAGES", 30)
    seen, plain = [], latent.latent_space

    def latent_space(rows, idf, *args, **kwargs):
        seen.append((idf, plain(rows, idf, *args, **kwargs)))
        return seen[-1][1]

    monkeypatch.setattr(latent, "latent_space", latent_space)
    rng = np.random.default_rng(6)
    passages = [[f"t{d % 60}w{i}" for i in rng.integers(0, 40, 48)] for d in range(600)]
    texts = [(d, " ".join(w for p in passages[2 * d : 2 * d + 2] for w in p)) for d in range(300)]  # two passages a text
    item = [f"t0w{i}" for i in range(40)]

    def share(work) -> float:
        work(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
        (idf, v), known = seen[0], latent.Slots()
        x = np.zeros((601, latent.SLOTS))
        for row, words in zip(x, [*passages, item]):
            np.add.at(row, latent.slots_of([w.encode() for w in words], known), 1)
        x *= idf
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        u, s, _ = np.linalg.svd(v / idf[:, None], full_matrices=False)
        best = np.linalg.svd(x, compute_uv=False)[: latent.DIMS]
        return float(((x @ u[:, s > 1e-6 * s[0]]) ** 2).sum() / (best**2).sum())

    return share


def test_space_is_fitted_on_all_passages(share_of_best):
    """Before, on SAMPLE_PASSAGES of them, about."""
    assert share_of_best(lambda docs, items: latent.find(docs, items).collect()) > 0.95


def test_pipeline_fits_its_space_on_all_passages(spark, share_of_best, tmp_path):
    """The pipeline's fourth stage; before, on SAMPLE_PASSAGES of them, about."""
    from corpus_pipeline import decontamination

    def stage(docs, items):
        items.write.parquet(str(tmp_path / "benchmark.parquet"))
        decontamination(spark, docs, str(tmp_path)).collect()

    assert share_of_best(stage) > 0.95
