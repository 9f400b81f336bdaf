"""Steps whose growth the third round's findings project."""

import numpy as np
import pytest

from planlines.operators import clusters as KM


def test_fits_read_matrices(spark):
    """Sums, counts and costs of sets of several K against brute force, from written matrices; before, arrays of doubles."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(KM.BLOCK + 300, 6)), 2, axis=0)
    rows = KM.packed_rows(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>"), "v")
    packed = KM.blocks(rows)
    assert not any(t.startswith("array") for _, t in packed.dtypes)
    held = [np.frombuffer(r["weights"]) for r in packed.collect()]
    assert sum(w.sum() for w in held) == len(x) and max(map(len, held)) <= KM.BLOCK
    sets = {0: rng.normal(size=(3, 6)), 4: rng.normal(size=(7, 6)), 5: np.repeat(rng.normal(size=(1, 6)), 2, axis=0)}
    for f, (sums, counts, cost) in KM.advance(packed, sets).items():
        far = ((x[:, None] - sets[f]) ** 2).sum(axis=2)
        near = far.argmin(axis=1)
        assert cost == pytest.approx(far.min(axis=1).sum())
        if f != 5:  # equal centroids: which one counts is open
            assert counts.tolist() == np.bincount(near, minlength=len(sets[f])).tolist()
            for k in range(len(sets[f])):
                assert np.allclose(sums[k], x[near == k].sum(axis=0))
