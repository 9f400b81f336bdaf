"""Components of many small groups, as radius sweeps ask for them."""

import numpy as np
import pytest

from planlines.operators import graph


@pytest.mark.parametrize("most", [0, 40, 1 << 17])
def test_small_groups_settle_without_rounds(spark, monkeypatch, most):
    """Long paths, rings and hubs in many groups of several keys; groups above the limit take the rounds."""
    rounds = []
    step = graph._large_star
    monkeypatch.setattr(graph, "_large_star", lambda *a: rounds.append(1) or step(*a))
    monkeypatch.setattr(graph, "GROUP_EDGES", most)
    monkeypatch.setattr(graph, "CHUNK_EDGES", 64)
    rng = np.random.default_rng(5)
    nodes, edges, want = [], [], {}
    for g in range(12):
        for r in (0.5, 2.0):
            n = 10 + 5 * g
            name = rng.permutation(1000)[:n].tolist()
            pairs = [(i, i + 1) for i in range(n // 2)] + [(n // 2 + 1, i) for i in range(n // 2 + 2, n - 1)] if r < 1 else [(i, (i + 7) % n) for i in range(n)]
            root = list(range(n))
            for _ in range(n):
                for a, b in pairs:
                    root[a] = root[b] = min(root[a], root[b], key=lambda k: name[k])
            nodes += [(g, r, v) for v in name]
            edges += [(g, r, *((name[a], name[b]) if rng.random() < 0.5 else (name[b], name[a]))) for a, b in pairs + pairs[:3]]
            want |= {(g, r, name[i]): name[root[i]] for i in range(n)}
    got = graph.connected_components(
        spark.createDataFrame(nodes, "g long, r double, n long"), spark.createDataFrame(edges, "g long, r double, u long, v long"), ["g", "r"]).collect()
    assert {(t["g"], t["r"], t["n"]): t["component"] for t in got} == want and len(got) == len(nodes)
    assert bool(rounds) == (most < 1 << 17)  # before, always rounds
