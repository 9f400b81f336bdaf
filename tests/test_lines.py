"""Polyline reconstruction on hand-made shapes."""

import pytest
from pyspark.sql import functions as F

from planlines.operators import lines as L
from planlines.operators.graph import connected_components


def chords_of(spark, shapes):
    rows, n = [], 0
    for image, segs in enumerate(shapes):
        for x1, y1, x2, y2 in segs:
            rows.append((image, n, float(x1), float(y1), float(x2), float(y2)))
            n += 1
    return spark.createDataFrame(rows, "image_id long, chord_id long, x1 double, y1 double, x2 double, y2 double")


Y_JUNCTION = [(0, 0, 50, 50), (51, 50, 100, 0), (50, 51, 50, 120)]
SQUARE = [(0, 0, 100, 0), (100, 1, 100, 100), (100, 100, 0, 101), (0, 100, 0, 0)]
LOLLIPOP = [(0, 0, 100, 0), (100, 0, 200, 50), (200, 50, 200, -50), (200, -50, 100, 0)]
LONG_CHAIN = [(i * 40, 0, i * 40 + 40, (i % 2)) for i in range(9)]
STACKED = [(0, 0, 60, 0)] * 5 + [(60, 0, 0, 0)] * 3


def build(spark, shapes, radius=10.0):
    ch = chords_of(spark, shapes)
    clusters = L.endpoint_clusters(L.chord_endpoints(ch), radius)
    edges, vertices = L.merged_edges(clusters), L.merged_vertices(clusters)
    chains = L.polyline_edges(edges)
    return clusters, edges, vertices, chains


def test_shapes(spark):
    _, edges, vertices, chains = build(spark, [Y_JUNCTION, SQUARE, LOLLIPOP, LONG_CHAIN, STACKED])
    got = {}
    for r in L.polyline_summary(chains, vertices).collect():
        got.setdefault(r["image_id"], []).append((r["n_points"], r["closed"], r["pure_cycle"]))
    assert sorted(got[0]) == [(2, False, False)] * 3
    assert got[1] == [(5, True, True)]
    assert sorted(got[2]) == [(2, False, False), (4, True, False)]
    assert got[3] == [(10, False, False)]
    assert got[4] == [(2, False, False)]
    # every edge appears exactly once
    und = chains.select("image_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    assert sorted(map(tuple, und.collect())) == sorted(map(tuple, edges.select("image_id", "u", "v").collect()))


def test_points_are_in_walking_order(spark):
    _, _, vertices, chains = build(spark, [LONG_CHAIN, SQUARE])
    pts = L.polylines(chains, vertices).orderBy("image_id", "seq").collect()
    xs = [r["x"] for r in pts if r["image_id"] == 0]
    assert xs == sorted(xs) or xs == sorted(xs, reverse=True)
    ring = [r["root"] for r in pts if r["image_id"] == 1]
    assert ring[0] == ring[-1] == min(ring) and len(set(ring)) == 4 and ring[1] < ring[-2]


def test_single_linkage_and_radius_zero(spark):
    # ends 8 apart in a row: linked through each other although the outer ones are 24 apart
    row = [(i * 8, 0, 500 + i * 100, 300) for i in range(4)]
    clusters, *_ = build(spark, [row])
    assert clusters.filter("y = 0").select("root").distinct().count() == 1
    clusters, *_ = build(spark, [[(0, 0, 50, 0), (0, 0, 0, 50)]], radius=0.0)
    assert clusters.select("root").distinct().count() == 4


@pytest.mark.parametrize("radius", [3.0, 10.0])
def test_clusters_match_brute_force(spark, radius):
    import random

    rnd = random.Random(5)
    segs = [tuple(rnd.uniform(0, 120) for _ in range(4)) for _ in range(60)]
    clusters, *_ = build(spark, [segs], radius)
    rows = clusters.collect()
    pts = {r["end_id"]: (r["x"], r["y"]) for r in rows}
    root = {e: e for e in pts}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in pts:
        for b in pts:
            if a < b and (pts[a][0] - pts[b][0]) ** 2 + (pts[a][1] - pts[b][1]) ** 2 <= radius**2:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    assert {r["end_id"]: r["root"] for r in rows} == {e: find(e) for e in pts}


def test_components_of_hub_path_and_any_partitioning(spark):
    hub = [(0, 1000, i) for i in range(300)]
    path = [(1, i, i + 1) for i in range(64)]
    edges = spark.createDataFrame(hub + path, "g long, u long, v long")
    nodes = spark.createDataFrame([(0, i) for i in [*range(300), 1000, 2000]] + [(1, i) for i in range(65)], "g long, n long")
    for parts in (1, 7):
        rows = connected_components(nodes, edges.repartition(parts), ["g"]).collect()
        lab = {(r["g"], r["n"]): r["component"] for r in rows}
        assert len(lab) == 367 and lab[(0, 2000)] == 2000
        assert {v for k, v in lab.items() if k != (0, 2000)} == {0}


def test_endpoint_pairs_count_copies_once(spark):
    ends = L.chord_endpoints(chords_of(spark, [[(0, 0, 5, 0)] * 40]))
    (row,) = L.endpoint_pairs(ends, 10.0).collect()
    assert (row["n_a"], row["n_b"], row["d2"]) == (40, 40, 25.0)
