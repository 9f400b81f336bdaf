"""Suppression, ranking, metrics, losses and symbol rules against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from planlines.functions import geometry as G
from planlines.operators import boxes as B
from planlines.operators import losses as X
from planlines.operators import metrics as E
from planlines.operators import models as ML
from planlines.operators import ranking as K
from planlines.operators import raster as R
from planlines.operators import symbols as Y
from planlines.sources import symbol_cache as C

DET = "image_id long, det_id long, x1 double, y1 double, x2 double, y2 double, conf double"


def greedy(dets, t, conf_t):
    rows = [d for d in dets if (d[6] or 0.0) >= conf_t]
    rows.sort(key=lambda d: -(d[6] or 0.0))

    def iou(a, b):
        inter = max(0.0, min(a[4], b[4]) - max(a[2], b[2])) * max(0.0, min(a[5], b[5]) - max(a[3], b[3]))
        if inter == 0:
            return 0.0
        denom = (a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - inter
        return inter / denom if denom > 0 else 0.0

    keep = []
    while rows:
        best = rows.pop(0)
        keep.append(best[1])
        rows = [d for d in rows if iou(best, d) < t]
    return set(keep)


@pytest.mark.parametrize("t", [0.3, 0.5, 0.9])
def test_nms_equals_greedy(spark, t):
    rnd = random.Random(int(t * 10))
    dets = []
    for i in range(400):
        image = i % 3
        x, y = rnd.uniform(0, 60 if image else 12), rnd.uniform(0, 60 if image else 12)
        w, h = 2 ** rnd.uniform(0, 6), 2 ** rnd.uniform(0, 6)
        conf = rnd.choice([None, 0.0, rnd.choice([0.4, 0.5, 0.6]), rnd.random()])
        dets.append((image, i, x, y, x + (0 if i % 50 == 7 else w), y + h, conf))
    dets += [(5, 1000 + i, 1.0, 1.0, 9.0, 9.0, 0.5) for i in range(60)]  # copies
    df = spark.createDataFrame(dets, DET)
    got = {r["det_id"] for r in B.nms(df, ["image_id"], "det_id", t, 0.2).collect()}
    want = set().union(*[greedy([d for d in dets if d[0] == im], t, 0.2) for im in (0, 1, 2, 5)])
    assert got == want


def test_normalize_rules(spark):
    recs = [
        '{"id": 7, "x1": 1, "y1": 2, "x2": 5, "y2": 6, "conf": 0}', '{"ID": "a", "x1": "1", "y1": "2", "x2": "5", "y2": "6.5", "confidence": 0.25, "class": 4, "label": "v"}',
        '{"id": "", "crop_id": "c", "x1": 1, "y1": 2, "x2": 5, "y2": 6, "conf": null, "confidence": 0.3}', '{"x1": 1, "y1": 2, "x2": 5, "y2": 6}',
        '{"id": 1, "x1": "no", "y1": 2, "x2": 5, "y2": 6}', '{"id": 2, "x1": 5, "y1": 2, "x2": 5, "y2": 6}', '{"id": 3, "x1": 1, "y1": 2, "x2": 5}',
    ]
    df = spark.createDataFrame([(r,) for r in recs], "record string")
    got = {r["crop_id"]: (r["confidence"], r["class_id"], r["class_name"]) for r in B.normalize_detections(df).collect()}
    assert got == {"7": (1.0, 0, "symbol"), "a": (0.25, 4, "v"), "c": (1.0, 0, "symbol")}


def test_inner_box_cases(spark):
    rows = [(0, 10.0, 10.0, 20.0, 20.0), (1, 10.5, 10.0, 11.5, 30.0), (2, 5.0, 5.0, 5.0, 9.0), (3, -50.0, -50.0, -40.0, -40.0), (4, 2.5, 2.5, 12.5, 12.5)]
    df = spark.createDataFrame(rows, "b long, x1 double, y1 double, x2 double, y2 double")
    box = G.inner_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(100), F.lit(80), 0.3)
    got = {r["b"]: r["i"] and tuple(r["i"]) for r in df.select("b", box.alias("i")).collect()}
    assert got[0] == (13, 13, 17, 17, False)
    assert got[1] == (10, 10, 12, 31, True)  # collapsed: the full box
    assert got[2] is None and got[3] is None
    assert got[4] == (round(5.5), round(5.5), round(9.5), round(9.5), False)  # half-even


def test_near_line_pierce_graze_and_unknown(spark):
    images = spark.createDataFrame([(0, 100, 100), (1, 100, 100)], "image_id long, width int, height int")
    runs = spark.createDataFrame([(0, 50, 0, 60)], "image_id long, y int, x0 int, x1 int")
    boxes = spark.createDataFrame(
        [(0, 1, 20.0, 40.0, 40.0, 60.0), (0, 2, 20.0, 49.0, 40.0, 80.0), (0, 3, 50.0, 40.0, 80.0, 60.0), (0, 4, 70.0, 10.0, 80.0, 20.0),
         (0, 5, 5.0, 5.0, 5.0, 9.0), (1, 6, 0.0, 0.0, 90.0, 90.0), (9, 7, 0.0, 0.0, 9.0, 9.0)],
        "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r["box_id"]: r["near_gt"] for r in Y.near_line(boxes, images, runs, "box_id").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: None}


@pytest.mark.parametrize("hot", [False, True])
def test_running_totals_with_one_hot_group(spark, hot):
    rnd = random.Random(3)
    rows = [(0 if hot or i % 3 == 0 else i % 5, i, rnd.randint(-5, 9)) for i in range(2000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, o long, v long")
    out = K.running(df, ["g"], [F.col("o").desc()], {"s": ("sum", "v"), "m": ("max", "v")}).collect()
    want = {}
    for g, o, v in sorted(rows, key=lambda r: -r[1]):
        s, m = want.get(g, (0, -99))
        want[g] = (s + v, max(m, v))
        want[(g, o)] = want[g]
    assert len(out) == 2000
    assert all((r["s"], r["m"]) == want[(r["g"], r["o"])] for r in out)
    assert all((r["s_total"], r["m_total"]) == want[r["g"]] for r in out)


def test_percentiles_equal_numpy(spark):
    rnd = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rnd.random(501)] + [("b", 1.0), ("b", 2.0), ("b", 4.0), ("b", 8.0), ("c", None)] + [("d", 3.0)] * 50
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    got = {r["g"]: tuple(r[k] for k in probs) for r in K.percentiles(df, ["g"], "v", probs).collect()}
    assert got["b"] == (1.75, 3.0, 5.0) and got["d"] == (3.0, 3.0, 3.0) and "c" not in got
    assert np.allclose(got["a"], np.percentile([v for g, v in rows if g == "a"], [25, 50, 75]))


def test_auc_ties_transform_and_single_class(spark):
    rnd = random.Random(2)
    rows = [("a", rnd.randint(0, 20) / 20, rnd.random() < 0.4) for _ in range(300)] + [("b", 0.3, True), ("b", 0.4, True)]
    df = spark.createDataFrame(rows, "g string, p double, y boolean")
    pos, neg = ([p for g, p, y in rows if g == "a" and y == want] for want in (True, False))
    brute = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    got = {r["g"]: r["auc"] for r in K.roc_auc(df, ["g"], "p", "y").collect()}
    assert math.isclose(got["a"], brute) and got["b"] is None
    moved = {r["g"]: r["auc"] for r in K.roc_auc(df.withColumn("p", F.exp("p") * 7), ["g"], "p", "y").collect()}
    assert math.isclose(moved["a"], brute)


def test_lovasz_matches_sorted_sum(spark):
    rnd = np.random.default_rng(7)
    z, t = rnd.normal(size=400).round(1), (rnd.random(400) < 0.3).astype(int)
    rows = [(0, float(a), int(b)) for a, b in zip(z, t)] + [(1, -2.0, 0), (1, -0.5, 0), (2, 5.0, 1)]
    df = spark.createDataFrame(rows, "image_id long, logit double, target int")

    def brute(z, t):
        err = 1 - z * (2 * t - 1)
        o = np.argsort(-err, kind="stable")
        e, g = err[o], t[o]
        jac = 1 - (g.sum() - g.cumsum()) / (g.sum() + (1 - g).cumsum())
        return float((np.maximum(e, 0) * np.diff(jac, prepend=0)).sum())

    got = {r["image_id"]: r["lovasz"] for r in X.lovasz_hinge(df, ["image_id"]).collect()}
    assert math.isclose(got[0], brute(z, t), rel_tol=1e-9)
    assert math.isclose(got[1], brute(np.array([-2.0, -0.5]), np.array([0, 0]))) and got[2] == 0.0


def test_overlap_edge_cases(spark):
    images = spark.createDataFrame([(0,), (1,), (2,)], "image_id long")
    gt = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (1, 0, 0)], "image_id long, y int, x int")
    pred = spark.createDataFrame([(0, 1, 2), (0, 1, 2), (0, 5, 5)], "image_id long, y int, x int")
    got = {r["image_id"]: r for r in E.image_metrics(images, gt, pred).collect()}
    assert (got[0]["tp"], got[0]["fp"], got[0]["fn"]) == (1, 1, 1) and math.isclose(got[0]["dice"], 0.5, abs_tol=1e-6)
    assert got[2]["dice"] == 1.0 and got[1]["dice"] < 1e-5
    with_len = {r["image_id"]: r for r in E.with_skeleton_lengths(E.image_metrics(images, gt, pred), gt, pred.distinct()).collect()}
    assert with_len[0]["len_skel_ratio"] == 1.0 and with_len[2]["len_skel_ratio"] is None
    flags = E.flag_pixels({"gt": gt, "pred": pred}, ["image_id", "y", "x"])
    row = E.pooled_overlap(flags.withColumn("g", F.lit(0)), ["g"]).first()
    assert math.isclose(row["dice"], 2 * row["iou"] / (1 + row["iou"]), abs_tol=1e-5)
    empty = E.centreline_dice(gt, pred, gt.limit(0), pred.limit(0), ["image_id", "y", "x"], ["image_id"])
    assert all(r["cldice"] == 0.0 for r in empty.collect())


def test_stitch_of_constant_tiles_is_constant(spark):
    images = spark.createDataFrame([(0, 50, 40)], "image_id long, width int, height int")
    px = spark.range(40 * 50).select(F.lit(0).cast("long").alias("image_id"), F.floor(F.col("id") / 50).cast("int").alias("y"), (F.col("id") % 50).cast("int").alias("x"))
    out = E.stitch(R.to_tiles(px, images, 16, 12).withColumn("p", F.lit(0.25)))
    assert out.count() == 2000 and out.filter("p <> 0.25").isEmpty()


def test_component_decisions_rules(spark):
    comps = {1: [0.9, 0.1], 2: [0.1, None], 3: [0.1], 4: [None], 5: [0.5], 6: []}
    labels = spark.createDataFrame([(0, c, i, 0) for c in comps for i in range(20)] + [(0, 7, i, 9) for i in range(20)], "image_id long, component long, y int, x int")
    pred = labels.filter("component <> 7")
    skel = spark.createDataFrame([(0, c, i, 0) for c in comps if c != 6 for i in range(40 if c == 3 else 5)], "image_id long, component long, y int, x int")
    ends = spark.createDataFrame([(0, c, i, 0, p) for c, ps in comps.items() for i, p in enumerate(ps)], "image_id long, component long, y int, x int, max_p double")
    got = {r["component"]: (r["fate"], r["reason"]) for r in Y.component_decisions(labels, pred, skel, ends, min_drop_skel_px=30).collect()}
    assert got == {1: ("keep", "irrigation_endpoint"), 2: ("drop", "callout_endpoint_short_skel"), 3: ("keep", "callout_endpoint_but_long_skel"),
                   4: ("keep", "no_strong_signal"), 5: ("keep", "no_strong_signal"), 6: ("keep", "no_endpoints")}
    plain = {r["component"]: r["reason"] for r in Y.component_decisions(labels, pred, skel, ends).collect()}
    assert plain[3] == "callout_endpoint_only"
    big = Y.component_decisions(labels, pred, skel, ends, min_component_px=21)
    assert big.isEmpty()


def test_silhouette_matches_brute_force(spark):
    rnd = np.random.default_rng(5)
    v, lab = rnd.random((60, 4)), rnd.integers(0, 4, 60)
    lab[0] = 9  # a cluster of one scores 0
    df = spark.createDataFrame([(i, int(lab[i]), [float(x) for x in v[i]]) for i in range(60)], "id long, label int, v array<double>")
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    s = []
    for i in range(60):
        own = (lab == lab[i]) & (np.arange(60) != i)
        if not own.any():
            s.append(0.0)
            continue
        a, b = d[i][own].mean(), min(d[i][lab == k].mean() for k in set(lab) if k != lab[i])
        s.append((b - a) / max(a, b))
    row = ML.silhouette(df, "v", "label").first()
    assert row["n"] == 60 and math.isclose(row["silhouette"], float(np.mean(s)), abs_tol=1e-9)
    many = spark.range(7000).selectExpr("CAST(id % 2 AS INT) AS label", "array(CAST(id % 2 AS DOUBLE) * 9, id % 7 * 0.01) AS v")
    row = ML.silhouette(many, "v", "label").first()
    assert row["n"] == 7000 and row["silhouette"] > 0.99
    assert ML.silhouette(many.filter("label = 0"), "v", "label").first()["silhouette"] is None


def test_strict_embeddings_refuse_a_gap(spark):
    det = spark.createDataFrame([(1,), (2,)], "id long")
    emb = spark.createDataFrame([(1, [0.5])], "id long, embedding array<float>")
    assert C.attach_embeddings(det, emb, "id").count() == 1
    with pytest.raises(PySparkException, match="no embedding for 2"):
        C.attach_embeddings(det, emb, "id", strict=True).collect()


def test_joins_by_cells_are_never_broadcast(spark):
    """Boxes and positions grow by the cells they reach: a small file may be a large hash table on the driver."""
    from planlines.operators import boxes as B
    from planlines.operators import spatial as S
    from planlines.operators import symbols as Y
    from planlines.session import stage

    dets = stage(spark.range(50).selectExpr("id AS det_id", "id % 5 AS image_id", "double(id) AS x1", "double(id) AS y1", "double(id + 9) AS x2", "double(id + 9) AS y2", "0.5D AS conf"))
    images = stage(spark.range(5).selectExpr("id AS image_id", "90 AS width", "90 AS height"))
    runs = stage(spark.range(5).selectExpr("id AS image_id", "20 AS y", "10 AS x0", "30 AS x1"))

    def joins(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "Join" in line]

    centred = joins(Y.near_line_centre(dets, images, runs, "det_id", 4.0))
    assert any("SortMergeJoin" in j and "bx" in j for j in centred) and not any("Broadcast" in j and "bx" in j for j in centred)
    side = dets.selectExpr("image_id", "det_id", "x1 AS ax", "y1 AS ay")
    near = joins(S.within_radius(side, dets.select("image_id", "x2", "y2"), 5.0, ["image_id"], ("ax", "ay"), ("x2", "y2")))
    assert near and not any("Broadcast" in j for j in near)
    pairs = joins(B.iou_pairs(dets, ["image_id"], "det_id"))
    assert pairs and not any("Broadcast" in j for j in pairs)
    kept = B.nms(dets, ["image_id"], "det_id")
    assert any("SortMergeJoin" in j for j in joins(kept)) and not any("Broadcast" in j for j in joins(kept))


def test_records_are_parsed_once(spark):
    """The filter on parsed fields tests the parsed map: one parse in the whole plan, after the records are dealt."""
    from planlines.operators import boxes as B

    raw = spark.createDataFrame([(1, '{"id": "a", "x1": 0, "y1": 0, "x2": "3", "y2": 2, "conf": 0}'), (2, "no record"), (3, None)], "det_id long, record string")
    out = B.normalize_detections(raw, keep=["det_id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "Repartition" in plan
    assert [(r["det_id"], r["crop_id"], r["x2"], r["confidence"]) for r in out.collect()] == [(1, "a", 3.0, 1.0)]
