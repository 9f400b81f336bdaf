"""Steps that the third round's findings name: each does its work once, on few rows, and right."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlines.functions import geometry as G
from planlines.operators import losses as X
from planlines.operators import raster as R
from planlines.plans.fixtures import IMAGES_PER_TASK, relation
from planlines.plans.inputs import Inputs
from planlines.sources import symbol_cache as C


def test_a_stroke_gives_one_span_a_row(spark):
    """Horizontal, vertical, steep, shallow and single-point strokes; before, every pixel was a span."""
    rows = [(0, 5, 5, 40, 5, 60, 50), (0, 9, 2, 9, 45, 60, 50), (0, 3, 30, 55, 37, 60, 50), (0, 30, 1, 37, 48, 60, 50), (0, 20, 20, 20, 20, 60, 50)]
    for n, row in enumerate(rows):
        x1, y1, x2, y2 = row[1:5]
        df = spark.createDataFrame([row], "image_id long, x1 int, y1 int, x2 int, y2 int, width int, height int")
        spans = R.stroke_spans(df, 4).collect()
        assert len({r["y"] for r in spans}) == len(spans)
        got = np.zeros((50, 60), bool)
        for r in spans:
            got[r["y"], r["x0"] : r["x1"] + 1] = True
        yy, xx = np.mgrid[:50, :60]
        dx, dy = x2 - x1, y2 - y1
        len2 = dx * dx + dy * dy
        dot, cross = (xx - x1) * dx + (yy - y1) * dy, (xx - x1) * dy - (yy - y1) * dx
        near = [4 * ((xx - a) ** 2 + (yy - b) ** 2) <= 16 for a, b in ((x1, y1), (x2, y2))]
        want = np.where(dot <= 0, near[0], np.where(dot >= len2, near[1], 4 * cross * cross <= 16 * len2))
        assert (got == want).all(), n


def test_runs_are_drawn_once(spark):
    """Readers of the line mask read a table; before, each of them drew all strokes."""
    q = Inputs(spark, "/root/testdata/sf0.001")
    assert "explode" not in q.runs._jdf.queryExecution().analyzed().toString().lower()
    assert q.runs.exceptAll(R.rasterize(R.chord_segments(q.chords, q.images), 4)).isEmpty()


def counted(df):
    """``df`` with an accumulator of the rows that tasks made of it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def test_cached_records_run_their_symbols_once(spark):
    rows = [("train", f"i{n % 3}", str(n), 0.0, 0.0, 1.0, 1.0, 0.5, [1.0, float(n)], n % 2 == 0) for n in range(40)]
    plain = spark.createDataFrame(rows, "split string, image string, id string, x1 double, y1 double, x2 double, y2 double, conf double, embedding array<float>, near_gt boolean")
    df, seen = counted(plain)
    records = C.cache_records(df, per_record=5).collect()
    assert sorted(int(s["id"]) for r in records for s in r["symbols"]) == list(range(40))
    assert seen.value == 40  # 80 before


def test_lovasz_reads_the_pixels_once(spark):
    logits, targets = np.array([2.0, -1.0, 0.5, 0.5, -3.0, 0.25]), np.array([1, 1, 0, 0, 0, 1])
    df, seen = counted(spark.createDataFrame([(1, float(z), int(t)) for z, t in zip(logits, targets)], "image_id long, logit double, target int"))
    got = X.lovasz_hinge(df, ["image_id"]).collect()
    errors = 1 - logits * (2 * targets - 1)
    order = np.argsort(-errors, kind="stable")
    t = targets[order]
    jaccard = 1 - (t.sum() - t.cumsum()) / (t.sum() + (1 - t).cumsum())
    want = (np.maximum(errors[order], 0) * np.diff(jaccard, prepend=0)).sum()
    assert got[0]["lovasz"] == pytest.approx(want)
    assert seen.value == 6  # 12 before


@pytest.mark.parametrize("width", [63, 64, 65, 200])
def test_masks_meet_pixels_by_words(spark, width):
    """Bits at word borders, shifts to both sides, rows without a run; no lambda over runs is left in the plan."""
    mask = np.random.default_rng(width).random((6, width)) < 0.4
    mask[2], mask[3] = False, True
    px = spark.createDataFrame([(7, int(y), int(x)) for y, x in zip(*np.nonzero(mask))], "image_id long, y int, x int")
    dense = spark.createDataFrame([(7, y, x) for y in range(6) for x in range(width)], "image_id long, y int, x int")
    out = R.attach_mask(dense, R.pixels_to_runs(px), {"here": 0, "left": 1, "right": -70})
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == 6 * width
    for r in rows:
        for name, shift in (("here", 0), ("left", 1), ("right", -70)):
            x = r["x"] - shift
            assert r[name] == (0 <= x < width and bool(mask[r["y"], x]))


def test_partitions_of_pixels_follow_the_images(spark, tmp_path):
    n = IMAGES_PER_TASK * 7
    spark.range(n).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    assert relation(spark, str(tmp_path), "pixels").rdd.getNumPartitions() == 7


@pytest.mark.parametrize("tile, stride", [(32, 24), (32, 32), (5, 1), (8, 11)])
def test_covering_tiles_are_one_sequence(spark, tile, stride):
    """Every position of every side, shorter than a tile too; no arrays are joined for a pixel."""
    df = spark.range(1, 100).selectExpr("cast(id as int) as side").selectExpr("side", "explode(sequence(0, side - 1)) as pos")
    out = df.select("side", "pos", G.covering_tiles(F.col("pos"), F.col("side"), tile, stride).alias("t"))
    assert "concat" not in out._jdf.queryExecution().analyzed().toString()
    for r in out.collect():
        n = max(1, -(-max(r["side"] - tile, 0) // stride) + 1)
        origins = [min(k * stride, max(0, r["side"] - tile)) for k in range(n)]
        assert r["t"] == [k for k, o in enumerate(origins) if o <= r["pos"] < o + tile]
