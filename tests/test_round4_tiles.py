"""Scores of sliding tiles, stitched by blocks."""

import numpy as np
import pytest

from planlines.operators import metrics as E
from planlines.operators import tiles as T
from planlines.plans import queries_pixels as Q
from planlines.plans.inputs import Inputs
from planlines.functions import scoring as SC
from pyspark.sql import functions as F


@pytest.mark.parametrize("tile, stride, strides", [(8, 6, 1), (8, 6, 2), (8, 8, 2), (5, 2, 3), (6, 9, 1), (8, 6, 16)])
def test_blocks_stitch_as_tiles_do(spark, monkeypatch, tile, stride, strides):
    """A model that looks at places and neighbours; images below a tile, holes, a missing image, fractions; blocks of few strides."""
    monkeypatch.setattr(T, "BLOCK_STRIDES", strides)
    rng = np.random.default_rng(tile)
    sizes = {1: (5, 4), 2: (23, 31), 3: (8, 8), 4: (41, 17), 5: (20, 20)}  # height, width
    images = spark.createDataFrame([(i, w, h) for i, (h, w) in sizes.items() if i != 5], "image_id long, width int, height int")
    rows = [(i, y, x, *(float(v) for v in (rng.random(3) * 255 if i == 4 else rng.integers(0, 256, 3))))
            for i, (h, w) in sizes.items() for y in range(h) for x in range(w) if i != 2 or rng.random() < 0.9 and not (10 < y < 21 and x < 12)]
    pixels = spark.createDataFrame(rows, "image_id long, y int, x int, r double, g double, b double")
    ramp = np.add.outer(np.arange(tile), 2 * np.arange(tile)) / tile

    def model(rgb):
        assert rgb.shape == (3, tile, tile) and rgb.dtype == np.float32
        return rgb.sum(axis=0) + np.roll(rgb[0], 1, axis=1) - ramp

    want = E.stitch(T.score_tiles(pixels, images, tile, stride, model).withColumn("p", SC.sigmoid(F.col("logit"))))
    want = {(r["image_id"], r["y"], r["x"]): r["p"] for r in want.collect()}
    for table in (pixels, pixels.filter("image_id < 4").select("image_id", "y", "x", *[F.col(c).cast("int").alias(c) for c in "rgb"])):
        got = T.stitched_scores(table.repartition(3, "x"), images, tile, stride, model).collect()
        found = {(r["image_id"], r["y"], r["x"]): r["p"] for r in got}
        assert len(found) == len(got) and found == pytest.approx({k: v for k, v in want.items() if k[0] < 4 or table is pixels}, abs=1e-12)


def test_score_tiles_joins_no_pixels(spark):
    """Pixels reach their blocks in one exchange; before, they met the images in a join and came back by tiles."""
    plan = Q.score_tiles(Inputs(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 2
