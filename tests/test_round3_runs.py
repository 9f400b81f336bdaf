"""The symbol filter on row runs, and masks that meet as words."""

import numpy as np
import pytest

from planlines.operators import metrics as E
from planlines.operators import morphology as M
from planlines.operators import raster as R
from planlines.plans import queries_pixels as Q
from planlines.plans.inputs import Inputs


def pixels_of(spark, masks):
    return spark.createDataFrame([(i, int(y), int(x)) for i, m in masks.items() for y, x in zip(*np.nonzero(m))], "image_id long, y int, x int")


@pytest.mark.parametrize("band", [1, 5, 256])
def test_runs_are_labelled_as_pixels(spark, monkeypatch, band):
    """Noise, a spiral over many bands, diagonals, full and single-pixel masks."""
    monkeypatch.setattr(M, "STACK", 64)
    rng = np.random.default_rng(band)
    spiral = np.zeros((23, 23), bool)
    for k in range(0, 11, 2):
        spiral[k, k : 23 - k] = spiral[22 - k, k : 23 - k] = spiral[k : 23 - k, 22 - k] = spiral[k + 2 : 23 - k, k] = True
    masks = {1: rng.random((40, 70)) < 0.35, 2: rng.random((31, 130)) < 0.6, 3: spiral, 4: np.eye(30, dtype=bool)[:, ::-1], 5: np.ones((9, 65), bool), 6: np.eye(1, dtype=bool)}
    px = pixels_of(spark, masks)
    got = R.runs_to_pixels(M.label_runs(R.pixels_to_runs(px), band), ["image_id", "component"])
    want = M.label_pixels(px).select("image_id", "component", "y", "x")
    assert got.count() == want.count() and got.select(want.columns).exceptAll(want).isEmpty()


def test_rows_find_the_run_that_holds_them(spark):
    runs = spark.createDataFrame([(1, 0, 2, 5, 10), (1, 0, 8, 8, 11), (1, 1, 0, 9, 12), (2, 0, 2, 5, 13)], "image_id long, y int, x0 int, x1 int, component long")
    rows = [(1, 0, 2, 5, "a"), (1, 0, 3, 6, "no"), (1, 0, 8, 8, "b"), (1, 0, 0, 0, "no"), (1, 0, 7, 7, "no"), (1, 1, 0, 0, "c"), (1, 1, 0, 0, "c"), (2, 0, 5, 5, "d"), (3, 0, 1, 1, "no")]
    out = R.containing_run(spark.createDataFrame(rows, "image_id long, y int, x0 int, x1 int, name string"), runs, "component").collect()
    assert sorted((r["name"], r["component"]) for r in out) == [("a", 10), ("b", 11), ("c", 12), ("c", 12), ("d", 13)]


def test_filter_reads_no_pixel_table(spark):
    """Labels stay row runs; before, every pixel was labelled, joined and written."""
    parts = Q.given_filter(Inputs(spark, "/root/testdata/sf0.001"))
    assert {"x0", "x1"} <= set(parts["labels"].columns) & set(parts["labelled"].columns)


def test_masks_meet_as_words(spark):
    rng = np.random.default_rng(1)
    gt, pred = ({i: rng.random((20, 130)) < 0.3 for i in (1, 2)} for _ in range(2))
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    out = E.image_metrics(images, pixels_of(spark, gt).unionByName(pixels_of(spark, gt)), pixels_of(spark, pred))
    assert "bit_or" in out._jdf.queryExecution().analyzed().toString().lower()  # before, a row a pixel
    for r in out.collect():
        g, p = (m.get(r["image_id"], np.zeros((20, 130), bool)) for m in (gt, pred))
        assert (r["tp"], r["fp"], r["fn"], r["gt_count"], r["pred_count"]) == ((g & p).sum(), (~g & p).sum(), (g & ~p).sum(), g.sum(), p.sum())
