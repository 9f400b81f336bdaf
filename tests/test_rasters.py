"""Rasters, components, skeletons and soft morphology against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlines.operators import morphology as M
from planlines.operators import raster as R
from planlines.operators import tiles as T


def pixels_of(spark, *masks):
    rows = [(i, int(y), int(x)) for i, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "image_id long, y int, x int")


def images_of(spark, *shapes):
    return spark.createDataFrame([(i, w, h) for i, (h, w) in enumerate(shapes)], "image_id long, width int, height int")


def as_mask(df, shape, image=0):
    m = np.zeros(shape, dtype=bool)
    for r in df.filter(F.col("image_id") == image).select("y", "x").collect():
        m[r["y"], r["x"]] = True
    return m


def flood(mask):
    """First pixel of every 8-connected component, by search."""
    lab, out = {}, np.full(mask.shape, -1)
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x] >= 0:
            continue
        stack, key = [(y, x)], y * (1 << 24) + x
        out[y, x] = key
        while stack:
            cy, cx = stack.pop()
            for ny in range(max(0, cy - 1), min(mask.shape[0], cy + 2)):
                for nx in range(max(0, cx - 1), min(mask.shape[1], cx + 2)):
                    if mask[ny, nx] and out[ny, nx] < 0:
                        out[ny, nx] = key
                        stack.append((ny, nx))
    return out


def blobs(seed, shape=(70, 90), p=0.42):
    return np.random.default_rng(seed).random(shape) < p


@pytest.mark.parametrize("tile", [8, 32, 256])
def test_components_do_not_depend_on_tiles(spark, tile):
    m = blobs(1)
    want = flood(m)
    px = pixels_of(spark, m)
    rows = M.label_pixels(px.unionByName(px), tile).collect()  # copies must not matter
    assert len(rows) == m.sum()
    assert all(want[r["y"], r["x"]] == r["component"] for r in rows)


def test_snake_across_tiles_is_one_component(spark):
    m = np.zeros((64, 64), dtype=bool)
    for k, y in enumerate(range(0, 64, 4)):
        m[y, :] = True
        m[y : y + 5, 63 if k % 2 == 0 else 0] = True
    labels = M.label_pixels(pixels_of(spark, m), 16)
    assert labels.select("component").distinct().count() == 1


@pytest.mark.parametrize("tile,halo", [(16, 9), (256, 33)])
def test_skeleton_equals_whole_image_thinning(spark, tile, halo):
    m = np.zeros((80, 100), dtype=bool)
    m[10:18, 5:90] = True
    m[10:70, 40:46] = True
    m[60:62, 60:62] = True  # lone 2×2 block
    m[75, 3] = True  # single pixel
    m[50:66, 70:86] = True  # solid square
    want, settled = M.thin(m, 200)
    assert settled
    rows = M.skeletonize(pixels_of(spark, m), tile, halo).collect()
    got = np.zeros_like(m)
    for r in rows:
        got[r["y"], r["x"]] = True
    assert (got == want).all()
    ring = sum(r.astype(int) for r in M._ring(want))
    assert all(ring[r["y"], r["x"]] == r["degree"] for r in rows)


@pytest.mark.parametrize("seed", range(12))
def test_thinning_keeps_every_component(seed):
    m = blobs(seed, (40, 40), 0.3 + 0.04 * seed)
    thin, _ = M.thin(m, 100)
    assert not (thin & ~m).any()
    before, after = flood(m), flood(thin)
    assert len(np.unique(before[m])) == len(np.unique(after[thin]))
    assert set(np.unique(before[thin])) == set(np.unique(before[m]))


def test_thin_four_pixel_bar():
    m = np.zeros((12, 40), dtype=bool)
    m[4:8, 3:37] = True
    thin, _ = M.thin(m, 50)
    assert thin.any() and thin.sum(axis=0).max() == 1 and thin.sum() >= 28


def test_soft_skeleton_matches_whole_image(spark):
    rng = np.random.default_rng(3)
    v = rng.random((40, 50))
    rows = [(0, y, x, float(v[y, x])) for y in range(40) for x in range(50)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, p double")

    def pool(a, dy, dx, op, fill):
        p = np.pad(a, ((dy, dy), (dx, dx)), constant_values=fill)
        h, w = a.shape
        return op.reduce([p[i : i + h, j : j + w] for i in range(2 * dy + 1) for j in range(2 * dx + 1)])

    def erode(a):
        return np.minimum(pool(a, 1, 0, np.minimum, np.inf), pool(a, 0, 1, np.minimum, np.inf))

    def opening(a):
        return pool(erode(a), 1, 1, np.maximum, -np.inf)

    img, skel = v, np.maximum(v - opening(v), 0)
    for _ in range(3):
        img = erode(img)
        d = np.maximum(img - opening(img), 0)
        skel = skel + np.maximum(d - skel * d, 0)
    for tile in (16, 256):
        got = {(r["y"], r["x"]): r["skel_p"] for r in M.soft_skeleton(df, ["p"], 3, tile).collect()}
        assert len(got) == v.size and max(abs(got[k] - skel[k]) for k in got) < 1e-12
    opened = {(r["y"], r["x"]): r["opened"] for r in M.soft_open(df, "p").collect()}
    want = opening(v)
    assert all(opened[k] == want[k] for k in opened)


def test_runs_and_dilation(spark):
    m = blobs(4, (50, 60), 0.2)
    px, im = pixels_of(spark, m), images_of(spark, m.shape)
    runs = R.pixels_to_runs(px)
    assert (as_mask(R.runs_to_pixels(runs), m.shape) == m).all()
    for radius in (0, 3, 5):
        want = np.zeros_like(m)
        kernel = R.disc_rows(radius)
        for y, x in zip(*np.nonzero(m)):
            for dy, hw in kernel:
                if 0 <= y + dy < m.shape[0]:
                    want[y + dy, max(0, x - hw) : x + hw + 1] = True
        assert (as_mask(R.runs_to_pixels(R.dilate(runs, im, radius)), m.shape) == want).all()


def test_boxes_touching_every_alignment(spark):
    rng = np.random.default_rng(9)
    m = rng.random((40, 48)) < 0.02
    px = pixels_of(spark, m)
    boxes = []
    for i in range(400):
        x0, y0 = rng.integers(0, 46), rng.integers(0, 38)
        boxes.append((0, i, int(x0), int(y0), int(rng.integers(x0 + 1, 49)), int(rng.integers(y0 + 1, 41))))
    df = spark.createDataFrame(boxes, "image_id long, box long, ix1 int, iy1 int, ix2 int, iy2 int")
    got = {r["box"] for r in R.boxes_touching(df, R.run_cells(R.pixels_to_runs(px))).collect()}
    assert got == {b[1] for b in boxes if m[b[3] : b[5], b[2] : b[4]].any()}


def test_stroke_matches_brute_force_and_dedupes(spark):
    segs = [(0, 3, 4, 30, 11, 40, 30), (0, 20, 2, 20, 25, 40, 30), (0, -5, 10, 60, 12, 40, 30), (0, 7, 7, 7, 7, 40, 30)]
    df = spark.createDataFrame(segs * 3, "image_id long, x1 int, y1 int, x2 int, y2 int, width int, height int")
    want = np.zeros((30, 40), dtype=bool)
    for _, x1, y1, x2, y2, w, h in segs:
        for y in range(h):
            for x in range(w):
                dx, dy = x2 - x1, y2 - y1
                t = 0.0 if dx == dy == 0 else min(1.0, max(0.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
                if (x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2 <= 4 + 1e-9:
                    want[y, x] = True
    assert (as_mask(R.runs_to_pixels(R.rasterize(df, 4)), (30, 40)) == want).all()


def test_tiles_small_image_is_padded(spark):
    im = images_of(spark, (5, 7), (40, 50))
    px = spark.createDataFrame([(i, y, x, 9, 9, 9) for i, (h, w) in enumerate([(5, 7), (40, 50)]) for y in range(h) for x in range(w)],
                               "image_id long, y int, x int, r int, g int, b int")
    runs = spark.createDataFrame([(0, 2, 1, 3)], "image_id long, y int, x0 int, x1 int")
    cells = T.tile_pixels(px, im, runs, 16, 12)
    per = cells.groupBy("image_id", "tile_row", "tile_col").agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sum("target").alias("t"))
    got = {(r["image_id"], r["tile_row"], r["tile_col"]): (r["n"], r["r"], r["t"]) for r in per.collect()}
    assert got[(0, 0, 0)] == (256, 35 * 9, 3)
    assert {k[1:] for k in got if k[0] == 1} == {(r, c) for r in (0, 12, 24) for c in (0, 12, 24, 34)}
    assert all(v == (256, 256 * 9, 0) for k, v in got.items() if k[0] == 1)
    tiles = {tuple(r) for r in R.positive_tiles(runs, im, 16, 12).collect()}
    assert tiles == {(0, 0, 0)}


def test_rotations_match_numpy(spark):
    t = 5
    a = np.arange(t * t).reshape(t, t)
    cells = spark.createDataFrame([(0, 0, 0, y, x, int(a[y, x])) for y in range(t) for x in range(t)],
                                  "image_id long, tile_row int, tile_col int, ly int, lx int, v int")
    for k in (1, 2, 3):
        draw = lambda name: F.lit({"h": 0.0, "v": 0.9, "r": 0.0, "k": (k - 0.5) / 3}[name])
        want = np.rot90(np.fliplr(a), k)
        for r in T.augment_tiles(cells, t, ["image_id"], draw=draw).collect():
            assert want[r["ly"], r["lx"]] == r["v"]


def test_sampling_without_lines_falls_back(spark):
    im = images_of(spark, (40, 50), (10, 12))
    none = spark.createDataFrame([], "image_id long, pno long, seq long, x double, y double")
    rows = T.sample_tiles(im, none, 16, 4).collect()
    assert len(rows) == 8
    assert all(0 <= r["tile_row"] <= 24 and 0 <= r["tile_col"] <= 34 for r in rows)
    assert all((r["tile_row"], r["tile_col"]) == (0, 0) for r in rows if r["image_id"] == 1)


def test_skeleton_endpoints_fallbacks(spark):
    rows = [(0, 1, 5, x, 2 if 0 < x < 9 else 1) for x in range(10)]  # a line: its two ends
    rows += [(0, 2, 0, 0, 0)]  # single pixel: itself
    rows += [(0, 3, y, x, 2) for y, x in [(20, 20), (20, 21), (20, 22), (21, 22), (22, 22), (22, 21), (22, 20), (21, 20)]]  # ring
    df = spark.createDataFrame(rows, "image_id long, component long, y int, x int, degree int")
    got = {}
    for r in M.skeleton_endpoints(df, ["image_id", "component"]).collect():
        got.setdefault(r["component"], []).append((r["y"], r["x"]))
    assert sorted(got[1]) == [(5, 0), (5, 9)]
    assert got[2] == [(0, 0)]
    assert sorted(got[3]) == [(20, 20), (22, 22)]


def test_thinning_runs_the_front_only(spark):
    """A wide block settles late: its tiles and their neighbours go on, thin strokes elsewhere are carried."""
    mask = np.zeros((400, 400), bool)
    mask[10:14, 5:395] = True
    mask[200:390, 200:280] = True
    mask[30:380, 20:23] = True
    rows = [(1, int(y), int(x)) for y, x in np.argwhere(mask)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int")
    trace: list[int] = []
    got = M.skeletonize(px, tile=40, halo=17, trace=trace)
    want, settled = M.thin(mask, 1000)
    assert settled and {(r["y"], r["x"]) for r in got.collect()} == set(map(tuple, np.argwhere(want).tolist()))
    degree = {(r["y"], r["x"]): r["degree"] for r in got.collect()}
    ring = sum(r.astype(int) for r in M._ring(want))
    assert all(ring[y, x] == d for (y, x), d in degree.items())
    assert len(trace) > 3 and trace[-1] == 0 and trace[0] < 20 and sorted(trace, reverse=True) == trace


def test_tiles_thinned_as_samples_of_their_own(spark):
    rng = np.random.default_rng(3)
    shape = (75, 90)
    gt, pred = (np.zeros(shape, bool) for _ in range(2))
    for m in (gt, pred):
        for _ in range(9):
            y, x = rng.integers(0, 60), rng.integers(0, 70)
            m[y : y + rng.integers(2, 40), x : x + rng.integers(2, 8)] = True
            m[y : y + 3, x : x + rng.integers(3, 50)] = True
    frame = lambda m: spark.createDataFrame([(1, int(y), int(x)) for y, x in np.argwhere(m)], "image_id long, y int, x int")
    images = spark.createDataFrame([(1, 90, 75)], "image_id long, width int, height int")
    got = {(r["tile_row"], r["tile_col"]): tuple(r)[3:] for r in M.tile_skeletons(frame(gt), frame(pred), images, 32, 24).collect()}
    want = {}
    for row in (0, 24, 43):
        for col in (0, 24, 48, 58):
            g, p = gt[row : row + 32, col : col + 32], pred[row : row + 32, col : col + 32]
            gs, ps = M.thin(g, 100)[0], M.thin(p, 100)[0]
            if g.any() or p.any():
                want[row, col] = tuple(int(v.sum()) for v in (g, p, g & p, gs, ps, ps & g, gs & p))
    assert got == want


def test_dense_tables_travel_as_row_pieces(spark):
    """Soft opening among existing cells, rows in any order: one exchange, and no pixel is a row in it."""
    rng = np.random.default_rng(11)
    v, there = rng.random((40, 50)), rng.random((40, 50)) < 0.9
    rows = [(0, int(y), int(x), float(v[y, x])) for y, x in rng.permutation(np.argwhere(there))]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, p double")

    def near(a, fill, op, steps):
        p = np.pad(np.where(there, a, fill), 1, constant_values=fill)
        return op.reduce([p[1 + dy : 41 + dy, 1 + dx : 51 + dx] for dy, dx in steps])

    eroded = near(v, np.inf, np.minimum, [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)])
    wide = near(eroded, -np.inf, np.maximum, [(0, -1), (0, 0), (0, 1)])
    want = near(wide, -np.inf, np.maximum, [(-1, 0), (0, 0), (1, 0)])
    for tile in (16, 256):
        out = M.soft_open(df, "p", tile=tile)
        got = out.collect()
        assert len(got) == there.sum() and all(r["opened"] == want[r["y"], r["x"]] and r["eroded"] == eroded[r["y"], r["x"]] for r in got)
    plan = M.soft_open(df, "p")._jdf.queryExecution().executedPlan().toString()  # not run yet: one plan
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_tiles_thinned_over_several_batches(spark, monkeypatch):
    rng = np.random.default_rng(12)
    masks = [rng.random((70, 150)) < 0.6 for _ in range(3)]
    px, images = pixels_of(spark, *masks), images_of(spark, *[(70, 150)] * 3)
    none = px.filter("false")
    for stack in (1 << 16, 40):
        monkeypatch.setattr(M, "STACK", stack)
        got = {tuple(r)[:3]: (r["n_gt"], r["gt_skel"], r["n_pred"]) for r in M.tile_skeletons(px, none, images, 32, 24).coalesce(1).collect()}
        for (i, row, col), counts in got.items():
            cut = masks[i][row : row + 32, col : col + 32]
            assert counts == (cut.sum(), M.thin(cut, 100)[0].sum(), 0)
        assert len(got) == 3 * 3 * 6
    words = M.tile_words(px, px.filter("x % 3 = 0"), images, 32, 24)
    for r in M.tile_counts(words, 32).collect():
        cut = masks[r["image_id"]][r["tile_row"] : r["tile_row"] + 32, r["tile_col"] : r["tile_col"] + 32]
        third = (np.arange(cut.shape[1]) + r["tile_col"]) % 3 == 0
        assert (r["n_gt"], r["n_pred"], r["n_both"]) == (cut.sum(), (cut & third).sum(), (cut & third).sum())
