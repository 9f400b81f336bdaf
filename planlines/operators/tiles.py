"""Training-tile operators: pixels of a tile, seeded flips, sampling, user scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlines.functions import geometry as G
from planlines.operators import raster as R
from planlines.operators.morphology import grouped_batches, piece_values, row_pieces
from planlines.operators.ranking import row_numbers
from planlines.session import fanout_partitions

#: Side of the blocks of ``stitched_scores``, in strides.
BLOCK_STRIDES = 16


def tile_pixels(pixels: DataFrame, images: DataFrame, runs: DataFrame, tile: int, stride: int) -> DataFrame:
    """RGB and 0/1 target of every cell of every tile; cells past the image are zero."""
    flagged = R.attach_mask(pixels.select("image_id", "y", "x", "r", "g", "b"), runs, {"target": 0})
    inside = R.to_tiles(flagged, images, tile, stride).select(
        "image_id", "tile_row", "tile_col", "ly", "lx", "r", "g", "b", F.col("target").cast("int").alias("target")
    )
    zero = [F.lit(0).alias(c) for c in ("r", "g", "b", "target")]
    return inside.unionByName(R.padding_cells(images, tile, stride).select("*", *zero))


def flip_h(y: Column, x: Column, tile: int) -> tuple[Column, Column]:
    return y, F.lit(tile - 1) - x


def flip_v(y: Column, x: Column, tile: int) -> tuple[Column, Column]:
    return F.lit(tile - 1) - y, x


def rotate90(y: Column, x: Column, k: int, tile: int) -> tuple[Column, Column]:
    """k counter-clockwise quarter turns."""
    for _ in range(k % 4):
        y, x = F.lit(tile - 1) - x, y
    return y, x


def augment_tiles(cells: DataFrame, tile: int, key: list[str], hflip: float = 0.5, vflip: float = 0.5,
                  rot: float = 0.5, seed: int = 0, draw: Callable[[str], Column] | None = None) -> DataFrame:
    """Flip and rotate whole tiles; each choice is a hash draw in [0, 1) of the tile key.

    ``draw(name)`` may replace the hash, e.g. by a rule another engine shares.
    """
    if draw is None:
        def draw(name: str) -> Column:
            return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *key), F.lit(1_000_000)) / 1_000_000

    y, x = F.col("ly"), F.col("lx")
    do_h, do_v, do_r = draw("h") < hflip, draw("v") < vflip, draw("r") < rot
    hy, hx = flip_h(y, x, tile)
    y, x = F.when(do_h, hy).otherwise(y), F.when(do_h, hx).otherwise(x)
    vy, vx = flip_v(y, x, tile)
    y, x = F.when(do_v, vy).otherwise(y), F.when(do_v, vx).otherwise(x)
    turns = F.floor(draw("k") * 3).cast("int") + 1
    ty, tx = y, x
    for k in (1, 2, 3):
        ry, rx = rotate90(y, x, k, tile)
        ty = F.when(do_r & (turns == k), ry).otherwise(ty)
        tx = F.when(do_r & (turns == k), rx).otherwise(tx)
    return cells.withColumns({"ly": ty, "lx": tx})


def sample_tiles(images: DataFrame, points: DataFrame, tile: int, per_image: int = 8, jitter: float = 0.25,
                 draw: Callable[[str], Column] | None = None, seed: int = 0) -> DataFrame:
    """Random tiles centred with jitter on polyline vertices, clamped to the image.

    ``points`` is the long polyline form with a 0-based polyline number ``pno`` and
    point number ``seq``. Draws: ``per_image`` per image with polylines; the image,
    the polyline and the vertex follow from hashes of the draw number. Without any
    polyline every image gets uniform origins instead.
    """
    if draw is None:
        def draw(name: str) -> Column:
            return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "draw"), F.lit(1 << 30))

    sizes = points.groupBy("image_id", "pno").agg(F.count("*").alias("n_points"))
    per = sizes.groupBy("image_id").agg(F.count("*").alias("n_lines"))
    ids = row_numbers(per, [], [F.col("image_id")], "ino") if not per.isEmpty() else None
    half, jit = tile // 2, int(jitter * tile)

    def place(centre: Column, side: str, name: str) -> Column:
        shift = (draw(name) % (2 * jit + 1)).cast("int") - jit if jit > 0 else F.lit(0)
        return G.clip(centre - half + shift, 0, F.greatest(F.lit(0), F.col(side) - tile)).cast("int")

    if ids is None:
        draws = images.select("*", F.explode(F.sequence(F.lit(0), F.lit(per_image - 1))).alias("j"))
        draws = draws.withColumn("draw", F.col("image_id") * per_image + F.col("j"))
        row = draw("row") % (F.greatest(F.lit(0), F.col("height") - tile) + 1)
        col = draw("col") % (F.greatest(F.lit(0), F.col("width") - tile) + 1)
        return draws.select("draw", "image_id", row.cast("int").alias("tile_row"), col.cast("int").alias("tile_col"))
    n = per.agg(F.count("*").alias("n")).scalar()
    drawn = (
        per.select(F.explode(F.sequence(F.lit(0), F.lit(per_image - 1))).alias("j"), "image_id")
        .join(ids.select("image_id", (F.col("ino") - 1).alias("ino")), "image_id")
        .select((F.col("ino") * per_image + F.col("j")).alias("draw"))
        .withColumn("ino", draw("image") % n)
    )
    chosen = drawn.join(ids.select((F.col("ino") - 1).alias("ino"), "image_id", "n_lines"), "ino")
    chosen = chosen.withColumn("pno", draw("line") % F.col("n_lines")).join(sizes, ["image_id", "pno"])
    chosen = chosen.withColumn("seq", draw("point") % F.col("n_points")).join(
        points.select("image_id", "pno", "seq", "x", "y"), ["image_id", "pno", "seq"]
    )
    sized = chosen.join(images.select("image_id", "width", "height"), "image_id")
    cy, cx = G.round_half_even(F.col("y")).cast("int"), G.round_half_even(F.col("x")).cast("int")
    return sized.select("draw", "image_id", place(cy, "height", "rj").alias("tile_row"), place(cx, "width", "cj").alias("tile_col"))


def score_tiles(pixels: DataFrame, images: DataFrame, tile: int, stride: int, fn: Callable[[np.ndarray], np.ndarray],
                mean: tuple[float, ...] = (0.485, 0.456, 0.406), std: tuple[float, ...] = (0.229, 0.224, 0.225)) -> DataFrame:
    """Run a user's model on every sliding tile: ``fn(float32[3, T, T]) -> logits[T, T]``, as ``image_id, tile_row, tile_col, y, x, logit``.

    Pixels travel to their tiles, and logits back, as pieces of rows; a task holds one tile
    of T² cells, whatever the image size. The result is laid out by (image, row), so
    stitching needs no further exchange.
    """
    mu, sd = np.array(mean)[:, None, None], np.array(std)[:, None, None]

    def reach(x0: int, x1: int, width: int, _height: int) -> list[tuple[int, int, int]]:
        last = max(0, width - tile)
        n = -(-last // stride) + 1
        out = []
        for k in range(max(0, (x0 - tile) // stride), n):
            col = min(k * stride, last)
            if col > x1:
                break
            if col + tile > x0:
                out.append((col, max(x0, col), min(x1, col + tile - 1)))
        return out

    sized = pixels.join(images.select("image_id", "width", "height"), "image_id")
    pieces = row_pieces(sized, ["r", "g", "b"], reach, ["width", "height"])
    rows = F.explode(G.covering_tiles(F.col("y"), F.col("height"), tile, stride)).alias("ty")
    at = ["image_id", "tile_row", "tile_col"]
    spread = pieces.select("*", rows).withColumn("tile_row", G.tile_origin(F.col("ty"), F.col("height"), tile, stride)).withColumnRenamed("tx", "tile_col")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_batches(batches, at):
            row, col = group.column("tile_row")[0].as_py(), group.column("tile_col")[0].as_py()
            spans = [(y - row, x - col, n) for y, x, n in zip(*[group.column(c).to_pylist() for c in ("y", "x0", "n")])]
            rgb = np.zeros((3, tile, tile), dtype=np.float64)
            for (y, x, n), data in zip(spans, group.column("data").to_pylist()):
                rgb[:, y, x : x + n] = np.frombuffer(data).reshape(3, n)
            logits = np.asarray(fn(((rgb / 255.0 - mu) / sd).astype(np.float32)), dtype=np.float64)
            if logits.shape != (tile, tile):
                raise ValueError(f"model returned shape {logits.shape} for a tile of {tile}")
            flat = np.concatenate([logits[y, x : x + n] for y, x, n in spans])
            offsets = np.append(0, np.cumsum([n for *_, n in spans])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[group.column(c).combine_chunks() for c in (*at, "y", "x0")], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                [*at, "y", "x0", "logits"])

    dealt = spread.select(*at, "y", "x0", "n", "data").repartition(fanout_partitions(pixels.sparkSession), *at).sortWithinPartitions(*at)
    scored = dealt.mapInArrow(run, "image_id long, tile_row int, tile_col int, y int, x0 int, logits array<double>")
    by_row = scored.repartition(fanout_partitions(pixels.sparkSession), "image_id", "y")
    return by_row.select(*at, "y", "x0", F.posexplode("logits").alias("k", "logit")).select(*at, "y", (F.col("x0") + F.col("k")).alias("x"), "logit")


def stitched_scores(pixels: DataFrame, images: DataFrame, tile: int, stride: int, fn: Callable[[np.ndarray], np.ndarray],
                    mean: tuple[float, ...] = (0.485, 0.456, 0.406), std: tuple[float, ...] = (0.229, 0.224, 0.225)) -> DataFrame:
    """Mean probability of a user's model over the sliding tiles of each pixel, as ``image_id, y, x, p``: ``score_tiles`` and ``stitch`` in one pass.

    A task holds one block of BLOCK_STRIDES strides a side and the pixels around it that its
    tiles see, whatever the image size; it scores every tile that reaches into the block, so
    its pixels are final and only pixels travel, most of them once. Tiles over a border between
    blocks are scored by each of them. Sizes reach the blocks as rows of their own: no join meets pixels.
    """
    mu, sd = np.array(mean)[:, None, None], np.array(std)[:, None, None]
    side, halo = BLOCK_STRIDES * stride, tile - 1

    def block(at: Column) -> Column:
        return F.greatest(F.floor(at / F.lit(side)), F.lit(0)).cast("int")

    def reach(x0: int, x1: int) -> list[tuple[int, int, int]]:
        blocks = range(max(0, (x0 - halo) // side), (x1 + halo) // side + 1)
        return [(b, max(x0, b * side - halo), min(x1, (b + 1) * side + halo - 1)) for b in blocks]

    rows = F.explode(F.sequence(block(F.col("y") - halo), block(F.col("y") + halo))).alias("ty")
    pieces = row_pieces(pixels, ["r", "g", "b"], reach, narrow=True).select("image_id", rows, "tx", F.lit(1).alias("kind"), "y", "x0", "n", "data")
    sizes = images.select("image_id", F.col("height").cast("int").alias("y"), F.col("width").cast("int").alias("x0")).filter("y > 0 AND x0 > 0")
    sizes = sizes.select("*", *[F.sequence(F.lit(0), block(F.col(c) - 1)).alias(t) for c, t in (("y", "ty"), ("x0", "tx"))])
    sizes = sizes.withColumn("ty", F.explode("ty")).withColumn("tx", F.explode("tx"))
    sizes = sizes.select("image_id", "ty", "tx", F.lit(0).alias("kind"), "y", "x0", F.lit(0).alias("n"), F.lit(None).cast("binary").alias("data"))

    def origins(length: int, b: int) -> list[int]:
        """Starts of the tiles along a side that reach into block ``b``."""
        last = max(0, length - tile)
        every = range(max(0, (b * side - tile) // stride), min(-(-last // stride), (b + 1) * side // stride) + 1)
        found = sorted({min(k * stride, last) for k in every} | {last})
        return [o for o in found if o < (b + 1) * side and o + tile > b * side]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_batches(batches, ["image_id", "ty", "tx"]):
            kind = group.column("kind").to_numpy()
            if kind[0] != 0 or kind[-1] == 0:
                continue
            ty, tx, height, width = (group.column(c)[0].as_py() for c in ("ty", "tx", "y", "x0"))
            tops, lefts = origins(height, ty), origins(width, tx)
            if not tops or not lefts:
                continue
            top, left = tops[0], lefts[0]
            rgb = np.zeros((3, tops[-1] + tile - top, lefts[-1] + tile - left))
            here = np.zeros(rgb.shape[1:], bool)
            pieces = group.slice(int(np.count_nonzero(kind == 0)))
            for y, x, n, data in zip(*[pieces.column(c).to_pylist() for c in ("y", "x0", "n", "data")]):
                a, b = max(0, left - x), min(n, left + here.shape[1] - x)
                if a < b and top <= y < top + len(here):
                    rgb[:, y - top, x + a - left : x + b - left] = piece_values(data, n, 3)[:, a:b]
                    here[y - top, x + a - left : x + b - left] = True
            scaled = ((rgb / 255.0 - mu) / sd).astype(np.float32)
            total, times = np.zeros(here.shape), np.zeros(here.shape)
            for r in tops:
                for c in lefts:
                    at = slice(r - top, r - top + tile), slice(c - left, c - left + tile)
                    if not here[at].any():
                        continue
                    logits = np.asarray(fn(scaled[(slice(None), *at)].copy()), dtype=np.float64)
                    if logits.shape != (tile, tile):
                        raise ValueError(f"model returned shape {logits.shape} for a tile of {tile}")
                    with np.errstate(over="ignore"):
                        total[at] += 1.0 / (1.0 + np.exp(-logits))
                    times[at] += 1
            here &= times > 0
            here[: max(0, ty * side - top)], here[max(0, (ty + 1) * side - top) :] = False, False
            here[:, : max(0, tx * side - left)], here[:, max(0, (tx + 1) * side - left) :] = False, False
            ys, xs = np.nonzero(here)
            if not len(ys):
                continue
            first = np.flatnonzero(np.append(True, (ys[1:] != ys[:-1]) | (xs[1:] != xs[:-1] + 1)))
            offsets = np.append(first, len(ys)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(first), group.column("image_id")[0].as_py()), pa.int64()), pa.array(ys[first] + top, pa.int32()),
                 pa.array(xs[first] + left, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(total[here] / times[here]))],
                ["image_id", "y", "x0", "ps"])

    at = ["image_id", "ty", "tx"]
    dealt = pieces.unionByName(sizes).repartition(fanout_partitions(pixels.sparkSession), *at).sortWithinPartitions(*at, "kind")
    found = dealt.mapInArrow(run, "image_id long, y int, x0 int, ps array<double>")
    return found.select("image_id", "y", "x0", F.posexplode("ps").alias("k", "p")).select("image_id", "y", (F.col("x0") + F.col("k")).alias("x"), "p")
