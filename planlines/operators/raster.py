"""Sparse rasters: strokes to row runs, run algebra, dilation and tiles.

A mask is kept either as pixels ``(keys, y, x)`` or as disjoint row runs
``(keys, y, x0, x1)``. Runs are several times fewer rows, so shuffles move runs
and pixels are exploded afterwards, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planlines.functions import geometry as G
from planlines.session import fanout_partitions

KEYS = ["image_id"]


def merge_spans(spans: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Overlapping or touching spans of a row become one run.

    Copies collapse in the first aggregation (map side first), so a row carries at
    most one span per start column into the window.
    """
    rows = spans.groupBy(*keys, "y", "x0").agg(F.max("x1").alias("x1"))
    by_row = Window.partitionBy(*keys, "y").orderBy("x0")
    reach = F.max("x1").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("x0") > reach + 1), 1).otherwise(0)
    marked = rows.withColumn("opens", opens).withColumn("run", F.sum("opens").over(by_row))
    return marked.groupBy(*keys, "y", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")


def containing_run(rows: DataFrame, runs: DataFrame, column: str, keys: list[str] = KEYS) -> DataFrame:
    """``rows (keys, y, x0, x1, …)`` that lie inside one of the disjoint ``runs``, with that run's ``column``.

    Both sides meet in one window for each image row: the run that last began decides.
    """
    rest = [c for c in rows.columns if c not in (*keys, "y", "x0", "x1")]
    held = F.struct("x1", column)
    of = runs.select(*keys, "y", "x0", F.lit(None).cast("int").alias("x1"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rest],
                     held.alias("_run"))
    both = of.unionByName(rows.withColumn("_run", F.lit(None).cast(of.schema["_run"].dataType)))
    # at one column the run stands before the rows
    by_row = Window.partitionBy(*keys, "y").orderBy("x0", F.col("x1").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_run", F.last("_run", ignorenulls=True).over(by_row))
    return met.filter(F.col("x1").isNotNull() & (F.col("x1") <= F.col("_run.x1"))).select(
        *keys, "y", "x0", "x1", *rest, F.col(f"_run.{column}").alias(column))


def n_pixels(df: DataFrame):
    """Aggregate: pixels of a table of pixels or of row runs."""
    return F.sum((F.col("x1") - F.col("x0") + 1).cast("long")) if "x1" in df.columns else F.count("*")


def pixel_words(pixels: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Pixels as 64-bit words of a row: bit ``x % 64`` of word ``x // 64``.

    Copies of a pixel vanish in the map-side OR, and up to 64 pixels travel as one row.
    """
    return pixels.groupBy(*keys, "y", F.shiftright("x", 6).alias("wx")).agg(word_where(F.lit(True)).alias("word"))


def word_where(flag):
    """Aggregate of pixels that share a word: the bits of those with ``flag``."""
    bit = F.when(flag, _shl(F.lit(1).cast("long"), F.col("x").bitwiseAND(63)))
    return F.coalesce(F.bit_or(bit), F.lit(0).cast("long"))


def runs_to_pixels(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return runs.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def pixels_to_runs(pixels: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Maximal runs of distinct pixels, one window per image row."""
    by_row = Window.partitionBy(*keys, "y").orderBy("x")
    marked = pixels.withColumn("run", F.col("x") - F.row_number().over(by_row))
    return (
        marked.groupBy(*keys, "y", "run")
        .agg(F.min("x").cast("int").alias("x0"), F.max("x").cast("int").alias("x1"))
        .drop("run")
    )


def stroke_spans(segments: DataFrame, thickness: int = 4, keys: list[str] = KEYS) -> DataFrame:
    """Row spans painted by each segment, clipped to the canvas before exploding.

    ``segments`` carries integer ``x1 y1 x2 y2`` and the canvas ``width height``.
    A round-brush stroke meets a row in one interval: bound it by the strip around
    the line and the padded bounding box, then keep the first and last exact pixel.
    """
    r = F.lit(thickness / 2.0)
    pad = F.lit((thickness + 1) // 2)
    # A segment grows into its pixels after this exchange, so its partition count is
    # fixed instead of being shrunk to the small size of the segments.
    parts = fanout_partitions(segments.sparkSession)
    cols = [*keys, "x1", "y1", "x2", "y2"]
    distinct = segments.select(*cols, "width", "height").repartition(parts, *cols).dropDuplicates(cols)
    dx, dy = (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")
    rows = distinct.select(
        "*",
        F.explode(
            G.span(
                F.greatest(F.lit(0), F.least("y1", "y2") - pad),
                F.least(F.col("height") - 1, F.greatest("y1", "y2") + pad),
            )
        ).alias("y"),
    )
    centre = F.col("x1") + (F.col("y") - F.col("y1")) * dx / dy
    half = r * F.sqrt(dx * dx + dy * dy) / F.abs(dy)
    box_lo, box_hi = F.least("x1", "x2") - pad, F.greatest("x1", "x2") + pad
    lo = F.when(dy == 0, box_lo).otherwise(F.greatest(box_lo, F.floor(centre - half).cast("int") - 1))
    hi = F.when(dy == 0, box_hi).otherwise(F.least(box_hi, F.ceil(centre + half).cast("int") + 1))
    bounded = rows.select("*", F.greatest(F.lit(0), lo).alias("lo"), F.least(F.col("width") - 1, hi).alias("hi"))
    cells = bounded.select("*", F.explode(G.span(F.col("lo"), F.col("hi"))).alias("x"))
    painted = cells.filter(G.within_stroke(F.col("x"), F.col("y"), thickness))
    # laid out by segment already: pixels become spans where they arise, and only spans travel
    return painted.groupBy(*cols, "y").agg(F.min("x").alias("_x0"), F.max("x").alias("_x1")).select(
        *keys, "y", F.col("_x0").alias("x0"), F.col("_x1").alias("x1")
    )


def rasterize(segments: DataFrame, thickness: int = 4, keys: list[str] = KEYS) -> DataFrame:
    """Union of all strokes as disjoint row runs."""
    return merge_spans(stroke_spans(segments, thickness, keys), keys)


def chord_segments(chords: DataFrame, images: DataFrame) -> DataFrame:
    """Float chords as integer segments (truncated toward zero) with their canvas."""
    ints = [F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return chords.select("image_id", *ints).join(images.select("image_id", "width", "height"), "image_id")


def attach_mask(dense: DataFrame, runs: DataFrame, shifts: dict[str, int], keys: list[str] = KEYS) -> DataFrame:
    """Dense pixels with boolean columns: is the mask set ``shift`` pixels to the left?

    The mask joins row by row: a row's runs travel as one short map of 64-pixel words,
    so the dense table is never shuffled by pixel, and not at all when it is already
    laid out by (image, row); a pixel looks up one word and tests one bit. The row maps
    are the hash side; they are a small fraction of the dense partition they meet.
    """
    pieces = runs.select(*keys, "y", "x0", "x1", F.explode(F.sequence(F.shiftright("x0", 6), F.shiftright("x1", 6))).alias("wx"))
    left = F.greatest(F.col("x0") - F.col("wx") * 64, F.lit(0))
    right = F.least(F.col("x1") - F.col("wx") * 64, F.lit(63))
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (63 - (right - left)).cast("int"))
    words = pieces.groupBy(*keys, "y", "wx").agg(F.bit_or(_shl(ones, left)).alias("word"))
    rows = words.groupBy(*keys, "y").agg(F.map_from_entries(F.collect_list(F.struct("wx", "word"))).alias("_words"))
    joined = dense.join(rows.hint("shuffle_hash"), [*keys, "y"], "left")

    def inside(shift: int):
        x = (F.col("x") - shift).cast("int")
        word = F.element_at("_words", F.shiftright(x, 6))
        bit = F.call_function("shiftright", word, x.bitwiseAND(63)).bitwiseAND(F.lit(1).cast("long"))
        return F.coalesce(bit == 1, F.lit(False))

    return joined.withColumns({name: inside(shift) for name, shift in shifts.items()}).drop("_words")


def disc_rows(radius: int) -> list[tuple[int, int]]:
    """Half width of the elliptical kernel of side 2r+1 for each row offset."""
    return [(dy, int(round((radius * radius - dy * dy) ** 0.5))) for dy in range(-radius, radius + 1)]


def dilate(runs: DataFrame, images: DataFrame, radius: int, keys: list[str] = KEYS) -> DataFrame:
    """Dilation by the elliptical kernel: 2r+1 widened copies of each run, merged per row."""
    if radius <= 0:
        return runs
    kernel = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(hw).alias("hw")) for dy, hw in disc_rows(radius)])
    grown = (
        runs.join(images.select("image_id", "width", "height"), "image_id")
        .select("*", F.explode(kernel).alias("k"))
        .select(
            *keys,
            (F.col("y") + F.col("k.dy")).alias("y"),
            F.greatest(F.lit(0), F.col("x0") - F.col("k.hw")).alias("x0"),
            F.least(F.col("width") - 1, F.col("x1") + F.col("k.hw")).alias("x1"),
            "height",
        )
        .filter((F.col("y") >= 0) & (F.col("y") < F.col("height")))
        .drop("height")
    )
    return merge_spans(grown, keys)


def run_cells(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """8×8 occupancy words: one 64-bit word per touched cell, bit ``8*(y%8) + x%8``.

    A unique row per cell: joins against it can not multiply, and one AND answers
    64 pixel questions.
    """
    pieces = runs.select(
        *keys, "y", "x0", "x1", F.explode(F.sequence(F.shiftright("x0", 3), F.shiftright("x1", 3))).alias("cx")
    )
    left = F.greatest(F.col("x0") - F.col("cx") * 8, F.lit(0))
    right = F.least(F.col("x1") - F.col("cx") * 8, F.lit(7))
    word = row_word(left, right, F.col("y") % 8, F.col("y") % 8)
    return pieces.groupBy(*keys, F.shiftright("y", 3).alias("cy"), "cx").agg(F.bit_or(word).alias("word"))


def row_word(left, right, top, bottom):
    """64-bit word with columns left..right of rows top..bottom set (all 0..7)."""
    one = F.lit(1).cast("long")
    byte = _shl(_shl(one, right - left + 1) - 1, left)
    two = byte.bitwiseOR(_shl(byte, F.lit(8)))
    four = two.bitwiseOR(_shl(two, F.lit(16)))
    eight = four.bitwiseOR(_shl(four, F.lit(32)))
    rows = _shl(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (56 - 8 * (bottom - top)).cast("int")), 8 * top)
    return eight.bitwiseAND(rows)


def _shl(value, bits):
    return F.call_function("shiftleft", value, bits.cast("int"))


def boxes_touching(boxes: DataFrame, cells: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Boxes ``[ix1, ix2) × [iy1, iy2)`` that contain at least one mask pixel.

    Boxes first meet the occupied 64×64 blocks, which drops the empty space of large
    boxes; inside an occupied block they visit the 8×8 cells they cover, where the
    occupancy word ANDed with the covered part of the cell decides exactly. Returns
    the distinct ``box`` ids with their keys.
    """
    blocks = cells.select(*keys, F.shiftright("cy", 3).alias("by"), F.shiftright("cx", 3).alias("bx")).distinct()

    def steps(low, high):
        return F.explode(F.sequence(low, high))

    last_y, last_x = F.col("iy2") - 1, F.col("ix2") - 1
    near = (
        boxes.select("*", steps(F.shiftright("iy1", 6), F.shiftright(last_y, 6)).alias("by"))
        .select("*", steps(F.shiftright("ix1", 6), F.shiftright(last_x, 6)).alias("bx"))
        .hint("merge").join(blocks, [*keys, "by", "bx"])
    )

    def inside(low, high, block):
        return steps(F.greatest(F.shiftright(low, 3), F.col(block) * 8), F.least(F.shiftright(high, 3), F.col(block) * 8 + 7))

    spread = near.select("*", inside("iy1", last_y, "by").alias("cy")).select("*", inside("ix1", last_x, "bx").alias("cx"))
    cover = row_word(
        F.greatest(F.col("ix1") - F.col("cx") * 8, F.lit(0)),
        F.least(F.col("ix2") - 1 - F.col("cx") * 8, F.lit(7)),
        F.greatest(F.col("iy1") - F.col("cy") * 8, F.lit(0)),
        F.least(F.col("iy2") - 1 - F.col("cy") * 8, F.lit(7)),
    )
    hit = spread.withColumn("cover", cover).hint("merge").join(cells, [*keys, "cy", "cx"])
    return hit.filter(F.col("cover").bitwiseAND(F.col("word")) != 0).select(*keys, "box").distinct()


def tile_grid(images: DataFrame, tile: int, stride: int) -> DataFrame:
    """Sliding tile origins with a clamped last tile, one row per tile."""
    rows = images.select(
        "image_id", "width", "height",
        F.explode(F.sequence(F.lit(0), G.tile_count(F.col("height"), tile, stride) - 1)).alias("ty"),
    ).select("*", F.explode(F.sequence(F.lit(0), G.tile_count(F.col("width"), tile, stride) - 1)).alias("tx"))
    return rows.select(
        "image_id",
        G.tile_origin(F.col("ty"), F.col("height"), tile, stride).alias("tile_row"),
        G.tile_origin(F.col("tx"), F.col("width"), tile, stride).alias("tile_col"),
    )


def to_tiles(pixels: DataFrame, images: DataFrame, tile: int, stride: int) -> DataFrame:
    """Each pixel repeated for every tile that covers it, with its tile-local position."""
    sized = pixels.join(images.select("image_id", "width", "height"), "image_id")
    spread = sized.select(
        "*", F.explode(G.covering_tiles(F.col("y"), F.col("height"), tile, stride)).alias("ty")
    ).select("*", F.explode(G.covering_tiles(F.col("x"), F.col("width"), tile, stride)).alias("tx"))
    row = G.tile_origin(F.col("ty"), F.col("height"), tile, stride)
    col = G.tile_origin(F.col("tx"), F.col("width"), tile, stride)
    return (
        spread.withColumn("tile_row", row)
        .withColumn("tile_col", col)
        .withColumn("ly", F.col("y") - F.col("tile_row"))
        .withColumn("lx", F.col("x") - F.col("tile_col"))
        .drop("ty", "tx", "width", "height")
    )


def padding_cells(images: DataFrame, tile: int, stride: int) -> DataFrame:
    """Tile cells past the image edge, which exist only where an image is smaller than a tile."""
    small = images.filter((F.col("width") < tile) | (F.col("height") < tile))
    tiles = tile_grid(small, tile, stride).join(small.select("image_id", "width", "height"), "image_id")
    cells = tiles.select("*", F.explode(F.sequence(F.lit(0), F.lit(tile - 1))).alias("ly")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(tile - 1))).alias("lx")
    )
    outside = (F.col("tile_row") + F.col("ly") >= F.col("height")) | (F.col("tile_col") + F.col("lx") >= F.col("width"))
    return cells.filter(outside).select("image_id", "tile_row", "tile_col", "ly", "lx")


def positive_tiles(runs: DataFrame, images: DataFrame, tile: int, stride: int) -> DataFrame:
    """Tiles with any foreground: runs name the tiles they touch, then ``distinct``.

    Work is one row per (run, touched tile), whatever the number of empty tiles.
    """
    if stride > tile:
        raise ValueError("tiles must cover the image: stride may not exceed tile")
    sized = runs.join(images.select("image_id", "width", "height"), "image_id")
    ends = F.array_distinct(
        F.concat(
            G.covering_tiles(F.col("x0"), F.col("width"), tile, stride),
            G.covering_tiles(F.col("x1"), F.col("width"), tile, stride),
        )
    )
    between = G.span(F.array_min(ends), F.array_max(ends))
    spread = sized.select(
        "*", F.explode(G.covering_tiles(F.col("y"), F.col("height"), tile, stride)).alias("ty")
    ).select("*", F.explode(between).alias("tx"))
    return spread.select(
        "image_id",
        G.tile_origin(F.col("ty"), F.col("height"), tile, stride).alias("tile_row"),
        G.tile_origin(F.col("tx"), F.col("width"), tile, stride).alias("tile_col"),
    ).distinct()
