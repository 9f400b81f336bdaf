"""Segmentation metrics over sparse masks and dense score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlines.functions import geometry as G
from planlines.functions import scoring as SC
from planlines.operators import raster as R
from planlines.operators.ranking import percentiles


def flag_pixels(masks: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Pixels in any of the masks with one boolean column per mask.

    A union and one aggregation replace the full outer join of the masks: one
    exchange, no sort, and copies vanish on the map side.
    """
    parts = None
    for name in masks:
        flags = [F.lit(n == name).alias(n) for n in masks]
        part = masks[name].select(*keys, *flags)
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(*keys).agg(*[F.bool_or(n).alias(n) for n in masks])


def _n(cond: Column) -> Column:
    return F.count_if(cond)


def confusion_counts(flags: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, gt_count and pred_count of flagged pixels (columns gt, pred)."""
    gt, pred = F.col("gt"), F.col("pred")
    return flags.groupBy(*by).agg(
        _n(gt & pred).alias("tp"), _n(~gt & pred).alias("fp"), _n(gt & ~pred).alias("fn"),
        _n(gt).alias("gt_count"), _n(pred).alias("pred_count"),
    )


def image_metrics(images: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Per-image Dice and counts; images without any pixel score 1.

    Masks meet as 64-pixel words, so no pixel travels.
    """
    both = [df.select("image_id", "y", "x", F.lit(n).alias("pred")) for n, df in ((False, gt), (True, pred))]
    words = both[0].unionByName(both[1]).groupBy("image_id", "y", F.shiftright("x", 6).alias("wx")).agg(
        R.word_where(~F.col("pred")).alias("g"), R.word_where(F.col("pred")).alias("p"))
    bits = words.select("image_id", F.bit_count("g").alias("g"), F.bit_count("p").alias("p"), F.bit_count(F.col("g").bitwiseAND(F.col("p"))).alias("b"))
    n = {c: F.sum(c).cast("long") for c in ("g", "p", "b")}
    counts = bits.groupBy("image_id").agg(
        n["b"].alias("tp"), (n["p"] - n["b"]).alias("fp"), (n["g"] - n["b"]).alias("fn"), n["g"].alias("gt_count"), n["p"].alias("pred_count"))
    cols = ["tp", "fp", "fn", "gt_count", "pred_count"]
    full = images.join(counts, "image_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in cols})
    return full.withColumn("dice", SC.dice_ratio(F.col("tp"), F.col("gt_count") + F.col("pred_count")))


def with_skeleton_lengths(metrics: DataFrame, gt_skel: DataFrame, pred_skel: DataFrame) -> DataFrame:
    """Add gt_skel, pred_skel and their ratio (NULL where the ground truth has none)."""

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("image_id").agg(F.count("*").alias(name))

    full = metrics.join(sizes(gt_skel, "gt_skel"), "image_id", "left").join(
        sizes(pred_skel, "pred_skel"), "image_id", "left"
    )
    full = full.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gt_skel", "pred_skel")})
    return full.withColumn("len_skel_ratio", F.when(F.col("gt_skel") > 0, F.col("pred_skel") / F.col("gt_skel")))


def tile_cover(images: DataFrame, df: DataFrame, tile: int, stride: int) -> DataFrame:
    """Add ``cover``, the number of tiles that contain a pixel, without exploding tiles."""
    sized = df.join(images.select("image_id", "width", "height"), "image_id")
    rows = F.size(G.covering_tiles(F.col("y"), F.col("height"), tile, stride))
    cols = F.size(G.covering_tiles(F.col("x"), F.col("width"), tile, stride))
    return sized.withColumn("cover", (rows * cols).cast("long"))


def pooled_overlap(flags: DataFrame, by: list[str], weights: dict[str, str | None] | None = None) -> DataFrame:
    """Pooled Dice and IoU over flagged pixels, one row per group and weighting ``over``.

    A weight column counts a pixel several times (None counts it once); all weightings
    share one pass over the pixels.
    """
    weights = weights or {"images": None}
    gt, pred = F.col("gt"), F.col("pred")
    conds = {"inter": gt & pred, "n_gt": gt, "n_pred": pred, "n_union": gt | pred}

    def total(cond: Column, column: str | None) -> Column:
        w = F.col(column) if column else F.lit(1).cast("long")
        return F.coalesce(F.sum(F.when(cond, w)), F.lit(0).cast("long"))

    sums = flags.groupBy(*by).agg(
        *[total(c, col).alias(f"{over}_{n}") for over, col in weights.items() for n, c in conds.items()]
    )
    rows = F.array(*[
        F.struct(F.lit(over).alias("over"), *[F.col(f"{over}_{n}").alias(n) for n in conds]) for over in weights
    ])
    out = sums.select(*by, F.explode(rows).alias("s")).select(*by, "s.*")
    return out.withColumn("dice", SC.dice_ratio(F.col("inter"), F.col("n_gt") + F.col("n_pred"))).withColumn(
        "iou", SC.iou_ratio(F.col("inter"), F.col("n_union"))
    )


def centreline_dice(gt: DataFrame, pred: DataFrame, gt_skel: DataFrame, pred_skel: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Centreline Dice pooled per ``by`` group from two masks and their skeletons.

    Epsilon sits in the denominators only, so nothing against nothing is 0.
    """
    flags = flag_pixels({"gt": gt, "pred": pred, "gs": gt_skel, "ps": pred_skel}, keys)
    sums = flags.groupBy(*by).agg(
        _n(F.col("ps") & F.col("gt")).alias("pred_skel_in_gt"), _n("ps").alias("pred_skel"),
        _n(F.col("gs") & F.col("pred")).alias("gt_skel_in_pred"), _n("gs").alias("gt_skel"),
    )
    return _centreline_ratio(sums)


def pooled_centreline(tiles: DataFrame, by: list[str]) -> DataFrame:
    """Centreline Dice pooled per group from the counts of ``morphology.tile_skeletons``."""
    names = ("pred_skel_in_gt", "pred_skel", "gt_skel_in_pred", "gt_skel")
    sums = tiles.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])
    return _centreline_ratio(sums)


def _centreline_ratio(sums: DataFrame) -> DataFrame:
    eps = F.lit(SC.EPS)
    prec = F.col("pred_skel_in_gt") / (F.col("pred_skel") + eps)
    sens = F.col("gt_skel_in_pred") / (F.col("gt_skel") + eps)
    return sums.withColumn("cldice", F.lit(2.0) * prec * sens / (prec + sens + eps))


def length_ratios(samples: DataFrame, by: list[str], ratio: str, gt: str, pred: str) -> DataFrame:
    """Distribution of pred/gt per sample: mean, median, p25, p75; samples without gt are skipped."""
    kept = samples.filter(F.col(gt) >= 1).withColumn(ratio, F.col(pred) / (F.col(gt) + F.lit(SC.EPS)))
    kept = kept.select(*by, ratio)
    mean = kept.groupBy(*by).agg(F.count("*").alias("n_samples"), F.avg(ratio).alias("mean"))
    quart = percentiles(kept, by, ratio, {"median": 0.5, "p25": 0.25, "p75": 0.75})
    return mean.join(quart, by)


def channel_stats(pixels: DataFrame, channels: list[str], by: list[str]) -> DataFrame:
    """Mean and population deviation per channel, from sums and sums of squares."""
    scaled = {c: F.col(c) / F.lit(255.0) for c in channels}
    aggs = [F.count("*").alias("n")]
    for c in channels:
        mean, square = F.avg(scaled[c]), F.avg(scaled[c] * scaled[c])
        aggs += [mean.alias(f"mean_{c}"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias(f"std_{c}")]
    return pixels.groupBy(*by).agg(*aggs)


def block_mean(pixels: DataFrame, factor: int, columns: list[str], by: list[str]) -> DataFrame:
    """Downsample by an integer factor: the mean of every factor × factor block."""
    return pixels.groupBy(
        *by, F.floor(F.col("y") / factor).cast("int").alias("by"), F.floor(F.col("x") / factor).cast("int").alias("bx")
    ).agg(*[F.avg(c).alias(c) for c in columns])


def stitch(tile_scores: DataFrame) -> DataFrame:
    """Mean probability over the overlapping tiles of a pixel."""
    return tile_scores.groupBy("image_id", "y", "x").agg(F.avg("p").alias("p"))


def outcome(gt: Column, pred: Column, kept: Column | None = None) -> Column:
    """Pixel outcome label; with ``kept`` the five-way before/after-filter label."""
    if kept is None:
        return F.when(gt & pred, "TP").when(gt, "FN").when(pred, "FP")
    return (
        F.when(gt & kept, "TP_kept").when(gt & ~pred, "FN").when(~gt & kept, "FP_kept")
        .when(~gt & pred, "FP_dropped").when(gt & pred, "TP_dropped")
    )
