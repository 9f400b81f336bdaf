"""Symbols against lines: features, piercing labels, bands and component decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlines.functions import geometry as G
from planlines.functions import scoring as SC
from planlines.operators import morphology as M
from planlines.operators import raster as R
from planlines.operators import spatial as S
from planlines.session import stage


def bbox_features(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """[w, h, ln(w/h), ln(w·h), ln w + ln h] with sides of at least 1."""
    w, h = F.greatest(x2 - x1, F.lit(1.0)), F.greatest(y2 - y1, F.lit(1.0))
    return [w, h, F.log(w / h), F.log(w * h), F.log(w) + F.log(h)]


def l2_norm(embedding: Column) -> Column:
    total = F.aggregate(embedding, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return F.sqrt(total)


def l2_normalize(embedding: Column) -> Column:
    """v / (‖v‖ + 1e-8). The norm is computed once per row by passing it through a one-element array."""
    parts = F.transform(
        F.array(l2_norm(embedding) + F.lit(1e-8)), lambda n: F.transform(embedding, lambda v: v.cast("double") / n)
    )
    return parts[0]


def symbol_features(symbols: DataFrame, name: str = "features") -> DataFrame:
    box = bbox_features(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return symbols.withColumn(name, F.concat(l2_normalize(F.col("embedding")), F.array(*box)))


def linear_score(features: Column, weights: list[float], bias: float) -> Column:
    """P(class 1) of a linear model with given coefficients."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    dot = F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return SC.sigmoid(dot + F.lit(float(bias)))


def band(p: Column, high: float = 0.85, low: float = 0.15) -> Column:
    return F.when(p >= high, "irrigation").when(p <= low, "callout").otherwise("neutral")


def cluster_category(p: Column, high: float = 0.7, low: float = 0.2) -> Column:
    return F.when(p > high, "irrigation").when(p < low, "callout").otherwise("ambiguous")


def near_line(boxes: DataFrame, images: DataFrame, runs: DataFrame, ident: str, margin: float = 0.3) -> DataFrame:
    """``near_gt``: does a line pierce the inner part of a symbol box?

    NULL for images without any line pixel; False for boxes without area. Boxes of
    unknown images are skipped.
    """
    sized = boxes.join(images.select("image_id", "width", "height"), "image_id")
    inner = G.inner_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.col("width"), F.col("height"), margin)
    probe = sized.select("image_id", F.col(ident).alias("box"), inner.alias("i")).filter("i is not null")
    hit = R.boxes_touching(probe.select("image_id", "box", "i.*"), R.run_cells(runs))
    return _with_flag(boxes, images, runs, hit, ident)


def _with_flag(boxes: DataFrame, images: DataFrame, runs: DataFrame, hit: DataFrame, ident: str) -> DataFrame:
    lined = runs.select("image_id").distinct().withColumn("has_gt", F.lit(True))
    known = boxes.join(images.select("image_id"), "image_id", "left_semi").join(lined, "image_id", "left")
    flags = hit.select("image_id", F.col("box").alias(ident), F.lit(True).alias("hit"))
    near = F.when(F.col("has_gt"), F.coalesce("hit", F.lit(False)))
    return known.join(flags.hint("merge"), ["image_id", ident], "left").withColumn("near_gt", near).drop("has_gt", "hit")


def near_line_centre(boxes: DataFrame, images: DataFrame, runs: DataFrame, ident: str, distance: float) -> DataFrame:
    """Earlier rule: the box centre lies less than ``distance`` pixels from a line pixel.

    Row by row the pixels within the distance form one interval, so the test is run
    overlap in the few rows around the centre, on 8-pixel cells. Both sides grow by their
    cells, which a planner does not see, so they are merged and never broadcast.
    """
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    d = F.lit(float(distance))
    rows = F.sequence(F.ceil(cy - d).cast("int"), F.floor(cy + d).cast("int"))
    probe = boxes.select("image_id", F.col(ident).alias("box"), cx.alias("px"), cy.alias("py"), F.explode(rows).alias("y"))
    half = F.sqrt(F.greatest(d * d - (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")), F.lit(0.0)))
    probe = probe.select(
        "image_id", "box", "px", "py", "y",
        F.explode(F.sequence(F.floor((F.col("px") - half) / 8).cast("int"), F.floor((F.col("px") + half) / 8).cast("int"))).alias("bx"),
    )
    blocks = runs.select(
        "image_id", "y", "x0", "x1",
        F.explode(F.sequence(F.shiftright("x0", 3), F.shiftright("x1", 3))).alias("bx"),
    )
    nearest = F.greatest(F.col("x0").cast("double"), F.least(F.col("x1").cast("double"), F.col("px")))
    # Pixels are integers: the closest of them is the clamped centre rounded either way.
    below, above = F.greatest(F.floor(nearest), F.col("x0")), F.least(F.ceil(nearest), F.col("x1"))
    dx = F.least(F.abs(below - F.col("px")), F.abs(above - F.col("px")))
    dy = F.col("y") - F.col("py")
    hit = probe.hint("merge").join(blocks, ["image_id", "y", "bx"]).filter(dx * dx + dy * dy < d * d)
    return _with_flag(boxes, images, runs, hit.select("image_id", "box").distinct(), ident)


def near_line_any(boxes: DataFrame, images: DataFrame, runs: DataFrame, ident: str, distance: int) -> DataFrame:
    """Earlier rule: any pixel of the full box lies within the dilated lines."""
    sized = boxes.join(images.select("image_id", "width", "height"), "image_id")
    zero = F.lit(0)
    probe = sized.select(
        "image_id", F.col(ident).alias("box"),
        F.greatest(zero, F.col("x1").cast("int")).alias("ix1"), F.greatest(zero, F.col("y1").cast("int")).alias("iy1"),
        F.least(F.col("width"), F.col("x2").cast("int") + 1).alias("ix2"),
        F.least(F.col("height"), F.col("y2").cast("int") + 1).alias("iy2"),
    ).filter("ix2 > ix1 and iy2 > iy1")
    hit = R.boxes_touching(probe, R.run_cells(R.dilate(runs, images, distance)))
    return _with_flag(boxes, images, runs, hit, ident)


def endpoint_symbol_p(endpoints: DataFrame, symbols: DataFrame, radius: float = 25.0, keys: list[str] | None = None) -> DataFrame:
    """Highest P among symbols whose centre lies within ``radius`` of each endpoint, else NULL.

    Symbols stacked on one centre count once, with their highest P.
    """
    keys = keys or ["image_id", "component", "y", "x"]
    cx, cy = (F.col("x1") + F.col("x2")) * 0.5, (F.col("y1") + F.col("y2")) * 0.5
    centres = symbols.select("image_id", cx.alias("sx"), cy.alias("sy"), "p").groupBy("image_id", "sx", "sy").agg(F.max("p").alias("p"))
    near = S.within_radius(endpoints.select(*keys), centres, radius, ["image_id"], ("x", "y"), ("sx", "sy"))
    best = near.groupBy(*keys).agg(F.max("p").alias("max_p"))
    return endpoints.select(*keys).join(best, keys, "left")


def component_decisions(
    labels: DataFrame, pred: DataFrame, skeleton: DataFrame, endpoint_p: DataFrame, *,
    high: float = 0.85, low: float = 0.15, min_component_px: int = 0, min_drop_skel_px: int = 0,
) -> DataFrame:
    """Keep or drop every predicted component by the symbols at its ends.

    ``labels`` are the components of the dilated mask, ``pred`` the original pixels
    with their component (both as pixels or as row runs), ``skeleton`` the centreline
    pixels with their component.
    """
    key = ["image_id", "component"]
    area = labels.groupBy(*key).agg(R.n_pixels(labels).alias("n_pixels")).filter(F.col("n_pixels") >= max(1, min_component_px))
    body = area.join(pred.select(*key).distinct(), key, "left_semi")
    length = skeleton.groupBy(*key).agg(F.count("*").alias("skel_len"))
    ends = endpoint_p.groupBy(*key).agg(
        F.count("*").alias("n_endpoints"), F.bool_or(F.col("max_p") >= high).alias("any_high"),
        F.bool_or(F.col("max_p") <= low).alias("any_low"),
    )
    df = body.join(length, key, "left").join(ends, key, "left").withColumns({
        "skel_len": F.coalesce("skel_len", F.lit(0).cast("long")), "n_endpoints": F.coalesce("n_endpoints", F.lit(0).cast("long")),
        "any_high": F.coalesce("any_high", F.lit(False)), "any_low": F.coalesce("any_low", F.lit(False)),
    })
    measured = F.lit(min_drop_skel_px > 0)
    long_enough = measured & (F.col("skel_len") >= min_drop_skel_px)
    reason = (
        F.when(F.col("n_endpoints") == 0, "no_endpoints")
        .when(F.col("any_high"), "irrigation_endpoint")
        .when(F.col("any_low") & long_enough, "callout_endpoint_but_long_skel")
        .when(F.col("any_low") & measured, "callout_endpoint_short_skel")
        .when(F.col("any_low"), "callout_endpoint_only")
        .otherwise("no_strong_signal")
    )
    df = df.withColumn("reason", reason)
    drop = F.col("reason").isin("callout_endpoint_short_skel", "callout_endpoint_only")
    return df.select(*key, "n_pixels", "n_endpoints", "skel_len", F.when(drop, "drop").otherwise("keep").alias("fate"), "reason")


def filter_mask(labelled_pred: DataFrame, decisions: DataFrame) -> DataFrame:
    """Original mask pixels (given as pixels or as row runs) without those of dropped components."""
    dropped = decisions.filter("fate = 'drop'").select("image_id", "component")
    kept = labelled_pred.join(dropped, ["image_id", "component"], "left_anti")
    return R.runs_to_pixels(kept) if "x1" in kept.columns else kept.select("image_id", "y", "x")


def filter_report(images: DataFrame, labels: DataFrame, labelled_pred: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per image: components in total, components dropped, pixels dropped."""
    key = ["image_id", "component"]
    total = labels.select(*key).distinct().groupBy("image_id").agg(F.count("*").alias("n_components"))
    dropped = decisions.filter("fate = 'drop'").select(*key)
    n_drop = dropped.groupBy("image_id").agg(F.count("*").alias("n_dropped"))
    px = labelled_pred.join(dropped, key, "left_semi").groupBy("image_id").agg(R.n_pixels(labelled_pred).alias("pixels_dropped"))
    out = images.select("image_id").join(total, "image_id", "left").join(n_drop, "image_id", "left").join(px, "image_id", "left")
    return out.na.fill(0)


def component_filter(pred: DataFrame, images: DataFrame, symbols: DataFrame, *, dilation: int = 3, radius: float = 25.0,
                     skeleton: DataFrame | None = None, runs: DataFrame | None = None, **thresholds) -> dict[str, DataFrame]:
    """The whole symbol filter over all images; ``symbols`` carry their P in ``p``.

    ``skeleton`` may be supplied as pixels; otherwise the mask is thinned. ``runs`` are
    the maximal row runs of ``pred``, where they are known. Labels are kept as runs.
    """
    pred = pred.select("image_id", "y", "x")
    runs = stage(R.pixels_to_runs(pred), "pred_runs") if runs is None else runs
    labels = M.label_runs(R.dilate(runs, images, dilation))
    labelled = stage(R.containing_run(runs.select("image_id", "y", "x0", "x1"), labels, "component"), "labelled")
    thin = M.skeletonize(pred) if skeleton is None else M.neighbour_count(skeleton)
    points = thin.select("image_id", "y", F.col("x").cast("int").alias("x0"), F.col("x").cast("int").alias("x1"), "degree")
    # The skeleton is read by every step of the end-pixel rule: keep it, not its plan.
    skel = R.containing_run(points, labelled, "component").select("image_id", "y", F.col("x0").alias("x"), "degree", "component")
    skel = stage(skel, "skeleton")
    ends = M.skeleton_endpoints(skel, ["image_id", "component"])
    endpoint_p = stage(endpoint_symbol_p(ends, symbols, radius), "ends")
    decisions = stage(component_decisions(labels, labelled, skel, endpoint_p, **thresholds), "decisions")
    return {
        "labels": labels, "labelled": labelled, "skeleton": skel, "endpoints": endpoint_p, "decisions": decisions,
        "mask": filter_mask(labelled, decisions), "report": filter_report(images, labels, labelled, decisions),
    }
