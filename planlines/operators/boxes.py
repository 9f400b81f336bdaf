"""Detections: normalisation, ranks, batches, overlap and greedy suppression."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlines.functions import geometry as G
from planlines.operators import spatial as S
from planlines.operators.ranking import row_numbers
from planlines.session import fanout_partitions, stage

BOX = ["x1", "y1", "x2", "y2"]


def _first_text(record, names: list[str]):
    """First value among ``names`` that is neither missing nor empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(record, F.lit(n)), F.lit("")) for n in names])


def normalize_detections(raw: DataFrame, record: str = "record", keep: list[str] | None = None) -> DataFrame:
    """Typed detections from JSON records with alternative field names.

    Records without an id, with unparsable or empty boxes are dropped. A missing or
    zero confidence becomes 1.0 here (it counts as 0.0 in suppression).

    Records are dealt over all tasks before they are parsed: a small file of them is
    much work. The parsed map passes a generator, so that the final filter does not
    parse each record again for every field it tests.
    """
    keep = keep or []
    dealt = raw.select(*keep, F.col(record).alias("record")).repartition(fanout_partitions(raw.sparkSession))
    df = dealt.select(*keep, F.explode(F.array(F.from_json("record", "map<string,string>"))).alias("m"))
    rec = F.col("m")
    coords = [F.try_element_at(rec, F.lit(c)).try_cast("double").alias(c) for c in BOX]
    conf = F.when(F.map_contains_key(rec, "conf"), F.try_element_at(rec, F.lit("conf"))).otherwise(
        F.try_element_at(rec, F.lit("confidence"))
    ).try_cast("double")
    class_id = F.when(F.map_contains_key(rec, "class_id"), F.try_element_at(rec, F.lit("class_id"))).otherwise(
        F.try_element_at(rec, F.lit("class"))
    ).try_cast("int")
    typed = df.select(
        *keep, _first_text(rec, ["id", "ID", "crop_id"]).alias("crop_id"), *coords,
        F.coalesce(F.nullif(conf, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.coalesce(class_id, F.lit(0)).alias("class_id"),
        F.coalesce(_first_text(rec, ["class_name", "label", "name"]), F.lit("symbol")).alias("class_name"),
    )
    return typed.filter("crop_id is not null and x2 > x1 and y2 > y1")


def with_score(dets: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Add ``score`` (missing confidence is 0) and apply the threshold."""
    return dets.withColumn("score", F.coalesce("conf", F.lit(0.0))).filter(F.col("score") >= threshold)


def conf_rank(dets: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Stable rank by confidence; ties keep input order."""
    return row_numbers(with_score(dets), keys, [F.col("score").desc(), F.col(seq)], "rank")


def id_batches(dets: DataFrame, keys: list[str], ident: str, size: int = 64) -> DataFrame:
    """Ids chunked in order into batches of ``size``, joined by commas."""
    numbered = row_numbers(dets.select(*keys, ident), keys, [F.col(ident)], "pos")
    batch = F.floor((F.col("pos") - 1) / size).cast("int").alias("batch")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", ident))), lambda s: s[ident].cast("string"))
    return numbered.groupBy(*keys, batch).agg(F.count("*").alias("n"), F.concat_ws(",", ids).alias("ids"))


def iou_pairs(dets: DataFrame, keys: list[str], ident: str, cell: float = 64.0) -> DataFrame:
    """IoU of all overlapping pairs of distinct boxes, with the number of copies of each.

    Copies of a box are one row, named by the smallest id, so stacked duplicates cost
    nothing; boxes without area overlap nothing.
    """
    boxes = (
        dets.filter("x2 > x1 and y2 > y1").groupBy(*keys, *BOX)
        .agg(F.min(ident).alias("box"), F.count("*").alias("n"))
    )

    def side(p: str) -> DataFrame:
        return boxes.select(*keys, F.col("box").alias(f"box_{p}"), F.col("n").alias(f"n_{p}"),
                            *[F.col(c).alias(f"{p}{c}") for c in BOX])

    pairs = S.overlapping_boxes(side("a"), side("b"), keys, cell).filter("box_a < box_b")
    return pairs.withColumn("iou", G.box_iou("a", "b"))


def _size_class(side):
    """Power-of-four class of a side length: classes k and k+1 differ by a factor of four."""
    return F.floor(F.log(side) / math.log(4.0)).cast("int")


def nms(dets: DataFrame, keys: list[str], seq: str, iou: float = 0.5, threshold: float = 0.0) -> DataFrame:
    """Greedy suppression: keep the best box, drop boxes with IoU ≥ ``iou``, repeat.

    Equal to the sequential rule, without listing overlapping pairs:
    * copies of a box suppress each other, so only the best-ranked one enters;
    * boxes sit in cells that grow with their size class; in each round only the
      best open box of a cell (the leader) can win, and it wins when no better open
      box overlaps it;
    * a box is compared with the few leaders around it, never with its whole cell.
    The globally best open box is always a leader, so every round makes progress.
    Joins are told to sort and merge: leaders grow with the cells they reach, which a
    planner does not see, and would be collected on the driver to be broadcast.
    """
    if not 0.0 < iou <= 1.0:
        raise ValueError("iou must lie in (0, 1]")
    ranked = with_score(dets, threshold).withColumn("rank", F.struct((-F.col("score")).alias("s"), F.col(seq).alias("q")))
    flat = ranked.filter("x2 <= x1 or y2 <= y1").select(*keys, seq)
    kx, ky = _size_class(F.col("x2") - F.col("x1")), _size_class(F.col("y2") - F.col("y1"))
    four = F.lit(4.0)
    boxes = (
        ranked.filter("x2 > x1 and y2 > y1").groupBy(*keys, *BOX).agg(F.min("rank").alias("rank"))
        .withColumn("kx", kx).withColumn("ky", ky)
        .withColumn("cx", F.floor(F.col("x1") / F.pow(four, F.col("kx"))))
        .withColumn("cy", F.floor(F.col("y1") / F.pow(four, F.col("ky"))))
    )
    place = ["kx", "ky", "cx", "cy"]
    open_boxes = stage(boxes, "boxes")
    kept = []
    while not open_boxes.isEmpty():
        best = open_boxes.groupBy(*keys, *place).agg(F.min(F.struct("rank", *BOX)).alias("b"))
        leaders = best.select(*keys, F.col("b.rank").alias("lrank"), *[F.col(f"b.{c}").alias(f"b{c}") for c in BOX])
        # A partner with IoU ≥ t has sides within a factor t, and its corner lies
        # between one partner side before the leader and the leader's far edge.
        reach = leaders
        for axis in ("x", "y"):
            lo, hi = F.col(f"b{axis}1"), F.col(f"b{axis}2")
            classes = F.sequence(_size_class((hi - lo) * (iou * 0.999999)), _size_class((hi - lo) / (iou * 0.999999)))
            reach = reach.select("*", F.explode(classes).alias(f"k{axis}"))
            unit = F.pow(four, F.col(f"k{axis}"))
            low = F.floor((lo - F.least(unit * 4, (hi - lo) / (iou * 0.999999))) / unit)
            reach = reach.select("*", F.explode(F.sequence(low, F.floor(hi / unit))).alias(f"c{axis}"))
        members = open_boxes.select(*keys, *place, "rank", *[F.col(c).alias(f"a{c}") for c in BOX])
        hits = reach.hint("merge").join(members, [*keys, *place]).filter(G.box_iou("a", "b") >= iou)
        hits = stage(hits.select(*keys, "lrank", "rank"), "hits")
        winners = hits.groupBy(*keys, "lrank").agg(F.min("rank").alias("best")).filter("best = lrank")
        kept.append(stage(winners.select(*keys, F.col("lrank.q").alias(seq)), "kept"))
        gone = hits.join(winners.select(*keys, "lrank").hint("merge"), [*keys, "lrank"], "left_semi").select(*keys, "rank").distinct()
        open_boxes = stage(open_boxes.join(gone.hint("merge"), [*keys, "rank"], "left_anti"), "boxes")
    for part in kept:
        flat = flat.unionByName(part)
    return dets.join(flat.hint("merge"), [*keys, seq], "left_semi")


def crop_window(df: DataFrame, pad: int, x1, y1, x2, y2) -> DataFrame:
    """Padded pixel window clipped to the image columns ``width`` and ``height``."""
    return df.select(
        "*",
        F.greatest(F.lit(0), x1 - pad).cast("int").alias("wx1"), F.greatest(F.lit(0), y1 - pad).cast("int").alias("wy1"),
        F.least(F.col("width"), x2 + pad).cast("int").alias("wx2"), F.least(F.col("height"), y2 + pad).cast("int").alias("wy2"),
    )
