"""Loss values as queries over a (sample, logit, target) table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlines.functions import scoring as SC
from planlines.operators.morphology import soft_skeleton_sums
from planlines.operators.ranking import running
from planlines.session import stage


def pixel_losses(
    scored: DataFrame, by: list[str], pos_weight: float = 1.0, dice_weight: float = 1.0,
    alpha: float = 0.25, gamma: float = 2.0,
) -> DataFrame:
    """BCE, soft Dice, focal and their weighted sums per group, in one aggregation."""
    z, t = F.col("logit"), F.col("target").cast("double")
    p = SC.sigmoid(z)
    sums = scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(SC.bce_with_logits(z, t, pos_weight)).alias("bce"),
        F.avg(SC.focal(z, t, alpha, gamma)).alias("focal"),
        F.sum(p * t).alias("inter"), (F.sum(p) + F.sum(t)).alias("total"),
    )
    dice = F.lit(1.0) - SC.dice_ratio(F.col("inter"), F.col("total"))
    w = F.lit(float(dice_weight))
    return sums.withColumn("dice_loss", dice).select(
        *by, "n", "bce", "focal", "dice_loss",
        (F.col("bce") + w * F.col("dice_loss")).alias("bce_dice"),
        (F.col("focal") + w * F.col("dice_loss")).alias("focal_dice"),
    )


def loss_sums() -> list[Column]:
    """Aggregates of pixels that add up: ``n, bce_sum, p_t, p_plus_t`` for ``summed_losses``."""
    z, t = F.col("logit"), F.col("target").cast("double")
    p = SC.sigmoid(z)
    return [F.count("*").alias("n"), F.sum(SC.bce_with_logits(z, t)).alias("bce_sum"), F.sum(p * t).alias("p_t"), (F.sum(p) + F.sum(t)).alias("p_plus_t")]


def summed_losses(sums: DataFrame, by: list[str]) -> DataFrame:
    """BCE and soft Dice loss per group from rows of ``loss_sums``."""
    total = sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "bce_sum", "p_t", "p_plus_t")])
    dice = F.lit(1.0) - SC.dice_ratio(F.col("p_t"), F.col("p_plus_t"))
    return total.select(*by, "n", (F.col("bce_sum") / F.col("n")).alias("bce"), dice.alias("dice_loss"))


def batch_mean(sample_losses: DataFrame, by: list[str], loss: str, batch: str) -> DataFrame:
    """Mean over batches of the batch means, not the mean over samples."""
    per_batch = sample_losses.groupBy(*by, batch).agg(F.avg(loss).alias("_b"))
    return per_batch.groupBy(*by).agg(F.count("*").alias("n_batches"), F.avg("_b").alias(loss))


def lovasz_hinge(scored: DataFrame, by: list[str]) -> DataFrame:
    """Lovász hinge of each group.

    Errors are sorted and the Jaccard loss differenced along them; equal errors form
    one step, which leaves the sum unchanged, so rows are first counted per distinct
    error. Only positive errors can contribute; the total of positives is all that is
    needed of the rest.
    """
    sign = F.lit(2.0) * F.col("target") - 1
    errors = scored.select(*by, (F.lit(1.0) - F.col("logit") * sign).alias("err"), F.col("target").cast("long").alias("t"))
    # written first: the pixels are read once, and a group with most of the errors splits in the join below
    counts = stage(errors.groupBy(*by, "err").agg(F.sum("t").alias("pos"), F.sum(1 - F.col("t")).alias("neg")), "errors")
    sizes = stage(counts.groupBy(*by).agg(F.sum("pos").alias("all_pos")), "sizes")
    steps = running(counts.filter("err > 0"), by, [F.col("err").desc()], {"cp": ("sum", "pos"), "cn": ("sum", "neg")})
    joined = steps.join(sizes, by)

    def jaccard(pos, neg):
        return F.when(pos + neg == 0, F.lit(0.0)).otherwise(
            F.lit(1.0) - (F.col("all_pos") - pos) / (F.col("all_pos") + neg)
        )

    after = jaccard(F.col("cp"), F.col("cn"))
    before = jaccard(F.col("cp") - F.col("pos"), F.col("cn") - F.col("neg"))
    loss = joined.groupBy(*by).agg(F.sum(F.col("err") * (after - before)).alias("lovasz"))
    return sizes.join(loss, by, "left").select(*by, F.coalesce("lovasz", F.lit(0.0)).alias("lovasz"))


def soft_cldice(scored: DataFrame, by: list[str], iterations: int = 3, smooth: float = 1.0) -> DataFrame:
    """Soft centreline Dice loss per group; ``smooth`` also sits in the last denominator."""
    dense = scored.select(*dict.fromkeys([*by, "image_id"]), "y", "x", SC.sigmoid(F.col("logit")).alias("p"), F.col("target").cast("double").alias("t"))
    pieces = soft_skeleton_sums(dense, "p", "t", [c for c in by if c != "image_id"], iterations)
    s = F.lit(float(smooth))
    sums = pieces.groupBy(*by).agg(
        ((F.sum("skel_p_t") + s) / (F.sum("skel_p") + s)).alias("tprec"),
        ((F.sum("skel_t_p") + s) / (F.sum("skel_t") + s)).alias("tsens"),
    )
    cl = F.lit(2.0) * F.col("tprec") * F.col("tsens") / (F.col("tprec") + F.col("tsens") + s)
    return sums.select(*by, "tprec", "tsens", (F.lit(1.0) - cl).alias("cldice_loss"))


def composite(
    parts: DataFrame, epochs: int, keys: list[str], dice_weight: float = 1.0,
    cldice_weight: float = 0.5, cldice_warmup: int = 5, lovasz_weight: float = 0.5, lovasz_warmup: int = 0,
) -> DataFrame:
    """Weighted total per epoch from component values ``bce dice_loss cldice_loss lovasz``."""
    per_epoch = parts.select("*", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    total = (
        F.col("bce") + F.lit(float(dice_weight)) * F.col("dice_loss")
        + SC.warmup_weight(cldice_weight, cldice_warmup, F.col("epoch")) * F.col("cldice_loss")
        + SC.warmup_weight(lovasz_weight, lovasz_warmup, F.col("epoch")) * F.col("lovasz")
    )
    return per_epoch.select(*keys, "epoch", total.alias("total"))
