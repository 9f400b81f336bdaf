"""Column expressions for scores, ratios and per-pixel losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def bce_with_logits(z: Column, t: Column, pos_weight: float = 1.0) -> Column:
    """Binary cross entropy in the form that can not overflow."""
    soft = F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))
    return (F.lit(1.0) - t) * z + (F.lit(1.0) + F.lit(pos_weight - 1.0) * t) * soft


def focal(z: Column, t: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p = sigmoid(z)
    hit = t * p + (F.lit(1.0) - t) * (F.lit(1.0) - p)
    weight = t * F.lit(alpha) + (F.lit(1.0) - t) * F.lit(1.0 - alpha)
    return weight * F.pow(F.lit(1.0) - hit, F.lit(gamma)) * bce_with_logits(z, t)


def dice_ratio(inter: Column, total: Column) -> Column:
    """(2·inter + eps) / (total + eps): 1 when both sides are empty."""
    return (F.lit(2.0) * inter + F.lit(EPS)) / (total + F.lit(EPS))


def iou_ratio(inter: Column, union: Column) -> Column:
    return (inter + F.lit(EPS)) / (union + F.lit(EPS))


def channel_normalize(v: Column, mean: float, std: float) -> Column:
    return (v / F.lit(255.0) - F.lit(mean)) / F.lit(std)


def channel_denormalize(v: Column, mean: float, std: float) -> Column:
    """Back to [0, 1], clipped."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v * F.lit(std) + F.lit(mean)))


def warmup_weight(weight: float, warmup: int, epoch: Column) -> Column:
    """Linear ramp from 0 to ``weight`` over ``warmup`` epochs (1-based)."""
    if warmup <= 0:
        return F.lit(float(weight))
    return F.lit(float(weight)) * F.least(F.lit(1.0), epoch / F.lit(warmup))
