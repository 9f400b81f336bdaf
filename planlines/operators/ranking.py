"""Ranks, running totals, percentiles and curve metrics that never need one big window.

A plain window sorts a whole group in one task. ``running`` range-partitions by
(keys, order) instead, so a group that holds most of the rows spreads over many
partitions; only one total per (group, partition) is combined globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planlines.session import fanout_partitions, stage


def running(
    df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, tuple[str, str]]
) -> DataFrame:
    """Add inclusive running values ``{name: ("sum" | "max", column)}`` in ``order`` within ``keys``.

    Rows must be unique under (keys, order). The partition number is written down
    with the rows, so a recomputed task can not disagree about it. Each value also
    comes with ``{name}_total``, its value over the whole group.
    """
    parts = fanout_partitions(df.sparkSession)
    spread = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    rows = stage(spread, "running")
    agg = {"sum": F.sum, "max": F.max}
    pieces = rows.groupBy(*keys, "_part").agg(*[agg[op](c).alias(f"_t_{n}") for n, (op, c) in totals.items()])
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *keys, "_part",
        *[agg[op](f"_t_{n}").over(before).alias(f"_o_{n}") for n, (op, _) in totals.items()],
        *[agg[op](f"_t_{n}").over(group).alias(f"{n}_total") for n, (op, _) in totals.items()],
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(offsets, [*keys, "_part"])
    for n, (op, c) in totals.items():
        local, offset = agg[op](c).over(inside), F.col(f"_o_{n}")
        value = F.greatest(local, offset) if op == "max" else local + F.coalesce(offset, F.lit(0))
        out = out.withColumn(n, value)
    return out.drop("_part", *[f"_o_{n}" for n in totals])


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position in ``order`` within ``keys``; the order must be total."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running(one, keys, order, {name: ("sum", "_one")}).drop("_one", f"{name}_total")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows of each group; Spark cuts each map task to n rows per group first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return first.withColumn(name, F.col(name).cast("long"))


def percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated percentiles, one row per group; NULLs are ignored."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranked = running(counts, keys, [F.col("_v")], {"_cum": ("sum", "_n")}).withColumnRenamed("_cum_total", "_total")
    aggs = []
    for i, p in enumerate(probs.values()):
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        for edge, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (F.col("_cum") > rank) & (F.col("_cum") - F.col("_n") <= rank)
            aggs.append(F.min(F.when(here, F.col("_v"))).alias(f"_{edge}{i}"))
    picked = ranked.groupBy(*keys, "_total").agg(*aggs)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (pos - F.floor(pos))).alias(name))
    return picked.select(*keys, *out)


def _score_counts(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Positives and negatives of every distinct score: all a curve needs."""
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.col(positive).cast("long")).alias("pos"), F.sum(1 - F.col(positive).cast("long")).alias("neg")
    )


def roc_auc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Exact area under the ROC curve with tied scores at half weight; NULL with one class."""
    counts = _score_counts(df, keys, score, positive)
    ranked = running(counts, keys, [F.col("score")], {"cum_neg": ("sum", "neg")})
    won = F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2)
    sums = ranked.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(won).alias("won"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    auc = F.when(both, F.col("won") / (F.col("n_pos").cast("double") * F.col("n_neg")))
    return sums.select(*keys, "n_pos", "n_neg", auc.alias("auc"))


def pr_curve(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Precision and recall at every distinct threshold, plus the terminal point (1, 0)."""
    counts = _score_counts(df, keys, score, positive)
    ranked = running(counts, keys, [F.col("score").desc()], {"tp": ("sum", "pos"), "fp": ("sum", "neg")})
    sizes = counts.groupBy(*keys).agg(F.sum("pos").alias("n_pos"))
    points = ranked.withColumnRenamed("tp_total", "n_pos").select(
        *keys, (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos")).otherwise(F.lit(1.0)).alias("recall"),
    )
    terminal = sizes.select(*keys, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(terminal)


def pr_at_targets(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Best precision at recall ≥ .5/.8/.9 and best recall at precision ≥ .8/.9/.95."""
    curve = pr_curve(df, keys, score, positive)
    best = [
        F.max(F.when(F.col("recall") >= t, F.col("precision"))).alias(f"p_at_r{int(t * 100)}") for t in (0.5, 0.8, 0.9)
    ] + [
        F.max(F.when(F.col("precision") >= t, F.col("recall"))).alias(f"r_at_p{int(t * 100)}") for t in (0.8, 0.9, 0.95)
    ]
    return curve.groupBy(*keys).agg(*best)


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram between minimum and maximum, the last bin closed."""
    limits = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_no = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)))
    known = df.filter(F.col(value).isNotNull())
    ranged = known.withColumn("lo", limits.select("lo").scalar()).withColumn("hi", limits.select("hi").scalar())
    placed = ranged.withColumn("bin", F.coalesce(bin_no, F.lit(0)).cast("int"))
    return placed.groupBy("bin").agg(F.count("*").alias("n"))
