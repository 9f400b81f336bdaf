"""CSV reports with fixed number formats, the result manifest, and run histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planlines.operators.ranking import running
from planlines.sources.rasters import stem

MANIFEST = (
    "split string, image_id long, image_file string, dice_before double, dice_after double, dice_delta double, "
    "len_skel_ratio_before double, len_skel_ratio_after double, fp_before long, fp_after long, fp_dropped long, "
    "fn_before long, fn_after long, fn_added long, n_components long, n_dropped long, pixels_dropped long, "
    "n_symbols long, n_sym_irr long, n_sym_call long"
)


def _even_ties(value: Column) -> Column:
    """Values that lie exactly between two numbers of four decimals (odd multiples of 1/32) go to the even one before they are printed."""
    v = value.cast("double")
    return F.when(F.abs(v) * 32 % 2 == 1, F.bround(v, 4)).otherwise(v)


def fixed4(value: Column) -> Column:
    """Four decimals; an undefined value prints as nan."""
    return F.when(value.isNull(), F.lit("nan")).otherwise(F.format_string("%.4f", _even_ties(value)))


def signed4(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("nan")).otherwise(F.format_string("%+.4f", _even_ties(value)))


def write_csv(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.option("header", True)
    (writer.partitionBy(partition) if partition else writer).csv(path)


def result_manifest(spark: SparkSession, csv_path: str, files: DataFrame) -> DataFrame:
    """Typed report rows whose rendered ``split/stem.jpg`` exists, with a delta class."""
    rows = spark.read.schema(MANIFEST).option("header", True).option("nanValue", "nan").csv(csv_path)
    rows = rows.withColumn("jpg", F.concat_ws("/", "split", F.concat(stem(F.col("image_file")), F.lit(".jpg"))))
    found = files.select(F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2)).alias("jpg"))
    return rows.join(found.distinct(), "jpg", "left_semi").withColumn("delta_class", delta_class(F.col("dice_delta")))


def delta_class(v: Column) -> Column:
    return F.when(v > 0.0005, "pos").when(v < -0.0005, "neg").otherwise("zero")


# --- run histories ----------------------------------------------------------

METRICS = ["val_dice", "val_iou", "val_total"]
#: The series of a run history.
SERIES = [
    "train_total", "train_dice_loss", "val_total", "val_dice_loss", "val_dice", "val_iou", "val_cldice",
    "val_length_ratio_pixel_mean", "val_length_ratio_pixel_median", "val_length_ratio_pixel_p25", "val_length_ratio_pixel_p75",
    "val_length_ratio_skel_mean", "val_length_ratio_skel_median", "val_length_ratio_skel_p25", "val_length_ratio_skel_p75", "lr",
]


def write_histories(long: DataFrame, path: str, metrics: list[str] = METRICS) -> None:
    """JSON records of parallel arrays in epoch order, one per run and thousand epochs."""
    rows = long.groupBy("run_id", F.floor(F.col("epoch") / 1000).alias("part")).agg(F.array_sort(F.collect_list(F.struct("epoch", *metrics))).alias("h"))
    rows.select("run_id", "part", *[F.col(f"h.{c}").alias(c) for c in ["epoch", *metrics]]).write.json(path)


def read_histories(spark: SparkSession, path: str, metrics: list[str] = METRICS) -> DataFrame:
    """Long form: one row per run and position in it; arrays of a run may differ in length.

    A piece starts where the pieces before it end; a run has a row for each piece there.
    """
    cols = ", ".join(f"{m} array<double>" for m in metrics)
    df = spark.read.schema(f"run_id long, part long, epoch array<int>, {cols}").json(path)
    zipped = F.arrays_zip("epoch", *metrics)
    sizes = df.groupBy("run_id", "part").agg(F.max(F.size(zipped)).alias("size"))
    before = Window.partitionBy("run_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("run_id", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    rows = df.join(starts, ["run_id", "part"]).select("run_id", "start", F.posexplode(zipped).alias("at", "h"))
    return rows.select("run_id", (F.col("start") + F.col("at")).cast("int").alias("pos"), "h.*")


def best_epoch(history: DataFrame, metric: str = "val_dice") -> DataFrame:
    """Epoch with the highest metric, the earliest on ties."""
    best = F.max(F.struct(F.col(metric).alias("m"), (-F.col("epoch")).alias("ne")))
    return history.groupBy("run_id").agg(best.alias("b"), F.count("*").alias("n_epochs"), F.max("epoch").alias("last_epoch")).select(
        "run_id", "n_epochs", "last_epoch", (-F.col("b.ne")).alias("best_epoch"), F.col("b.m").alias("best_value")
    )


def improved_epochs(history: DataFrame, metric: str = "val_dice") -> DataFrame:
    """Every epoch with the best value before it (starting at -1) and whether it improved on it.

    ``improved`` holds when the running maximum rises, which a strict comparison with
    the previous maximum is: equal values do not count.
    """
    firsts = history.groupBy("run_id", metric).agg(F.min("epoch").alias("first"))
    ran = running(history.select("run_id", "epoch", metric), ["run_id"], [F.col("epoch")], {"top": ("max", metric)})
    joined = ran.join(firsts, ["run_id", metric])
    improved = (F.col(metric) == F.col("top")) & (F.col("first") == F.col("epoch")) & (F.col(metric) > -1)
    return joined.select("run_id", "epoch", metric, F.greatest("top", F.lit(-1.0)).alias("best_so_far"), improved.alias("improved"))


def history_report(history: DataFrame, every: int = 5, metric: str = "val_dice", metrics: list[str] = METRICS) -> DataFrame:
    """Every ``every``-th epoch of a run, its best and its last, with a mark on the best."""
    one = history.withColumn("_one", F.lit(1).cast("long"))
    placed = running(one, ["run_id"], [F.col("epoch")], {"pos": ("sum", "_one")})
    joined = placed.join(best_epoch(history, metric).select("run_id", "best_epoch"), "run_id")
    is_best = F.col("epoch") == F.col("best_epoch")
    shown = ((F.col("pos") - 1) % every == 0) | is_best | (F.col("pos") == F.col("pos_total"))
    return joined.filter(shown).select(
        "run_id", "epoch", "pos", *metrics, F.when(is_best, "BEST").otherwise("").alias("mark")
    )
