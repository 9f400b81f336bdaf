"""Incremental symbol ingest and running metrics as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from planlines.functions import scoring as SC
from planlines.operators.symbols import near_line
from planlines.sources.symbol_cache import RECORD


def ingest_symbols(spark: SparkSession, source: str, images: DataFrame, runs: DataFrame, target: str,
                   checkpoint: str, margin: float = 0.3, max_files: int = 1000) -> None:
    """Label the symbols of newly arrived files and append them to ``target``.

    The file source and its checkpoint decide what is new. A batch writes its own
    folder, replacing it when the batch is repeated after a failure, so every file
    lands exactly once.
    """
    files = (
        spark.readStream.schema(RECORD).option("maxFilesPerTrigger", max_files).json(source)
        .select("split", "image", F.explode("symbols").alias("s"))
        .select("split", "image", F.col("s.id").alias("crop_id"), "s.x1", "s.y1", "s.x2", "s.y2", "s.conf")
    )

    def label(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.join(images.select("split", F.col("file_name").alias("image"), "image_id"), ["split", "image"])
        near_line(keyed, images, runs, "crop_id", margin).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (
        files.writeStream.foreachBatch(label).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def running_overlap(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Running tp/fp/fn sums per run over arriving score files, one output folder per batch.

    Only sums are kept as state (one row per run), so the ratio is computed on read;
    distribution metrics are not mergeable this way and stay batch jobs.
    """
    counts = spark.readStream.schema(schema).parquet(source).groupBy("run_id").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")
    )

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (
        counts.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_running(spark: SparkSession, target: str) -> DataFrame:
    """Latest sums of every run with Dice and IoU."""
    rows = spark.read.parquet(target)
    last = rows.groupBy("run_id").agg(F.max_by(F.struct("tp", "fp", "fn"), "batch").alias("s")).select("run_id", "s.*")
    return last.withColumn("dice", SC.dice_ratio(F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).withColumn(
        "iou", SC.iou_ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))
    )


EVENT = "run_id long, seq long, kind string, tp long, fp long, fn long"
_SUMS = ("tp", "fp", "fn")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Sums of a run since its last reset; one row of them for each micro-batch that touches the run."""
    resets, updates, sums = state.get if state.exists else (0, 0, [0, 0, 0])
    sums = list(sums)
    events = pd.concat(list(batches)).sort_values("seq")
    last = events.loc[events["kind"] == "reset", "seq"].max()
    if pd.notna(last):
        resets += int((events["kind"] == "reset").sum())
        updates, sums = 0, [0, 0, 0]
        events = events[events["seq"] > last]
    mine = events[events["kind"] == "update"]
    updates += len(mine)
    sums = [a + int(b) for a, b in zip(sums, mine[list(_SUMS)].sum())]
    state.update((resets, updates, sums))
    yield pd.DataFrame({"run_id": [key[0]], "resets": [resets], "updates": [updates], **{c: [v] for c, v in zip(_SUMS, sums)}})


def overlap_since_reset(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """Running tp/fp/fn of every run over arriving event files, cleared by ``reset`` events.

    ``source``: Parquet files of EVENT rows in the order of ``seq``; a micro-batch takes
    ``files_per_batch`` of them, and a task holds one run's events of a micro-batch. State is one small record for each run, kept by the
    checkpoint, so a restarted job goes on where it stopped. Batches write a folder each
    and replace it when they are repeated.
    """
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    out = "run_id long, resets long, updates long, tp long, fp long, fn long"
    kept = "resets long, updates long, sums array<long>"
    running = events.groupBy("run_id").applyInPandasWithState(_advance, out, kept, "update", GroupStateTimeout.NoTimeout)

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (
        running.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_since_reset(spark: SparkSession, target: str) -> DataFrame:
    """Latest record of every run with Dice and the number of micro-batches that touched it."""
    rows = spark.read.parquet(target)
    fields = ("resets", "updates", *_SUMS)
    last = rows.groupBy("run_id").agg(F.count("*").alias("n_batches"), F.max_by(F.struct(*fields), "batch").alias("s")).select("run_id", "n_batches", "s.*")
    return last.withColumn("dice", SC.dice_ratio(F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
