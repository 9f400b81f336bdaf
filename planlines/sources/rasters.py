"""Image files: listings for existence checks and decoded pixel tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlines.session import fanout_partitions, stage
from planlines.sources.annotations import _file_system


def stem(file_name):
    """File name without its last suffix."""
    return F.regexp_replace(file_name, r"\.[^.]*$", "")


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, file_name, length)`` of the files below ``root``; contents are never read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    )
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for folder in batch.column("path").to_pylist():
            files, base = _file_system(folder)
            scheme = folder[: folder.index("://") + 3] if "://" in folder else ""
            found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([scheme + i.path for i in found], pa.string()), pa.array([i.base_name for i in found], pa.string()),
                 pa.array([i.size or 0 for i in found], pa.int64()), pa.array([i.type == fs.FileType.Directory for i in found], pa.bool_())],
                ["path", "file_name", "length", "folder"],
            )


def walk_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, file_name, length)`` of the files below ``root``, listed by tasks, one folder each.

    Every round lists the folders that the last one found, so the rounds are the depth
    of the tree; the driver sees counts only and paths stay in a table. A missing root
    has no files.
    """
    folders, levels = spark.createDataFrame([(root.rstrip("/"),)], "path string"), []
    while True:
        dealt = folders.repartition(fanout_partitions(spark), "path")
        levels.append(stage(dealt.mapInArrow(_entries, "path string, file_name string, length long, folder boolean"), "listing"))
        folders = levels[-1].filter("folder").select("path")
        if folders.isEmpty():
            break
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.filter("not folder").drop("folder")


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                files, path = _file_system(f"{root}/{name}")
                files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(path) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([batch.column("name")], ["name"])

    return run


def write_files(contents: DataFrame, root: str) -> int:
    """Write ``contents (name, content binary)`` as one file each below ``root``; a repeated task writes the same file again."""
    return contents.select("name", "content").mapInArrow(_write(root), "name string").count()


def present(images: DataFrame, files: DataFrame) -> DataFrame:
    return images.join(files.select("file_name").distinct(), "file_name", "left_semi")


def missing(images: DataFrame, files: DataFrame) -> DataFrame:
    return images.join(files.select("file_name").distinct(), "file_name", "left_anti")


def read_image_files(spark: SparkSession, root: str) -> DataFrame:
    """Pixels ``(file_name, y, x, r, g, b)`` through Spark's own image source.

    The decoded buffer is row-major with blue first; grey images repeat their one
    channel. One file is decoded by one task, so very large plans should arrive as a
    pixel table instead.
    """
    img = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root).select("image.*")
    width, channels = F.col("width"), F.col("nChannels")
    rows = img.select(
        F.element_at(F.split("origin", "/"), -1).alias("file_name"), "width", "nChannels", "data",
        F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"),
    )
    line = F.substring("data", F.col("y") * width * channels + 1, width * channels)
    cells = rows.select("file_name", "nChannels", "y", "width", line.alias("line")).select(
        "file_name", "nChannels", "y", "line", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x")
    )

    def channel(k: int):
        at = F.col("x") * channels + F.when(channels == 1, F.lit(0)).otherwise(F.lit(k)) + 1
        return F.conv(F.hex(F.substring("line", at, F.lit(1))), 16, 10).cast("int")

    return cells.select("file_name", "y", "x", channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"))
