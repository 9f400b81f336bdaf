"""Annotation exports: keypoint JSON documents per split folder, and their split summary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlines.operators.ranking import percentiles

DOCUMENT = (
    "images array<struct<id:bigint,file_name:string,height:int,width:int>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:int,keypoints:array<double>>>"
)
FILE_NAME = "_annotations.coco.json"


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _split_documents(root: str) -> list[tuple[str, str]]:
    """(split, path) of the export document in every split folder: a handful of names."""
    from pyarrow import fs

    files, base = _file_system(root)
    scheme = root[: root.index("://") + 3] if "://" in root else ""
    folders = [i for i in files.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory]
    found = [(d.base_name, f"{d.path}/{FILE_NAME}") for d in folders]
    there = files.get_file_info([p for _, p in found])
    return [(s, f"{scheme}{p}") for (s, p), i in zip(found, there) if i.type == fs.FileType.File]


def _read_texts(batches):
    for batch in batches:
        texts = []
        for path in batch["path"]:
            files, name = _file_system(path)
            with files.open_input_stream(name) as stream:
                texts.append(stream.read().decode("utf-8"))
        yield pd.DataFrame({"split": batch["split"], "text": texts})


def read_export(spark: SparkSession, root: str, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Images and raw annotations of every split folder below ``root``.

    A missing list counts as empty. The export's own file name starts with an
    underscore, which Spark's file sources hide, so each of these few documents is
    opened by a task of its own and parsed there. An export rewritten as one document
    per line (``pattern``) scans in parallel through the JSON source.
    """
    if pattern is None:
        names = _split_documents(root)
        paths = spark.createDataFrame(names, "split string, path string").repartition(max(1, len(names)), "path")
        texts = paths.mapInPandas(_read_texts, "split string, text string")
        docs = texts.select("split", F.from_json("text", DOCUMENT).alias("d")).select("split", "d.*")
    else:
        docs = spark.read.schema(DOCUMENT).json(f"{root}/{pattern}")
        split = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        docs = docs.select("images", "annotations", F.regexp_replace(split, "^split=", "").alias("split"))
    images = docs.select("split", F.explode("images").alias("i")).select(
        "split", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height"
    )
    annotations = docs.select("split", F.explode("annotations").alias("a")).select(
        "split", F.col("a.id").alias("ann_id"), "a.image_id", "a.category_id", "a.keypoints"
    )
    return images, annotations


def write_export(images: DataFrame, annotations: DataFrame, root: str, per_document: int = 1000) -> None:
    """Write images ``(split, image_id, …)`` and annotations as export documents of bounded size, one per line."""
    numbered = [
        (images, F.col("image_id"), F.struct(F.col("image_id").alias("id"), "file_name", "height", "width"), "images"),
        (annotations, F.col("ann_id"), F.struct(F.col("ann_id").alias("id"), "image_id", "category_id", "keypoints"), "annotations"),
    ]
    for df, ident, record, name in numbered:
        docs = df.groupBy("split", F.floor(ident / per_document).alias("part")).agg(F.collect_list(record).alias(name))
        docs.drop("part").write.mode("append").partitionBy("split").json(root)


def flatten_keypoints(annotations: DataFrame) -> DataFrame:
    """Keypoint array ``[x1, y1, v1, x2, y2, v2]`` as columns; short arrays give NULLs."""
    at = {"x1": 0, "y1": 1, "v1": 2, "x2": 3, "y2": 4, "v2": 5}
    cols = [F.get("keypoints", F.lit(i)).alias(n) for n, i in at.items()]
    return annotations.select("*", F.size("keypoints").alias("n_kps"), *cols).drop("keypoints")


def line_chords(flat: DataFrame, images: DataFrame, category: int = 1, min_visibility: int = 1) -> DataFrame:
    """Annotations that are usable chords of known images."""
    visible = (F.col("v1").cast("int") >= min_visibility) & (F.col("v2").cast("int") >= min_visibility)
    kept = flat.filter((F.col("category_id") == category) & (F.col("n_kps") >= 6) & visible)
    chord = kept.select("image_id", F.col("ann_id").alias("chord_id"), "x1", "y1", "x2", "y2", "v1", "v2")
    return chord.join(images.select("image_id", "split"), "image_id")


def split_summary(images: DataFrame, chords: DataFrame) -> DataFrame:
    """Per split: images, chords, min/median/max chords per image (zeros count), size ranges."""
    counts = chords.groupBy("image_id").agg(F.count("*").alias("n"))
    per_image = images.join(counts, "image_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    base = per_image.groupBy("split").agg(
        F.count("*").alias("n_images"), F.sum("n").alias("n_chords"), F.min("n").alias("min_chords"),
        F.max("n").alias("max_chords"), F.min("width").alias("min_width"), F.max("width").alias("max_width"),
        F.min("height").alias("min_height"), F.max("height").alias("max_height"),
    )
    return base.join(percentiles(per_image, ["split"], "n", {"median_chords": 0.5}), "split")
