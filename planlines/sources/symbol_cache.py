"""Per-image symbol records and detection payloads as JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlines.session import stage

SYMBOL = "struct<id:string,x1:double,y1:double,x2:double,y2:double,conf:double,embedding:array<float>,near_gt:boolean>"
RECORD = f"image string, symbols array<{SYMBOL}>, split string"
MAX_SYMBOLS = 10_000


def write_cache(symbols: DataFrame, path: str) -> None:
    """One record per image and block of symbols, in a folder per split.

    ``block`` is part of every record: an image with more than MAX_SYMBOLS symbols
    has several, and readers see rows. Rewrites go to a new folder.
    """
    cache_records(symbols).write.partitionBy("split").json(path)


def write_version(symbols: DataFrame, root: str) -> str:
    """Write the cache as a new version below ``root``; readers of ``root`` do not see it yet."""
    name = f"version-{uuid.uuid4().hex}"
    write_cache(symbols, f"{root}/{name}")
    return name


def switch(spark: SparkSession, root: str, name: str) -> None:
    """Make ``name`` the version that readers of ``root`` get.

    The pointer is a file with the version's name, written aside and renamed over the
    old one in one step, so a reader finds the old version or the new one, whole. A
    job that stops before the rename leaves the old one in force.
    """
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    aside, pointer = fs.Path(f"{root}/next-{uuid.uuid4().hex}"), fs.Path(f"{root}/CURRENT")
    out = aside.getFileSystem(conf).create(aside, True)
    out.writeBytes(name)
    out.close()
    options = spark._sc._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    options[0] = getattr(fs, "Options$Rename").OVERWRITE
    fs.FileContext.getFileContext(aside.toUri(), conf).rename(aside, pointer, options)


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the version in force, None before the first switch."""
    fs = spark._jvm.org.apache.hadoop.fs
    pointer = fs.Path(f"{root}/CURRENT")
    if not pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer):
        return None
    return f"{root}/{spark.read.text(f'{root}/CURRENT').first()[0]}"


def cache_records(symbols: DataFrame, per_record: int = MAX_SYMBOLS) -> DataFrame:
    """Symbols ``(split, image, id, x1..y2, conf, embedding, near_gt)`` grouped into records.

    The block number comes from a hash of the id, over a block count taken from the
    image's own size, so no record outgrows its bound even for a huge image. Symbols are
    read twice, so they are written out and their plan runs once.
    """
    symbols = stage(symbols, "symbols")
    sizes = symbols.groupBy("split", "image").agg(F.ceil(F.count("*") / per_record).alias("blocks"))
    # the sizes are written first: both sides of the join are then plain exchanges, and an image with most symbols splits
    blocked = symbols.join(stage(sizes, "sizes"), ["split", "image"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    record = F.struct("id", "x1", "y1", "x2", "y2", "conf", "embedding", "near_gt")
    return blocked.groupBy("split", "image", "block").agg(F.array_sort(F.collect_list(record)).alias("symbols"))


def read_cache(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """One row per symbol; an image without symbols gives one row of NULLs.

    ``splits`` prunes folders. Unreadable records give no rows and are reported by
    ``cached_images`` as absent, so they are redone.
    """
    df = spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path)
    if splits is not None:
        df = df.filter(F.col("split").isin(splits))
    return df.select("split", "image", F.explode_outer("symbols").alias("s")).select("split", "image", "s.*")


def training_symbols(cache: DataFrame) -> DataFrame:
    """Symbols with a known label; an unknown label never trains."""
    return cache.filter("near_gt is not null")


def cached_images(spark: SparkSession, path: str) -> DataFrame:
    """Images with a readable record; the symbols take part in the test, or they would not be parsed."""
    schema = f"{RECORD}, _corrupt_record string"
    df = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    readable = F.col("_corrupt_record").isNull() & (F.coalesce(F.size("symbols"), F.lit(0)) >= 0)
    return df.groupBy("split", "image").agg(F.bool_and(readable).alias("ok")).filter("ok").drop("ok")


def pending_images(images: DataFrame, done: DataFrame) -> DataFrame:
    """Images still to process: those without a readable record."""
    return images.join(done, ["split", "image"], "left_anti")


def attach_embeddings(detections: DataFrame, embeddings: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Detections with their embedding; those without are dropped, or refused when ``strict``."""
    if not strict:
        joined = detections.join(embeddings, key)
    else:
        found = detections.join(embeddings, key, "left")
        msg = F.concat(F.lit("no embedding for "), F.col(key).cast("string"))
        joined = found.filter(F.when(F.col("embedding").isNull(), F.raise_error(msg)).otherwise(F.lit(True)))
    return joined.withColumn("embedding_dim", F.size("embedding"))


def detection_payload(raw: DataFrame, normalized: DataFrame, embedded: DataFrame, keys: list[str]) -> DataFrame:
    """Per image: raw and normalised counts, embedding shape; the lists stay in their own tables."""
    n_raw = raw.groupBy(*keys).agg(F.count("*").alias("num_raw_localizations"))
    n_det = normalized.groupBy(*keys).agg(F.count("*").alias("num_detections"))
    emb = embedded.groupBy(*keys).agg(F.count("*").alias("n_embeddings"), F.max("embedding_dim").alias("dim"))
    df = n_raw.join(n_det, keys, "left").join(emb, keys, "left").na.fill(0)
    shape = F.format_string("[%d, %d]", "n_embeddings", F.col("dim").cast("long"))
    return df.select(*keys, "num_raw_localizations", "num_detections", shape.alias("embedding_shape"))


DETECTION = "struct<id:bigint,x1:double,y1:double,x2:double,y2:double,conf:double>"
CLASSIFICATION = "struct<id:bigint,embedding_dim:int>"


def payload_records(payload: DataFrame, normalized: DataFrame, embedded: DataFrame, keys: list[str], ident: str, per_record: int = MAX_SYMBOLS) -> DataFrame:
    """The payload with its lists: ``keys, block``, the counts, ``detections`` and ``classifications`` in the order of their ids.

    A record holds at most about ``per_record`` detections, so an image with more has
    several blocks, each with the image's counts; an image without detections has one.
    """
    dims = embedded.select(*keys, ident, "embedding_dim")
    joined = normalized.join(dims, [*keys, ident], "left").join(stage(payload.select(*keys, "num_detections"), "counts"), keys)
    blocked = joined.withColumn("block", F.pmod(F.xxhash64(ident), F.ceil(F.col("num_detections") / per_record)))
    detection = F.struct(F.col(ident).alias("id"), "x1", "y1", "x2", "y2", "conf")
    known = F.when(F.col("embedding_dim").isNotNull(), F.struct(F.col(ident).alias("id"), "embedding_dim"))
    lists = blocked.groupBy(*keys, "block").agg(
        F.array_sort(F.collect_list(detection)).alias("detections"), F.array_sort(F.collect_list(known)).alias("classifications")
    )
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return payload.join(lists, keys, "left").withColumns({
        "block": F.coalesce("block", F.lit(0).cast("long")), "detections": F.coalesce("detections", none(DETECTION)),
        "classifications": F.coalesce("classifications", none(CLASSIFICATION)),
    })


def write_payload(payload: DataFrame, normalized: DataFrame, embedded: DataFrame, path: str) -> None:
    """The payload as JSON, detections and embeddings as Parquet columns beside it."""
    payload.write.json(f"{path}/payload")
    normalized.write.parquet(f"{path}/detections")
    embedded.write.parquet(f"{path}/embeddings")
