"""Session defaults and the shared area where long lineages are cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
#: Bytes that a task gathers before it writes them to a staged table; several tasks share an executor.
ROW_GROUP = 32 << 20


def build_session(name: str = "planlines", cpus: str | int = "*", **conf) -> SparkSession:
    """Local session with the settings the jobs assume; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def fanout_partitions(spark: SparkSession) -> int:
    """Partition count for exchanges whose rows grow afterwards (explodes, tile work).

    The runtime re-planner sizes partitions by their input bytes and would shrink
    these too far, so they get the session's own count, which a job sets by its data.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_root(spark: SparkSession) -> str:
    """Folder for written intermediate tables.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    session may fall back to a temporary folder of the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/planlines/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    Cuts the lineage of iterative jobs, survives the loss of executors, and gives
    the next plan real file sizes and column pruning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def release(staged: DataFrame) -> None:
    """Delete a table that ``stage`` wrote, once nothing that is still to run reads it."""
    path = getattr(staged, "_staged_at", None)
    if path:
        jvm, conf = staged.sparkSession._jvm, staged.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
