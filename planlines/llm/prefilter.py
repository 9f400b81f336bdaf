"""A filter of fixed size that spares rows nobody asks for the way through a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter. Spark's bitmaps hold 32768 each, so it is at most 1025 rows of 4 KB.
FILTER_BITS = 1 << 25


def free(taken: list[str], *names: str) -> list[str]:
    """The names with so many underscores in front that no column of ``taken`` has them (case does not matter)."""
    mark = "_"
    while any(c.lower().startswith(mark + "pf_") for c in taken):
        mark += "_"
    return [f"{mark}pf_{n}" for n in names]


def split(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` that may be among ``ids (doc_id)``, and rows that surely are not.

    A bitmap of hashed ids goes to all tasks; it has one size whatever the input.
    Once it fills up it lets more rows through, never fewer, and an exact join is to
    follow on the first part. Rows without id are surely not among them. Columns of
    ``docs`` may have any names.
    """
    bucket, bits, spot, byte = free(docs.columns, "bucket", "bits", "spot", "byte")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    packed = ids.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias(bucket)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias(bits)
    )
    rows = docs.withColumn(bucket, F.bitmap_bucket_number(slot)).withColumn(spot, F.bitmap_bit_position(slot))
    value = F.conv(F.hex(F.expr(f"substring({bits}, CAST({spot} DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    rows = rows.join(F.broadcast(packed), bucket, "left").withColumn(byte, value)
    maybe = F.coalesce(F.expr(f"shiftright({byte}, CAST({spot} % 8 AS INT)) & 1 = 1"), F.lit(False)) & F.col("doc_id").isNotNull()
    return rows.filter(maybe).select(*_columns(docs)), rows.filter(~maybe).select(*_columns(docs))


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def having(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` that may be among ``ids``; the join that follows is exact."""
    return split(docs, ids)[0]


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not among ``ids (doc_id)``. Rows without id stay."""
    some, rest = split(docs, ids)
    return rest.unionByName(some.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*_columns(docs)))
