"""Byte ranges of export documents and the tasks that read them."""

from pyspark.sql import functions as F

from planlines.sources import export_ranges as D


def test_short_ranges_share_tasks(spark, tmp_path, monkeypatch):
    images = spark.range(300).select(F.lit("a").alias("split"), F.col("id").alias("image_id"), F.lit("f").alias("file_name"), F.lit(1).alias("height"), F.lit(2).alias("width"))
    notes = spark.createDataFrame([], "split string, ann_id long, image_id long, category_id int, keypoints array<double>")
    D.write_documents(images, notes, str(tmp_path))
    tasks, stage = [], D.stage
    monkeypatch.setattr(D, "stage", lambda df, name: tasks.append(df.rdd.getNumPartitions()) or stage(df, name))
    assert sorted(r["image_id"] for r in D.read_documents(spark, str(tmp_path), 64)[0].collect()) == list(range(300))
    assert tasks == [4]  # before, one for each range of 64 bytes
