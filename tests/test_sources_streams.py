"""Scans, sinks and streams on small written files."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from planlines import session
from planlines.sources import annotations as A
from planlines.sources import rasters as P
from planlines.sources import reports as O
from planlines.sources import symbol_cache as C
from planlines.streaming import ingest as S


def test_pretty_printed_export(spark, tmp_path):
    for split, doc in {
        "train": {"images": [{"id": 1, "file_name": "a.b.jpg", "width": 10, "height": 8, "extra": 1}],
                  "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "keypoints": [1, 2, 2, 3, 4, 1]}, {"id": 2, "image_id": 1, "category_id": 1, "keypoints": [1, 2]},
                                  {"id": 3, "image_id": 1, "category_id": 1, "keypoints": [1, 2, 0, 3, 4, 1]}, {"id": 4, "image_id": 9, "category_id": 1, "keypoints": [1, 2, 1, 3, 4, 1]},
                                  {"id": 5, "image_id": 1, "category_id": 2, "keypoints": [1, 2, 1, 3, 4, 1]}]},
        "valid": {"images": [{"id": 2, "file_name": "c.jpg", "width": 5, "height": 5}]},
    }.items():
        (tmp_path / split).mkdir()
        (tmp_path / split / A.FILE_NAME).write_text(json.dumps(doc, indent=2))
    images, ann = A.read_export(spark, str(tmp_path))
    assert {(r["split"], r["image_id"]) for r in images.collect()} == {("train", 1), ("valid", 2)}
    chords = A.line_chords(A.flatten_keypoints(ann), images)
    assert [r["chord_id"] for r in chords.collect()] == [1]
    summary = {r["split"]: r for r in A.split_summary(images, chords).collect()}
    assert summary["valid"]["n_chords"] == 0 and summary["train"]["median_chords"] == 1.0


def png(path, rows):
    """A tiny RGB PNG file."""
    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in rows)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_pixels_and_listing(spark, tmp_path):
    rows = [[(10 * y + x, 50 + x, 200 + y) for x in range(4)] for y in range(3)]
    png(tmp_path / "a.png", rows)
    got = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in P.read_image_files(spark, str(tmp_path)).collect()}
    assert got == {(y, x): rows[y][x] for y in range(3) for x in range(4)}
    images = spark.createDataFrame([(1, "a.png"), (2, "b.png")], "image_id long, file_name string")
    files = P.list_files(spark, str(tmp_path), "*.png")
    assert [r["image_id"] for r in P.present(images, files).collect()] == [1]
    assert [r["image_id"] for r in P.missing(images, files).collect()] == [2]


def symbols(spark, names):
    rows = [("train", n, f"{n}-{i}", 1.0, 1.0, 5.0, 5.0, 0.5, [0.1, 0.2], None if i == 2 else i == 0) for n in names for i in range(3)]
    return spark.createDataFrame(rows, "split string, image string, id string, x1 double, y1 double, x2 double, y2 double, conf double, embedding array<float>, near_gt boolean")


def test_cache_round_trip_and_blocks(spark, tmp_path):
    path = str(tmp_path / "cache")
    C.write_cache(symbols(spark, ["a", "b"]), path)
    back = C.read_cache(spark, path, ["train"])
    assert back.count() == 6 and C.training_symbols(back).count() == 4
    assert C.read_cache(spark, path, ["nowhere"]).isEmpty()
    assert C.cached_images(spark, path).count() == 2
    big = symbols(spark, [f"x{i}" for i in range(50)]).withColumn("image", F.lit("one"))
    records = C.cache_records(big, 20)
    assert records.count() > 1 and records.select(F.sum(F.size("symbols"))).first()[0] == 150


def test_missing_symbols_read_as_empty(spark, tmp_path):
    d = tmp_path / "c" / "split=train"
    d.mkdir(parents=True)
    (d / "a.json").write_text('{"image": "a"}\n')
    (d / "b.json").write_text('{"image": "b", "symb')
    rows = C.read_cache(spark, str(tmp_path / "c")).collect()
    assert [(r["image"], r["id"]) for r in rows if r["image"]] == [("a", None)]
    assert [r["image"] for r in C.cached_images(spark, str(tmp_path / "c")).collect()] == ["a"]


def test_history_ties_and_marks(spark):
    dice = [0.1, 0.5, 0.4, 0.5, 0.6, 0.6, 0.2]
    df = spark.createDataFrame([(1, e + 1, v, v / 2, 1 - v) for e, v in enumerate(dice)], "run_id long, epoch int, val_dice double, val_iou double, val_total double")
    best = O.best_epoch(df).first()
    assert (best["best_epoch"], best["n_epochs"], best["last_epoch"]) == (5, 7, 7)
    assert [r["epoch"] for r in O.improved_epochs(df).orderBy("epoch").collect() if r["improved"]] == [1, 2, 5]
    report = O.history_report(df, every=3).orderBy("epoch").collect()
    assert [(r["epoch"], r["mark"]) for r in report] == [(1, ""), (4, ""), (5, "BEST"), (7, "")]


def test_number_formats(spark):
    row = spark.createDataFrame([(0.12345, -0.00004, None)], "a double, b double, c double").select(
        O.fixed4(F.col("a")), O.signed4(F.col("b")), O.fixed4(F.col("c")), O.delta_class(F.col("b")), O.delta_class(F.lit(0.0006))).first()
    assert tuple(row) == ("0.1235", "-0.0000", "nan", "zero", "pos")


def test_stream_picks_up_only_new_files(spark, tmp_path):
    images = spark.createDataFrame([("train", "a", 1, 20, 20), ("train", "b", 2, 20, 20)], "split string, file_name string, image_id long, width int, height int")
    runs = spark.createDataFrame([(1, 3, 0, 19)], "image_id long, y int, x0 int, x1 int")
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    C.write_cache(symbols(spark, ["a"]), src)
    S.ingest_symbols(spark, src, images, runs, out, mark)
    S.ingest_symbols(spark, src, images, runs, out, mark)  # nothing new
    C.cache_records(symbols(spark, ["b"])).drop("block").write.mode("append").partitionBy("split").json(src)
    S.ingest_symbols(spark, src, images, runs, out, mark)
    got = {r["crop_id"]: r["near_gt"] for r in spark.read.parquet(out).collect()}
    assert len(got) == spark.read.parquet(out).count() == 6
    assert got["a-0"] is True and got["b-0"] is None


def test_running_sums_resume(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "run_id long, tp long, fp long, fn long"
    spark.createDataFrame([(1, 5, 1, 0), (2, 0, 0, 0)], schema).write.parquet(src)
    S.running_overlap(spark, src, schema, out, mark)
    spark.createDataFrame([(1, 3, 0, 2)], schema).write.mode("append").parquet(src)
    S.running_overlap(spark, src, schema, out, mark)
    got = {r["run_id"]: (r["tp"], r["fp"], r["fn"], round(r["dice"], 4)) for r in S.read_running(spark, out).collect()}
    assert got == {1: (8, 1, 2, 0.8421), 2: (0, 0, 0, 1.0)}


def test_cluster_session_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Fake:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(Fake())


def test_cache_versions_switch_whole(spark):
    root = session.scratch_path(spark, "versions")
    rows = lambda n: spark.range(n).selectExpr(
        "'train' AS split", "concat('i', id % 2) AS image", "CAST(id AS STRING) AS id", "0.0D AS x1", "0.0D AS y1", "1.0D AS x2", "1.0D AS y2",
        "0.5D AS conf", "array(0.5F) AS embedding", "true AS near_gt",
    )
    seen = lambda: C.read_cache(spark, C.current(spark, root)).filter("id is not null").count()
    assert C.current(spark, root) is None
    C.switch(spark, root, C.write_version(rows(5), root))
    assert seen() == 5
    new = C.write_version(rows(9), root)  # a job that stops here has changed nothing
    assert seen() == 5
    C.switch(spark, root, new)
    assert seen() == 9


def test_files_are_listed_by_tasks(spark, tmp_path):
    from planlines.sources import rasters

    names = ["a/b/1.jpg", "a/2.jpg", "3.jpg", "c/_hidden.json", "c/d/e/4 x.png"]
    df = spark.createDataFrame([(n, b"xy") for n in names], "name string, content binary")
    assert rasters.write_files(df, str(tmp_path)) == 5
    (tmp_path / "none").mkdir()
    got = rasters.walk_files(spark, str(tmp_path)).collect()
    assert sorted(r["path"] for r in got) == sorted(f"{tmp_path}/{n}" for n in names)
    assert {r["length"] for r in got} == {2} and {r["file_name"] for r in got} == {n.rsplit("/", 1)[-1] for n in names}
    assert rasters.walk_files(spark, f"{tmp_path}/missing").count() == 0


def test_stream_is_cleared_by_resets_and_goes_on_after_a_stop(spark, tmp_path):
    source, target, mark = (f"{tmp_path}/{n}" for n in ("events", "out", "mark"))
    put = lambda rows: spark.createDataFrame(rows, S.EVENT).coalesce(1).write.mode("append").parquet(source)
    put([(1, 2, "update", 5, 1, 1), (1, 1, "update", 2, 0, 0), (2, 3, "update", 9, 9, 9)])
    S.overlap_since_reset(spark, source, target, mark)
    first = {r["run_id"]: r for r in S.read_since_reset(spark, target).collect()}
    assert (first[1]["tp"], first[1]["updates"], first[1]["resets"]) == (7, 2, 0)
    put([(1, 6, "update", 3, 1, 0), (1, 5, "reset", 0, 0, 0), (1, 4, "update", 100, 0, 0)])
    put([(2, 7, "reset", 0, 0, 0), (2, 8, "reset", 0, 0, 0), (1, 9, "update", 1, 0, 2)])
    S.overlap_since_reset(spark, source, target, mark)
    got = {r["run_id"]: r for r in S.read_since_reset(spark, target).collect()}
    assert [got[1][c] for c in ("tp", "fp", "fn", "updates", "resets", "n_batches")] == [4, 1, 2, 2, 1, 3]
    assert [got[2][c] for c in ("tp", "fp", "fn", "updates", "resets", "n_batches")] == [0, 0, 0, 0, 2, 2]
