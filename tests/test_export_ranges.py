"""Export documents read in byte ranges, against a plain parse of the whole text."""

import json
import random

from planlines.sources import annotations as A
from planlines.sources import export_ranges as D


def document(rng, n):
    """Nested, escaped and misleading content in every place the format allows."""
    junk = ["plain", 'quo"te', "back\\slash\\", "{brace", "]bracket[", '\\"', "é\n", "", "\\" * 5, '"images": [{"id": 99}]']
    images = [{"id": i, "file_name": rng.choice(junk) + f"{i}.jpg", "height": i, "width": 2 * i, "license": {"a": [1, {"b": rng.choice(junk)}]}} for i in range(n)]
    notes = [
        {"id": 1000 + i, "image_id": rng.randrange(n), "category_id": 1, "keypoints": [float(i), 1.0, 2.0, 3.5, 4.0, 2.0], "segmentation": [[1, 2], []],
         "text": rng.choice(junk) * rng.randrange(3)} for i in range(3 * n)
    ]
    return {"info": {"note": rng.choice(junk), "images": [{"id": 7}]}, "images": images, "licenses": [{"id": 5}], "annotations": notes, "tail": [1, [2]], "end": "}"}


def test_ranges_of_any_size_give_every_object_once(spark, tmp_path):
    rng = random.Random(3)
    docs = {"train": document(rng, 12), "valid": document(rng, 3), "empty": {"images": []}, "none": {}}
    for i, (split, doc) in enumerate(docs.items()):
        (tmp_path / split).mkdir()
        text = json.dumps(doc, indent=[None, 2, None, None][i], ensure_ascii=bool(i % 2))
        (tmp_path / split / A.FILE_NAME).write_text(text, encoding="utf-8")
    want_images = sorted((s, i["id"], i["file_name"], i["width"], i["height"]) for s, d in docs.items() for i in d.get("images", []))
    want_notes = sorted((s, a["id"], a["image_id"], a["category_id"], a["keypoints"]) for s, d in docs.items() for a in d.get("annotations", []))
    for size in (61, 1000, 1 << 20):
        images, notes = D.read_documents(spark, str(tmp_path), size)
        assert sorted(map(tuple, images.collect())) == want_images, size
        assert sorted(map(tuple, notes.collect())) == want_notes, size
    one = A.read_export(spark, str(tmp_path))[0]
    assert sorted(map(tuple, one.select("split", "image_id", "file_name", "width", "height").collect())) == want_images


def test_written_documents_are_read_back_by_several_tasks(spark, tmp_path):
    images = spark.range(300).selectExpr("if(id % 3 = 0, 'a', 'b') AS split", "id AS image_id", "concat('f\"', id) AS file_name", "1 AS height", "2 AS width")
    notes = spark.range(900).selectExpr("if(id % 2 = 0, 'a', 'b') AS split", "id AS ann_id", "id % 300 AS image_id", "1 AS category_id", "array(CAST(id AS DOUBLE)) AS keypoints")
    D.write_documents(images, notes, str(tmp_path))
    for split in ("a", "b"):
        doc = json.loads((tmp_path / split / A.FILE_NAME).read_text())
        assert len(doc["images"]) + len(doc["annotations"]) == {"a": 550, "b": 650}[split]
    got_images, got_notes = D.read_documents(spark, str(tmp_path), 4096)
    assert got_images.count() == 300 and sorted(map(tuple, got_notes.collect())) == sorted(map(tuple, notes.collect()))
