"""One large export document read by many tasks: byte ranges that find their own place in the JSON.

A task that starts in the middle of a document does not know whether it is inside a
string, nor how deep. Both answers are prepared for each range (first scan), the
driver runs through them from the document's start, one small row for each range, and
then every range knows its true state. The second scan hands out the objects that
start in a range and stand in an array of the top level, each read to its end, even
beyond the range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlines.session import fanout_partitions, scratch_path, stage
from planlines.sources.annotations import FILE_NAME, _file_system, _split_documents

#: Bytes of a range (a task reads at least as many, in one range or several), and of a step beyond it.
RANGE_BYTES, STEP_BYTES = 32 << 20, 64 << 10
#: Bytes of found objects that a task holds before it hands them on.
BATCH_BYTES = 8 << 20
IMAGE = "id bigint, file_name string, height int, width int"
ANNOTATION = "id bigint, image_id bigint, category_id int, keypoints array<double>"

_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*(?P<end>"?)|[{}\[\]]', re.DOTALL)
_REST = re.compile(rb'(?:[^"\\]|\\.)*(?P<end>"?)', re.DOTALL)
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.DOTALL)


class Document:
    """Random reads of one file."""

    def __init__(self, path: str):
        files, name = _file_system(path)
        self.file = files.open_input_file(name)
        self.size = self.file.size()

    def read(self, low: int, high: int) -> bytes:
        self.file.seek(low)
        return self.file.read(max(0, min(high, self.size) - low))

    def escaped(self, at: int) -> bool:
        """Does an odd number of backslashes stand right before ``at``? Only asked within strings."""
        n, low = 0, at
        while low:
            first = max(0, low - 64)
            piece = self.read(first, low)
            run = len(piece) - len(piece.rstrip(b"\\"))
            n, low = n + run, first
            if run < len(piece):
                break
        return n % 2 == 1


def _string_end(data: bytes, at: int) -> int | None:
    """Position after the quote that ends a string running at ``at``, None if it does not end here."""
    m = _REST.match(data, at)
    return m.end() if m.group("end") else None


def _effect(data: bytes, at: int | None) -> tuple[bool, int]:
    """Inside a string at the end, and the change of depth, from ``at`` outside strings (None: inside all the way)."""
    if at is None:
        return True, 0
    depth, open_string = 0, False
    for m in _TOKEN.finditer(data, at):
        c = m.group()[:1]
        if c == b'"':
            open_string = not m.group("end")
        else:
            depth += 1 if c in b"{[" else -1
    return open_string, depth


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened: dict[str, Document] = {}
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            doc = opened.get(r["path"]) or opened.setdefault(r["path"], Document(r["path"]))
            data = doc.read(r["low"], r["high"])
            inside = _string_end(data, 1 if doc.escaped(r["low"]) else 0)
            rows.append((r["path"], r["low"], *_effect(data, 0), *_effect(data, inside)))
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
        columns = zip(*rows) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["path", "low", "open0", "depth0", "open1", "depth1"])


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``path, at, name, text``: an array of the top level (its name), or an object in one (its text)."""
    opened: dict[str, Document] = {}
    held: list[tuple] = []
    size = 0

    def found() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], ["path", "at", "name", "text"])

    for batch in batches:
        for r in batch.to_pylist():
            doc = opened.get(r["path"]) or opened.setdefault(r["path"], Document(r["path"]))
            low, high, depth = r["low"], r["high"], r["depth"]
            data = doc.read(low, high)
            at = _string_end(data, 1 if doc.escaped(low) else 0) if r["inside"] else 0
            out: list[tuple] = []
            begin = None  # of an object whose end is still to come
            while at is not None:
                for m in _TOKEN.finditer(data, at):
                    c = m.group()[:1]
                    if c == b'"':
                        continue
                    if c in b"{[":
                        depth += 1
                        if depth == 2 and c == b"[" and low + m.start() < high:
                            before = doc.read(max(0, low + m.start() - 1024), low + m.start())
                            key = _KEY.search(before)
                            out.append((low + m.start(), key.group(1).decode() if key else "", None))
                        if depth == 3 and c == b"{" and low + m.start() < high:
                            begin = m.start()
                    else:
                        depth -= 1
                        if depth == 2 and begin is not None:
                            out.append((low + begin, None, data[begin : m.end()].decode("utf-8")))
                            begin = None
                            if low + m.end() >= high:
                                break
                if begin is None or low + len(data) >= doc.size:
                    break
                # the object goes on beyond what was read: read on, and go back to its start
                data, depth, at = data[begin:] + doc.read(low + len(data), low + 2 * len(data) + STEP_BYTES - begin), 2, 0
                low, begin = low + begin, None
            held += [(r["path"], *o) for o in out]
            size += sum(len(text or "") for _, _, text in out)
            if size >= BATCH_BYTES:
                yield found()
                held, size = [], 0
    if held:
        yield found()


def read_documents(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Images and raw annotations of the export document in every split folder below ``root``.

    Same rows as ``read_export``; a document of any size is read in ranges of
    ``range_bytes`` by many tasks, which take several ranges each where ranges are short.
    A missing array counts as empty.
    """
    names = _split_documents(root)
    ranges = []
    for _, path in names:
        size = Document(path).size
        ranges += [(path, low, min(size, low + range_bytes)) for low in range(0, size, range_bytes)]
    schema = "path string, low long, high long"
    total = sum(high - low for _, low, high in ranges)
    tasks = max(1, min(len(ranges), max(fanout_partitions(spark), -(-total // RANGE_BYTES))))
    table = spark.createDataFrame(ranges, schema).repartition(tasks, "path", "low")
    effects = table.mapInArrow(_scan, "path string, low long, open0 boolean, depth0 long, open1 boolean, depth1 long").collect()
    found = {(e["path"], e["low"]): e for e in effects}  # one small row for each range
    known, state, last = [], (False, 0), None
    for path, low, high in ranges:
        if path != last:
            state, last = (False, 0), path
        known.append((path, low, high, *state))
        e = found[path, low]
        state = (e["open1"], state[1] + e["depth1"]) if state[0] else (e["open0"], state[1] + e["depth0"])
    placed = spark.createDataFrame(known, schema + ", inside boolean, depth long").repartition(tasks, "path", "low")
    rows = stage(placed.mapInArrow(_objects, "path string, at long, name string, text string"), "objects")
    arrays = rows.filter("name is not null").select("path", "at", "name").collect()  # a few for each document
    split = F.lit(None).cast("string")
    section = F.lit(None).cast("string")
    for s, path in names:
        split = F.when(F.col("path") == path, s).otherwise(split)
    for a in sorted(arrays, key=lambda a: a["at"]):  # a later array of the same document takes over from its start on
        section = F.when((F.col("path") == a["path"]) & (F.col("at") > a["at"]), a["name"]).otherwise(section)
    objects = rows.filter("text is not null").select(split.alias("split"), section.alias("section"), "text")

    def parsed(name: str, schema: str) -> DataFrame:
        return objects.filter(F.col("section") == name).select("split", F.from_json("text", schema).alias("o")).select("split", "o.*")

    images = parsed("images", IMAGE).select("split", F.col("id").alias("image_id"), "file_name", "width", "height")
    annotations = parsed("annotations", ANNOTATION).select("split", F.col("id").alias("ann_id"), "image_id", "category_id", "keypoints")
    return images, annotations


def write_documents(images: DataFrame, annotations: DataFrame, root: str) -> None:
    """One export document for each split, under the export's own file name.

    The format asks for one file, so one task streams a split's rows into it in order;
    nothing is gathered.
    """
    spark = images.sparkSession

    def lines(df: DataFrame, ident: str, record, part: int) -> DataFrame:
        first = df.groupBy("split").agg(F.min(ident).alias("first"))
        text = F.concat(F.when(F.col(ident) == F.col("first"), " ").otherwise(","), F.to_json(record))
        return df.join(F.broadcast(first), "split").select("split", F.lit(part).alias("part"), F.col(ident).alias("place"), text.alias("value"))

    splits = images.select("split").distinct()
    fixed = [splits.select("split", F.lit(p).alias("part"), F.lit(0).cast("long").alias("place"), F.lit(t).alias("value"))
             for p, t in ((0, '{"info": {"note": "a \\"quoted\\" {brace] and a \\\\"}, "images": ['), (2, '], "annotations": ['), (4, ']}'))]
    image = F.struct(F.col("image_id").alias("id"), "file_name", "height", "width")
    annotation = F.struct(F.col("ann_id").alias("id"), "image_id", "category_id", "keypoints")
    rows = lines(images, "image_id", image, 1).unionByName(lines(annotations, "ann_id", annotation, 3))
    for f in fixed:
        rows = rows.unionByName(f)
    path = scratch_path(spark, "documents")
    rows.repartition("split").sortWithinPartitions("split", "part", "place").drop("part", "place").write.partitionBy("split").text(path)
    fs = spark._jvm.org.apache.hadoop.fs
    files = fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in files.listStatus(fs.Path(path)):  # one for each split
        name = folder.getPath().getName()
        if name.startswith("split="):
            target = fs.Path(f"{root}/{name[6:]}")
            files.mkdirs(target)
            (written,) = [f for f in files.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            files.rename(written.getPath(), fs.Path(target, FILE_NAME))
