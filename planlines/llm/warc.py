"""WARC archives with records compressed one by one against a Zstandard dictionary."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlines.llm.texts import utf8
from planlines.session import scratch_path, stage

# Fixed values of the formats: frame magics, and the names of header fields.
DICT_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # a skippable frame without content, magic 0x184D2A50
WARC_VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
# End of fixed values.

#: Records the dictionary is built from, the largest of them, and its size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 400, 64 << 10, 64 << 10
#: Payload bytes of one archive file.
FILE_BYTES = 24 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
FIELDS = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def _record(page_id, url: str | None, html: bytes, n: int, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit holds only its headers."""
    revisit = refers_to is not None
    block = (HTTP_HEAD % n) + (b"" if revisit else html)
    head = [
        WARC_VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {n}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(pages: DataFrame, n: int) -> bytes:
    """Dictionary from a bounded sample of ``pages``, which has ``n`` rows.

    About ``SAMPLE_RECORDS`` pages of at most ``SAMPLE_BYTES``, chosen by a hash of
    id and content. The sample changes only how small the archive gets. Where there
    are too few records to train on, the headers every record has serve instead.
    """
    some = pages.select("page_id", "url", utf8("html").alias("html")).filter(F.length("html") <= SAMPLE_BYTES)
    spot = F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 40))
    limit = int(min(1.0, SAMPLE_RECORDS / max(n, 1)) * (1 << 40))
    rows = some.filter(spot < F.lit(limit)).limit(2 * SAMPLE_RECORDS).collect()
    records = [_record(r.page_id, r.url, bytes(r.html), len(r.html), _digest(bytes(r.html)), None) for r in rows]
    try:
        return zstandard.train_dictionary(DICT_BYTES, records).as_bytes() if len(records) >= 8 else _record(0, "", b"", 0, "", None)
    except zstandard.ZstdError:
        return _record(0, "", b"", 0, "", None)


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    raw = data[:4] != struct.pack("<I", 0xEC30A437)
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT)


def _encode(dictionary: bytes, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = zstandard.ZstdCompressor(level=level).compress(dictionary)
        lead = struct.pack("<II", DICT_MAGIC, len(packed)) + packed
        press = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_checksum=True)
        mark, first_id = None, None
        for batch in batches:
            out = []
            for page_id, sha, kind, url, html, noted in zip(*batch.columns):
                key = (page_id.as_py(), sha.as_py())
                if kind.as_py() == 0:
                    mark, first_id = key, noted.as_py()
                    continue
                html = html.as_py()
                record = _record(key[0], url.as_py(), html, len(html), _digest(html), first_id if mark == key else None)
                out += [lead] if lead else []
                lead = b""
                out.append(press.compress(record))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    return run


def write_archive(pages: DataFrame, path: str, min_payload: int = 0, level: int = 3) -> None:
    """Write ``pages (page_id, url, html)`` as ``.warc.zst`` content below ``path``.

    Each file starts with a skippable frame that holds the dictionary, compressed,
    and goes on with one Zstandard frame for each record. Spark's text writer puts
    the frames down as they are, with an empty skippable frame as its separator, so
    the output commit of Spark covers lost tasks and any file system it knows.

    Of pages with equal payloads (by SHA-1) of at least ``min_payload`` bytes the
    smallest id is the response and the others revisit it; smaller ones are all
    responses. Null html is an empty payload, null url has no target field. Rows
    that repeat the smallest id are all responses, and so are rows with a null id.
    Empty tables give an empty archive. Other columns are ignored.

    Payloads move once: who revisits whom is found on digests, and these marks are
    dealt out with the pages, by id and digest, to one task for each file, where a
    mark sorts just before its page.
    """
    html = utf8("html")
    sha = F.sha1(html).alias("sha")
    keys = pages.filter(F.length(html) >= min_payload).select("page_id", sha)
    first = keys.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = stage(first.filter("n > 1 and first_id is not null").select("sha", "first_id"), "first")
    marks = keys.join(first, "sha").filter("page_id > first_id").distinct()
    size = pages.agg(F.sum(F.length(html)).alias("bytes"), F.count("*").alias("n")).first()
    files = 1 + int((size["bytes"] or 0) // FILE_BYTES)
    rows = pages.select("page_id", sha, F.lit(1).alias("kind"), "url", html.alias("html"), F.lit(None).cast("long").alias("first_id"))
    noted = marks.select("page_id", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
                         F.lit(None).cast("binary").alias("html"), "first_id")
    dealt = rows.unionByName(noted).repartition(files, "page_id", "sha").sortWithinPartitions("page_id", "sha", "kind", "url")
    frames = dealt.mapInArrow(_encode(train_dictionary(pages, size["n"]), level), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option(
        "maxRecordsPerFile", 0
    ).text(path)


def _frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """``(magic, content)`` of skippable frames, and ``(0, rest)`` at the start of each other frame."""
    at = 0
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            n = struct.unpack_from("<I", data, at + 4)[0]
            yield magic, data[at + 8 : at + 8 + n]
            at += 8 + n
        else:
            end = yield 0, memoryview(data)[at:]
            at += end


def _parse(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (_digest(payload) != digest or len(payload) != int(fields["X-Payload-Bytes"])):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "payload_bytes": int(fields["X-Payload-Bytes"]), "payload_digest": digest,
        "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if response else None,
    }


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ])
    for batch in batches:
        for file in batch.column("content"):
            data, press, out, size = file.as_py(), None, [], 0
            frames = _frames(data)
            item = next(frames, None)
            while item is not None:
                magic, content = item
                if magic == DICT_MAGIC and press is None:
                    press = zstandard.ZstdDecompressor(dict_data=_dictionary(zstandard.ZstdDecompressor().decompress(content)))
                if magic:
                    item = next(frames, None)
                    continue
                one = press.decompressobj()
                record = one.decompress(content)
                out.append(_parse(record))
                size += len(record)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
                try:
                    item = frames.send(len(content) - len(one.unused_data))
                except StopIteration:
                    item = None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files below ``path``; every response's payload is checked against its digest.

    A file is one row of bounded size (``FILE_BYTES`` of payload, or one record).
    """
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    return files.select("content").mapInArrow(_decode, FIELDS)


def archived(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write ``pages`` as an archive in the shared scratch folder and read it back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path, min_payload)
    return read_archive(spark, path)
