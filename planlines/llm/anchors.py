"""Substring dedup with fixed-block anchors: repeats of 50 words found through aligned blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlines.llm.prefilter import free, having, split
from planlines.llm.texts import WordHashes, by_group, hashes, rolling, slices, starts_of, task, utf8
from planlines.session import stage

WINDOW = 50
#: Any window of WINDOW words holds a whole aligned block of this many.
BLOCK = WINDOW // 2
#: Words whose probes share a bucket.
BUCKET_WORDS = 1_500_000


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def word_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, sha``: number of words, and the hash of the words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for text in batch.column("text"):
                words = text.as_py().split()
                n.append(len(words))
                sha.append(_digest(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "sha"]
            )

    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(task(run), "doc_id long, n_words long, sha string")


def _flat(batch: pa.RecordBatch, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a batch in one array, and where each text starts and the last ends."""
    parts = [hashes(t.as_py().split(), known) for t in batch.column("text")]
    ends = np.cumsum([0, *map(len, parts)])
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), ends


def _probes(buckets: int):
    """Every rolling block hash of every text, dealt by bucket and packed by (bucket, slice).

    A row holds the ids of the texts with hashes in this bucket, how many each has,
    and the hashes' low halves with the lowest bit telling anchors, the blocks that
    start at a multiple of BLOCK, from the other windows of BLOCK words.
    """
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for batch in slices(whole, "text"):
                x, ends = _flat(batch, known)
                n = np.maximum(np.diff(ends) - BLOCK + 1, 0)
                if not n.sum():
                    continue
                text = np.repeat(np.arange(len(n), dtype=np.int32), n)
                within = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
                h = rolling(x, BLOCK)[ends[:-1][text] + within]
                bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(kind)
                low = (h.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | (within % BLOCK == 0)
                order = np.argsort(bucket, kind="stable")
                bucket, text, low = bucket[order], text[order], low[order]
                runs = starts_of([bucket, text])
                counts = np.diff(np.append(runs, len(low))).astype(np.uint32)
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[text[runs]]
                rows = starts_of([bucket[runs]])
                cuts, to = rows[1:], runs[rows[1:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[runs[rows]].astype(np.int32)), _packed(ids, cuts), _packed(counts, cuts), _packed(low, to)],
                    ["bucket", "ids", "counts", "low"],
                )

    return run


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.split(values, cuts)], pa.binary())


PROBE = "bucket int, ids binary, counts binary, low binary"


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Text id and packed hash of each probe of a bucket."""
    joined = {c: b"".join(x.as_py() for x in table.column(c)) for c in ("ids", "counts", "low")}
    ids = np.repeat(np.frombuffer(joined["ids"], np.int64), np.frombuffer(joined["counts"], np.uint32).astype(np.int64))
    return ids, np.frombuffer(joined["low"], np.uint32)


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of a bucket that one text holds as an anchor and another text holds anywhere.

    Gives one row for each text and bucket: the text's matching hashes.
    """
    for table in _buckets(batches):
        ids, low = _unpack(table)
        key = np.sort(((low >> np.uint32(1)).astype(np.uint64) << np.uint64(32)) | np.arange(len(low), dtype=np.uint64))
        at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ids, anchor, half = ids[at], (low[at] & 1).astype(bool), (key >> np.uint64(32)).astype(np.uint32)
        starts = starts_of([half])
        hit = np.logical_or.reduceat(anchor, starts) & (np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts))
        hit = np.repeat(hit, np.diff(np.append(starts, len(half))))
        ids, half = ids[hit], half[hit]
        order = np.argsort(ids, kind="stable")
        ids, half = ids[order], half[order]
        runs = starts_of([ids])
        if len(runs):
            yield pa.RecordBatch.from_arrays([pa.array(ids[runs], pa.int64()), _packed(half, runs[1:])], ["doc_id", "low"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Each bucket's rows together, from a stream sorted by bucket."""
    for table in by_group(batches, ["bucket"], lambda t: iter([t])):
        starts = starts_of([table.column("bucket").to_numpy()])
        for a, b in zip(starts, np.append(starts[1:], table.num_rows)):
            yield table.slice(a, b - a)


def _spans(starts: np.ndarray, n_words: int) -> np.ndarray:
    """Words covered by windows at ``starts``."""
    cover = np.zeros(n_words + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all windows of WINDOW words that hold a matching block: (hash, doc_id), one row each."""
    known = WordHashes()
    for batch in batches:
        ids, out = [], []
        for doc_id, text, lists in zip(batch.column("doc_id"), batch.column("text"), batch.column("lows")):
            h, start = _candidates(hashes(text.as_py().split(), known), lists.as_py())
            u = np.unique(h[start])
            out.append(u)
            ids.append(np.full(len(u), doc_id.as_py(), np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(out).view(np.int64) if out else []), pa.array(np.concatenate(ids) if ids else [], pa.int64())],
            ["h", "doc_id"],
        )


def _candidates(x: np.ndarray, lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes of a text, and the starts of those windows around its matching blocks."""
    blocks, windows = rolling(x, BLOCK), rolling(x, WINDOW)
    match = np.isin(blocks.astype(np.uint32) >> np.uint32(1), np.frombuffer(b"".join(lists), np.uint32))
    # a window holds a match if one starts within its first WINDOW - BLOCK + 1 words
    seen = np.concatenate([[0], np.cumsum(match)])
    at = np.arange(len(windows))
    return windows, at[seen[at + WINDOW - BLOCK + 1] > seen[at]]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the words of repeated windows from each text; ``kept`` is what is left."""
    known = WordHashes()
    for batch in batches:
        out = []
        for text, repeats in zip(batch.column("text"), batch.column("repeats")):
            words = text.as_py().split()
            h = rolling(hashes(words, known), WINDOW)
            gone = _spans(np.flatnonzero(np.isin(h.view(np.int64), np.array(repeats.as_py(), np.int64))), len(words))
            kept = [w for w, g in zip(words, gone.tolist()) if not g]
            out.append((_digest(words), int(gone.sum()), _digest(kept), b" ".join(kept)))
        cols = list(zip(*out)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", "sha", "n_removed", "kept_sha256", "kept"]
        )


def removals(docs: DataFrame) -> DataFrame:
    """Words to remove from each row of ``docs (doc_id, text)``.

    Returns ``doc_id, n_words, n_removed, kept_sha256, kept, sha``, one row for each row
    with an id. A word goes if a window of WINDOW words covers it whose sequence
    also starts in a document with a smaller id. ``kept`` is the words left, joined
    by single spaces, or null where none is removed.

    1. A copy of a document with a smaller id goes whole, by the hash of all words.
    2. Blocks of BLOCK words at multiples of BLOCK are the anchors. Every rolling
       window of BLOCK words probes them: hashes are dealt into buckets of fixed
       size, packed by text, and those that meet an anchor of another text match.
       A repeated window always holds an anchor of the text it repeats.
    3. Texts with matches meet them, and each window of WINDOW words around a match,
       on either side, is hashed whole. The smallest id of each hash decides, so a
       passage in any number of documents takes as many rows as it has occurrences,
       and no pairs. The union of the windows decided on is the maximal repeat.

    Null text has no words. Texts under WINDOW words stay as they are. Rows without
    id are not judged and not returned. Rows that repeat an id and its text are
    alike; two texts under one id are each judged against smaller ids only.
    """
    docs = docs.filter("doc_id is not null").select("doc_id", "text")
    digests = stage(word_digests(docs), "digests")
    copies = stage(
        digests.filter(F.col("n_words") >= WINDOW).groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1").select("sha", "first_id"), "copies",
    )
    rows = stage(digests.join(copies, "sha", "left").withColumn("copy", F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))).drop("first_id"), "rows")
    words = rows.agg(F.sum("n_words")).first()[0] or 0
    buckets = 1 + int(words // BUCKET_WORDS)
    probes = docs.select("doc_id", utf8("text").alias("text")).mapInArrow(task(_probes(buckets)), PROBE)
    found = stage(probes.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(task(_matches), "doc_id long, low binary"), "matches")
    units = rows.filter(~F.col("copy")).select("doc_id").distinct()
    lows = found.join(units, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("low").alias("lows"))
    lows = stage(lows, "lows")
    candidates = having(docs.select("doc_id", utf8("text").alias("text")), lows)
    texts = stage(candidates.join(lows, "doc_id"), "texts")
    windows = texts.mapInArrow(task(_windows), "h long, doc_id long")
    first = windows.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    first = stage(first.filter("first_id < last_id").select("h", "first_id"), "windows")
    repeats = windows.join(first, "h").filter("doc_id > first_id").groupBy("doc_id").agg(F.collect_list("h").alias("repeats"))
    cut = texts.select("doc_id", "text").join(repeats, "doc_id").mapInArrow(
        task(_cut), "doc_id long, sha string, n_removed long, kept_sha256 string, kept binary"
    ).filter("n_removed > 0").dropDuplicates(["doc_id", "sha"])
    cut = stage(cut, "cut")
    judged = rows.join(cut, ["doc_id", "sha"], "left")
    gone = F.col("copy") & (F.col("n_words") >= WINDOW)
    return judged.select(
        "doc_id", "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, F.lit("")).otherwise(F.col("kept").cast("string")).alias("kept"),
        "sha",
    )


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeats cut out of their texts; documents with nothing left go.

    All columns stay, whatever their names; ``n_chars``, where there is one, follows
    the text. Rows without id stay as they are, and so do texts that had no words.
    """
    ident, sha, kept, cuts, left = free(docs.columns, "id", "sha", "kept", "cuts", "left")
    cut = removals(docs).filter("n_removed > 0").select(F.col("doc_id").alias(ident), F.col("sha").alias(sha), F.col("kept").alias(kept))
    cut = stage(cut.dropDuplicates([ident, sha]), "removed")
    some, rest = split(docs, cut.select(F.col(ident).alias("doc_id")))
    joined = some.join(cut.groupBy(ident).agg(F.map_from_entries(F.collect_list(F.struct(sha, kept))).alias(cuts)),
                       F.col("doc_id") == F.col(ident), "left")
    words = F.array_join(F.split(F.btrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+", -1), " ")
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.coalesce(F.element_at(cuts, F.sha2(words, 256)), F.col("text")))
    out = joined.withColumn(left, text).filter(F.col(cuts).isNull() | (F.col(left) != ""))
    columns = [
        F.col(left).alias(c) if c == "text" else F.length(left).cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`")
        for c, t in docs.dtypes
    ]
    return rest.unionByName(out.select(*columns))
