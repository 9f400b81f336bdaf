"""Ranked lexical search by NRA: impact-sorted lists read in step, score intervals, no random access.

Documents are dealt into shards as the scan delivers them. A shard's lists hold the
impacts of a term in falling order; for an item all its lists are read to the same
depth, and every document has a lower bound (what was read of it) and an upper one
(plus the next unread impact of each list it has not turned up in). Reading goes on
until no document that may still be among the best has an open interval: that settles
who is in, which scores are equal, and what the scores are.

Statistics (documents, lengths, document frequencies) are those of the whole table. A
shard's best are all that can be among the table's best, so shards only meet in a
ranking of at most ``k`` rows each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlines.llm.texts import slices, task, utf8
from planlines.operators.ranking import running, top_n
from planlines.session import stage

#: Terms (with repeats) of the items that meet the documents at a time.
BLOCK_TERMS = 1 << 20
#: Postings and documents of a shard.
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 15
#: Postings read of each list in the first round; every round doubles the depth.
FIRST_DEPTH = 128
#: Groups in which the shards' best of an item meet before they meet as a whole.
SALTS = 64

_TERM_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms stay, A-Z becomes a-z, any other ASCII character a blank.
FOLD = bytes(
    c if c >= 0x80 or c in _TERM_BYTES else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Known(dict):
    """term -> number, -1 where no item holds the term."""

    def __missing__(self, term: bytes) -> int:
        return -1


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """``doc_id, n, ids, tfs``: length of each text and how often it holds which of the ``vocabulary`` (broadcast list of terms).

    ``ids`` and ``tfs`` are packed 32-bit numbers. Every row of ``docs`` with a term is a
    document of its own, whatever its id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known((t, i) for i, t in enumerate(vocabulary.value))
        for whole in batches:
            for batch in slices(whole, "text"):
                n, ids, tfs, some = [], [], [], []
                for text in batch.column("text"):
                    words = terms(text.as_py())
                    some.append(bool(words))
                    if words:
                        found = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                        number, often = np.unique(found[found >= 0], return_counts=True)
                        n.append(len(words))
                        ids.append(number.tobytes())
                        tfs.append(often.astype(np.int32).tobytes())
                doc_ids = batch.column("doc_id").filter(pa.array(some, pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], ["doc_id", "n", "ids", "tfs"]
                )

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return known.mapInArrow(task(run), "doc_id long, n long, ids binary, tfs binary")


def frequencies(index: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms with repeats, and the document frequency of each of ``size`` terms, added up by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                df[np.frombuffer(ids.as_py(), np.int32)] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["id", "df"])

    total = index.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = np.zeros(size, np.int64)
    for r in index.select("ids").mapInArrow(task(run), "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r["id"]] = r["df"]
    return total["n"], total["l"], df


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * ((1000000000 * tf) // (1000 * tf + 12 * m))


class Shard:
    """Impact-sorted lists of the terms of some documents."""

    def __init__(self, n: list[int], ids: list[bytes], tfs: list[bytes], w: np.ndarray, all_docs: int, all_terms: int):
        number = [np.frombuffer(b, np.int32) for b in ids]
        sizes = [len(x) for x in number]
        self.docs = len(n)
        doc = np.repeat(np.arange(self.docs, dtype=np.int64), sizes)
        term = np.concatenate([*number, np.empty(0, np.int32)]).astype(np.int64)
        tf = np.concatenate([*[np.frombuffer(b, np.int32) for b in tfs], np.empty(0, np.int32)]).astype(np.int64)
        m = np.array([75 + (25 * length * all_docs) // max(all_terms, 1) for length in n], np.int64)
        value = impacts(w[term], tf, m[doc])
        order = np.lexsort((-value, term))
        self.doc, self.value, term = doc[order], value[order], term[order]
        self.terms, self.starts = np.unique(term, return_index=True)
        self.ends = np.append(self.starts[1:], len(term))

    def lists(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the ``wanted`` terms have a list here, and where it starts and ends."""
        at = np.searchsorted(self.terms, wanted)
        here = np.flatnonzero(at < len(self.terms))
        here = here[self.terms[at[here]] == wanted[here]]
        return here, self.starts[at[here]], self.ends[at[here]]

    def best(self, wanted: np.ndarray, repeats: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the ``k`` best with a score of at least ``floor``, and their exact scores."""
        here, starts, ends = self.lists(wanted)
        times = repeats[here]
        lower = np.zeros(self.docs, np.int64)
        read, depth = starts.copy(), FIRST_DEPTH
        while True:
            upto = np.minimum(starts + depth, ends)
            for a, b, q in zip(read.tolist(), upto.tolist(), times.tolist()):
                lower[self.doc[a:b]] += q * self.value[a:b]
            read = upto
            # the next unread impact of a list bounds all its unread ones
            ahead = [int(q * self.value[b]) if b < e else 0 for b, e, q in zip(read.tolist(), ends.tolist(), times.tolist())]
            gap = np.full(self.docs, sum(ahead), np.int64)
            for a, b, f in zip(starts.tolist(), read.tolist(), ahead):
                if f:
                    gap[self.doc[a:b]] -= f
            at_least = max(floor, 1)
            if self.docs >= k:
                at_least = max(at_least, int(np.partition(lower, self.docs - k)[self.docs - k]))
            if not ((gap > 0) & (lower + gap >= at_least)).any():
                found = np.flatnonzero(lower >= at_least)
                return found, lower[found]
            depth *= 2


class Best:
    """The ``k`` best documents of one item so far: higher scores first, equal ones by id, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def add(self, rows: list[tuple]) -> None:
        self.rows = sorted([*self.rows, *rows], key=lambda r: (-r[1], r[0] is None, r[0] or 0))[: self.k]

    def floor(self) -> int:
        return self.rows[-1][1] if len(self.rows) == self.k else 0


def shard_best(index: DataFrame, queries, w, all_docs: int, all_terms: int, k: int) -> DataFrame:
    """``item, doc_id, score``: for each task the ``k`` best of its documents, found shard by shard.

    ``queries`` is a broadcast list of (item, term numbers, repeats). The scores reached
    in earlier shards of the task are the floor of later ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Best(k) for item, _, _ in queries.value}
        held: list[tuple] = []
        size = 0

        def work():
            ids = [h[0] for h in held]
            shard = Shard([h[1] for h in held], [h[2] for h in held], [h[3] for h in held], w.value, all_docs, all_terms)
            for item, wanted, repeats in queries.value:
                found, scores = shard.best(wanted, repeats, k, best[item].floor())
                best[item].add([(ids[d], s) for d, s in zip(found.tolist(), scores.tolist())])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "tfs"))):
                held.append(row)
                size += len(row[2]) // 4
                if size >= SHARD_POSTINGS or len(held) >= SHARD_DOCS:
                    work()
                    held, size = [], 0
        if held:
            work()
        rows = [(item, d, s) for item, b in best.items() for d, s in b.rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)],
            ["item", "doc_id", "score"],
        )

    return index.mapInArrow(task(run), "item long, doc_id long, score long")


def item_blocks(items: DataFrame, most: int = BLOCK_TERMS) -> DataFrame:
    """``items (item_id, text)`` with a number of their own (``item``) and the block they are searched in.

    Rows that repeat an id are items of their own.
    """
    numbered = stage(items.select("item_id", utf8("text").alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    sized = numbered.withColumn("size", F.octet_length("text").cast("long") + 1)
    return stage(running(sized, [], [F.col("item")], {"upto": ("sum", "size")}).withColumn("block", F.expr(f"upto DIV {4 * most}L")), "item_blocks")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring rows of ``docs (doc_id, text)`` for each row of ``items``.

    Scores are above 0 and exact; equal ones go by ascending doc_id, null last. Null texts
    hold no term. Items without a term in common with any document have no rows, and
    neither do empty tables. Items are searched in blocks of at most about ``block_terms``
    terms, the only part of them that the driver and a task hold at a time.
    """
    spark = docs.sparkSession
    blocked = item_blocks(items, block_terms)
    results = []
    for block in [r["block"] for r in blocked.select("block").distinct().orderBy("block").toLocalIterator()]:
        texts = [(r["item"], terms(bytes(r["text"]))) for r in blocked.filter(F.col("block") == block).select("item", "text").toLocalIterator()]
        words = sorted({t for _, found in texts for t in found})
        number = {t: i for i, t in enumerate(words)}
        queries = []
        for item, found in texts:
            wanted, repeats = np.unique(np.array([number[t] for t in found], np.int64), return_counts=True)
            queries.append((item, wanted, repeats.astype(np.int64)))
        vocabulary = spark.sparkContext.broadcast(words)
        index = stage(postings(docs, vocabulary), "postings")
        n, length, df = frequencies(index, len(words))
        sent = spark.sparkContext.broadcast(queries), spark.sparkContext.broadcast(weights(n, df))
        results.append(stage(shard_best(index, *sent, n, length, k), "shard_best"))
        for b in (vocabulary, *sent):
            b.destroy()
    if not results:
        empty = spark.createDataFrame([], "rank int, doc_id long, score long")
        return items.limit(0).select("item_id").join(empty, F.lit(True)).select("item_id", "rank", "doc_id", "score")
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = top_n(found.withColumn("salt", F.spark_partition_id() % SALTS), ["item", "salt"], order, k).drop("rank", "salt")
    ranked = top_n(some, ["item"], order, k).withColumn("rank", F.col("rank").cast("int"))
    return ranked.join(blocked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
