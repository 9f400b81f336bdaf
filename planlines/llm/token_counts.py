"""Token counts of whole texts of any length: overlapping chunks, spliced where both are proven right.

A byte-level tokenizer without normalizer cuts a text into special strings and, between
them, into pre-tokens by one scan from left to right without look-behind; tokens never
cross a cut. What follows a cut therefore depends on the text behind it alone: if a cut
of one chunk is a cut of the whole text, and the next chunk cuts there too, then from
there on the next chunk agrees with the whole text. Cuts of a chunk are those of the
whole text up to ``MARGIN`` characters before its end, since no decision looks further
ahead than a special string or a contraction. Chunk 0 starts with the text, so by
induction a common cut in every overlap makes the count exact.

For the same reason the tokens of a text are those of its words, each with the blanks
before it: a blank after a character that is none is always a cut, and so is a mark
after a letter or digit. Texts that are not
chunked are counted that way, and the tokenizer sees each word of a task once.

Where an overlap holds no common cut (a run of letters or blanks longer than it), chunks
and overlaps of that text are doubled, until there is one or the text is one chunk.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlines.llm.texts import slices, task
from planlines.session import fanout_partitions, release, stage

#: Characters of a chunk, and those it shares with the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Longest look-ahead of a scan besides special strings.
LOOK_AHEAD = 8
#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 1 << 19
LIMIT = 1024
#: Words whose tokens a task remembers, about 100 MB.
KNOWN_WORDS = 600_000

_BLANKS = " \t\n\r"
#: Pieces that no token crosses: marks after letters or digits are cut off where blanks or the end follow.
_WORDS = re.compile(
    r"[ \t\n\r]*[^\W_]+(?=[ \t\n\r.,;:!?]|\Z)|(?<=[^\W_])[.,;:!?]+(?=[ \t\n\r]|\Z)|[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+"
)
#: Blanks of a scan that _WORDS does not cut at, and characters that only some rules call blank.
_OTHER_BLANKS = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


def margin(definition: dict) -> int:
    """Characters before a chunk's end from which its cuts are not sure; ValueError for tokenizers without a proof."""
    scan = definition.get("pre_tokenizer") or {}
    plain = scan.get("type") == "ByteLevel" and scan.get("use_regex", True) and not scan.get("add_prefix_space")
    special = definition.get("added_tokens") or []
    if not plain or definition.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
        raise ValueError("cuts are proven stable for byte-level tokenizers without normalizer, prefix and stripping only")
    return LOOK_AHEAD + max([len(t["content"]) for t in special], default=0)


class Encoder:
    """The tokenizer of a definition, one thread, special strings as its default has them, nothing added or cut."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Tokens of each word met so far; forgotten when there are too many.
        self.known: dict[str, int] = {}
        special = (t["content"] for t in json.loads(definition).get("added_tokens") or [])
        self.word_by_word = not any(_WORDS.fullmatch(t) is None or t[0] in _BLANKS or _OTHER_BLANKS.search(t) for t in special)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Texts with other blanks than the common ones are encoded in one piece."""
        whole = [not self.word_by_word or _OTHER_BLANKS.search(t) is not None for t in texts]
        parts = [[] if w else _WORDS.findall(t) for w, t in zip(whole, texts)]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        new = {w for words in parts for w in words}.difference(self.known)
        # words that start with a blank and end with none stay words when they stand in a row
        row = [w for w in new if w[0] in _BLANKS and w[-1] not in _BLANKS] if self.word_by_word else []
        alone = list(new.difference(row))
        self.known.update(zip(alone, map(len, self.tokenizer.encode_batch(alone, add_special_tokens=False))))
        if row:
            starts = np.fromiter((o[0] for o in self.tokenizer.encode("".join(row), add_special_tokens=False).offsets), np.int64)
            ends = np.searchsorted(starts, np.cumsum([len(w) for w in row]))
            self.known.update(zip(row, np.diff(ends, prepend=0).tolist()))
        rest = iter(self.tokenizer.encode_batch([t for w, t in zip(whole, texts) if w], add_special_tokens=False))
        return [len(next(rest)) if w else sum(map(self.known.__getitem__, words)) for w, words in zip(whole, parts)]

    def cuts(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Characters before each cut, tokens before it, and all tokens; the start is a cut."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.empty(0, np.int64)
        starts = np.array([o[0] for o in e.offsets], np.int64)
        return starts[first], first, len(e)


def _whole(rows: DataFrame, definition) -> DataFrame:
    """``rows (doc_id, text)`` with whole texts encoded at once: ``doc_id, n_bytes, n_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            for batch in slices(whole, "text", ENCODE_BYTES):
                encoder = encoder or Encoder(definition.value)
                texts = batch.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("n_bytes"), pa.array(encoder.counts(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task(run), f"doc_id {kind}, n_bytes long, n_tokens long")


def _pieces(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``key, piece, last, text`` of ``rows (key, text)``: piece i starts at ``i * chunk`` and shares ``overlap`` with the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text")):
                text = text.as_py()
                n = max(1, -(-(len(text) - overlap) // chunk))
                for i in range(n):
                    end = len(text) if i == n - 1 else (i + 1) * chunk + overlap
                    yield pa.RecordBatch.from_pydict(
                        {"key": pa.array([key.as_py()], pa.int64()), "piece": pa.array([i], pa.int32()), "last": [i == n - 1], "text": [text[i * chunk : end]]}
                    )

    cut = rows.select("key", "text").mapInArrow(task(run), "key long, piece int, last boolean, text string")
    return cut.repartition(fanout_partitions(rows.sparkSession), "key", "piece")


def _encoded(pieces: DataFrame, definition, chunk: int, overlap: int, unsure: int) -> DataFrame:
    """For each piece its tokens and the cuts of its two overlaps, with the tokens before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(definition.value)
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                text, first, last = row.column("text")[0].as_py(), row.column("piece")[0].as_py(), row.column("last")[0].as_py()
                at, before, n = encoder.cuts(text)
                left = at <= (overlap if first else -1)
                right = (at >= (len(text) if last else chunk)) & (at <= len(text) - unsure)
                base = first * chunk
                yield pa.RecordBatch.from_arrays(
                    [row.column("key"), row.column("piece"), row.column("last"), pa.array([n], pa.int64())]
                    + [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (base + at[left], before[left], base + at[right], before[right])],
                    ["key", "piece", "last", "n", "left_at", "left_n", "right_at", "right_n"],
                )

    arrays = ", ".join(f"{c} array<long>" for c in ("left_at", "left_n", "right_at", "right_n"))
    return pieces.mapInArrow(task(run), f"key long, piece int, last boolean, n long, {arrays}")


def spliced(pieces: DataFrame) -> DataFrame:
    """``key, n_tokens, missing``: tokens of each text, and the number of overlaps without a common cut.

    A piece counts from the splice with its predecessor to the splice with its
    successor, so a splice adds the tokens before it on its left side and takes off
    those before it on its right side. Neighbours meet by (key, piece), not by text.
    """
    after = pieces.select("key", (F.col("piece") - 1).alias("piece"), F.col("left_at").alias("next_at"), F.col("left_n").alias("next_n"))
    both = pieces.filter("NOT last").join(after, ["key", "piece"])
    both = both.withColumn("cut", F.array_min(F.array_intersect("right_at", "next_at")))

    def tokens(at, n):
        return F.element_at(n, F.array_position(at, F.col("cut")).cast("int"))

    gain = F.when(F.col("cut").isNotNull(), tokens("right_at", F.col("right_n")) - tokens("next_at", F.col("next_n")))
    parts = both.select("key", gain.alias("n"), F.col("cut").isNull().cast("long").alias("missing"))
    parts = parts.unionByName(pieces.filter("last").select("key", "n", F.lit(0).cast("long").alias("missing")))
    return parts.groupBy("key").agg(F.sum("n").alias("n_tokens"), F.sum("missing").alias("missing"))


def count(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row of ``docs (doc_id, text)``; a null text is an empty one.

    ``path`` names the tokenizer's file, read once by the driver and sent to the tasks.
    Texts of up to ``chunk + overlap`` characters are encoded whole, one row each;
    longer ones are dealt out in chunks. Every row is counted by itself, repeated and
    null ids too; other columns are ignored.
    """
    with open(path, encoding="utf-8") as f:
        text = f.read()
    unsure = margin(json.loads(text))
    if overlap <= 2 * unsure or chunk < 2 * overlap:
        raise ValueError("an overlap must exceed twice the margin, a chunk twice the overlap")
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(text)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    is_long = F.char_length("text") > chunk + overlap
    short = _whole(rows.filter(~is_long), definition)
    long = stage(rows.filter(is_long).withColumn("key", F.monotonically_increasing_id()), "long_texts")
    done, todo = None, long
    while True:
        # with no long text left this still runs once over no rows, and ends
        pieces = stage(_encoded(_pieces(todo, chunk, overlap), definition, chunk, overlap, unsure), "pieces")
        tried = stage(spliced(pieces), "spliced")
        release(pieces)
        fine = tried.filter("missing = 0").select("key", "n_tokens")
        done = fine if done is None else done.unionByName(fine)
        if not tried.filter("missing > 0").limit(1).count():
            break
        todo = todo.join(tried.filter("missing > 0").select("key"), "key", "left_semi")
        chunk, overlap = 2 * chunk, 2 * overlap
    return short.unionByName(long.drop("text").join(done, "key").select("doc_id", "n_bytes", "n_tokens"))


def budget(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
