"""Words, hashes and Arrow batches shared by the text operators.

A word is a run of anything but space, tab, line feed, vertical tab, form feed and
carriage return. ``bytes.split()`` cuts UTF-8 at exactly these six bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task turns into arrays at a time.
SLICE_BYTES = 3 << 20
#: Distinct words whose hash a task remembers.
CACHE_WORDS = 250_000


class WordHashes(dict):
    """word -> 64-bit hash, computed once per word; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashes(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(x: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each run of ``k`` consecutive values (empty if there is none)."""
    n = len(x) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = x[:n].copy()
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for j in range(1, k):
            out *= base
            out += x[j : j + n]
    return mixed(out)


def utf8(text: str | Column) -> Column:
    """The text's bytes, empty for null; tasks then see bytes and decode nothing."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most ``most`` bytes of ``column`` (one row at least)."""
    sizes = np.asarray(batch.column(column).to_numpy(zero_copy_only=False), dtype=object)
    total = np.cumsum([len(v) for v in sizes]) if len(sizes) else np.empty(0)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def by_group(
    batches: Iterable[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]
) -> Iterator[pa.RecordBatch]:
    """Call ``work`` on whole groups of a stream sorted by ``keys``, many small groups at a time.

    The tail of a batch may continue in the next one, so it is held back; what is
    held is one batch and one group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = last_group_start(batch, keys)
        if cut == 0 and held and same_group(held[-1], batch, keys):
            held.append(batch)
            continue
        same = bool(held) and same_group(held[-1], batch, keys)
        first_end = first_group_end(batch, keys) if same else 0
        if held and not same:
            yield from work(pa.Table.from_batches(held))
        elif same:
            yield from work(pa.Table.from_batches([*held, batch.slice(0, first_end)]))
        if cut > first_end:
            yield from work(pa.Table.from_batches([batch.slice(first_end, cut - first_end)]))
        held = [batch.slice(cut)] if cut < batch.num_rows else []
    if held:
        yield from work(pa.Table.from_batches(held))


def starts_of(columns: list[np.ndarray]) -> np.ndarray:
    """First row of each run of equal keys."""
    n = len(columns[0])
    if not n:
        return np.empty(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _keys(batch, keys: list[str]) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]


def last_group_start(batch: pa.RecordBatch, keys: list[str]) -> int:
    return int(starts_of(_keys(batch, keys))[-1])


def first_group_end(batch: pa.RecordBatch, keys: list[str]) -> int:
    starts = starts_of(_keys(batch, keys))
    return int(starts[1]) if len(starts) > 1 else batch.num_rows


def same_group(left: pa.RecordBatch, right: pa.RecordBatch, keys: list[str]) -> bool:
    return all(left.column(k)[-1].as_py() == right.column(k)[0].as_py() for k in keys)


def fold(column: str | Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; a null id counts as an empty text."""
    col = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % parts


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, with the memory it took given back to the machine at its end.

    Python workers serve one task after another, of other stages too; what an
    allocator keeps for itself after a task counts against the executor for good.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return whole


def n_words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
