"""Benchmark decontamination by latent semantic retrieval: randomised SVD, cosine search, exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlines.llm.prefilter import having, without
from planlines.llm.texts import CACHE_WORDS, slices, starts_of, task, utf8
from planlines.session import release, stage

#: Slots of the hashed vocabulary, and latent dimensions.
SLOTS, DIMS = 1 << 14, 64
#: Passages of a sample where one is asked for; words of a passage; products of the power iteration.
SAMPLE_PASSAGES, PASSAGE, POWER = 12000, 48, 2
#: Passages that are multiplied at a time, and rows that are summed at a time.
AT_ONCE, SUMMED = 4096, 512
#: Words of a block; windows are whole numbers of blocks. Longer items add longer windows.
BLOCK, WINDOWS = 8, (3, 6, 10)
#: Cosine from which a window is a candidate.
COSINE = 0.5
#: Share of an item's words in common order from which it counts as found; from
#: which no further check is needed; and the share of its answer that is needed else.
FOUND, SURE, ANSWER, ANSWER_WORDS = 0.6, 0.9, 0.5, 8
#: Items that meet the documents at a time.
ITEM_BLOCK = 2000

_STRIP = b".,;:!?\"'()[]{}#*$%&|<>"


class Slots(dict):
    """word -> slot of its lower-case form without outer punctuation; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(plain(word)) % SLOTS
        return value


class LowerSlots(dict):
    """The same for words of a text that is in lower case already."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.strip(_STRIP)) % SLOTS
        return value


def plain(word: bytes) -> bytes:
    return word.decode("utf-8", "replace").lower().encode().strip(_STRIP)


def slots_of(words: list[bytes], known: Slots) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def slotted(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, slots``: the slot of every word of each text, two bytes each, and a hash of the text.

    All passes of the method read these; words are cut and looked up once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LowerSlots()
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                texts = (text.as_py().decode("utf-8", "replace").lower().encode().split() for text in batch.column("text"))
                packed = [np.fromiter(map(known.__getitem__, words), np.uint16, len(words)).tobytes() for words in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(packed, pa.binary())], ["doc_id", "mark", "slots"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), utf8("text").alias("text"))
    return rows.mapInArrow(task(run), "doc_id long, mark long, slots binary")


def _unpacked(column) -> list[np.ndarray]:
    return [np.frombuffer(p.as_py(), np.uint16) for p in column]


def slot_counts(slotted: DataFrame) -> DataFrame:
    """``slot, df``: number of passages of all texts that hold each slot; slot -1 counts the passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SLOTS, np.int64), 0
        for whole in batches:
            for batch in slices(whole, "slots", 128 << 10):
                texts = [x for x in _unpacked(batch.column("slots")) if len(x)]
                if not texts:
                    continue
                sizes = np.array([len(x) for x in texts])
                parts = -(-sizes // PASSAGE)
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                passage = np.repeat(np.cumsum(parts) - parts, sizes) + place // PASSAGE
                key = np.sort((passage * SLOTS + np.concatenate(texts)).astype(np.int32 if parts.sum() < 1 << 17 else np.int64))
                df += np.bincount(key[starts_of([key])] % SLOTS, minlength=SLOTS)
                n += int(parts.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["slot", "df"])

    parts = slotted.select("slots").mapInArrow(task(run), "slot long, df long")
    return parts.groupBy("slot").agg(F.sum("df").alias("df"))


def sample_passages(docs: DataFrame, n: int) -> DataFrame:
    """``slots``: about SAMPLE_PASSAGES of the ``n`` passages, chosen by a hash of their text's id and their place; all where ``n`` is 0. ``find`` samples nothing."""
    limit = int(min(1.0, SAMPLE_PASSAGES / max(n, 1)) * (1 << 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, x in zip(batch.column("doc_id"), _unpacked(batch.column("slots"))):
                key = str(doc_id.as_py()).encode()
                for a in range(0, len(x), PASSAGE):
                    if xxhash.xxh3_64_intdigest(key + b"/%d" % a) & 0xFFFFFFFF < limit:
                        out.append(x[a : a + PASSAGE].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["slots"])

    return slotted(docs).select("doc_id", "slots").mapInArrow(task(run), "slots binary")


def _padded(texts: list[np.ndarray], width: int) -> np.ndarray:
    """The pieces of ``width`` words of all ``texts``, one a column; SLOTS fills the last ones of the texts."""
    sizes = np.array([len(x) for x in texts])
    parts = -(-sizes // width)
    rows = np.full(int(parts.sum()) * width, SLOTS, np.intp)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows[np.repeat((np.cumsum(parts) - parts) * width, sizes) + place] = np.concatenate(texts)
    return np.ascontiguousarray(rows.reshape(-1, width).T)


def _summed(table: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """For each column of ``picks`` the sum of the rows of ``table`` it names, SUMMED at a time so that the sums stay in reach."""
    out, row = np.zeros((picks.shape[1], table.shape[1]), np.float32), np.empty((SUMMED, table.shape[1]), np.float32)
    for a in range(0, len(out), SUMMED):
        part = out[a : a + SUMMED]
        for names in picks[:, a : a + SUMMED]:
            part += np.take(table, names, axis=0, out=row[: len(part)], mode="clip")
    return out


def _add_product(x: np.ndarray, weighted: np.ndarray, idf: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` what the passages, the columns of ``x``, give to X'X q, but for the idf of each slot; ``weighted`` is idf times q."""
    n, dims = x.shape[1], weighted.shape[1]
    y, row = _summed(weighted, x), np.empty((SUMMED, dims), np.float32)
    key = (x * n + np.arange(n)).astype(np.int32).ravel()
    key.sort()
    key = key[: np.searchsorted(key, SLOTS * n)]
    slot = key // n
    passage = (key - slot * n).astype(np.intp)
    first = starts_of([key])
    tf = np.diff(np.append(first, len(key)))
    y /= np.maximum(np.bincount(passage[first], weights=(tf * idf[slot[first]]) ** 2, minlength=n), 1e-24)[:, None].astype(np.float32)
    runs = starts_of([slot])
    size = np.diff(np.append(runs, len(slot)))
    order = np.argsort(-size, kind="stable")
    runs, size = runs[order], size[order]
    common = int(np.searchsorted(-size, -n / 20))  # slots that many passages hold are a dense product, the others sums of rows
    for a in range(0, common, 256):
        k = min(256, common - a)
        held = np.concatenate([i * n + passage[s : s + m] for i, (s, m) in enumerate(zip(runs[a : a + k], size[a : a + k]))])
        total[slot[runs[a : a + k]]] += np.bincount(held, minlength=k * n).astype(np.float32).reshape(k, n) @ y
    for a in range(common, len(size), SUMMED):
        start, m = runs[a : a + SUMMED], size[a : a + SUMMED]
        sums = np.zeros((len(start), dims), np.float32)
        for r, k in enumerate(np.searchsorted(-m, -np.arange(m[0])).tolist()):
            sums[:k] += np.take(y, passage[start[:k] + r], axis=0, out=row[:k], mode="clip")
        total[slot[start]] += sums


def _times(texts: DataFrame, idf: np.ndarray, q: np.ndarray, kind: type) -> np.ndarray:
    """X'X q over all passages of ``texts``: each task multiplies its own, slabs are summed by group."""
    send = texts.sparkSession.sparkContext.broadcast((idf, np.append(idf[:, None] * q, np.zeros((1, q.shape[1])), axis=0).astype(np.float32)))
    slab = SLOTS // 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, weighted = send.value
        total, any_words = np.zeros((SLOTS, weighted.shape[1])), False
        for whole in batches:
            for batch in slices(whole, "slots", 1 << 20):
                found = [x for x in (np.frombuffer(p.as_py(), kind) for p in batch.column("slots")) if len(x)]
                passages = _padded(found, PASSAGE) if found else np.empty((PASSAGE, 0), np.intp)
                for a in range(0, passages.shape[1], AT_ONCE):
                    _add_product(np.ascontiguousarray(passages[:, a : a + AT_ONCE]), weighted, idf, total)
                    any_words = True
        for k in range(16 if any_words else 0):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([total[k * slab : (k + 1) * slab].astype(np.float32).tobytes()], pa.binary())], ["slab", "part"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, p in zip(batch.column("slab").to_pylist(), batch.column("part")):
                totals[k] = totals.get(k, 0.0) + np.frombuffer(p.as_py(), np.float32).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["slab", "part"])

    slabs = texts.select("slots").mapInArrow(task(run), "slab int, part binary").repartition(16, "slab")
    parts = slabs.mapInArrow(task(add), "slab int, part binary").collect()
    send.destroy()
    out = np.zeros((SLOTS, q.shape[1]))
    for p in parts:
        out[p["slab"] * slab : (p["slab"] + 1) * slab] = np.frombuffer(p["part"]).reshape(slab, -1)
    return idf[:, None] * out


def latent_space(texts: DataFrame, idf: np.ndarray, dims: int = DIMS, seed: int = 3, kind: type = np.int32) -> np.ndarray:
    """SLOTS x dims map from idf-weighted word counts into the latent space of all passages of ``texts (slots)``, whose slots are of ``kind``.

    Randomised SVD: a random block is multiplied by X'X and made orthogonal again,
    POWER products in all; the last one, F = X'X q, gives X'X as F (q'F)^-1 F' on its
    range, and so the right singular vectors, each scaled by its inverse singular value
    so that no common direction outweighs the others. The driver holds SLOTS x dims
    numbers, whatever the corpus.
    """
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((SLOTS, dims)))[0]
    for _ in range(POWER - 1):
        q = np.linalg.qr(_times(texts, idf, q, kind))[0]
    f = _times(texts, idf, q, kind)
    core = q.T @ f
    parts, vectors = np.linalg.eigh((core + core.T) / 2)
    sound = parts > 1e-6 * max(parts[-1], 1e-9)
    root = f @ (vectors[:, sound] / np.sqrt(parts[sound]))  # X'X is root root'
    squares, vectors = np.linalg.eigh(root.T @ root)
    out = np.zeros((SLOTS, dims), np.float32)
    out[:, : len(squares)] = idf[:, None] * (root @ (vectors / np.maximum(squares, 1e-9)))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def common(item: list[bytes], text: list[bytes]) -> int:
    """Length of the longest common subsequence, a machine word of bits per step."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | (1 << i)
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def verdict(item: list[bytes], region: list[bytes]) -> tuple[float, float, bool]:
    """Share of the item and of its answer (its last words) found in order, and whether that is a leak."""
    share = common(item, region) / len(item)
    answer = item[-ANSWER_WORDS:]
    told = common(answer, region) / len(answer)
    return share, told, share >= SURE or (share >= FOUND and told >= ANSWER)


def windows(longest: int) -> list[int]:
    """Window sizes in blocks: WINDOWS, and from there each 5/3 of the last, up to an item of ``longest`` words."""
    out = list(WINDOWS)
    while out[-1] * BLOCK < longest:
        out.append(-(-out[-1] * 5 // 3))
    return out


def _search(space, items):
    """Task: windows of each text near an item by cosine whose slots pass the check, as ``begin`` and ``end`` word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.append(space.value, np.zeros((1, DIMS), np.float32), axis=0)
        slots = [slots_of(words, Slots()) for _, words in items.value]
        sizes = windows(max(map(len, slots), default=0))
        fits = [min(sizes, key=lambda w: abs(w * BLOCK - len(s))) for s in slots]
        groups = {}
        for w in sorted(set(fits)):
            mine = [k for k, fit in enumerate(fits) if fit == w]
            member = np.zeros((len(mine), SLOTS), bool)
            for at, k in enumerate(mine):
                member[at, slots[k]] = True
            groups[w] = (mine, _unit(np.stack([v[slots[k]].sum(axis=0) for k in mine])).T.copy(), member)
        listed = [s.tolist() for s in slots]
        for whole in batches:
            for batch in slices(whole, "slots", 128 << 10):
                texts = _unpacked(batch.column("slots"))
                some = [k for k, x in enumerate(texts) if len(x)]
                out = []
                for at, lo, hi, k, cosine in _candidates([texts[i] for i in some], slots, v, groups):
                    row = some[at]
                    if verdict(listed[k], texts[row][lo:hi].tolist())[2]:
                        out.append((batch.column("doc_id")[row].as_py(), batch.column("mark")[row].as_py(), k, lo, hi, cosine))
                cols = list(zip(*out)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "mark", "item", "begin", "end", "cosine"])

    return run


def _candidates(texts: list[np.ndarray], items: list[np.ndarray], v: np.ndarray, groups: dict):
    """(text, first and last word of the surroundings, item, cosine) of windows near an item.

    Windows whose surroundings hold too few words of the item, wherever they stand,
    can not pass the check and are left out: no common subsequence is longer.
    """
    if not len(texts):
        return
    n_blocks = np.array([-(-len(x) // BLOCK) for x in texts])
    starts = np.cumsum([0, *n_blocks])
    x = np.concatenate(texts).astype(np.int32)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    edges = np.concatenate([b + np.arange(k) * BLOCK for b, k in zip(begin, n_blocks)])
    blocks = _summed(v, _padded(texts, BLOCK))  # the last block of a text is shorter
    total = np.zeros((v.shape[1], len(blocks) + 1))
    np.cumsum(np.ascontiguousarray(blocks.T), axis=1, dtype=np.float64, out=total[:, 1:])
    owner = np.repeat(np.arange(len(texts)), n_blocks)
    ends = begin + sizes
    for w, (mine, latent, member) in groups.items():
        length = np.array([len(items[k]) for k in mine], np.int32)
        reach = np.arange(max((w + 2) * BLOCK, int(length.max()) + 2 * BLOCK), dtype=np.int32)
        last = np.minimum(np.arange(len(owner)) + w, starts[owner + 1])  # the last windows of a text are shorter
        window = (np.take(total, last, axis=1) - total[:, :-1]).astype(np.float32)
        size = np.maximum(np.sqrt(np.einsum("ji,ji->i", window, window)), 1e-12)
        product = latent.T @ window
        near = np.flatnonzero(product >= COSINE * size)
        for part in np.array_split(near, max(1, len(near) // min(4096, max(1, 4096 * 96 // len(reach))))):
            i, b = part // len(owner), part % len(owner)
            lo = np.maximum(begin[owner[b]], edges[b] - BLOCK)
            hi = np.minimum(ends[owner[b]], lo + np.maximum((w + 2) * BLOCK, length[i] + 2 * BLOCK))
            words = np.take(x, lo.astype(np.int32)[:, None] + reach, mode="clip")
            words += (i * SLOTS).astype(np.int32)[:, None]
            held = np.count_nonzero(np.take(member, words) & (reach < (hi - lo).astype(np.int32)[:, None]), axis=1)
            for k in np.flatnonzero(held >= FOUND * length[i]):
                doc = owner[b[k]]
                yield int(doc), int(lo[k] - begin[doc]), int(hi[k] - begin[doc]), mine[i[k]], float(product[i[k], b[k]] / size[b[k]])


def _check(items):
    """Task: the windows that passed by their slots, checked by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                out = []
                for doc_id, text, near in zip(batch.column("doc_id"), batch.column("text"), batch.column("near")):
                    words = text.as_py().split()
                    for hit in near.as_py():
                        item_id, item = items.value[hit["item"]]
                        share, told, leak = verdict(item, [plain(w) for w in words[hit["begin"] : hit["end"]]])
                        if leak:
                            out.append((doc_id.as_py(), item_id, hit["cosine"], share, told))
                cols = list(zip(*out)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "cosine", "overlap", "answer"]
                )

    return run


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, overlap, answer``: benchmark items that ``docs (doc_id, text)`` give away.

    1. Passages of PASSAGE words of all documents give the document frequencies of
       the hashed words; all of them and the benchmark's texts give the latent space,
       by distributed randomised SVD.
    2. Every document, whole, is cut into blocks of BLOCK words; sums of neighbouring
       blocks are the windows, at each block one of every size, the sizes reaching up
       to the longest item. A window whose cosine
       with an item of its size is COSINE or more is a candidate.
    3. The longest common subsequence of the item's words and the words around the
       window decides, after the one of their slots, which is never shorter: SURE or more of the item is a leak; from FOUND on it is a
       paraphrase, and a leak if its answer, the item's last words, is there as well.

    ``benchmark (item_id, text)`` meets the documents in blocks of ITEM_BLOCK items.
    Items and texts without words match nothing. One row for each pair of ids, with
    its best overlap; repeated rows change nothing. Rows without id are left out.
    """
    spark = docs.sparkSession
    docs = docs.filter("doc_id is not null").select("doc_id", "text")
    packed = stage(slotted(docs), "slots")
    counts = {r["slot"]: r["df"] for r in slot_counts(packed).collect()}
    n = counts.pop(-1, 0)
    df = np.zeros(SLOTS)
    df[list(counts)] = list(counts.values())
    idf = np.log((n + 1) / (df + 0.5)).clip(0.01)
    asked = stage(benchmark.filter("item_id is not null").select("item_id", utf8("text").alias("text")).distinct(), "items")
    probes = stage(slotted(asked.select(F.col("item_id").alias("doc_id"), F.col("text").cast("string").alias("text"))), "probes")
    space = spark.sparkContext.broadcast(latent_space(packed.unionByName(probes), idf, kind=np.uint16))
    schema = "doc_id long, item_id long, cosine double, overlap double, answer double"
    near = "doc_id long, mark long, item int, begin int, end int, cosine double"
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), utf8("text").alias("text"))
    found = []
    blocks = 1 + asked.count() // ITEM_BLOCK
    for k in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        items = [(r["item_id"], [plain(w) for w in bytes(r["text"]).split()]) for r in sorted(part)]
        send = spark.sparkContext.broadcast([(i, w) for i, w in items if w])
        close = stage(packed.mapInArrow(task(_search(space, send)), near), "near")
        of_text = close.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("item", "begin", "end", "cosine")).alias("near"))
        asked_for = having(texts, close.select("doc_id").distinct()).dropDuplicates(["doc_id", "mark"]).join(of_text, ["doc_id", "mark"])
        found.append(stage(asked_for.mapInArrow(task(_check(send)), schema), "found"))
        send.destroy()
    space.destroy()
    for table in (packed, probes):
        release(table)
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    best = F.max(F.struct("overlap", "answer", "cosine")).alias("b")
    return hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.overlap", "b.answer")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that give a benchmark item away; all columns stay. Rows without id stay."""
    return without(docs, stage(find(docs, benchmark).select("doc_id").distinct(), "leaks"))
