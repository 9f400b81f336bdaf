"""N-gram Jaccard join through MinHash banding (in place of a forest's adaptive tries) with exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlines.llm.prefilter import free, having, split, without
from planlines.llm.texts import WordHashes, by_group, hashes, mixed, rolling, starts_of, task, utf8
from planlines.operators.graph import connected_components
from planlines.operators.ranking import row_numbers
from planlines.session import stage

SHINGLE = 5
THRESHOLD = 0.8
#: Trees of the forest and the most labels on a path of their tries.
TREES, DEPTH = 32, 8
#: Chance, at the threshold, that a pair meets in some tree.
RECALL = 0.999999
#: Texts of one block; two blocks meet in a task.
BLOCK = 256


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Longest prefix at which pairs of ``threshold`` still meet with chance ``recall``.

    Matched prefixes start at the full depth and get shorter by one label until
    1 - (1 - s^d)^trees reaches the target.
    """
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


def shingles(words: list[bytes], known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words; a shorter text is one shingle."""
    x = hashes(words, known)
    return np.unique(rolling(x, min(SHINGLE, len(x)))) if len(x) else x


def _sign(labels: int):
    """Task: hash of the shingle set, its size, and the first ``labels`` MinHash labels, a byte each."""
    salts = mixed(np.arange(1, labels + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    scale, shift = (salts | np.uint64(1)).astype(np.uint32) | np.uint32(1), (salts >> np.uint64(32)).astype(np.uint32)

    def minima(s: np.ndarray) -> np.ndarray:
        x, best = mixed(s ^ np.uint64(0x5851F42D4C957F2D)), np.full(labels, 0xFFFFFFFF, np.uint32)
        low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for a in range(0, len(x), 1024):
                h = low[a : a + 1024][None, :] * scale[:, None] + (high[a : a + 1024][None, :] ^ shift[:, None])
                best = np.minimum(best, h.min(axis=1))
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            out = []
            for text in batch.column("text"):
                s = shingles(text.as_py().split(), known)
                if not len(s):
                    out.append((None, 0, None))
                    continue
                sign = mixed(minima(s).astype(np.uint64)).astype(np.uint8)
                out.append((hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), sign.tobytes()))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())],
                ["doc_id", "set", "n", "sign"],
            )

    return run


def _tiles(entries: DataFrame, key: list[str], crowd: DataFrame) -> DataFrame:
    """Deal the rows of each group into tiles of two blocks, so that any two rows of it share a tile.

    ``crowd`` has ``key, members`` for groups of two or more; rows of other groups go.
    A group of at most BLOCK rows is one tile. ``side`` tells the two blocks apart.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(11)), F.col("blocks")).cast("int")
    rows = entries.join(crowd, key).withColumn("blocks", blocks).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = [F.least("own", "other").alias("ba"), F.greatest("own", "other").alias("bb")]
    side = (F.col("own") != F.least("own", "other")).alias("side")
    tile = F.xxhash64(*key, F.least("own", "other"), F.greatest("own", "other")).alias("tile")
    return rows.select(tile, *pair, side, *[c for c in entries.columns if c not in key])


def _pairs(tile: np.ndarray, side: np.ndarray, mixed_tile: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of the same tile, by distance in the sorted rows; only across sides in tiles of two blocks."""
    at = np.arange(len(tile))
    for step in range(1, len(tile)):
        a = at[: len(tile) - step]
        a = a[tile[a] == tile[a + step]]
        if not len(a):
            return
        keep = ~mixed_tile[a] | (side[a] != side[a + step])
        if keep.any():
            yield a[keep], a[keep] + step


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component, for links ``a - b`` among ``n`` rows."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        before = root.copy()
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        root = root[root]
        root = root[root]
        if (root == before).all():
            break
    while (root[root] != root).any():
        root = root[root]
    return root


def _likely(floor: int):
    """Task: links between texts of a tile whose labels agree often enough, as stars."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rep, n, tile = (table.column(c).to_numpy() for c in ("rep", "n", "tile"))
        side, two = table.column("side").to_numpy(), (table.column("ba").to_numpy() != table.column("bb").to_numpy())
        sign = np.frombuffer(b"".join(x.as_py() for x in table.column("sign")), np.uint8).reshape(len(rep), -1)
        left, right = [], []
        for a, b in _pairs(tile, side, two):
            sizes = np.minimum(n[a], n[b]) >= THRESHOLD * np.maximum(n[a], n[b]) - 1e-9
            a, b = a[sizes], b[sizes]
            for i in range(0, len(a), 8192):
                u, v = a[i : i + 8192], b[i : i + 8192]
                same = (sign[u] == sign[v]).sum(axis=1) >= floor
                left.append(u[same])
                right.append(v[same])
        if left:
            root = _roots(len(rep), np.concatenate(left), np.concatenate(right))
            moved = root != np.arange(len(rep))
            yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[root[moved]])], ["u", "v"])

    return lambda batches: by_group(batches, ["tile"], work)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: exact similarity of the pairs of each tile; per text its links, counting copies, and a star link."""
    known = WordHashes()

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rep, copies, tile = (table.column(c).to_numpy() for c in ("rep", "copies", "tile"))
        side, two = table.column("side").to_numpy(), (table.column("ba").to_numpy() != table.column("bb").to_numpy())
        starts = starts_of([tile])
        for lo, hi in zip(starts, np.append(starts[1:], len(tile))):
            sets = [shingles(t.as_py().split(), known) for t in table.column("text").slice(lo, hi - lo)]
            match = _similar(sets)
            if two[lo]:
                match &= side[lo:hi][:, None] != side[lo:hi][None, :]
            links = match @ copies[lo:hi]
            a, b = np.nonzero(np.triu(match))
            root = _roots(hi - lo, a, b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[lo:hi]), pa.array(rep[lo:hi][root]), pa.array(links.astype(np.int64))], ["u", "v", "links"]
            )

    return by_group(batches, ["tile"], work)


def _similar(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of THRESHOLD or more; not the diagonal."""
    m, n = len(sets), np.array([len(s) for s in sets])
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(everything, kind="stable")
    everything, owner = everything[order], owner[order]
    starts = starts_of([everything])
    sizes = np.diff(np.append(starts, len(everything)))
    shared = np.repeat(sizes > 1, sizes)
    column = np.repeat(np.cumsum(sizes > 1) - 1, sizes)[shared]
    owner = owner[shared]
    both = np.zeros((m, m), np.float32)
    width = 1 << 14
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k in range(len(cuts) - 1):
        part = slice(cuts[k], cuts[k + 1])
        if cuts[k + 1] > cuts[k]:
            grid = np.zeros((m, width), np.float32)
            grid[owner[part], column[part] - k * width] = 1
            both += grid @ grid.T
    union = n[:, None] + n[None, :] - both
    match = both * 10 >= union * 8 - 1e-3 if THRESHOLD == 0.8 else both >= THRESHOLD * union - 1e-6
    np.fill_diagonal(match, False)
    return match


def join(docs: DataFrame) -> DataFrame:
    """Near-duplicate classes of ``docs (doc_id, text)``: texts whose sets of SHINGLE-word runs overlap by THRESHOLD.

    Returns ``doc_id, class_id, copy_id, n_links``, one row for each distinct id:
    the smallest id of its connected group, the smallest id with the same shingle
    set, and the number of other documents it is linked to, copies included.

    1. Texts with equal shingle sets are one class; the rest works on its smallest id.
    2. Banding: each class has TREES bands of MinHash labels, of the length that
       ``prefix_length`` finds for the target recall; classes that share a band meet in
       its node. Nodes with one class end there.
    3. Nodes are cut into tiles of two blocks, so that a crowded one spreads over
       many tasks. Sizes and the share of equal labels rule out pairs (at a share
       six deviations under the threshold); what is left is linked as stars, no pair
       is written.
    4. Connected groups of likely links are dealt into tiles again with their texts,
       and every pair of a tile is verified exactly. Tasks return sums and stars.

    Texts without words (null, empty, blanks) have no shingles and no links. Under
    SHINGLE words the whole text is one shingle. Rows that repeat an id count once,
    by one of their texts that has words; rows without id are not returned.
    """
    docs = docs.filter("doc_id is not null").select("doc_id", utf8("text").alias("text"))
    depth = prefix_length()
    labels = TREES * depth
    signed = stage(docs.mapInArrow(task(_sign(labels)), "doc_id long, set binary, n int, sign binary"), "signed")
    first = F.min(F.struct((F.col("n") == 0).alias("blank"), "set", "n"))
    single = signed.groupBy("doc_id").agg(first.alias("s")).select("doc_id", "s.set", "s.n")
    single = stage(single, "documents")
    classes = stage(
        single.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n")), "classes"
    )
    signs = classes.join(
        signed.filter("n > 0").select(F.col("doc_id").alias("rep"), "set", "sign").dropDuplicates(["rep", "set"]), ["rep", "set"]
    ).select("rep", "n", "sign")
    signs = stage(signs, "signs")
    prefix = lambda t: F.substring("sign", t * depth + 1, depth)
    paths = F.array(*[F.xxhash64(F.lit(t), prefix(t)) for t in range(TREES)])
    entries = signs.select("rep", F.explode(paths).alias("node"))
    crowd = stage(entries.groupBy("node").agg(F.count("*").alias("members")).filter("members > 1"), "nodes")
    members = _tiles(entries, ["node"], crowd).join(signs, "rep")
    agree = THRESHOLD - 6 * (THRESHOLD * (1 - THRESHOLD) / labels) ** 0.5
    likely = _sorted(members).mapInArrow(task(_likely(int(np.floor(agree * labels)))), "u long, v long").distinct()
    likely = stage(likely, "likely")
    ends = likely.select(F.col("u").alias("n")).unionByName(likely.select(F.col("v").alias("n"))).distinct()
    groups = stage(connected_components(ends, likely, []), "groups").select(F.col("n").alias("rep"), F.col("component").alias("root"))
    sizes = stage(groups.groupBy("root").agg(F.count("*").alias("members")).filter("members > 1"), "sizes")
    asked = having(docs, groups.select(F.col("rep").alias("doc_id"))).withColumnRenamed("doc_id", "rep")
    texts = stage(groups.join(classes.select("rep", "copies"), "rep").join(asked, "rep").dropDuplicates(["rep"]), "texts")
    tiles = _tiles(texts, ["root"], sizes)
    verified = stage(_sorted(tiles).mapInArrow(task(_verify), "u long, v long, links long"), "verified")
    links = verified.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "rep")
    stars = verified.filter("u <> v").select("u", "v").distinct()
    ends = stars.select(F.col("u").alias("n")).unionByName(stars.select(F.col("v").alias("n"))).distinct()
    final = connected_components(ends, stars, []).select(F.col("n").alias("rep"), F.col("component").alias("class_id"))
    known = classes.select("set", "rep", "copies").join(links, "rep", "left").join(final, "rep", "left")
    known = stage(known, "known")
    joined = single.join(known, "set", "left")
    return joined.select(
        "doc_id", F.coalesce("class_id", "rep", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("copy_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
    )


def _sorted(tiles: DataFrame) -> DataFrame:
    """Whole tiles in a task each, smallest id first: the root of a star is then the same in every tile that has it."""
    return tiles.repartition("tile").sortWithinPartitions("tile", "rep")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id.

    All columns stay. Rows without id stay, and so do texts without words. Of rows that
    repeat an id and its text one stays; different texts under one id are documents of
    their own, judged each by its text.
    """
    mark = F.xxhash64("text")
    seen = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(mark).alias("low"), F.max(mark).alias("high"))
    repeated = stage(seen.filter("n > 1"), "repeated")
    if repeated.filter("low <> high").isEmpty():
        later = stage(join(docs).filter("doc_id <> class_id").select("doc_id"), "later")
        some, rest = split(without(docs, later), repeated.select("doc_id"))
        return rest.unionByName(some.dropDuplicates(["doc_id"]))
    # (id, text) pairs get numbers of their own, in the order of the ids
    texts = docs.filter("doc_id is not null").select("doc_id", mark.alias("mark"), "text")
    units = stage(row_numbers(texts.select("doc_id", "mark").distinct(), [], [F.col("doc_id"), F.col("mark")], "unit"), "units")
    numbered = texts.dropDuplicates(["doc_id", "mark"]).join(units, ["doc_id", "mark"])
    later = join(numbered.select(F.col("unit").alias("doc_id"), "text")).filter("doc_id <> class_id").select(F.col("doc_id").alias("unit"))
    ident, of = free(docs.columns, "id", "mark")
    gone = stage(units.join(later, "unit").select(F.col("doc_id").alias(ident), F.col("mark").alias(of)), "later")
    left = docs.join(gone, (F.col("doc_id") == F.col(ident)) & (mark == F.col(of)), "left_anti")
    some, rest = split(left, repeated.select("doc_id"))
    return rest.unionByName(some.dropDuplicates(["doc_id", "text"]))
