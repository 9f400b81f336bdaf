"""k-means fits that share their scans, and silhouettes under plain Euclidean distance.

All restarts and all K advance together: a round is one pass in which every row
meets the packed centroids of every fit that still moves, so ten restarts of five K
cost as many passes as the slowest of them, not their sum. Tasks return one sum for
each (fit, cluster); the driver holds centroids only. Copies of a vector are one row
with a weight, so passes and pairs cost what the distinct vectors cost. Fits read
vectors as written matrices (``blocks``): a pass decodes no vector element by element.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlines.operators.symbols import l2_normalize
from planlines.session import fanout_partitions, release, stage

K_CANDIDATES = [15, 20, 30, 40, 50]

#: Rounds of the start, and rows each draws for a fit as a multiple of its K.
START_ROUNDS, START_FACTOR = 3, 2
#: Rows that a task multiplies at a time, and scored rows that a silhouette tile holds.
SLAB, TILE_ROWS = 4096, 32768
#: Rows of a written matrix, and matrices that make a task of a pass, about.
BLOCK, BLOCKS_PER_TASK = 1024, 4


@dataclass
class Fit:
    """One k-means fit: ``centres`` by cluster, ``cost`` the sum of squared distances to them."""

    k: int
    seed: int
    centres: np.ndarray
    counts: np.ndarray | None = None
    cost: float = float("nan")
    rounds: int = 0
    settled: bool = False


def _matrix(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors, keys and weights of each of the ``blocks``."""
    for batch in batches:
        for units, keys, weights in zip(*(batch.column(c) for c in ("units", "keys", "weights"))):
            key, weight = np.frombuffer(keys.as_buffer(), np.int64), np.frombuffer(weights.as_buffer())
            yield np.frombuffer(units.as_buffer()).reshape(len(key), -1), key, weight


def added_up(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]], slots: int) -> dict[int, np.ndarray]:
    """``work`` on the rows of each task, its arrays summed by slot over all tasks in task order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, at = work(batches), TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({
            "slot": pa.array(list(found), pa.int32()), "part": pa.array([at] * len(found), pa.int32()),
            "sums": pa.array([np.asarray(v, np.float64).tobytes() for v in found.values()], pa.binary()),
        })

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, sums in zip(batch.column("slot").to_pylist(), batch.column("sums")):
                total[slot] = total.get(slot, 0.0) + np.frombuffer(sums.as_py())
        yield pa.RecordBatch.from_pydict({
            "slot": pa.array(list(total), pa.int32()), "sums": pa.array([v.tobytes() for v in total.values()], pa.binary()),
        })

    parts = rows.mapInArrow(each, "slot int, part int, sums binary")
    dealt = parts.repartition(max(1, min(slots, 16)), "slot").sortWithinPartitions("slot", "part")
    return {r["slot"]: np.frombuffer(r["sums"]) for r in dealt.mapInArrow(add, "slot int, sums binary").collect()}


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, never negative."""
    square = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    return np.maximum(square, 0.0)


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1] for each key, another one for each salt."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)


def packed_rows(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """``unit, key`` and the columns ``keep`` of the rows that have a vector, written out for the passes."""
    known = df.filter(F.col(vector).isNotNull())
    return stage(known.select(*keep, F.col(vector).cast("array<double>").alias("unit"), F.xxhash64(vector).alias("key")), "vectors")


def collapsed(rows: DataFrame, *labels: str) -> DataFrame:
    """``unit, key, weight`` and the ``labels`` of ``packed_rows``: copies become one row with their number, written out.

    Rows that carry a weight already keep it, unless labels are asked for.
    """
    if "weight" in rows.columns and not labels:
        return rows
    weight = F.sum("weight") if "weight" in rows.columns else F.count("*")
    return stage(rows.groupBy("unit", "key", *labels).agg(weight.cast("double").alias("weight")), "distinct")


def blocks(rows: DataFrame) -> DataFrame:
    """``units, keys, weights``: the ``collapsed`` rows as matrices of BLOCK rows, in order of their keys, written out."""
    if "units" in rows.columns:
        return rows
    rows = collapsed(rows)
    parts = max(1, min(fanout_partitions(rows.sparkSession), -(-rows.count() // (BLOCK * BLOCKS_PER_TASK))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def matrices(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            end = len(table) if last else len(table) // BLOCK * BLOCK
            for a in range(0, end, BLOCK):
                part = table.slice(a, min(BLOCK, end - a)).to_batches()[0]
                flat = _matrix(part.column("unit")), *(part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "weight"))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in flat], ["units", "keys", "weights"])
            held = table.slice(end).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield from matrices(False)
        if sum(b.num_rows for b in held):
            yield from matrices(True)

    dealt = rows.select("unit", "key", "weight").repartition(parts, "key").sortWithinPartitions("key", "unit")
    return stage(dealt.mapInArrow(pack, "units binary, keys binary, weights binary"), "blocks")


def unit_embeddings(symbols: DataFrame, *keep: str) -> DataFrame:
    """``packed_rows`` of the symbols' unit embeddings with the columns ``keep``."""
    return packed_rows(symbols.select(*keep, l2_normalize(F.col("embedding")).alias("v")), "v", *keep)


def cluster_symbols(symbols: DataFrame, k: int = 30, inits: int = 10) -> DataFrame:
    """Symbols with the k-means cluster of their unit embedding; without symbols an empty table."""
    keep = [c for c in symbols.columns if c != "embedding"]
    rows = unit_embeddings(symbols, *keep)
    chosen = best(fit_all(rows, [k], inits), k)
    centres = chosen.centres if len(chosen.centres) else np.zeros((1, 1))
    return assign(rows, {"cluster": centres}).drop("unit", "key")


def _drawn(rows: DataFrame, sets: list[np.ndarray], most: list[int], turn: int) -> list[np.ndarray]:
    """For each set ``most`` rows, drawn with weights by the squared distance to its nearest centroid.

    Every row draws an exponential waiting time with its distance times its weight as the
    rate (the first of its copies' times); the shortest times of all are a weighted sample, so a task keeps ``most`` rows and
    the sample has its size in one pass. A set without centroids weighs all alike.
    """
    send = rows.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0), None) for _ in send.value]
        for x, key, weight in _matrices(batches):
            for f, centres in enumerate(send.value):
                far = _distances(x, centres).min(axis=1) if len(centres) else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    wait = -np.log(_uniform(key, turn * 100003 + f)) / (far * weight)
                wait[far <= 1e-18] = np.inf
                old, kept = held[f]
                wait, all_x = np.concatenate([old, wait]), x if kept is None else np.concatenate([kept, x])
                best = np.argsort(wait, kind="stable")[: most[f]]
                best = best[np.isfinite(wait[best])]
                held[f] = wait[best], all_x[best]
        for f, (wait, x) in enumerate(held):
            if x is not None and len(wait):
                yield pa.RecordBatch.from_pydict({
                    "f": pa.array([f] * len(wait), pa.int32()), "wait": pa.array(wait), "x": pa.array([v.tobytes() for v in x], pa.binary()),
                })

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first ``most`` rows of each set, from rows in order."""
        seen: dict[int, int] = {}
        for batch in batches:
            mine = []
            for i, f in enumerate(batch.column("f").to_pylist()):
                seen[f] = seen.get(f, 0) + 1
                if seen[f] <= most[f]:
                    mine.append(i)
            yield batch.take(pa.array(mine, pa.int64()))

    drawn = rows.mapInArrow(run, "f int, wait double, x binary")  # of each task at most ``most`` rows a set
    dealt = drawn.repartition(max(1, min(len(sets), 16)), "f").sortWithinPartitions("f", "wait", "x")
    out: list[list] = [[] for _ in sets]
    for r in sorted(dealt.mapInArrow(least, drawn.schema).collect(), key=lambda r: (r["f"], r["wait"], r["x"])):
        out[r["f"]].append(np.frombuffer(r["x"]))
    send.destroy()
    return [np.array(v) for v in out]


def _spread(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of the weighted points: the first by weight, each next by weight times squared distance to the nearest so far."""
    rng = np.random.default_rng(seed)
    chosen = [points[rng.choice(len(points), p=weight / weight.sum())]]
    near = _distances(points, chosen[0][None, :])[:, 0]
    while len(chosen) < k:
        p = weight * near
        if p.sum() <= 0:  # fewer distinct points than clusters: the rest repeat
            chosen.append(chosen[-1])
            continue
        chosen.append(points[rng.choice(len(points), p=p / p.sum())])
        near = np.minimum(near, _distances(points, chosen[-1][None, :])[:, 0])
    return np.array(chosen)


def starts(rows: DataFrame, wanted: list[tuple[int, int]]) -> list[np.ndarray]:
    """Start centroids for each (k, seed), all drawn in the same START_ROUNDS + 2 passes."""
    rows = blocks(rows)
    sets = _drawn(rows, [np.empty((0, 0))] * len(wanted), [1] * len(wanted), wanted[0][1])
    if not len(sets[0]):
        return sets
    for turn in range(START_ROUNDS):
        more = _drawn(rows, sets, [START_FACTOR * k for k, _ in wanted], 7 * (turn + 1))
        sets = [np.concatenate([s, m]) if len(m) else s for s, m in zip(sets, more)]
    totals = advance(rows, dict(enumerate(sets)))
    return [_spread(s, totals[f][1], k, seed) for f, (s, (k, seed)) in enumerate(zip(sets, wanted))]


def advance(rows: DataFrame, sets: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each set of centroids: vector sum and number of the rows in ``blocks`` nearest to each, and the cost. One pass for all sets."""
    send = rows.sparkSession.sparkContext.broadcast(sets)

    def work(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        order = list(send.value)
        packed = np.concatenate([send.value[f] for f in order])
        ends = np.cumsum([len(send.value[f]) for f in order])
        weights = np.concatenate([-2 * packed.T, (packed * packed).sum(axis=1)[None]])  # of (x, 1): squared distance less |x|²
        sums, counts, cost = np.zeros_like(packed), np.zeros(len(packed)), np.zeros(len(order))
        far, mine = np.empty((0, len(packed))), np.zeros((0, len(packed)))  # kept from block to block
        for x, _, weight in _matrices(batches):
            n = len(x)
            if len(far) < n:
                far, mine = np.empty((n, len(packed))), np.zeros((n, len(packed)))
            np.matmul(np.column_stack([x, np.ones(n)]), weights, out=far[:n])
            rows_of = np.arange(n)[:, None]
            near = np.column_stack([a + far[:n, a:b].argmin(axis=1) for a, b in zip([0, *ends[:-1]], ends)])
            cost += weight @ np.maximum(far[rows_of, near] + (x * x).sum(axis=1)[:, None], 0.0)
            mine[rows_of, near] = weight[:, None]
            sums += mine[:n].T @ x
            counts += mine[:n].sum(axis=0)
            mine[rows_of, near] = 0.0
        return {f: np.append(np.column_stack([sums[b - len(send.value[f]) : b], counts[b - len(send.value[f]) : b]]).ravel(), cost[at])
                for at, (f, b) in enumerate(zip(order, ends))}

    found = added_up(rows, work, len(sets))
    send.destroy()
    out = {}
    for f, centres in sets.items():
        table = found[f][:-1].reshape(len(centres), -1)
        out[f] = table[:, :-1], table[:, -1], float(found[f][-1])
    return out


def _mean_variance(rows: DataFrame) -> float:
    def work(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = None
        for x, _, weight in _matrices(batches):
            one = np.concatenate([weight @ x, weight @ (x * x), [weight.sum()]])
            total = one if total is None else total + one
        return {} if total is None else {0: total}

    found = added_up(rows, work, 1)
    if not found:
        return 0.0
    n, d = found[0][-1], len(found[0]) // 2
    return float((found[0][d : 2 * d] / n - (found[0][:d] / n) ** 2).mean())


def lloyd(rows: DataFrame, fits: list[Fit], max_iter: int = 300, tol: float = 1e-4) -> list[Fit]:
    """Move all ``fits`` until each settles: squared centroid shifts within ``tol`` times the mean variance.

    A cluster that loses all rows keeps its centroid. Costs and counts are those of
    the final centroids. Fits that reach ``max_iter`` give a warning.
    """
    rows = blocks(rows)
    limit = tol * _mean_variance(rows)
    moving = {i: f for i, f in enumerate(fits) if len(f.centres)}
    while moving:
        found = advance(rows, {i: f.centres for i, f in moving.items()})
        for i, (sums, counts, _) in found.items():
            f = moving[i]
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], f.centres)
            f.settled = bool(((new - f.centres) ** 2).sum() <= limit)
            f.centres, f.rounds = new, f.rounds + 1
        moving = {i: f for i, f in moving.items() if not f.settled and f.rounds < max_iter}
    if any(len(f.centres) and not f.settled for f in fits):
        warnings.warn(f"k-means stopped after {max_iter} rounds without settling", stacklevel=2)
    known = {i: f.centres for i, f in enumerate(fits) if len(f.centres)}
    for i, (_, counts, cost) in (advance(rows, known) if known else {}).items():
        fits[i].counts, fits[i].cost = np.rint(counts).astype(np.int64), cost
    return fits


def fit_all(rows: DataFrame, ks: list[int], inits: int = 10, seed: int = 0, max_iter: int = 300, tol: float = 1e-4) -> list[Fit]:
    """``inits`` fits for each of ``ks`` over ``rows (unit, key)`` of ``packed_rows``; without rows they have no centroids."""
    packed = blocks(rows)
    wanted = [(k, seed + i) for k in ks for i in range(inits)]
    fits = [Fit(k, s, c) for (k, s), c in zip(wanted, starts(packed, wanted))]
    lloyd(packed, fits, max_iter, tol)
    release(packed)
    return fits


def best(fits: list[Fit], k: int) -> Fit:
    """The fit of least cost for ``k``, the first on ties."""
    return min((f for f in fits if f.k == k), key=lambda f: f.cost)


def assign(rows: DataFrame, named: dict[str, np.ndarray]) -> DataFrame:
    """``rows`` with the nearest centroid's number for each named set, the lowest number on ties."""
    send = rows.sparkSession.sparkContext.broadcast(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLAB):
                part = batch.slice(a, SLAB)
                x = _matrix(part.column("unit"))
                for name, centres in send.value.items():
                    part = part.append_column(name, pa.array(_distances(x, centres).argmin(axis=1), pa.int32()))
                yield part

    extra = ", ".join(f"{n} int" for n in named)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, {extra}")


# --- silhouettes --------------------------------------------------------------


def silhouettes(rows: DataFrame, labels: list[str], sample: int | None = None) -> DataFrame:
    """``label, n, silhouette``: mean silhouette under Euclidean distance for each of the ``labels`` (int columns from 0) of ``rows (unit, key)``.

    Copies with the same labels are one row with a weight. All distinct rows are scored,
    or with ``sample`` about as many, those of least hash; every scored row is measured
    against all rows. Scored rows are dealt into groups of about TILE_ROWS, all rows into
    strands: a tile holds one group, reads one strand by batches and gives one sum for each
    (row, cluster) of all labellings at once, so no pair is a row and no task holds more
    than a group. The time for all rows grows with the square of the distinct rows, as
    plain distances have it; with ``sample`` it grows with the rows. Rows alone in their
    cluster score 0; below two clusters the value is NULL.
    """
    spark, n_labels = rows.sparkSession, len(labels)
    everything = collapsed(rows, *labels)
    numbered = stage(everything.withColumn("id", F.monotonically_increasing_id()), "rows")
    sizes: list[dict[int, float]] = [{r[c]: r["n"] for r in numbered.groupBy(c).agg(F.sum("weight").alias("n")).collect()} for c in labels]  # clusters
    width = [max(s, default=-1) + 1 for s in sizes]
    offset = np.cumsum([0, *width])
    asked, n = numbered, numbered.count()
    if sample is not None:
        limit = int(min(1.0, sample / max(n, 1)) * (1 << 40))
        asked = numbered.filter(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 40)) < limit)
        n = asked.count()
    parts = fanout_partitions(spark)
    groups = max(1, -(-n // TILE_ROWS))
    strands = max(1, -(-parts // groups))
    group, strand = (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int") for salt, m in ((1, groups), (2, strands)))

    def every(m: int):
        return F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    columns = ["id", "unit", "weight", *labels]
    left = asked.select(group.alias("g"), every(strands).alias("s"), F.lit(0).alias("kind"), *columns)
    right = numbered.select(every(groups).alias("g"), strand.alias("s"), F.lit(1).alias("kind"), *columns)

    def tags_of(part: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([part.column(c).to_numpy(zero_copy_only=False) for c in labels]).astype(np.int64)

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x, held, sums, filled = None, None, [], None, False

        def done() -> Iterator[pa.RecordBatch]:
            for a in range(0, 0 if sums is None else len(sums), SLAB):
                own = pa.concat_arrays([p.column("id") for p in held])[a : a + SLAB], pa.concat_arrays([p.column("weight") for p in held])[a : a + SLAB]
                tags = np.concatenate([tags_of(p) for p in held])[a : a + SLAB]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array([t.tobytes() for t in tags], pa.binary()), pa.array([v.tobytes() for v in sums[a : a + SLAB]], pa.binary())],
                    ["id", "weight", "tags", "sums"])

        for batch in batches:
            tiles = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "s", "kind")])
            cuts = np.flatnonzero((tiles[1:] != tiles[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                here, part = (int(tiles[a, 0]), int(tiles[a, 1])), batch.slice(a, b - a)
                if here != at:
                    yield from done()
                    at, x, held, sums, filled = here, None, [], None, False
                if tiles[a, 2] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if not filled:
                    x, filled = np.concatenate([_matrix(p.column("unit")) for p in held]), True
                    x = np.column_stack([x, np.ones(len(x)), (x * x).sum(axis=1)])
                    sums = np.zeros((len(x), offset[-1]))
                for c in range(0, part.num_rows, 1024):
                    piece = part.slice(c, 1024)
                    y, others, weight = _matrix(piece.column("unit")), tags_of(piece), piece.column("weight").to_numpy(zero_copy_only=False)
                    member = np.zeros((len(y), offset[-1]))
                    for k in range(n_labels):
                        member[np.arange(len(y)), offset[k] + others[:, k]] = weight
                    toward = np.concatenate([-2 * y.T, (y * y).sum(axis=1)[None], np.ones((1, len(y)))])  # of (x, 1, |x|²): squared distance
                    for r in range(0, len(x), SLAB // 8):
                        far = x[r : r + SLAB // 8] @ toward
                        np.sqrt(np.maximum(far, 0.0, out=far), out=far)
                        sums[r : r + SLAB // 8] += far @ member
        yield from done()

    def score(weight: np.ndarray, tags: np.ndarray, sums: np.ndarray) -> list[tuple[int, float, float]]:
        out = []
        for c in range(n_labels):
            count = np.array([sizes[c].get(k, 0) for k in range(width[c])], float)
            own, mine = tags[:, c], sums[:, offset[c] : offset[c + 1]]
            a = mine[np.arange(len(own)), own] / np.maximum(count[own] - 1, 1)
            mean = np.where(count > 0, mine / np.maximum(count, 1), np.inf)
            mean[np.arange(len(own)), own] = np.inf
            b = mean.min(axis=1) if width[c] else np.zeros(len(own))
            with np.errstate(invalid="ignore"):
                s = np.where((count[own] > 1) & np.isfinite(b), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
            out.append((c, float(weight.sum()), float(weight @ s)))
        return out

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a row's strands follow one another; the last row of a batch waits for the next."""
        found, rest = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "weight"))
            tags = np.frombuffer(b"".join(batch.column("tags").to_pylist()), np.int64).reshape(len(ids), n_labels)
            sums = np.frombuffer(b"".join(batch.column("sums").to_pylist())).reshape(len(ids), -1)
            if rest is not None:
                ids, weight, tags, sums = (np.concatenate([p, q]) for p, q in zip(rest, (ids, weight, tags, sums)))
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            whole = ids[first], weight[first], tags[first], np.add.reduceat(sums, first, axis=0)
            found += score(*(v[:-1] for v in whole[1:]))
            rest = tuple(v[-1:] for v in whole)
        if rest is not None:
            found += score(*rest[1:])
        cols = list(zip(*found)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.float64()))], ["c", "n", "total"])

    tiles = left.unionByName(right).repartition(max(parts, min(groups * strands, 4 * parts)), "g", "s").sortWithinPartitions("g", "s", "kind")
    sums = tiles.mapInArrow(tile, "id long, weight double, tags binary, sums binary")
    scored = sums.repartition(parts, "id").sortWithinPartitions("id").mapInArrow(add, "c int, n double, total double")
    got = {r["c"]: (r["n"], r["total"]) for r in scored.groupBy("c").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    release(numbered)
    release(everything)
    out = []
    for c, name in enumerate(labels):
        n, total = got.get(c, (0, 0.0))
        out.append((name, round(n), total / n if n and len(sizes[c]) > 1 else None))
    return spark.createDataFrame(out, "label string, n long, silhouette double")


def pick_k(rows: DataFrame, fits: list[Fit], sample: int | None = None) -> tuple[int, dict[int, float | None]]:
    """K of the highest silhouette over the best fit of each K, the smallest on ties, and all values."""
    ks = sorted({f.k for f in fits})
    named = {f"c{k}": best(fits, k).centres for k in ks}
    labelled = stage(assign(collapsed(rows), named), "labelled")
    values = {int(r["label"][1:]): r["silhouette"] for r in silhouettes(labelled, list(named), sample).collect()}
    release(labelled)
    return max(ks, key=lambda k: (-1.0 if values[k] is None else values[k], -k)), values
