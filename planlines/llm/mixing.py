"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlines.llm.texts import n_words, task
from planlines.operators.ranking import row_numbers
from planlines.session import stage

WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of one source that share a flight; each leaves at most two undecided.
CHUNK = 512
NEAR = 1e-9


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``source, n_docs, source_size, target`` for ``sizes (source, size)``.

    Sources in code point order, null last, get ``weights`` in turn and share
    ``share`` times all sizes by weight. A target stops at ``most`` times its
    source's size; the excess is shared again by weight until no target is above.
    The level per unit of weight only rises, so a round is one aggregated row, and
    the rounds end when no further source stops. No rows in, no rows out.
    """
    totals = stage(sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")), "sources")
    order = [F.col("source").isNull(), F.col("source")]
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = stage(row_numbers(totals, [], order).withColumn("weight", turn), "ranked")
    level, stopped = None, 0
    while True:
        full = F.col("weight") * (level or 0.0) > most * F.col("source_size")
        row = ranked.agg(
            F.sum("source_size").alias("all"), F.count_if(full).alias("n"),
            F.sum(F.when(full, most * F.col("source_size")).otherwise(0.0)).alias("given"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["open"] or (level is not None and row["n"] == stopped):
            break
        stopped, level = row["n"], (share * row["all"] - row["given"]) / row["open"]
    target = F.least(F.col("weight") * (level or 0.0), most * F.col("source_size"))
    return ranked.select("source", "n_docs", "source_size", target.cast("double").alias("target"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, chunk: int = CHUNK,
    seed: int = 7, carry: tuple[str, ...] = (),
) -> DataFrame:
    """How many copies of each document the mix takes.

    Returns ``doc_id, source, size, source_size, target, copies`` for every row of
    ``docs (doc_id, text, source)``; other columns are ignored, but for those named in
    ``carry``, which come back with their rows and order rows that tie. A document enters
    ``target / source_size`` times on average: the whole part always, the fraction
    by balanced sampling. The flight moves the undecided rows along the null space
    of the two constraints of their source, the number of documents and the number
    of words, until all but two are settled at 0 or 1. Rows of a source are dealt
    into chunks by a hash of their id, and the longest are settled first, so what a
    chunk leaves undecided are two of its shortest rows; these meet in the next
    round. When a source has one chunk left, its last two rows land where the words
    are nearest to what was expected.

    Null text is empty and has size 0; such rows are sampled like others. Null
    sources are one source. Rows with equal ids are sampled separately. The choice
    depends on ids, sizes and ``seed`` alone, not on the layout of the input.
    """
    sizes = stage(docs.select("doc_id", "source", n_words("text").alias("size"), *carry), "sizes")
    targets = source_targets(sizes, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + NEAR)
    rows = sizes.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.*", "source_size", "target", whole.alias("whole"), F.greatest(rate - whole, F.lit(0.0)).alias("p"),
    )
    kept = ["doc_id", "source", "size", "source_size", "target", *carry]
    settled = [rows.filter(F.col("p") <= NEAR).select(*kept, F.col("whole").alias("copies"))]
    left = rows.filter(F.col("p") > NEAR)
    while True:
        left = left.withColumn("spot", F.xxhash64(F.lit(seed), "doc_id", "size"))
        per_source = left.groupBy("source").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
        last = (per_source.agg(F.max("chunks")).first()[0] or 0) <= 1
        dealt = left.alias("l").join(per_source.alias("c"), F.col("l.source").eqNullSafe(F.col("c.source"))).select(
            "l.*", F.pmod(F.col("spot"), F.col("chunks")).alias("part")
        )
        sorted_rows = dealt.repartition("source", "part").sortWithinPartitions(
            "source", "part", F.col("size").desc(), "spot", "doc_id", "p", *carry
        )
        flown = stage(sorted_rows.mapInArrow(task(_fly(seed, last)), rows.drop("p").withColumn("p", F.lit(0.0)).schema), "flight")
        done = F.col("p").isin(0.0, 1.0)
        settled.append(flown.filter(done).select(*kept, (F.col("whole") + F.col("p")).cast("long").alias("copies")))
        if last:
            break
        left = flown.filter(~done)
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def _flight(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Inclusion probabilities after the flight: 0 or 1, but for two rows at most.

    ``sizes`` fall. Each step projects the unit vector of the largest undecided row
    that can move onto the null space of the two constraints, so that row moves most
    and all others make up for it; the step ends where a first row reaches 0 or 1, up or down with
    the chances that keep every expectation. ``last``: the rest lands as well.
    """
    out, at = p.copy(), np.arange(len(p))
    s, q = sizes.astype(float), p.astype(float)
    while True:
        free = (q > NEAR) & (q < 1 - NEAR)
        if not free.all():
            out[at[~free]] = np.round(q[~free])
            at, s, q = at[free], s[free], q[free]
        m = len(q)
        if m < 2 or (m == 2 and s[0] != s[1]):
            break
        c = s - s.mean()
        square = float(c @ c)
        flat = square <= 1e-12 * float(s @ s)
        free_to = 1 - 1.0 / m - (0.0 if flat else c * c / square) + np.zeros(m)
        g = int(np.argmax(free_to > 1e-6))  # the largest row that the constraints let move
        if free_to[g] <= 1e-6:
            break
        move = np.full(m, -1.0 / m) if flat else -(1.0 / m + (c[g] / square) * c)
        move[g] += 1.0
        move[np.abs(move) < 1e-12] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(move > 0, (1 - q) / move, np.where(move < 0, q / -move, np.inf)))
            down = np.min(np.where(move > 0, q / move, np.where(move < 0, (1 - q) / -move, np.inf)))
        if not np.isfinite(up + down):
            break
        q = q + (up if rng.random() * (up + down) < down else -down) * move
    if last and 0 < len(q) <= 4:
        sides = [np.array([(k >> i) & 1 for i in range(len(q))], float) for k in range(1 << len(q))]
        q = min(sides, key=lambda x: (abs((x - q) @ s), abs((x - q).sum()), tuple(x)))
    elif last:
        q = (np.cumsum(q) + 0.5).astype(int) - (np.cumsum(q) - q + 0.5).astype(int)
    out[at] = q
    return out


def _fly(seed: int, last: bool):
    """Task of one round: the rows of each (source, part), in blocks of twice a chunk at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rng, held = None, None, []

        def settle(schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            p = _flight(np.array([r["size"] for r in held], float), np.array([r["p"] for r in held]), rng, last)
            names = [n for n in schema.names if n not in ("p", "spot", "part")] + ["p"]
            rows = [{n: r[n] for n in names[:-1]} | {"p": float(x)} for r, x in zip(held, p)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([schema.field(n) for n in names]))

        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["source"], row["part"]) or len(held) >= 2 * CHUNK:
                    if held:
                        yield from settle(batch.schema)
                    key, held = (row["source"], row["part"]), []
                    rng = np.random.default_rng(xxhash.xxh3_64_intdigest(repr((seed, key, row["spot"])).encode()))
                held.append(row)
            schema = batch.schema
        if held:
            yield from settle(schema)

    return run


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """Rows of ``docs`` that the mix takes, with all their columns and ``copies``.

    Each row is judged and kept by itself, whether its id is null or repeated: the
    rows are written out with a key of their own, and the mix is joined back on it.
    Rows with equal ids and sizes are told apart by their text. ``copies`` replaces a
    column of that name.
    """
    docs = docs.drop("copies")
    taken_names, end = {c.lower() for c in docs.columns}, ""
    while {f"mix_row{end}", f"mix_text{end}"} & taken_names:
        end += "_"
    row, text = f"mix_row{end}", f"mix_text{end}"
    keyed = stage(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    marked = keyed.select("doc_id", "text", "source", F.xxhash64("text").alias(text), row)
    taken = mix(marked, carry=(text, row), **how).filter("copies > 0").select(row, "copies")
    return keyed.join(taken, row).drop(row)
