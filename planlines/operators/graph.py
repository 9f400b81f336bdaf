"""Connected components of an edge table, by joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlines.session import fanout_partitions, release, stage

#: Edges of a group that a task may join by itself, and edges that it joins at a time, about.
GROUP_EDGES, CHUNK_EDGES = 1 << 17, 1 << 16


def _settled(edges: DataFrame, keys: list[str]) -> bool:
    """True when no root is a member of another star: every star is a whole component."""
    roots = edges.select(*keys, F.col("v").alias("u"))
    return edges.select(*keys, "u").join(roots, [*keys, "u"], "left_semi").isEmpty()


def connected_components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Label every node with the smallest node id of its component.

    ``nodes`` has ``keys, n``; ``edges`` has ``keys, u, v`` (any direction, copies
    allowed). Groups of at most GROUP_EDGES edges are labelled in one pass, many of them
    in a task; the edges of larger groups, and all without ``keys``, take ``_stars``.
    """
    canon = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    current = edges.filter("u <> v").select(*keys, *canon).distinct()
    if keys:
        current = stage(current, "edges")
        large = stage(current.groupBy(*keys).count().filter(F.col("count") > GROUP_EDGES).select(*keys), "large")
        if large.isEmpty():
            labels = _small_groups(current, keys)
        else:
            rest = _stars(current.join(large, keys, "left_semi"), keys)
            labels = _small_groups(current.join(large, keys, "left_anti"), keys).unionByName(rest)
        labels = stage(labels, "components")
        release(current)
        release(large)
    else:
        labels = _stars(current, keys)
    labels = labels.select(*keys, F.col("u").alias("n"), F.col("v").alias("component"))
    return nodes.join(labels, [*keys, "n"], "left").select(
        *keys, "n", F.coalesce("component", "n").alias("component")
    )


def joined_nodes(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of the component of each of the nodes 0..n - 1."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        open_edges = a != b
        if not open_edges.any():
            return parent
        u, v, a, b = u[open_edges], v[open_edges], a[open_edges], b[open_edges]
        low = np.minimum(a, b)
        np.minimum.at(parent, a, low)
        np.minimum.at(parent, b, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _small_groups(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, u, v``: every node but the smallest of its component with that one; a group of edges meets in a task."""

    def labelled(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(table))))
        names, ids = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
        codes, at = np.unique(np.tile(group, 2) * len(names) + ids, return_inverse=True)
        root = joined_nodes(at[: len(table)], at[len(table) :], len(codes))
        moved = np.flatnonzero(root != np.arange(len(codes)))
        of = pa.array(starts[codes[moved] // len(names)])
        columns = [table.column(k).take(of).combine_chunks() for k in keys]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(names[codes[c] % len(names)]) for c in (moved, root[moved]))], [*keys, "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            cols = [table.column(k).to_numpy() for k in keys]
            starts = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0)))
            end = len(table) if last else starts[-1]  # the last group may go on in the next batch
            if end:
                yield labelled(table.slice(0, end), starts[starts < end])
            held = table.slice(end).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= CHUNK_EDGES:
                    yield from work(False)
        if held:
            yield from work(True)

    rows = edges.select(*keys, "u", "v")
    dealt = rows.repartition(fanout_partitions(edges.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, rows.schema)


def _stars(current: DataFrame, keys: list[str]) -> DataFrame:
    """Edges ``u > v`` as stars around the smallest node of each component.

    Alternates the large-star and small-star steps of Kiveris et al.
    (SoCC 2014) until every star's root is a root only; the number of rounds follows
    the logarithm of the longest path. The minimum around each node is written out
    before edges meet it, so both sides of that join are plain exchanges and a hub's
    edges split like any skewed key. A round's tables go once the next is written.
    """
    while True:
        last = current
        large = _large_star(last, keys)
        current = _small_star(large, keys)
        release(large)
        if _settled(current, keys):
            return current
        release(last)


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest node around u."""
    both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    low = stage(both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "low")
    # edges are stored with u > v, so the larger neighbours of a node are its "u" partners
    larger = edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("w"))
    out = stage(larger.join(low, [*keys, "u"]).select(*keys, F.col("w").alias("u"), F.col("m").alias("v")).distinct(), "stars")
    release(low)
    return out


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    low = stage(edges.groupBy(*keys, "u").agg(F.min("v").alias("m")), "low")
    moved = edges.join(low, [*keys, "u"]).filter("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    out = stage(moved.unionByName(low.select(*keys, "u", F.col("m").alias("v"))).distinct(), "stars")
    release(low)
    return out
