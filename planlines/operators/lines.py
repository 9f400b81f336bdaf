"""From two-point chords to merged vertices, edges and polylines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlines.functions import geometry as G
from planlines.operators import spatial as S
from planlines.operators.graph import connected_components
from planlines.operators.ranking import percentiles
from planlines.session import stage

KEYS = ["image_id"]


def chord_endpoints(chords: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Two rows per chord; ``end_id`` = 2·chord_id for the first end, +1 for the second."""
    ends = F.array(
        F.struct((F.col("chord_id") * 2).alias("end_id"), F.col("x1").alias("x"), F.col("y1").alias("y")),
        F.struct((F.col("chord_id") * 2 + 1).alias("end_id"), F.col("x2").alias("x"), F.col("y2").alias("y")),
    )
    return chords.select(*keys, "chord_id", F.explode(ends).alias("e")).select(*keys, "chord_id", "e.*")


def locations(ends: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Distinct end positions with their smallest end id and multiplicity."""
    return ends.groupBy(*keys, "x", "y").agg(F.min("end_id").alias("loc_id"), F.count("*").alias("n_ends"))


def endpoint_pairs(ends: DataFrame, radius: float, keys: list[str] = KEYS) -> DataFrame:
    """Pairs of distinct end positions at most ``radius`` apart, with multiplicities.

    Copies of a position are aggregated first, so ``n`` stacked ends cost one row,
    not n² pairs; ends of one position are trivially within the radius.
    """
    loc = locations(ends, keys)
    a = loc.select(*keys, F.col("loc_id").alias("loc_a"), F.col("x").alias("xa"), F.col("y").alias("ya"),
                   F.col("n_ends").alias("n_a"))
    b = loc.select(*keys, F.col("loc_id").alias("loc_b"), F.col("x").alias("xb"), F.col("y").alias("yb"),
                   F.col("n_ends").alias("n_b"))
    pairs = S.within_radius(a, b, radius, keys, ("xa", "ya"), ("xb", "yb")).filter("loc_a < loc_b")
    return pairs.withColumn("d2", S.distance2("xa", "ya", "xb", "yb"))


def endpoint_clusters(ends: DataFrame, radius: float | str, keys: list[str] = KEYS) -> DataFrame:
    """Single-linkage clusters of chord ends: ``keys, end_id, root`` (root = smallest end id).

    ``radius`` is a number or the name of a key column holding one. Cells of side
    r/√2 hold only ends within r of each other, so a cell is one graph node whatever
    it contains. Two cells up to two apart are linked when any end of one lies within
    r of the other: a semi-join that stops at its first match, never a list of pairs.
    Radius 0 disables merging.
    """
    r = F.col(radius) if isinstance(radius, str) else F.lit(float(radius))
    extra = [] if not isinstance(radius, str) or radius in keys else [radius]
    loc = locations(ends, [*keys, *extra]).withColumn("r", r)
    side = F.col("r") * F.lit(0.5**0.5 * (1 - 1e-9))
    gridded = loc.filter("r > 0").withColumn("cx", F.floor(F.col("x") / side)).withColumn(
        "cy", F.floor(F.col("y") / side)
    )
    cells = gridded.groupBy(*keys, "cx", "cy").agg(F.min("loc_id").alias("node"))
    members = stage(gridded.join(cells, [*keys, "cx", "cy"]), "cells")
    reach = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if (a, b) > (0, 0)]
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in reach])
    probe = members.select(*keys, "r", F.col("x").alias("px"), F.col("y").alias("py"), F.col("node").alias("u"),
                           "cx", "cy", F.explode(offsets).alias("o"))
    probe = probe.withColumn("cx", F.col("cx") + F.col("o.a")).withColumn("cy", F.col("cy") + F.col("o.b")).drop("o")
    here = [*keys, "cx", "cy"]
    p, q = probe.alias("p"), members.select(*here, "x", "y").alias("q")
    cond = S.distance2("p.px", "p.py", "q.x", "q.y") <= F.col("p.r") * F.col("p.r")
    for c in here:
        cond = (F.col(f"p.{c}") == F.col(f"q.{c}")) & cond
    linked = p.join(q, cond, "left_semi").select(*here, "u").distinct()
    edges = linked.join(cells, here).select(*keys, "u", F.col("node").alias("v"))
    comp = connected_components(cells.select(*keys, F.col("node").alias("n")), edges, keys)
    located = members.join(comp.withColumnRenamed("n", "node"), [*keys, "node"]).select(*keys, "x", "y", "component")
    labelled = ends.join(located, [*keys, "x", "y"], "left")
    return labelled.select(*keys, "chord_id", "end_id", "x", "y", F.coalesce("component", "end_id").alias("root"))


def merged_vertices(clusters: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Centroid and size of each cluster."""
    return clusters.groupBy(*keys, "root").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n_ends")
    )


def merged_edges(clusters: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Undirected distinct edges ``u < v`` between clusters; collapsed chords vanish.

    Both ends of a chord meet in one aggregation instead of two self-joins.
    """
    return (
        clusters.groupBy(*keys, "chord_id")
        .agg(F.min("root").alias("u"), F.max("root").alias("v"))
        .filter("u < v")
        .select(*keys, "u", "v")
        .distinct()
    )


def vertex_degree(edges: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return (
        edges.select(*keys, F.explode(F.array("u", "v")).alias("root"))
        .groupBy(*keys, "root")
        .agg(F.count("*").alias("degree"))
        .withColumn("topology", F.col("degree") != 2)
    )


def edge_segments(edges: DataFrame, vertices: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Edges as integer segments between truncated centroids, for rasterising.

    Polylines cover every edge exactly once, so a mask needs the edges only and
    skips the ordering of chains.
    """

    def at(name: str, n: int) -> DataFrame:
        return vertices.select(*keys, F.col("root").alias(name), F.col("x").cast("int").alias(f"x{n}"),
                               F.col("y").cast("int").alias(f"y{n}"))

    return edges.join(at("u", 1), [*keys, "u"]).join(at("v", 2), [*keys, "v"])


def _rank_darts(darts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """List ranking by pointer doubling.

    ``darts`` has ``d`` (the dart), ``nxt`` (its successor or NULL). Returns the
    finished darts with ``last`` (end of the path) and ``steps``, and the darts that
    never finish because they run in a circle. The number of rounds is the logarithm
    of the longest path; a round in which no dart finishes proves the rest circular.
    """
    state = stage(darts.select(*keys, "d", "nxt", F.col("d").alias("last"), F.lit(0).cast("long").alias("steps")), "darts")
    open_before = state.filter("nxt is not null").count()
    while open_before:
        ahead = state.select(*keys, F.col("d").alias("nxt"), F.col("nxt").alias("nxt2"),
                             F.col("last").alias("last2"), F.col("steps").alias("steps2"))
        moved = state.join(ahead, [*keys, "nxt"], "left").select(
            *keys, "d", F.col("nxt2").alias("nxt"), F.coalesce("last2", "last").alias("last"),
            F.when(F.col("steps2").isNull(), F.col("steps")).otherwise(F.col("steps") + F.col("steps2") + 1).alias("steps"),
        )
        state = stage(moved, "darts")
        open_now = state.filter("nxt is not null").count()
        if open_now == open_before:
            break
        open_before = open_now
    return state.filter("nxt is null").drop("nxt"), state.filter("nxt is not null").select(*keys, "d")


def polyline_edges(edges: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Directed edges of every polyline in order: ``keys, chain, seq, a, b, closed, cycle``.

    A polyline is a maximal chain through degree-2 vertices. Each edge is seen as two
    darts; a dart continues where its head has degree 2. Of the two readings of an
    open chain the one starting at the smaller dart is kept; a pure cycle is cut at
    its smallest vertex and read towards that vertex's smaller neighbour.
    """
    edges = stage(edges, "links")
    darts = edges.select(*keys, F.explode(F.array(
        F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b"))
    )).alias("d"))
    inner = vertex_degree(edges, keys).filter("degree = 2").select(*keys, F.col("root").alias("m"))
    # At a degree-2 vertex m the dart (a→m) continues to the neighbour other than a.
    sides = darts.select(*keys, F.col("d.a").alias("m"), F.col("d.b").alias("nb")).join(inner, [*keys, "m"])
    both = sides.groupBy(*keys, "m").agg(F.min("nb").alias("lo"), F.max("nb").alias("hi"))

    def successors(cut: DataFrame | None) -> DataFrame:
        passing = both if cut is None else both.join(cut, [*keys, "m"], "left_anti")
        d = darts.withColumn("m", F.col("d.b"))
        onward = F.when(F.col("lo").isNotNull(), F.struct(
            F.col("m").alias("a"), F.when(F.col("lo") == F.col("d.a"), F.col("hi")).otherwise(F.col("lo")).alias("b")
        ))
        return d.join(passing, [*keys, "m"], "left").select(*keys, "d", onward.alias("nxt"))

    done, circular = _rank_darts(successors(None), keys)
    cyclic = circular.select(*keys, F.col("d.a").alias("u"), F.col("d.b").alias("v"))
    ranked = done.withColumn("cycle", F.lit(False))
    if not circular.isEmpty():
        nodes = cyclic.select(*keys, F.col("u").alias("n")).distinct()
        comp = connected_components(nodes, cyclic, keys)
        cut = comp.select(*keys, F.col("component").alias("m")).distinct()
        ring = successors(cut).join(circular, [*keys, "d"], "left_semi")
        opened, _ = _rank_darts(ring, keys)
        ranked = ranked.unionByName(opened.withColumn("cycle", F.lit(True)))
    ranked = stage(ranked, "ranked")
    flip = F.struct(F.col("last.b").alias("a"), F.col("last.a").alias("b"))
    # The path from dart d ends at dart `last`; its mirror starts at last reversed. A
    # chain is named by its start dart, found as the reverse of the mirror's end.
    mirror = ranked.select(*keys, F.struct(F.col("d.b").alias("a"), F.col("d.a").alias("b")).alias("d"),
                           F.col("last").alias("mirror_last"), F.col("steps").alias("seq"))
    joined = ranked.join(mirror, [*keys, "d"]).withColumn(
        "first", F.struct(F.col("mirror_last.b").alias("a"), F.col("mirror_last.a").alias("b"))
    ).withColumn("other", flip)
    kept = joined.filter(F.col("first") <= F.col("other"))
    return kept.select(
        *keys, F.col("first").alias("chain"), "seq", F.col("d.a").alias("a"), F.col("d.b").alias("b"),
        (F.col("first.a") == F.col("last.b")).alias("closed"), "cycle",
    )


def polylines(chain_edges: DataFrame, vertices: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Long form: one row per polyline point, ``keys, chain_a, chain_b, seq, root, x, y``."""
    first = chain_edges.filter("seq = 0").select(*keys, "chain", F.lit(0).cast("long").alias("seq"), F.col("a").alias("root"))
    rest = chain_edges.select(*keys, "chain", (F.col("seq") + 1).alias("seq"), F.col("b").alias("root"))
    points = first.unionByName(rest).join(vertices.select(*keys, "root", "x", "y"), [*keys, "root"])
    return points.select(*keys, F.col("chain.a").alias("chain_a"), F.col("chain.b").alias("chain_b"), "seq", "root", "x", "y")


def polyline_summary(chain_edges: DataFrame, vertices: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per polyline: number of points, length, closed and pure-cycle flags."""

    def at(name: str, p: str) -> DataFrame:
        return vertices.select(*keys, F.col("root").alias(name), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))

    placed = chain_edges.join(at("a", "a"), [*keys, "a"]).join(at("b", "b"), [*keys, "b"])
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return placed.groupBy(*keys, F.col("chain.a").alias("chain_a"), F.col("chain.b").alias("chain_b")).agg(
        (F.count("*") + 1).alias("n_points"), F.sum(F.sqrt(dx * dx + dy * dy)).alias("length"),
        F.bool_or("closed").alias("closed"), F.bool_or("cycle").alias("pure_cycle"),
    )


def polyline_counts(edges: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``n_open, n_loops, n_polylines`` per group of keys, without walking a chain.

    An open polyline has its two ends at vertices of another degree than 2, so half
    their degree total counts them; a pure loop is a component in which every degree is 2.
    """
    edges = stage(edges, "links")
    degree = stage(vertex_degree(edges, keys), "degrees")
    n_open = degree.filter("degree <> 2").groupBy(*keys).agg((F.expr("sum(degree) div 2")).alias("n_open"))
    nodes = degree.select(*keys, F.col("root").alias("n"))
    comp = connected_components(nodes, edges.select(*keys, "u", "v"), keys).withColumnRenamed("n", "root")
    even = degree.join(comp, [*keys, "root"]).groupBy(*keys, "component").agg(F.bool_and(F.col("degree") == 2).alias("loop"))
    n_loops = even.groupBy(*keys).agg(F.count_if("loop").alias("n_loops"))
    both = n_loops.join(n_open, keys, "left").na.fill(0)
    return both.select(*keys, "n_open", "n_loops", (F.col("n_open") + F.col("n_loops")).alias("n_polylines"))


def polyline_sizes(summary: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Polylines per group of keys and the least, median and greatest number of their points."""
    ends = summary.groupBy(*keys).agg(
        F.count("*").alias("n_polylines"), F.min("n_points").alias("min_points"), F.max("n_points").alias("max_points")
    )
    return ends.join(percentiles(summary, keys, "n_points", {"median_points": 0.5}), keys)
