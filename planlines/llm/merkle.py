"""Merkle manifest of a dataset: nodes labelled with the leaf ranks they cover, proofs by containment joins.

A tree belongs to a scope (a source, or the one tree over all sources). Its leaves
have ranks 0, 1, ...; a node carries the interval ``[lo, hi)`` of ranks below it, and
that label is all the tree there is: no node points to another. Levels are handled
``BAND`` at a time. A bucket is what lies below one node at the top of its band, at
most ``WIDTH`` nodes of the band's lowest level, so no group grows with the data and
a source with most of the rows is as many buckets as its size asks for.

The ancestors of a node are the nodes of its bucket whose intervals contain it; what
such an ancestor covers without the child that contains the node are its siblings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlines.operators.ranking import row_numbers, running
from planlines.session import stage

#: Nodes that become one, levels that one shuffle resolves, and nodes of a bucket.
ARITY, BAND = 3, 3
WIDTH = ARITY**BAND
_POWERS = [ARITY**i for i in range(40)]
STEP = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*parts), 256)


def field(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def scope_of(source: Column) -> Column:
    """A text that is never null and sorts as the sources do: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


@dataclass
class Tree:
    """Buckets of each band (written tables), and the root of each scope."""

    bands: list[DataFrame]
    roots: DataFrame


def _height(n: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in _POWERS]), lambda p: p < n))


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _parents(nodes: Column) -> Column:
    """Nodes one level up: every ARITY consecutive ones, the last run may be shorter."""

    def parent(i):
        kids = F.slice(nodes, i * ARITY + 1, F.lit(ARITY))
        kids = F.transform(kids, lambda k: F.struct(k["lo"].alias("lo"), k["hi"].alias("hi"), k["digest"].alias("digest")))
        return F.struct(
            kids[0]["lo"].alias("lo"), F.element_at(kids, -1)["hi"].alias("hi"),
            digest(_joined(F.transform(kids, lambda k: k["digest"]))).alias("digest"), kids.alias("kids"),
        )

    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / ARITY).cast("int") - 1), parent)


def build(leaves: DataFrame) -> Tree:
    """The trees over ``leaves (scope, rank, n, digest)``; ``n`` is the number of leaves of the scope.

    Ranks of a scope are 0 to n - 1. A scope with one leaf is its own root; otherwise
    levels are added until one node remains. The driver learns the greatest ``n``.
    """
    nodes = leaves.select("scope", _height(F.col("n")).alias("height"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest")
    most = leaves.agg(F.max("n")).first()[0] or 0
    tallest = sum(p < most for p in _POWERS)
    bands, roots = [], [nodes.filter("height = 0").select("scope", "digest")]
    for band in range(-(-tallest // BAND)):
        low = nodes.filter(F.col("height") > BAND * band)
        grouped = low.groupBy("scope", _bucket_of("lo", band).alias("bucket")).agg(
            F.first("height").alias("height"), F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("level0")
        )
        levels = []
        for i in range(BAND):
            below = F.col(f"level{i}")
            none = F.array().cast("array<struct<lo: bigint, hi: bigint, digest: string, kids: array<struct<lo: bigint, hi: bigint, digest: string>>>>")
            grouped = grouped.withColumn(f"level{i + 1}", F.when(F.col("height") > BAND * band + i, _parents(below)).otherwise(none))
            levels.append(f"level{i + 1}")
        made = grouped.withColumn("inner", F.concat(*levels))
        top = F.element_at("inner", -1)
        buckets = stage(made.select("scope", "bucket", "height", "inner", top["lo"].alias("lo"), top["hi"].alias("hi"), top["digest"].alias("digest")), "merkle")
        bands.append(buckets)
        nodes = buckets.select("scope", "height", "lo", "hi", "digest")
        roots.append(nodes.filter(F.col("height") <= BAND * (band + 1)).select("scope", "digest"))
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return Tree(bands, found)


def _bucket_of(lo: str, band: int) -> Column:
    return F.expr(f"`{lo}` DIV {ARITY ** (BAND * (band + 1))}L")


def _steps(inner: Column, rank: Column) -> Column:
    """For each ancestor, lowest first: the digests of its other children before and after the one that holds ``rank``."""

    def siblings(ancestor):
        def side(keep):
            return _joined(F.transform(F.filter(ancestor["kids"], keep), lambda k: k["digest"]))

        return F.struct(side(lambda k: k["hi"] <= rank).alias("before"), side(lambda k: k["lo"] > rank).alias("after"))

    return F.transform(F.filter(inner, lambda a: (a["lo"] <= rank) & (rank < a["hi"])), siblings)


def attach(tree: Tree, rows: DataFrame, above: DataFrame) -> DataFrame:
    """``rows (scope, rank, n, ...)`` with ``path``: the siblings on the way from that leaf to the root, lowest first.

    ``above (scope, path)`` continues the paths beyond the scopes' roots; every scope
    has one row there. Paths are attached from the highest band down, so a join meets
    one row for each node at the top of the band below, and the last one the leaves.
    """
    paths = None
    for band in reversed(range(len(tree.bands))):
        tops = tree.bands[band]
        last = tops.filter(F.col("height") <= BAND * (band + 1)).join(above, "scope").withColumnRenamed("path", "up")
        if paths is None:
            up = last
        else:
            rest = tops.filter(F.col("height") > BAND * (band + 1)).withColumn("bucket_up", _bucket_of("lo", band + 1))
            rest = rest.join(paths, (rest["scope"] == paths["p_scope"]) & (rest["bucket_up"] == paths["p_bucket"]))
            up = last.unionByName(rest.withColumn("up", F.concat(_steps(F.col("p_inner"), F.col("lo")), "p_up")).select(*last.columns))
        paths = up.select(*[F.col(c).alias(f"p_{c}") for c in ("scope", "bucket", "inner", "up")])
    alone = rows.filter("n <= 1").join(above, "scope").select(*rows.columns, "path")
    if paths is None:
        return alone
    many = rows.filter("n > 1").withColumn("_bucket", _bucket_of("rank", 0))
    many = many.join(paths, (many["scope"] == paths["p_scope"]) & (many["_bucket"] == paths["p_bucket"]))
    return alone.unionByName(many.withColumn("path", F.concat(_steps(F.col("p_inner"), F.col("rank")), "p_up")).select(*rows.columns, "path"))


def siblings(path: Column) -> Column:
    """All sibling digests of a path as one text, level by level, left to right."""
    return _joined(F.transform(path, lambda s: F.concat(s["before"], s["after"])))


def fold(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda at, s: digest(s["before"], at, s["after"]))


def forest(leaves: DataFrame) -> DataFrame:
    """Leaves placed in the tree of their scope, and all scopes' roots in one tree above them.

    ``leaves (scope, order columns..., leaf, ...)`` with ``order`` (any column) and
    ``leaf`` (hex digest). Returns its columns with ``subroot``, ``root`` and ``path``.
    Leaves with equal order are placed by their digest, so repeated rows give one
    result. No rows in, no rows out.
    """
    one = leaves.withColumn("_one", F.lit(1).cast("long"))
    placed = stage(running(one, ["scope"], [F.col("order"), F.col("leaf")], {"rank": ("sum", "_one")}).drop("_one"), "leaves")
    placed = placed.withColumn("rank", F.col("rank") - 1).withColumnRenamed("rank_total", "n")
    tree = build(placed.withColumn("digest", F.col("leaf")))
    roots = stage(row_numbers(tree.roots, [], [F.col("scope")]), "subroots")
    n = roots.count()
    tops = roots.select(F.lit("").alias("scope"), (F.col("rank") - 1).alias("rank"), F.lit(n).cast("long").alias("n"), "digest", F.col("scope").alias("of"))
    upper = build(tops)
    first = upper.roots.first()
    end = tops.sparkSession.createDataFrame([("", [])], f"scope string, path {STEP}")
    above = stage(attach(upper, tops, end).select(F.col("of").alias("scope"), F.col("digest").alias("subroot"), "path"), "above")
    with_path = attach(tree, placed, above.select("scope", "path"))
    return with_path.join(above.select("scope", "subroot"), "scope").withColumn("root", F.lit(first["digest"] if first else None))


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """``doc_id, leaf, subroot, root, path`` and ``altered_leaf`` (null where unaltered) of every row of ``docs``.

    A leaf is the digest of the row's ``fields``. One tree per ``source``, leaves by
    ``doc_id`` (null first). As a drill, rows whose unsigned crc32 of the decimal id is
    even are also read without the line feeds of ``text``; a null id is never altered, a
    null text stays. Other columns are ignored, whatever their names.
    """
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    leaf = digest(*[field(F.col(f"`{c}`")) for c in fields])
    cut = [F.replace(F.col("text"), F.lit("\n"), F.lit("")) if c == "text" else F.col(f"`{c}`") for c in fields]
    changed = F.when(even & F.contains("text", F.lit("\n")), digest(*map(field, cut)))
    rows = docs.select(scope_of(F.col("source")).alias("scope"), F.col("doc_id").alias("order"), leaf.alias("leaf"), changed.alias("altered_leaf"))
    return forest(stage(rows, "digests")).withColumnRenamed("order", "doc_id").drop("scope", "rank", "n")


def verify(proved: DataFrame) -> DataFrame:
    """Digests of the proofs and the verdict on the rows as they are read now."""
    now = F.coalesce("altered_leaf", "leaf")
    return proved.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.col("path"), now).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
