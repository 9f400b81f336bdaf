"""DuckDB texts of the derived relations, composed into WITH clauses by name."""

from __future__ import annotations

import re

from planlines.plans.fixtures import duck_texts
from planlines.plans.inputs import BIAS, WEIGHTS


def raster_sql(segments: str, thickness: int) -> str:
    """Exact round-brush strokes of integer segments by testing every bounding-box pixel."""
    pad = (thickness + 1) // 2
    dot = "((px.x - s.x1) * (s.x2 - s.x1) + (py.y - s.y1) * (s.y2 - s.y1))"
    len2 = "((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1))"
    cross = "((px.x - s.x1) * (s.y2 - s.y1) - (py.y - s.y1) * (s.x2 - s.x1))"
    t2 = thickness * thickness
    return f"""
SELECT DISTINCT s.image_id, CAST(py.y AS INT) AS y, CAST(px.x AS INT) AS x FROM {segments} s,
  UNNEST(range(greatest(0, least(s.y1, s.y2) - {pad}), least(s.height - 1, greatest(s.y1, s.y2) + {pad}) + 1)) AS py(y),
  UNNEST(range(greatest(0, least(s.x1, s.x2) - {pad}), least(s.width - 1, greatest(s.x1, s.x2) + {pad}) + 1)) AS px(x)
WHERE CASE WHEN {dot} <= 0 THEN 4 * ((px.x - s.x1) * (px.x - s.x1) + (py.y - s.y1) * (py.y - s.y1)) <= {t2}
           WHEN {dot} >= {len2} THEN 4 * ((px.x - s.x2) * (px.x - s.x2) + (py.y - s.y2) * (py.y - s.y2)) <= {t2}
           ELSE 4 * {cross} * {cross} <= {t2} * {len2} END"""


def segments_sql(source: str) -> str:
    return f"""
SELECT DISTINCT c.image_id, CAST(trunc(c.x1) AS BIGINT) AS x1, CAST(trunc(c.y1) AS BIGINT) AS y1,
       CAST(trunc(c.x2) AS BIGINT) AS x2, CAST(trunc(c.y2) AS BIGINT) AS y2, i.width, i.height
FROM {source} c JOIN images i USING (image_id)"""


def dilate_sql(mask: str, radius: int) -> str:
    return f"""
SELECT DISTINCT m.image_id, CAST(m.y + k.dy AS INT) AS y, CAST(m.x + o.dx AS INT) AS x
FROM {mask} m JOIN images i USING (image_id),
     (SELECT dy, CAST(round_even(sqrt({radius * radius} - dy * dy), 0) AS BIGINT) AS hw FROM (SELECT UNNEST(range(-{radius}, {radius + 1})) AS dy)) k,
     UNNEST(range(-k.hw, k.hw + 1)) AS o(dx)
WHERE m.y + k.dy >= 0 AND m.y + k.dy < i.height AND m.x + o.dx >= 0 AND m.x + o.dx < i.width"""


def _thin_pass(rows: str, first: bool, columns: bool = False) -> str:
    """One sub-round of thinning on a list of rows as bits (or of ``columns``), every cell of one at once.

    Of eight neighbour bits, ``more`` marks cells with at least two of them set; the
    same on the complements says at least two are empty, that is at most six are set.
    """
    ring = ["n", "ne", "e", "se", "s", "sw", "w", "nw"]

    def some(terms: list[str]) -> str:
        return "(" + " | ".join(terms) + ")"

    def more(terms: list[str]) -> str:
        return some([f"({t} & {some(terms[:i])})" for i, t in enumerate(terms) if i])

    bits = [f"r.{c}" for c in ring]
    holes = [f"(~{b})" for b in bits]
    rises = [f"((~{a}) & {b})" for a, b in zip(bits, bits[1:] + bits[:1])]
    triples = [("n", "e", "s"), ("e", "s", "w")] if first else [("n", "e", "w"), ("n", "s", "w")]
    sides = " & ".join(f"(~(r.{a} & r.{b} & r.{c}))" for a, b, c in triples)
    lone = ("((r.e & r.s & r.se) & ~((r.u << 1) | r.u | (r.u >> 1) | (r.u >> 2) | (r.dd << 1) | r.dd | (r.dd >> 1) | (r.dd >> 2)"
            " | (r.c << 1) | (r.c >> 2) | (r.d << 1) | (r.d >> 2)))")
    gone = f"{more(bits)} & {more(holes)} & {some(rises)} & (~{more(rises)}) & {sides} & (~{lone})"
    at = f"coalesce({rows}[%s], 0)"
    u, c, d, dd = (at % i for i in ("i - 1", "i", "i + 1", "i + 2"))
    if columns:  # u and d are the columns to the west and east, bit y of a column is row y
        around = {"n": f"{c} << 1", "ne": f"{d} << 1", "e": d, "se": f"{d} >> 1", "s": f"{c} >> 1", "sw": f"{u} >> 1", "w": u, "nw": f"{u} << 1"}
    else:
        west = lambda v: f"(({v} << 1) & 4294967295)"
        around = {"n": u, "ne": f"{u} >> 1", "e": f"{c} >> 1", "se": f"{d} >> 1", "s": d, "sw": west(d), "w": west(c), "nw": west(u)}
    cells = ", ".join(f"'{k}': {v}" for k, v in {"c": c, "u": u, "d": d, "dd": dd, **around}.items())
    return f"list_transform(list_transform(range(1, len({rows}) + 1), lambda i: {{{cells}}}), lambda r: r.c & ~({gone}))"


def thin_sql(name: str, source: str) -> dict[str, str]:
    """Tiles of 32 pixels thinned one by one: ``{name}_rows`` before, ``{name}`` after the round that changes nothing.

    ``source``: pixels ``(image_id, tile_row, tile_col, ly, lx, kind)``. A tile is a list of
    rows, bit x of a row its column x.
    """
    at = "image_id, tile_row, tile_col, kind"
    return {
        f"{name}_rows": f"""SELECT {at}, list_transform(range(0, 32), lambda y: coalesce(list_filter(l, lambda e: e.ly = y)[1].w, 0)) AS m
FROM (SELECT {at}, list({{'ly': ly, 'w': w}}) AS l FROM (SELECT {at}, ly, CAST(sum(1::BIGINT << lx) AS BIGINT) AS w FROM ({source}) GROUP BY {at}, ly) GROUP BY {at})""",
        f"{name}_half": f"""SELECT {at}, m AS old, m AS half, 0 AS k, false AS settled FROM {name}_rows
UNION ALL SELECT {at}, CASE WHEN k % 2 = 0 THEN half ELSE old END,
  CASE WHEN k % 2 = 0 THEN {_thin_pass("half", True)} ELSE {_thin_pass("half", False)} END, k + 1,
  k % 2 = 1 AND old = {_thin_pass("half", False)} FROM {name}_half WHERE NOT settled""",
        name: f"SELECT {at}, half AS m FROM {name}_half WHERE settled",
    }


def image_thin_sql(name: str, source: str) -> dict[str, str]:
    """Whole images of at most 120 rows thinned: the pixels ``{name} (image_id, kind, y, x)`` that are left.

    ``source``: pixels ``(image_id, y, x, kind)``. An image is a list of its columns, bit y of a
    column its row y.
    """
    at = "image_id, kind"
    return {
        f"{name}_columns": f"""SELECT {at}, list_transform(range(0, w + 1), lambda x: coalesce(list_filter(l, lambda e: e.x = x)[1].b, 0::HUGEINT)) AS m
FROM (SELECT {at}, max(x) AS w, list({{'x': x, 'b': b}}) AS l FROM (SELECT {at}, x, CAST(sum(1::HUGEINT << y) AS HUGEINT) AS b FROM ({source}) GROUP BY {at}, x) GROUP BY {at})""",
        f"{name}_half": f"""SELECT {at}, m AS old, m AS half, 0 AS k, false AS settled FROM {name}_columns
UNION ALL SELECT {at}, CASE WHEN k % 2 = 0 THEN half ELSE old END,
  CASE WHEN k % 2 = 0 THEN {_thin_pass("half", True, True)} ELSE {_thin_pass("half", False, True)} END, k + 1,
  k % 2 = 1 AND old = {_thin_pass("half", False, True)} FROM {name}_half WHERE NOT settled""",
        name: f"""SELECT image_id, kind, CAST(y.y AS INT) AS y, CAST(x.x AS INT) AS x FROM {name}_half, UNNEST(range(0, len(half))) AS x(x), UNNEST(range(0, 120)) AS y(y)
WHERE settled AND (half[x.x + 1] >> y.y) & 1 = 1""",
    }


def tile_counts_sql(name: str) -> str:
    """Counts of both masks (kind 0 and 1) and their skeletons, one row for each tile."""
    bits = lambda e: f"CAST(list_sum(list_transform(range(1, 33), lambda y: bit_count({e}))) AS BIGINT)"
    return f"""SELECT image_id, tile_row, tile_col, {bits("g[y]")} AS n_gt, {bits("p[y]")} AS n_pred, {bits("g[y] & p[y]")} AS n_both,
  {bits("gs[y]")} AS gt_skel, {bits("ps[y]")} AS pred_skel, {bits("ps[y] & g[y]")} AS pred_skel_in_gt, {bits("gs[y] & p[y]")} AS gt_skel_in_pred
FROM (SELECT image_id, tile_row, tile_col, coalesce(any_value(a.m) FILTER (kind = 0), list_transform(range(32), lambda y: 0::BIGINT)) AS g,
    coalesce(any_value(a.m) FILTER (kind = 1), list_transform(range(32), lambda y: 0::BIGINT)) AS p,
    coalesce(any_value(b.m) FILTER (kind = 0), list_transform(range(32), lambda y: 0::BIGINT)) AS gs,
    coalesce(any_value(b.m) FILTER (kind = 1), list_transform(range(32), lambda y: 0::BIGINT)) AS ps
  FROM {name}_rows a JOIN {name} b USING (image_id, tile_row, tile_col, kind) GROUP BY image_id, tile_row, tile_col)"""


def components_sql(name: str, mask: str) -> dict[str, str]:
    """Relations ``{name}_runs``, ``_adj``, ``_reach``, ``_lab`` and the pixel labels ``{name}``."""
    return {
        f"{name}_runs": f"""SELECT image_id, y, min(x) AS x0, max(x) AS x1, CAST(y AS BIGINT) * 16777216 + min(x) AS n
FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM {mask}) t GROUP BY image_id, y, g""",
        f"{name}_down": f"""SELECT a.image_id, a.n AS u, b.n AS v FROM {name}_runs a JOIN {name}_runs b
ON a.image_id = b.image_id AND b.y = a.y + 1 AND b.x0 <= a.x1 + 1 AND b.x1 >= a.x0 - 1""",
        f"{name}_adj": f"SELECT * FROM {name}_down UNION ALL SELECT image_id, v, u FROM {name}_down",
        f"{name}_reach": f"""SELECT image_id, n AS u, n AS v FROM {name}_runs
UNION SELECT r.image_id, r.u, a.v FROM {name}_reach r JOIN {name}_adj a ON a.image_id = r.image_id AND a.u = r.v""",
        f"{name}_lab": f"SELECT image_id, u AS n, min(v) AS component FROM {name}_reach GROUP BY image_id, u",
        name: f"""SELECT r.image_id, r.y, CAST(q.x AS INT) AS x, l.component FROM {name}_runs r
JOIN {name}_lab l ON l.image_id = r.image_id AND l.n = r.n, UNNEST(range(r.x0, r.x1 + 1)) AS q(x)""",
    }


def clusters_sql(name: str, radius: str) -> dict[str, str]:
    return {
        f"{name}_near": f"""SELECT a.image_id, a.end_id AS u, b.end_id AS v FROM ends a JOIN ends b
ON a.image_id = b.image_id AND {radius} > 0 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {radius} * {radius}""",
        f"{name}_reach": f"""SELECT image_id, end_id AS u, end_id AS v FROM ends
UNION SELECT r.image_id, r.u, p.v FROM {name}_reach r JOIN {name}_near p ON p.image_id = r.image_id AND p.u = r.v""",
        f"{name}": f"""SELECT e.image_id, e.chord_id, e.end_id, e.x, e.y, r.root FROM ends e
JOIN (SELECT image_id, u, min(v) AS root FROM {name}_reach GROUP BY image_id, u) r ON r.image_id = e.image_id AND r.u = e.end_id""",
    }


def edges_sql(clusters: str) -> str:
    return f"""SELECT DISTINCT image_id, u, v FROM (SELECT image_id, chord_id, min(root) AS u, max(root) AS v
FROM {clusters} GROUP BY image_id, chord_id) WHERE u < v"""


_w = "[" + ", ".join(repr(v) for v in WEIGHTS) + "]"

RELATIONS: dict[str, str] = {
    **duck_texts(),
    "chords": """SELECT a.image_id, a.ann_id AS chord_id, a.x1, a.y1, a.x2, a.y2, a.v1, a.v2, i.split
FROM annotations a JOIN images i USING (image_id)
WHERE a.category_id = 1 AND a.n_kps >= 6 AND a.v1 >= 1 AND a.v2 >= 1""",
    "segs": segments_sql("chords"),
    "mask": raster_sql("segs", 4),
    "centreline": raster_sql("segs", 1),
    "scored": """SELECT p.image_id, p.y, p.x, p.logit + CASE WHEN s.x IS NOT NULL THEN 4.0 ELSE -3.0 END AS logit,
       CASE WHEN m.x IS NOT NULL THEN 1 ELSE 0 END AS target
FROM pixels p LEFT JOIN mask m ON m.image_id = p.image_id AND m.y = p.y AND m.x = p.x
LEFT JOIN mask s ON s.image_id = p.image_id AND s.y = p.y AND s.x = p.x - 1""",
    "pred": "SELECT image_id, y, x FROM scored WHERE logit >= 0",
    "tiles": """SELECT DISTINCT i.image_id, least(a.k * 24, greatest(0, i.height - 32)) AS tile_row,
       least(b.k * 24, greatest(0, i.width - 32)) AS tile_col
FROM images i, UNNEST(range(0, greatest(1, CAST(ceil(greatest(i.height - 32, 0) / 24) AS BIGINT) + 1))) AS a(k),
     UNNEST(range(0, greatest(1, CAST(ceil(greatest(i.width - 32, 0) / 24) AS BIGINT) + 1))) AS b(k)""",
    "tile_scores": """SELECT s.image_id, s.y, s.x, s.target, t.tile_row, t.tile_col,
       s.logit + ((t.tile_row + t.tile_col) % 3) / 4 AS logit
FROM scored s JOIN tiles t ON t.image_id = s.image_id AND s.y >= t.tile_row AND s.y < t.tile_row + 32
 AND s.x >= t.tile_col AND s.x < t.tile_col + 32""",
    **thin_sql("thinned", """SELECT t.image_id, t.tile_row, t.tile_col, m.y - t.tile_row AS ly, m.x - t.tile_col AS lx, m.kind
FROM (SELECT image_id, y, x, 0 AS kind FROM mask UNION ALL SELECT image_id, y, x, 1 FROM pred) m JOIN tiles t
  ON t.image_id = m.image_id AND m.y >= t.tile_row AND m.y < t.tile_row + 32 AND m.x >= t.tile_col AND m.x < t.tile_col + 32"""),
    "thin_counts": tile_counts_sql("thinned"),
    **image_thin_sql("lean", "SELECT image_id, y, x, 0 AS kind FROM mask UNION ALL SELECT image_id, y, x, 1 FROM pred"),
    **thin_sql("thinner", """SELECT image_id, tile_row, tile_col, y - tile_row AS ly, x - tile_col AS lx, kind FROM tile_scores,
  UNNEST([0, 1]) AS u(kind) WHERE CASE WHEN kind = 0 THEN target = 1 ELSE logit >= 0 END"""),
    "thinner_counts": tile_counts_sql("thinner"),
    "ends": """SELECT image_id, chord_id, chord_id * 2 AS end_id, x1 AS x, y1 AS y FROM chords
UNION ALL SELECT image_id, chord_id, chord_id * 2 + 1, x2, y2 FROM chords""",
    **clusters_sql("clusters", "10.0"),
    "vertices": "SELECT image_id, root, avg(x) AS x, avg(y) AS y, count(*) AS n_ends FROM clusters GROUP BY image_id, root",
    "edges": edges_sql("clusters"),
    "degrees": """SELECT image_id, root, count(*) AS degree FROM (SELECT image_id, u AS root FROM edges
UNION ALL SELECT image_id, v FROM edges) GROUP BY image_id, root""",
    "gt_segs": segments_sql("""(SELECT e.image_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM edges e
JOIN vertices a ON a.image_id = e.image_id AND a.root = e.u JOIN vertices b ON b.image_id = e.image_id AND b.root = e.v)"""),
    "gt_mask": raster_sql("gt_segs", 4),
    # every directed edge, and walks along degree-2 vertices from each of them
    "darts": "SELECT image_id, u AS a, v AS b FROM edges UNION ALL SELECT image_id, v, u FROM edges",
    "walks": """SELECT image_id, a AS fa, b AS fb, a, b, 0 AS seq FROM darts
UNION SELECT w.image_id, w.fa, w.fb, d.a, d.b, w.seq + 1 FROM walks w JOIN degrees g ON g.image_id = w.image_id AND g.root = w.b AND g.degree = 2
JOIN darts d ON d.image_id = w.image_id AND d.a = w.b AND d.b <> w.a WHERE w.b <> w.fa""",
    "walk_ends": """SELECT image_id, fa, fb, arg_max(a, seq) AS la, arg_max(b, seq) AS lb, max(seq) AS steps, min(b) AS low
FROM walks GROUP BY image_id, fa, fb""",
    "chains": """SELECT w.* , (ga.degree = 2) AS pure_cycle FROM walk_ends w
JOIN degrees ga ON ga.image_id = w.image_id AND ga.root = w.fa
LEFT JOIN degrees gb ON gb.image_id = w.image_id AND gb.root = w.lb
WHERE ((ga.degree <> 2 AND gb.degree <> 2) OR (ga.degree = 2 AND w.lb = w.fa AND w.low = w.fa))
  AND (w.fa < w.lb OR (w.fa = w.lb AND w.fb <= w.la))""",
    "boxes_in": """SELECT d.*, i.width, i.height, greatest(0.0, d.x2 - d.x1) AS w, greatest(0.0, d.y2 - d.y1) AS h
FROM detections d JOIN images i USING (image_id)""",
    "inner0": """SELECT *, CAST(greatest(0, least(width, round_even(x1 + w * 0.3, 0))) AS INT) AS ax1,
       CAST(greatest(0, least(height, round_even(y1 + h * 0.3, 0))) AS INT) AS ay1,
       CAST(greatest(0, least(width, round_even(x2 - w * 0.3, 0))) AS INT) AS ax2,
       CAST(greatest(0, least(height, round_even(y2 - h * 0.3, 0))) AS INT) AS ay2,
       CAST(greatest(0, trunc(x1)) AS INT) AS fx1, CAST(greatest(0, trunc(y1)) AS INT) AS fy1,
       CAST(least(width, trunc(x2) + 1) AS INT) AS fx2, CAST(least(height, trunc(y2) + 1) AS INT) AS fy2 FROM boxes_in""",
    "inner_boxes": """SELECT det_id, image_id, collapsed, CASE WHEN collapsed THEN fx1 ELSE ax1 END AS ix1,
       CASE WHEN collapsed THEN fy1 ELSE ay1 END AS iy1, CASE WHEN collapsed THEN fx2 ELSE ax2 END AS ix2,
       CASE WHEN collapsed THEN fy2 ELSE ay2 END AS iy2
FROM (SELECT *, (ax2 <= ax1 OR ay2 <= ay1) AS collapsed FROM inner0 WHERE w > 0 AND h > 0)
WHERE NOT collapsed OR (fx2 > fx1 AND fy2 > fy1)""",
    "lined": "SELECT DISTINCT image_id FROM mask",
    "near": """SELECT d.image_id, d.det_id, CASE WHEN l.image_id IS NULL THEN NULL ELSE coalesce(h.hit, FALSE) END AS near_gt
FROM detections d JOIN images i USING (image_id) LEFT JOIN lined l ON l.image_id = d.image_id
LEFT JOIN (SELECT DISTINCT b.det_id, TRUE AS hit FROM inner_boxes b JOIN mask m ON m.image_id = b.image_id
  AND m.x >= b.ix1 AND m.x < b.ix2 AND m.y >= b.iy1 AND m.y < b.iy2) h ON h.det_id = d.det_id""",
    "labelled": "SELECT s.*, n.near_gt FROM symbols s JOIN near n ON n.det_id = s.crop_id",
    "features": """SELECT * EXCLUDE (e, nrm), list_concat(list_transform(e, lambda v: v / nrm),
  [w, h, ln(w / h), ln(w * h), ln(w) + ln(h)]) AS features
FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda v: v * v))) + 1e-8 AS nrm
FROM (SELECT * EXCLUDE (embedding), CAST(embedding AS DOUBLE[]) AS e, greatest(x2 - x1, 1.0) AS w, greatest(y2 - y1, 1.0) AS h FROM symbols))""",
    "linear": f"""SELECT * EXCLUDE (features), 1.0 / (1.0 + exp(-(list_dot_product(features, CAST({_w} AS DOUBLE[])) + {BIAS}))) AS p FROM features""",
    "grown": dilate_sql("pred", 3),
    **components_sql("pred_comp", "pred"),
    # missed labels: confident pixels away from the labels
    "prob": """SELECT image_id, y, x, avg(1.0 / (1.0 + exp(-logit))) AS p FROM tile_scores GROUP BY image_id, y, x""",
    "gt_far": dilate_sql("shifted_gt", 2),
    "shifted_gt": "SELECT image_id, y, x FROM mask WHERE (y + 3 * image_id) % 40 < 28",
    "unlabelled": """SELECT p.image_id, p.y, p.x, p.p FROM prob p LEFT JOIN gt_far g
ON g.image_id = p.image_id AND g.y = p.y AND g.x = p.x WHERE p.p >= 0.8 AND g.x IS NULL""",
    **components_sql("miss_comp", "unlabelled"),
    "candidates": """SELECT c.image_id, c.component, count(*) AS area, min(c.x) AS x, min(c.y) AS y,
       max(c.x) - min(c.x) + 1 AS w, max(c.y) - min(c.y) + 1 AS h, avg(u.p) AS mean_prob
FROM miss_comp c JOIN unlabelled u ON u.image_id = c.image_id AND u.y = c.y AND u.x = c.x
GROUP BY c.image_id, c.component HAVING count(*) >= 12 AND avg(u.p) >= 0.85""",
    # the symbol filter on the line mask, with one-pixel strokes as the given skeleton
    "fgrown": dilate_sql("mask", 3),
    **components_sql("fcomp", "fgrown"),
    "fpred": "SELECT m.image_id, m.y, m.x, c.component FROM mask m JOIN fcomp c ON c.image_id = m.image_id AND c.y = m.y AND c.x = m.x",
    "fskel": """SELECT s.image_id, s.y, s.x, c.component, (SELECT count(*) FROM centreline n WHERE n.image_id = s.image_id
  AND n.y BETWEEN s.y - 1 AND s.y + 1 AND n.x BETWEEN s.x - 1 AND s.x + 1) - 1 AS degree
FROM centreline s JOIN fcomp c ON c.image_id = s.image_id AND c.y = s.y AND c.x = s.x""",
    "fstat": """SELECT image_id, component, count(*) AS n, count(*) FILTER (degree = 1) AS n_ends, sum(y) / count(*) AS cy, sum(x) / count(*) AS cx
FROM fskel GROUP BY image_id, component""",
    "ffar1": """SELECT image_id, component, y, x FROM (SELECT s.*, row_number() OVER (PARTITION BY s.image_id, s.component
  ORDER BY (s.y - t.cy) * (s.y - t.cy) + (s.x - t.cx) * (s.x - t.cx) DESC, s.y, s.x) AS k
  FROM fskel s JOIN fstat t USING (image_id, component) WHERE t.n_ends = 0 AND t.n > 2) WHERE k = 1""",
    "ffar2": """SELECT image_id, component, y, x FROM (SELECT s.*, row_number() OVER (PARTITION BY s.image_id, s.component
  ORDER BY (s.y - t.y) * (s.y - t.y) + (s.x - t.x) * (s.x - t.x) DESC, s.y, s.x) AS k
  FROM fskel s JOIN ffar1 t USING (image_id, component)) WHERE k = 1""",
    "fends": """SELECT image_id, component, y, x FROM fskel WHERE degree = 1
UNION ALL SELECT s.image_id, s.component, s.y, s.x FROM fskel s JOIN fstat t USING (image_id, component) WHERE t.n_ends = 0 AND t.n <= 2
UNION ALL SELECT * FROM ffar1 UNION ALL SELECT * FROM ffar2""",
    "fends_p": """SELECT e.image_id, e.component, e.y, e.x, max(s.p) AS max_p FROM fends e
LEFT JOIN (SELECT image_id, (x1 + x2) * 0.5 AS sx, (y1 + y2) * 0.5 AS sy, p FROM linear) s
ON s.image_id = e.image_id AND (s.sx - e.x) * (s.sx - e.x) + (s.sy - e.y) * (s.sy - e.y) <= 625.0
GROUP BY e.image_id, e.component, e.y, e.x""",
    "fdec": """SELECT image_id, component, n_pixels, n_endpoints, skel_len,
  CASE WHEN starts_with(reason, 'callout_endpoint_short') THEN 'drop' ELSE 'keep' END AS fate, reason FROM (
  SELECT *, CASE WHEN n_endpoints = 0 THEN 'no_endpoints' WHEN any_high THEN 'irrigation_endpoint'
    WHEN any_low AND skel_len >= 30 THEN 'callout_endpoint_but_long_skel' WHEN any_low THEN 'callout_endpoint_short_skel'
    ELSE 'no_strong_signal' END AS reason FROM (
  SELECT a.image_id, a.component, a.n_pixels, coalesce(l.skel_len, 0) AS skel_len, coalesce(e.n_endpoints, 0) AS n_endpoints,
    coalesce(e.any_high, FALSE) AS any_high, coalesce(e.any_low, FALSE) AS any_low
  FROM (SELECT image_id, component, count(*) AS n_pixels FROM fcomp GROUP BY image_id, component) a
  SEMI JOIN fpred p ON p.image_id = a.image_id AND p.component = a.component
  LEFT JOIN (SELECT image_id, component, count(*) AS skel_len FROM fskel GROUP BY image_id, component) l ON l.image_id = a.image_id AND l.component = a.component
  LEFT JOIN (SELECT image_id, component, count(*) AS n_endpoints, bool_or(max_p >= 0.85) AS any_high, bool_or(max_p <= 0.15) AS any_low
    FROM fends_p GROUP BY image_id, component) e ON e.image_id = a.image_id AND e.component = a.component))""",
    "ffilt": """SELECT p.image_id, p.y, p.x FROM fpred p ANTI JOIN (SELECT * FROM fdec WHERE fate = 'drop') d
ON d.image_id = p.image_id AND d.component = p.component""",
    "freport": """SELECT i.image_id, coalesce(t.n, 0) AS n_components, coalesce(d.n, 0) AS n_dropped, coalesce(x.n, 0) AS pixels_dropped
FROM images i LEFT JOIN (SELECT image_id, count(DISTINCT component) AS n FROM fcomp GROUP BY image_id) t USING (image_id)
LEFT JOIN (SELECT image_id, count(*) AS n FROM fdec WHERE fate = 'drop' GROUP BY image_id) d USING (image_id)
LEFT JOIN (SELECT p.image_id, count(*) AS n FROM fpred p JOIN fdec q ON q.image_id = p.image_id AND q.component = p.component
  WHERE q.fate = 'drop' GROUP BY p.image_id) x USING (image_id)""",
}

_WORD = re.compile(r"[a-z_][a-z0-9_]*")


def filter_of_predictions() -> dict[str, str]:
    """The symbol filter's relations (f...) once more for the predicted mask (e...), with thinned skeletons and its own limits."""
    names = {n: f"e{n[1:]}" for n in RELATIONS if n.startswith(("fgrown", "fcomp", "fpred", "fskel", "fstat", "ffar", "fends", "fdec", "ffilt", "freport"))}
    words = {**names, "mask": "pred", "centreline": "lean_pred"}
    texts = {}
    for old, new in names.items():
        text = _WORD.sub(lambda m: words.get(m.group(), m.group()), RELATIONS[old])
        texts[new] = text.replace("skel_len >= 30", "skel_len >= 150").replace("max_p <= 0.15", "max_p <= 0.05")
    return {
        "lean_pred": "SELECT image_id, y, x FROM lean WHERE kind = 1", **texts, **image_thin_sql("leaner", "SELECT image_id, y, x, 0 AS kind FROM efilt"),
    }


RELATIONS |= filter_of_predictions()


def with_relations(body: str) -> str:
    """Prefix ``body`` with the relations it uses, dependencies first."""
    order: list[str] = []
    entered: set[str] = set()

    def visit(text: str) -> None:
        for word in _WORD.findall(text):
            if word in RELATIONS and word not in entered:
                entered.add(word)
                visit(RELATIONS[word])
                order.append(word)

    visit(body)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({RELATIONS[n]})" for n in order)
    own = body.strip()
    if own.upper().startswith("WITH "):
        return f"WITH RECURSIVE {ctes},\n{own[5:]}"
    return f"WITH RECURSIVE {ctes}\n{own}"
