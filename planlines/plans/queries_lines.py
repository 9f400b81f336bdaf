"""Queries over annotations, detections, boxes and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlines.functions import geometry as G
from planlines.operators import boxes as B
from planlines.operators import lines as L
from planlines.operators import ranking as K
from planlines.operators import raster as R
from planlines.operators import symbols as Y
from planlines.plans.inputs import RADIUS, STRIDE, TILE, Inputs
from planlines.plans.registry import query
from planlines.session import scratch_path, stage
from planlines.sources import annotations as A
from planlines.sources import export_ranges as D
from planlines.sources import rasters as P
from planlines.sources import symbol_cache as C


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- annotation exports and chords ------------------------------------------

KEYPOINTS = """CASE WHEN n_kps >= 6 THEN array(x1, y1, cast(v1 as double), x2, y2, cast(v2 as double))
                      ELSE array(x1, y1, cast(v1 as double)) END"""


@query("coco_scan", """
SELECT i.split, a.image_id, a.ann_id, a.category_id, CAST(CASE WHEN a.n_kps >= 6 THEN 6 ELSE 3 END AS INT) AS n_kps,
       a.x1, a.y1, CASE WHEN a.n_kps >= 6 THEN a.x2 END AS x2, CASE WHEN a.n_kps >= 6 THEN a.y2 END AS y2,
       i.file_name, i.width, i.height
FROM annotations a JOIN images i USING (image_id)""")
def coco_scan(q: Inputs):
    """Export documents written per split, scanned back and flattened."""
    path = scratch_path(q.spark, "export")
    ann = q.annotations.join(q.images.select("image_id", "split"), "image_id").withColumn("keypoints", F.expr(KEYPOINTS))
    A.write_export(q.images, ann, path)
    images, annotations = A.read_export(q.spark, path, "*/*.json")
    flat = A.flatten_keypoints(annotations).drop("v1", "v2", "split")
    return flat.join(images, "image_id")


@query("coco_document_scan", """
SELECT i.split, a.image_id, a.ann_id, a.category_id, CAST(CASE WHEN a.n_kps >= 6 THEN 6 ELSE 3 END AS INT) AS n_kps,
       a.x1, a.y1, CASE WHEN a.n_kps >= 6 THEN a.x2 END AS x2, CASE WHEN a.n_kps >= 6 THEN a.y2 END AS y2,
       i.file_name, i.width, i.height
FROM annotations a JOIN images i USING (image_id)""")
def coco_document_scan(q: Inputs):
    """One export document for each split, under its own name, read in byte ranges by several tasks."""
    root = scratch_path(q.spark, "exports")
    ann = q.annotations.join(q.images.select("image_id", "split"), "image_id").withColumn("keypoints", F.expr(KEYPOINTS))
    D.write_documents(q.images, ann, root)
    images, annotations = D.read_documents(q.spark, root, range_bytes=8 << 10)
    return A.flatten_keypoints(annotations).drop("v1", "v2", "split").join(images, "image_id")


@query("chords", "SELECT image_id, chord_id, x1, y1, x2, y2, v1, v2, split FROM chords")
def chords(q: Inputs):
    return q.chords


@query("split_filter", "SELECT image_id, split, file_name, width, height FROM images WHERE split IN ('train', 'valid')")
def split_filter(q: Inputs):
    """Split selection on a partitioned table; an unknown split selects nothing."""
    path = scratch_path(q.spark, "images")
    q.images.write.partitionBy("split").parquet(path)
    return q.spark.read.parquet(path).filter(F.col("split").isin("train", "valid", "holdout"))


@query("split_summary", """
SELECT i.split, count(*) AS n_images, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS n_chords,
       min(coalesce(c.n, 0)) AS min_chords, max(coalesce(c.n, 0)) AS max_chords, median(coalesce(c.n, 0)) AS median_chords,
       min(width) AS min_width, max(width) AS max_width, min(height) AS min_height, max(height) AS max_height
FROM images i LEFT JOIN (SELECT image_id, count(*) AS n FROM chords GROUP BY image_id) c USING (image_id) GROUP BY i.split""")
def split_summary(q: Inputs):
    return A.split_summary(q.images, q.chords)


@query("union_splits", "SELECT image_id, split, file_name FROM images WHERE split IN ('train', 'test')")
def union_splits(q: Inputs):
    cols = ["image_id", "split", "file_name"]
    return q.images.filter("split = 'train'").select(*cols).unionByName(q.images.filter("split = 'test'").select(*cols))


@query("first_n_images", """
SELECT split, image_id, rank FROM (SELECT split, image_id, row_number() OVER (PARTITION BY split ORDER BY image_id) AS rank
FROM images) WHERE rank <= 5""")
def first_n_images(q: Inputs):
    return K.top_n(q.images.select("split", "image_id"), ["split"], [F.col("image_id")], 5)


@query("missing_images", "SELECT image_id, split, file_name FROM images WHERE image_id % 7 = 2")
def missing_images(q: Inputs):
    """Image rows whose file is absent from the listing of the split folders, which tasks list."""
    path = scratch_path(q.spark, "files")
    there = q.images.filter("image_id % 7 <> 2")
    P.write_files(there.select(F.concat_ws("/", "split", "file_name").alias("name"), F.lit("x").cast("binary").alias("content")), path)
    return P.missing(q.images.select("image_id", "split", "file_name"), P.walk_files(q.spark, path))


# --- lines ------------------------------------------------------------------


@query("endpoint_pairs", """
WITH loc AS (SELECT image_id, x, y, min(end_id) AS loc_id, count(*) AS n FROM ends GROUP BY image_id, x, y)
SELECT a.image_id, a.loc_id AS loc_a, b.loc_id AS loc_b, a.n AS n_a, b.n AS n_b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
FROM loc a JOIN loc b ON a.image_id = b.image_id AND a.loc_id < b.loc_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100.0""")
def endpoint_pairs(q: Inputs):
    return L.endpoint_pairs(q.ends, RADIUS).select("image_id", "loc_a", "loc_b", "n_a", "n_b", "d2")


@query("endpoint_clusters", "SELECT image_id, end_id, root FROM clusters")
def endpoint_clusters(q: Inputs):
    return q.clusters.select("image_id", "end_id", "root")


@query("merged_vertices", "SELECT image_id, root, round(x, 6) AS x, round(y, 6) AS y, n_ends FROM vertices")
def merged_vertices(q: Inputs):
    return L.merged_vertices(q.clusters).select("image_id", "root", r6("x").alias("x"), r6("y").alias("y"), "n_ends")


@query("merged_edges", "SELECT image_id, u, v FROM edges")
def merged_edges(q: Inputs):
    return L.merged_edges(q.clusters)


@query("vertex_degree", "SELECT image_id, root, degree, degree <> 2 AS topology FROM degrees")
def vertex_degree(q: Inputs):
    return L.vertex_degree(L.merged_edges(q.clusters))


POLYLINES_SQL = """
SELECT c.image_id, c.fa AS chain_a, c.fb AS chain_b, CAST(c.steps + 2 AS BIGINT) AS n_points, round(sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS length,
       c.fa = c.lb AS closed, c.pure_cycle
FROM chains c JOIN walks w ON w.image_id = c.image_id AND w.fa = c.fa AND w.fb = c.fb
JOIN vertices a ON a.image_id = w.image_id AND a.root = w.a JOIN vertices b ON b.image_id = w.image_id AND b.root = w.b
{where} GROUP BY c.image_id, c.fa, c.fb, c.steps, c.lb, c.pure_cycle"""


def _polyline_summary(q: Inputs):
    clusters = stage(q.clusters, "clusters")
    edges = L.polyline_edges(L.merged_edges(clusters))
    return L.polyline_summary(edges, L.merged_vertices(clusters)).withColumn("length", r6("length"))


@query("polylines", POLYLINES_SQL.format(where=""))
def polylines(q: Inputs):
    return _polyline_summary(q)


@query("pure_cycles", """
WITH r AS (SELECT image_id, CAST(3 + image_id % 5 AS BIGINT) AS n FROM images WHERE image_id % 2 = 0),
e AS (SELECT image_id, n, i, (i + 1) % n AS j FROM (SELECT *, UNNEST(range(0, n)) AS i FROM r))
SELECT image_id, 0::BIGINT AS chain_a, 1::BIGINT AS chain_b, n + 1 AS n_points,
  round(sum(sqrt((i * i % 11 - j * j % 11) ** 2 + (i * 7 % 5 - j * 7 % 5) ** 2)), 6) AS length, true AS closed, true AS pure_cycle
FROM e GROUP BY image_id, n""")
def pure_cycles(q: Inputs):
    """Rings and open chains of three to seven vertices, one for each image; the rings are reported."""
    n = F.col("n")
    shapes = q.images.select("image_id", (3 + F.col("image_id") % 5).cast("long").alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    vertices = shapes.select("image_id", F.col("i").alias("root"), (F.col("i") * F.col("i") % 11).cast("double").alias("x"), (F.col("i") * 7 % 5).cast("double").alias("y"))
    links = shapes.filter("image_id % 2 = 0 or i < n - 1").withColumn("j", (F.col("i") + 1) % n)
    edges = links.select("image_id", F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"))
    return L.polyline_summary(L.polyline_edges(edges), vertices).filter("pure_cycle").withColumn("length", r6("length"))


@query("radius_sweep", """
WITH radii AS (SELECT UNNEST([0.0, 5.0, 10.0, 20.0, 40.0]::DOUBLE[]) AS radius),
rnear AS (SELECT r.radius, a.image_id, a.end_id AS u, b.end_id AS v FROM radii r, ends a JOIN ends b ON a.image_id = b.image_id
  WHERE r.radius > 0 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= r.radius * r.radius),
rreach AS (SELECT r.radius, image_id, end_id AS u, end_id AS v FROM radii r, ends
  UNION SELECT r.radius, r.image_id, r.u, p.v FROM rreach r JOIN rnear p ON p.radius = r.radius AND p.image_id = r.image_id AND p.u = r.v),
cl AS (SELECT e.image_id, e.chord_id, r.radius, min(r.v) AS root FROM ends e JOIN rreach r ON r.image_id = e.image_id AND r.u = e.end_id
  GROUP BY e.image_id, e.chord_id, e.end_id, r.radius),
ed AS (SELECT DISTINCT radius, image_id, u, v FROM (SELECT radius, image_id, chord_id, min(root) AS u, max(root) AS v FROM cl GROUP BY radius, image_id, chord_id) WHERE u < v),
vx AS (SELECT radius, image_id, count(DISTINCT root) AS n_vertices FROM cl GROUP BY radius, image_id),
eg AS (SELECT radius, image_id, count(*) AS n_edges FROM ed GROUP BY radius, image_id),
dg AS (SELECT radius, image_id, root, count(*) AS degree FROM (SELECT radius, image_id, u AS root FROM ed UNION ALL SELECT radius, image_id, v FROM ed) GROUP BY radius, image_id, root),
tp AS (SELECT radius, image_id, CAST(sum(degree) FILTER (degree <> 2) AS BIGINT) AS open_ends FROM dg GROUP BY radius, image_id)
SELECT v.radius, v.image_id, v.n_vertices, coalesce(e.n_edges, 0) AS n_edges, coalesce(t.open_ends, 0) // 2 AS n_open_polylines
FROM vx v LEFT JOIN eg e USING (radius, image_id) LEFT JOIN tp t USING (radius, image_id)""")
def radius_sweep(q: Inputs):
    """Merging at several radii in one pass: the radius is one more group key.

    Every polyline that is not a pure cycle has two ends at topology vertices, so
    half the degree total of those vertices counts them.
    """
    radii = F.array(*[F.lit(r) for r in (0.0, 5.0, 10.0, 20.0, 40.0)])
    keys = ["image_id", "radius"]
    ends = q.ends.select("*", F.explode(radii).alias("radius"))
    clusters = stage(L.endpoint_clusters(ends, "radius", keys), "clusters")
    edges = stage(L.merged_edges(clusters, keys), "links")
    vertices = clusters.select(*keys, "root").distinct().groupBy(*keys).agg(F.count("*").alias("n_vertices"))
    n_edges = edges.groupBy(*keys).agg(F.count("*").alias("n_edges"))
    ends_of = L.vertex_degree(edges, keys).filter("topology").groupBy(*keys).agg(F.sum("degree").alias("open_ends"))
    joined = vertices.join(n_edges, keys, "left").join(ends_of, keys, "left").na.fill(0)
    return joined.select("radius", "image_id", "n_vertices", "n_edges", F.expr("open_ends div 2").alias("n_open_polylines"))


@query("radius_sweep_loops", """
WITH radii AS (SELECT UNNEST([0.0, 5.0, 10.0, 20.0, 40.0]::DOUBLE[]) AS radius),
rnear AS (SELECT r.radius, a.image_id, a.end_id AS u, b.end_id AS v FROM radii r, ends a JOIN ends b ON a.image_id = b.image_id
  WHERE r.radius > 0 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= r.radius * r.radius),
rreach AS (SELECT r.radius, image_id, end_id AS u, end_id AS v FROM radii r, ends
  UNION SELECT r.radius, r.image_id, r.u, p.v FROM rreach r JOIN rnear p ON p.radius = r.radius AND p.image_id = r.image_id AND p.u = r.v),
cl AS (SELECT e.image_id, e.chord_id, r.radius, min(r.v) AS root FROM ends e JOIN rreach r ON r.image_id = e.image_id AND r.u = e.end_id
  GROUP BY e.image_id, e.chord_id, e.end_id, r.radius),
ed AS (SELECT DISTINCT radius, image_id, u, v FROM (SELECT radius, image_id, chord_id, min(root) AS u, max(root) AS v FROM cl GROUP BY radius, image_id, chord_id) WHERE u < v),
sd AS (SELECT radius, image_id, u AS a, v AS b FROM ed UNION ALL SELECT radius, image_id, v, u FROM ed),
dg AS (SELECT radius, image_id, a AS root, count(*) AS degree FROM sd GROUP BY radius, image_id, a),
cr AS (SELECT radius, image_id, root AS u, root AS v FROM dg UNION SELECT c.radius, c.image_id, c.u, s.b FROM cr c JOIN sd s ON s.radius = c.radius AND s.image_id = c.image_id AND s.a = c.v),
cc AS (SELECT radius, image_id, u AS root, min(v) AS comp FROM cr GROUP BY radius, image_id, u),
lp AS (SELECT radius, image_id, count(*) AS n FROM (SELECT radius, image_id, comp FROM cc JOIN dg USING (radius, image_id, root) GROUP BY radius, image_id, comp HAVING bool_and(degree = 2)) GROUP BY radius, image_id),
op AS (SELECT radius, image_id, CAST(sum(degree) FILTER (degree <> 2) AS BIGINT) // 2 AS n FROM dg GROUP BY radius, image_id),
al AS (SELECT DISTINCT radius, image_id FROM cl)
SELECT radius, image_id, coalesce(op.n, 0) AS n_open, coalesce(lp.n, 0) AS n_loops, coalesce(op.n, 0) + coalesce(lp.n, 0) AS n_polylines
FROM al LEFT JOIN op USING (radius, image_id) LEFT JOIN lp USING (radius, image_id)""")
def radius_sweep_loops(q: Inputs):
    """All polylines by merge radius, pure loops with them, without walking any chain."""
    radii = F.array(*[F.lit(r) for r in (0.0, 5.0, 10.0, 20.0, 40.0)])
    keys = ["image_id", "radius"]
    clusters = stage(L.endpoint_clusters(q.ends.select("*", F.explode(radii).alias("radius")), "radius", keys), "clusters")
    counts = L.polyline_counts(L.merged_edges(clusters, keys), keys)
    return clusters.select(*keys).distinct().join(counts, keys, "left").na.fill(0).select("radius", "image_id", "n_open", "n_loops", "n_polylines")


@query("polyline_sizes", f"""
WITH summary AS ({POLYLINES_SQL.format(where="").strip().replace("WITH ", "WITH RECURSIVE ", 1)})
SELECT image_id, count(*) AS n_polylines, min(n_points) AS min_points, round(median(n_points), 6) AS median_points, max(n_points) AS max_points FROM summary GROUP BY image_id""")
def polyline_sizes(q: Inputs):
    """Points per polyline of each image."""
    return L.polyline_sizes(_polyline_summary(q)).withColumn("median_points", r6("median_points"))


# --- detections -------------------------------------------------------------

RAW_SQL = """
SELECT det_id, image_id, concat('{',
  CASE det_id % 6 WHEN 0 THEN concat('"ID": ', CAST(det_id AS STRING)) WHEN 1 THEN concat('"id": "", "crop_id": "c', CAST(det_id AS STRING), '"')
       WHEN 2 THEN '"other": 1' ELSE concat('"id": "c', CAST(det_id AS STRING), '"') END,
  ', "x1": ', CASE WHEN det_id % 31 = 4 THEN '"left"' ELSE CAST(x1 AS STRING) END, ', "y1": ', CAST(y1 AS STRING),
  ', "x2": "', CAST(x2 AS STRING), '", "y2": ', CAST(y2 AS STRING),
  CASE WHEN det_id % 5 = 0 THEN '' WHEN conf IS NULL THEN ', "conf": null' WHEN det_id % 5 = 1 THEN concat(', "confidence": ', CAST(conf AS STRING))
       ELSE concat(', "conf": ', CAST(conf AS STRING)) END,
  CASE det_id % 4 WHEN 0 THEN ', "class_id": 3, "class_name": "valve"' WHEN 1 THEN ', "class": 2, "label": "pipe"'
       WHEN 2 THEN ', "class_name": "", "name": "tee"' ELSE '' END, '}') AS record
FROM {detections}"""


def raw_detections(q: Inputs):
    q.detections.createOrReplaceTempView("planlines_detections")
    return q.spark.sql(RAW_SQL.replace("{detections}", "planlines_detections"))


@query("normalize_detections", """
WITH raw AS (SELECT * FROM (""" + RAW_SQL.replace("{detections}", "detections") + """))
SELECT * FROM (SELECT det_id, coalesce(nullif(record->>'$.id', ''), nullif(record->>'$.ID', ''), nullif(record->>'$.crop_id', '')) AS crop_id,
  TRY_CAST(record->>'$.x1' AS DOUBLE) AS x1, TRY_CAST(record->>'$.y1' AS DOUBLE) AS y1, TRY_CAST(record->>'$.x2' AS DOUBLE) AS x2, TRY_CAST(record->>'$.y2' AS DOUBLE) AS y2,
  coalesce(nullif(TRY_CAST(CASE WHEN json_exists(record, '$.conf') THEN record->>'$.conf' ELSE record->>'$.confidence' END AS DOUBLE), 0.0), 1.0) AS confidence,
  coalesce(TRY_CAST(CASE WHEN json_exists(record, '$.class_id') THEN record->>'$.class_id' ELSE record->>'$.class' END AS INT), 0) AS class_id,
  coalesce(nullif(record->>'$.class_name', ''), nullif(record->>'$.label', ''), nullif(record->>'$.name', ''), 'symbol') AS class_name
FROM raw) WHERE crop_id IS NOT NULL AND x2 > x1 AND y2 > y1""")
def normalize_detections(q: Inputs):
    return B.normalize_detections(raw_detections(q), keep=["det_id"])


@query("conf_rank", """
SELECT image_id, det_id, coalesce(conf, 0.0) AS score, row_number() OVER (PARTITION BY image_id ORDER BY coalesce(conf, 0.0) DESC, det_id) AS rank
FROM detections""")
def conf_rank(q: Inputs):
    return B.conf_rank(q.detections, ["image_id"], "det_id").select("image_id", "det_id", "score", "rank")


@query("id_batches", """
SELECT image_id, batch, count(*) AS n, string_agg(CAST(det_id AS VARCHAR), ',' ORDER BY det_id) AS ids
FROM (SELECT image_id, det_id, CAST((row_number() OVER (PARTITION BY image_id ORDER BY det_id) - 1) // 8 AS INT) AS batch FROM detections)
GROUP BY image_id, batch""")
def id_batches(q: Inputs):
    return B.id_batches(q.detections, ["image_id"], "det_id", 8)


IOU_CTES = """
WITH bx AS (SELECT image_id, x1, y1, x2, y2, min(det_id) AS box, count(*) AS n FROM detections WHERE x2 > x1 AND y2 > y1 GROUP BY ALL),
pr AS (SELECT a.image_id, a.box AS box_a, b.box AS box_b, a.n AS n_a, b.n AS n_b,
  (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter,
  (a.x2 - a.x1) * (a.y2 - a.y1) AS area_a, (b.x2 - b.x1) * (b.y2 - b.y1) AS area_b
  FROM bx a JOIN bx b ON a.image_id = b.image_id AND a.box < b.box AND greatest(a.x1, b.x1) < least(a.x2, b.x2) AND greatest(a.y1, b.y1) < least(a.y2, b.y2))"""


@query("box_iou_pairs", IOU_CTES + " SELECT image_id, box_a, box_b, n_a, n_b, round(inter / (area_a + area_b - inter), 6) AS iou FROM pr")
def box_iou_pairs(q: Inputs):
    pairs = B.iou_pairs(q.detections, ["image_id"], "det_id")
    return pairs.select("image_id", "box_a", "box_b", "n_a", "n_b", r6("iou").alias("iou"))


@query("nms", """
WITH d AS (SELECT *, coalesce(conf, 0.0) AS score, row_number() OVER (PARTITION BY image_id ORDER BY coalesce(conf, 0.0) DESC, det_id) AS rk
  FROM detections WHERE coalesce(conf, 0.0) >= 0.3),
hit AS (SELECT image_id, ra, rb FROM (SELECT a.image_id, a.rk AS ra, b.rk AS rb,
  greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas FROM d a JOIN d b ON a.image_id = b.image_id AND a.rk < b.rk)
  WHERE inter > 0 AND inter / (areas - inter) >= 0.5),
adj AS (SELECT image_id, rb AS rk, list(ra) AS better FROM hit GROUP BY image_id, rb),
walk AS (SELECT image_id, 0 AS rk, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT image_id FROM d)
  UNION ALL SELECT w.image_id, w.rk + 1, CASE WHEN list_has_any(w.kept, coalesce(a.better, CAST([] AS BIGINT[]))) THEN w.kept ELSE list_append(w.kept, w.rk + 1) END
  FROM walk w JOIN d ON d.image_id = w.image_id AND d.rk = w.rk + 1 LEFT JOIN adj a ON a.image_id = w.image_id AND a.rk = w.rk + 1)
SELECT d.image_id, d.det_id FROM d JOIN (SELECT image_id, arg_max(kept, rk) AS kept FROM walk GROUP BY image_id) w
ON w.image_id = d.image_id AND list_contains(w.kept, d.rk)""")
def nms(q: Inputs):
    return B.nms(q.detections, ["image_id"], "det_id", 0.5, 0.3).select("image_id", "det_id")


@query("crop_window", """
SELECT det_id, CAST(greatest(0, trunc(x1) - 4) AS INT) AS wx1, CAST(greatest(0, trunc(y1) - 4) AS INT) AS wy1,
       CAST(least(width, trunc(x2) + 4) AS INT) AS wx2, CAST(least(height, trunc(y2) + 4) AS INT) AS wy2 FROM boxes_in""")
def crop_window(q: Inputs):
    sized = q.detections.join(q.images.select("image_id", "width", "height"), "image_id")
    edges = [F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")]
    return B.crop_window(sized, 4, *edges).select("det_id", "wx1", "wy1", "wx2", "wy2")


@query("inner_box", "SELECT det_id, image_id, ix1, iy1, ix2, iy2, collapsed FROM inner_boxes")
def inner_box(q: Inputs):
    sized = q.detections.join(q.images.select("image_id", "width", "height"), "image_id")
    box = G.inner_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.col("width"), F.col("height"), 0.3)
    return sized.select("det_id", "image_id", box.alias("i")).filter("i is not null").select("det_id", "image_id", "i.*")


@query("near_line", "SELECT image_id, det_id, near_gt FROM near")
def near_line(q: Inputs):
    return Y.near_line(q.detections, q.images, q.runs, "det_id").select("image_id", "det_id", "near_gt")


@query("near_line_v1", """
SELECT d.image_id, d.det_id, CASE WHEN l.image_id IS NULL THEN NULL ELSE coalesce(h.hit, FALSE) END AS near_gt
FROM detections d JOIN images i USING (image_id) LEFT JOIN lined l ON l.image_id = d.image_id
LEFT JOIN (SELECT DISTINCT b.det_id, TRUE AS hit FROM detections b JOIN mask m ON m.image_id = b.image_id
  AND (m.x - (b.x1 + b.x2) / 2) * (m.x - (b.x1 + b.x2) / 2) + (m.y - (b.y1 + b.y2) / 2) * (m.y - (b.y1 + b.y2) / 2) < 16.0) h ON h.det_id = d.det_id""")
def near_line_v1(q: Inputs):
    return Y.near_line_centre(q.detections, q.images, q.runs, "det_id", 4.0).select("image_id", "det_id", "near_gt")


@query("near_line_v2", """
WITH far AS (SELECT DISTINCT m.image_id, m.y + o.dy AS y, m.x + p.dx AS x FROM mask m, UNNEST(range(-2, 3)) AS o(dy), UNNEST(range(-2, 3)) AS p(dx)
  WHERE (o.dy IN (-2, 2) AND p.dx = 0) OR abs(o.dy) < 2),
hit AS (SELECT DISTINCT b.det_id, TRUE AS hit FROM boxes_in b JOIN far m ON m.image_id = b.image_id AND m.x >= greatest(0, trunc(b.x1)) AND m.x < least(b.width, trunc(b.x2) + 1)
  AND m.y >= greatest(0, trunc(b.y1)) AND m.y < least(b.height, trunc(b.y2) + 1))
SELECT d.image_id, d.det_id, CASE WHEN l.image_id IS NULL THEN NULL ELSE coalesce(h.hit, FALSE) END AS near_gt
FROM detections d JOIN images i USING (image_id) LEFT JOIN lined l ON l.image_id = d.image_id LEFT JOIN hit h ON h.det_id = d.det_id""")
def near_line_v2(q: Inputs):
    return Y.near_line_any(q.detections, q.images, q.runs, "det_id", 2).select("image_id", "det_id", "near_gt")


@query("class_histogram", """
SELECT 'class_' || CAST(label % 4 AS VARCHAR) AS class_name, label AS class_id, count(*) AS n FROM symbols GROUP BY label""")
def class_histogram(q: Inputs):
    named = q.symbols.withColumn("class_name", F.concat(F.lit("class_"), (F.col("label") % 4).cast("string")))
    counts = named.groupBy("class_name", F.col("label").alias("class_id")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "class_id")


@query("conf_summary", """
SELECT count(conf) AS n, round(min(conf), 6) AS min_conf, round(avg(conf), 6) AS mean_conf, round(median(conf), 6) AS median_conf,
       round(max(conf), 6) AS max_conf FROM detections""")
def conf_summary(q: Inputs):
    keyed = q.detections.select(F.lit(0).alias("g"), "conf")
    base = keyed.groupBy("g").agg(F.count("conf").alias("n"), r6(F.min("conf")).alias("min_conf"), r6(F.avg("conf")).alias("mean_conf"),
                                  r6(F.max("conf")).alias("max_conf"))
    med = K.percentiles(keyed, ["g"], "conf", {"median_conf": 0.5})
    return base.join(med, "g").withColumn("median_conf", r6("median_conf")).drop("g")


@query("conf_histogram", """
WITH l AS (SELECT min(conf) AS lo, max(conf) AS hi FROM detections)
SELECT CAST(least(floor((conf - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM detections, l WHERE conf IS NOT NULL GROUP BY ALL""")
def conf_histogram(q: Inputs):
    return K.histogram(q.detections, "conf", 20)


@query("sample_images", """
SELECT image_id, file_name FROM images ORDER BY md5('0:' || CAST(image_id AS VARCHAR)), image_id LIMIT 50""")
def sample_images(q: Inputs):
    """Seeded sample of 50 images, or all when there are fewer."""
    from planlines.operators.models import hash_sample

    return hash_sample(q.images.select("image_id", "file_name"), "image_id", 50)


@query("detection_payload", """
SELECT d.image_id, count(*) AS num_raw_localizations, count(*) FILTER (x2 > x1 AND y2 > y1) AS num_detections,
       '[' || CAST(count(*) FILTER (x2 > x1 AND y2 > y1) AS VARCHAR) || ', 64]' AS embedding_shape
FROM detections d GROUP BY d.image_id""")
def detection_payload(q: Inputs):
    normalized = q.detections.filter("x2 > x1 and y2 > y1")
    embedded = C.attach_embeddings(normalized, q.symbols.select(F.col("crop_id").alias("det_id"), "embedding"), "det_id", strict=True)
    return C.detection_payload(q.detections, normalized, embedded, ["image_id"])


@query("payload_lists", """
SELECT image_id, count(*) OVER w AS num_raw_localizations, count(*) FILTER (ok) OVER w AS num_detections, det_id, x1, y1, x2, y2, conf, 64 AS embedding_dim
FROM (SELECT *, x2 > x1 AND y2 > y1 AS ok FROM detections) WINDOW w AS (PARTITION BY image_id) QUALIFY ok""")
def payload_lists(q: Inputs):
    """Payload records with their lists, written as JSON and read back, one row for each detection."""
    normalized = q.detections.filter("x2 > x1 and y2 > y1")
    embedded = C.attach_embeddings(normalized, q.symbols.select(F.col("crop_id").alias("det_id"), "embedding"), "det_id", strict=True)
    payload = C.detection_payload(q.detections, normalized, embedded, ["image_id"])
    path = scratch_path(q.spark, "payload")
    C.payload_records(payload, normalized, embedded, ["image_id"], "det_id", per_record=7).write.json(path)
    schema = f"image_id long, block long, num_raw_localizations long, num_detections long, detections array<{C.DETECTION}>, classifications array<{C.CLASSIFICATION}>"
    rows = q.spark.read.schema(schema).json(path)
    dims = F.map_from_entries(F.transform("classifications", lambda c: F.struct(c["id"], c["embedding_dim"])))
    out = rows.select("image_id", "num_raw_localizations", "num_detections", F.explode("detections").alias("d"), dims.alias("dims"))
    return out.select("image_id", "num_raw_localizations", "num_detections", F.col("d.id").alias("det_id"), "d.x1", "d.y1", "d.x2", "d.y2", "d.conf",
                      F.element_at("dims", F.col("d.id")).alias("embedding_dim"))


@query("attach_embeddings", """
SELECT det_id, image_id, conf, len(embedding) AS embedding_dim FROM detections d JOIN embeddings e ON e.vec_id = d.det_id""")
def attach_embeddings(q: Inputs):
    """Detections without an embedding of their own id are dropped."""
    emb = q.table("embeddings").select(F.col("vec_id").alias("det_id"), "embedding")
    return C.attach_embeddings(q.detections, emb, "det_id").select("det_id", "image_id", "conf", F.col("embedding_dim").cast("long").alias("embedding_dim"))


# --- tiles ------------------------------------------------------------------


@query("tile_grid", "SELECT image_id, CAST(tile_row AS INT) AS tile_row, CAST(tile_col AS INT) AS tile_col FROM tiles")
def tile_grid(q: Inputs):
    return R.tile_grid(q.images, TILE, STRIDE)


@query("positive_tiles", """
SELECT t.image_id, CAST(t.tile_row AS INT) AS tile_row, CAST(t.tile_col AS INT) AS tile_col FROM tiles t SEMI JOIN mask m
ON m.image_id = t.image_id AND m.y >= t.tile_row AND m.y < t.tile_row + 32 AND m.x >= t.tile_col AND m.x < t.tile_col + 32""")
def positive_tiles(q: Inputs):
    return R.positive_tiles(q.runs, q.images, TILE, STRIDE)
