"""Input relations derived from the base tables, one SQL text for both engines.

Each text uses ``{table}`` for a base table and ``{relation}`` names for other
fixtures. Spark reads the Parquet files directly; DuckDB sees registered views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planlines.session import fanout_partitions

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

IMAGES = """
SELECT s_suppkey AS image_id,
       CASE WHEN s_suppkey % 10 < 7 THEN 'train' WHEN s_suppkey % 10 < 9 THEN 'valid' ELSE 'test' END AS split,
       concat('plan_', CAST(s_suppkey AS STRING), '.rf.jpg') AS file_name,
       CAST(96 + (s_suppkey * 37) % 64 AS INT) AS width,
       CAST(72 + (s_suppkey * 53) % 48 AS INT) AS height
FROM {supplier}
"""

ANNOTATIONS = """
SELECT a.ann_id, CASE WHEN a.ann_id % 101 = 7 THEN a.image_id + 100000 ELSE a.image_id END AS image_id,
       a.category_id, a.n_kps,
       CAST(a.bx + a.step * a.dx AS DOUBLE) AS x1, CAST(a.by_ + a.step * a.dy AS DOUBLE) AS y1, a.v1,
       CAST(a.bx + (a.step + 1) * a.dx + a.jit AS DOUBLE) AS x2,
       CAST(a.by_ + (a.step + 1) * a.dy AS DOUBLE) AS y2, a.v2
FROM (
  SELECT c.c_custkey AS ann_id, c.chain % c.n AS image_id, CAST(c.c_custkey % 5 AS INT) AS step,
         CASE WHEN c.c_custkey % 41 = 0 THEN 2 ELSE 1 END AS category_id,
         CASE WHEN c.c_custkey % 43 = 0 THEN 3 ELSE 6 END AS n_kps,
         CASE WHEN c.c_custkey % 37 = 0 THEN 0 ELSE 2 END AS v1, CAST(1 + c.c_custkey % 2 AS INT) AS v2,
         (c.chain * 7919) % 90 AS bx, (c.chain * 10473) % 70 AS by_,
         6 + c.chain % 7 AS dx, c.chain % 5 - 2 AS dy,
         (c.c_custkey * 31) % 3 - 1 AS jit
  FROM (SELECT c_custkey, CAST(floor(c_custkey / 5) AS BIGINT) AS chain,
               (SELECT count(*) FROM {supplier}) AS n FROM {customer}) c
) a
WHERE a.image_id % 10 <> 3
"""

DETECTIONS = """
SELECT d.det_id, d.image_id,
       CAST(d.ax + d.idx % 3 AS DOUBLE) + d.frac AS x1, CAST(d.ay + d.idx % 3 AS DOUBLE) AS y1,
       CAST(d.ax + d.idx % 3 + d.w AS DOUBLE) + d.frac AS x2, CAST(d.ay + d.idx % 3 + d.h AS DOUBLE) AS y2,
       CASE WHEN d.det_id % 53 = 0 THEN NULL ELSE CAST((d.det_id * 7919) % 1000 AS DOUBLE) / 1000 END AS conf
FROM (
  SELECT q.p_partkey AS det_id, q.p_partkey % q.n AS image_id, q.idx,
         (q.g * 29 + (q.p_partkey % q.n) * 11) % 80 AS ax, (q.g * 17 + (q.p_partkey % q.n) * 7) % 60 AS ay,
         CASE WHEN q.p_partkey % 97 = 0 THEN 0 WHEN q.p_partkey % 23 = 5 THEN 1 ELSE 4 + q.p_size % 20 END AS w,
         CASE WHEN q.p_partkey % 23 = 5 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS frac,
         4 + (q.p_partkey * 3) % 18 AS h
  FROM (SELECT p.p_partkey, p.p_size, p.n, CAST(floor(p.p_partkey / p.n) AS BIGINT) AS idx,
               CAST(floor(floor(p.p_partkey / p.n) / 3) AS BIGINT) AS g
        FROM (SELECT p_partkey, p_size, (SELECT count(*) FROM {supplier}) AS n FROM {part}) p) q
) d
"""

SYMBOLS = """
SELECT d.image_id, d.det_id AS crop_id, d.x1, d.y1, d.x2, d.y2, d.conf, e.embedding, e.label
FROM (SELECT det_id, image_id, x1, y1, x2, y2, conf,
             det_id % (SELECT count(*) FROM {embeddings}) AS vec FROM {detections}) d
JOIN {embeddings} e ON e.vec_id = d.vec
"""

PIXELS = """
SELECT r.image_id, r.y, CAST(x AS INT) AS x,
       CAST((CAST(floor(r.y / 5) AS BIGINT) * 31 + CAST(floor(x / 7) AS BIGINT) * 17 + r.image_id * 13) % 41 - 28 + (r.y * 3 + x) % 5 AS DOUBLE) / 4 AS logit,
       CAST((r.y * 7 + x * 13 + r.image_id) % 256 AS INT) AS r, CAST((r.y * 5 + x * 3) % 256 AS INT) AS g,
       CAST((x * 11) % 256 AS INT) AS b
FROM (SELECT {SPREAD} i.image_id, i.width, CAST(y AS INT) AS y FROM {images} i, {EXP_Y}) r, {EXP_X}
"""

RUN_HISTORY = """
SELECT user_id AS run_id, day AS epoch, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) / count(*) / 600 AS val_dice, min(value) / 600 AS val_iou,
       max(value) / 600 AS val_total
FROM (SELECT user_id, value, CAST(day(ts) AS INT) AS day FROM {events}) t GROUP BY user_id, day
"""

TEXTS = {
    "images": IMAGES,
    "annotations": ANNOTATIONS,
    "detections": DETECTIONS,
    "symbols": SYMBOLS,
    "pixels": PIXELS,
    "run_history": RUN_HISTORY,
}

_SPARK_EXPLODE = {
    "EXP_Y": "LATERAL explode(sequence(0, i.height - 1)) AS ey(y)",
    "EXP_X": "LATERAL explode(sequence(0, r.width - 1)) AS ex(x)",
}
_DUCK_EXPLODE = {
    "EXP_Y": "UNNEST(range(0, i.height)) AS ey(y)",
    "EXP_X": "UNNEST(range(0, r.width)) AS ex(x)",
}


#: Images whose pixels a task holds, about; aggregates by pixel keep a task's pixels in memory.
IMAGES_PER_TASK = 128


def _spark_sql(name: str, sf_dir: str, parts: str) -> str:
    env = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in BASE_TABLES}
    env.update(_SPARK_EXPLODE)
    # Image rows are few and each grows by its area: spread them before the explode.
    env["SPREAD"] = f"/*+ REPARTITION({parts}, image_id, y) */"
    for dep in TEXTS:
        if "{" + dep + "}" in TEXTS[name]:
            env[dep] = f"({_spark_sql(dep, sf_dir, parts)})"
    return TEXTS[name].format(**env)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture relation as a DataFrame over the Parquet tables in ``sf_dir``."""
    if name in TEXTS:
        sf_dir, parts = sf_dir.rstrip("/"), fanout_partitions(spark)
        if name == "pixels":
            parts = max(parts, -(-spark.read.parquet(f"{sf_dir}/supplier.parquet").count() // IMAGES_PER_TASK))
        return spark.sql(_spark_sql(name, sf_dir, str(parts)))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def duck_texts() -> dict[str, str]:
    """The same relations as DuckDB SELECT texts that refer to each other by name."""
    env = {t: t for t in BASE_TABLES}
    env.update({t: t for t in TEXTS})
    env.update(_DUCK_EXPLODE)
    env["SPREAD"] = ""
    return {name: text.format(**env) for name, text in TEXTS.items()}
