"""Queries over symbols, models, run histories and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlines.operators import boxes as B
from planlines.operators import clusters as KM
from planlines.operators import metrics as E
from planlines.operators import models as ML
from planlines.operators import networks as N
from planlines.operators import ranking as K
from planlines.operators import symbols as Y
from planlines.plans.inputs import N_FEATURES, Inputs
from planlines.plans.queries_lines import r6
from planlines.plans.registry import SQL, query
from planlines.session import scratch_path, stage
from planlines.sources import reports as O
from planlines.sources import symbol_cache as C
from planlines.sources.rasters import stem
from planlines.streaming import ingest as S

BOX = ["x1", "y1", "x2", "y2"]


# --- features ---------------------------------------------------------------


@query("bbox_features", """
SELECT crop_id, w, h, round(ln(w / h), 6) AS log_aspect, round(ln(w * h), 6) AS log_area, round(ln(w) + ln(h), 6) AS log_sum
FROM (SELECT crop_id, greatest(x2 - x1, 1.0) AS w, greatest(y2 - y1, 1.0) AS h FROM symbols)""")
def bbox_features(q: Inputs):
    w, h, aspect, area, total = Y.bbox_features(*[F.col(c) for c in BOX])
    return q.symbols.select("crop_id", w.alias("w"), h.alias("h"), r6(aspect).alias("log_aspect"), r6(area).alias("log_area"), r6(total).alias("log_sum"))


def _probe(array: str):
    """First and last element and a position-weighted sum of a double array."""
    weighted = F.aggregate(F.transform(array, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return [r6(F.col(array)[0]).alias("first"), r6(F.element_at(array, -1)).alias("last"), F.round(weighted, 5).alias("weighted"), F.size(array).cast("long").alias("n")]


PROBE_SQL = "round(v[1], 6) AS first, round(v[len(v)], 6) AS last, round(list_sum(list_transform(v, lambda e, i: e * i)), 5) AS weighted, len(v) AS n"


@query("l2_normalize", f"SELECT crop_id, {PROBE_SQL} FROM (SELECT crop_id, list_transform(e, lambda x: x / (sqrt(list_sum(list_transform(e, lambda t: t * t))) + 1e-8)) AS v FROM (SELECT crop_id, CAST(embedding AS DOUBLE[]) AS e FROM symbols))")
def l2_normalize(q: Inputs):
    return q.symbols.select("crop_id", Y.l2_normalize(F.col("embedding")).alias("v")).select("crop_id", *_probe("v"))


@query("symbol_features", f"SELECT crop_id, {PROBE_SQL} FROM (SELECT crop_id, features AS v FROM features)")
def symbol_features(q: Inputs):
    return Y.symbol_features(q.symbols, "v").select("crop_id", *_probe("v"))


@query("embedding_norms", """
SELECT count(*) AS n, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim, round(min(nrm), 6) AS min_norm, round(avg(nrm), 6) AS mean_norm, round(max(nrm), 6) AS max_norm
FROM (SELECT embedding, sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))) AS nrm FROM embeddings)""")
def embedding_norms(q: Inputs):
    norms = q.table("embeddings").select(F.size("embedding").cast("long").alias("dim"), Y.l2_norm(F.col("embedding")).alias("norm"))
    return norms.agg(F.count("*").alias("n"), F.min("dim").alias("min_dim"), F.max("dim").alias("max_dim"), r6(F.min("norm")).alias("min_norm"),
                     r6(F.avg("norm")).alias("mean_norm"), r6(F.max("norm")).alias("max_norm"))


@query("score_linear", "SELECT crop_id, round(p, 6) AS p FROM linear")
def score_linear(q: Inputs):
    """P of a linear model with given coefficients, entirely in the JVM."""
    return q.scored_symbols.select("crop_id", r6("p").alias("p"))


@query("symbol_bands", """
SELECT image_id, count(*) AS n_symbols, count(*) FILTER (p >= 0.85) AS n_irrigation, count(*) FILTER (p <= 0.15) AS n_callout, count(*) FILTER (p < 0.85 AND p > 0.15) AS n_neutral
FROM linear GROUP BY image_id""")
def symbol_bands(q: Inputs):
    band = Y.band(F.col("p"))
    return q.scored_symbols.withColumn("band", band).groupBy("image_id").agg(
        F.count("*").alias("n_symbols"), *[F.count_if(F.col("band") == b).alias(f"n_{b}") for b in ("irrigation", "callout", "neutral")]
    )


@query("standardize", """
WITH l AS (SELECT crop_id, UNNEST(features) AS v, UNNEST(range(0, len(features))) AS i FROM features),
s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS d FROM l GROUP BY i)
SELECT crop_id, round(sum((v - m) / CASE WHEN d = 0 THEN 1 ELSE d END * (i + 1)), 4) AS weighted, count(*) AS n FROM l JOIN s USING (i) GROUP BY crop_id""")
def standardize(q: Inputs):
    feats = Y.symbol_features(q.symbols).select("crop_id", "features")
    scaled = ML.standardize(feats, "features", ML.collect_stats(feats, "features"))
    weighted = F.aggregate(F.transform("scaled", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return scaled.select("crop_id", F.round(weighted, 4).alias("weighted"), F.size("scaled").cast("long").alias("n"))


# --- labels, clusters, curves -----------------------------------------------


@query("relabel_audit", """
WITH r AS (SELECT i.split, l.near_gt AS new, CASE WHEN l.label % 5 <> 3 THEN l.label % 2 = 0 END AS old FROM labelled l JOIN images i USING (image_id) WHERE l.near_gt IS NOT NULL)
SELECT coalesce(split, 'all') AS split, count(*) AS n, count(*) FILTER (new) AS n_true, count(*) FILTER (NOT new) AS n_false,
  count(*) FILTER (new IS DISTINCT FROM old) AS n_flips, round(100.0 * count(*) FILTER (new IS DISTINCT FROM old) / count(*), 4) AS pct_flips FROM r GROUP BY ROLLUP (split)""")
def relabel_audit(q: Inputs):
    """New labels against the previous flags, per split and in total.

    Only symbols of images with lines get a new label; a missing old flag is a flip.
    """
    rows = q.labelled_symbols.filter("near_gt is not null").join(q.images.select("image_id", "split"), "image_id")
    new, old = F.col("near_gt"), F.when(F.col("label") % 5 != 3, F.col("label") % 2 == 0)
    out = rows.rollup("split").agg(
        F.count("*").alias("n"), F.count_if(new).alias("n_true"), F.count_if(~new).alias("n_false"), F.count_if(~new.eqNullSafe(old)).alias("n_flips"),
    )
    return out.withColumn("pct_flips", F.round(100.0 * F.col("n_flips") / F.col("n"), 4)).withColumn("split", F.coalesce("split", F.lit("all")))


RATE_CTES = """
WITH k AS (SELECT UNNEST(range(0, 12)) AS label),
r AS (SELECT label, count(*) AS n, avg(CAST(near_gt AS INT)) AS p FROM labelled WHERE near_gt IS NOT NULL GROUP BY label),
c AS (SELECT CAST(k.label AS INT) AS label, coalesce(r.n, 0) AS n_members, coalesce(r.p, 0.0) AS p_near FROM k LEFT JOIN r USING (label)),
g AS (SELECT *, CASE WHEN p_near > 0.14 THEN 'irrigation' WHEN p_near < 0.12 THEN 'callout' ELSE 'ambiguous' END AS category FROM c)"""


def _rates(q: Inputs) -> DataFrame:
    """Near rate of each of twelve clusters, two of them empty; the fixture's label is the cluster."""
    clusters = q.spark.range(12).select(F.col("id").cast("int").alias("label"))
    return ML.categorize(ML.cluster_near_rate(q.labelled_symbols, "label", clusters), 0.14, 0.12)


@query("cluster_near_rate", RATE_CTES + " SELECT label, n_members, round(p_near, 6) AS p_near FROM g")
def cluster_near_rate(q: Inputs):
    return _rates(q).select("label", "n_members", r6("p_near").alias("p_near"))


@query("cluster_category", RATE_CTES + " SELECT label, category FROM g")
def cluster_category(q: Inputs):
    return _rates(q).select("label", "category")


@query("category_counts", RATE_CTES + """
SELECT g.category, count(*) AS n_clusters, CAST(sum(n_members) AS BIGINT) AS n_symbols, round(sum(n_members * p_near) / greatest(sum(n_members), 1), 6) AS near_rate FROM g GROUP BY g.category""")
def category_counts(q: Inputs):
    near = F.sum(F.col("n_members") * F.col("p_near")) / F.greatest(F.sum("n_members"), F.lit(1))
    return _rates(q).groupBy("category").agg(F.count("*").alias("n_clusters"), F.sum("n_members").alias("n_symbols"), r6(near).alias("near_rate"))


@query("cluster_meta", RATE_CTES + """
SELECT row_number() OVER (ORDER BY CASE category WHEN 'irrigation' THEN 0 WHEN 'ambiguous' THEN 1 ELSE 2 END, p_near DESC, label) AS pos, label, category, n_members, printf('%.4f', p_near) AS p_near FROM g""")
def cluster_meta(q: Inputs):
    """Cluster metadata sorted by category and falling rate, written as CSV and read back."""
    from pyspark.sql.window import Window

    # One row per cluster: a global window over a few dozen rows.
    w = Window.orderBy(ML.category_order(F.col("category")), F.desc("p_near"), "label")
    meta = _rates(q).select(F.row_number().over(w).cast("long").alias("pos"), "label", "category", "n_members", O.fixed4(F.col("p_near")).alias("p_near"))
    path = scratch_path(q.spark, "clusters")
    O.write_csv(meta, path)
    return q.spark.read.schema("pos long, label int, category string, n_members long, p_near string").option("header", True).csv(path)


@query("cluster_samples", """
SELECT label, crop_id, rank FROM (SELECT label, crop_id, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || CAST(crop_id AS VARCHAR)), crop_id) AS rank FROM symbols) WHERE rank <= 6""")
def cluster_samples(q: Inputs):
    """Six members per cluster in a seeded hash order, without replacement."""
    salted = F.md5(F.concat(F.lit("0:"), F.col("crop_id").cast("string")))
    return K.top_n(q.symbols.select("label", "crop_id"), ["label"], [salted, F.col("crop_id")], 6)


CURVE_CTES = """
WITH s AS (SELECT i.split, n.p, l.near_gt AS y FROM linear n JOIN labelled l USING (crop_id) JOIN images i ON i.image_id = l.image_id WHERE l.near_gt IS NOT NULL)"""


def _curve_rows(q: Inputs) -> DataFrame:
    rows = q.labelled_symbols.filter("near_gt is not null").select("crop_id", "image_id", "near_gt")
    scored = rows.join(q.scored_symbols.select("crop_id", "p"), "crop_id")
    return scored.join(q.images.select("image_id", "split"), "image_id")


@query("roc_auc", CURVE_CTES + """,
r AS (SELECT split, y, rank() OVER (PARTITION BY split ORDER BY p) + (count(*) OVER (PARTITION BY split, p) - 1) / 2 AS rk FROM s)
SELECT split, count(*) FILTER (y) AS n_pos, count(*) FILTER (NOT y) AS n_neg,
  round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / nullif(count(*) FILTER (y) * count(*) FILTER (NOT y), 0), 6) AS auc FROM r GROUP BY split""")
def roc_auc(q: Inputs):
    return K.roc_auc(_curve_rows(q), ["split"], "p", "near_gt").withColumn("auc", r6("auc"))


@query("pr_at_targets", CURVE_CTES + """,
d AS (SELECT split, p, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM s GROUP BY split, p),
c AS (SELECT split, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY split) AS np FROM d WINDOW w AS (PARTITION BY split ORDER BY p DESC)),
pr AS (SELECT split, tp / (tp + fp) AS precision, CASE WHEN np > 0 THEN tp / np ELSE 1.0 END AS recall FROM c UNION ALL SELECT DISTINCT split, 1.0, 0.0 FROM d)
SELECT split, round(max(precision) FILTER (recall >= 0.5), 6) AS p_at_r50, round(max(precision) FILTER (recall >= 0.8), 6) AS p_at_r80, round(max(precision) FILTER (recall >= 0.9), 6) AS p_at_r90,
  round(max(recall) FILTER (precision >= 0.8), 6) AS r_at_p80, round(max(recall) FILTER (precision >= 0.9), 6) AS r_at_p90, round(max(recall) FILTER (precision >= 0.95), 6) AS r_at_p95 FROM pr GROUP BY split""")
def pr_at_targets(q: Inputs):
    out = K.pr_at_targets(_curve_rows(q), ["split"], "p", "near_gt")
    return out.withColumns({c: r6(c) for c in out.columns if c != "split"})


@query("silhouette", """
WITH s AS (SELECT crop_id, label, list_transform(e, lambda v: v / (sqrt(list_sum(list_transform(e, lambda t: t * t))) + 1e-8)) AS v
  FROM (SELECT crop_id, label, CAST(embedding AS DOUBLE[]) AS e FROM symbols)),
n AS (SELECT label, count(*) AS k FROM s GROUP BY label),
d AS (SELECT a.crop_id, a.label, b.label AS other, sum(list_distance(a.v, b.v) ** 2) AS total FROM s a, s b GROUP BY ALL),
m AS (SELECT d.crop_id, max(CASE WHEN other = d.label THEN total / greatest(k - 1, 1) END) AS a, min(CASE WHEN other <> d.label THEN total / k END) AS b, max(CASE WHEN other = d.label THEN k END) AS own FROM d JOIN n ON n.label = d.other GROUP BY d.crop_id)
SELECT count(*) AS n, round(avg(CASE WHEN own > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 5) AS silhouette FROM m""")
def silhouette(q: Inputs):
    """Silhouette of the fixture's labels over all symbols, under squared distance."""
    rows = stage(q.symbols.select("label", Y.l2_normalize(F.col("embedding")).alias("v")), "embeddings")
    return ML.silhouette(rows, "v", "label").withColumn("silhouette", F.round("silhouette", 5))


@query("silhouette_euclidean", """
WITH s AS (SELECT crop_id, label, list_transform(e, lambda v: v / (sqrt(list_sum(list_transform(e, lambda t: t * t))) + 1e-8)) AS v
  FROM (SELECT crop_id, label, CAST(embedding AS DOUBLE[]) AS e FROM symbols)),
n AS (SELECT label, count(*) AS k FROM s GROUP BY label),
d AS (SELECT a.crop_id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS total FROM s a, s b GROUP BY ALL),
m AS (SELECT d.crop_id, max(CASE WHEN other = d.label THEN total / greatest(k - 1, 1) END) AS a, min(CASE WHEN other <> d.label THEN total / k END) AS b, max(CASE WHEN other = d.label THEN k END) AS own FROM d JOIN n ON n.label = d.other GROUP BY d.crop_id)
SELECT count(*) AS n, round(avg(CASE WHEN own > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 5) AS silhouette FROM m""")
def silhouette_euclidean(q: Inputs):
    """Silhouette of the fixture's labels over all symbols, under plain distance."""
    rows = KM.unit_embeddings(q.symbols.withColumn("label", F.col("label").cast("int")), "label")
    return KM.silhouettes(rows, ["label"]).select("n", F.round("silhouette", 5).alias("silhouette"))


# --- models -----------------------------------------------------------------


@query("class_weights", """
SELECT near_gt, count(*) AS n, round((SELECT count(*) FROM labelled WHERE near_gt IS NOT NULL) / (2.0 * count(*)), 6) AS weight FROM labelled WHERE near_gt IS NOT NULL GROUP BY near_gt""")
def class_weights(q: Inputs):
    known = q.labelled_symbols.filter("near_gt is not null")
    return ML.class_weights(known, "near_gt").withColumn("weight", r6("weight"))


@query("cluster_symbols")
def cluster_symbols(q: Inputs):
    """k-means clusters of the unit embeddings, the best of several seeded fits."""
    return KM.cluster_symbols(q.symbols, 30).select("crop_id", "image_id", "cluster")


@query("categorized_symbols")
def categorized_symbols(q: Inputs):
    """Symbols with the category of their k-means cluster."""
    return _categorize_clusters(q, q.labelled_symbols, 30)[1]


def _categorize_clusters(q: Inputs, labelled: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    known = labelled.filter("near_gt is not null")
    rows = stage(KM.cluster_symbols(known, k).select("crop_id", "image_id", "near_gt", "cluster"), "clustered")
    ids = q.spark.range(k).select(F.col("id").cast("int").alias("cluster"))
    clusters = ML.categorize(ML.cluster_near_rate(rows, "cluster", ids))
    return clusters, rows.join(clusters.select("cluster", "category"), "cluster")


def _cluster_artifact(q: Inputs, labelled: DataFrame) -> DataFrame:
    """Ten fits for each candidate K, the K of the highest silhouette, its best fit written and read back."""
    rows = KM.unit_embeddings(labelled.filter("near_gt is not null"), "crop_id", "near_gt")
    distinct = KM.collapsed(rows)
    fits = KM.fit_all(distinct, KM.K_CANDIDATES)
    k, _ = KM.pick_k(distinct, fits)
    centres = KM.best(fits, k).centres
    ids = q.spark.range(k).select(F.col("id").cast("int").alias("cluster"))
    path = scratch_path(q.spark, "artifact")
    rates = ML.cluster_near_rate(KM.assign(rows, {"cluster": centres}), "cluster", ids)
    ML.write_cluster_artifact(centres, ML.categorize(rates), path)
    return ML.read_cluster_artifact(q.spark, path)


@query("cluster_centroids")
def cluster_centroids(q: Inputs):
    """The mining job's artifact itself: one row for each cluster of the chosen K."""
    return _cluster_artifact(q, q.labelled_symbols)


@query("cluster_artifact", "SELECT count(*) AS n_symbols, 64::BIGINT AS dim, 0::BIGINT AS n_bad FROM labelled WHERE near_gt IS NOT NULL")
def cluster_artifact(q: Inputs):
    """The mining job's artifact, with K chosen by silhouette, written and read back.

    ``n_bad`` counts clusters that are missing, have no whole centroid, or whose
    category does not follow from their rate and the thresholds in the record.
    """
    read = _cluster_artifact(q, q.labelled_symbols)
    right = F.when(F.col("p_near") > F.col("high"), "irrigation").when(F.col("p_near") < F.col("low"), "callout").otherwise("ambiguous")
    good = (F.size("centroid") == 64) & (F.col("category") == right)
    return read.agg(
        F.sum("n_members").alias("n_symbols"), F.max(F.size("centroid")).cast("long").alias("dim"),
        (F.max("k") - F.count_if(good)).cast("long").alias("n_bad"),
    )


@query("relabelled_cache", "SELECT i.split, l.crop_id, l.near_gt FROM labelled l JOIN images i USING (image_id)")
def relabelled_cache(q: Inputs):
    """A cache with old flags, read, labelled anew against the lines, and published as a new version."""
    root = scratch_path(q.spark, "cache")
    C.switch(q.spark, root, C.write_version(_cache_rows(q).withColumn("near_gt", F.col("id").cast("long") % 2 == 0), root))
    names = q.images.select("split", F.col("file_name").alias("image"), "image_id")
    rows = C.read_cache(q.spark, C.current(q.spark, root)).filter("id is not null").drop("near_gt").join(names, ["split", "image"])
    fresh = Y.near_line(rows, q.images, q.runs, "id")
    C.switch(q.spark, root, C.write_version(fresh.select("split", "image", "id", *BOX, "conf", "embedding", "near_gt"), root))
    return C.read_cache(q.spark, C.current(q.spark, root)).select("split", F.col("id").cast("long").alias("crop_id"), "near_gt")


def _mined(q: Inputs) -> DataFrame:
    """The cache after a mining run that found a third of the images done: their records and those of the rest."""
    root = scratch_path(q.spark, "cache")
    before = _cache_rows(q).join(q.images.filter("image_id % 3 = 0").select("split", F.col("file_name").alias("image")), ["split", "image"], "left_semi")
    C.switch(q.spark, root, C.write_version(before, root))
    old = C.current(q.spark, root)
    pending = stage(C.pending_images(q.images.withColumnRenamed("file_name", "image"), C.cached_images(q.spark, old)), "pending")
    dets = q.detections.join(pending.select("image_id"), "image_id", "left_semi")
    kept = B.nms(dets, ["image_id"], "det_id", 0.5, 0.3)
    emb = q.symbols.select(F.col("crop_id").alias("det_id"), "embedding")
    symbols = C.attach_embeddings(kept, emb, "det_id").withColumnRenamed("det_id", "crop_id")
    labelled = Y.near_line(symbols, q.images, q.runs, "crop_id")
    new = labelled.join(pending.select("image_id", "split", "image"), "image_id").withColumn("id", F.col("crop_id").cast("string"))
    columns = ["split", "image", "id", *BOX, "conf", "embedding", "near_gt"]
    done = C.read_cache(q.spark, old).filter("id is not null").select(*columns)
    C.switch(q.spark, root, C.write_version(done.unionByName(new.select(*columns)), root))
    return C.read_cache(q.spark, C.current(q.spark, root)).filter("id is not null").withColumn("crop_id", F.col("id").cast("long"))


@query("symbol_mining")
def symbol_mining(q: Inputs):
    """Detections to categorised clusters: images without a record are mined, K is chosen, the artifact written."""
    return _cluster_artifact(q, _mined(q)).select("cluster", "n_members", "p_near", "category", "k")


@query("mined_cache", f"""
WITH chosen AS ({SQL["nms"].strip().replace("WITH d AS", "WITH RECURSIVE d AS", 1)})
SELECT s.image_id, s.crop_id, n.near_gt FROM symbols s JOIN near n ON n.det_id = s.crop_id WHERE s.image_id % 3 = 0
UNION ALL SELECT k.image_id, k.det_id AS crop_id, n.near_gt FROM chosen k JOIN symbols s ON s.crop_id = k.det_id JOIN near n ON n.det_id = k.det_id WHERE k.image_id % 3 <> 0""")
def mined_cache(q: Inputs):
    """Symbols of the cache after a resumed mining run, with their labels."""
    names = q.images.select("split", F.col("file_name").alias("image"), "image_id")
    return _mined(q).join(names, ["split", "image"]).select("image_id", "crop_id", "near_gt")


def _features(q: Inputs) -> DataFrame:
    """Raw features of all symbols with split and label, written out."""
    feats = Y.symbol_features(q.labelled_symbols).join(q.images.select("image_id", "split"), "image_id")
    return stage(feats.select("split", "crop_id", "near_gt", "features"), "features")


def _known(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and validation symbols with a known label."""
    known = rows.filter("near_gt is not null")
    return known.filter("split = 'train'"), known.filter("split = 'valid'")


def _scored(model, rows: DataFrame) -> DataFrame:
    """Rows with ``p``; none without a model."""
    return model.transform(rows) if model else rows.limit(0).withColumn("p", F.lit(None).cast("double"))


@query("fit_logreg")
def fit_logreg(q: Inputs):
    """Validation scores of the balanced logistic regression."""
    train, valid = _known(_features(q))
    return _scored(N.logistic(train, "features", "near_gt"), valid).select("crop_id", "near_gt", "p")


@query("fit_mlp")
def fit_mlp(q: Inputs):
    """Validation scores of the network with one hidden ReLU layer."""
    train, valid = _known(_features(q))
    return _scored(N.network(train, "features", "near_gt", "crop_id"), valid).select("crop_id", "near_gt", "p")


@query("select_model")
def select_model(q: Inputs):
    """Candidates with their AUCs and the one chosen by validation AUC."""
    train, valid = _known(_features(q))
    results, best = N.candidates(train, valid, "features", "near_gt", "crop_id")
    rows = [(n, a, v, best is not None and n == best[0]) for n, a, v in results]
    return q.spark.createDataFrame(rows, "model string, auc_train double, auc_valid double, chosen boolean")


@query("score_symbols")
def score_symbols(q: Inputs):
    """The classifier job: the chosen model, saved and loaded again, scores the raw features of every symbol of every split."""
    return _classifier_job(q)[0].select("split", "crop_id", "near_gt", "p", Y.band(F.col("p")).alias("band"))


def _classifier_job(q: Inputs) -> tuple[DataFrame, DataFrame]:
    """Scores of all symbols, known label or not, and the metadata row saved with the chosen model.

    Without a validation AUC (a class is missing there) nothing is chosen, saved or scored.
    """
    rows = _features(q)
    train, valid = _known(rows)
    results, best = N.candidates(train, valid, "features", "near_gt", "crop_id")
    if best is None:
        none = q.spark.createDataFrame([], N.META).withColumn("is_best", F.lit(None).cast("boolean"))
        return _scored(None, rows), none
    path = scratch_path(q.spark, "classifier")
    aucs = next((a, v) for n, a, v in results if n == best[0])
    N.save(path, best[1], q.spark.createDataFrame([(best[0], *aucs, N_FEATURES, ["train"], train.count(), valid.count())], N.META))
    model, meta = N.load(q.spark, path)
    # the loaded artifact is judged anew on the raw validation rows
    again, most = ML.auc_of(model.transform(valid), "near_gt"), max(v for _, _, v in results if v is not None)
    return model.transform(rows), meta.withColumn("is_best", (F.col("auc_valid") == again) & (F.col("auc_valid") == most))


#: A validation AUC exists where both splits hold both labels; else there is no model and no row.
JUDGED = """(SELECT count(DISTINCT (i.split, l.near_gt)) FROM labelled l JOIN images i USING (image_id)
  WHERE l.near_gt IS NOT NULL AND i.split IN ('train', 'valid')) = 4"""


@query("score_coverage", f"""
SELECT i.split, count(*) AS n, count(l.near_gt) AS n_known, count(*) AS n_scored, CAST(sum(l.crop_id) AS BIGINT) AS ids
FROM labelled l JOIN images i USING (image_id) WHERE {JUDGED} GROUP BY i.split""")
def score_coverage(q: Inputs):
    """What the classifier job scored, by split: every symbol, with a probability."""
    return _classifier_job(q)[0].groupBy("split").agg(
        F.count("*").alias("n"), F.count("near_gt").alias("n_known"), F.count_if(F.col("p").between(0, 1)).alias("n_scored"), F.sum("crop_id").alias("ids")
    )


@query("classifier_metadata", f"""
SELECT 69::BIGINT AS n_features, 'train' AS train_splits, count(*) FILTER (i.split = 'train') AS n_train, count(*) FILTER (i.split = 'valid') AS n_valid, true AS is_best
FROM labelled l JOIN images i USING (image_id) WHERE l.near_gt IS NOT NULL HAVING {JUDGED}""")
def classifier_metadata(q: Inputs):
    """The metadata row saved with the chosen model; ``is_best``: the loaded artifact reaches its recorded AUC, the highest of all."""
    meta = _classifier_job(q)[1]
    return meta.select("n_features", F.array_join("train_splits", ",").alias("train_splits"), "n_train", "n_valid", "is_best")


# --- symbol records ---------------------------------------------------------


def _cache_rows(q: Inputs) -> DataFrame:
    rows = q.labelled_symbols.join(q.images.select("image_id", "split", F.col("file_name").alias("image")), "image_id")
    return rows.select("split", "image", F.col("crop_id").cast("string").alias("id"), *BOX, F.coalesce("conf", F.lit(0.0)).alias("conf"), "embedding", "near_gt")


@query("symbol_sink", """
SELECT i.split, i.file_name AS image, count(*) AS n_symbols, min(l.crop_id) AS first_id, count(*) FILTER (l.near_gt) AS n_near FROM labelled l JOIN images i USING (image_id) GROUP BY i.split, i.file_name""")
def symbol_sink(q: Inputs):
    """Per-image records as they would be written."""
    records = C.cache_records(_cache_rows(q))
    ids = F.transform("symbols", lambda s: s["id"].cast("long"))
    near = F.size(F.filter("symbols", lambda s: s["near_gt"]))
    return records.groupBy("split", "image").agg(F.sum(F.size("symbols")).alias("n_symbols"), F.min(F.array_min(ids)).alias("first_id"), F.sum(near).alias("n_near"))


@query("symbol_scan", """
SELECT i.split, l.image_id, l.crop_id, l.x1, l.y1, l.x2, l.y2, coalesce(l.conf, 0.0) AS conf, len(l.embedding) AS dim, l.near_gt FROM labelled l JOIN images i USING (image_id)
WHERE i.split IN ('train', 'valid') AND l.near_gt IS NOT NULL""")
def symbol_scan(q: Inputs):
    """Records written per split, scanned back for two splits, keeping known labels."""
    path = scratch_path(q.spark, "cache")
    C.write_cache(_cache_rows(q).withColumn("image", F.concat(stem(F.col("image")), F.lit(".json"))), path)
    rows = C.training_symbols(C.read_cache(q.spark, path, ["train", "valid"]))
    # records and images meet by stem: a record's image may have another suffix
    names = q.images.select("split", stem(F.col("file_name")).alias("stem"), "image_id")
    known = rows.withColumn("stem", stem(F.col("image"))).join(names, ["split", "stem"])
    return known.select("split", "image_id", F.col("id").cast("long").alias("crop_id"), *BOX, "conf", F.size("embedding").cast("long").alias("dim"), "near_gt")


@query("pending_images", """
SELECT i.image_id, i.split, i.file_name AS image FROM images i WHERE i.image_id % 3 = 0 OR i.image_id % 7 = 1""")
def pending_images(q: Inputs):
    """Images without a readable record: some were never written, some are broken."""
    path = scratch_path(q.spark, "partial")
    images = q.images.select("image_id", "split", F.col("file_name").alias("image"))
    good = F.to_json(F.struct("image", F.array().cast(f"array<{C.SYMBOL}>").alias("symbols")))
    broken = F.concat(F.lit('{"image": "'), F.col("image"), F.lit('", "symbols": 7}'))
    lines = images.filter("image_id % 3 <> 0").select("split", F.when(F.col("image_id") % 7 == 1, broken).otherwise(good).alias("value"))
    lines.write.partitionBy("split").text(path)
    return C.pending_images(images, C.cached_images(q.spark, path))


# --- run histories ----------------------------------------------------------


@query("history_long", "SELECT run_id, epoch, round(val_dice, 10) AS val_dice, round(val_iou, 10) AS val_iou, round(val_total, 10) AS val_total FROM run_history")
def history_long(q: Inputs):
    """Histories written as parallel arrays, scanned back to one row per epoch."""
    path = scratch_path(q.spark, "history")
    O.write_histories(q.history, path)
    rows = O.read_histories(q.spark, path)
    return rows.select("run_id", "epoch", *[F.round(c, 10).alias(c) for c in O.METRICS])


BEST_CTES = """
WITH h AS (SELECT run_id, epoch, round(val_dice, 10) AS val_dice, round(val_iou, 10) AS val_iou, round(val_total, 10) AS val_total FROM run_history),
b AS (SELECT run_id, epoch AS best_epoch, val_dice AS best_value FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_dice DESC, epoch) AS k FROM h) WHERE k = 1)"""


def _history(q: Inputs) -> DataFrame:
    return q.history.select("run_id", "epoch", *[F.round(c, 10).alias(c) for c in O.METRICS])


@query("best_epoch", BEST_CTES + " SELECT run_id, count(*) AS n_epochs, max(epoch) AS last_epoch, min(best_epoch) AS best_epoch, min(best_value) AS best_value FROM h JOIN b USING (run_id) GROUP BY run_id")
def best_epoch(q: Inputs):
    return O.best_epoch(_history(q))


@query("improved_epochs", BEST_CTES + """
SELECT run_id, epoch, val_dice, max(val_dice) OVER (PARTITION BY run_id ORDER BY epoch) AS best_so_far,
  val_dice > coalesce(max(val_dice) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0) AS improved FROM h""")
def improved_epochs(q: Inputs):
    return O.improved_epochs(_history(q))


@query("history_report", BEST_CTES + """,
p AS (SELECT h.*, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS pos, count(*) OVER (PARTITION BY run_id) AS total FROM h)
SELECT run_id, epoch, pos, val_dice, val_iou, val_total, CASE WHEN epoch = best_epoch THEN 'BEST' ELSE '' END AS mark FROM p JOIN b USING (run_id)
WHERE (pos - 1) % 5 = 0 OR epoch = best_epoch OR pos = total""")
def history_report(q: Inputs):
    return O.history_report(_history(q))


#: Stand-ins for the series that the run table lacks: shares of the Dice by their place in the list.
SERIES_SQL = ", ".join(
    f"round({c}, 10) AS {c}" if c in O.METRICS else f"round(val_dice * {i + 1} / 16.0::DOUBLE, 10) AS {c}" for i, c in enumerate(O.SERIES)
)


def _series(q: Inputs) -> DataFrame:
    """Histories with all their series, written as parallel arrays and scanned back."""
    values = [F.round(F.col(c) if c in O.METRICS else F.col("val_dice") * (i + 1) / 16.0, 10).alias(c) for i, c in enumerate(O.SERIES)]
    path = scratch_path(q.spark, "history")
    O.write_histories(q.history.select("run_id", "epoch", *values), path, O.SERIES)
    return O.read_histories(q.spark, path, O.SERIES)


@query("history_series", f"""
UNPIVOT (SELECT run_id, epoch, {SERIES_SQL} FROM run_history) ON {", ".join(O.SERIES)} INTO NAME series VALUE value""")
def history_series(q: Inputs):
    """One row for each run, epoch and series."""
    return _series(q).unpivot(["run_id", "epoch"], O.SERIES, "series", "value")


@query("history_report_series", f"""
WITH h AS (SELECT run_id, epoch, {SERIES_SQL} FROM run_history),
b AS (SELECT run_id, epoch AS best_epoch FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_dice DESC, epoch) AS k FROM h) WHERE k = 1),
p AS (SELECT h.*, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS pos, count(*) OVER (PARTITION BY run_id) AS total FROM h)
SELECT run_id, epoch, pos, {", ".join(O.SERIES)}, CASE WHEN epoch = best_epoch THEN 'BEST' ELSE '' END AS mark FROM p JOIN b USING (run_id)
WHERE (pos - 1) % 5 = 0 OR epoch = best_epoch OR pos = total""")
def history_report_series(q: Inputs):
    """The run report with every series."""
    return O.history_report(_series(q).drop("pos"), metrics=O.SERIES)


# --- streams ----------------------------------------------------------------


@query("stream_ingest", "SELECT l.image_id, CAST(l.crop_id AS VARCHAR) AS crop_id, l.near_gt FROM labelled l")
def stream_ingest(q: Inputs):
    """Records arriving as files, labelled against the lines and appended exactly once."""
    source, target, mark = (scratch_path(q.spark, n) for n in ("arriving", "ingested", "offsets"))
    C.write_cache(_cache_rows(q), source)
    runs = stage(q.runs, "runs")
    S.ingest_symbols(q.spark, source, q.images, runs, target, mark)
    return q.spark.read.parquet(target).select("image_id", "crop_id", "near_gt")


@query("stream_metrics", """
WITH c AS (SELECT image_id % 7 AS run_id, count(*) FILTER (target = 1 AND logit >= 0) AS tp, count(*) FILTER (target = 0 AND logit >= 0) AS fp, count(*) FILTER (target = 1 AND logit < 0) AS fn FROM scored GROUP BY image_id % 7)
SELECT run_id, tp, fp, fn, round((2.0 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6), 6) AS dice, round((tp + 1e-6) / (tp + fp + fn + 1e-6), 6) AS iou FROM c""")
def stream_metrics(q: Inputs):
    """Running sums over arriving per-image counts, read as ratios."""
    source, target, mark = (scratch_path(q.spark, n) for n in ("counts", "running", "offsets"))
    counts = E.confusion_counts(q.flags, ["image_id"]).select((F.col("image_id") % 7).alias("run_id"), "tp", "fp", "fn")
    counts.write.parquet(source)
    S.running_overlap(q.spark, source, "run_id long, tp long, fp long, fn long", target, mark)
    out = S.read_running(q.spark, target)
    return out.withColumns({c: r6(c) for c in ("dice", "iou")})


@query("stream_resets", """
WITH c AS (SELECT image_id, count(*) FILTER (target = 1 AND logit >= 0) AS tp, count(*) FILTER (target = 0 AND logit >= 0) AS fp, count(*) FILTER (target = 1 AND logit < 0) AS fn FROM scored GROUP BY image_id),
e AS (SELECT image_id % 3 AS run_id, image_id AS seq, CASE WHEN image_id % 7 = 4 THEN 'reset' ELSE 'update' END AS kind, tp, fp, fn FROM c),
l AS (SELECT run_id, count(*) FILTER (kind = 'reset') AS resets, max(seq) FILTER (kind = 'reset') AS last FROM e GROUP BY run_id),
s AS (SELECT run_id, any_value(resets) AS resets, count(*) FILTER (kind = 'update' AND seq > coalesce(last, -1)) AS updates,
  CAST(coalesce(sum(tp) FILTER (kind = 'update' AND seq > coalesce(last, -1)), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp) FILTER (kind = 'update' AND seq > coalesce(last, -1)), 0) AS BIGINT) AS fp,
  CAST(coalesce(sum(fn) FILTER (kind = 'update' AND seq > coalesce(last, -1)), 0) AS BIGINT) AS fn FROM e JOIN l USING (run_id) GROUP BY run_id)
SELECT run_id, resets, updates, tp, fp, fn, round((2.0 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6), 6) AS dice FROM s""")
def stream_resets(q: Inputs):
    """Running sums over three micro-batches of events, cleared whenever a run is reset."""
    source, target, mark = (scratch_path(q.spark, n) for n in ("events", "running", "offsets"))
    kind = F.when(F.col("image_id") % 7 == 4, "reset").otherwise("update")
    counts = E.confusion_counts(q.flags, ["image_id"]).select((F.col("image_id") % 3).alias("run_id"), F.col("image_id").alias("seq"), kind.alias("kind"), "tp", "fp", "fn")
    events = stage(counts, "counts")
    top = (events.agg(F.max("seq")).first()[0] or 0) + 1
    for part in range(3):  # files arrive in the order of the events
        mine = events.filter((F.col("seq") >= part * top // 3) & (F.col("seq") < (part + 1) * top // 3))
        mine.coalesce(1).write.mode("append").parquet(source)
    S.overlap_since_reset(q.spark, source, target, mark)
    return S.read_since_reset(q.spark, target).withColumn("dice", r6("dice")).drop("n_batches")
