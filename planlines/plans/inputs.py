"""Relations the queries start from, as lazy DataFrames over one data folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlines.functions import scoring as SC
from planlines.operators import lines as L
from planlines.operators import raster as R
from planlines.operators import symbols as Y
from planlines.plans.fixtures import relation
from planlines.session import stage
from planlines.sources.annotations import line_chords

TILE, STRIDE, BATCH = 32, 24, 16
RADIUS = 10.0
N_FEATURES = 69
# A fixed linear model: weight of feature i, and the bias.
WEIGHTS = [((i * 7) % 11 - 5) / 10 for i in range(64)] + [0.05, -0.04, 0.3, -0.1, 0.02]
BIAS = 0.1


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return relation(self.spark, self.sf_dir, name)

    @cached_property
    def images(self) -> DataFrame:
        return self.table("images")

    @cached_property
    def annotations(self) -> DataFrame:
        return self.table("annotations")

    @cached_property
    def detections(self) -> DataFrame:
        return self.table("detections")

    @cached_property
    def symbols(self) -> DataFrame:
        return self.table("symbols")

    @cached_property
    def pixels(self) -> DataFrame:
        return self.table("pixels")

    @cached_property
    def history(self) -> DataFrame:
        return self.table("run_history")

    @cached_property
    def chords(self) -> DataFrame:
        return line_chords(self.annotations, self.images)

    @cached_property
    def ends(self) -> DataFrame:
        return L.chord_endpoints(self.chords)

    @cached_property
    def clusters(self) -> DataFrame:
        return L.endpoint_clusters(self.ends, RADIUS)

    @cached_property
    def runs(self) -> DataFrame:
        """Line mask of the chords as row runs, written out: most queries read it several times."""
        return stage(R.rasterize(R.chord_segments(self.chords, self.images), 4), "runs")

    @cached_property
    def mask(self) -> DataFrame:
        return R.runs_to_pixels(self.runs)

    @cached_property
    def centreline(self) -> DataFrame:
        """One-pixel strokes of the chords, a stand-in skeleton with exact SQL."""
        return R.runs_to_pixels(R.rasterize(R.chord_segments(self.chords, self.images), 1))

    @cached_property
    def scored(self) -> DataFrame:
        """Dense pixels with 0/1 target and a logit correlated with the mask one pixel off."""
        joined = R.attach_mask(self.pixels, self.runs, {"gt": 0, "lift": 1})
        shift = F.when(F.col("lift"), F.lit(4.0)).otherwise(F.lit(-3.0))
        return joined.select("image_id", "y", "x", (F.col("logit") + shift).alias("logit"), F.col("gt").cast("int").alias("target"))

    @cached_property
    def flags(self) -> DataFrame:
        """Dense pixels with boolean gt and pred."""
        return self.scored.select("image_id", "y", "x", (F.col("target") == 1).alias("gt"), (F.col("logit") >= 0).alias("pred"))

    @cached_property
    def pred(self) -> DataFrame:
        return self.scored.filter("logit >= 0").select("image_id", "y", "x")

    @cached_property
    def tile_scores(self) -> DataFrame:
        """Scores seen by overlapping tiles that disagree a little."""
        tiled = R.to_tiles(self.scored, self.images, TILE, STRIDE)
        off = ((F.col("tile_row") + F.col("tile_col")) % 3) / 4
        return tiled.withColumn("logit", F.col("logit") + off).withColumn("p", SC.sigmoid(F.col("logit")))

    @cached_property
    def labelled_symbols(self) -> DataFrame:
        """Symbols with ``near_gt`` from the chord mask."""
        return Y.near_line(self.symbols, self.images, self.runs, "crop_id")

    @cached_property
    def scored_symbols(self) -> DataFrame:
        """Symbols with P of the fixed linear model."""
        featured = Y.symbol_features(self.symbols)
        return featured.withColumn("p", Y.linear_score(F.col("features"), WEIGHTS, BIAS)).drop("features", "embedding")
