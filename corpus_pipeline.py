"""Cleaning and mixing of a corpus: five stages over ``documents``, each written out and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planlines.llm import anchors, forest, latent, mixing, site_quality
from planlines.llm.texts import read
from planlines.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site quality classifier keeps."""
    return site_quality.keep(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return forest.dedup(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that an earlier document holds."""
    return anchors.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away."""
    return latent.clean(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontamination", decontamination),
    ("mixture", mixture),
]

#: Several stages are trained or iterative and have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), name)
    return docs
