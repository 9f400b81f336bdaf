"""Quality classifier with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlines.llm.prefilter import without
from planlines.llm.texts import WordHashes, fold, hashes, rolling, slices, task, utf8
from planlines.session import stage

#: Most labelled documents that the document classifier is fitted on.
MAX_LABELLED = 20000
FOLDS = 5
FEATURES = ("length", "short", "upper", "symbols", "bangs", "bars", "digits", "word_chars", "distinct", "repeated", "dup_lines")
_KIND = np.zeros(256, np.uint8)
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"#*$%&<>", b"!", b"|", b"0123456789"), 1):
    _KIND[list(_bytes)] = _k


def _measure(text: bytes, known: WordHashes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0, 1.0] + [0.0] * (len(FEATURES) - 2)
    count = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=7)
    x = hashes(words, known)
    triples = rolling(x, 3)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return [
        np.log(n), 50.0 / (50.0 + n), count[1] / max(1, count[1] + count[2]), count[3] / n, count[4] / n, count[5] / n,
        count[6] / len(text), min(30.0, sum(map(len, words)) / n), np.log(len(np.unique(x)) + 1) / np.log(n + 1),
        1 - len(np.unique(triples)) / len(triples) if len(triples) else 0.0, 1 - len(set(lines)) / len(lines),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for whole in batches:
        for batch in slices(whole, "text"):
            x = [[float(v) for v in _measure(t.as_py(), known)] for t in batch.column("text")]
            columns = [batch.column(c) for c in ("doc_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(x, pa.list_(pa.float64()))], ["doc_id", "host", "path", "x"])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights on standardised features, folded back to raw ones; the bias is last. Newton steps until settled."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / scale
    return np.append(raw, w[-1] - raw @ mean)


def _strength(groups: DataFrame, toward: str) -> float:
    """Prior strength by moments, from ``n, good`` of groups and the rate ``toward`` they shrink to.

    The spread of group rates around it, each group weighing its rows, less what
    chance alone gives, stands for the spread between groups. One aggregated row.
    """
    rate, m = F.col("good") / F.col("n"), F.col(toward)
    row = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (rate - m) * (rate - m)).alias("square"),
        F.sum(m * (1 - m)).alias("chance"), F.sum(F.col("n") * m * (1 - m)).alias("within"),
    ).first()
    if not row["n"]:
        return 1.0
    between = (row["square"] - row["chance"]) / row["n"]
    return float(min(max(row["within"] / row["n"] / between - 1, 1.0), 1e6)) if between > 0 else 1e6


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", least: float = 0.5) -> DataFrame:
    """``doc_id, classifier, host_rate, path_rate, score, kept`` for every row of ``docs (doc_id, text, <host>, <path>)``.

    1. ``classifier``: logistic regression on measures of the whole text, fitted on
       at most MAX_LABELLED labelled documents with crc32 of the id not divisible by
       FOLDS.
    2. Hosts: the expected number of good documents of each host, shrunk towards the
       rate of all documents; paths within a host, shrunk towards their host's rate.
       Both prior strengths are estimated from all groups, so a site of few documents
       keeps its parent's rate and a large one its own.
    3. ``score``: the classifier's evidence (its odds over the odds of its training
       rows) times the odds of the path. ``kept`` is a score of ``least`` or more.

    Null and empty texts are texts without words. Null hosts and paths are groups of
    their own. Without both kinds of labels the evidence is neutral and everything
    is kept. Repeated rows count each and get equal scores.
    """
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), utf8("text").alias("text"))
    measured = stage(rows.mapInArrow(task(_features), "doc_id long, host string, path string, x array<double>"), "measures")
    usable = labels.filter("quality is not null").filter(fold("doc_id", FOLDS) != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = usable.count()
    spot = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    sample = measured.join(usable.filter(spot < MAX_LABELLED / max(n, 1)), "doc_id").select("x", "quality")
    known = sample.limit(2 * MAX_LABELLED).collect()
    x = np.array([r["x"] for r in known], float).reshape(len(known), len(FEATURES))
    y = np.array([float(r["quality"] == 1) for r in known])
    if 0 < y.sum() < len(y):
        w = fit_logistic(x, y)
        base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    else:
        w, base = np.zeros(len(FEATURES) + 1), 0.5
    z = sum((F.get("x", F.lit(i)) * float(w[i]) for i in range(len(FEATURES))), F.lit(float(w[-1])))
    z = F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))
    docs_z = measured.select("doc_id", "host", "path", z.alias("z")).withColumn("classifier", 1 / (1 + F.exp(-F.col("z"))))
    paths = stage(docs_z.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("classifier").alias("good")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = float(np.clip(total["good"] / total["n"], 1e-6, 1 - 1e-6)) if total["n"] else 0.5
    hosts = stage(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("overall", F.lit(overall)), "hosts")
    shrunk = lambda k, m: (F.col("good") + k * F.col(m)) / (F.col("n") + k)
    rates = stage(hosts.select("host", shrunk(_strength(hosts, "overall"), "overall").alias("host_rate")), "host_rates")
    within = paths.alias("p").join(rates.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", "host_rate")
    within = stage(within, "within")
    sites = stage(within.withColumn("path_rate", shrunk(_strength(within, "host_rate"), "host_rate")), "sites")
    same = F.col("d.host").eqNullSafe(F.col("s.host")) & F.col("d.path").eqNullSafe(F.col("s.path"))
    joined = docs_z.alias("d").join(sites.select("host", "path", "host_rate", "path_rate").alias("s"), same)
    rate = F.least(F.greatest("path_rate", F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = F.col("z") - float(np.log(base / (1 - base))) + F.log(rate / (1 - rate))
    score = 1 / (1 + F.exp(-logit))
    return joined.select("d.doc_id", "classifier", "host_rate", "path_rate", score.alias("score"), (score >= least).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``docs`` without the rejected documents; all columns stay. Rows without id stay."""
    rejected = judge(docs, labels, **how).filter(~F.col("kept")).select("doc_id").distinct()
    return without(docs, stage(rejected, "rejected"))
