"""Toxicity scores from positive and unlabelled text, trained with a non-negative risk estimator."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlines.llm.texts import CACHE_WORDS, fold, slices, utf8
from planlines.session import stage

LETTERS = re.compile(r"[^\W\d_]+")
#: Slots of the hashed features: words, and their first four and five letters.
BITS = 18
#: Most confirmed toxic and most unlabelled texts that the classifier is fitted on.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 12000
FOLDS = 5


class _Features(dict):
    """word -> row of ``table`` with its three slots; forgets all when it holds too many."""

    def __init__(self) -> None:
        super().__init__()
        self.table = np.zeros((1024, 3), np.int32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        slots = (xxhash.xxh3_64_intdigest(f"{k}{w}") & ((1 << BITS) - 1) for k, w in ((0, word), (4, word[:4]), (5, word[:5])))
        self.table[at] = list(slots)
        self[word] = at
        return at

    def of(self, text: bytes) -> np.ndarray:
        """Distinct slots of all words of the text, letters only, in lower case."""
        words = set(LETTERS.findall(text.decode("utf-8", "replace").lower()))
        if len(self) > CACHE_WORDS:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.unique(self.table[rows])


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Features()
    for batch in batches:
        packed = [known.of(t.as_py()).astype(np.int32).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(packed, pa.binary())], ["positive", "slots"])


class Sparse:
    """Rows of active slots."""

    def __init__(self, rows: list[np.ndarray]):
        self.at = np.cumsum([0, *map(len, rows)])
        self.slots = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32)

    def take(self, rows: np.ndarray) -> Sparse:
        return Sparse([self.slots[self.at[r] : self.at[r + 1]] for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(w[self.slots])])
        return total[self.at[1:]] - total[self.at[:-1]]

    def grad(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.slots, np.repeat(g, np.diff(self.at)), 1 << BITS)


def _telling(positive: Sparse, unlabelled: Sparse, least: int = 4, deviations: float = 4.0) -> np.ndarray:
    """Slots clearly more common in confirmed toxic text than in unlabelled text.

    Only these get weights: with few toxic examples, the many words they share with
    nothing else would separate them by heart.
    """
    n_p, n_u = len(positive.at) - 1, len(unlabelled.at) - 1
    in_p = np.bincount(positive.slots, minlength=1 << BITS)
    usual = (np.bincount(unlabelled.slots, minlength=1 << BITS) + 1) / (n_u + 2)
    return (in_p >= least) & (in_p / n_p - usual > deviations * np.sqrt(usual * (1 - usual) / n_p))


def fit_nnpu(
    positive: Sparse, unlabelled: Sparse, prior: float, steps: int = 400, batch: int = 1000, rate: float = 0.03, decay: float = 1e-4,
    seed: int = 5,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier that minimises the non-negative PU risk.

    With logistic loss l, the risk is prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]):
    the unlabelled text stands for negatives once the share of toxic text in it is
    taken off. Where a batch drives the second part below zero, the step climbs out of
    it instead (the correction that keeps a flexible model from overfitting).
    """
    rng = np.random.default_rng(seed)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)
    useful = _telling(positive, unlabelled)
    w, b = np.zeros(1 << BITS), float(np.log(prior / (1 - prior)))
    m, v, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    n_p, n_u = len(positive.at) - 1, len(unlabelled.at) - 1
    parts = max(1, n_u // batch)
    while t < steps:
        order_u, order_p = rng.permutation(n_u), rng.permutation(n_p)
        for k in range(min(parts, n_p)):
            p, u = positive.take(order_p[k::parts]), unlabelled.take(order_u[k::parts])
            fp, fu = p.dot(w) + b, u.dot(w) + b
            rest = loss(-fu).mean() - prior * loss(-fp).mean()
            gp_toxic = -prior * sigmoid(-fp) / len(fp)
            gp_clean, gu = -prior * sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)
            gp, gu = (gp_toxic + gp_clean, gu) if rest >= 0 else (-gp_clean, -gu)
            g = np.append((p.grad(gp) + u.grad(gu)) * useful, gp.sum() + gu.sum())
            g[:-1] += decay * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1] * useful, b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fit on documents whose fold is not 0; see ``score``."""
    usable = labels.filter("toxic is not null").filter(fold("doc_id", FOLDS) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = stage(usable, "labels")
    count = usable.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("p")).first()
    if not count["p"]:
        return np.zeros(1 << BITS), -5.0
    prior = min(max(count["p"] / count["n"], 1e-4), 0.9)
    spot = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    again = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
    toxic = usable.filter("toxic = 1").filter(spot < MAX_POSITIVE / count["p"]).limit(2 * MAX_POSITIVE)
    mixed = usable.filter(again < MAX_UNLABELLED / count["n"]).limit(2 * MAX_UNLABELLED)
    chosen = toxic.select("doc_id", F.lit(True).alias("positive")).unionByName(mixed.select("doc_id", F.lit(False).alias("positive")))
    # at most 2 * (MAX_POSITIVE + MAX_UNLABELLED) ids, so they may go everywhere
    texts = docs.select("doc_id", utf8("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("positive", "text")
    rows = texts.mapInArrow(_featurize, "positive boolean, slots binary").collect()
    rows.sort(key=lambda r: (r["positive"], bytes(r["slots"])))
    sides = [[np.frombuffer(r["slots"], np.int32) for r in rows if r["positive"] == s] for s in (True, False)]
    if not all(sides):
        return np.zeros(1 << BITS), -5.0
    return fit_nnpu(Sparse(sides[0]), Sparse(sides[1]), prior)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs (doc_id, text)``.

    The classifier sees text alone: hashed words and word beginnings, present or
    not. It learns from at most MAX_POSITIVE documents that ``labels`` calls toxic
    and at most MAX_UNLABELLED labelled documents taken as unlabelled text, all with
    crc32 of the id not divisible by FOLDS; the class prior is the share of toxic
    rows among all labels of that part. Documents with several labels are toxic if
    one says so. Null and empty texts get the score of a text without words. Without
    any toxic label every score is low. Repeated rows get equal scores.
    """
    w, b = train(docs, labels)
    weights = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features()
        for whole in batches:
            for batch in slices(whole, "text"):
                z = np.array([weights.value[known.of(t.as_py())].sum(dtype=np.float64) + b for t in batch.column("text")], float)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p)], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), utf8("text").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
