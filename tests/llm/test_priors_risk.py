"""Shrunken site rates and the positive-unlabelled risk, recomputed in plain Python."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
from helpers import prose

from planlines.llm import site_quality, toxicity


def test_site_rates_and_scores_by_hand(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        host = rng.choice(["a"] * 8 + ["b"] * 4 + ["c", None])
        good = rng.random() < {"a": 0.9, "b": 0.2}.get(host, 0.5)
        text = prose(rng, 60) if good else "buy now!!! " * rng.randrange(1, 9) + prose(rng, 4)
        rows.append((i, text, host, rng.choice(["x", "x", "y", None])))
        if i % 2:
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r for r in site_quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    sites = defaultdict(list)
    for i, _, host, path in rows:
        sites[host, path].append(got[i]["classifier"])

    def strength(groups):
        """Prior strength from (n, good, parent rate) of the groups."""
        n = sum(g[0] for g in groups)
        square = sum(k * (good / k - m) ** 2 for k, good, m in groups)
        between = (square - sum(m * (1 - m) for _, _, m in groups)) / n
        return min(max(sum(k * m * (1 - m) for k, _, m in groups) / n / between - 1, 1.0), 1e6) if between > 0 else 1e6

    everything = [c for v in sites.values() for c in v]
    overall = sum(everything) / len(everything)
    hosts = defaultdict(lambda: [0, 0.0])
    for (host, _), v in sites.items():
        hosts[host][0] += len(v)
        hosts[host][1] += sum(v)
    k = strength([(n, good, overall) for n, good in hosts.values()])
    host_rate = {h: (good + k * overall) / (n + k) for h, (n, good) in hosts.items()}
    k = strength([(len(v), sum(v), host_rate[h]) for (h, _), v in sites.items()])
    path_rate = {(h, p): (sum(v) + k * host_rate[h]) / (len(v) + k) for (h, p), v in sites.items()}
    logit = lambda q: math.log(q / (1 - q))
    bases = []
    for i, _, host, path in rows:
        r = got[i]
        assert math.isclose(r["host_rate"], host_rate[host], rel_tol=1e-9) and math.isclose(r["path_rate"], path_rate[host, path], rel_tol=1e-9)
        assert r["kept"] == (r["score"] >= 0.5)
        if 1e-9 < r["score"] < 1 - 1e-9 and 1e-9 < r["classifier"] < 1 - 1e-9:
            bases.append(logit(r["classifier"]) + logit(r["path_rate"]) - logit(r["score"]))
    learnt = [q for i, q in labels if zlib.crc32(str(i).encode()) % site_quality.FOLDS]
    assert len(bases) > 100 and np.allclose(bases, logit(sum(learnt) / len(learnt)), atol=1e-5)


def plain_nnpu(positive, unlabelled, useful, prior, steps, batch, seed=5, rate=0.03, decay=1e-4):
    """Dense matrices and the risk written out, one optimiser step for each batch."""
    rng, d = np.random.default_rng(seed), positive.shape[1]
    w, b = np.zeros(d), math.log(prior / (1 - prior))
    m, v, t, climbs = np.zeros(d + 1), np.zeros(d + 1), 0, 0
    parts = max(1, len(unlabelled) // batch)
    risk = lambda p, u, w, b: (
        prior * np.logaddexp(0, -(p @ w + b)).mean(), np.logaddexp(0, u @ w + b).mean() - prior * np.logaddexp(0, p @ w + b).mean()
    )
    while t < steps:
        order_u, order_p = rng.permutation(len(unlabelled)), rng.permutation(len(positive))
        for k in range(min(parts, len(positive))):
            p, u = positive[order_p[k::parts]], unlabelled[order_u[k::parts]]
            climbs += risk(p, u, w, b)[1] < 0

            def objective(w, b):
                toxic, rest = risk(p, u, w, b)
                return toxic + rest if risk(p, u, w0, b0)[1] >= 0 else -rest

            w0, b0, g = w, b, np.zeros(d + 1)
            for j in np.append(np.flatnonzero(useful), d):  # central differences of the objective
                e = np.zeros(d + 1)
                e[j] = 1e-5
                g[j] = (objective(w + e[:-1], b + e[-1]) - objective(w - e[:-1], b - e[-1])) / 2e-5
            g[:-1] += decay * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1] * useful, b - step[-1]
    return w, b, climbs


def test_risk_and_its_correction_step_by_step():
    rng = np.random.default_rng(2)
    d = 30
    p = rng.random((40, d)) < np.where(np.arange(d) < 5, 0.8, 0.1)
    u = rng.random((120, d)) < np.where(np.arange(d) < 5, 0.05, 0.1)
    sparse = lambda x: toxicity.Sparse([np.flatnonzero(r).astype(np.int32) for r in x])
    useful = toxicity._telling(sparse(p), sparse(u))[:d]
    assert set(np.flatnonzero(useful)) == set(range(5))
    for prior in (0.1, 0.6):  # in some steps the second part of the risk is below zero
        w, b = toxicity.fit_nnpu(sparse(p), sparse(u), prior, steps=60, batch=40)
        want, bias, climbs = plain_nnpu(p.astype(float), u.astype(float), useful, prior, 60, 40)
        assert np.allclose(w[:d], want, atol=2e-3) and abs(b - bias) < 2e-3
        assert not w[d:].any() and climbs > 0
