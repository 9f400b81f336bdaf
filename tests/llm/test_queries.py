"""The registered queries on the smallest data folder: against their SQL, else against brute force."""

import base64
import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare, connect
from helpers import words_of

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", ["op1_chat_prefix_targets", "op6_host_rules", "op7_fixed_block_anchors"])
def test_sql(spark, name):
    ok, message = compare(spark, connect(SF), name, QUERIES[name], SQL[name], SF)
    assert ok, message


def test_every_operator_has_one_query():
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
    assert "pipeline" in QUERIES


def test_leaks(spark, docs):
    from planlines.llm import latent

    items = {r["item_id"]: [latent.plain(w) for w in r["text"].encode().split()] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for d, text in docs.items():
        words = [latent.plain(w) for w in (text or "").encode().split()]
        for i, item in items.items():
            if sum(w in set(words) for w in item) >= latent.FOUND * len(item):
                spots = range(0, max(1, len(words)), latent.BLOCK)
                if any(latent.verdict(item, words[a : a + len(item) + 2 * latent.BLOCK])[2] for a in spots):
                    want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in rows(spark, "op3_latent_decontamination")}
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_near_duplicates(spark, docs):
    sets = {}
    for d, text in docs.items():
        w = words_of(text)
        k = min(5, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    root, links = {d: d for d in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows(spark, "op8_minhash_forest")}
    assert got == {d: (find(d), links[d]) for d in sets}


def test_language_model(spark, docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {d: [*words_of((t or "").translate(low)), None] for d, t in docs.items()}
    counts = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = rows(spark, "op5_hidden_markov")
    assert len(got) == len(docs)
    for r in got:
        ws = tokens[r["doc_id"]]
        assert np.isclose(r["base_score"], sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) and r["score"] < 0
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in counts for w in ws), n)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_mix(spark, docs):
    got = rows(spark, "op9_mix_sources")
    assert {r["doc_id"]: r["size"] for r in got} == {d: len(words_of(t)) for d, t in docs.items()}
    size = sum(r["size"] for r in got)
    assert all(r["taken"] <= 2 * r["size"] for r in got) and abs(sum(r["taken"] for r in got) - 1.5 * size) < 0.03 * size
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in rows(spark, "op9_mix_sources")}


def test_archive(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = defaultdict(list)
    for p, html in sorted(pages.items()):
        first[html].append(p)
    for r in rows(spark, "op10_warc_dictionary"):
        html = pages.pop(r["page_id"])
        lead = first[html][0]
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == base64.b32encode(hashlib.sha1(html).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if lead == r["page_id"] else ("revisit", lead))
    assert not pages


def test_classifiers_cover_every_row(spark, docs):
    for name in ("op2_site_quality", "op4_nonnegative_pu"):
        got = rows(spark, name)
        assert sorted(r["doc_id"] for r in got) == sorted(docs) and all(0 <= r["score"] <= 1 for r in got)


def test_pipeline(spark, docs):
    """Every stage's rule holds in the result: near duplicates, repeats and leaks are gone."""
    from planlines.llm import latent

    got = rows(spark, "pipeline")
    assert 0 < len(got) < len(docs) and len({r["doc_id"] for r in got}) == len(got) and all(r["copies"] in (1, 2) for r in got)
    seen, items = {}, [[latent.plain(w) for w in r["text"].encode().split()] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in sorted(got, key=lambda r: r["doc_id"]):
        words = words_of(r["text"])
        if words == words_of(docs[r["doc_id"]]):
            for i in range(len(words) - 49):
                key = tuple(words[i : i + 50])
                assert seen.setdefault(key, r["doc_id"]) == r["doc_id"]
        text = [latent.plain(w.encode()) for w in words]
        assert not any(latent.common(item, text[:4000]) == len(item) and item[0] in text and b" ".join(item) in b" ".join(text) for item in items)
    held = {r["doc_id"] for r in got}
    joined = {r["doc_id"]: r["class_id"] for r in rows(spark, "op8_minhash_forest")}
    both = Counter(joined[d] for d in held)
    assert max(both.values()) == 1
