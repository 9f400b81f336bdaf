"""Every operator on the awkward and on the empty table: defined rows, no crash."""

from collections import Counter

import pytest
from helpers import awkward, nothing, words_of
from pyspark.sql import functions as F

import corpus_pipeline
from planlines.llm import anchors, chat, forest, hmm, host_rules, latent, mixing, site_quality, toxicity, warc
from planlines.session import stage


@pytest.fixture(scope="module")
def docs(spark):
    return stage(awkward(spark))


@pytest.fixture(scope="module")
def empty(spark):
    return stage(nothing(spark))


def labels(spark, rows=((1, 1, 0), (4, 0, 1), (7, 1, 0), (13, 0, 1), (13, 0, 1), (None, 1, 1), (8, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def items(spark, rows=((1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (2, None), (3, ""), (None, "x y z"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_chat(spark, docs):
    odd = spark.createDataFrame(
        [(1, None, None, None, "z"), (1, 0, "user", "<s>", "z"), (1, 0, "user", "<s>", "z"), (1, 0, "assistant", r"<\s> [INST]", "z"),
         (2, 3, "assistant", "", "z"), (2, 3, "assistant", None, "z"), (3, 0, "user", "<|end|>", "z"), (None, 1, "assistant", "x" * 100000, "z"),
         (None, 0, "user", None, "z")],
        "conv_id long, turn long, role string, text string, turns string",
    )
    got = {r["conv_id"]: r for r in chat.digests(chat.prefix_examples(odd)).collect()}
    assert {k: v["n_turns"] for k, v in got.items()} == {1: 4, 2: 2, 3: 1, None: 2}
    assert {k: v["loss_chars"] for k, v in got.items()} == {1: 11, 2: 0, 3: 0, None: 100000}
    assert chat.prefix_examples(odd.limit(0)).count() == 0


def test_site_quality(spark, docs, empty):
    got = site_quality.judge(docs, labels(spark)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert site_quality.judge(empty, labels(spark)).count() == 0
    neutral = site_quality.judge(docs, labels(spark, [(1, 1, 0)])).collect()
    assert all(r["kept"] for r in neutral)
    kept = site_quality.keep(docs, labels(spark))
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 2


def test_latent(spark, docs, empty):
    assert latent.find(docs, items(spark)).count() == 0
    assert latent.find(empty, items(spark)).count() == 0
    assert latent.find(docs, items(spark).limit(0)).count() == 0
    assert latent.clean(docs, items(spark)).count() == docs.count()


def test_toxicity(spark, docs, empty):
    got = toxicity.score(docs, labels(spark)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert toxicity.score(empty, labels(spark)).count() == 0
    none = toxicity.score(docs, labels(spark, [(1, 1, 0), (7, 1, 0)])).collect()
    assert all(r["score"] < 0.5 for r in none)


def test_hmm(spark, docs, empty):
    got = hmm.score(docs).collect()
    assert len(got) == docs.count() and all(r["score"] <= 0 and r["base_score"] <= 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert hmm.score(empty).count() == 0


def test_host_rules(spark, docs, empty):
    got = host_rules.judge(docs).collect()
    assert len(got) == docs.count() and host_rules.judge(empty).count() == 0
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n_words"] == 0 and by_id[1]["base_failed"] and not by_id[1]["kept"]
    assert by_id[13]["n_repeat_words"] == 200 and by_id[7]["n_words"] == 30000


def test_anchors(spark, docs, empty):
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in anchors.removals(docs).collect()]
    assert len(got) == docs.filter("doc_id is not null").count()
    assert {(9, 150, 80), (10, 80, 80), (11, 80, 80), (8, 150, 0), (1, 0, 0)} <= set(got)
    assert anchors.removals(empty).count() == 0
    left = anchors.dedup(docs)
    assert left.columns == docs.columns and left.filter("doc_id in (10, 11)").count() == 0 and left.filter("doc_id is null").count() == 2
    assert len(words_of(left.filter("doc_id = 9").first()["text"])) == 70 and left.filter("doc_id = 1").count() == 1
    assert anchors.dedup(empty).count() == 0


def test_forest(spark, docs, empty):
    got = {r["doc_id"]: r for r in forest.join(docs).collect()}
    assert len(got) == 16
    assert (got[5]["class_id"], got[5]["n_links"]) == (4, 1) and got[14]["class_id"] == 6
    assert (got[1]["class_id"], got[1]["n_links"]) == (1, 0) and (got[2]["class_id"], got[3]["n_links"]) == (2, 0)
    assert got[11]["copy_id"] == 10 and forest.join(empty).count() == 0
    left = forest.dedup(docs)
    assert left.columns == docs.columns and left.filter("doc_id = 10").count() == 1 and left.filter("doc_id in (5, 11, 14)").count() == 0
    assert left.filter("doc_id is null").count() == 2


def test_repeated_ids_lose_no_text(spark):
    rng_a, rng_b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, rng_a), (2, rng_a), (2, None), (5, rng_a), (5, rng_b), (5, rng_b), (7, rng_b), (None, rng_b), (9, "c d e f g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = {r["doc_id"]: r["n_links"] for r in forest.join(docs).collect()}
    assert links[1] >= 1 and links[2] >= 1  # the null row of 2 does not hide its text
    got = Counter(tuple(r) for r in forest.dedup(docs).collect())
    assert got == Counter([(1, rng_a), (2, None), (5, rng_b), (None, rng_b), (9, "c d e f g h")])


def test_columns_of_any_name(spark, docs):
    names = ["_pf_bits", "_pf_bucket", "_pf_spot", "_PF_byte", "_id", "_sha", "_kept", "_cut", "_text", "__pf_left"]
    odd = docs.select("*", *[F.lit(f"v{i}").alias(n) for i, n in enumerate(names)])
    for work in (anchors.dedup, forest.dedup, lambda d: latent.clean(d, items(spark)), lambda d: site_quality.keep(d, labels(spark))):
        want, got = work(docs), work(odd)
        assert got.columns == odd.columns
        assert Counter(tuple(r) for r in got.drop(*names).collect()) == Counter(tuple(r) for r in want.collect())
        assert {tuple(r) for r in got.select(*names).collect()} == {tuple(f"v{i}" for i in range(len(names)))}


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and mixing.mix(empty).count() == 0
    assert all(0 <= r["copies"] <= 2 for r in got) and {r["source"] for r in got} == {"s", None}
    assert mixing.mix(docs.filter("doc_id in (1, 2)")).count() == 2


def test_mixture_keeps_rows(spark, docs, empty):
    got = corpus_pipeline.mixture(spark, docs, "").collect()
    chosen = [r for r in mixing.mix(docs).collect() if r["copies"] > 0]
    count = lambda rows: Counter((r["doc_id"], r["source"], r["copies"]) for r in rows)
    assert count(got) == count(chosen) and {r["doc_id"] for r in got} >= {None, 10}
    had = Counter(tuple(r) for r in docs.drop("copies").collect())
    assert not Counter(tuple(r)[:-1] for r in got) - had and all(r["copies"] <= 2 for r in got)
    named = docs.withColumn("MIX_row", F.lit(3))
    left = mixing.mixed_documents(named)
    assert left.columns == [c for c in named.columns if c != "copies"] + ["copies"] and left.filter("MIX_row = 3").count() == len(got)
    assert mixing.mixed_documents(empty).count() == 0


def test_warc(spark):
    odd = spark.createDataFrame(
        [(3, "u", "x", 1), (1, None, "x", 1), (2, "u\r\nz", None, 1), (5, "", "", 1), (None, "q", "x", 1), (7, "w", "é" * 200000, 1), (9, "w", "a\r\n\r\nb", 1)],
        "page_id long, url string, html string, sha long",
    )
    got = {r["page_id"]: r for r in warc.archived(odd).collect()}
    assert {k: (v["record_type"], v["refers_to"]) for k, v in got.items()} == {
        1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 5: ("revisit", 2), 7: ("response", None), 9: ("response", None),
        None: ("response", None),
    }
    assert bytes(got[9]["payload"]) == b"a\r\n\r\nb" and got[7]["payload_bytes"] == 400000
    assert warc.archived(odd.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.archived(odd, min_payload=10**6).collect()} == {"response"}


def test_warc_dictionary_of_many_pages(spark):
    pages = spark.range(300).selectExpr("id AS page_id", "concat('u', id) AS url", "repeat(concat('page ', id, ' '), 40) AS html")
    few = warc.train_dictionary(pages, 300)
    assert len(few) > 1000
    for n in ((1 << 23) + 1, 1 << 33):
        assert warc.train_dictionary(pages, n)  # the rows stand for n, of which about 400 are drawn


def test_pipeline_stages(spark, docs, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    at = docs
    for name, work in corpus_pipeline.STAGES[:-1]:
        at = stage(work(spark, at, str(tmp_path)), name)
        assert at.columns == docs.columns, name
