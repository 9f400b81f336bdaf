"""Ranked search, Merkle proofs and token counts against plain Python and the tokenizer itself."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import compare, connect
from helpers import SCHEMA, awkward, nothing, prose, row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from planlines.llm import merkle, nra, token_counts
from planlines.session import stage

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return stage(awkward(spark))


@pytest.fixture(scope="module")
def empty(spark):
    return stage(nothing(spark))


@pytest.mark.parametrize("name", ["op11_nra_search", "op12_merkle_manifest"])
def test_sql(spark, name):
    ok, message = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, message


# search


def plain_search(docs, items, k):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    bags = [(d, Counter(TERM.findall((t or "").translate(UPPER)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 75 + 25 * sum(b.values()) * n // length
            score = sum(
                q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 12 * m))
                for t, q in Counter(TERM.findall((text or "").translate(UPPER))).items() if b[t]
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = nra.search(d, spark.createDataFrame(items, "item_id long, text string"), **how)
    return sorted([tuple(r) for r in found.collect()], key=repr)


def test_search_is_exact(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(i, prose(rng, rng.randrange(1, 60), 50)) for i in range(300)] + [(1000 + i, "W1 w2, w1") for i in range(40)] + [(7, None), (8, " .,"), (None, "w1")]
    items = [(i, prose(rng, rng.randrange(1, 25), 60)) for i in range(12)] + [(20, "w1 W1 w2"), (21, None), (22, "nothing here"), (20, "w3")]
    want = plain_search(docs, items, 5)
    assert searched(spark, docs, items, k=5) == want
    for depth, shard in ((1, 40), (3, 7)):  # shallow reads and small shards: bounds decide, floors carry over
        monkeypatch.setattr(nra, "FIRST_DEPTH", depth)
        monkeypatch.setattr(nra, "SHARD_DOCS", shard)
        assert searched(spark, docs, items, k=5) == want
    assert searched(spark, docs, items, k=5, block_terms=10) == want


def test_search_stops_before_the_lists_end():
    """Lists are left unread where no document can still get in, and the best are exact all the same.

    The best hold every term here: without random access a document's lack of a term shows at the list's end only.
    """
    rng = np.random.default_rng(0)
    ids, tfs = [], []
    for d in range(4000):
        mine = np.flatnonzero(rng.random(6) < (0.6 if d >= 10 else 1.1)).astype(np.int32)
        ids.append(mine.tobytes())
        tfs.append((rng.integers(1, 3, len(mine)) if d >= 10 else np.full(len(mine), 50)).astype(np.int32).tobytes())
    shard = nra.Shard([20] * 4000, ids, tfs, np.full(6, 1000), 4000, 80000)
    read = []

    class Spy(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                read.append(at.stop - at.start)
            return np.asarray(self)[at]

    shard.value = shard.value.view(Spy)
    found, scores = shard.best(np.arange(6), np.ones(6, np.int64), 3, 0)
    exact = np.zeros(4000, np.int64)
    for a, b in zip(shard.starts, shard.ends):
        exact[shard.doc[a:b]] += np.asarray(shard.value)[a:b]
    top = np.sort(exact)[-3:]
    assert (scores >= top.min()).all() and set(np.sort(scores)[-3:]) == set(top) and (exact[found] == scores).all()
    assert sum(read) < 0.5 * len(shard.doc)


def test_search_on_awkward_tables(spark, docs, empty):
    items = spark.createDataFrame([(1, "w1 w2 w3"), (2, None), (3, ""), (None, "the"), (4, "a")], "item_id long, text string")
    got = nra.search(docs, items).collect()
    assert {(r["item_id"], r["doc_id"]) for r in got} >= {(4, 4), (4, 5), (None, 13)}
    assert nra.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
    for d, i in ((empty, items), (docs, items.limit(0))):
        none = nra.search(d, i)
        assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


# proofs


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(level):
    """Root and, for each leaf, its sibling digests and their places, level by level."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i in range(len(paths)):
            first = at[i] // 3 * 3
            run = level[first : first + 3]
            paths[i].append((run[: at[i] - first], run[at[i] - first + 1 :]))
            at[i] //= 3
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    def leaf(r, cut):
        text = r["text"].replace("\n", "") if cut and r["text"] is not None else r["text"]
        values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        mine = sorted([r for r in rows if r["source"] == s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, False)))
        trees[s] = (mine, *plain_tree([leaf(r, False) for r in mine]))
    root, tops = plain_tree([trees[s][1] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        mine, subroot, paths = trees[s]
        for r, path in zip(mine, paths):
            now = leaf(r, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0)
            for before, after in path + top:
                now = h(*before, now, *after)
            proof = h(*[d for before, after in path + top for d in before + after])
            out.append((r["doc_id"], leaf(r, False), subroot, root, proof, now, now == root))
    return sorted(out, key=repr)


def proved(docs):
    return sorted([tuple(r) for r in merkle.verify(merkle.manifest(docs)).collect()], key=repr)


def test_proofs_of_trees_of_every_shape(spark):
    rng = random.Random(6)
    rows, at = [], 0
    for s, n in (("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 27), ("f", 28), ("g", 82), ("h", 250), (None, 5), ("é", 9), ("Z", 10)):
        for _ in range(n):
            rows.append(row(at, prose(rng, 3) + rng.choice(["", "\nx", "\n"]), s))
            at += rng.randrange(1, 4)
    docs = spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA).repartition(3)
    got = proved(docs)
    assert got == plain_manifest(docs.collect())
    assert 0 < sum(not r[-1] for r in got) < len(got)
    one = docs.filter("source = 'a'")
    assert proved(one) == plain_manifest(one.collect())
    two = docs.filter("source in ('h', 'a')")
    assert proved(two) == plain_manifest(two.collect())


def test_proofs_on_awkward_tables(spark, docs, empty):
    assert proved(docs) == plain_manifest(docs.collect()) and len(proved(docs)) == docs.count()
    assert proved(empty) == []
    named = docs.withColumn("scope", F.lit("x")).withColumn("path", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("bucket", F.lit(3)).withColumn("order", F.lit(4))
    assert proved(named) == proved(docs)


def test_a_changed_row_is_found(spark):
    docs = spark.createDataFrame([row(i, f"line {i}\nmore", "s") for i in range(40)], SCHEMA)
    for r in merkle.verify(merkle.manifest(docs)).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 2 != 0)


# tokens


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


BITS = [
    "<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "\t", "\r\n", "'s", "'re", "'", "don't", "a", "é", "12", "!!", "\xa0", "　", "\x1c", "\x0b",
    "日本", "🙂", ".", "...", "?!", "a.b", "_", "²", "-", "word", " word", ",",
]


def test_counts_are_the_tokenizers(spark, path, tokenizer):
    rng = random.Random(9)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 400))) for _ in range(150)]
    texts += ["", None, " ", "x" * 5000, " " * 3000, "\n" * 2000 + "y", "<|endoftext|>" * 200, "ab " * 1500, "." * 1000 + " " * 1000 + "z" * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
    for chunk, overlap in ((128, 64), (300, 50), (token_counts.CHUNK, token_counts.OVERLAP)):
        got = token_counts.count(df, path, chunk, overlap).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in got} == want
        assert all(r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) for r in got)


def test_overlaps_are_widened(spark, path, tokenizer):
    text = "some words " * 40 + "q" * 900 + " and " * 50
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    sent = spark.sparkContext.broadcast(definition)
    rows = df.withColumnRenamed("doc_id", "key")
    unsure = token_counts.margin(json.loads(definition))
    first = token_counts.spliced(stage(token_counts._encoded(token_counts._pieces(rows, 128, 64), sent, 128, 64, unsure))).first()
    assert first["missing"] > 0  # no cut within the run of one letter
    assert token_counts.count(df, path, 128, 64).first()["n_tokens"] == len(tokenizer.encode(text))


def test_tokens_on_awkward_tables(spark, docs, empty, path, tokenizer):
    got = token_counts.budget(token_counts.count(docs, path, 1000, 100)).collect()
    want = Counter((r["doc_id"], len(tokenizer.encode(r["text"] or "", add_special_tokens=False))) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want and all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert token_counts.count(empty, path).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        token_counts.count(docs, path, 100, 90)
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.margin({"pre_tokenizer": {"type": "Whitespace"}})


def test_query_counts_every_document(spark, tokenizer):
    got = {r["doc_id"]: r["n_tokens"] for r in entry.queries()["op13_token_counts"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False)) for r in rows}
