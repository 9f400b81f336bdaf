"""Methods against brute force, exact round trips and held-out accuracy."""

import glob
import hashlib
import itertools
import os
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import zstandard
from helpers import prose, words_of

from planlines.llm import anchors, chat, forest, hmm, host_rules, latent, mixing, site_quality, texts, toxicity, warc
from planlines.session import scratch_path

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# texts


def test_words_and_hashes():
    text = "a\x0bb\x0c c\td e f\r\n g\x1cx"
    assert [w.decode() for w in text.encode().split()] == words_of(text)
    x = np.arange(100, dtype=np.uint64) % np.uint64(7)
    h = texts.rolling(x, 7)
    assert len(h) == 94 and (h[7:14] == h[:7]).all() and len(set(h.tolist())) == 7
    assert len(texts.rolling(x, 101)) == 0


def test_groups_that_cross_batches():
    import pyarrow as pa

    keys = np.array([1, 1, 2, 2, 2, 2, 2, 3, 4, 4])
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + size]}) for i in range(0, len(keys), size)]
        seen = []
        for table in texts.by_group(batches, ["k"], lambda t: iter([t])):
            seen.append(Counter(table["k"].to_pylist()))
        total = Counter()
        for s in seen:
            assert not set(s) & set(total)  # no group is cut
            total += s
        assert total == Counter(keys.tolist())


# chat


def test_chat_round_trip(spark):
    bits = ["<", "\\", "|", "<|", "end|>", *chat.FOREIGN, chat.OPEN, chat.MIDDLE, chat.CLOSE, "x", "\n", "é", "[", "INST]", "s>", "$1"]
    rng = random.Random(1)
    rows, want = [], {}
    for c in range(60):
        turns = [(c, t, rng.choice(["user", "assistant", "<|end|>"]), "".join(rng.choices(bits, k=rng.randrange(8)))) for t in range(rng.randrange(1, 6))]
        rows += turns
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        want[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    rng.shuffle(rows)
    examples = chat.prefix_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r[0]: tuple(r)[1:5] for r in chat.digests(examples).collect()}
    assert got == want
    for r in examples.collect():
        assert r["formatted"].count(chat.CLOSE) == r["last_turn"] + 1
        assert r["formatted"][r["loss_end"] :] == chat.CLOSE


# quality


def test_site_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    judged = site_quality.judge(docs, labels).join(labels, "doc_id").filter(texts.fold("doc_id", site_quality.FOLDS) == 0)
    rows = judged.collect()
    assert rows and np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) > 0.9


def test_sparse_sites_keep_the_parents_rate(spark):
    rows = [(i, "good words here " * 5, "big", "a") for i in range(200)] + [(1001, "##!! " * 30, "tiny", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(150)] + [(1001, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in site_quality.judge(docs, labels).collect()}
    assert got[0]["host_rate"] > 0.9 and got[1001]["host_rate"] > 0.02  # one bad document does not make a bad site


# decontamination


def test_common_subsequence():
    rng = random.Random(2)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for _ in range(200):
        a, b = ([bytes([rng.randrange(97, 102)]) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        assert latent.common(a, b) == plain(a, b)


def test_leaks_and_paraphrases(spark):
    rng = random.Random(3)
    item = {i: prose(rng, 20 + 5 * i).split() for i in range(12)}
    rows, want = [], set()
    for d in range(240):
        words = prose(rng, rng.randrange(30, 400)).split()
        if d % 4 == 0:
            i = rng.randrange(12)
            leak = [w if rng.random() > 0.15 or d % 8 else "other" for w in item[i]]
            at = rng.randrange(len(words))
            words[at:at] = leak
            want |= {(d, i)} if latent.verdict([w.encode() for w in item[i]], [w.encode() for w in leak])[2] else set()
        rows.append((d, " ".join(words)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in item.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent.find(frame(spark, rows), bench).collect()}
    assert len(want & got) >= 0.9 * len(want) and len(want) > 50 and not got - want


def test_long_items_and_all_benchmark_passages(spark):
    rng = random.Random(13)
    item = {i: prose(rng, n).split() for i, n in enumerate((30, 60, 300, 700, 1500))}
    rows = [(d, prose(rng, rng.randrange(30, 2500))) for d in range(60)]
    for i, words in item.items():
        rows.append((100 + i, " ".join([*prose(rng, 101).split(), *words, *prose(rng, 90).split()])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in item.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent.find(frame(spark, rows), bench).collect()}
    assert got == {(100 + i, i) for i in item}
    many = spark.range(2 * latent.SAMPLE_PASSAGES + 100).selectExpr("id AS doc_id", "'a b' AS text")
    assert latent.sample_passages(many, 0).count() == 2 * latent.SAMPLE_PASSAGES + 100


def test_latent_space_is_that_of_an_exact_svd(spark):
    rng = np.random.default_rng(0)
    groups = [rng.choice(latent.SLOTS, 30, replace=False) for _ in range(4)]
    packed = [rng.choice(groups[i % 4], 40).astype(np.int32) for i in range(200)]
    idf = np.ones(latent.SLOTS)
    sample = spark.createDataFrame([(bytearray(p.tobytes()),) for p in packed], "slots binary")
    v = latent.latent_space(sample, idf, dims=12)
    x = np.zeros((200, latent.SLOTS))
    for i, p in enumerate(packed):
        np.add.at(x[i], p, 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    angles = np.linalg.svd(vt[:4] @ np.linalg.qr(v)[0], compute_uv=False)  # the four topics
    assert angles.min() > 0.999


# toxicity


def test_toxicity_held_out(spark):
    rng, rows, labels = random.Random(5), [], []
    for d in range(1500):
        words = prose(rng, rng.randrange(20, 120), 800).split()
        toxic = d % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Idiot!", "scum", "loweist", "loweien", "loweiung"]))
        rows.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    got = toxicity.score(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 200 and np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in held]) > 0.97


def test_labels_of_the_held_out_part_change_nothing(spark):
    rng = random.Random(6)
    rows = [(d, prose(rng, 30, 50) + (" scum" if d % 5 == 0 else "")) for d in range(300)]
    right = spark.createDataFrame([(d, int(d % 5 == 0)) for d in range(300)], "doc_id long, toxic int")
    held = texts.fold("doc_id", toxicity.FOLDS) == 0
    from pyspark.sql import functions as F

    wrong = right.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, rows), x).collect()} for x in (right, wrong))
    assert one == two


# language model


def small_model(seed=1):
    rng = np.random.default_rng(seed)
    emit = np.full((hmm.STATES, hmm.SYMBOLS), 1e-9)
    emit[:, :4] = rng.random((hmm.STATES, 4))
    return hmm.Model(rng.random(hmm.STATES), rng.random(hmm.STATES), rng.random((hmm.STATES, hmm.STATES)), emit)


def by_paths(model, text):
    total = 0.0
    for path in itertools.product(range(hmm.STATES), repeat=len(text)):
        p = model.start[path[0]]
        for t, s in enumerate(path):
            p *= model.emit[s, text[t]] * (model.move[path[t - 1], s] if t else 1)
        total += p
    return np.log(total)


def test_forward_recursion_sums_all_paths():
    model = small_model()
    some = [np.array(t, np.int16) for t in ([0], [1, 2], [3, 0, 1, 1], [2, 2, 2], [0, 1, 2, 3, 0])]
    assert np.allclose(hmm.log_likelihoods(model, some), [by_paths(model, t) for t in some])
    long = np.random.default_rng(0).integers(0, 4, 5000).astype(np.int16)
    assert np.isfinite(hmm.log_likelihoods(model, [long, some[0]])).all()


def test_expected_counts_raise_the_likelihood():
    model, rng = small_model(), np.random.default_rng(3)
    some = [rng.integers(0, 4, rng.integers(1, 100)).astype(np.int16) for _ in range(50)]
    counts, total, tokens = hmm.expected(model, some)
    assert tokens == sum(map(len, some)) and np.isclose(total, hmm.log_likelihoods(model, some).sum())
    assert np.isclose(counts[2 * hmm.STATES + hmm.STATES**2 :].sum(), tokens)
    assert np.isclose(counts[2 * hmm.STATES : 2 * hmm.STATES + hmm.STATES**2].sum(), tokens - len(some))
    better = hmm.Model.of_counts(counts * 1e5)  # so that the smoothing weighs nothing
    assert hmm.log_likelihoods(better, some).sum() > total


def test_language_model_scores(spark):
    rng = random.Random(7)
    rows = [(d, prose(rng, rng.randrange(1, 60), 300 if d % 2 else 40)) for d in range(400)]
    got = {r["doc_id"]: r for r in hmm.score(frame(spark, rows)).collect()}
    import zlib

    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    counts = Counter(w for d, t in rows if not held[d] for w in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    for d, t in rows:
        tokens = [*t.split(), None]
        assert np.isclose(got[d]["base_score"], sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["held_out"]) == (len(tokens), sum(w in counts for w in tokens), held[d])
    unseen = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


# host rules


def test_host_verdicts(spark):
    bad, good = "same words again " * 60, lambda k: " ".join(f"v{k}x{i}" for i in range(60))
    rows = [(i, good(i), "fine") for i in range(300)] + [(1000 + i, bad if i % 10 else good(i), "farm") for i in range(300)] + [(5000, bad, "once")]
    got = {r["doc_id"]: r for r in host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["kept"] and not got[1000]["host_kept"] and not got[1000]["kept"] and not got[1000]["base_failed"]
    assert got[5000]["host_rate"] < 1 and got[1001]["n_repeat_words"] == 180


def test_host_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = host_rules.text_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# substring dedup


def test_repeats_against_brute_force(spark):
    rng = random.Random(8)
    shared = [prose(rng, n, 300).split() for n in (49, 50, 51, 75, 130, 60)]
    rows = []
    for d in range(150):
        words = prose(rng, rng.randrange(0, 160), 300).split()
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) - 40)
            at = rng.randrange(len(words) + 1)
            words[at:at] = s[a:] if rng.random() < 0.3 else s
        rows.append((d, " ".join(words)))
    rows += [(200 + d, rows[d][1]) for d in range(0, 150, 7)]
    ids = [d for d, _ in rows]
    rng.shuffle(ids)
    rows = [(i, t) for i, (_, t) in zip(ids, rows)]
    first = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    want = {}
    for d, t in rows:
        w, gone = t.split(), set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[d] = (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in anchors.removals(frame(spark, rows)).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 2000


# near duplicates


def test_join_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for g in range(25):
        base = prose(rng, rng.randrange(5, 200)).split()
        for _ in range(rng.randrange(1, 6)):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    base = prose(rng, 300).split()
    for _ in range(300):  # a group that spreads over several blocks
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(300)] = f"e{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(words)))
    sets = {}
    for d, t in rows:
        w = t.split()
        k = min(5, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    root, links = {d: d for d in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in forest.join(frame(spark, rows)).collect()}
    assert got == {d: (find(d), links[d]) for d in sets}


def test_prefix_length_meets_the_recall():
    d = forest.prefix_length()
    assert 1 - (1 - 0.8**d) ** forest.TREES >= forest.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** forest.TREES


# language model without frequent words


def test_end_is_known_without_frequent_words(spark, monkeypatch):
    rng = random.Random(8)
    docs = frame(spark, [(d, prose(rng, 20)) for d in range(30)])
    read = lambda: {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in hmm.score(docs).collect()}
    want = read()
    monkeypatch.setattr(hmm, "FREQUENT", 0)
    assert read() == want


# mixing


def test_targets_against_rounds(spark):
    rng = random.Random(10)
    names = [None, "ä", "a", "Z", *[f"s{i}" for i in range(9)]]
    sizes = {s: rng.choice([0, 5, 100, 2000, 9000]) for s in names}
    table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    order = sorted((s for s in names if s is not None)) + [None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    assert got.keys() == target.keys() and all(np.isclose(got[s], target[s]) for s in target)


def test_mix_is_near_its_targets_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    one = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    two = {r["doc_id"]: r for r in mixing.mix(docs.repartition(7)).collect()}
    assert {k: v["copies"] for k, v in one.items()} == {k: v["copies"] for k, v in two.items()}
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in one.values():
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["copies"] <= 2
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert abs(sum(taken.values()) - sum(target.values())) < 0.02 * sum(target.values())


def test_flight_keeps_totals_and_chances():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = rng.integers(0, 60)
        s = np.sort(rng.integers(0, rng.integers(1, 2000), n))[::-1].astype(float)
        p = np.full(n, rng.random())
        x = mixing._flight(s, p, rng, False)
        assert ((x > 0) & (x < 1)).sum() <= 2 and np.isclose(x @ s, p @ s) and np.isclose(x.sum(), p.sum())
        assert set(mixing._flight(s, p, rng, True)) <= {0.0, 1.0}
    mean = np.mean([mixing._flight(np.array([9, 7, 5, 3, 3, 2, 1.0]), np.full(7, 0.3), rng, False) for _ in range(4000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.03


# archives


def test_archive_files_are_plain_zstandard(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    path = scratch_path(spark, "warc-test")
    warc.write_archive(pages, path)
    files = [f for f in glob.glob(f"{path.removeprefix('file:')}/part-*") if os.path.getsize(f)]
    records = 0
    for f in files:
        data = open(f, "rb").read()
        magic, n = struct.unpack_from("<II", data)
        assert magic == warc.DICT_MAGIC  # the dictionary leads, in a skippable frame
        trained = zstandard.ZstdDecompressor().decompress(data[8 : 8 + n])
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained)).stream_reader(data, read_across_frames=True)
        text = reader.read()
        records += text.count(b"WARC/1.1\r\nWARC-Type: ")
    assert records == pages.count()
    back = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archive(spark, path).collect()}
    assert back == {r["page_id"]: r["html"] for r in pages.collect()}
