"""Hidden Markov language model: Baum-Welch over all partitions, exact scores by the scaled forward recursion."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlines.llm.texts import CACHE_WORDS, fold, slices, utf8
from planlines.session import stage

FOLDS, HELD_OUT = 7, 2
#: Hidden states; symbols for single words (the last is the end); classes for all other words.
STATES, SINGLE, CLASSES = 8, 8192, 2048
SYMBOLS = SINGLE + CLASSES
#: Most words whose counts go to every task; the others meet their counts in a join.
FREQUENT = 1 << 18
#: Tokens of a training segment.
SEGMENT = 128
#: Documents of the start values, and the most tokens of one; training ends when a round gains less (nats a token), or after so many.
START_DOCS, START_TOKENS, START_ROUNDS, GAIN, ROUNDS = 400, 4000, 20, 0.005, 8
#: Added to expected emissions and transitions.
SMOOTH = 0.05
END = -1  # hash of the end token, as a signed number
_SCALE = float(1 << 20)


def word_class(word: bytes) -> int:
    """Class of words without a symbol of their own: by their last three bytes."""
    return SINGLE + zlib.crc32(word[-3:]) % CLASSES


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & 0x7FFFFFFFFFFFFFFF


def word_counts(docs: DataFrame) -> DataFrame:
    """``h, class, c``: tokens of all ``docs`` by the hash of the word, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = list(counter)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([END if w == b" " else _hash(w) for w in words], pa.int64()),
                    pa.array([-1 if w == b" " else word_class(w) for w in words], pa.int32()),
                    pa.array([counter[w] for w in words], pa.int64()),
                ],
                ["h", "class", "c"],
            )
            counter.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                counter.update(text.as_py().lower().split())
                counter[b" "] += 1  # no word holds a blank
                if len(counter) > CACHE_WORDS:
                    yield flush()
        yield flush()

    parts = docs.select(utf8("text").alias("text")).mapInArrow(run, "h long, class int, c long")
    return parts.groupBy("h", "class").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Counts of the frequent words, symbols of the most frequent, and totals of the classes: of fixed size."""

    def __init__(self, counts: DataFrame):
        totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.distinct = int(totals["n"] or 0), int(totals["v"])
        level = F.floor(F.log2("c") * 8)
        steps = sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"])
        least, total = None, 0
        for r in steps:
            total += r["count"]
            if total > FREQUENT:
                break
            least = r["level"]
        rows = counts.filter(level >= least).select("h", "c").toArrow() if least is not None else None
        h = rows["h"].to_numpy() if rows else np.empty(0, np.int64)
        c = rows["c"].to_numpy() if rows else np.empty(0, np.int64)
        end = counts.filter(F.col("h") == END).select("c").first()
        if end and END not in h:  # it never meets its count in the join
            h, c = np.append(h, END), np.append(c, end["c"])
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        words = np.flatnonzero(self.h != END)
        top = words[np.lexsort((self.h[words], -self.c[words]))][: SINGLE - 1]
        self.symbol = np.full(len(self.h), -1, np.int32)
        self.symbol[top] = np.arange(len(top))
        self.symbol[self.h == END] = SINGLE - 1
        marks = counts.sparkSession.createDataFrame([(int(x),) for x in self.h[top]], "h long")
        rest = counts.filter(F.col("h") != END).join(F.broadcast(marks), "h", "left_anti")  # at most SINGLE rows
        self.class_total = np.zeros(SYMBOLS)
        self.class_total[SINGLE:] = 1.0
        for r in rest.groupBy("class").agg((F.sum("c") + F.count("*")).alias("n")).collect():
            self.class_total[r["class"]] += r["n"]
        self.class_log = np.where(self.class_total > 0, np.log10(np.maximum(self.class_total, 1.0)), 0.0)


class _Codes(dict):
    """word -> row of growing tables: count of a frequent word or -1, hash, symbol; forgets all when it holds too many."""

    def __init__(self, h: np.ndarray, c: np.ndarray, symbol: np.ndarray):
        super().__init__()
        self.known, self.counts, self.symbols = h, c, symbol
        self.c, self.h, self.s = [], [], []
        self[b" "] = self._add(END, SINGLE - 1)

    def _add(self, h: int, symbol: int) -> int:
        at = int(np.searchsorted(self.known, h))
        found = at < len(self.known) and self.known[at] == h
        own = int(self.symbols[at]) if found else -1
        self.c.append(int(self.counts[at]) if found else (0 if h == END else -1))
        self.h.append(h)
        self.s.append(own if own >= 0 else symbol)
        return len(self.h) - 1

    def __missing__(self, word: bytes) -> int:
        at = self[word] = self._add(_hash(word), word_class(word))
        return at

    def reset(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.c, self.h, self.s = [], [], []
            self[b" "] = self._add(END, SINGLE - 1)


ENCODED = (
    "doc_id long, held_out boolean, n_tokens long, known long, all_log double, class_log double, symbols binary, rare binary, times binary"
)


def _encode(send):
    """Task: symbols of each text, sums over its frequent words, and its other words' hashes with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(*send.value)
        for whole in batches:
            for batch in slices(whole, "text", 3 << 20):
                codes.reset()
                texts = [t.as_py().lower().split() for t in batch.column("text")]
                x = [np.fromiter(map(codes.__getitem__, [*w, b" "]), np.int64, len(w) + 1) for w in texts]
                c, h, s = np.array(codes.c), np.array(codes.h, np.int64), np.array(codes.s, np.int16)
                logs = np.log10(np.maximum(c, 0) + 1.0)
                in_class = s >= SINGLE
                out = []
                for a in x:
                    rare, times = np.unique(h[a[c[a] < 0]], return_counts=True)
                    out.append((
                        len(a), int((c[a] > 0).sum()), float(logs[a].sum()), float(logs[a[in_class[a]]].sum()), s[a].tobytes(),
                        rare.tobytes(), times.astype(np.int32).tobytes(),
                    ))
                cols = list(zip(*out)) or [[]] * 7
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), *(pa.array(v, t) for v, t in zip(cols, kinds))],
                    ["doc_id", "held_out", "n_tokens", "known", "all_log", "class_log", "symbols", "rare", "times"],
                )

    return run


def _unpack_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(b.as_py()) // 8 for b in batch.column("rare")]
        h = np.frombuffer(b"".join(b.as_py() for b in batch.column("rare")), np.int64)
        times = np.frombuffer(b"".join(b.as_py() for b in batch.column("times")), np.int32)
        rid = np.repeat(batch.column("rid").to_numpy(), n)
        yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(h), pa.array(times)], ["rid", "h", "times"])


class Model:
    """Start, middle (of segments that continue a text), transition and emission probabilities."""

    def __init__(self, start, middle, move, emit):
        unit = lambda x: x / x.sum(axis=-1, keepdims=True)
        self.start, self.middle, self.move, self.emit = unit(start), unit(middle), unit(move), unit(emit)

    @staticmethod
    def guess(seen: np.ndarray, seed: int = 17) -> Model:
        rng = np.random.default_rng(seed)
        flat = np.full(STATES, 1.0)
        emit = (seen + 1.0) * rng.gamma(2.0, 0.5, (STATES, SYMBOLS))
        return Model(flat, flat, np.full((STATES, STATES), 1.0) + 4 * np.eye(STATES), emit)

    @staticmethod
    def of_counts(counts: np.ndarray) -> Model:
        k = STATES
        start, middle, move = counts[:k] + SMOOTH, counts[k : 2 * k] + SMOOTH, counts[2 * k : 2 * k + k * k].reshape(k, k) + SMOOTH
        return Model(start, middle, move, counts[2 * k + k * k :].reshape(k, SYMBOLS) + SMOOTH)


#: Length of a vector of expected counts, and of the same with the log likelihood at its end.
COUNTS = 2 * STATES + STATES * STATES + STATES * SYMBOLS


def expected(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, float, int]:
    """Expected counts of one Baum-Welch round over ``texts``, their log likelihood and tokens.

    Texts are cut into segments of SEGMENT tokens that run side by side, each scaled
    step by step; a segment that continues a text starts from the middle
    distribution.
    """
    counts = np.zeros(COUNTS)
    pieces = [(t[a : a + SEGMENT], a == 0) for t in texts for a in range(0, len(t), SEGMENT)]
    pieces.sort(key=lambda p: -len(p[0]))
    total, tokens = 0.0, 0
    table = np.ascontiguousarray(model.emit.T)
    for at in range(0, len(pieces), 2048):
        part = pieces[at : at + 2048]
        size = np.array([len(p) for p, _ in part])
        x = np.zeros((size[0], len(part)), np.int64)
        for i, (p, _) in enumerate(part):
            x[: len(p), i] = p
        first = np.array([f for _, f in part])
        steps = [int((size > t).sum()) for t in range(size[0])]
        emits, alphas, scales = [], [], []
        for t, n in enumerate(steps):
            b = table[x[t, :n]]
            a = b * (np.where(first[:, None], model.start, model.middle) if t == 0 else alphas[-1][:n] @ model.move)
            s = a.sum(axis=1)
            alphas.append(a / s[:, None])
            emits.append(b)
            scales.append(s)
            total += float(np.log(s).sum())
        move = np.zeros((STATES, STATES))
        beta = np.ones((steps[-1], STATES))
        gammas = [None] * len(steps)
        for t in range(len(steps) - 1, -1, -1):
            n = steps[t]
            if len(beta) < n:
                beta = np.concatenate([beta, np.ones((n - len(beta), STATES))])
            gammas[t] = alphas[t] * beta
            if t:
                ahead = emits[t] * beta / scales[t][:, None]
                move += alphas[t - 1][:n].T @ ahead
                beta = ahead @ model.move.T
        counts[:STATES] += gammas[0][first].sum(axis=0)
        counts[STATES : 2 * STATES] += gammas[0][~first].sum(axis=0)
        counts[2 * STATES : 2 * STATES + STATES**2] += (move * model.move).ravel()
        gamma, symbols = np.concatenate(gammas), np.concatenate([x[t, :n] for t, n in enumerate(steps)])
        for k in range(STATES):
            from_ = 2 * STATES + STATES**2 + k * SYMBOLS
            counts[from_ : from_ + SYMBOLS] += np.bincount(symbols, gamma[:, k], SYMBOLS)
        tokens += len(symbols)
    return counts, total, tokens


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Exact natural log likelihood of each whole text; long and short ones run side by side."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    size = np.array([len(texts[i]) for i in order])
    flat = np.concatenate([texts[i] for i in order]).astype(np.int64)
    begin = np.cumsum(size) - size
    table, out = np.ascontiguousarray(model.emit.T), np.zeros(len(texts))
    shorter = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # texts with a token at each step
    a = None
    for t in range(size[0]):
        n = shorter[t]
        a = table[flat[begin[:n] + t]] * (model.start if t == 0 else a[:n] @ model.move)
        s = a.sum(axis=1)
        a /= s[:, None]
        out[:n] += np.log(s)
    back = np.zeros(len(texts))
    back[order] = out
    return back


def _texts(column) -> list[np.ndarray]:
    return [np.frombuffer(b.as_py(), np.int16) for b in column]


def _round(encoded: DataFrame, model: Model) -> tuple[np.ndarray, float]:
    """One Baum-Welch round: every task sums its expected counts, Spark adds them up, position by position.

    Counts travel as whole numbers (scaled), so their sum does not depend on its order.
    """
    send = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total, tokens = np.zeros(COUNTS), 0.0, 0
        for batch in batches:
            for part in slices(batch, "symbols", 1 << 20):
                c, s, n = expected(send.value, _texts(part.column("symbols")))
                counts, total, tokens = counts + c, total + s, tokens + n
        values = np.rint(np.concatenate([counts, [total, tokens]]) * _SCALE).astype(np.int64)
        at = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(values[at])], ["at", "v"])

    sums = encoded.select("symbols").mapInArrow(run, "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    send.destroy()
    out = np.zeros(COUNTS + 2)
    out[sums["at"].to_numpy()] = sums["v"].to_numpy() / _SCALE
    return out[:COUNTS], out[COUNTS] / max(out[COUNTS + 1], 1.0)


def train(encoded: DataFrame) -> Model:
    """Baum-Welch over all training texts.

    Start values come from about START_DOCS texts of at most START_TOKENS tokens on the driver; from there every round
    uses all texts, until one gains less than GAIN nats a token (ROUNDS at most).
    """
    training = encoded.filter(~F.col("held_out"))
    n = training.count()
    spot = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1 << 30)) / float(1 << 30)
    some = training.filter((spot < START_DOCS / max(n, 1)) & (F.length("symbols") <= 2 * START_TOKENS)).select("symbols")
    rows = sorted(bytes(r["symbols"]) for r in some.limit(2 * START_DOCS).collect())
    texts = [np.frombuffer(r, np.int16) for r in rows]
    seen = np.bincount(np.concatenate([*texts, np.empty(0, np.int16)]).astype(np.int64), minlength=SYMBOLS)
    model = Model.guess(seen)
    for _ in range(START_ROUNDS if texts else 0):
        model = Model.of_counts(expected(model, texts)[0])
    last = -np.inf
    for _ in range(ROUNDS if n else 0):
        counts, mean = _round(training, model)
        model = Model.of_counts(counts)
        if mean - last < GAIN:
            break
        last = mean
    return model


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs (doc_id, text)``.

    Tokens are the words in lower case (A-Z only) and an end. Learned from are the
    texts whose crc32 of the id leaves no remainder HELD_OUT by FOLDS. ``base_score``
    is the add-one unigram model's log10 probability, ``score`` the hidden Markov
    model's: the SINGLE - 1 most frequent words and the end are symbols, all other
    words share CLASSES symbols by their endings, and a word's probability within
    its class is its add-one share of the class. Both need the count of every token:
    counts of at most FREQUENT words go to all tasks, the others meet theirs in a
    join. Words are told apart by 63 bits of a hash.

    Null and empty texts are one end token. Without training texts the base score is
    0 and the model is flat. Repeated rows get equal scores. A text as long as a row
    allows is scored whole, in one pass.
    """
    docs = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    counts = stage(word_counts(docs.filter(~F.col("held_out"))), "counts")
    words = Vocabulary(counts)
    sc = docs.sparkSession.sparkContext
    send = sc.broadcast((words.h, words.c, words.symbol))
    rows = docs.select("doc_id", "held_out", utf8("text").alias("text")).mapInArrow(_encode(send), ENCODED)
    encoded = stage(rows.withColumn("rid", F.monotonically_increasing_id()), "encoded")
    rare = encoded.select("rid", "rare", "times").filter(F.length("rare") > 0).mapInArrow(_unpack_rare, "rid long, h long, times int")
    met = rare.join(counts.select("h", "c"), "h")
    rare_sums = met.groupBy("rid").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum("times").alias("rare_known")
    )
    model = sc.broadcast(train(encoded))
    class_log = sc.broadcast(words.class_log)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column("symbols"))
            if not texts:
                continue
            value = log_likelihoods(model.value, texts) / np.log(10) - [float(class_log.value[t].sum()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(value)], ["rid", "path_log"])

    paths = encoded.select("rid", "symbols").mapInArrow(run, "rid long, path_log double")
    size = float(np.log10(words.tokens + words.distinct + 1))
    more = F.coalesce("rare_log", F.lit(0.0))
    joined = encoded.drop("symbols", "rare", "times").join(paths, "rid").join(rare_sums, "rid", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("all_log") + more - F.col("n_tokens") * size).alias("base_score"),
        (F.col("path_log") + F.col("class_log") + more).alias("score"),
    )
