"""Quality rules judged by host: shrunken failure rates, joined back to documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlines.llm.texts import BLANKS
from planlines.session import stage

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Shares above which a document fails.
REPEAT_SHARE, SYMBOL_SHARE, DUP_LINE_SHARE = 0.5, 0.1, 0.3
#: A host whose shrunken failure rate is above this is rejected.
MAX_RATE = 0.5


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(words: Column, k: int = 3) -> Column:
    """Words inside windows of ``k`` words that occur at least twice in the list.

    Windows are sorted by hash with their position, equal neighbours are kept, and
    the lengths of the union of their spans are added up: n log n for one text.
    """

    def marked(windows: Column) -> Column:
        same = lambda x, i: (F.get(windows, i - 1)["h"] == x["h"]) | (F.get(windows, i + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(windows, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"]))

    spot = lambda w, i: F.struct(F.xxhash64(*[F.get(w, i + j) for j in range(k)]).alias("h"), i.alias("p"))
    windows = _let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: spot(w, i)))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    grow = lambda a, p: F.struct((a["n"] + p + k - F.greatest(a["end"], p)).alias("n"), (p + k).alias("end"))
    total = F.aggregate(_let(F.sort_array(windows), marked), start, grow, lambda a: a["n"])
    return F.when(F.size(words) < k, 0).otherwise(total).cast("long")


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``.

    Null text counts as empty: all zero.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(*rest, t.alias("_t"), words.alias("_w"), lines.alias("_l")).select(
        *rest,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_w")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )


def host_verdicts(failures: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """``host, host_docs, host_failures, host_rate, host_kept`` for ``failures (host, failed)``.

    The prior is a beta distribution fitted to the hosts' rates by moments, each
    host weighing its documents: mean m, between-host variance v after the binomial
    noise is taken off, strength m(1-m)/v - 1. Without spread between hosts the
    strength is that of all documents, so every host gets the global rate. Null
    hosts are one host. An empty table has no verdicts.
    """
    hosts = failures.groupBy("host").agg(F.count("*").alias("host_docs"), F.count_if("failed").alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_docs")
    sums = hosts.agg(
        F.sum("host_docs").alias("n"), F.sum("host_failures").alias("f"), F.count("*").alias("k"),
        F.sum(rate * rate * F.col("host_docs")).alias("q"),
    ).first()
    n, f, k = float(sums["n"] or 0), float(sums["f"] or 0), sums["k"]
    mean = f / n if n else 0.0
    spread = (sums["q"] / n - mean * mean) - (k - 1) * mean * (1 - mean) / n if n else 0.0
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else n
    strength = min(max(strength, 1.0), max(n, 1.0))
    shrunk = (F.col("host_failures") + mean * strength) / (F.col("host_docs") + strength)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_kept", F.col("host_rate") <= max_rate)


def judge(docs: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Counts, own failures and the host's verdict for every row of ``docs (doc_id, text, <host>)``.

    ``base_failed``: under ``MIN_WORDS`` words, or over half of the words in repeated
    three-word windows. ``failed`` adds too many symbols per character and too many
    repeated lines, and is what hosts are judged by. ``kept`` is false where
    ``base_failed``, else the host's verdict. Texts are read once: the counts are
    written out and both sides of the join read them. Repeated rows count each.
    """
    counts = text_counts(docs.select("doc_id", F.col(host).alias("host"), "text"))
    repeats = 100 * F.col("n_repeat_words") > 100 * REPEAT_SHARE * F.col("n_words")
    base = (F.col("n_words") < MIN_WORDS) | repeats
    own = base | (F.col("n_symbols") > SYMBOL_SHARE * F.col("word_chars")) | (F.col("n_dup_lines") > DUP_LINE_SHARE * F.col("n_lines"))
    counts = stage(counts.withColumn("base_failed", base).withColumn("failed", own), "counts")
    verdicts = host_verdicts(counts, max_rate)
    joined = counts.alias("d").join(verdicts.alias("h"), F.col("d.host").eqNullSafe(F.col("h.host")))
    return joined.select("d.*", "host_docs", "host_failures", "host_rate", "host_kept", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))
