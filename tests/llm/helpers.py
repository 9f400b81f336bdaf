"""Small tables with the awkward cases, and plain Python versions of the rules."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that operators use inside
    "n long, h long, rep long, tile long, host string, path string, size long, rank long, copies int, score double, kept string, sha string"
)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def row(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, len(text or ""), 1, 2, 3, 4, "h", "p", 5, 6, 7, 0.5, "k", "x")


def awkward(spark):
    """Nulls in every column, empty, blank, short, very long, repeated and tied rows."""
    rng = random.Random(4)
    long_text, shared = prose(rng, 30000), prose(rng, 80)
    rows = [
        row(1, None), row(2, ""), row(3, " \n\t "), row(4, "a"), row(5, "a"), row(6, "one two three"), row(7, long_text),
        row(8, prose(rng, 70) + "\n" + shared), row(9, prose(rng, 70) + "\n" + shared), row(10, shared), row(10, shared),
        row(11, shared, None), row(12, "é ü x " * 40, "s", None), row(None, shared), row(None, None, None, None), row(13, "the " * 200),
        row(14, "one two three"), tuple([15] + [None] * 16), row(16, "\x00 \x07 \U0001f600 " * 30),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
