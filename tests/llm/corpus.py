"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = ("digest", "n", "name", "keys", "length", "piece", "batch", "b", "held_out", "host", "root", "rank", "score")

_rng = random.Random(4)
_SYLLABLES = ["ka", "mo", "ti", "ren", "sul", "pa", "vor", "de", "lin", "qu"]
VOCABULARY = ["".join(_rng.choice(_SYLLABLES) for _ in range(_rng.randint(1, 4))) for _ in range(300)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text: str, seed: int, n: int) -> str:
    """``text`` with ``n`` words replaced."""
    rng, words = random.Random(seed), text.split(" ")
    for i in rng.sample(range(len(words)), n):
        words[i] = f"edit{seed}x{i}"
    return " ".join(words)


def edge_rows() -> list[tuple]:
    """Nulls, empty and very long texts, copies, near copies, odd characters, a repeated row."""
    base = prose(1, 120)
    rows = [
        (1, base), (2, base.upper()), (3, base.replace(" ", "\n\t ")), (4, edited(base, 4, 1)), (5, edited(base, 5, 2)),
        (6, edited(base, 6, 30)), (7, None), (8, ""), (9, " \t\n "), (10, "one"), (11, "One two"), (12, "one two three"),
        (13, "one TWO three"), (14, "日本語 テキスト ﬁ é́  x 😀"), (15, "<|endoftext|> it's 'll we're 12½ __ --"),
        (16, "x" * 6000), (17, prose(17, 9000)), (18, "1234 !!! ###"), (None, "no id here"), (20, base), (20, base),
        (21, prose(21, 60)), (22, "a  b   c\n\n d "),
    ]
    return rows + [(100 + i, prose(100 + i, 10 + i)) for i in range(25)]


def table(spark, rows, schema: str = "doc_id long, text string", clash: bool = True):
    """Rows with further columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, schema)
    extra = [c for c in CLASHING if c not in df.columns] if clash else []
    return df.withColumns({c: F.lit("other") for c in extra})


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingles(text: str | None, n: int) -> frozenset:
    w = words(text)
    if len(w) < n:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
