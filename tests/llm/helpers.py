"""Small hostile tables for the corpus operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioustrnlmdk") for _ in range(r.randint(2, 8))) for _ in range(n))


def documents(spark, rows, extra: str | None = None):
    """rows: (doc_id, text); ``extra`` is a further column whose name may clash."""
    data = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    if extra:
        return spark.createDataFrame([(*d, "own") for d in data], f"{SCHEMA}, {extra} string")
    return spark.createDataFrame(data, SCHEMA)


def hostile():
    """Nulls, empty texts, white space, copies, repeated rows, one id with two texts, a very long text."""
    base, shared = prose(1, 60), prose(2, 30)
    return [
        (3, base),
        (1, base),
        (1, base),
        (None, base),
        (None, base),
        (None, None),
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (7, "one"),
        (8, prose(3, 25) + " " + shared + " " + prose(4, 25)),
        (9, shared + "  \n " + prose(5, 15) + " " + shared),
        (10, prose(6, 40_000)),
        (11, prose(7, 30)),
        (11, prose(8, 30) + " " + shared),
        (12, "é ü ß 日本 " * 30),
        (13, base.replace("a", "A")),
    ]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
