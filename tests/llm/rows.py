"""Small tables with awkward rows, and plain versions of words, for the tests of this folder."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that operators might use themselves.
CLASHING = ("chunk", "bucket", "kind", "keys", "packed", "id", "key", "a", "b", "sig", "label", "component", "n", "at", "term", "rows", "range")


def lower(text: str | None) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def prose(seed: int, words: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"W{rng.randrange(vocabulary)}" for _ in range(words)]


def frame(spark, rows, names, kinds):
    """The rows with a null in each of the clashing columns' strings."""
    fields = [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]
    extra = [T.StructField(c, T.StringType()) for c in CLASHING if c not in names]
    full = [tuple(r) + tuple(None if i % 2 else c.name for i, c in enumerate(extra)) for r in rows]
    return spark.createDataFrame(full, T.StructType(fields + extra))


def documents(spark, rows):
    """(doc_id, text, source) with columns of clashing names."""
    return frame(spark, rows, ("doc_id", "text", "source"), (T.LongType(), T.StringType(), T.StringType()))


def awkward() -> list[tuple]:
    """Copies, near copies, repeated rows, nulls, empty and very long texts."""
    base, other = prose(1, 120), prose(2, 90)
    near = base[:60] + ["changed"] + base[61:]
    long = prose(3, 60_000, 50_000)
    shared = prose(4, 50)
    texts = [
        (1, " ".join(base)),
        (2, "\n".join(base)),
        (3, " ".join(near)),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \t\n\x0b\x0c\r "),
        (7, " ".join(other)),
        (None, " ".join(base)),
        (None, "only here"),
        (8, "one"),
        (9, "ONE"),
        (10, " ".join(long)),
        (11, " ".join(long[:-1])),
        (12, " ".join(other + shared)),
        (13, " ".join(shared * 3)),
        (14, "x" * 300_000),
        (15, "two words"),
        (16, "!?é　ü one  two three"),
    ]
    sources = ["a", "b", None, "a", "Z", "é"]
    return [(i, t, sources[k % len(sources)]) for k, (i, t) in enumerate(texts)]
