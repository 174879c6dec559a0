from __future__ import annotations

import re

import pytest
from pyspark.sql import types as T

from tests.llm.rows import awkward, documents, frame, lower, prose
from wardcast.llm import phrase_index as index

BREAK = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def items(spark, rows):
    return frame(spark, rows, ("item_id", "text"), (T.LongType(), T.StringType()))


def plain(rows, wanted, length):
    windows = {}
    for i, t in wanted:
        w = BREAK.findall(lower(t))
        for p in range(len(w) - min(length, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + min(length, len(w))]), set()).add(i)
    out = []
    for i, t, _ in rows:
        w, hit, found = BREAK.findall(lower(t)), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if own := windows.get(tuple(w[p : p + size])):
                    hit |= set(range(p, p + size))
                    found |= own
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def ordered(rows):
    return sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in rows)


def wanted():
    base, other, shared = prose(1, 120), prose(2, 90), prose(4, 50)
    return [
        (1, " ".join(base[20:40])),
        (1, " ".join(base[20:40])),
        (20, "-".join(w.upper() for w in other[:9])),
        (3, " ".join(shared[:10]) + "."),
        (4, " ".join(shared[:10] + other[:10])),
        (5, "one"),
        (6, ""),
        (7, None),
        (8, "!?"),
        (None, " ".join(base[100:])),
        (9, "nowhere to be found in any of the texts of this small table"),
        (10, "two words"),
        (11, " ".join(["twice"] * 12)),
    ]


@pytest.mark.parametrize(("length", "small"), [(10, 200_000), (3, 200_000), (10, 0)])
def test_awkward_rows(spark, monkeypatch, length, small):
    monkeypatch.setattr(index, "SMALL", small)
    rows = awkward() + [(30, "TWICE " * 11 + "ﬀ İ ẞ twice\x00twice", "s"), (31, "«" + " ".join(prose(1, 120)[25:37]), "s"), (1, "one", "s")]
    got = index.contaminated(documents(spark, rows), items(spark, wanted()), length=length).collect()
    assert ordered(got) == ordered(plain(rows, wanted(), length))
    docs = documents(spark, rows)
    kept = index.without_phrases(docs, items(spark, wanted()), length=length)
    assert kept.columns == docs.columns
    clean = [(i, t) for (i, t, s), r in zip(rows, plain(rows, wanted(), length), strict=True) if r[2] == 0]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, clean))


def test_empty_tables(spark):
    rows = awkward()[:8]
    none = index.contaminated(documents(spark, rows), items(spark, []))
    assert ordered(none.collect()) == ordered(plain(rows, [], 10))
    assert index.contaminated(documents(spark, []), items(spark, wanted())).collect() == []


def test_postings_hold_every_occurrence(spark):
    docs = index.keyed(documents(spark, [(1, "A b, a", "s"), (2, None, "s"), (3, ".É é b", "s")]), "doc_id", "text")
    terms = spark.createDataFrame([("a",), ("é",)], "term string")
    got = {(r.term, r.doc, r.at) for r in index.postings(docs, terms).collect()}
    assert got == {("a", 1, 0), ("a", 1, 2), ("é", 3, 2), (None, 1, 3), (None, 2, 0), (None, 3, 3)}


def test_near(spark):
    rows = [(1, "x rare y z common", "s"), (2, "common x x x x x x rare", "s"), (3, "z common rare common", "s"), (4, "common common", "s")]
    found = index.near(documents(spark, rows), items(spark, [(7, "rare common"), (8, "")]), id="doc_id", text="text", item_id="item_id", item_text="text", within=3)
    assert {tuple(r) for r in found.collect()} == {(7, 1, 1), (7, 3, 2)}
