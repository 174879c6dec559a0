from __future__ import annotations

from collections import Counter

import pytest

from tests.llm.rows import WORDS, awkward, documents, lower, prose
from wardcast.llm import doubling_dedup as dd


def plain(rows, length, fold=False):
    texts = [WORDS.findall(t or "") for _, t, _ in rows]
    keys = [[lower(w) if fold else w for w in t] for t in texts]
    seen = Counter(tuple(t[p : p + length]) for t in keys for p in range(len(t) - length + 1))
    out = []
    for (i, _, _), t, k in zip(rows, texts, keys, strict=True):
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[tuple(k[p : p + length])] > 1:
                gone[p : p + length] = [True] * length
        out.append((i, len(t), sum(gone), " ".join(w for w, g in zip(t, gone, strict=True) if not g)))
    return out


def ordered(rows):
    return sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in rows)


@pytest.mark.parametrize(("length", "fold"), [(35, False), (10, True), (1, False), (64, False)])
def test_awkward_rows(spark, length, fold):
    rows = awkward()
    got = dd.without_repeats(documents(spark, rows), length=length, lower=fold).collect()
    assert ordered(got) == ordered(plain(rows, length, fold))


def test_passages_within_and_across_texts(spark):
    passage, rows = prose(1, 55, 10_000), []
    for i in range(30):
        own = prose(100 + i, 80, 10_000)
        rows.append((i, " ".join(own[:i] + (passage if i % 3 else passage[:34]) + own[i:]), "s"))
    rows.append((50, " ".join(passage + ["between"] + passage), "s"))
    rows.append((51, " ".join(["again"] * 200), "s"))
    got = dd.without_repeats(documents(spark, rows)).collect()
    assert ordered(got) == ordered(plain(rows, 35))
    removed = {r.doc_id: r.n_removed for r in got}
    assert removed[1] == 55 and removed[3] == 0 and removed[50] == 110 and removed[51] == 200


def test_empty_table(spark):
    assert dd.without_repeats(documents(spark, [])).collect() == []


def test_levels_double_up_to_the_length():
    assert dd.lengths(35, 8) == [9, 18, 35]
    assert dd.lengths(64, 8) == [8, 16, 32, 64]
    assert dd.lengths(5, 8) == [5]
