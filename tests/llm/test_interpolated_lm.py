from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.rows import WORDS, awkward, documents, lower
from wardcast.llm import interpolated_lm as lm
from wardcast.llm import queries


def bucket(count: int) -> int:
    return 0 if count == 0 else int(math.log2(count)) + 1


def plain(rows, train, tune, order):
    """Scores with weights learned on every held-out token, without a grid."""
    tokens = [WORDS.findall(lower(t)) + [None] for _, t, _ in rows]
    grams = [[[tuple(([0] * order + w)[i + order - k + 1 : i + order + 1]) for i in range(len(w))] for k in range(1, order + 1)] for w in tokens]
    contexts = lambda g, k, i, c: c[k - 1][g[k - 1][i - 1]] if i else c[0][(None,)]
    every, kept = ([Counter() for _ in range(order)] for _ in range(2))
    for i, g in enumerate(grams):
        for k in range(order):
            if train[i]:
                every[k].update(g[k])
                if not tune[i]:
                    kept[k].update(g[k])
    n, types, held = sum(every[0].values()), len(every[0]), sum(kept[0].values())

    def estimates(g, i, c, total):
        out = [(0, c[0][g[0][i]] / total if total else 0.0)]
        for k in range(1, order):
            context = contexts(g, k, i, c)
            out.append((bucket(context), c[k][g[k][i]] / context if context else 0.0))
        return out

    data = [estimates(g, i, kept, held) for j, g in enumerate(grams) if tune[j] and train[j] for i in range(len(g[0]))]
    table = [[0.5] * 64 for _ in range(order)]
    for k in range(1, order):
        table[k][0] = 0.0
    if held == 0:
        table[0] = [0.0] * 64

    def parts(e):
        out = [1 / (types + 1)]
        for k, (b, p) in enumerate(e):
            out = [x * (1 - table[k][b]) for x in out] + [table[k][b] * p]
        return out

    for _ in range(200 if data else 0):
        up, down = Counter(), Counter()
        for e in data:
            ps = parts(e)
            reach = ps[0]
            for k, (b, _) in enumerate(e):
                reach += ps[k + 1]
                up[k, b] += ps[k + 1] / sum(ps)
                down[k, b] += reach / sum(ps)
        for k in range(order):
            for b in range(64):
                table[k][b] = up[k, b] / down[k, b] if down[k, b] else table[k][b - 1] if b > (k > 0) else table[k][b]
            if k:
                table[k][0] = 0.0
    out = []
    for g in grams:
        score = sum(math.log10(max(sum(parts(estimates(g, i, every, n))), 1e-300)) for i in range(len(g[0])))
        base = sum(math.log10((every[0][w] + 1) / (n + types + 1)) for w in g[0])
        out.append((len(g[0]), sum(every[0][w] > 0 for w in g[0]), n, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_a_plain_model(spark, order):
    rows = [(i, t, s) for i, t, s in awkward() if t is None or len(t) < 10_000]
    docs = documents(spark, rows)
    train = F.col("doc_id") % 4 != 3
    got = lm.scores(docs, id="doc_id", text="text", train=train, tune=F.col("doc_id") % 3 == 0, order=order).collect()
    marks = [(i is not None and i % 4 != 3, i is not None and i % 4 != 3 and i % 3 == 0) for i, _, _ in rows]
    want = plain(rows, [a for a, _ in marks], [b for _, b in marks], order)
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    got = sorted((tuple(r) for r in got), key=key)
    want = sorted(((i, *w) for (i, _, _), w in zip(rows, want, strict=True)), key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want])
    # The grid rounds an estimate by less than an eighth of its step; scores agree far closer than that.
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=0.02)


def test_very_long_text_and_empty_tables(spark):
    docs = documents(spark, awkward())
    some = lm.scores(docs, id="doc_id", text="text", train=F.lit(True), tune=F.col("doc_id") == 1)
    rows = {r.doc_id: r for r in some.collect()}
    assert rows[10].n_tokens == 60_001 and rows[14].n_tokens == 2 and rows[4].n_tokens == 1
    assert all(r.score < 0 for r in rows.values())
    none = docs.limit(0)
    assert lm.scores(none, id="doc_id", text="text", train=F.lit(True), tune=F.lit(True)).collect() == []
    unlearned = lm.scores(docs, id="doc_id", text="text", train=F.lit(None).cast("boolean"), tune=F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known, r.score) for r in unlearned} == {(0, 0, 0.0)}


def test_learned_weights_beat_even_ones_on_held_out_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = lm.scores(docs, id="doc_id", text="text", train=F.col("doc_id") % 7 != 2, tune=F.col("doc_id") % 7 == 3)
    better = out.where("doc_id % 7 = 2").agg(F.sum("score"), F.sum("base_score")).first()
    assert better[0] > better[1]


def test_the_query_scores_held_out_text_better_than_bigrams(spark, sf_dir, monkeypatch):
    def mean(**more):
        monkeypatch.setattr(queries.interpolated_lm, "scores", lambda *a, **k: full(*a, **k | more))
        return queries.op1_interpolated_lm(spark, sf_dir).where("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0]

    full = queries.interpolated_lm.scores
    assert mean() > mean(order=2) + 0.01


@pytest.mark.parametrize("n", [1, 3, 51, 4000])
def test_requests_tell_which_keys_were_first_or_alone(n):
    keys, _ = lm.X.distinct(lm.mix(np.arange(1, 2000, dtype=np.uint64)))
    shared = keys[::3]
    ones = [np.ones(len(x), np.int64) for x in (keys, shared)]
    for kind, order in ((1, 3), (2, 3), (3, 3)):
        asked = [next(lm._request(c, kind, k, [o * (300 + c), o * c], n, order)).to_pylist() for c, (k, o) in enumerate(zip((keys, shared), ones, strict=True))]
        for b in {r["bucket"] for r in asked[0]}:
            blobs = [r["keys"] for rows in asked for r in rows if r["bucket"] == b]
            some, both = (x[lm.X.bucket_of(x, n) == b] for x in (keys, shared))
            got = [lm.zstandard.decompress(x) for x in lm._totals(blobs)]
            total, at = lm._unsqueeze(got[0], len(some), 0)
            fold, at = lm._unsqueeze(got[0], len(some), at)
            assert total.tolist() == np.where(np.isin(some, both), 601, 300).tolist()
            assert fold.tolist() == np.isin(some, both).astype(int).tolist()
            said = np.unpackbits(np.frombuffer(got[0], np.uint8, offset=at), count=len(some)) if kind < 3 else None
            if kind == 1:
                assert said.all()
            elif kind == 2:
                assert said.tolist() == (~np.isin(some, both)).tolist()
            else:
                assert at == len(got[0])


def test_a_chunks_ngrams_are_not_looked_up_one_by_one(monkeypatch):
    grams = lm.mix(np.arange(5000, dtype=np.uint64) % np.uint64(700))
    marks = [np.ones(5000, bool), np.arange(5000) % 3 == 0]
    with monkeypatch.context() as m:
        m.setattr(np, "searchsorted", None)
        level = lm._Grams(grams, marks, np.zeros(5000, bool))
    assert (level.keys[level.at] == grams).all() and len(level.keys) == 700
    assert [int(x.sum()) for x in level.own] == [5000, 1667]


def test_ngrams_around_one_that_no_other_chunk_has_are_not_asked_about():
    tokens, bounds = np.array([1, 2, 3, 9, 1, 2, 9], np.uint64), np.array([0, 4, 7])
    marks = [np.ones(7, bool), np.zeros(7, bool)]
    _, pairs, triples = lm._grams(tokens, bounds, 3)
    level = lm._Grams(pairs, marks, np.zeros(7, bool))
    level.alone = level.keys == pairs[2]
    inside = level.alone_within(bounds)
    assert inside.tolist() == [False, False, True, True, False, False, False]
    assert set(lm._Grams(triples, marks, inside).asked) == {int(np.searchsorted(np.unique(triples), t)) for t in triples[[0, 1, 4, 5, 6]]}
