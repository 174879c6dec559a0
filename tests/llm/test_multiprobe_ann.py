from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.rows import frame
from wardcast.llm import multiprobe_ann as ann

KINDS = (T.LongType(), T.ArrayType(T.FloatType()))


def vectors(spark, rows):
    return frame(spark, rows, ("vec_id", "embedding"), KINDS)


def exact(rows, k, asks):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = set()
    for q, x in good:
        if asks(q):
            scored = sorted(((-float(np.dot(x, y)), i) for i, y in good if i != q))[:k]
            out |= {(q, r, i) for r, (_, i) in enumerate(scored, 1)}
    return out


def small(seed, n, d=6):
    return np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32).tolist()


def test_all_candidates_if_few_and_bad_vectors_take_no_part(spark):
    good = small(1, 6)
    bad = [None, [0.0] * 6, [None] + [1.0] * 5, [float("nan")] * 6, [float("inf")] + [1.0] * 5, [1.0] * 3, []]
    rows = [(20 * i, v) for i, v in enumerate(good)] + [(i + 1, v) for i, v in enumerate(bad)] + [(None, good[0]), (7, good[2]), (9, good[2])]
    got = ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, id="vec_id", vector="embedding", k=20).collect()
    rows = [r for r in rows if r[1] is None or len(r[1]) == 6]
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == exact(rows, 20, lambda i: i % 20 == 0)


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(60)] + [(100 + i, v) for i, v in enumerate(small(2, 20, 3))]
    got = ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, id="vec_id", vector="embedding", k=5).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == exact(rows, 5, lambda i: i % 20 == 0)


def test_lengths_count_and_scores_are_inner_products(spark):
    points = small(3, 40)
    rows = [(i, [x * (1 + i % 7) for x in v]) for i, v in enumerate(points)]
    got = ann.nearest(vectors(spark, rows), F.col("vec_id") < 8, id="vec_id", vector="embedding", k=39).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == exact(rows, 39, lambda i: i < 8)
    by_id = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    assert all(np.isclose(r.score, by_id[r.query_id] @ by_id[r.vec_id], rtol=1e-12) for r in got)


def test_empty_table(spark):
    assert ann.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0, id="vec_id", vector="embedding").collect() == []


def test_split_buckets_find_the_same(spark, monkeypatch):
    rows = [(i, v) for i, v in enumerate(small(4, 300))]
    table = vectors(spark, rows)
    find = lambda: {tuple(r) for r in ann.nearest(table, F.col("vec_id") % 20 == 0, id="vec_id", vector="embedding", k=10).collect()}
    whole = find()
    monkeypatch.setattr(ann, "BLOCK", 16)
    assert find() == whole


@pytest.mark.parametrize("size", ["sf0.01"])
def test_recall_against_brute_force(spark, sf_dir, size):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = ann.nearest(rows, F.col("vec_id") % 20 == 0, id="vec_id", vector="embedding", k=20).collect()
    want = exact([(r.vec_id, list(r.embedding)) for r in rows.collect()], 20, lambda i: i % 20 == 0)
    want = {(q, i) for q, _, i in want}
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.93 * len(want)


def test_second_round_returns_only_what_reaches_the_bar():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(50, 4)), rng.normal(size=(2, 4))
    own = pa.table({"bucket": np.zeros(50, np.int64), "v1": np.arange(50), "v2": np.arange(50), "low": np.arange(50), "vector": list(x)})
    near = q @ x.T
    bars = np.array([np.sort(near[0])[-3], -np.inf])
    asked = pa.table({"bucket": np.zeros(2, np.int64), "q1": np.arange(2), "q2": np.arange(2), "bar": bars, "vector": list(q)})
    (found,) = ann._best(own, asked, 4, 5)
    got = {(r["q1"], r["low"]) for r in found.to_pylist()}
    assert got == {(0, int(i)) for i in np.argsort(-near[0])[:3]} | {(1, int(i)) for i in np.argsort(-near[1])[:5]}


def test_bar_is_the_kth_best_of_different_vectors(spark):
    rows = [(1, 1, v, v, float(s)) for v, s in [(1, 9), (1, 9), (2, 8), (3, 7)]] + [(2, 2, 1, 1, 5.0)]
    found = spark.createDataFrame(rows, "q1 long, q2 long, v1 long, v2 long, score double")
    assert [tuple(r) for r in ann._bars(found, 2).collect()] == [(1, 1, 8.0)]


def test_probes_are_in_order_of_the_distance_to_the_borders():
    tables = ann.Tables(5, 1, 3, 1.0, 27, 1)
    x = np.random.default_rng(5).normal(size=(1, 6))
    at = tables.places(x, 0)[0]
    below = at - np.floor(at)
    first = tables.probed(x, 0)[0]
    assert first[0] == tables.buckets(np.floor(at)[None], 0)[0] and len(set(first.tolist())) == 27
    near = [min((below[k], -1), (1 - below[k], 1)) for k in range(3)]
    k = int(np.argmin([n[0] for n in near]))
    step = np.floor(at).copy()
    step[k] += near[k][1]
    assert first[1] == tables.buckets(step[None], 0)[0]
