from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.rows import awkward, documents, frame
from wardcast.llm import pivotal_mix as mix

KINDS = (T.LongType(), T.StringType(), T.LongType())


def sized(spark, rows):
    return frame(spark, rows, ("doc_id", "source", "size"), KINDS)


def plain_targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"é": 4, "Z": 4, None: 9, "a": 0}, {"x": 7}, {"a": 1, "b": 1, "c": 1, "d": 999}])
def test_targets(spark, sizes):
    table = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, rows long")
    got = {r.source: r.target for r in mix.targets(table, (1, 2, 3), 3.0).collect()}
    want = plain_targets(sizes, (1, 2, 3), 3.0)
    assert got.keys() == want.keys() and all(np.isclose(got[s], want[s]) for s in want)


def check(rows, got):
    assert sorted((r.doc_id or -1, r.source or "", r.size) for r in got) == sorted((i or -1, s or "", n or 0) for i, s, n in rows)
    total, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        total[r.source] += r.size
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 3
    want = plain_targets(total, (1, 2, 3), 3.0)
    for r in got:
        assert np.isclose(r.target, want[r.source]) and r.source_size == total[r.source]
        assert r.source_size == 0 or int(np.floor(r.target / r.source_size + 1e-9)) <= r.copies <= np.ceil(r.target / r.source_size - 1e-9)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)


def test_hot_source_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mix, "GROUP", 16)
    monkeypatch.setattr(mix, "FAN_IN", 3)
    rng = np.random.default_rng(1)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", int(rng.integers(0, 400))) for i in range(900)]
    got = mix.mixed(sized(spark, rows), id="doc_id", source="source", size="size").collect()
    check(rows, got)
    again = mix.mixed(sized(spark, rows[::-1]).repartition(5), id="doc_id", source="source", size="size").collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)


def test_awkward_rows(spark):
    rows = documents(spark, awkward()).withColumn("size", mix.word_count("text"))
    plain = [(r.doc_id, r.source, r["size"]) for r in rows.collect()]
    got = mix.mixed(rows, id="doc_id", source="source", size="size")
    assert set(rows.columns) < set(got.columns)
    check(plain, got.collect())
    assert mix.mixed(rows.limit(0), id="doc_id", source="source", size="size").collect() == []
    nothing = mix.mixed(sized(spark, [(1, "a", 0), (2, None, None)]), id="doc_id", source="source", size="size").collect()
    assert {(r.doc_id, r["size"], r.target) for r in nothing} == {(1, 0, 0.0), (2, 0, 0.0)}


def test_many_sources_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mix, "MANY_SOURCES", 2)
    rows = [(i, [None, "a", "b", "c"][i % 4], 5 + i % 11) for i in range(200)]
    check(rows, mix.mixed(sized(spark, rows), id="doc_id", source="source", size="size").collect())


def test_pairs_keep_their_mass_and_expectation():
    size = np.array([7, 3, 11, 2, 5, 13])
    x = np.full(6, 0.37)
    sums, rng = np.zeros(6), np.random.default_rng(2)
    for _ in range(4000):
        out, held = mix.rounded(size, x, rng.random(6))
        assert np.isclose((size * out).sum(), (size * x).sum())
        assert all(v in (0.0, 1.0) for k, v in enumerate(out) if k != held)
        sums += out
    assert np.abs(sums / 4000 - 0.37).max() < 0.04
    assert mix.rounded(size, np.array([0, 1, 0, 1, 1, 0.0]), rng.random(6))[1] == -1


def test_mean_copies_are_the_ratio(spark):
    rows = [(i, "a" if i % 4 else "b", 1 + i % 9) for i in range(4000)]
    got = mix.mixed(sized(spark, rows), id="doc_id", source="source", size="size")
    for r in got.groupBy("source").agg(F.avg("copies").alias("m"), F.first(F.col("target") / F.col("source_size")).alias("w")).collect():
        assert abs(r.m - r.w) < 0.05
