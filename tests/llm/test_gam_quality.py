from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.rows import awkward, documents, frame
from wardcast.llm import gam_quality as gam


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    ones = label.sum()
    return (rank[label > 0].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_learns_single_features_and_a_pair():
    rng = np.random.default_rng(3)
    x = rng.random((4000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.7) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fitted(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert auc(model.score(x[3000:]), y[3000:]) > 0.97
    alone = gam.Model(model.base, model.edges, model.tables, model.coarse, [], [])
    assert auc(alone.score(x[3000:]), y[3000:]) < 0.9


def test_a_score_is_the_sum_of_its_bins():
    rng = np.random.default_rng(4)
    x = rng.random((500, len(gam.FEATURES)))
    model = gam.fitted(x, (x[:, 2] > 0.5).astype(float))
    total = model.base
    for k, table in enumerate(model.tables):
        total += table[sum(e <= x[7, k] for e in model.edges[k])]
    for (a, b), square in zip(model.pairs, model.squares, strict=True):
        total += square[sum(e <= x[7, a] for e in model.coarse[a]), sum(e <= x[7, b] for e in model.coarse[b])]
    assert np.isclose(model.score(x)[7], 1 / (1 + np.exp(-total)))


def test_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = gam.with_features(docs, id="doc_id", text="text")
    model = gam.learned(rows, labels.where("doc_id % 4 <> 2"), id="doc_id", label="quality")
    known = gam.scored(rows, model).join(labels, "doc_id").where("doc_id % 4 = 2").toPandas()
    assert auc(known.score.to_numpy(), known.quality.to_numpy()) > 0.97
    clean = known[known.quality == 1]
    assert (clean.score >= 0.7).mean() > 0.97
    by_text = docs.select("doc_id", gam.text_score(model, "text").alias("own")).join(gam.scored(rows, model), "doc_id")
    assert by_text.where(F.abs(F.col("own") - F.col("score")) > 1e-12).isEmpty()


def test_features_of_awkward_texts(spark):
    docs = documents(spark, awkward())
    rows = gam.with_features(docs, id="doc_id", text="text").collect()
    assert len(rows) == len(awkward()) and all(np.isfinite(r.features).all() for r in rows)
    by_id = {r.doc_id: dict(zip(gam.FEATURES, r.features, strict=True)) for r in rows}
    assert not any(by_id[4].values()) and by_id[4] == by_id[5] == by_id[6]
    assert by_id[9]["capital_words"] == 1 and by_id[8]["capital_words"] == 0
    assert by_id[13]["distinct_words"] < 0.4 and by_id[10]["log_words"] == np.log1p(60_000)
    named = dict(zip(gam.FEATURES, gam.features(pa.array(["a | a | a\na b.\na b."]))[0], strict=True))
    assert named["pipes"] == 2 / 19 and named["lines_again"] > 0 and named["commonest_word"] == 5 / 9 and named["stopped_words"] == 2 / 9


def test_few_labels(spark):
    docs = documents(spark, awkward())
    rows = gam.with_features(docs, id="doc_id", text="text")
    kinds = (T.LongType(), T.IntegerType())
    for labels in ([], [(1, 1), (7, 1)], [(1, None), (2, 7), (99, 0), (None, 1)], [(1, 1), (7, 0), (7, 0)]):
        model = gam.learned(rows, frame(spark, labels, ("doc_id", "quality"), kinds), id="doc_id", label="quality")
        scores = [r.score for r in gam.scored(rows, model).collect()]
        assert len(scores) == len(awkward()) and all(0 < s < 1 for s in scores)
    assert gam.scored(rows.limit(0), model).collect() == []


def test_rows_to_learn_from(spark):
    """The same model as from the features of all rows, also where ids repeat and more are labelled than may be used."""
    docs = spark.createDataFrame([(i % 90 if i % 11 else None, f"text {i} " * (i % 7)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(3, None), (None, 1), (5, 7)], "doc_id long, quality int")
    for most in (20, 1000):
        some = gam.to_learn_from(docs, labels, id="doc_id", label="quality", most=most)
        assert some.where("doc_id IS NULL").isEmpty() and some.select("doc_id").distinct().count() == min(most, 90)
        models = [gam.learned(gam.with_features(d, id="doc_id", text="text"), labels, id="doc_id", label="quality", most=most) for d in (docs, some)]
        x = np.random.default_rng(1).random((50, len(gam.FEATURES)))
        assert (models[0].score(x) == models[1].score(x)).all()


def test_slices_follow_bytes(monkeypatch):
    monkeypatch.setattr(gam, "SLICE_BYTES", 100)
    texts = pa.array(["x" * n for n in (10, 80, 20, 500, 0, 0, 99, 1)] + [None] * 2000)
    found = list(gam._slices(texts))
    assert [low for low, _ in found] == np.cumsum([0, *[n for _, n in found]])[:-1].tolist() and sum(n for _, n in found) == len(texts)
    assert all(n <= 1024 and (n == 1 or sum(len(x.as_py() or "") for x in texts.slice(low, n)) <= 100) for low, n in found)
