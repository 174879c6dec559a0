from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.rows import awkward, documents
from wardcast.llm import exchange, memory, partenum_join
from wardcast.llm.memory import lean, let_go


def test_batches_pass_through():
    batches = [pa.RecordBatch.from_pydict({"x": [i, i + 1]}) for i in range(3)]
    assert list(lean(lambda got: (b for b in got))(iter(batches))) == batches
    assert list(lean(lambda got: iter(()))(iter([]))) == []


def test_freed_memory_goes_back():
    def held() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    let_go()
    before = held()
    small = [np.ones(1 << 14) for _ in range(800)]
    assert held() - before > 80 << 20
    del small
    let_go()
    assert held() - before < 40 << 20


def sizes(docs) -> list[tuple[int, int]]:
    """(rows, bytes) of each batch that reaches a worker."""

    def each(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    return [tuple(r) for r in docs.mapInArrow(each, "rows long, bytes long").collect()]


def test_the_pipeline_sends_texts_in_small_batches(spark, tmp_path):
    session = spark.newSession()
    docs = session.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("text "), 1000).alias("text"))
    assert max(b for _, b in sizes(docs)) > 3 * memory.BATCH_BYTES
    session.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.quality(session, docs, str(tmp_path)).columns == docs.columns
    got = sizes(docs)
    assert sum(n for n, _ in got) == 3000 and max(b for _, b in got) < 1.5 * memory.BATCH_BYTES


def test_parts_of_a_chunk_are_as_few_however_small_the_batches():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(i, i + 10))}) for i in range(0, 25_000, 10)]
    got = list(exchange.gathered(iter(batches)))
    assert [b.num_rows for b in got] == [10_000, 10_000, 5_000]
    assert pa.Table.from_batches(got)["x"].to_pylist() == list(range(25_000))
    whole = pa.RecordBatch.from_pydict({"x": list(range(30_000))})
    assert [b.num_rows for b in exchange.gathered(iter([whole, whole]))] == [30_000, 30_000]
    assert list(exchange.gathered(iter([]))) == []


def test_near_duplicates_in_small_batches(spark, monkeypatch):
    session = spark.newSession()
    plain = sorted(map(tuple, partenum_join.near_duplicates(documents(session, awkward())).collect()), key=repr)
    monkeypatch.setattr(memory, "BATCH_BYTES", 2000)
    memory.small_batches(session)
    assert len(sizes(documents(session, awkward()).coalesce(1))) > 3
    assert sorted(map(tuple, partenum_join.near_duplicates(documents(session, awkward())).collect()), key=repr) == plain
