from __future__ import annotations

import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from tests.llm.rows import WORDS
from tests.llm.test_partenum_join import plain as near
from tests.llm.test_phrase_index import plain as phrases
from wardcast.llm import gam_quality, pivotal_mix
from wardcast.llm.queries import quality_model
from wardcast.llm.storage import written

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before and after each stage, at the smallest scale."""
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("test tables are not available")
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in pipeline.STAGES:
        out.append((name, written(stage(spark, out[-1][1], sf_dir))))
    return out


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_order_and_columns(stages):
    assert [n for n, _ in stages] == ["documents", "quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    for _, df in stages[1:-1]:
        assert df.columns == stages[0][1].columns


def test_quality(spark, stages):
    docs = stages[0][1]
    features = gam_quality.with_features(docs, id="doc_id", text="text")
    model = quality_model(features, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    kept = {r.doc_id for r in gam_quality.scored(features, model).collect() if r.score >= 0.7}
    assert {r[0] for r in rows(stages[1][1])} == kept


def test_near_duplicates(stages):
    before = rows(stages[1][1])
    first = {i for i, _, c in near(before, 5, 80, 100) if i == c}
    assert sorted(r[0] for r in rows(stages[2][1])) == sorted(first)


def test_decontamination(spark, stages):
    before = rows(stages[2][1])
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    clean = [r[0] for r in phrases(before, items, 10) if r[2] == 0]
    assert sorted(r[0] for r in rows(stages[3][1])) == sorted(clean)


def test_mixing(stages):
    before, after = (rows(stages[k][1]) for k in (3, 4))
    copies = Counter(after)
    assert set(copies) <= set(before) and max(copies.values()) <= 3
    size, taken = defaultdict(int), defaultdict(int)
    for r in before:
        size[r[2]] += len(WORDS.findall(r[1] or ""))
    for r in after:
        taken[r[2]] += len(WORDS.findall(r[1] or ""))
    largest = max(len(WORDS.findall(r[1] or "")) for r in before)
    table = [(s, n, 1) for s, n in size.items()]
    spark = stages[0][1].sparkSession
    for r in pivotal_mix.targets(spark.createDataFrame(table, "source string, source_size long, rows long"), (1, 2, 3), 3.0).collect():
        assert abs(taken[r.source] - r.target) <= largest


def test_sharding(stages):
    before, after = rows(stages[4][1]), stages[5][1].collect()
    assert Counter(r[0] for r in before) == Counter(r.doc_id for r in after)
    for shard in range(8):
        slots = sorted(r.slot for r in after if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_nothing_else_imports_the_package():
    own = re.compile(r"wardcast\.llm|wardcast import llm|corpus_pipeline|tests\.llm")
    for path in [*ROOT.glob("wardcast/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert not own.search(path.read_text()), path


def test_rows_without_ids_or_words_stay(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", None, 11)]
        + [(3, None, None, None, None), (4, "", "en", "s", 0), (None, "a b c d e f", "en", "s", 11)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    kept = pipeline.near_duplicates(spark, docs, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]
    mixed = pipeline.mixing(spark, docs, "").collect()
    assert all(r in docs.collect() for r in mixed)
    assert len(pipeline.sharding(spark, docs, "").collect()) == 6


def test_only_rows_with_an_id_are_numbered(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(None, f"a b c d e {i}", "en", "s", 11) for i in range(5)] + [(1, "a b c", "en", "s", 5)], kind)
    kept = pipeline.near_duplicates(spark, docs, "")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window [row_number()") :]
    below = below[below.index("Join ") :]
    own = below[: below.index("LogicalRDD")]
    assert "Filter isnotnull(doc_id" in own
    assert kept.count() == 6
