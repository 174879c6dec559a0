"""A corpus from raw documents to shards, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardcast.llm import gam_quality, partenum_join, phrase_index, pivotal_mix, sampled_shards
from wardcast.llm.memory import small_batches
from wardcast.llm.queries import KEEP_SCORE, table, training_labels
from wardcast.llm.storage import saved, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, as ``labels.quality`` marks them outside its held-out fold.

    Empty texts are judged like any other.
    """
    small_batches(spark)
    labels = training_labels(table(spark, sf_dir, "labels"))
    rows = gam_quality.to_learn_from(docs, labels, id="doc_id", label="quality")
    model = gam_quality.learned(gam_quality.with_features(rows, id="doc_id", text="text"), labels, id="doc_id", label="quality")
    return docs.where(gam_quality.text_score(model, "text") >= KEEP_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that links of a similarity of 0.8 or more on five-word
    shingles hold together.

    Of rows that repeat the id of such a document one stays. Rows without words, or without an id, stay.
    """
    small_batches(spark)
    found = partenum_join.near_duplicates(docs, size=5, threshold=partenum_join.Threshold(80, 100))
    first = found.where("n_shingles > 0 AND doc_id = component_id").select("doc_id").distinct().withColumn("_first", F.lit(True))
    once = Window.partitionBy("doc_id").orderBy("text", "source", "lang", "n_chars")
    rows = docs.where("doc_id IS NOT NULL").join(first, "doc_id", "left").withColumn("_place", F.row_number().over(once))
    wordless = ~F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    known = rows.where(wordless | (F.col("_first") & (F.col("_place") == 1))).select(*docs.columns)
    return known.unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item."""
    return phrase_index.without_phrases(docs, table(spark, sf_dir, "benchmark"), length=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes: none, one, or repeated rows."""
    keys = {
        "_k1": F.xxhash64("doc_id", "source", F.coalesce("text", F.lit(""))),
        "_k2": F.xxhash64(F.lit(1), "doc_id", "source", F.coalesce("text", F.lit(""))),
    }
    rows = docs.select("doc_id", "source", pivotal_mix.word_count("text").alias("size"), *[c.alias(k) for k, c in keys.items()])
    mix = pivotal_mix.mixed(saved(rows), id="doc_id", source="source", size="size")
    # Rows that are equal in all of this share their copies.
    shares = mix.groupBy("_k1", "_k2").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    once = Window.partitionBy("_k1", "_k2").orderBy("_k1")
    placed = docs.withColumns(keys).join(shares, ["_k1", "_k2"]).withColumn("_place", F.row_number().over(once))
    own = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_place") <= F.col("_copies") % F.col("_rows")).cast("int")
    return placed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), own.cast("int")))).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the place in it of every document, copies each."""
    return sampled_shards.sharded(docs, shards=8)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Trained scores and random rounding are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
