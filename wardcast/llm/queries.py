"""The registered queries of this package, each over its whole tables, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.llm import (
    check_sql,
    density_extract,
    gam_quality,
    interpolated_lm,
    merkle_manifest,
    multiprobe_ann,
    partenum_join,
    phrase_index,
    pivotal_mix,
    prefix_trie,
    sampled_shards,
    warc_bundles,
    wildcard_urls,
)
from wardcast.llm.doubling_dedup import without_repeats
from wardcast.llm.storage import saved

URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
KEEP_SCORE = 0.7
CRAWLED = "2024-01-01T00:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(column: str, folds: int, fold: int) -> Column:
    """Whether a row falls into that fold; not if it has no id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op1_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores; an eighth of the learned-from texts is held out to learn the weights."""
    docs = table(spark, sf_dir, "documents")
    held_out = _fold("doc_id", 7, 2)
    tune = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / F.lit(7)) % 8 == 0
    known = F.col("doc_id").isNotNull()
    out = interpolated_lm.scores(docs, id="doc_id", text="text", train=known & ~held_out, tune=tune, order=3)
    return out.withColumn("held_out", held_out)


def op2_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(gam_quality.with_features(table(spark, sf_dir, "documents"), id="doc_id", text="text"))
    model = quality_model(rows, table(spark, sf_dir, "labels"))
    out = gam_quality.scored(rows, model).select("doc_id", _fold("doc_id", 4, 2).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= KEEP_SCORE).cast("int"))


def quality_model(rows: DataFrame, labels: DataFrame) -> gam_quality.Model:
    """Learned from the labels outside the held-out fold."""
    return gam_quality.learned(rows, training_labels(labels), id="doc_id", label="quality")


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels outside the held-out fold."""
    return labels.where(~_fold("doc_id", 4, 2))


def op3_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return partenum_join.near_duplicates(docs, size=4, threshold=partenum_join.Threshold(85, 100))


def op4_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents"), length=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return multiprobe_ann.nearest(rows, F.col("vec_id") % 20 == 0, id="vec_id", vector="embedding", k=20)


def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = saved(docs.select("doc_id", "source", pivotal_mix.word_count("text").alias("size")))
    out = pivotal_mix.mixed(rows, id="doc_id", source="source", size="size", weights=(1, 2, 3), most=3.0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_sampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampled_shards.sharded(table(spark, sf_dir, "documents"), shards=8)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc_bundles.classified(table(spark, sf_dir, "pages"), id="page_id", payload="html", least=0)
    archives = saved(warc_bundles.bundles(rows, id="page_id", url="url", payload="html", date=CRAWLED))
    number = F.when(F.col("id") != "", F.col("id").cast("long")).alias("page_id")
    refers = F.col("refers_to").cast("long").alias("refers_to")
    return warc_bundles.records(archives).select(number, "payload_bytes", "payload_digest", "record_type", refers)


def op9_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    out = phrase_index.contaminated(docs, items, length=10)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_wildcard_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [wildcard_urls.site_rule(*rule) for rule in URL_RULES]
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return wildcard_urls.judged(pages, rules, default="allow").drop("url")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.translate("text", phrase_index.UPPER, phrase_index.LOWER)
    leaf, lowered = (merkle_manifest.row_digest(["doc_id", "source", "lang", "n_chars", t]) for t in ("text", text))
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    claimed = {"claimed": F.when(changed, lowered).otherwise(leaf)}
    out = merkle_manifest.manifest(docs, id="doc_id", group="lang", leaf=leaf, carry=claimed)
    proven = merkle_manifest.folded(F.col("claimed"), F.col("proof")).alias("folded_root")
    out = out.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("proof")).alias("proof_sha256"), proven)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prefix_trie.turns(table(spark, sf_dir, "conversations"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    nodes, lists = prefix_trie.trie(*prefix_trie.rebuilt(own, base=F.col("conv_id") - F.col("conv_id") % 5, head=head))
    out = nodes.join(prefix_trie.ends_digest(lists), prefix_trie.KEY, "left")
    return out.select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op13_density_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_extract.extracted(table(spark, sf_dir, "pages"), id="page_id", url="url", page="html")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_interpolated_lm": op1_interpolated_lm,
    "op2_gam_quality": op2_gam_quality,
    "op3_partenum_join": op3_partenum_join,
    "op4_doubling_dedup": op4_doubling_dedup,
    "op5_multiprobe_ann": op5_multiprobe_ann,
    "op6_pivotal_mix": op6_pivotal_mix,
    "op7_sampled_shards": op7_sampled_shards,
    "op8_warc_bundles": op8_warc_bundles,
    "op9_phrase_index": op9_phrase_index,
    "op10_wildcard_urls": op10_wildcard_urls,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_density_extract": op13_density_extract,
}

CHECK_SQL: dict[str, str] = {
    "op3_partenum_join": check_sql.PARTENUM_JOIN,
    "op4_doubling_dedup": check_sql.DOUBLING_DEDUP,
    "op8_warc_bundles": check_sql.WARC_BUNDLES,
    "op9_phrase_index": check_sql.PHRASE_INDEX,
    "op10_wildcard_urls": check_sql.wildcard_urls(URL_RULES),
    "op11_merkle_manifest": check_sql.MERKLE_MANIFEST,
    "op12_prefix_trie": check_sql.PREFIX_TRIE,
}
