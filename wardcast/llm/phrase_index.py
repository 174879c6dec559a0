"""Benchmark decontamination with a distributed positional inverted index.

The index has a posting (term, text, position) for every occurrence of the terms that the test items' rarest
words are. For each window of an item, the two terms that are rarest in the corpus are looked up; their
postings, moved back by the terms' offsets in the item, intersect where a text may hold the window. Such an
alignment of an item and a text is then compared word by word, which gives the exact phrases.

Everything is DataFrame expressions. The texts are split twice, once to count the items' terms and once for
the postings; only texts with an alignment are read again. Items and their terms are broadcast up to
``SMALL`` rows; beyond, the same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardcast.llm.storage import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: all of ASCII but letters and digits.
BREAK = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SMALL = 200_000


def split_words(text: Column) -> Column:
    """The words as they stand; the first or last may be empty, where the text begins or ends with a break."""
    return F.split(F.coalesce(text, F.lit("")), BREAK)


def lowered(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def _count(words: Column) -> Column:
    last = F.size(words) - 1
    return F.size(words) - (F.get(words, F.lit(0)) == "").cast("int") - ((last > 0) & (F.get(words, last) == "")).cast("int")


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast only if its counted rows are few."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc, key, text): the key tells texts with one id apart."""
    return docs.select(F.col(id).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), F.col(text).alias("text"))


def item_terms(items: DataFrame, id: str, text: str) -> DataFrame:
    """(item, part, many, at, term): the words of each item in order; a part is one text of one item."""
    rows = items.select(F.col(id).alias("item"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    rows = rows.select("item", F.xxhash64("item", "text").alias("part"), F.filter(split_words(lowered(F.col("text"))), lambda w: w != "").alias("words"))
    return rows.select("item", "part", F.size("words").alias("many"), F.posexplode("words").alias("at", "term"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(folded, times): how often the corpus holds each of the terms (term), in any case."""
    folded = _small(saved(terms.select(F.lower("term").alias("folded")).distinct()))
    words = docs.select(F.explode(split_words(F.col("text"))).alias("word")).select(F.lower("word").alias("folded"))
    return words.join(folded, "folded").groupBy("folded").agg(F.count("*").alias("times"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index (term, doc, key, at): a row for each occurrence of the terms (term) in the texts (doc, key, text),
    and one with a null term for each text, whose place is the number of its words.

    Places of words count from 0 or 1, the same for a whole text.
    """
    wanted = terms.select("term", F.lower("term").alias("folded")).distinct()
    end = wanted.sparkSession.range(1).select(F.lit(None).cast("string").alias("term"), F.lit("").alias("folded"))
    wanted = _small(saved(wanted.unionByName(end)))
    words = docs.select("doc", "key", split_words(F.col("text")).alias("words"))
    words = words.select("doc", "key", _count(F.col("words")).alias("many"), F.size("words").alias("end"), F.posexplode(F.concat("words", F.array(F.lit("")))).alias("at", "word"))
    words = words.withColumn("folded", F.lower("word")).where("word <> '' OR at = end")
    found = words.join(wanted, "folded").where(F.col("term").isNull() | (lowered(F.col("word")) == F.col("term")))
    place = F.when(F.col("term").isNull(), F.col("many")).otherwise(F.col("at"))
    return saved(found.select("term", "doc", "key", place.alias("at")))


def windows(terms: DataFrame, length: int) -> DataFrame:
    """(item, part, start, at, term): the words of every window; an item of fewer words is one window."""
    size = F.least(F.lit(length), F.col("many"))
    first = F.greatest(F.lit(0), F.col("at") - size + 1)
    last = F.least(F.col("at"), F.col("many") - size)
    return terms.select("item", "part", F.explode(F.sequence(first, last)).alias("start"), "at", "term")


def _rarest(terms: DataFrame, counts: DataFrame, length: int, ranks: int) -> DataFrame:
    """(item, part, at, term, lone): the words that are among the rarest of some window, and whether one of those
    windows has no other word."""
    known = windows(terms, length).withColumn("folded", F.lower("term")).join(counts, "folded", "left")
    order = Window.partitionBy("item", "part", "start").orderBy(F.coalesce("times", F.lit(0)), "at")
    ranked = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    sizes = Window.partitionBy("item", "part", "start")
    ranked = ranked.withColumn("lone", F.count("*").over(sizes) == 1)
    return ranked.groupBy("item", "part", "at", "term").agg(F.bool_or("lone").alias("lone"))


def aligned(index: DataFrame, seeds: DataFrame) -> DataFrame:
    """(item, part, doc, key, shift): where postings of different words of an item, each moved back by the word's
    offset, meet in a text; one is enough for a window of one word."""
    seeds = _small(saved(seeds.withColumnRenamed("at", "offset")))
    moved = index.where("term IS NOT NULL").join(seeds, "term")
    moved = moved.groupBy("item", "part", "doc", "key", (F.col("at") - F.col("offset")).alias("shift"))
    met = moved.agg(F.min("offset").alias("low"), F.max("offset").alias("high"), F.bool_or("lone").alias("lone"))
    return met.where("low < high OR lone").select("item", "part", "doc", "key", "shift")


def phrases(docs: DataFrame, items: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(item, doc, key, start, size): the windows of the items (item_terms) that the texts hold at the alignments."""
    order = F.transform(F.sort_array(F.collect_list(F.struct("at", "term"))), lambda x: x["term"])
    whole = _small(saved(items.groupBy("part").agg(order.alias("terms"))))
    pairs = found.join(whole, "part").withColumnsRenamed({"doc": "_doc", "key": "_key"})
    pairs = _small(saved(pairs))
    rows = docs.join(pairs, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")))
    rows = rows.select("item", "doc", "key", "shift", "terms", split_words(lowered(F.col("text"))).alias("words"))
    same = F.transform("terms", lambda t, i: F.coalesce(F.get(F.col("words"), F.col("shift") + i) == t, F.lit(False)))
    rows = rows.select("item", "doc", "key", "shift", F.least(F.lit(length), F.size("terms")).alias("size"), same.alias("same"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("same") - F.col("size")),
        lambda s: F.forall(F.slice(F.col("same"), s + 1, F.col("size")), lambda x: x),
    )
    rows = rows.select("item", "doc", "key", "size", "shift", F.explode(starts).alias("start"))
    return rows.select("item", "doc", "key", (F.col("shift") + F.col("start")).alias("start"), "size")


def _searched(texts: DataFrame, items: DataFrame, item_id: str, item_text: str, length: int) -> tuple[DataFrame, DataFrame]:
    """The index of the texts, and the windows that they hold."""
    terms = saved(item_terms(items, item_id, item_text))
    counts = saved(term_counts(texts, terms))
    seeds = saved(_rarest(terms, counts, length, 2))
    index = postings(texts, seeds)
    return index, saved(phrases(texts, terms, aligned(index, seeds), length))


def contaminated(
    docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = 10
) -> DataFrame:
    """(id, n_words, n_hit, items) of every row: its words, those inside a window of an item, and the ids of the
    items with such windows, sorted as strings.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and of all other characters. A window is
    ``length`` consecutive words of an item, or all of a shorter one. Null and empty texts have no words; an
    item without words matches nothing, and one without an id counts for hits but is not listed. Repeated
    items count once; rows that repeat an id, or have none, are judged each by its own text. Other columns
    are ignored.
    """
    texts = keyed(docs, id, text)
    index, hits = _searched(texts, items, item_id, item_text, length)
    words = hits.select("doc", "key", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at"))
    n_hit = words.distinct().groupBy("doc", "key").agg(F.count("*").alias("n_hit"))
    listed = hits.select("doc", "key", F.col("item").cast("string").alias("item")).distinct()
    listed = listed.groupBy("doc", "key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    both = n_hit.join(listed, n_hit["doc"].eqNullSafe(listed["doc"]) & (n_hit["key"] == listed["key"]))
    both = both.select(n_hit["doc"].alias("_doc"), n_hit["key"].alias("_key"), "n_hit", "items")
    sizes = index.where("term IS NULL").select("doc", "key", F.col("at").cast("long").alias("n_words"))
    out = sizes.join(both, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("doc").alias(id), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def without_phrases(
    docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = 10
) -> DataFrame:
    """The rows, all columns, whose texts hold no window of an item; words and windows as in ``contaminated``."""
    _, hits = _searched(keyed(docs, id, text), items, item_id, item_text, length)
    hit = _small(saved(hits.select(F.col("doc").alias("_doc"), F.col("key").alias("_key")).distinct()))
    key = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(hit, docs[id].eqNullSafe(hit["_doc"]) & (key == hit["_key"]), "left_anti")


def near(docs: DataFrame, items: DataFrame, *, id: str, text: str, item_id: str, item_text: str, within: int) -> DataFrame:
    """(item, id, at): occurrences of an item's rarest word with every other word of it at most ``within`` places away.

    The proximity search of the same index, with postings for all terms of the items. Words may stand in any
    order; a word that the item has several times must occur once. Items without words match nothing.
    """
    texts = keyed(docs, id, text)
    terms = saved(item_terms(items, item_id, item_text).select("item", "part", "term").distinct())
    counts = term_counts(texts, terms)
    index = postings(texts, terms).where("term IS NOT NULL")
    known = terms.withColumn("folded", F.lower("term")).join(counts, "folded", "left")
    order = Window.partitionBy("item", "part").orderBy(F.coalesce("times", F.lit(0)), "term")
    rare = known.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("item", "part", "term")
    many = terms.groupBy("item", "part").agg(F.count("*").alias("many"))
    width = F.lit(max(within, 1))
    block = F.floor(F.col("at") / width)
    heads = index.join(rare.join(many.drop("item"), "part"), "term")
    heads = heads.select("item", "part", "many", "doc", "key", F.col("at").alias("head"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    others = index.join(terms, "term").select("part", "term", F.col("doc").alias("_doc"), "key", "at", block.alias("block"))
    met = heads.join(others, ["part", "key", "block"]).where(F.col("doc").eqNullSafe(F.col("_doc")))
    met = met.where(F.abs(F.col("at") - F.col("head")) <= within)
    met = met.groupBy("item", "part", "doc", "key", "head", "many").agg(F.count_distinct("term").alias("found"))
    return met.where("found = many").select("item", F.col("doc").alias(id), F.col("head").alias("at"))
