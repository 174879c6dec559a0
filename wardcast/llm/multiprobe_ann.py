"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are scaled into the unit ball and given one more component that puts them on the sphere, so a larger
inner product is a smaller distance. A table hashes a vector to the cells that its projections on random
(2-stable) directions fall into. A query visits its own bucket and those next to it, in the order of the
estimated chance of success: how far the query is from the borders that a perturbation crosses.

Bucket holders and the queries that probe them meet in parts of the key space, where exact inner products
rerank them, and those of all parts and tables are merged. This takes two rounds. The first visits the likeliest
bucket of each table, a fixed number a query, and so gives every query a bar: its k-th best so far. In the second,
which visits the others, a part returns only what reaches the bar. The first round sees a share of the vectors that
does not depend on how many there are or into how many parts they fall, so neither does the number of rows returned
for a query.
Equal vectors are indexed once, with as many of their smallest ids as an answer can hold. A bucket with more
vectors than ``BLOCK`` is split, and its probes go to all of its blocks. Queries for which the probes found fewer
than k candidates are compared with all vectors, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardcast.llm.storage import saved
from wardcast.llm.words import mix

#: About so many indexed vectors meet their probes in one task, and at most so many of one bucket.
BLOCK = 8_192


class Tables:
    """Hash tables over vectors of one dimension; the same seed gives the same tables."""

    def __init__(self, dimension: int, tables: int, projections: int, width: float, probes: int, seed: int):
        random = np.random.default_rng(seed)
        self.directions = random.normal(size=(tables, dimension + 1, projections)) / width
        self.shifts = random.random((tables, projections))
        steps = np.array(np.meshgrid(*[(0, -1, 1)] * projections, indexing="ij")).reshape(projections, -1).T
        self.steps, self.probes = steps, min(probes, len(steps))

    def places(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return vectors @ self.directions[table] + self.shifts[table]

    def buckets(self, cells: np.ndarray, table: int) -> np.ndarray:
        key = np.full(cells.shape[:-1], table, np.uint64)
        for k in range(cells.shape[-1]):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[..., k].astype(np.int64).view(np.uint64))
        return key.view(np.int64)

    def probed(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """The buckets to visit, the likeliest first: a row for each vector."""
        at = self.places(vectors, table)
        cell = np.floor(at)
        below = at - cell
        cost = np.zeros((len(vectors), len(self.steps)))
        for k in range(self.steps.shape[1]):
            step = self.steps[:, k]
            cost += np.where(step == 0, 0, np.where(step < 0, below[:, k : k + 1] ** 2, (1 - below[:, k : k + 1]) ** 2))
        first = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
        return self.buckets(cell[:, None, :] + self.steps[first], table)


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _unit(vectors: np.ndarray, longest: float | None) -> np.ndarray:
    """Indexed vectors over the longest one's norm, or (None) queries over their own, on the sphere."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    if longest is None:
        return np.hstack((vectors / norms, np.zeros((len(vectors), 1))))
    return np.hstack((vectors / longest, np.sqrt(np.maximum(1 - (norms / longest) ** 2, 0))))


def _best(own: pa.Table, asked: pa.Table, dimension: int, k: int) -> Iterator[pa.Table]:
    """The k nearest of each query in one part that reach its bar, over all buckets that both sides name."""
    x, q = _matrix(own["vector"], dimension), _matrix(asked["vector"], dimension)
    buckets, low = own["bucket"].to_numpy(), own["low"].to_numpy()
    probes, bars = asked["bucket"].to_numpy(), asked["bar"].to_numpy()
    # Products by matrix and by pair differ by rounding: far less than this share of the norms.
    slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)
    names, query = np.unique(np.stack((asked["q1"].to_numpy(), asked["q2"].to_numpy()), 1), axis=0, return_inverse=True)
    query = query.reshape(-1)
    by, probe_order = np.argsort(buckets, kind="stable"), np.argsort(probes, kind="stable")
    common = np.intersect1d(buckets, probes)
    edges = [np.searchsorted(buckets[by], common, s) for s in ("left", "right")]
    probe_edges = [np.searchsorted(probes[probe_order], common, s) for s in ("left", "right")]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b, c, d in zip(*edges, *probe_edges, strict=True):
        rows = by[a:b]
        for at in range(int(c), int(d), 512):
            some = probe_order[at : min(at + 512, int(d))]
            near = q[some] @ x[rows].T
            bar = bars[some]
            if len(rows) > k:
                bar = np.maximum(bar, np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k])
            i, j = np.nonzero(near >= (bar - slack[some])[:, None])
            if len(i):
                pairs.append((some[i], rows[j]))
    if not pairs:
        return
    i, j = (np.concatenate(c) for c in zip(*pairs, strict=True))
    score = np.concatenate([(q[i[a : a + 65536]] * x[j[a : a + 65536]]).sum(axis=1) for a in range(0, len(i), 65536)])
    of = query[i]
    order = np.lexsort((j, low[j], -score, of))
    of, j, score = of[order], j[order], score[order]
    v1, v2 = own["v1"].to_numpy()[j], own["v2"].to_numpy()[j]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (v1[1:] != v1[:-1]) | (v2[1:] != v2[:-1])
    of, j, v1, v2, score = of[new], j[new], v1[new], v2[new], score[new]
    keep = np.arange(len(of)) - np.searchsorted(of, of) < k
    of, j, v1, v2, score = of[keep], j[keep], v1[keep], v2[keep], score[keep]
    yield pa.table(
        {"q1": names[of, 0], "q2": names[of, 1], "v1": v1, "v2": v2, "low": low[j], "score": score}
    )


_FOUND = "q1 long, q2 long, v1 long, v2 long, low long, score double"


def _met(index: DataFrame, probes: DataFrame, dimension: int, k: int) -> DataFrame:
    """Index rows (part, bucket, v1, v2, low, vector) and probes (part, bucket, q1, q2, bar, vector), by part."""

    def each(own: pa.Table, asked: pa.Table) -> pa.Table:
        found = list(_best(own, asked, dimension, k)) if own.num_rows and asked.num_rows else []
        return pa.concat_tables(found) if found else pa.table({n: pa.array([], t) for n, t in _TYPES})

    return index.groupBy("part").cogroup(probes.groupBy("part")).applyInArrow(each, _FOUND)


_TYPES = [(n, pa.int64()) for n in ("q1", "q2", "v1", "v2", "low")] + [("score", pa.float64())]


def _bars(found: DataFrame, k: int) -> DataFrame:
    """(q1, q2, bar): the k-th best score among the different vectors found, for queries with so many."""
    different = found.groupBy("q1", "q2", "v1", "v2").agg(F.max("score").alias("score"))
    ahead = Window.partitionBy("q1", "q2").orderBy(F.desc("score"))
    return different.withColumn("place", F.row_number().over(ahead)).where(F.col("place") == k).select("q1", "q2", F.col("score").alias("bar"))


def nearest(
    rows: DataFrame, queries: Column, *, id: str, vector: str, k: int = 20, tables: int = 6, projections: int = 6,
    width: float = 2.0, probes: int = 48, seed: int = 11,
) -> DataFrame:
    """(query_id, rank, id, score): the k rows with the largest inner products found for each row that ``queries``
    marks, in double precision, ties to the smaller id.

    A query's own id is no candidate. Rows without an id, and vectors that are null or zero, that hold nulls or
    values that are not finite, or whose length is not the most frequent one, take no part. Repeated rows are
    candidates each. With k candidates or fewer, all are returned. Other columns are ignored.
    """
    good = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = good.where("id IS NOT NULL AND vector IS NOT NULL").where(fine & F.exists("vector", lambda x: x != 0))
    sizes = good.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("many")).orderBy(F.desc("many"), "size")
    dimension = (sizes.first() or [1])[0]
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = good.where(F.size("vector") == dimension).withColumns(
        {"v1": F.xxhash64("vector"), "v2": F.xxhash64(F.lit(1), "vector"), "square": squares}
    )
    # Of equal vectors an answer holds the k smallest ids at most, and one more where the query is among them.
    first = Window.partitionBy("v1", "v2").orderBy("id")
    few = good.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    once = few.groupBy("v1", "v2").agg(
        F.sort_array(F.collect_list("id")).alias("ids"), F.min("id").alias("low"), F.first("vector").alias("vector"), F.max("square").alias("square")
    )
    once = saved(once)
    square, many = once.agg(F.max("square"), F.count("*")).first()
    longest, n = float(square or 1.0) ** 0.5, max(-(-many * tables // BLOCK), 1)
    wanted = saved(good.where("asked").groupBy("v1", "v2").agg(F.first("vector").alias("vector")).withColumnsRenamed({"v1": "q1", "v2": "q2"}))
    hashed = Tables(dimension, tables, projections, width, probes, seed)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column("vector"), dimension), longest)
            for t in range(tables):
                bucket = hashed.buckets(np.floor(hashed.places(unit, t)), t)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], names=["bucket", *batch.schema.names])

    kind = rows.schema[vector].dataType.simpleString()

    def probing(asking: DataFrame, visits: slice) -> DataFrame:
        """The buckets of those places in each query's order, in every table."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 256):
                    some = batch.slice(low, 256)
                    unit = _unit(_matrix(some.column("vector"), dimension), None)
                    for t in range(tables):
                        bucket = hashed.probed(unit, t)[:, visits]
                        at = pa.array(np.repeat(np.arange(some.num_rows), bucket.shape[1]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(bucket.reshape(-1)), *(c.take(at) for c in some.columns)], names=["bucket", *some.schema.names]
                        )

        return asking.select("q1", "q2", "bar", "vector").mapInArrow(each, f"bucket long, q1 long, q2 long, bar double, vector {kind}")

    index = once.select("v1", "v2", "low", "vector").mapInArrow(indexed, f"bucket long, v1 long, v2 long, low long, vector {kind}")
    large = saved(index.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks")).where("blocks > 1"))
    split = not large.isEmpty()
    part = F.pmod(F.xxhash64("bucket", "block"), F.lit(n)).cast("int")
    held = F.pmod("v1", F.coalesce("blocks", F.lit(1))).cast("int") if split else F.lit(0)
    index = (index.join(large, "bucket", "left") if split else index).withColumn("block", held).withColumn("part", part)
    blocks = F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)).cast("int"))

    def visited(asking: DataFrame, visits: slice) -> DataFrame:
        probe = probing(asking, visits)
        probe = probe.join(large, "bucket", "left").withColumn("block", F.explode(blocks)) if split else probe.withColumn("block", F.lit(0))
        return _met(index, probe.withColumn("part", part), dimension, k + 1)

    wanted = wanted.withColumn("bar", F.lit(float("-inf")))
    likeliest = saved(visited(wanted, slice(0, 1)))
    bars = _bars(likeliest, k + 1)
    raised = wanted.drop("bar").join(bars, ["q1", "q2"], "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    found = likeliest.unionByName(saved(visited(raised, slice(1, None))))

    counts = found.groupBy("q1", "q2").agg(F.count_distinct("v1", "v2").alias("many"))
    short = wanted.join(counts.where(F.col("many") > k), ["q1", "q2"], "left_anti")
    whole = max(-(-many // BLOCK), 1)
    everywhere = short.withColumns({"bucket": F.lit(0), "part": F.explode(F.sequence(F.lit(0), F.lit(whole - 1)))})
    spread = once.withColumns({"bucket": F.lit(0), "part": F.pmod("v1", F.lit(whole)).cast("int")})
    found = found.unionByName(_met(spread, everywhere, dimension, k + 1))

    merged = found.groupBy("q1", "q2", "v1", "v2", "low").agg(F.max("score").alias("score"))
    ahead = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "low")
    merged = merged.withColumn("place", F.row_number().over(ahead)).where(F.col("place") <= k + 1)
    merged = merged.join(once.select("v1", "v2", "ids"), ["v1", "v2"])
    asking = good.where("asked").select(F.col("id").alias("query_id"), F.col("v1").alias("q1"), F.col("v2").alias("q2"))
    out = asking.join(merged.select("q1", "q2", "score", F.explode("ids").alias("id")), ["q1", "q2"]).where("id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(id), "score")
