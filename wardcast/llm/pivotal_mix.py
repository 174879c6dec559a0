"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its texts should have, a fraction as a
rule. The whole part is taken; the fractional parts are rounded in pairs: mass moves at random from one of
two texts to the other, as much as makes one of them 0 or 1, so that the expected copies of each text and
the total size of the pair stay what they were. What is left of a group of texts is one fractional text, which
meets those of other groups in a tree, until each source has one left and that is rounded alone. So a
source's size differs from its target by less than one text.

Groups are dealt by a hash and have a bounded expected number of texts, so a source with a third of all rows is
many groups. The random numbers of a group follow from its name, so reruns agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.llm.storage import saved
from wardcast.llm.words import counted

GROUP, FAN_IN = 1024, 64
#: Up to so many sources, their targets are sent to every executor; beyond, they are joined by a shuffle.
MANY_SOURCES = 10_000


@F.arrow_udf(T.LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; none of a null."""
    return pa.array(counted(texts), pa.int64())


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size, rows, target) from (source, source_size, rows).

    Sources by code point, null last, have the weights in turn and share the total size by them; a target stops at
    ``most`` times its source's size, and the excess goes to the others by weight until none is above. That is
    one level L with target = least(most * size, L * weight): sources are taken in the order in which they
    reach their limit, and L follows from what the first of them leave to the rest.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    at = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")
    named = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), at))
    named = named.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_limit = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    earlier, every = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    # The level rises while sources at their limit are set aside and falls once one that is not would be.
    level = F.max("level").over(every) * F.col("weight")
    named = named.withColumn("level", left / share).withColumn("target", F.least("cap", level))
    return named.select("source", "source_size", "rows", "target")


def rounded(size: np.ndarray, x: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Fractions turned into 0 or 1 in pairs; the place of the one that is left, or -1."""
    a, x, held = size.tolist(), x.tolist(), -1
    for j, draw in enumerate(draws.tolist()):
        if not 0.0 < x[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i, p, q = held, x[held], x[j]
        rise, fall, sink, lift = (1 - p) * a[i], q * a[j], p * a[i], (1 - q) * a[j]
        up, down = min(rise, fall), min(sink, lift)
        if draw * (up + down) < down:
            p = 1.0 if rise <= fall else min(p + up / a[i], 1.0)
            q = 0.0 if fall <= rise else max(q - up / a[j], 0.0)
        else:
            p = 0.0 if sink <= lift else max(p - down / a[i], 0.0)
            q = 1.0 if lift <= sink else min(q + down / a[j], 1.0)
        x[i], x[j] = p, q
        held = i if 0.0 < p < 1.0 else j if 0.0 < q < 1.0 else -1
    return np.array(x), held


def _level(rows: DataFrame, source: str, id: str, size: str, level: int, seed: int, last: bool) -> DataFrame:
    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by([(size, "descending"), (id, "ascending")])  # so that a small text is left
        name = str(table[source][0].as_py()).encode() + b"/%d/%d" % (level, table["_node"][0].as_py())
        random = np.random.Generator(np.random.PCG64([seed, zlib.crc32(name), len(name)]))
        x, held = rounded(table[size].to_numpy(), table["_x"].to_numpy(), random.random(table.num_rows))
        if last and held >= 0:
            x[held] = float(random.random() < x[held])
        return table.set_column(table.column_names.index("_x"), "_x", pa.array(x))

    return rows.groupBy(source, "_node").applyInArrow(each, rows.schema)


def mixed(
    rows: DataFrame, *, id: str, source: str, size: str, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 1
) -> DataFrame:
    """The rows with ``source_size``, ``target`` and ``copies``, the number of times that the mix takes each.

    Sizes are whole numbers; a null one counts as 0. ``copies`` is the target over the source's size, rounded up
    or down, so it is at most ``most``. Texts of size 0 are rounded one by one, as they carry no mass. A null
    source is a source of its own, the last one. Each row counts for itself, rows with one id or none too. An
    empty table gives none. Columns named like the new ones are replaced.
    """
    rows = rows.withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("long")).drop("source_size", "target", "copies")
    sizes = rows.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"), F.count("*").alias("rows"))
    aims = saved(targets(sizes, weights, most)).withColumnRenamed("source", "_source").withColumnRenamed("rows", "_rows")
    many, largest = aims.agg(F.count("*"), F.max("_rows")).first()
    if not many:
        largest = 0
    on = rows[source].eqNullSafe(aims["_source"])
    every = rows.join(F.broadcast(aims) if many <= MANY_SOURCES else aims, on)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + F.lit(1e-12))
    draw = F.pmod(F.xxhash64(id, source, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = F.greatest(ratio - F.col("_whole"), F.lit(0.0))
    part = F.when(part < 1e-12, F.lit(0.0)).when(F.col(size) > 0, part).otherwise((draw < part).cast("double"))
    group = F.pmod(F.xxhash64(id, size), F.ceil(F.col("_rows") / F.lit(GROUP)))
    state = every.withColumn("_whole", whole).withColumn("_x", part).withColumn("_node", group).drop("_source", "_rows")

    nodes, level, finished = max(-(-largest // GROUP), 1), 0, []
    while True:
        last = nodes == 1
        step = saved(_level(state, source, id, size, level, seed, last))
        finished.append(step.where("_x <= 0 OR _x >= 1"))
        if last:
            break
        state = step.where("_x > 0 AND _x < 1").withColumn("_node", F.floor(F.col("_node") / F.lit(FAN_IN)))
        nodes, level = -(-nodes // FAN_IN), level + 1
    out = finished[0]
    for x in finished[1:]:
        out = out.unionByName(x)
    return out.withColumn("copies", F.col("_whole") + F.col("_x").cast("long")).drop("_whole", "_x", "_node")
