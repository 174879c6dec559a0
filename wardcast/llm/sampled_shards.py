"""Shards of nearly equal bytes by sampled splitters.

Keys are fingerprints of the texts, so equal texts are neighbours. A sample of keys, drawn in proportion to size,
gives the quantiles that cut the key space into ranges of nearly equal bytes, many for each shard; the driver
holds the sample, which has ``DRAWS`` keys for each range at any size of the input. Ranges that
turn out overfull are subdivided. A text whose copies alone would overfill a range becomes a part of its own, cut by
a hash of the identifier, whatever else the range holds; the other texts of the range are dealt by a hash of the
key, which keeps equal ones together. There are at most as many such texts and overfull ranges as ranges. The
counted ranges, whose number is a parameter, are then given to shards, the largest first to the emptiest.

Equal texts share a shard unless they alone are more than a shard's share of all bytes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardcast.llm.exchange import partitions
from wardcast.llm.storage import saved

#: Ranges for each shard, draws for each range, and how many times its share a range may hold.
RANGES, DRAWS, OVERFULL = 64, 40, 2


def sharded(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shards: int = 8, seed: int = 7) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row.

    ``size`` is the text's bytes in UTF-8 plus one, ``slot`` numbers a shard's rows from 0 without gaps. A null text
    counts as an empty one. Each row has a place of its own, rows with one id or none too. An empty table
    gives none; other columns are ignored. Reruns put every row into the same shard.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id).alias("id"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("key"),
    )
    rows = saved(rows)
    total, many = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(RANGES * shards, partitions(docs.sparkSession))

    # A row is drawn as often as its size holds whole draws, and once more by chance for the rest.
    chance = F.pmod(F.xxhash64("key", "id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = F.floor(F.col("size") * F.lit(DRAWS * ranges / max(total, 1)) + chance).cast("int")
    sample = rows.where(drawn > 0).select("key", F.explode(F.array_repeat(F.lit(0), drawn)))
    keys = np.sort(np.array([r.key for r in sample.select("key").collect()], np.int64))
    splitters = np.unique(keys[len(keys) * np.arange(1, ranges) // ranges]) if len(keys) else keys

    @F.arrow_udf("int")
    def range_of(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(splitters, keys.to_numpy(zero_copy_only=False), side="right"), pa.int32())

    placed = rows.withColumn("range", range_of("key"))
    most_bytes, most_rows = OVERFULL * total / ranges, OVERFULL * many / ranges
    pieces = F.greatest(F.ceil(F.sum("size") / F.lit(max(most_bytes, 1))), F.ceil(F.count("*") / F.lit(max(most_rows, 1))))
    full = placed.groupBy("range").agg(pieces.alias("parts")).where("parts > 1").select("range")
    alone = placed.join(F.broadcast(full), "range", "left_semi").groupBy("key").agg(pieces.alias("pieces")).where("pieces > 1")
    alone = [(r.key, -1 - i, r.pieces) for i, r in enumerate(sorted(alone.collect()))]
    alone = docs.sparkSession.createDataFrame(alone, "key long, own long, pieces long")
    placed = placed.join(F.broadcast(alone), "key", "left")
    split = placed.where("own IS NULL").groupBy("range").agg(pieces.alias("parts")).where("parts > 1")
    hashed = F.pmod(F.xxhash64("key", F.lit(seed)), F.coalesce("parts", F.lit(1)))
    piece = F.pmod(F.xxhash64("id", F.lit(seed)), F.coalesce("pieces", F.lit(1)))
    placed = placed.join(F.broadcast(split), "range", "left").withColumns({"part": F.coalesce("own", hashed), "piece": piece})
    placed = saved(placed.drop("own", "pieces", "parts"))

    counted = placed.groupBy("range", "part", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    units = assigned([tuple(r) for r in counted.collect()], shards, total)
    names = "range int, part long, piece long, shard int, start long"
    units = docs.sparkSession.createDataFrame(units, names) if units else docs.sparkSession.createDataFrame([], names)
    order = Window.partitionBy("range", "part", "piece").orderBy("key", "id")
    out = placed.withColumn("place", F.row_number().over(order)).join(units, ["range", "part", "piece"])
    slot = (F.col("start") + F.col("place") - 1).cast("long")
    return out.select(F.col("id").alias(id), "size", "text_crc32", "shard", slot.alias("slot"))


def assigned(units: list[tuple], shards: int, total: int) -> list[tuple]:
    """(range, part, piece, shard, first slot) for (range, part, piece, bytes, rows).

    The pieces of a part stay together unless the part is more than a shard's share.
    """
    groups: dict[tuple, list[tuple]] = {}
    for unit in units:
        groups.setdefault(tuple(unit[:2]), []).append(unit)
    atoms: list[list[tuple]] = []
    for group in groups.values():
        atoms += [group] if sum(u[3] for u in group) * shards <= total else [[u] for u in group]
    atoms.sort(key=lambda a: (-sum(u[3] for u in a), a[0][:3]))
    loads = [(0, shard) for shard in range(shards)]
    chosen: dict[tuple, int] = {}
    for atom in atoms:
        load, shard = heapq.heappop(loads)
        heapq.heappush(loads, (load + sum(u[3] for u in atom), shard))
        chosen |= {u[:3]: shard for u in atom}
    start, out = [0] * shards, []
    for unit in sorted(units):
        shard = chosen[unit[:3]]
        out.append((*unit[:3], shard, start[shard]))
        start[shard] += unit[4]
    return out
