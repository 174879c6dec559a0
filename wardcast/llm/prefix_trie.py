"""The trie of conversation prefixes, from vertical bitmaps.

Conversations are numbered by id and dealt into shards of ``SHARD`` consecutive ones. A shard's index maps each
(position, turn) to a bitset of its conversations; going down from the root, a node's bitset is intersected with the
postings of the next position, which yields its children, their popcounts, and the list of conversations that end
there. Nodes of different shards are the same if their prefixes are, which a 128-bit sum over (position, turn) tells.

A shard's nodes are merged by prefix, so a prefix that a third of all conversations share is one row for each shard.
Sums over subtrees need no walk across shards: every node is counted by the shard that holds its smallest member,
whose trie has all of the node's ancestors, and the shards' sums for an ancestor are added.

Long conversations are cut into bands of ``BAND`` turns. A band's trie begins with the nodes that its pieces come
from, and what the later bands of a conversation add to its ancestors is carried to the end of its earlier pieces, so a
task holds ``SHARD`` pieces of at most ``BAND`` turns (28 bytes a turn), and no texts.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardcast.llm.numbering import numbered
from wardcast.llm.storage import saved
from wardcast.llm.words import mix

SHARD, BAND = 4096, 1024
KEY = ["k1", "k2", "depth"]
NODES = (
    "band long, shard long, i long, up long, k1 long, k2 long, depth long, conv_id long, n long, size long, more boolean,"
    " ends array<long>, through array<long>"
)
SUMS = "k1 long, k2 long, depth long, conv_id long, n long, parent long, children long, leaves long, saved long"


def turns(rows: DataFrame, *, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, at, of, t1, t2, size) of every turn: its place, its conversation's length, its digest and its bytes.

    Turns are in order of their number, null first; turns of equal number are in order of their digests, and rows
    equal in all of it are turns of their own. A null role or text is empty. Rows without a conversation id
    belong to no conversation and take no part.
    """
    role, text = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    terms = F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2")
    picked = rows.select(F.col(id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), *terms, F.octet_length(text).cast("long").alias("size"))
    return numbered(picked.where("conv_id IS NOT NULL"), "conv_id", ["turn", "t1", "t2"]).drop("turn")


def rebuilt(own: DataFrame, *, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, of) that begin with the first turns of another one, and their turns.

    ``base`` and ``head`` are expressions of ``conv_id``: the other conversation, and how many of its first turns, at
    most, take the place of as many of the conversation's own. ``head`` is small. A conversation whose base is not
    there has no turns in their place.
    """
    convs = own.groupBy("conv_id").agg(F.max("of").alias("length"))
    convs = convs.select("conv_id", "length", base.cast("long").alias("base"), head.cast("long").alias("head"))
    others = convs.select(F.col("conv_id").alias("base"), F.col("length").alias("there"))
    convs = convs.join(others, "base", "left").withColumn("taken", F.least("head", F.coalesce("there", F.lit(0))))
    convs = saved(convs.withColumn("of", F.col("taken") + F.greatest(F.col("length") - F.col("head"), F.lit(0))))
    most = convs.agg(F.max("taken")).first()[0] or 0
    firsts = own.where(F.col("at") < most).withColumnRenamed("conv_id", "base").drop("of")
    first = firsts.join(convs.drop("there"), "base").where("at < taken").select("conv_id", "at", "of", "t1", "t2", "size")
    rest = own.where(F.col("at") >= head).drop("of").join(convs, "conv_id")
    rest = rest.select("conv_id", (F.col("at") - F.col("head") + F.col("taken")).alias("at"), "of", "t1", "t2", "size")
    return convs.select("conv_id", "of"), first.unionByName(rest)


def trie(convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and the lists of the conversations that end at them.

    ``convs`` has every (conv_id, of) once, ``rows`` their turns (conv_id, at, of, t1, t2, size), with places from 0
    without gaps. Nodes: k1, k2, depth (the prefix), conv_id (the smallest member), n (members), parent (the parent's
    smallest member, null for the root), children, leaves (nodes without children in the subtree), saved (sum over
    the subtree of (n - 1) times the bytes of the node's last turn). Lists: k1, k2, depth, shard, ends; ids ascend
    within a list and lists ascend with the shard. Without conversations there is no node.
    """
    places = numbered(convs.select("conv_id", F.lit(0).alias("one"), F.col("of").alias("length")), "one", ["conv_id"])
    places = places.select("conv_id", F.col("at").alias("ordinal"), "length")
    placed = saved(rows.select("conv_id", "at", "t1", "t2", "size").join(places, "conv_id").withColumn("band", F.expr(f"at div {BAND}")))
    pieces = _entries(placed, places).unionByName(placed).withColumn("shard", F.expr(f"ordinal div {SHARD}"))
    local = saved(pieces.groupBy("band", "shard").applyInArrow(_local_nodes, NODES))

    merged = saved(local.groupBy(KEY).agg(F.min("conv_id").alias("first"), F.sum("n").alias("all"), F.max("size").alias("bytes"), F.max("more").alias("inner")))
    known = local.select("band", "shard", "i", "up", *KEY, "conv_id").join(merged, KEY)
    later = _later(merged, local)
    parts = known.groupBy("band", "shard").cogroup(later.groupBy("in_band", "in_shard")).applyInArrow(_local_sums, SUMS)
    sums = [F.sum(c).alias(c) for c in ("children", "leaves", "saved")]
    nodes = parts.groupBy(KEY).agg(F.max("conv_id").alias("conv_id"), F.max("n").alias("n"), F.max("parent").alias("parent"), *sums)
    return nodes, local.where(F.size("ends") > 0).select(*KEY, "shard", "ends")


def _entries(placed: DataFrame, places: DataFrame) -> DataFrame:
    """One row before each piece, with the key of the node that it goes on from in t1 and t2 and no size."""
    zero = F.lit(0).cast("long")
    start = places.select("conv_id", (zero - 1).alias("at"), zero.alias("t1"), zero.alias("t2"), zero.alias("size"), "ordinal", "length", zero.alias("band"))
    long = placed.where(F.col("length") > BAND)
    sums = long.mapInArrow(_with_terms, "conv_id long, ordinal long, length long, band long, t1 long, t2 long")
    sums = sums.groupBy("conv_id", "ordinal", "length", "band").agg(F.bit_xor("t1").alias("t1"), F.bit_xor("t2").alias("t2"))
    so_far = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumns({k: F.bit_xor(k).over(so_far) for k in ("t1", "t2")}).withColumn("band", F.col("band") + 1)
    sums = sums.where(F.col("band") * BAND < F.col("length")).withColumns({"at": F.col("band") * BAND - 1, "size": zero})
    return start.unionByName(sums.select(start.columns))


def _terms(at: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a turn at its place adds to the keys of the prefixes that hold it."""
    step = at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(t1.view(np.uint64) + step).view(np.int64), mix(t2.view(np.uint64) ^ mix(step + np.uint64(1))).view(np.int64)


def _with_terms(batches):
    for b in batches:
        if b.num_rows:
            k1, k2 = _terms(*(b[c].to_numpy() for c in ("at", "t1", "t2")))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("conv_id", "ordinal", "length", "band")), pa.array(k1), pa.array(k2)], names=["conv_id", "ordinal", "length", "band", "t1", "t2"])


def _local_nodes(table: pa.Table) -> pa.Table:
    """The trie of a shard's pieces of a band, parents before children."""
    table = table.sort_by([("ordinal", "ascending"), ("at", "ascending")])
    band, shard = table["band"][0].as_py(), table["shard"][0].as_py()
    at, ids, length, size = (table[c].to_numpy() for c in ("at", "conv_id", "length", "size"))
    t1, t2 = (np.ascontiguousarray(table[c].to_numpy()) for c in ("t1", "t2"))
    heads = np.flatnonzero((at + 1 == band * BAND) & (size == 0) & np.concatenate(([True], ids[1:] != ids[:-1])))
    k1, k2 = (x.tolist() for x in _terms(at, t1, t2))
    turn, size, ids, length = list(zip(t1.tolist(), t2.tolist(), strict=True)), size.tolist(), ids[heads].tolist(), length[heads].tolist()
    first, entry = (heads + 1).tolist(), [turn[h] for h in heads.tolist()]
    count = np.diff(np.append(heads, len(at))).tolist()
    count = [c - 1 for c in count]

    index: dict[tuple, int] = defaultdict(int)
    starts: dict[tuple, int] = defaultdict(int)
    stops = [0] * (max(count) + 1)
    for c, low in enumerate(first):
        own = 1 << c
        starts[entry[c]] |= own
        for p in range(count[c]):
            index[p, turn[low + p]] |= own
        stops[count[c]] |= own

    out: dict[str, list] = {n.split()[0]: [] for n in NODES.split(", ")}

    def node(up: int, key: tuple, p: int, bits: int, size: int) -> int:
        i, smallest = len(out["i"]), (bits & -bits).bit_length() - 1
        done = bits & stops[p]
        ends, through = [], []
        while done:
            c = (done & -done).bit_length() - 1
            done &= done - 1
            (ends if length[c] == band * BAND + p else through).append(ids[c])
        own = band == 0 or p > 0
        goes_on = bool(through) or bool(bits & ~stops[p])
        row = (band, shard, i, up, *key, band * BAND + p, ids[smallest], bits.bit_count() if own else 0, size, goes_on, ends if own else [], through if own else [])
        for column, value in zip(out.values(), row, strict=True):
            column.append(value)
        return i

    waiting = [(node(-1, key, 0, bits, 0), key, 0, bits) for key, bits in starts.items()]
    while waiting:
        up, key, p, bits = waiting.pop()
        rest = bits & ~stops[p]
        while rest:
            c = (rest & -rest).bit_length() - 1
            place = first[c] + p
            child = bits & index[p, turn[place]]
            rest &= ~child
            below = (key[0] ^ k1[place], key[1] ^ k2[place])
            waiting.append((node(up, below, p + 1, child, size[place]), below, p + 1, child))
    kinds = [pa.bool_() if n == "more" else pa.list_(pa.int64()) if n in ("ends", "through") else pa.int64() for n in out]
    return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def _later(merged: DataFrame, local: DataFrame) -> DataFrame:
    """What the later bands of conversations add above the local nodes (in_band, in_shard, place) that their pieces end at."""
    band = F.greatest(F.expr(f"(depth - 1) div {BAND}"), F.lit(0).cast("long"))
    own = merged.where(F.col("depth") > BAND).groupBy(F.col("first").alias("conv_id"), band.alias("band")).agg(F.sum((~F.col("inner")).cast("long")).alias("leaves"), F.sum((F.col("all") - 1) * F.col("bytes")).alias("saved"))
    past = local.select(F.col("band").alias("in_band"), F.col("shard").alias("in_shard"), F.col("i").alias("place"), F.explode("through").alias("conv_id"))
    every = own.select("conv_id", "band", "leaves", "saved").unionByName(past.select("conv_id", F.col("in_band").alias("band"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))).groupBy("conv_id", "band").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    after = Window.partitionBy("conv_id").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tails = every.select("conv_id", "band", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(c) for c in ("leaves", "saved")])
    tails = tails.withColumnRenamed("band", "in_band")
    return past.join(tails, ["conv_id", "in_band"]).groupBy("in_band", "in_shard", "place").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _local_sums(nodes: pa.Table, later: pa.Table) -> pa.Table:
    """Sums over the subtrees of a shard's trie of a band, of the nodes whose smallest member it holds."""
    nodes = nodes.sort_by("i")
    n = nodes.num_rows
    i, up, depth, own, first, every, size = (nodes[c].to_numpy() for c in ("i", "up", "depth", "conv_id", "first", "all", "bytes"))
    inner = nodes["inner"].to_numpy(zero_copy_only=False).astype(bool)
    entry = (up < 0) & (depth > 0)
    here = (own == first) & ~entry
    leaves, kept, children = (here & ~inner).astype(np.int64), np.where(here, (every - 1) * size, 0), np.zeros(n, np.int64)
    if later.num_rows:
        at = later["place"].to_numpy()
        leaves[at] += later["leaves"].to_numpy()
        kept[at] += later["saved"].to_numpy()
    below = up >= 0
    np.add.at(children, up[below], here[below])
    for k in np.flatnonzero(below)[::-1].tolist():
        leaves[up[k]] += leaves[k]
        kept[up[k]] += kept[k]
    leaves[entry] = kept[entry] = 0
    parent = pa.array(np.where(below, first[up], 0), mask=~below)
    columns = [*(nodes[c] for c in KEY), nodes["first"], nodes["all"], parent, pa.array(children), pa.array(leaves), pa.array(kept)]
    return pa.Table.from_arrays(columns, names=[c.split()[0] for c in SUMS.split(", ")])


def ends_digest(lists: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256): lowercase hex SHA-256 of the ids of each node's lists, comma-joined.

    A node's lists come to one task one by one, in order of their shards, and are not held: the digest of a text
    is made in order.
    """
    import hashlib

    def read(batches):
        key, state = None, None
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    if key is not None:
                        found.append((*key, state.hexdigest()))
                    key, state = row[:3], hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, row[4])).encode())
            yield table(found)
        if key is not None:
            yield table([(*key, state.hexdigest())])

    def table(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.string()]
        columns = list(zip(*found, strict=True)) if found else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*KEY, "ends_sha256"])

    dealt = lists.select(*KEY, "shard", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "shard")
    return dealt.mapInArrow(read, "k1 long, k2 long, depth long, ends_sha256 string")
