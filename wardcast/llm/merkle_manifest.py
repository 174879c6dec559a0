"""A Merkle tree over every row of a table, with a proof for each row.

Rows are the leaves of one tree for each group, in order of their ids; the groups' roots are the leaves of the tree
above them. Every 8 consecutive nodes have a parent, the digest of theirs, while more than one node remains.

The tree is worked through forward in time: a node is due at its label, (level, place), and digests wait in a priority
queue, ordered by the label of the parent that they are sent to, until it is due. The queue is external: what crosses
blocks of 8**3 consecutive nodes waits in Spark's shuffle, ordered by the block that it goes to, and a task holds the
queue of one block. The sweep back runs the labels in reverse and sends every node the part of the proofs that its
leaves have in common, from the root down. A block holds at most 512 rows, whatever share of the table its group is.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wardcast.llm.numbering import numbered
from wardcast.llm.storage import saved

FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
PROOF = "array<struct<left:string,right:string>>"


def row_digest(columns: Sequence[Column | str]) -> Column:
    """Lowercase hex SHA-256 of the values, each with its length in bytes in front, or ``-`` if it is null."""
    parts = []
    for column in columns:
        value = (F.col(column) if isinstance(column, str) else column).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof amount to."""
    return F.aggregate(proof, leaf, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Lowercase hex SHA-256 of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(rows: DataFrame, *, id: str, group: str, leaf: Column, carry: dict[str, Column] | None = None) -> DataFrame:
    """``id``, ``leaf``, the ``carry`` columns, ``subroot``, ``root`` and ``proof`` of every row.

    ``proof`` has one entry for each level from the leaf to the root: the digests of the node's siblings to the left and
    to the right, each one text. A group of one row has no level of its own, and one group alone none above it.
    A null group is a group of its own, before all others; groups are in order of their UTF-8 bytes. Rows without an
    id come first in their group; rows with equal ids are in order of their leaves, and rows equal in both have one
    place each, in any order. An empty table has no root and no rows.
    """
    carry = carry or {}
    key = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("."), F.col(group).cast("string")))
    picked = rows.select(F.col(id).alias("id"), key.alias("g"), leaf.alias("digest"), *[c.alias(f"_{n}") for n, c in carry.items()])
    own = _upwards(numbered(picked, "g", ["id", "digest"]))
    above = own[-1].select(F.lit(0).alias("one"), F.col("g").alias("name"), "digest")
    top = _upwards(numbered(above, "one", ["name"]).withColumnRenamed("one", "g"))
    root = top[-1].select("digest").first()
    ends = top[-1].select("g", "at", F.array().cast(PROOF).alias("proof"), F.lit("").alias("subroot"))
    proofs = _downwards(top, ends).select(F.col("name").alias("g"), F.lit(0).cast("long").alias("at"), "proof", F.col("digest").alias("subroot"))
    out = _downwards(own, saved(proofs))
    extra = [F.col(f"_{n}").alias(n) for n in carry]
    return out.select(F.col("id").alias(id), F.col("digest").alias("leaf"), *extra, "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "proof")


def _upwards(nodes: DataFrame) -> list[DataFrame]:
    """The nodes (g, at, of, digest) at the foot of each round's blocks, up to the last, with one node for each g."""
    rounds, most = [nodes], nodes.agg(F.max("of")).first()[0] or 0
    while most > 1:
        low = rounds[-1].select("g", "at", "of", "digest", F.expr(f"at div {BLOCK}").alias("block"))
        kind = low.schema["g"].dataType.simpleString()
        rounds.append(saved(low.groupBy("g", "block").applyInArrow(_grown, f"g {kind}, at long, of long, digest string")))
        most = -(-most // BLOCK)
    return rounds


def _downwards(rounds: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The columns of the first round with the proof and the subroot of each node, from those of the last (ends)."""
    for i, nodes in reversed(list(enumerate(rounds[:-1]))):
        kind = T.StructType([*nodes.schema.fields, *T.StructType.fromDDL(f"proof {PROOF}, subroot string").fields])
        low = nodes.withColumn("block", F.expr(f"at div {BLOCK}")).groupBy("g", "block")
        found = low.cogroup(ends.groupBy("g", "at")).applyInArrow(_teller(to_arrow_schema(kind)), kind)
        ends = found if i == 0 else saved(found.select("g", "at", "proof", "subroot"))
    if len(rounds) == 1:
        return rounds[0].join(ends, ["g", "at"])
    return ends


def swept(digests: list[str], total: int) -> tuple[dict[tuple[int, int], list[str]], str, int]:
    """What every node above the digests received, by its label, the last node's digest, and how many nodes its level has.

    The digests are consecutive nodes of a level that has ``total``, from a multiple of 8**3 on.
    """
    if total <= 1:
        return {}, digests[0], total
    queue = [(1, i // FAN, i, digest) for i, digest in enumerate(digests)]
    received: dict[tuple[int, int], list[str]] = {}
    counts = [total]
    for _ in range(LEVELS):
        counts.append(-(-counts[-1] // FAN))
    while True:
        level, place = queue[0][:2]
        sent = []
        while queue and queue[0][:2] == (level, place):
            sent.append(heapq.heappop(queue)[3])
        received[level, place] = sent
        digest = hashlib.sha256("".join(sent).encode()).hexdigest()
        if level == LEVELS or counts[level] == 1:
            return received, digest, counts[level]
        heapq.heappush(queue, (level + 1, place // FAN, place, digest))


def sent_back(received: dict[tuple[int, int], list[str]], suffix: list, count: int) -> list[list]:
    """The proofs of the ``count`` nodes below, from that of the last node: the labels in reverse."""
    if not received:
        return [suffix] * count
    queue = [(-level, -place) for level, place in received]
    heapq.heapify(queue)
    proofs = {max(received): suffix}
    while queue:
        level, place = (-x for x in heapq.heappop(queue))
        own, sent = proofs.pop((level, place)), received[level, place]
        for i, _ in enumerate(sent):
            step = {"left": "".join(sent[:i]), "right": "".join(sent[i + 1 :])}
            proofs[level - 1, place * FAN + i] = [step, *own]
    return [proofs[0, i] for i in range(count)]


def _grown(nodes: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("at")
    _, digest, of = swept(nodes["digest"].to_pylist(), nodes["of"][0].as_py())
    block = nodes["block"][0].as_py()
    return pa.table({"g": nodes["g"].slice(0, 1), "at": [block], "of": [of], "digest": [digest]})


def _teller(shape: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def told(nodes: pa.Table, end: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return shape.empty_table()
        nodes = nodes.sort_by("at").drop(["block"])
        received, _, _ = swept(nodes["digest"].to_pylist(), nodes["of"][0].as_py())
        proofs = sent_back(received, end["proof"][0].as_py(), nodes.num_rows)
        subroot = [end["subroot"][0].as_py()] * nodes.num_rows
        columns = [*nodes.columns, pa.array(proofs, shape.field("proof").type), pa.array(subroot, pa.string())]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    return told
