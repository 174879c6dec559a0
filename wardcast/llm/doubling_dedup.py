"""Removal of passages that occur more than once, by level-wise doubling.

A window is ``length`` consecutive words of one text. Windows are compared by hash at a short length
first. A window of twice that length can only repeat if both of its halves do, so only places where two
repeated windows meet are asked about at the next level, up to the wanted length. Halves overlap by a
word where a length is odd. All levels but the last are filters, sent as 32 bits per window; the last
compares 96 bits.

Every level asks the whole corpus about its distinct surviving windows (``exchange``): a passage that
very many texts share is one entry per chunk of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.llm import exchange as X
from wardcast.llm.words import Words, mix, sequences, utf8, window_starts, words

_SECOND = np.uint64(0xA0761D6478BD642F)


def lengths(length: int, shortest: int) -> list[int]:
    """The window lengths of the levels: each at most twice the one before, none under ``shortest``."""
    out = [length]
    while -(-out[0] // 2) >= shortest:
        out.insert(0, -(-out[0] // 2))
    return out


class _Level:
    """The windows of one chunk that are still candidates, replayed from the answers to earlier levels."""

    def __init__(self, found: Words, steps: list[int], n: int, answers: list[list[bytes]]):
        self.found, self.steps, self.n = found, steps, n
        self.at = window_starts(found.bounds, steps[0])
        self._keys()
        for step, blobs in zip(range(len(answers)), answers, strict=True):
            again = self.distinct[X.bits(blobs, self.distinct, n) | (self.counts > 1)]
            self.at = self.at[X.among(self.keys, again)]
            if step + 1 < len(steps):
                self._longer(steps[step], steps[step + 1])

    def _keys(self, length: int | None = None) -> None:
        self.keys = sequences(self.found.hashes, self.at, length or self.steps[0])
        self.distinct, self.counts = X.distinct(self.keys)

    def _longer(self, length: int, longer: int) -> None:
        alive = np.zeros(len(self.found.hashes) + 1, bool)
        alive[self.at] = True
        starts = window_starts(self.found.bounds, longer)
        self.at = starts[alive[starts] & alive[starts + longer - length]]
        self._keys(longer)

    def ask(self, chunk: int, level: int) -> Iterator[pa.RecordBatch]:
        if level + 1 < len(self.steps):
            yield from X.asked(chunk, level, self.distinct, self.n, self.distinct.astype(np.uint32))
        else:
            _, first = np.unique(self.keys, return_index=True)
            other = sequences(mix(self.found.hashes ^ _SECOND), self.at[first], self.steps[level])
            yield from X.asked(chunk, level, self.distinct, self.n, self.distinct, other.astype(np.uint32))


def _confirmed(blobs: list[bytes]) -> list[bytes]:
    """One bit per window: set if another chunk sent the same 96 bits."""
    sizes = [len(x) // 12 for x in blobs]
    keys = [np.frombuffer(x, np.uint64, c) for x, c in zip(blobs, sizes, strict=True)]
    ordered, counts = X.distinct(np.concatenate(keys))
    twice = ordered[counts > 1]
    alike = [X.among(x, twice) for x in keys]
    full = np.concatenate([x[m] for x, m in zip(keys, alike, strict=True)])
    rest = [np.frombuffer(x, np.uint32, offset=8 * c)[m] for x, c, m in zip(blobs, sizes, alike, strict=True)]
    other = np.concatenate(rest)
    order = np.lexsort((other, full))
    same = (full[order][1:] == full[order][:-1]) & (other[order][1:] == other[order][:-1])
    again = np.zeros(len(full), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    out, used = [], 0
    for mask in alike:
        n = int(mask.sum())
        mask[mask] = again[used : used + n]
        out.append(np.packbits(mask).tobytes())
        used += n
    return out


def without_repeats(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", length: int = 35, lower: bool = False, shortest: int = 8
) -> DataFrame:
    """Every text without the words that a repeated window covers: (id, n_words, n_removed, kept).

    A window counts as repeated if the same ``length`` words start anywhere else, in the same text too;
    overlapping occurrences count. Windows are judged on the input. ``kept`` joins the other words by one
    space. Null and empty texts, and texts shorter than a window, lose nothing; a null text has no
    words and keeps the empty text. Each row counts for itself, so rows with the same id, or wholly
    equal rows, are repeats of each other. Other columns are ignored.
    """
    n, steps = X.partitions(docs.sparkSession), lengths(length, shortest)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    dealt = X.chunks(rows, n)

    def state(table: pa.Table, got: pa.Table | None, levels: int) -> _Level:
        answers = [X.answered(got, k) for k in range(levels)]
        return _Level(words(table["text"], lower=lower), steps, n, answers)

    asks = X.per_chunk(dealt, lambda c, t: state(t, None, 0).ask(c, 0), X.ASKED)
    answers = None
    for level in range(len(steps)):
        answer = X.repeated(4) if level + 1 < len(steps) else _confirmed
        new = X.by_bucket(asks, n, answer).repartitionById(n, F.col("chunk"))  # read again by each later level
        answers = new if answers is None else answers.unionByName(new)
        if level + 1 < len(steps):
            step = lambda c, t, got, k=level + 1: state(t, got, k).ask(c, k)
            asks = X.with_answers(dealt, answers, n, step, X.ASKED)

    def keep(_: int, table: pa.Table, got: pa.Table) -> Iterator[pa.RecordBatch]:
        last = state(table, got, len(steps))
        change = np.zeros(len(last.found.hashes) + 1, np.int64)
        np.add.at(change, last.at, 1)
        np.add.at(change, last.at + length, -1)
        gone = np.cumsum(change)[:-1] > 0
        bounds = last.found.bounds
        removed = np.concatenate(([0], np.cumsum(gone)))[bounds]
        data, offsets = utf8(table["text"])
        kept = []
        for i in range(table.num_rows):
            own = data[offsets[i] : offsets[i + 1]].tobytes().split()
            if removed[i + 1] > removed[i]:
                own = [w for w, g in zip(own, gone[bounds[i] : bounds[i + 1]].tolist(), strict=True) if not g]
            kept.append(b" ".join(own))
        columns = [
            table["id"].combine_chunks(),
            pa.array(np.diff(bounds), pa.int64()),
            pa.array(np.diff(removed), pa.int64()),
            pa.array(kept, pa.binary()).cast(pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[id, "n_words", "n_removed", "kept"])

    kind = docs.schema[id].dataType.simpleString()
    return X.with_answers(dealt, answers, n, keep, f"`{id}` {kind}, n_words long, n_removed long, kept string")
