"""Text quality by a generalised additive model with pairwise interactions.

The logit of a text's quality is a sum of lookup tables, one for each feature's bin and one for each chosen pair
of features. Boosting goes round the features in turn; each step fits a shallow tree of one feature to what the
model still misses, and adds the tree to that feature's table. The pairs whose best cut explains most of
the rest then get tables in the same way. Rounds stop when a part of the labelled rows, which no tree sees,
gets no better. Scoring adds the bins' values, for all rows of a batch at once.

Features are taken from the whole text. The model is fitted on the driver, from at most ``FIT_ROWS`` labelled
rows; features, labels and scores are Spark jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.llm.memory import lean, let_go
from wardcast.llm.words import sequences, utf8, window_starts, words

#: Text that is worked on at once; its arrays take some tens of times as much.
SLICE_BYTES = 1 << 20
#: At most so many labelled rows, chosen by a hash of their id, reach the driver.
FIT_ROWS = 40_000

FEATURES = (
    "log_words", "word_length", "short_words", "long_words", "upper", "digits", "symbols", "pipes", "lines",
    "not_ascii", "capital_words", "marked_words", "stopped_words", "distinct_words", "commonest_word",
    "word_pairs_again", "same_word_twice", "lines_again",
)

_BYTES = np.arange(256)
_KINDS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digits": (_BYTES >= 48) & (_BYTES <= 57),
    "symbols": np.isin(_BYTES, list(b"!#$%&*+/<=>@[\\]^_`{|}~")),
    "pipes": _BYTES == ord("|"),
    "lines": _BYTES == 10,
    "not_ascii": _BYTES >= 128,
    "stops": np.isin(_BYTES, list(b".?;:")),
}


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[bounds]).astype(np.float64)


def _between(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many marks lie between each start and its end; ``marks`` has one place more than any end."""
    if len(starts) == 0:
        return np.zeros(0)
    edges = np.stack((starts, ends), axis=1).reshape(-1)
    return np.where(ends > starts, np.add.reduceat(marks, edges, dtype=np.int64)[::2], 0).astype(np.float64)


def _runs(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of distinct keys and how often its commonest one occurs."""
    keys = keys.copy()
    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        keys[x:y].sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(keys)))
    edges = np.searchsorted(first, bounds)
    most = np.zeros(len(bounds) - 1)
    some = np.diff(edges) > 0
    if some.any():
        most[some] = np.maximum.reduceat(length, edges[:-1][some])
    return np.diff(edges).astype(np.float64), most


def features(texts) -> np.ndarray:
    """One row of ``FEATURES`` for each text; a null or empty one has zeros."""
    found = words(texts, lower=True)
    data, offsets = utf8(texts)
    size, many = np.diff(offsets).astype(np.float64), found.counts.astype(np.float64)
    data = np.append(data, np.uint8(0))
    marked = {k: v[data].view(np.uint8) for k, v in _KINDS.items()}
    whole = {k: _between(v, offsets[:-1], offsets[1:]) for k, v in marked.items()}
    share = {k: v / np.maximum(size, 1) for k, v in whole.items()}
    inside = {k: _between(marked[k], found.starts, found.ends) for k in ("upper", "lower", "symbols")}
    length = (found.ends - found.starts).astype(np.float64)
    per_word = lambda x: _sums(x, found.bounds) / np.maximum(many, 1)
    last = data[found.ends - 1]
    distinct, commonest = _runs(found.hashes, found.bounds)
    starts = window_starts(found.bounds, 2)
    pairs = np.concatenate(([0], np.cumsum(np.maximum(found.counts - 1, 0))))
    distinct_pairs, _ = _runs(sequences(found.hashes, starts, 2), pairs)
    again = np.zeros(len(found.hashes))
    again[starts] = found.hashes[starts] == found.hashes[np.minimum(starts + 1, len(found.hashes) - 1)] if len(starts) else 0
    line_share = np.zeros(len(size))
    for i in np.flatnonzero(whole["lines"] > 0).tolist():
        rows = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
        line_share[i] = 1 - len(set(rows)) / len(rows)
    columns = {
        "log_words": np.log1p(many),
        "word_length": per_word(length),
        "short_words": per_word(length <= 3),
        "long_words": per_word(length > 15),
        **{k: share[k] for k in ("upper", "digits", "symbols", "pipes", "lines", "not_ascii")},
        "capital_words": per_word((inside["upper"] > 1) & (inside["lower"] == 0)),
        "marked_words": per_word(inside["symbols"] > 0),
        "stopped_words": per_word(_KINDS["stops"][last]) if len(last) else np.zeros(len(size)),
        "distinct_words": distinct / np.maximum(many, 1),
        "commonest_word": commonest / np.maximum(many, 1),
        "word_pairs_again": 1 - distinct_pairs / np.maximum(many - 1, 1),
        "same_word_twice": per_word(again),
        "lines_again": line_share,
    }
    out = np.stack([columns[k] for k in FEATURES], axis=1)
    out[many == 0] = 0.0
    return out


class Model(NamedTuple):
    """Bin edges and a table for each feature; coarse edges and a square table for each chosen pair."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    squares: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        for (a, b), square in zip(self.pairs, self.squares, strict=True):
            total += square[tuple(np.searchsorted(self.coarse[k], x[:, k], side="right") for k in (a, b))]
        return 1 / (1 + np.exp(-total))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Where to cut bins with these sums of gradients and curvatures, and what that gains."""
    if len(g) < 2:
        return 0, 0.0
    left, curve = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left, curve) + _gain(g.sum() - left, h.sum() - curve) - _gain(g.sum(), h.sum())
    at = int(gain.argmax())
    return at + 1, float(gain[at])


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A tree on ordered bins, grown where it gains most: the value of each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        at, gain, i = max(((*_cut(g[a:b], h[a:b]), i) for i, (a, b) in enumerate(parts)), key=lambda c: c[1])
        if gain <= 1e-9:
            break
        a, b = parts[i]
        parts[i : i + 1] = [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a square table into four: its gain and the value of each cell."""
    sums = [np.cumsum(np.cumsum(x, 0), 1) for x in (g, h)]
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    (ga, gb, gc, gd), (ha, hb, hc, hd) = (
        (s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1], s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + s[:-1, :-1])
        for s in sums
    )
    gain = _gain(ga, ha) + _gain(gb, hb) + _gain(gc, hc) + _gain(gd, hd) - _gain(sums[0][-1, -1], sums[1][-1, -1])
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros(g.shape)
    for rows, columns, up, down in ((slice(0, i + 1), slice(0, j + 1), ga, ha), (slice(0, i + 1), slice(j + 1, None), gb, hb),
                                    (slice(i + 1, None), slice(0, j + 1), gc, hc), (slice(i + 1, None), slice(j + 1, None), gd, hd)):
        out[rows, columns] = up[i, j] / (down[i, j] + 1.0)
    return float(gain[i, j]), out


def fitted(x: np.ndarray, y: np.ndarray, *, bins: int = 48, coarse_bins: int = 12, leaves: int = 4, pairs: int = 8,
           rounds: int = 300, rate: float = 0.15, patience: int = 15) -> Model:
    """The model of labels y (0 or 1) by features x. Without rows, or with one label alone, a constant."""
    rate_of_ones = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    width = x.shape[1]
    edges = [_quantiles(x[:, k], bins) if len(x) else np.zeros(0) for k in range(width)]
    coarse = [_quantiles(x[:, k], coarse_bins) if len(x) else np.zeros(0) for k in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if len(x) == 0 or y.min() == y.max():
        return Model(base, edges, tables, coarse, [], [])
    seen = np.arange(len(y)) % 5 != 0
    place = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    total = np.full(len(y), base)

    def missed() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return (y - p) * seen, p * (1 - p) * seen

    def loss() -> float:
        return float(np.logaddexp(0, np.where(y > 0, -total, total))[~seen].mean())

    def boosted(steps, kept: list[np.ndarray]) -> None:
        nonlocal total
        best, since, good = loss(), 0, [t.copy() for t in kept]
        start = total.copy()
        for _ in range(rounds):
            for k, step in enumerate(steps):
                change, where = step(*missed())
                kept[k] += rate * change
                total = total + rate * change[where]
            now = loss()
            if now < best - 1e-6:
                best, since, good = now, 0, [t.copy() for t in kept]
            elif (since := since + 1) >= patience:
                break
        kept[:] = good
        total = start
        for table, step in zip(kept, steps, strict=True):
            total = total + table[step.where]

    class Single:
        def __init__(self, k: int):
            self.where, self.size = place[k], len(tables[k])

        def __call__(self, g, h):
            sums = (np.bincount(self.where, v, self.size) for v in (g, h))
            return _tree(*sums, leaves), self.where

    boosted([Single(k) for k in range(width)], tables)

    cell = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]

    class Pair:
        def __init__(self, a: int, b: int):
            self.shape, self.where = (len(coarse[a]) + 1, len(coarse[b]) + 1), (cell[a], cell[b])
            self.flat = cell[a] * self.shape[1] + cell[b]

        def sums(self, g, h):
            return (np.bincount(self.flat, v, self.shape[0] * self.shape[1]).reshape(self.shape) for v in (g, h))

        def __call__(self, g, h):
            return _quarters(*self.sums(g, h))[1], self.where

    g, h = missed()
    ranked = sorted(((_quarters(*Pair(a, b).sums(g, h))[0], a, b) for a, b in combinations(range(width), 2)), reverse=True)
    chosen = [(a, b) for gain, a, b in ranked[:pairs] if gain > 0]
    steps = [Pair(a, b) for a, b in chosen]
    squares = [np.zeros(s.shape) for s in steps]
    if steps:
        boosted(steps, squares)
    return Model(base, edges, tables, coarse, chosen, squares)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where runs of rows begin and how many rows each has: at most 1,024, and of about ``SLICE_BYTES`` or one row."""
    ends = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    low, n = 0, len(texts)
    while low < n:
        full = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE_BYTES, side="right"))
        high = min(max(full, low + 1), low + 1024)
        yield low, high - low
        low = high


def with_features(docs: DataFrame, *, id: str, text: str) -> DataFrame:
    """(id, features) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, many in _slices(batch.column(1)):
                some = batch.slice(low, many)
                x = features(some.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([some.column(0), lists], names=[id, "features"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(lean(each), f"`{id}` {kind}, features array<double>")


def to_learn_from(docs: DataFrame, labels: DataFrame, *, id: str, label: str, most: int = FIT_ROWS) -> DataFrame:
    """The rows that ``learned`` would take of all, so that features of no others need computing.

    Ids are chosen before texts are read; rows that repeat a chosen id are all there, and ``learned`` takes as many as it may.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(id).alias("_id")).distinct()
    there = docs.select(F.col(id).alias("_id")).distinct().join(known, "_id")
    chosen = there.orderBy(F.xxhash64("_id"), "_id").limit(most)
    return docs.join(F.broadcast(chosen), F.col(id) == F.col("_id"), "left_semi")


def learned(rows: DataFrame, labels: DataFrame, *, id: str, label: str, most: int = FIT_ROWS) -> Model:
    """The model of the labelled rows: features by ``with_features``, and labels (id, label) of 0 or 1.

    Labels that are null or neither, and those of unknown ids, are left out. With more than ``most`` rows, those with
    the smallest hashes of their id are taken, in every run the same.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(id).alias("_id"), F.col(label).alias("_label"))
    joined = rows.join(known, F.col(id) == F.col("_id")).select("_id", "features", "_label")
    chosen = joined.orderBy(F.xxhash64("_id"), "_id", "_label").limit(most).collect()
    x = np.array([r.features for r in chosen], np.float64).reshape(-1, len(FEATURES))
    return fitted(x, np.array([r._label for r in chosen], np.float64))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """The rows with ``score``, from 0 to 1: higher where the label 1 is likelier.

    A null or empty text has a score too, that of a text without words.
    """

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.score(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))))

    return rows.withColumn("score", score("features"))


def text_score(model: Model, text: str) -> Column:
    """The score of a text column, computed from the text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [model.score(features(texts.slice(low, many))) for low, many in _slices(texts)]
        let_go()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(F.col(text))
