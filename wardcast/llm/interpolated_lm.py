"""Language-model scores by deleted interpolation.

The probability of a word mixes maximum-likelihood estimates of all orders,

    P_k(w | context) = l_k(b) * c(context w) / c(context) + (1 - l_k(b)) * P_{k-1},   P_0 = 1 / (V + 1),

where b is the bucket of c(context) by powers of two. Expectation-maximisation learns the weights on held-out
counts: a part of the training texts whose n-grams are taken out of the estimates while it is predicted.

Every n-gram of the corpus is counted: chunks of texts ask the owners of their distinct n-grams
(``exchange``) for corpus counts, so a word in a third of all texts is one entry per chunk. Words and bigrams are
asked about first, then the higher orders one by one. An owner also says which n-grams no other chunk has: what
contains one of those is in this chunk only, so the chunk's own counts are the corpus counts and it does not ask. To ask
about the next order a chunk needs these marks alone, one bit for each n-gram; the counts are sent once, at the end.
The counts at each word are stored once. Maximisation needs only how many held-out words have which estimates, in a grid
of bounded size; that grid is all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.llm import exchange as X
from wardcast.llm.storage import saved
from wardcast.llm.words import mix, words

_END, _START, _STEP = np.uint64(0x5851F42D4C957F2D), 0x14057B7EF767814F, np.uint64(0x2545F4914F6CDD1D)
#: Cells of the grid on a side: powers of two of a context's count, and of an estimate. Counts below 2^63 need no more,
#: and words of one cell are taken to have its mean logarithm of each estimate.
GRID = 64
_DOCS_A_ROW = 4096
#: What an owner says beside the counts: nothing, which chunk asked first about a key, or if only one asked.
_NOTHING, _FIRST, _ONLY = range(3)


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and the bounds of the texts."""
    found = words(texts, lower=True)
    bounds = found.bounds + np.arange(len(found.bounds))
    out = np.full(bounds[-1], _END, np.uint64)
    place = np.ones(len(out), bool)
    place[bounds[1:] - 1] = False
    out[place] = found.hashes
    return out, bounds


def _grams(tokens: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """The hash of the n-gram that ends at each token, for n = 1 to ``order``; a text begins with starts."""
    out = [mix(tokens)]
    first = bounds[:-1][np.diff(bounds) > 0]
    for k in range(1, order):
        before = np.empty_like(tokens)
        before[1:] = out[-1][:-1]
        before[first] = np.uint64((_START * k) % (1 << 64))
        out.append(mix(before * _STEP + tokens))
    return out


def _squeeze(counts: np.ndarray) -> bytes:
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def _unsqueeze(data: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    out = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = np.frombuffer(data, np.int64, len(large), at + n)
    return out, at + n + 8 * len(large)


def _key_bytes(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte: the low bytes are noise, the high ones nearly all alike."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    planes = [zstandard.compress(np.ascontiguousarray(steps[:, k]).tobytes(), 1) for k in range(8)]
    return np.array([len(x) for x in planes], np.uint32).tobytes() + b"".join(planes)


def _keys_of(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    steps = np.empty((n, 8), np.uint8)
    sizes = np.frombuffer(data, np.uint32, 8, at).tolist()
    at += 32
    for k, size in enumerate(sizes):
        steps[:, k] = np.frombuffer(zstandard.decompress(data[at : at + size]), np.uint8)
        at += size
    return np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64), at


def _request(chunk: int, kind: int, keys: np.ndarray, counts: list[np.ndarray], n: int, order: int) -> Iterator[pa.RecordBatch]:
    """Keys (48 bits or more within a bucket, all 64 for words) with how often the chunk's training texts have them."""
    edges = np.searchsorted(X.bucket_of(keys, n), np.arange(n + 1))
    sent = keys >> np.uint64(0 if kind == 1 else max(16 - (n - 1).bit_length(), 0))
    wants = _FIRST if kind == 1 else _ONLY if kind < order else _NOTHING
    rows = []
    for b, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if x < y:
            packed = zstandard.compress(b"".join(_squeeze(c[x:y]) for c in counts), 1)
            rows.append((b, np.int64(y - x).tobytes() + bytes([wants]) + _key_bytes(sent[x:y]) + packed))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([chunk] * len(rows), pa.int32()),
            pa.array([b for b, _ in rows], pa.int32()),
            pa.array([kind] * len(rows), pa.int32()),
            pa.array([x for _, x in rows], pa.binary()),
        ],
        names=["chunk", "bucket", "kind", "keys"],
    )


def _totals(blobs: list[bytes]) -> list[bytes]:
    """For each request: corpus counts of its keys, and which of them it is the first or the only one to ask about."""
    asked, counts = [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        keys, at = _keys_of(blob, 9, n)
        data = zstandard.decompress(blob[at:])
        train, at = _unsqueeze(data, n, 0)
        asked.append(keys)
        counts.append((train, _unsqueeze(data, n, at)[0]))
    known, times = X.distinct(np.concatenate(asked))
    total, fold = (np.zeros(len(known), np.int64) for _ in range(2))
    seen = np.zeros(len(known), bool)
    places = []
    for keys, (train, part) in zip(asked, counts, strict=True):
        at = np.searchsorted(known, keys)
        total[at] += train
        fold[at] += part
        places.append(at)
    out = []
    for at, blob in zip(places, blobs, strict=True):
        said = _squeeze(total[at]) + _squeeze(fold[at])
        if blob[8] == _FIRST:
            said += np.packbits(~seen[at]).tobytes()
            seen[at] = True
        elif blob[8] == _ONLY:
            said += np.packbits(times[at] == 1).tobytes()
        out.append(zstandard.compress(said, 1))
    return out


def _only_ones(blobs: list[bytes]) -> list[bytes | None]:
    """For each request that wants it: which of its keys no other chunk asked about."""
    if blobs[0][8] != _ONLY:
        return [None] * len(blobs)
    asked = [_keys_of(blob, 9, int(np.frombuffer(blob, np.int64, 1)[0]))[0] for blob in blobs]
    known, times = X.distinct(np.concatenate(asked))
    return [np.packbits(~X.among(keys, known[times > 1])).tobytes() for keys in asked]


class _Grams:
    """The n-grams of one order in a chunk: distinct keys, the place of each token's, and what is known of them."""

    def __init__(self, grams: np.ndarray, marks: list[np.ndarray], inside: np.ndarray):
        """``inside``: tokens whose n-gram holds one that no other chunk has."""
        self.keys, self.at = X.placed(grams)
        self.own = [np.bincount(self.at[mark], minlength=len(self.keys)) for mark in marks]
        self.first, self.alone = (np.zeros(len(self.keys), bool) for _ in range(2))
        self.alone[self.at[inside]] = True
        self.asked = np.flatnonzero(~self.alone)

    def request(self, chunk: int, kind: int, n: int, order: int) -> Iterator[pa.RecordBatch]:
        yield from _request(chunk, kind, self.keys[self.asked], [c[self.asked] for c in self.own], n, order)

    def learn(self, blobs: list[bytes], n: int) -> np.ndarray:
        """Put the owners' counts in place of the chunk's own; what they say of each key beside, false where nothing."""
        said = np.zeros(len(self.keys), bool)
        low = 0
        _, sizes = np.unique(X.bucket_of(self.keys[self.asked], n), return_counts=True)
        for blob, size in zip(blobs, sizes.tolist(), strict=True):
            data, mine = zstandard.decompress(blob), self.asked[low : low + size]
            self.own[0][mine], at = _unsqueeze(data, size, 0)
            self.own[1][mine], at = _unsqueeze(data, size, at)
            if at < len(data):
                said[mine] = np.unpackbits(np.frombuffer(data, np.uint8, offset=at), count=size)
            low += size
        return said

    def set_apart(self, blobs: list[bytes], n: int) -> None:
        """Mark the n-grams of which the owners say that no other chunk has them."""
        self.alone[self.asked] = X.bits(blobs, self.keys[self.asked], n)

    def alone_within(self, bounds: np.ndarray) -> np.ndarray:
        """Tokens whose n-gram of the next order holds one of this order that no other chunk has."""
        alone = self.alone[self.at]
        before = np.zeros(len(alone), bool)
        before[1:] = alone[:-1]
        before[bounds[:-1]] = False
        return alone | before


def _log2_bucket(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.int64)


def _contexts(counts: list[np.ndarray], bounds: np.ndarray) -> list[np.ndarray]:
    """The count of the context at each token for the orders from 2: the shorter n-gram one token back;
    before the first token, the number of texts, which is the count of the end."""
    out = []
    first = bounds[:-1]
    for c in counts[:-1]:
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[first] = counts[0][bounds[1:] - 1]
        out.append(before)
    return out


def _held_out_grid(counts: list[np.ndarray], bounds: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells (bucket and step of every order) of the given tokens, with weight and sums of logarithms."""
    contexts = _contexts(counts, bounds)
    cell = np.zeros(int(tokens.sum()), np.int64)
    logs = []
    for c, context in zip(counts[1:], contexts, strict=True):
        c, context = c[tokens], context[tokens]
        seen = (c > 0) & (context > 0)
        log = np.where(seen, np.log2(np.where(seen, c, 1) / np.where(seen, context, 1)), 0.0)
        step = np.where(seen, np.minimum(1 + np.floor(-log), GRID - 1), 0).astype(np.int64)
        cell = (cell * GRID + np.minimum(_log2_bucket(context), GRID - 1)) * GRID + step
        logs.append(log)
    c = counts[0][tokens]
    log = np.log2(np.maximum(c, 1))
    cell = cell * GRID + np.where(c > 0, np.minimum(1 + np.floor(log), GRID - 1), 0).astype(np.int64)
    cells, place = np.unique(cell, return_inverse=True)
    sums = [np.bincount(place, minlength=len(cells)), *(np.bincount(place, x, len(cells)) for x in [*logs, log])]
    return cells, np.array(sums, np.float64)


def learned_weights(cells: np.ndarray, sums: np.ndarray, order: int, tokens: int, types: int, rounds: int = 200) -> list[np.ndarray]:
    """Weights of the orders 1 to ``order`` by bucket of the context's count, by expectation-maximisation.

    A bucket without held-out words takes the weights of the next lower one; a context that was never
    seen has no estimate, so its weight is 0.
    """
    weight, means = sums[0], sums[1:] / np.maximum(sums[0], 1)
    estimates, buckets, rest = [], [], cells.copy()
    steps = [rest % GRID]
    rest //= GRID
    for _ in range(order - 1):
        steps.append(rest % GRID)
        buckets.append((rest // GRID) % GRID)
        rest //= GRID * GRID
    # The cell number was built from the second order on, so the highest order stands nearest the end.
    steps[1:], buckets = steps[:0:-1], buckets[::-1]
    estimates.append(np.where(steps[0] > 0, np.exp2(means[-1]) / max(tokens, 1), 0.0))
    for k in range(order - 1):
        estimates.append(np.where(steps[k + 1] > 0, np.exp2(means[k]), 0.0))
    buckets = [np.zeros(len(cells), np.int64), *buckets]
    table = [np.full(GRID, 0.5) for _ in range(order)]
    for k in range(1, order):
        table[k][0] = 0.0
    if tokens == 0:
        table[0][:] = 0.0
    for _ in range(rounds if len(cells) else 0):
        own = [t[b] for t, b in zip(table, buckets, strict=True)]
        p = np.full(len(cells), 1.0 / (types + 1))
        parts = [p]
        for share, estimate in zip(own, estimates, strict=True):
            parts = [x * (1 - share) for x in parts] + [share * estimate]
        p = np.maximum(sum(parts), 1e-300)
        reach, new = parts[0] / p, []
        for k in range(order):
            used = parts[k + 1] / p
            reach = reach + used
            up, down = (np.bincount(buckets[k], weight * x, GRID) for x in (used, reach))
            new.append(np.where(down > 1e-9, up / np.maximum(down, 1e-9), np.nan))
        moved = 0.0
        for k in range(order):
            for b in range(GRID):
                if np.isnan(new[k][b]):
                    new[k][b] = new[k][b - 1] if b > (k > 0) else table[k][b]
            if k:
                new[k][0] = 0.0
            moved = max(moved, float(np.abs(new[k] - table[k]).max()))
            table[k] = new[k]
        if moved < 1e-7:
            break
    return table


def scores(docs: DataFrame, *, id: str, text: str, train: Column, tune: Column, order: int = 2) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every text.

    ``train`` marks the rows to count n-grams from, ``tune`` those of them that are held out to learn the
    weights; all of ``train`` is counted for the scores. Tokens are lower-cased (A-Z) words and one end.
    ``base_score`` is the add-one unigram model. Scores are log10 probabilities of whole texts.

    A null or empty text is its end alone. A row whose mark is null is scored, not learned from. Each row
    counts for itself, copies too. Without training tokens every score is 0. Other columns are ignored.
    """
    n = X.partitions(docs.sparkSession)
    marks = {"train": F.coalesce(train, F.lit(False)), "tune": F.coalesce(train & tune, F.lit(False))}
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), *[c.alias(k) for k, c in marks.items()])
    dealt = X.chunks(rows, n)

    def levels(
        table: pa.Table, bounds: np.ndarray, tokens: np.ndarray, got: pa.Table | None, upto: int, counted: bool = True
    ) -> Iterator[_Grams]:
        """The chunk's n-grams of each order up to that one, with the answers there are: counts, or only which are alone.

        Without counts, words are left out, as nothing is said of them then, and only the last order has the chunk's own.
        """
        marks = [np.repeat(table[c].to_numpy(), np.diff(bounds)) for c in ("train", "tune")]
        inside = np.zeros(len(tokens), bool)
        for k, grams in enumerate(_grams(tokens, bounds, upto), 1):
            if k == 1 and not counted:
                continue
            level = _Grams(grams, marks if counted or k == upto else [], inside)
            answers = X.answered(got, k) if got is not None else []
            if answers and not counted:
                level.set_apart(answers, n)
            elif answers:
                said = level.learn(answers, n)
                level.first = said if k == 1 else level.first
                level.alone |= said if k > 1 else False
            # Words and bigrams are asked about together, so words spare no question.
            inside = level.alone_within(bounds) if k > 1 else inside
            yield level

    def ask(chunk: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        tokens, bounds = _tokens(table["text"])
        for k, level in enumerate(levels(table, bounds, tokens, None, min(order, 2)), 1):
            yield from level.request(chunk, k, n, order)

    def ask_longer(k: int) -> Callable[[int, pa.Table, pa.Table], Iterator[pa.RecordBatch]]:
        def each(chunk: int, table: pa.Table, got: pa.Table) -> Iterator[pa.RecordBatch]:
            tokens, bounds = _tokens(table["text"])
            for level in levels(table, bounds, tokens, got, k, counted=False):
                pass
            yield from level.request(chunk, k, n, order)

        return each

    def look(_: int, table: pa.Table, got: pa.Table) -> Iterator[pa.RecordBatch]:
        tokens, bounds = _tokens(table["text"])
        sizes = np.diff(bounds)
        train, tune = (table[c].to_numpy() for c in ("train", "tune"))
        total, fold, types = [], [], 0
        for level in levels(table, bounds, tokens, got, order):
            types += int((level.first & (level.own[0] > 0)).sum())
            total.append(level.own[0][level.at])
            fold.append(level.own[1][level.at])
        del level, tokens
        held = np.repeat(tune, sizes)
        cells, sums = _held_out_grid([t - f for t, f in zip(total, fold, strict=True)], bounds, held)
        cells = np.concatenate((cells, [-1, -2, -3]))
        ends = [float(sizes[train].sum()), float(sizes[tune].sum()), float(types)]
        sums = np.concatenate((sums, np.vstack((ends, np.zeros((order, 3))))), axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells), pa.array(list(sums.T), pa.list_(pa.float64())), *[pa.nulls(len(cells), pa.binary())] * 2],
            names=["cell", "sums", "packed", "counts"],
        )
        n_known = np.add.reduceat((total[0] > 0).astype(np.int64), bounds[:-1])
        base = np.add.reduceat(np.log10(total[0] + 1.0), bounds[:-1])
        for low in range(0, table.num_rows, _DOCS_A_ROW):
            high = min(low + _DOCS_A_ROW, table.num_rows)
            x, y = bounds[low], bounds[high]
            part = pa.table(
                {"id": table["id"].slice(low, high - low), "size": sizes[low:high], "n_known": n_known[low:high], "base": base[low:high]}
            )
            # A column for each byte: alike bytes side by side are smaller.
            each = [c[x:y].view(np.uint8).reshape(-1, 8) for c in total]
            counts = pa.table({f"c{k}_{b}": np.ascontiguousarray(c[:, b]) for k, c in enumerate(each) for b in range(8)})
            blobs = [pa.array([X.packed(t)], pa.binary()) for t in (part, counts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([0]), pa.nulls(1, pa.list_(pa.float64())), *blobs], names=["cell", "sums", "packed", "counts"]
            )

    asks = X.per_chunk(dealt, ask, X.ASKED)
    counted, alone = X.by_bucket(asks, n, _totals), X.by_bucket(asks, n, _only_ones)
    for k in range(3, order + 1):
        asks = X.with_answers(dealt, alone, n, ask_longer(k), X.ASKED)
        counted = counted.unionByName(X.by_bucket(asks, n, _totals))
        alone = alone.unionByName(X.by_bucket(asks, n, _only_ones))
    looked = saved(X.with_answers(dealt, counted, n, look, "cell long, sums array<double>, packed binary, counts binary"))
    parts = [F.sum(F.col("sums")[i]) for i in range(order + 1)]
    grid = looked.where("packed is null").groupBy("cell").agg(*[p.alias(f"s{i}") for i, p in enumerate(parts)]).toArrow()
    cells, sums = grid["cell"].to_numpy(), np.array([grid[f"s{i}"].to_numpy() for i in range(order + 1)])
    tokens, tuned, types = (int(sums[0][cells == k].sum()) for k in (-1, -2, -3))
    cells, sums = cells[cells >= 0], sums[:, cells >= 0]
    weights = learned_weights(cells, sums, order, tokens - tuned, types)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, more in zip(batch.column("packed"), batch.column("counts"), strict=True):
                part, by_byte = (pa.ipc.open_stream(x.as_buffer()).read_all().combine_chunks() for x in (blob, more))
                bounds = np.concatenate(([0], np.cumsum(part["size"].to_numpy())))
                counts = [
                    np.stack([by_byte[f"c{k}_{b}"].to_numpy() for b in range(8)], axis=1).reshape(-1).view(np.int64) for k in range(order)
                ]
                p = np.full(bounds[-1], 1.0 / (types + 1))
                p = p * (1 - weights[0][0]) + weights[0][0] * counts[0] / max(tokens, 1)
                for k, context in enumerate(_contexts(counts, bounds), 1):
                    share = weights[k][np.minimum(_log2_bucket(context), GRID - 1)]
                    p = p * (1 - share) + share * counts[k] / np.maximum(context, 1)
                sizes = np.diff(bounds)
                columns = {
                    id: part["id"].combine_chunks(),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "n_known": part["n_known"].combine_chunks(),
                    "train_tokens": pa.array(np.full(len(sizes), tokens), pa.int64()),
                    "base_score": pa.array(part["base"].to_numpy() - sizes * np.log10(tokens + types + 1.0)),
                    "score": pa.array(np.add.reduceat(np.log10(np.maximum(p, 1e-300)), bounds[:-1])),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = docs.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return looked.where("packed is not null").select("packed", "counts").mapInArrow(score, schema)
