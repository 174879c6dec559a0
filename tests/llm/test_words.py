from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.rows import WORDS, lower
from wardcast.llm import exchange, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b\x00中", max_size=30)), max_size=8), st.booleans())
def test_words_equal_the_pattern(texts, fold):
    found = words.words(pa.array(texts, pa.string()), lower=fold)
    plain = [WORDS.findall(lower(t) if fold else t or "") for t in texts]
    assert found.counts.tolist() == [len(p) for p in plain]
    assert words.counted(pa.array(texts, pa.string())).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(set(zip(flat, found.hashes.tolist(), strict=True))) == len(set(flat)) == len(set(found.hashes.tolist()))
    data = found.data.tobytes()
    cut = [data[s:e].decode() for s, e in zip(found.starts, found.ends, strict=True)]
    assert [lower(w) if fold else w for w in cut] == flat


def test_pieces_do_not_change_words(monkeypatch):
    texts = pa.array(["ab " * 50, "x" * 100 + " y", None, "cd\nef", "ab"])
    whole = words.words(texts, lower=True)
    monkeypatch.setattr(words, "PIECE", 7)
    parts = words.words(texts, lower=True)
    assert (whole.hashes == parts.hashes).all() and (whole.bounds == parts.bounds).all()
    assert words.counted(texts).tolist() == whole.counts.tolist()


def test_sequences_depend_on_words_and_order_only():
    found = words.words(pa.array(["a b c a b c", "c b a"]), lower=True)
    starts = words.window_starts(found.bounds, 3)
    assert starts.tolist() == [0, 1, 2, 3, 6]
    keys = words.sequences(found.hashes, starts, 3).tolist()
    assert keys[0] == keys[3] and len(set(keys)) == 4


def test_keys_in_order_are_in_bucket_order():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    buckets = exchange.bucket_of(keys, 37)
    assert (np.diff(buckets) >= 0).all() and buckets.min() == 0 and buckets.max() == 36
    assert (exchange.widened(exchange.narrow(keys, 5).tobytes(), 5) == keys % np.uint64(1 << 40)).all()


def test_sliced_arrays():
    texts = pa.array(["skipped", "a b", None, "c"])[1:]
    assert words.words(texts, lower=False).counts.tolist() == [2, 0, 1]
