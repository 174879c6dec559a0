from __future__ import annotations

from collections import Counter

import pytest

from wardcast.llm import numbering, storage


def test_places_in_groups(spark, monkeypatch):
    monkeypatch.setattr(numbering, "RANGE_ROWS", 100)
    rows = [("hot", (i * 7) % 501 if i % 5 else None, f"t{i}") for i in range(900)] + [("cold", 1, "x")] * 40 + [("one", None, None)]
    got = numbering.numbered(spark.createDataFrame(rows, "g string, k int, t string"), "g", ["k", "t"]).collect()
    sizes = Counter(r[0] for r in rows)
    assert {r.g: r.of for r in got} == sizes
    for g in sizes:
        placed = sorted((r for r in got if r.g == g), key=lambda r: r["at"])
        assert [r["at"] for r in placed] == list(range(sizes[g]))
        order = [(r.k is not None, r.k or 0, r.t is not None, r.t or "") for r in placed]
        assert order == sorted(order)


def test_no_rows(spark):
    assert numbering.numbered(spark.createDataFrame([], "g string, k int"), "g", ["k"]).collect() == []


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext, conf = Context(), {}  # noqa: N815

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        storage.folder(Session())
