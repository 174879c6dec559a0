from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def right_closed_band(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``edges[i] < value <= edges[i + 1]``; NULL outside all of them.

    ``width_bucket`` closes on the left, so the bands are a CASE chain.
    """
    band = F.when(value <= F.lit(edges[0]), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        band = band.when(value <= F.lit(upper), F.lit(label))
    return band
