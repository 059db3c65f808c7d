"""Set operations on frames matched by column name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """Distinct rows of all frames; columns a frame lacks are NULL there."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), frames
    ).distinct()
