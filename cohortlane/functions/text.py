"""Text predicates for concept names."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_matches(column: str, all_of: Iterable[str], none_of: Iterable[str] = ()) -> Column:
    """Lower-cased text contains every pattern of ``all_of``, none of ``none_of``.

    A pattern is a regular expression, so ``"a|b"`` means either of the two.
    """
    text = F.lower(F.col(column))
    wanted = [text.rlike(pattern) for pattern in all_of]
    unwanted = [~text.rlike(pattern) for pattern in none_of]
    return reduce(and_, [*wanted, *unwanted], F.lit(True))
