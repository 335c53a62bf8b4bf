"""Dense vectors as Column expressions; numbers are summed as doubles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(vector: Column, query: Sequence[float]) -> Column:
    """1 - cosine similarity to a constant vector; null if the lengths differ, NaN for a zero vector.

    The query is scaled to length 1 once, so each row takes one pass for the dot product and one for its norm.
    """
    length = math.sqrt(sum(float(x) ** 2 for x in query))
    unit = F.array(*[F.lit(float(x) / length) for x in query]) if length else F.lit(None).cast("array<double>")
    return F.when(F.size(vector) == len(query), F.lit(1.0) - F.try_divide(dot(vector, unit), norm(vector)))


def similarity(distance: Column) -> Column:
    """max(0, 1 - distance), 0 where the distance is no number."""
    return F.when(distance.isNull() | F.isnan(distance), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - distance))
