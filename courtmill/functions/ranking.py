"""Seeds and reproducible choices among equals."""

from __future__ import annotations

import hashlib
import json
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: The fields of a request that its seed is made of.
SEED_FIELDS = ("aesthetic", "brand", "budget", "cut", "outdoor", "playstyle", "playstyle_tag", "position", "width")


def seed_of(request: dict) -> int:
    """An unsigned 64-bit seed of a request's fields: compact JSON in ASCII with sorted keys, hashed; nulls count."""
    text = json.dumps(request, sort_keys=True, separators=(",", ":"))
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def request_seed(**fields: Column) -> Column:
    """The seed of a row's fields, as text. Requests are few, so the JSON is written as Python does."""
    names = sorted(fields)

    @F.pandas_udf("string")
    def seeds(rows: pd.DataFrame) -> pd.Series:
        plain = rows.astype(object).where(rows.notna(), None).to_dict("records")
        return pd.Series([str(seed_of(r)) for r in plain])

    return seeds(F.struct(*[fields[n].alias(n) for n in names]))


def primary_key(similarity: Column, overlap: Column) -> Column:
    """What candidates are ranked by: similarity to four places, else overlap, else 0."""
    return F.coalesce(F.bround(similarity, 4), overlap.cast("double"), F.lit(0.0))


def pick(ranked: list[tuple[float, int]], n: int, seed: int) -> list[int]:
    """Ids of ``n`` of (key, id): greatest keys first; where a group of equals is too large, a seeded sample of it.

    Equals stand in descending order of id; random numbers are drawn for that one group only.
    """
    chosen: list[int] = []
    order = sorted(ranked, reverse=True)
    i = 0
    while i < len(order) and len(chosen) < n:
        equals = [x for k, x in order if k == order[i][0]]
        room = n - len(chosen)
        chosen += equals if len(equals) <= room else random.Random(seed).sample(equals, room)
        i += len(equals)
    return chosen
