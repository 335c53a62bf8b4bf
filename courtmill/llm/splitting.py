"""Splitting oversized items at natural boundaries by dynamic programming.

A cut may fall at the end of a paragraph, a line, a sentence or a word; between letters only where a
stretch has nothing better. The dynamic programme takes the cuts that minimise the sum of the cut
penalties and of the squared deviation from equal sizes, subject to the greatest length, with each
piece starting about ``overlap`` characters before the end of the one before it (moved to a word's
start within ``SLACK`` characters where there is one). Weaker cut points are offered only in stretches
without stronger ones, so the work is linear in the text's length. A letter and its marks stay together
unless they alone are longer than a piece's room.

Only items over the limit leave the JVM. An item is stripped of spaces, tabs and line breaks at both
ends first. Defined results: null and blank items have no piece, an item within the limit is one
piece, repeated rows are split each for itself, an empty table gives an empty result, extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from unicodedata import combining

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtmill.session import named

LIMIT = 1_500
OVERLAP = 150
SLACK = 30
BLANKS = " \t\r\n"
#: Cost of a cut by its kind; the size term is at most about 1 for each piece.
PARAGRAPH, LINE, SENTENCE, WORD, LETTER = 0.0, 0.15, 0.3, 1.5, 6.0
_PARAGRAPH = re.compile(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+|\r[ \t]*\r[ \t\r]*")
_LINE = re.compile(r"\r?\n|\r")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』”]*")
_SPACE = re.compile(r"\s+")


def _cut_points(text: str, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions a piece may end at, ascending, and their penalties; no gap is over ``widest``."""
    cost: dict[int, float] = {len(text): 0.0}
    for pattern, penalty in ((_SENTENCE, SENTENCE), (_LINE, LINE), (_PARAGRAPH, PARAGRAPH)):
        for m in pattern.finditer(text):
            if m.end() < len(text):
                cost[m.end()] = min(cost.get(m.end(), penalty), penalty)
    last = 0
    for at in sorted(cost):
        if at - last > widest // 3:
            for m in _SPACE.finditer(text, last + 1, at):
                cost.setdefault(m.end(), WORD)
        last = at
    last = 0
    for at in sorted(cost):
        while at - last > widest:
            aim = last + max(1, widest // 4)
            last = _whole_letter(text, aim, min(at - 1, aim + widest // 4))
            cost.setdefault(last, LETTER)
        last = at
    points = np.array(sorted(cost))
    return points, np.array([cost[p] for p in points.tolist()])


def _joins(text: str, at: int) -> bool:
    """Whether the character at ``at`` belongs to the one before it (marks, joiners, variation selectors)."""
    return bool(combining(text[at])) or text[at] in "\u200d\ufe0f" or (at > 0 and text[at - 1] == "\u200d")


def _whole_letter(text: str, at: int, most: int) -> int:
    """The first place from ``at`` to ``most`` that parts no letter from its marks, or ``at`` within a longer run of marks."""
    return next((i for i in range(at, most + 1) if not _joins(text, i)), at)


def _restart(text: str, end: int, overlap: int) -> int:
    """Where the piece after one that ends at ``end`` starts: a word's start near ``end - overlap``."""
    aim = max(0, end - overlap)
    low, high = max(0, aim - SLACK), min(end, aim + SLACK)
    starts = [m.end() for m in _SPACE.finditer(text, low, high) if m.end() < end]
    if not starts:
        return _whole_letter(text, aim, min(end - 1, aim + SLACK))
    return min(starts, key=lambda s: (abs(s - aim), s))


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each piece of a text already stripped."""
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    slack = SLACK if overlap else 0
    fresh = limit - overlap - slack
    if fresh < 1:
        raise ValueError("the overlap leaves no room for new text")
    points, penalty = _cut_points(text, max(1, fresh // 2))
    count = -(-(len(text) - overlap) // (limit - overlap))
    target = (len(text) + (count - 1) * overlap) / count
    m = len(points)
    begin = np.empty(m + 1, dtype=np.int64)  # begin[i]: start of a piece that follows cut i - 1
    begin[0] = 0
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    came = np.zeros(m + 1, dtype=np.int64)
    low = 0
    for j in range(m):
        end = points[j]
        while end - begin[low] > limit:
            low += 1
        size = end - begin[low : j + 1]
        total = best[low : j + 1] + ((size - target) / target) ** 2
        k = int(np.argmin(total))
        best[j + 1], came[j + 1] = total[k] + penalty[j], low + k
        begin[j + 1] = _restart(text, int(end), overlap) if overlap and j + 1 < m else end
        begin[j + 1] = max(begin[j + 1], begin[j])
    pieces, at = [], m
    while at:
        before = int(came[at])
        pieces.append((int(begin[before]), int(points[at - 1])))
        at = before
    return pieces[::-1]


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: the keys, ``piece_no`` from 0, ``start_pos``, ``end_pos``, ``piece``.

    Positions count characters of the stripped item.
    """
    inside = [f"key_{i}" for i in range(len(keys))]
    items = df.select(*[named(k).alias(i) for k, i in zip(keys, inside, strict=True)], F.btrim(named(text), F.lit(BLANKS)).alias("item"))
    whole = items.filter((F.length("item") > 0) & (F.length("item") <= limit)).select(*inside, F.lit(0).alias("piece_no"), F.lit(0).alias("start_pos"), F.length("item").alias("end_pos"), F.col("item").alias("piece"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [cut(t, limit, overlap) for t in batch["item"]]
            out = batch.loc[batch.index.repeat([len(s) for s in spans])].reset_index(drop=True)
            flat = [(i, a, b) for s in spans for i, (a, b) in enumerate(s)]
            out["piece_no"] = np.array([f[0] for f in flat], dtype="int32")
            out["start_pos"] = np.array([f[1] for f in flat], dtype="int32")
            out["end_pos"] = np.array([f[2] for f in flat], dtype="int32")
            out["piece"] = [t[a:b] for t, (_, a, b) in zip(out["item"], flat, strict=True)]
            yield out.drop(columns="item")

    schema = whole.schema
    long = items.filter(F.length("item") > limit).mapInPandas(run, schema)
    renamed = [F.col(i).alias(k) for k, i in zip(keys, inside, strict=True)]
    return whole.unionByName(long).select(*renamed, "piece_no", "start_pos", "end_pos", "piece")


def items_of(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """(item_kind, item_id, seg_no, item_text) of both tables' splittable texts."""
    one = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.lit(0).alias("seg_no"), F.col("content").alias("item_text"))
    each = records.select(F.lit("review_text").alias("item_kind"), F.col("ord").alias("item_id"), F.posexplode("review_text").alias("seg_no", "item_text"))
    return one.unionByName(each)
