"""Evaluation texts leaking into training text: canonical template windows and slot consistency.

Words (runs of letters, digits and marks, in lower case) are turned into templates: numbers in figures or
words and units become typed placeholders, and what stood there the slots' values. Two kinds of windows
are hash-joined with those of the held-out texts:

* Windows of ``WINDOW`` words meet on the hash of their template and on the hash of their slots, so what
  meets holds the same words: an exact leak. Templates that are common because they are mostly slots are
  parted by their slots' values and make no hot key.
* Windows of ``WINDOW`` template words, in which a run of numbers and a run of names are one placeholder
  each, however many words they have, meet on the template alone. A meeting counts where each value of
  the item always stands against the same value of the document, and not all are equal: a re-parameterised
  item. A window needs ``LITERALS`` words outside its slots; one of slots only is a table, not a passage.

A name is a word that its own text writes with a capital within a sentence, which either side decides for
itself; texts that write most words so have no names. Names are typed in the second kind only, so that
writing in capitals hides no exact leak.

Texts are read once, in Arrow batches; a number per window leaves, hashed in numpy. The held-out side is
broadcast if it has at most ``BROADCAST_WINDOWS`` windows; beyond, both sides are shuffled by hash, and a
window common to very many documents is dealt over ``SALTS`` tasks. Either way gives the same rows.
Defined results: null, empty or shorter-than-window texts have no window; repeated rows give one result
row per pair of ids; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtmill.session import fits

WINDOW = 12
#: Words outside slots that a re-parameterised window has at least.
LITERALS = 6
BROADCAST_WINDOWS = 500_000
SALTS = 16
#: Share of capitalised words within sentences from which a text's capitals say nothing.
CAPITALS = 0.5
CACHED_WORDS = 300_000
#: English number words, and units of the field.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million dozen".split()
)
UNIT_WORDS = frozenset("mm cm m km g kg mg oz lb lbs percent degrees degree minutes minute hours hour seconds second days day weeks week months month years year grams ounces".split())
NUMBER, UNIT, NAME = 1, 2, 3
_PLAIN = regex.compile(r"[a-z0-9]+")
_ANY = regex.compile(r"[\p{L}\p{N}\p{M}]+")
#: Words within a sentence, and those of them with a capital.
_WITHIN = regex.compile(r"(?<=[\p{L}\p{N},;]\s)\p{L}[\p{L}\p{M}]+")
_CAPITAL = regex.compile(r"(?<=[\p{L}\p{N},;]\s)\p{Lu}[\p{Ll}\p{M}]+(?!\p{L})")
_MIX = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64) for i in range(128)], dtype=np.uint64)
_TYPE = np.array([0] + [xxhash.xxh64_intdigest(f"slot {i}") for i in (NUMBER, UNIT, NAME)], dtype=np.uint64)


def words(text: str) -> list[str]:
    """The text's words: runs of letters, digits and marks in lower case."""
    low = text.lower()
    return (_PLAIN if low.isascii() else _ANY).findall(low)


def name_words(text: str) -> frozenset[str]:
    """The words a text writes with a capital within its sentences."""
    capital = _CAPITAL.findall(text)
    if not capital or len(capital) > CAPITALS * len(_WITHIN.findall(text)):
        return frozenset()
    return frozenset(w.lower() for w in capital)


class _Coder:
    """Codes of words, kept from batch to batch."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def __call__(self, found: list[str]) -> list[tuple[int, int]]:
        """(code, slot type or 0) of each word."""
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        try:
            return [known[w] for w in found]
        except KeyError:
            for w in found:
                if w not in known:
                    kind = NUMBER if w in NUMBER_WORDS or w.isnumeric() else UNIT if w in UNIT_WORDS else 0
                    known[w] = (xxhash.xxh64_intdigest(w), kind)
            return [known[w] for w in found]


def _rolling(codes: np.ndarray, window: int, salt: int) -> np.ndarray:
    """A hash of the ``window`` codes from each place on, as signed 64 bits."""
    n = len(codes) - window + 1
    total = np.full(n, _MIX[100 + salt], dtype=np.uint64)
    for i in range(window):
        total += codes[i : i + n] * _MIX[(i + 7 * salt) % 100]
        total ^= total >> np.uint64(31)
    return (total * _MIX[90 + salt] ^ (total >> np.uint64(29))).view(np.int64)


def _texts(batch: pa.RecordBatch, window: int, coder: _Coder) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """(row, text, codes, kinds) of the texts long enough for a window."""
    for row, text in enumerate(batch.column("text").to_pylist()):
        found = words(text)
        if len(found) >= window:
            pairs = np.array(coder(found), dtype=np.uint64)
            yield row, text, pairs[:, 0], pairs[:, 1].astype(np.int64)


def _readable(df: DataFrame, key: str, window: int) -> DataFrame:
    return df.filter(F.length("text") >= 2 * window - 1).select(F.col(key).cast("long").alias(key), "text")


def exact_windows(df: DataFrame, key: str, window: int = WINDOW) -> DataFrame:
    """(key, pos, template_hash, slot_hash), one row per window; positions count words from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder()
        for batch in batches:
            read = list(_texts(batch, window, coder))
            if not read:
                continue
            sizes = np.array([len(codes) for _, _, codes, _ in read])
            codes, kinds = np.concatenate([r[2] for r in read]), np.concatenate([r[3] for r in read])
            starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
            place = np.arange(len(codes)) - starts
            whole = np.flatnonzero(place <= np.repeat(sizes, sizes) - window)
            template = _rolling(np.where(kinds > 0, _TYPE[kinds], codes), window, 0)[whole]
            slots = _rolling(np.where(kinds > 0, codes, np.uint64(0)), window, 1)[whole]
            rows = np.repeat(np.array([r[0] for r in read]), sizes)[whole]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows)), pa.array(place[whole].astype(np.int32)), pa.array(template), pa.array(slots)], [key, "pos", "template_hash", "slot_hash"])

    return _readable(df, key, window).mapInArrow(run, f"{key} bigint, pos int, template_hash bigint, slot_hash bigint")


def template_windows(df: DataFrame, key: str, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """(key, pos, template_hash, slots): windows of template words with a slot and enough literal words.

    ``slots`` holds a hash of each slot's value, in order; positions count template words from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder()
        for batch in batches:
            rows, places, hashes, counts, values = [], [], [], [], []
            for row, text, codes, kinds in _texts(batch, window, coder):
                names = {xxhash.xxh64_intdigest(w) for w in name_words(text)}
                if names:
                    kinds = np.where((kinds == 0) & np.isin(codes, np.fromiter(names, np.uint64, len(names))), NAME, kinds)
                if not kinds.any():
                    continue
                same = np.concatenate([[False], (kinds[1:] == kinds[:-1]) & ((kinds[1:] == NUMBER) | (kinds[1:] == NAME))])
                first = np.flatnonzero(~same)
                if len(first) < window:
                    continue
                # The value of a run mixes its words in order.
                within = np.arange(len(codes)) - first[np.cumsum(~same) - 1]
                value = np.add.reduceat(codes * _MIX[within % 90], first)
                kind = kinds[first]
                template = _rolling(np.where(kind > 0, _TYPE[kind], codes[first]), window, 2)
                slotted = np.concatenate([[0], np.cumsum(kind > 0)])
                number = slotted[window:] - slotted[:-window]
                keep = np.flatnonzero((number > 0) & (window - number >= literals))
                if not len(keep):
                    continue
                filled = value[kind > 0].view(np.int64)
                low, n = slotted[keep], number[keep]
                rows.append(np.full(len(keep), row))
                places.append(keep)
                hashes.append(template[keep])
                counts.append(n)
                values.append(filled[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
            if rows:
                ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
                slots = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(hashes)), slots], [key, "pos", "template_hash", "slots"])

    return _readable(df, key, window).mapInArrow(run, f"{key} bigint, pos int, template_hash bigint, slots array<bigint>")


def _meet(docs: DataFrame, held: DataFrame, on: list[str], broadcast_windows: int) -> DataFrame:
    """Equal windows of both sides: broadcast within the bound, else shuffled with documents dealt over salts."""
    if fits(held, broadcast_windows):
        return docs.join(F.broadcast(held), on)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(held.withColumn("salt", salts), [*on, "salt"]).drop("salt")


def exact_leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, exact_windows): numbers of the document's windows that stand in the item word by word."""
    held = exact_windows(items, "item_id", window).select("item_id", "template_hash", "slot_hash").distinct()
    hits = _meet(exact_windows(documents, "doc_id", window), held, ["template_hash", "slot_hash"], broadcast_windows)
    return hits.groupBy("doc_id", "item_id").agg(F.countDistinct("pos").cast("int").alias("exact_windows"))


def consistent(theirs: Column, ours: Column) -> Column:
    """Whether each value of the item's slots always stands against the same value, and some against another."""
    pairs = F.array_distinct(F.arrays_zip(theirs.alias("a"), ours.alias("b")))
    return (F.size(F.array_distinct(theirs)) == F.size(pairs)) & (theirs != ours)


def replaced_leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, template_windows): numbers of the document's windows that are the item's with replaced values."""
    held = template_windows(items, "item_id", window).select("item_id", "template_hash", F.col("slots").alias("item_slots")).distinct()
    hits = _meet(template_windows(documents, "doc_id", window), held, ["template_hash"], broadcast_windows)
    found = hits.filter(consistent(F.col("item_slots"), F.col("slots")))
    return found.groupBy("doc_id", "item_id").agg(F.countDistinct("pos").cast("int").alias("template_windows"))


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, exact_windows, template_windows): documents with the items they hold, pairs with neither left out."""
    both = exact_leaks(documents, items, window, broadcast_windows).join(replaced_leaks(documents, items, window, broadcast_windows), ["doc_id", "item_id"], "full_outer")
    return both.select("doc_id", "item_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("exact_windows", "template_windows")])


def exact_pairs(documents: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id) of documents with at least ``window`` consecutive words of an item."""
    return exact_leaks(documents, items, window, broadcast_windows).select("doc_id", "item_id")
