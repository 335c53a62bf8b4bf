"""Mapping free-entered values to a canonical list by symmetric-delete lookup.

Every reference spelling (canonical values and aliases) is folded to letters and digits and entered
under all its variants with up to ``MOST_EDITS`` characters deleted; a value's own deletes then find
every spelling within that many edits without comparing it to the whole list. Candidates are ranked by
weighted Damerau-Levenshtein distance, then by how much of the value they explain, then by how often
the reference entry occurs letter for letter in the data, then by id. Words a field's values are
dressed in (``DRESSING``) cost nothing; other words left over allow an exact spelling only.

The dictionary is broadcast while the list has at most ``BROADCAST_TERMS`` spellings; a longer list is
joined on the delete keys instead, under the same rules. Values never leave their rows' partitions in the
first case: each batch resolves its distinct values once, so a hot value costs no shuffle. In the second
only distinct values are joined. Spellings and stretches of more than ``LONGEST_EDITED`` letters are
entered and looked up letter for letter.

Defined results: null and blank values have no row; a value that means no entry has ``ref_id`` 0; an
empty list maps everything to 0; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtmill.session import named, small

MOST_EDITS = 2
#: Letters up to which edits are looked for: a stretch has some n * n / 2 deletes.
LONGEST_EDITED = 80
BROADCAST_TERMS = 50_000
CACHED_VALUES = 200_000
FIELDS = ("brand", "cushioning_tech", "cut_height")
#: Words that dress up a value of the field without changing what it means.
DRESSING = {
    "brand": "by the brand inc co ltd llc corp footwear sports sport basketball hoops official store shoes shoe company maker from a".split(),
    "cushioning_tech": "with tech technology foam unit cushioning cushion full length dual density heel only forefoot system midsole the a".split(),
    "cut_height": "cut top tops rise collar profile height per maker the a is ankle below above shoe style".split(),
}
_LIKE = {frozenset(p) for p in ("0o", "1i", "1l", "5s", "8b", "3e", "4a", "2z", "6g", "7t", "il", "9g")}
_WORD = re.compile(r"[^\W_]+")


def folded(value: str) -> str:
    """Lower case without accents, compatibility forms resolved."""
    if value.isascii():
        return value.lower()
    text = unicodedata.normalize("NFKD", value.replace("™", " ").replace("®", " ")).casefold()
    return "".join(c for c in text if not unicodedata.combining(c)).replace("ß", "ss")


def _words(value: str) -> list[str]:
    return _WORD.findall(folded(value))


def deletes(term: str, edits: int = MOST_EDITS) -> set[str]:
    """The term and all its variants with up to ``edits`` characters deleted."""
    found = level = {term}
    for _ in range(edits):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        found = found | level
    return found


def lookup_keys(term: str) -> set[str]:
    """What a spelling is entered and looked up under."""
    return deletes(term) if len(term) <= LONGEST_EDITED else {term}


def bound(term: str) -> float:
    """Greatest weighted distance at which a spelling still counts as this term."""
    return 1.0 if len(term) <= 6 else 2.0


def distance(value: str, term: str, most: float) -> float:
    """Weighted Damerau-Levenshtein distance (optimal string alignment), or infinity beyond ``most``.

    Look-alikes cost 0.3, doubled letters 0.5, transpositions 0.8, letters missing at the end 0.5, all
    else 1; a wrong first letter costs 0.5 more.
    """
    n, m = len(value), len(term)
    if value == term:
        return 0.0
    if m > n and term.startswith(value) and n >= 2:
        return 0.5 * (m - n) if 0.5 * (m - n) <= most else float("inf")
    before: list[float] = []
    row = [float(j) for j in range(m + 1)]
    for i in range(1, n + 1):
        a = value[i - 1]
        now = [row[0] + 1.0]
        for j in range(1, m + 1):
            b = term[j - 1]
            change = 0.0 if a == b else 0.3 if frozenset((a, b)) in _LIKE else 1.5 if i == j == 1 else 1.0
            more = 0.5 if i > 1 and a == value[i - 2] else 1.0
            less = 0.5 if j > 1 and b == term[j - 2] else 1.0
            best = min(row[j - 1] + change, row[j] + more, now[j - 1] + less)
            if i > 1 and j > 1 and a == term[j - 2] and b == value[i - 2] and a != b:
                best = min(best, before[j - 2] + 0.8)
            now.append(best)
        if min(now) > most and min(row) > most:
            return float("inf")
        before, row = row, now
    return row[m] if row[m] <= most else float("inf")


class Dictionary:
    """Symmetric-delete index of one or more fields' reference spellings."""

    def __init__(self, entries: Iterable[tuple[str, int, str]], frequency: dict[int, int] | None = None, dressing: dict[str, list[str]] | None = None):
        """``entries``: (field, ref_id, spelling)."""
        self.dressing = {f: frozenset(w) for f, w in (DRESSING if dressing is None else dressing).items()}
        self.frequency = frequency or {}
        self.index: dict[tuple[str, str], set[tuple[str, int]]] = defaultdict(set)
        self.longest: dict[str, int] = {}
        leading: dict[tuple[str, str], set[int]] = defaultdict(set)
        acronym: dict[tuple[str, str], set[int]] = defaultdict(set)
        for field, ref, spelling in entries:
            parts = _words(spelling)
            term = "".join(parts)
            if not term:
                continue
            self.longest[field] = max(self.longest.get(field, 1), len(parts))
            for key in lookup_keys(term):
                self.index[field, key].add((term, ref))
            if len(parts) > 1:
                leading[field, parts[0]].add(ref)
                acronym[field, "".join(p[0] for p in parts)].add(ref)
        self.leading = {k: next(iter(v)) for k, v in leading.items() if len(v) == 1 and len(k[1]) >= 4}
        self.acronym = {k: next(iter(v)) for k, v in acronym.items() if len(v) == 1 and len(k[1]) >= 2}

    def candidates(self, field: str, text: str) -> set[tuple[str, int]]:
        found: set[tuple[str, int]] = set()
        for key in lookup_keys(text):
            found |= self.index.get((field, key), set())
        return found

    def resolve(self, field: str, value: str) -> int:
        """The id of the entry meant, or 0."""
        return choose(field, value, self.dressing.get(field, frozenset()), self.longest.get(field, 1), self.candidates, self.frequency, self.leading, self.acronym)


def windows(value: str, dressing: frozenset[str], longest: int) -> Iterator[tuple[str, bool, int]]:
    """Folded stretches of the value to look up: (stretch, nothing but dressing left over, characters left over)."""
    parts: list[str] = []
    for word in _words(value):
        loose = next((d for d in sorted(dressing, key=lambda d: -len(d)) if len(d) >= 3 and word.endswith(d) and 2 <= len(word) - len(d) <= 5), None) if word not in dressing else None
        parts += [word[: -len(loose)], loose] if loose and "cut" in dressing else [word]
    whole = "".join(parts)
    seen: set[tuple[str, bool]] = set()
    for size in range(min(len(parts), longest + 2), 0, -1):  # a spelling may be broken once or twice more
        for i in range(len(parts) - size + 1):
            stretch = "".join(parts[i : i + size])
            rest = parts[:i] + parts[i + size :]
            clean = all(w in dressing or w in parts[i : i + size] or "".join(rest) == stretch for w in rest)
            if (stretch, clean) not in seen:
                seen.add((stretch, clean))
                yield stretch, clean, len(whole) - len(stretch)


def cost(stretch: str, term: str, clean: bool, dressing: frozenset[str]) -> float | None:
    """The distance of a stretch to a spelling, or None if it doesn't mean it."""
    d = distance(stretch, term, bound(term))
    bad = d > bound(term) or (not clean and (d > 0 or len(term) < 3)) or (len(stretch) < 3 and d > 1.0) or (stretch in dressing and d > 0)
    return None if bad else d


def choose(field, value, dressing, longest, candidates, frequency, leading, acronym) -> int:
    """The best candidate over all stretches of a value, or 0."""
    best: tuple | None = None
    for stretch, clean, left in windows(value, dressing, longest):
        for term, ref in candidates(field, stretch):
            d = cost(stretch, term, clean, dressing)
            if d is None:
                continue
            rank = (not clean, d, -len(term), left, -frequency.get(ref, 0), ref)
            best = min(best, rank) if best else rank
    if best:
        return best[-1]
    bare = [w for w in _words(value) if w not in dressing]
    if len(bare) == 1:
        return leading.get((field, bare[0])) or acronym.get((field, bare[0])) or 0
    return 0


def spellings(reference: DataFrame) -> DataFrame:
    """(field_name, ref_id, spelling): canonical values and aliases."""
    each = F.array_compact(F.concat(F.array("canonical_value"), F.coalesce("aliases", F.expr("array()").cast("array<string>"))))
    return reference.filter(F.col("ref_id").isNotNull()).select("field_name", F.col("ref_id").cast("int").alias("ref_id"), F.explode(each).alias("spelling"))


def typed_values(records: DataFrame, reference: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field_name, value) of non-blank values that are no canonical value letter for letter."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), named(f).alias("value")) for f in fields])).alias("pair")
    each = records.select(named(key).alias("record_key"), pairs).select("record_key", "pair.*").filter(F.btrim("value", F.lit(" \t\r\n ")) != "")
    exact = small(reference.select("field_name", F.col("canonical_value").alias("value")).distinct())
    return each.join(exact, ["field_name", "value"], "left_anti")


def reference_frequency(records: DataFrame, reference: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(ref_id, n): how often each entry occurs letter for letter; one row per entry at most."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), named(f).alias("canonical_value")) for f in fields])).alias("pair")
    counts = records.select(pairs).select("pair.*").groupBy("field_name", "canonical_value").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(reference.select("field_name", "canonical_value", "ref_id"), ["field_name", "canonical_value"]).groupBy("ref_id").agg(F.sum("n").alias("n"))


def map_values(records: DataFrame, reference: DataFrame, key: str = "ord", fields: tuple[str, ...] = FIELDS, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(key, field_name, value, ref_id) of every typed value; ``ref_id`` 0 reports a miss."""
    values = typed_values(records, reference, key, fields)
    terms = spellings(reference)
    bounded = terms.limit(broadcast_terms + 1).collect()  # at most broadcast_terms + 1 rows
    if len(bounded) > broadcast_terms:
        return _by_join(values, terms, reference_frequency(records, reference, fields), key)
    frequency = {r.ref_id: r.n for r in reference_frequency(records, reference, fields).collect()}  # a row per entry of the bounded list
    shared = records.sparkSession.sparkContext.broadcast(Dictionary([tuple(r) for r in bounded], frequency))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], int] = {}
        for batch in batches:
            if len(known) > CACHED_VALUES:
                known.clear()
            codes, pairs = pd.MultiIndex.from_arrays([batch["field_name"], batch["value"]]).factorize()
            for pair in pairs:
                if pair not in known:
                    known[pair] = shared.value.resolve(*pair)
            ids = pd.Series([known[p] for p in pairs], dtype="int32")
            batch["ref_id"] = ids.to_numpy()[codes] if len(batch) else pd.Series(dtype="int32")
            yield batch

    kind = values.schema["record_key"].dataType.simpleString()
    out = values.select("record_key", "field_name", "value").mapInPandas(run, f"record_key {kind}, field_name string, value string, ref_id int")
    return out.select(F.col("record_key").alias(key), "field_name", "value", "ref_id")


def _by_join(values: DataFrame, terms: DataFrame, frequency: DataFrame, key: str) -> DataFrame:
    """The same for a list too long to broadcast: stretches and terms meet on their delete keys."""
    dressing = {f: frozenset(w) for f, w in DRESSING.items()}
    none: frozenset[str] = frozenset()

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["parts"] = [_words(v) for v in batch["spelling"]]
            yield batch

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for field, value, most in zip(batch["field_name"], batch["value"], batch["longest"], strict=True):
                rows = [(field, value, s, c, n, key) for s, c, n in windows(value, dressing.get(field, none), int(most)) for key in lookup_keys(s)]
                yield pd.DataFrame(rows, columns=["field_name", "value", "stretch", "clean", "rest", "key"]).astype({"rest": "int32"})

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, r, t, key) for f, r, t in zip(batch["field_name"], batch["ref_id"], batch["term"], strict=True) for key in lookup_keys(t)]
            yield pd.DataFrame(rows, columns=["field_name", "ref_id", "term", "key"]).astype({"ref_id": "int32"})

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["cost"] = [cost(s, t, c, dressing.get(f, none)) for s, t, c, f in zip(batch["stretch"], batch["term"], batch["clean"], batch["field_name"], strict=True)]
            kept = batch[batch["cost"].notna()]
            yield kept.astype({"cost": "float64"})

    def bare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left = [[w for w in _words(v) if w not in dressing.get(f, none)] for f, v in zip(batch["field_name"], batch["value"], strict=True)]
            batch["word"] = pd.Series([w[0] if len(w) == 1 else None for w in left], index=batch.index, dtype=object)
            yield batch[batch["word"].notna()]

    terms = terms.mapInPandas(part, "field_name string, ref_id int, spelling string, parts array<string>").filter(F.size("parts") > 0)
    longest = terms.groupBy("field_name").agg(F.max(F.size("parts")).alias("longest"))
    distinct = values.select("field_name", "value").distinct().join(small(longest), "field_name", "left").na.fill(1, ["longest"])
    stretches = distinct.mapInPandas(cut, "field_name string, value string, stretch string, clean boolean, rest int, key string")
    entered = terms.select("field_name", "ref_id", F.array_join("parts", "").alias("term")).distinct().mapInPandas(enter, "field_name string, ref_id int, term string, key string")
    pairs = stretches.join(entered, ["field_name", "key"]).select("field_name", "value", "stretch", "clean", "rest", "term", "ref_id").distinct()
    ranked = pairs.mapInPandas(weigh, "field_name string, value string, stretch string, clean boolean, rest int, term string, ref_id int, cost double")
    ranked = ranked.join(small(frequency.select(F.col("ref_id").cast("int").alias("ref_id"), "n")), "ref_id", "left")
    rank = F.struct(~F.col("clean"), F.col("cost"), -F.length("term"), F.col("rest"), -F.coalesce("n", F.lit(0)), F.col("ref_id"))
    best = ranked.groupBy("field_name", "value").agg(F.min_by("ref_id", rank).alias("ref_id"))

    def only(word: Column, letters: int, name: str) -> DataFrame:
        """The entry that alone has the word."""
        each = terms.filter(F.size("parts") > 1).select("field_name", word.alias("word"), "ref_id").filter(F.length("word") >= letters)
        one = each.groupBy("field_name", "word").agg(F.min("ref_id").alias(name), F.max("ref_id").alias("other"))
        return small(one.filter(F.col(name) == F.col("other")).drop("other"))

    # What has no candidate may be the first word or the initials of an entry.
    rest = distinct.join(best, ["field_name", "value"], "left_anti").select("field_name", "value").mapInPandas(bare, "field_name string, value string, word string")
    initials = F.array_join(F.transform("parts", lambda p: F.substring(p, 1, 1)), "")
    rest = rest.join(only(F.get("parts", F.lit(0)), 4, "leading"), ["field_name", "word"], "left").join(only(initials, 2, "acronym"), ["field_name", "word"], "left")
    fallback = rest.select("field_name", "value", F.coalesce("leading", "acronym").alias("ref_id")).filter("ref_id is not null")
    mapped = values.join(best.unionByName(fallback), ["field_name", "value"], "left")
    return mapped.select(F.col("record_key").alias(key), "field_name", "value", F.coalesce("ref_id", F.lit(0)).alias("ref_id"))


def misses(mapped: DataFrame) -> DataFrame:
    """(field_name, value, n): the values that mean no entry, with their numbers of rows."""
    return mapped.filter("ref_id = 0").groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))
