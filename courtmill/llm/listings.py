"""Product listings describing the same item: title combination voting.

Titles are cut into segments and words; typed attributes (weights, drops, sizes, years) are left out. Ordered combinations of two to ``MOST_WORDS`` words that stand within ``SPAN`` words of a
segment are counted over all titles and scored by frequency, by length, by how close and how far to the
front their words stand, and by cohesion (the share of the rarest word's titles that hold them all). Each
title takes its best combination. Words that follow many different words in cohesive pairs are the heads of
model lines; a title that has pairs of a word and a head chooses among those, fused or misspelt heads
included, and any other title among all its combinations that two or more titles share and that are not
words of brands only.

The combination, the version number, the stated cut and the audience make up a title's group. Then clusters
are verified and merged: a rare combination within two edits of a much commoner one of the same brand joins
it, and titles of one combination that name different brands are parted. Combinations of over
``LONGEST_EDITED`` letters are merged only where they are equal.

Counting is combined in each batch and on the map side, so a product with a third of all titles is no hot
task; titles are read twice, to count and to choose. What the driver gathers are the heads and the words of
brands, two vocabularies checked against ``MOST_HEADS``. Groups are keys, never collected;
``matching_pairs`` only expands them because its result is defined as pairs, and salts large groups.

Defined results: null or blank titles are in no group; an accessory (a thing *for* a shoe) groups only
with the same row delivered again; titles without any shared combination group by their whole folded name;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtmill.llm.canonical import deletes, distance, folded
from courtmill.session import checkpoint


MOST_HEADS = 100_000
HEAD_PARTNERS = 3
COHESION = 0.5
EDITS = 2
LONGEST_EDITED = 60
#: Words of a combination at most, and the stretch of words they stand within.
MOST_WORDS, SPAN = 4, 6
#: Share of a line's titles that a misspelling within one edit, and one within two, may have at most.
RARER, RARE = 0.1, 0.02
SALT_ROWS = 512
CACHED_WORDS = 500_000
#: Words of the field that are never part of a model line.
CUTS = {"low": "low", "lo": "low", "mid": "mid", "high": "high", "hi": "high"}
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}
PLAIN = frozenset(
    "low lo mid high hi top cut mens men womens women unisex adult adults youth kids kid junior jr gs grade school boys girls basketball court hoops "
    "shoe shoes sneaker sneakers trainer trainers gen vol version by for the and with drop weight oz grams size us eu uk release cm mm".split()
)
_YOUTH = re.compile(r"\b(?:gs|grade school|youth|kids?|junior|jr|boys?|girls?|children s|toddler)\b")
#: A thing that is for something; "for men" and the like at the end of a segment tell whom a shoe is for.
_FOR = re.compile(r"\s*(?:[^\W\d_]+[\s:]+){1,4}(?:[-–—|]\s+)?(?:for|fits|to fit|suits|suitable for|compatible with)\b(?!\s+(?:men|women|kids|youth|boys|girls|adults|everyone)\s*(?:$|[,;|/-]))")
_SEGMENT = re.compile(r"\s+[-–—|/•·]+\s+|\s*[|;,•·]\s*|\s+/\s*|\s*/\s+")
_TYPED = re.compile(r"\d+(?:\.\d+)?\s*(?:oz|g|grams?|mm|cm)\b|\bdrop\b|\b(?:us|eu|uk|size)\s*\d+(?:\.\d+)?|\b(?:19|20)\d\d\b|\b(?:ss|fw|aw)\d\d\b")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ]{4})(?=[A-ZÀ-Þ][a-zà-ÿ]{2})")
_WORD = re.compile(r"[^\W_]+")
_VERSION = re.compile(
    r"^\s*(?:(?:low|lo|mid|high|hi)(?:[\s-]*(?:top|cut))?\s+)?(?:(?:gen|vol|version|mk|v|no)\s*\.?\s*(\d{1,2})|#\s*(\d{1,2})|(\d{1,2})|(xii|xi|x|ix|viii|vii|vi|v|iv|iii|ii|i))\b(?!\.\d|\s*(?:oz|g|grams?|mm|cm)\b)"
)


def plain_title(title: str) -> str:
    """Entities resolved, fused capitals parted."""
    text = html.unescape(html.unescape(title)).replace("®", " ").replace("™", " ")
    return re.sub(r"\s+", " ", _CAMEL.sub(" ", text)).strip()


def segments(title: str) -> list[str]:
    """Folded segments of a title, apostrophes dropped."""
    return [s for s in (folded(p).replace("'", "").replace("’", "").strip() for p in _SEGMENT.split(plain_title(title))) if s]


def words(segment: str) -> list[str]:
    """The words of a segment that may name a model line."""
    return [w for w in _WORD.findall(_TYPED.sub(" ", segment)) if len(w) > 2 and not w.isdigit() and w not in PLAIN and not re.fullmatch(r"v?\d+\w*", w)]


def ordered(parts: list[str]) -> Iterator[tuple[tuple[str, ...], int, int]]:
    """(combination, words from its first to its last, place of its first) of a segment's words."""
    for i, first in enumerate(parts):
        rest = range(i + 1, min(len(parts), i + SPAN))
        for k in range(1, MOST_WORDS):
            for chosen in itertools.combinations(rest, k):
                yield (first, *(parts[j] for j in chosen)), chosen[-1] - i, i


def combinations(listings: DataFrame) -> DataFrame:
    """(combination, titles, gap, place): ordered combinations of words of one segment over all titles.

    ``gap`` is the mean number of words from the first to the last beyond their number, ``place`` the
    first's mean position. Combinations of one word count the titles that hold it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[tuple, list[int]] = {}
            for title in batch["model_raw"]:
                seen: dict[tuple, tuple[int, int]] = {}
                for segment in segments(title):
                    parts = words(segment)
                    for i, word in enumerate(parts):
                        seen.setdefault((word,), (0, i))
                    for combination, gap, place in ordered(parts):
                        seen.setdefault(combination, (gap, place))
                for combination, (gap, place) in seen.items():
                    total = counts.setdefault(combination, [0, 0, 0])
                    total[0] += 1
                    total[1] += gap
                    total[2] += place
            yield pd.DataFrame([(list(c), *t) for c, t in counts.items()], columns=["combination", "titles", "gap", "place"])

    each = listings.filter(F.btrim("model_raw") != "").select("model_raw").mapInPandas(run, "combination array<string>, titles bigint, gap bigint, place bigint")
    total = each.groupBy("combination").agg(*[F.sum(c).alias(c) for c in ("titles", "gap", "place")]).filter("titles > 1")
    return total.select("combination", "titles", (F.col("gap") / F.col("titles") - F.size("combination") + 1).alias("gap"), (F.col("place") / F.col("titles")).alias("place"))


def scored(combos: DataFrame) -> DataFrame:
    """(combination, titles, gap, place, df1, df2, cohesion, score) of two words or more; ``df1``, ``df2`` of the first and last."""
    single = combos.filter(F.size("combination") == 1).select(F.get("combination", F.lit(0)).alias("word"), F.col("titles").alias("df"))
    several = combos.filter(F.size("combination") > 1)
    rarest = several.select("combination", F.explode("combination").alias("word")).join(single, "word").groupBy("combination").agg(F.min("df").alias("rarest"), F.map_from_entries(F.collect_set(F.struct("word", "df"))).alias("dfs"))
    joined = several.join(rarest, "combination").withColumn("cohesion", F.col("titles") / F.col("rarest"))
    last = F.element_at("combination", -1)
    length = F.size("combination") * F.length(F.array_join("combination", "")) / 2
    score = F.log1p("titles") * F.col("cohesion") * length / (1 + F.col("gap") + 1) / (1 + F.col("place") / 8)
    return joined.select("combination", "titles", "gap", "place", F.element_at("dfs", F.get("combination", F.lit(0))).alias("df1"), F.element_at("dfs", last).alias("df2"), "cohesion", score.alias("score"))


def heads(scores: DataFrame) -> list[str]:
    """Words that stand right after ``HEAD_PARTNERS`` or more different rarer words in cohesive pairs."""
    near = scores.filter((F.size("combination") == 2) & (F.col("gap") < 0.5) & (F.col("cohesion") >= COHESION) & (F.col("df1") < F.col("df2")))
    found = near.select(F.element_at("combination", -1).alias("second")).groupBy("second").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HEAD_PARTNERS)
    rows = found.orderBy(F.desc("n"), "second").limit(MOST_HEADS + 1).collect()  # at most MOST_HEADS + 1 rows
    if len(rows) > MOST_HEADS:
        raise ValueError("more heads than may be broadcast")
    return [r.second for r in rows]


def brand_words(listings: DataFrame) -> list[str]:
    """Words of the brands named in two or more rows; they are no part of a model line."""
    texts = listings.filter(F.btrim("brand") != "").groupBy(F.lower(F.btrim("brand")).alias("b")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    rows = texts.orderBy(F.desc("n"), "b").limit(MOST_HEADS + 1).collect()  # at most MOST_HEADS + 1 rows
    if len(rows) > MOST_HEADS:
        raise ValueError("more brand spellings than may be broadcast")
    return sorted({w for r in rows for w in _WORD.findall(folded(r.b)) if len(w) >= 3})


class Parser:
    """What a title says, given the heads of model lines and the words of brands."""

    def __init__(self, known: list[str], brands: list[str] = ()):
        self.heads = frozenset(known)
        self.brands = frozenset(brands)
        self.near_brands = frozenset(k for b in brands if len(b) >= 4 for k in deletes(b, 1))
        self.near: dict[str, set[str]] = defaultdict(set)
        for head in known:
            if len(head) >= 3:
                for key in deletes(head, 1):
                    self.near[key].add(head)
        self.ends = tuple(sorted(known, key=lambda h: -len(h)))
        self.known_heads: dict[str, str | None] = {}
        self.known_firsts: dict[str, bool] = {}

    def head_of(self, word: str) -> str | None:
        """The head a word spells, one edit allowed."""
        if word not in self.known_heads:
            if len(self.known_heads) > CACHED_WORDS:
                self.known_heads.clear()
            self.known_heads[word] = self._head_of(word)
        return self.known_heads[word]

    def _head_of(self, word: str) -> str | None:
        if word in self.heads:
            return word
        if len(word) < 3 or word in PLAIN:
            return None
        close = {h for key in deletes(word, 1) for h in self.near.get(key, ())}
        best = [(distance(word, h, 1.5), h) for h in close]
        best = [b for b in best if b[0] <= 1.5]
        return min(best)[1] if best else None

    def names_line(self, word: str) -> bool:
        """Whether a word may be the first of a model line: no brand or misspelt brand, no common word."""
        if word not in self.known_firsts:
            if len(self.known_firsts) > CACHED_WORDS:
                self.known_firsts.clear()
            self.known_firsts[word] = self._names_line(word)
        return self.known_firsts[word]

    def _names_line(self, word: str) -> bool:
        if len(word) < 4 or not word.isalpha() or word in PLAIN or word in self.brands or word in self.heads:
            return False
        return not any(k in self.near_brands for k in deletes(word, 1)) or all(distance(word, b, 1.0) > 1.0 for b in self.brands)

    def lines(self, parts: list[str]) -> list[tuple[str, str, str]]:
        """Candidate (word, head, what follows) of a title's segments, exact heads first."""
        exact, loose = [], []
        for segment in parts:
            spans = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(segment)]
            for i, (word, _, end) in enumerate(spans):
                if word in PLAIN or word.isdigit():
                    continue
                before = spans[i - 1][0] if i else ""
                fits = self.names_line(before)
                if fits and word in self.heads:
                    exact.append((before, word, segment[end:]))
                elif fits and word not in self.heads and word not in self.brands and (head := self.head_of(word)):
                    loose.append((before, head, segment[end:]))
                fused = next((h for h in self.ends if word.endswith(h) and len(word) - len(h) >= 5), None) if word.endswith(self.ends) and word not in self.heads else None
                if fused:
                    loose.append((word[: -len(fused)], fused, segment[end:]))
        return exact or loose

    @staticmethod
    def version(rest: str) -> int:
        m = _VERSION.match(rest)
        if not m:
            return 0
        digits = m.group(1) or m.group(2) or m.group(3)
        return int(digits) if digits else ROMAN[m.group(4)]

    @staticmethod
    def cut(parts: list[str]) -> str:
        text = " ".join(parts)
        m = re.search(r"\b(low|lo|mid|high|hi)[\s-]*(?:top|cut)\b", text) or re.search(r"\b(low|lo|mid|high|hi)\b", text)
        return CUTS[m.group(1)] if m else ""

    @staticmethod
    def youth(parts: list[str]) -> bool:
        return bool(_YOUTH.search(re.sub(r"[^\w]+", " ", " ".join(parts))))

    @staticmethod
    def accessory(title: str) -> bool:
        """Whether the title starts with a thing that is *for* something, or fits it."""
        return bool(_FOR.match(folded(plain_title(title))))


def brand_key(brand: str | None) -> str:
    """A brand as it is compared: folded letters without store and company words."""
    found = [w for w in _WORD.findall(folded(brand or "")) if w not in ("sports", "official", "store", "inc", "footwear", "basketball", "shop", "co", "the", "by")]
    return "".join(found)


def parsed(listings: DataFrame, known: list[str], brands: list[str] = ()) -> DataFrame:
    """(ord, combination, line, version, cut, youth, brand, accessory, name): one row per candidate of a title.

    ``line`` tells whether the candidate is a word and a head; if a title has one, it has no others.
    """
    parser = listings.sparkSession.sparkContext.broadcast(Parser(known, brands))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = parser.value
        for batch in batches:
            rows = []
            for key, title, brand in zip(batch["ord"], batch["model_raw"], batch["brand"], strict=True):
                parts = segments(title)
                common = (p.cut(parts), p.youth(parts), brand_key(brand if isinstance(brand, str) else None))
                name = " ".join(sorted({w for s in parts[:1] for w in _WORD.findall(s)}))
                for word, head, rest in p.lines(parts):
                    rows.append((key, [word, head], True, p.version(rest), *common, p.accessory(title), name))
                if not rows or rows[-1][0] != key:
                    rows.append((key, [], False, 0, *common, p.accessory(title), name))
                    for segment in parts:
                        for combination in dict.fromkeys(c for c, _, _ in ordered(words(segment)) if not p.brands.issuperset(c)):
                            rest = segment[segment.rfind(combination[-1]) + len(combination[-1]) :]
                            rows.append((key, list(combination), False, p.version(rest), *common, p.accessory(title), name))
            yield pd.DataFrame(rows, columns=["ord", "combination", "line", "version", "cut", "youth", "brand", "accessory", "name"]).astype({"version": "int32"})

    titled = listings.filter(F.btrim("model_raw") != "").select(F.col("ord").cast("long"), "model_raw", "brand")
    return titled.mapInPandas(run, "ord bigint, combination array<string>, line boolean, version int, cut string, youth boolean, brand string, accessory boolean, name string")


def chosen(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """(ord, line, version, cut, youth, brand, accessory, name): each title with its best combination, '' if none is shared."""
    fields = ("combination", "version", "cut", "youth", "brand", "accessory", "name")
    ranked = rows.join(scores.select("combination", "score"), "combination", "left").filter(F.col("line") | (F.size("combination") == 0) | F.col("score").isNotNull())
    rank = F.struct(F.coalesce("score", F.lit(0.0)), F.length(F.coalesce(F.get("combination", F.lit(0)), F.lit(""))), "combination")
    best = ranked.groupBy("ord").agg(F.max_by(F.struct(*fields), rank).alias("b")).select("ord", "b.*")
    return best.select("ord", F.array_join("combination", "").alias("line"), "version", "cut", "youth", "brand", "accessory", "name")


def merged_lines(clusters: DataFrame) -> DataFrame:
    """(line, into): rare lines that are a misspelling of a much commoner line of the same brand.

    ``clusters`` has one row per line with ``titles`` and ``brand``. Lines meet on hashes of their delete
    keys; a key of very many lines, all alike but for four letters, is split by adaptive execution.
    """

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["keys"] = [sorted(deletes(line, EDITS)) if len(line) <= LONGEST_EDITED else [line] for line in batch["line"]]
            yield batch

    def alike(a: str, b: str, brand_a: str, brand_b: str, few: int, many: int) -> bool:
        if brand_a and brand_b and brand_a != brand_b and distance(brand_a, brand_b, 2.0) > 2.0:
            return False
        sure = brand_a and brand_b and many > 1 and few <= max(2, RARE * many)
        return distance(a, b, 2.0) <= (2.0 if sure else 1.0)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["a_line", "b_line", "a_brand", "b_brand", "a_titles", "b_titles"]
        for batch in batches:
            good = [alike(*row) for row in zip(*(batch[c].tolist() for c in columns), strict=True)]
            yield batch[np.array(good, dtype=bool)]

    tasks = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entered = clusters.select("line", "titles", "brand").repartition(tasks, "line").mapInPandas(enter, "line string, titles bigint, brand string, keys array<string>")
    each = entered.select("line", "titles", "brand", F.explode("keys").alias("key")).select("line", "titles", "brand", F.xxhash64("key").alias("key"))
    rare = each.select("key", *[F.col(c).alias(f"a_{c}") for c in ("line", "titles", "brand")])
    often = each.select("key", *[F.col(c).alias(f"b_{c}") for c in ("line", "titles", "brand")])
    much_rarer = F.col("a_titles") <= F.greatest(F.lit(2), F.col("b_titles") * RARER)
    ordered = (F.col("a_titles") < F.col("b_titles")) | ((F.col("a_titles") == F.col("b_titles")) & (F.col("a_line") > F.col("b_line")))
    pairs = rare.join(often, "key").filter((F.col("a_line") != F.col("b_line")) & much_rarer & ordered).drop("key").distinct()
    good = pairs.mapInPandas(check, pairs.schema)
    once = good.groupBy(F.col("a_line").alias("line")).agg(F.max_by("b_line", F.struct("b_titles", "b_line")).alias("into"))
    twice = once.select(F.col("line").alias("into"), F.col("into").alias("further"))
    return once.join(twice, "into", "left").select("line", F.coalesce("further", "into").alias("into"))


def groups(listings: DataFrame) -> DataFrame:
    """(ord, group_id): listings of one shoe have the same id; accessories have ids of their own rows."""
    brands = brand_words(listings)
    scores = checkpoint(scored(checkpoint(combinations(listings))))  # shared combinations only; each read twice
    best = checkpoint(chosen(parsed(listings, heads(scores), brands), scores))  # one short row a title; read five times
    shoes = best.filter(~F.col("accessory") & (F.col("line") != ""))
    votes = shoes.groupBy("line", "brand").agg(F.count(F.lit(1)).alias("n"))
    clusters = votes.groupBy("line").agg(F.sum("n").alias("titles"), F.max_by("brand", F.struct(F.when(F.col("brand") != "", F.col("n")).otherwise(0), "brand")).alias("brand"))
    moved = checkpoint(merged_lines(clusters))  # misspelt lines only; read twice
    home = F.coalesce(F.col("into"), F.col("line"))
    # Parted brands: another brand's name in a line counts only with two titles and more than two edits.
    placed = votes.join(moved, "line", "left").select(home.alias("home"), "brand", "n").groupBy("home", "brand").agg(F.sum("n").alias("n"))
    top = placed.groupBy("home").agg(F.max_by("brand", F.struct(F.when(F.col("brand") != "", F.col("n")).otherwise(0), "brand")).alias("top"))

    def other(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            apart = [bool(x and y and not x.startswith(y) and not y.startswith(x) and distance(x, y, 3.0) > 3.0) for x, y in zip(batch["brand"], batch["top"], strict=True)]
            yield batch[np.array(apart, dtype=bool)]

    rivals = placed.join(top, "home").filter((F.col("n") >= 2) & (F.col("brand") != F.col("top"))).select("home", "brand", "top")
    apart = rivals.mapInPandas(other, rivals.schema).select("home", "brand", F.col("brand").alias("own_brand"))
    joined = shoes.join(moved, "line", "left").withColumn("home", home).join(apart, ["home", "brand"], "left")
    told = joined.select("ord", F.concat_ws("|", F.lit("shoe"), "home", F.coalesce("own_brand", F.lit("")), F.col("version").cast("string"), "cut", F.col("youth").cast("string")).alias("group_id"))
    loose = best.filter(~F.col("accessory") & (F.col("line") == "")).select("ord", F.concat_ws("|", F.lit("name"), "name", "brand", F.col("version").cast("string"), "cut", F.col("youth").cast("string")).alias("group_id"))
    same_row = F.concat_ws("|", F.lit("accessory"), F.xxhash64("source", "url", "model_raw").cast("string"), F.xxhash64("model_raw", "url").cast("string"))
    things = best.filter("accessory").select("ord").join(listings.select(F.col("ord").cast("long").alias("ord"), same_row.alias("group_id")), "ord")
    return told.unionByName(loose).unionByName(things)


def matching_pairs(grouped: DataFrame) -> DataFrame:
    """(ord_a, ord_b), ord_a < ord_b, of every group; groups are cut into salted blocks of about SALT_ROWS."""
    sizes = grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group_id", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("blocks"))
    member = grouped.join(sizes, "group_id").withColumn("block", F.pmod(F.xxhash64("ord"), F.col("blocks")).cast("int"))
    left = member.select("group_id", "block", F.col("ord").alias("ord_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    right = member.select("group_id", F.col("block").alias("other"), F.col("ord").alias("ord_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return left.join(right, ["group_id", "block", "other"]).filter("ord_a < ord_b").select("ord_a", "ord_b")
