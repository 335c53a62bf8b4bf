"""Brands, model keys and versions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What brands are called. Any other table of the same form may be passed instead.
BRANDS = {
    "Jordan": ["air jordan", "jordan brand", "jordan"],
    "Nike": ["nike"],
    "Adidas": ["adidas"],
    "Under Armour": ["under armour", "under armor", "ua "],
    "Puma": ["puma"],
    "New Balance": ["new balance", "nb "],
    "Anta": ["anta"],
    "Li-Ning": ["li-ning", "li ning", "lining", "way of wade"],
    "Reebok": ["reebok"],
    "Converse": ["converse"],
    "361 Degrees": ["361 degrees", "361°", "361"],
    "Peak": ["peak"],
    "Asics": ["asics"],
}
#: A line name that also names its brand and stays in the model.
KEPT_LINES = ("way of wade",)
#: Roman numerals read as numbers, tokens left out, tokens spelt another way.
ROMAN = {
    "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10", "xi": "11", "xii": "12",
    "xiii": "13", "xiv": "14", "xx": "20", "xxx": "30", "xxxi": "31", "xxxii": "32", "xxxiii": "33", "xxxiv": "34", "xxxv": "35",
    "xxxvi": "36", "xxxvii": "37", "xxxviii": "38", "xxxix": "39", "xl": "40",
}
DROPPED = ("the", "basketball", "shoe", "shoes", "performance", "review", "ep", "pe", "se", "team", "edition", "ad")
RESPELT = {"zer0": "zero", "3zer0": "3zero", "vol": "volume", "millenium": "millennium", "lo": "low", "way": "wxy"}
REWRITTEN = (("fly.by", "fly by"), ("air zoom", "zoom"))


def _by_length(brands: dict[str, list[str]]) -> list[tuple[str, str]]:
    pairs = [(alias, brand) for brand, aliases in brands.items() for alias in aliases]
    return sorted(pairs, key=lambda p: -len(p[0]))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _aliases(brands: dict[str, list[str]]) -> Column:
    """A constant array of (alias, word, brand), longest alias first; one value, however many brands."""
    return F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(a.strip()).alias("word"), F.lit(b).alias("brand")) for a, b in _by_length(brands)])


def brand(text: Column, brands: dict[str, list[str]] = BRANDS) -> Column:
    """The brand whose longest alias the text is or starts with; null if none."""
    low = F.lower(_stripped(text))
    return F.get(F.filter(_aliases(brands), lambda a: (low == a["word"]) | low.startswith(a["alias"])), F.lit(0))["brand"]


def split_brand(name: Column, brands: dict[str, list[str]] = BRANDS) -> Column:
    """struct<brand, model> of a display name; without a known brand the model is the whole name."""
    whole = F.struct(_stripped(name).alias("name"))
    first = F.transform(
        F.array(whole),
        lambda w: F.struct(w["name"].alias("name"), F.get(F.filter(_aliases(brands), lambda a: F.lower(w["name"]).startswith(F.concat(a["word"], F.lit(" ")))), F.lit(0)).alias("hit")),
    )
    cut = lambda x: F.when(x["hit"].isNull() | x["hit"]["word"].isin(*KEPT_LINES), x["name"]).otherwise(_stripped(F.substring(x["name"], F.length(x["hit"]["word"]) + 1, F.length(x["name"]))))
    return F.get(F.transform(first, lambda x: F.struct(x["hit"]["brand"].alias("brand"), cut(x).alias("model"))), F.lit(0))


def model_key(brand_name: Column, model: Column, brands: dict[str, list[str]] = BRANDS) -> Column:
    """A model's matching key: lower-case tokens without punctuation, brand words and editions."""
    text = F.replace(F.lower(model), F.lit("&"), F.lit(" and "))
    for old, new in REWRITTEN:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(text, r"(?<=[a-z0-9])\.(?=\d)", " ")
    text = F.regexp_replace(F.regexp_replace(text, "[.'’]", ""), "[^a-z0-9]+", " ")
    own = F.create_map(*[x for title, aliases in brands.items() for x in (F.lit(title), F.array(*[F.lit(w) for a in aliases for w in a.split()]))])
    own_words = F.coalesce(F.try_element_at(own, F.coalesce(brand_name, F.lit(""))), F.array().cast("array<string>"))
    roman = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    respelt = F.create_map(*[F.lit(x) for pair in RESPELT.items() for x in pair])

    def folded(token: Column) -> Column:
        plain = F.regexp_replace(token, r"^v(\d+)$", "$1")
        number = F.coalesce(F.try_element_at(roman, plain), plain)
        return F.coalesce(F.try_element_at(respelt, number), number)

    kept = F.filter(F.split(F.trim(text), " +"), lambda t: (t != "") & ~F.array_contains(own_words, t) & ~t.isin(*DROPPED))
    return F.array_join(F.transform(kept, folded), " ")


def slug(*parts: Column) -> Column:
    joined = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.regexp_replace(F.regexp_replace(F.lower(joined), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def key_slug(label: Column) -> Column:
    """A label as a snake-case key."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def version(model: Column) -> Column:
    """The number a model's key ends with, or null."""
    return F.nullif(F.regexp_extract(model_key(F.lit(None).cast("string"), model), r"(\d+(?:\.\d+)?)\s*$", 1), F.lit(""))


def numeric_signature(key: Column) -> Column:
    """The numeric tokens of a key, in order."""
    return F.filter(F.split(key, " "), lambda t: t.rlike(r"^\d+(?:\.\d+)?$"))


def review_title(title: Column) -> Column:
    """A title without a closing 'performance review' or 'review'."""
    return _stripped(F.regexp_replace(title, r"(?iU)\s*performance review\s*$|\s*review\s*$", ""))
