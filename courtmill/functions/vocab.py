"""Fixed vocabularies as Column expressions: fits, surfaces and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Synonyms of positions and of playstyles.
POSITIONS = {
    "pg": "guard",
    "sg": "guard",
    "guard": "guard",
    "point guard": "guard",
    "shooting guard": "guard",
    "sf": "wing",
    "wing": "wing",
    "small forward": "wing",
    "forward": "wing",
    "pf": "big",
    "c": "big",
    "big": "big",
    "center": "big",
    "power forward": "big",
    "big man": "big",
}
PLAYSTYLES = {
    "slasher": "slasher",
    "shooter": "shooter",
    "all-around": "all-around",
    "all around": "all-around",
    "allround": "all-around",
    "versatile": "all-around",
    "post": "post",
    "post player": "post",
    "post scorer": "post",
    "defender": "defender",
    "lockdown defender": "defender",
    "speedster": "speedster",
    "quick guard": "speedster",
    "shifty": "speedster",
}


def _first(text: Column, *rules: tuple[tuple[str, ...], str]) -> Column:
    """The result of the first rule one of whose words is in the text."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for needles, result in reversed(rules):
        hit = low.contains(needles[0])
        for needle in needles[1:]:
            hit = hit | low.contains(needle)
        out = F.when(hit, F.lit(result)).otherwise(out)
    return out


def cut_height(text: Column) -> Column:
    return _first(text, (("low",), "low"), (("mid",), "mid"), (("high",), "high"))


def width_fit(text: Column) -> Column:
    return _first(text, (("narrow",), "narrow"), (("wide",), "wide"), (("standard", "medium", "normal", "true"), "standard"))


def outdoor(text: Column) -> Column:
    return _first(text, (("good", "great", "excellent"), "good"), (("fair", "average", "decent", "ok"), "fair"), (("bad", "poor", "avoid"), "bad"))


def length_fit(text: Column) -> Column:
    """True to size first, then small before large; 'slight', 'half' and 'bit' soften."""
    low = F.lower(text)
    soft = low.rlike("slight|half|bit")
    small = low.rlike("small|short|size up")
    large = low.rlike("large|big|long|size down")
    exact = low.contains("true to size") | low.isin("tts", "true")
    return (
        F.when(exact, "true_to_size")
        .when(small, F.when(soft, "slightly_small").otherwise("runs_small"))
        .when(large, F.when(soft, "slightly_large").otherwise("runs_large"))
    )


def surface(text: Column) -> Column:
    """Suitability for outdoor courts of the surface a shoe is meant for."""
    low = F.lower(text)
    out, inside = low.contains("outdoor"), low.contains("indoor")
    return F.when(out & ~inside, "good").when(out & inside, "fair").when(inside, "bad")


def outdoor_of_score(score: Column) -> Column:
    """From a sub-score of 100; 0 says nothing."""
    return F.when(score.isNull() | (score == 0), None).when(score >= 75, "good").when(score >= 55, "fair").otherwise("bad")


def outdoor_of_percent(percent: Column) -> Column:
    return F.when(percent >= 80, "good").when(percent >= 55, "fair").when(percent.isNotNull(), "bad")


def _tags(text: Column, mapping: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    parts = F.split(F.lower(text), r"[/,;+&]| and ")
    return F.array_distinct(F.array_compact(F.transform(parts, lambda p: F.try_element_at(table, F.regexp_replace(p, r"(?U)^\s+|\s+$", "")))))


def positions(text: Column) -> Column:
    """Tags of a list like 'PG/SG', in order, each once."""
    return _tags(text, POSITIONS)


def playstyles(text: Column) -> Column:
    return _tags(text, PLAYSTYLES)


def tags_in(text: Column) -> Column:
    """Sorted tags named anywhere in free text as whole words; one-letter synonyms don't count."""
    low = F.lower(text)
    by_tag: dict[str, list[str]] = {}
    for word, tag in [*POSITIONS.items(), *PLAYSTYLES.items()]:
        if len(word) > 1:
            by_tag.setdefault(tag, []).append(word)
    hits = [F.when(low.rlike(rf"(?U)\b(?:{'|'.join(words)})\b"), F.lit(tag)) for tag, words in sorted(by_tag.items())]
    return F.array_compact(F.array(*hits))
