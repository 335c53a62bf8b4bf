"""Prose: boilerplate sentences, shortening, summaries, prompts and the recursive splitter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of advertising sentences, removed in this order.
ADVERTISING = (
    r"(?is)(?:some|the) links? (?:on|in) this (?:page|post|article).{0,300}",
    r"(?is)affiliate (?:links?|commission|disclosure).{0,300}",
    r"(?is)we may earn a commission.{0,200}",
    r"(?is)at no (?:extra|additional) cost to you.{0,100}",
    r"(?is)(?:click|tap) here to (?:buy|shop|check).{0,150}",
    r"(?i)(?:buy|shop|check price) (?:it |them )?(?:now |today )?(?:at|on|from) (?:amazon|nike|adidas|ebay|stockx)[^.]*\.?",
    r"(?is)subscribe to (?:our|the) (?:newsletter|channel).{0,150}",
)
#: The parts of a specification summary, and of the chips of a card.
SUMMARY = (
    ("cut_height", "%s cut"),
    ("cushioning_tech", "cushioning: %s"),
    ("traction_pattern", "traction: %s"),
    ("weight_oz", "weight: %s oz"),
    ("width_fit", "fit width: %s"),
    ("length_fit", "sizing: %s"),
    ("outdoor_suitability", "outdoor suitability: %s"),
)
CHIPS = (("cut_height", "%s cut"), ("cushioning_tech", "%s"), ("outdoor_suitability", "outdoor: %s"), ("width_fit", "%s fit"))
MOST_CHIPS = 6
CHUNK_CHARS = 1_500


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_advertising(text: Column) -> Column:
    for pattern in ADVERTISING:
        text = F.regexp_replace(text, pattern, "")
    return trimmed(F.regexp_replace(text, r"(?U)\s{2,}", " "))


def one_line(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"(?U)\s+", " "))


def shortened(text: Column, most: int) -> Column:
    """One line of at most ``most`` characters, with an ellipsis if cut."""
    line = one_line(text)
    cut = F.regexp_replace(F.substring(line, 1, most - 1), r"(?U)\s+$", "")
    return F.when(F.length(line) > most, F.concat(cut, F.lit("…"))).otherwise(line)


def query_text(playstyle: Column, aesthetic: Column) -> Column:
    """The sentence a request is embedded as."""
    play, look = F.nullif(trimmed(playstyle), F.lit("")), F.nullif(trimmed(aesthetic), F.lit(""))
    parts = F.concat_ws(" ", F.concat(F.lit("Basketball shoe for a "), play, F.lit(" player.")), F.concat(F.lit("Style and look: "), look, F.lit(".")))
    return F.when(parts == "", F.lit("Basketball shoe recommendation.")).otherwise(parts)


def _filled(template: str, value: Column) -> Column:
    before, after = template.split("%s")
    return F.concat(F.lit(before), F.replace(value.cast("string"), F.lit("_"), F.lit(" ")), F.lit(after))


def _listed(label: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, ", ")))


def spec_summary(brand: Column, name: Column, specs: str, price: Column) -> Column:
    """The facts of a shoe as one paragraph; ``specs`` names the struct of its specifications."""
    field = lambda f: F.col(f"{specs}.{f}")
    parts = [
        F.concat_ws(" ", brand, name),
        F.concat(F.lit("signature shoe of "), F.nullif(field("signature_player"), F.lit(""))),
        F.concat(F.lit("released "), F.nullif(field("release_year"), F.lit(0)).cast("string")),
        *[_filled(template, field(f)) for f, template in SUMMARY],
        _listed("positions: ", field("position_tags")),
        _listed("playstyles: ", field("playstyle_tags")),
        F.concat(F.lit("price: $"), F.bround(price, 0).cast("bigint").cast("string")),
    ]
    return F.concat(F.concat_ws(". ", *parts), F.lit("."))


def spec_chips(specs: str) -> Column:
    """At most six short labels."""
    field = lambda f: F.col(f"{specs}.{f}")
    none = F.array().cast("array<string>")
    spaced = lambda tags: F.transform(F.coalesce(tags, none), lambda t: F.replace(t, F.lit("_"), F.lit(" ")))
    single = F.array_compact(F.array(*[_filled(template, F.nullif(field(f), F.lit(""))) for f, template in CHIPS]))
    return F.slice(F.concat(spaced(field("playstyle_tags")), spaced(field("position_tags")), single), 1, MOST_CHIPS)


def explanation(brand: Column, name: Column, specs: str, playstyle: Column, snippet: Column, snippet_source: Column) -> Column:
    """Why a shoe fits, from its facts and its best snippet."""
    field = lambda f: F.nullif(F.col(f"{specs}.{f}"), F.lit(""))
    play = F.nullif(trimmed(playstyle), F.lit(""))
    start = F.concat(F.lit("The "), F.concat_ws(" ", brand, name), F.coalesce(F.concat(F.lit(" fits a "), play, F.lit(" player")), F.lit(" is a strong match")))
    details = F.concat_ws(
        ", ",
        F.concat(F.replace(field("cut_height"), F.lit("_"), F.lit(" ")), F.lit(" cut")),
        F.concat(field("cushioning_tech"), F.lit(" cushioning")),
        F.concat(F.lit("outdoor suitability rated "), field("outdoor_suitability")),
    )
    sentence = F.concat(start, F.when(details != "", F.concat(F.lit(" with "), details)).otherwise(F.lit("")), F.lit("."))
    credit = F.coalesce(F.concat(F.nullif(snippet_source, F.lit("")), F.lit(" notes: ")), F.lit("From the specs: "))
    quote = F.concat(F.lit(" "), credit, F.lit('"'), shortened(snippet, 180), F.lit('"'))
    return F.concat(sentence, F.coalesce(quote, F.lit("")))


def split_text(text: str, most: int = CHUNK_CHARS) -> list[str]:
    """Pieces of at most ``most`` characters: packed paragraphs, within those sentences, else windows."""
    out: list[str] = []
    todo = [text]
    while todo:
        piece = todo.pop().strip()
        if len(piece) <= most:
            out += [piece] if piece else []
            continue
        glue = next((g for g in ("\n\n", ". ") if g in piece), None)
        if glue is None:
            out += [piece[i : i + most] for i in range(0, len(piece), most)]
            continue
        packed: list[str] = []
        for part in piece.split(glue):
            if packed and packed[-1] and len(packed[-1]) + len(glue) + len(part) <= most:
                packed[-1] += glue + part
            elif packed and not packed[-1]:
                packed[-1] = part
            else:
                packed.append(part)
        todo += reversed([p for p in packed if p])
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_long(texts: pd.Series) -> pd.Series:
    """The splitter over a column; null gives no piece."""
    return texts.map(lambda t: split_text(t) if isinstance(t, str) else [])


def split(text: Column, most: int = CHUNK_CHARS) -> Column:
    """Pieces of a text; only texts over the limit leave the JVM."""
    line = trimmed(text)
    whole = F.when(line == "", F.array().cast("array<string>")).otherwise(F.array(line))
    return F.when(F.length(line) <= most, whole).otherwise(split_long(F.when(F.length(line) > most, line)))


def prompt_block(position: Column, brand: Column, name: Column, price: Column, specs: Column, similarity: Column, snippets: Column) -> Column:
    """The evidence of one candidate in a language model's prompt."""
    lines = F.transform(F.slice(snippets, 1, 3), lambda s: F.concat(F.lit("- ["), F.coalesce(F.nullif(s["source"], F.lit("")), F.lit("specs")), F.lit("] "), one_line(s["text"])))
    shown = F.regexp_replace(price.cast("decimal(10,2)").cast("string"), r"\.?0+$", "")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), position.cast("string"), F.lit("] "), brand, F.lit(" "), name, F.lit(" — $"), F.coalesce(shown, F.lit("?"))),
        F.concat(F.lit("Specs JSON: "), F.to_json(specs)),
        F.coalesce(F.concat(F.lit("Similarity: "), F.format_number(similarity, 2)), F.lit("Similarity: (not available)")),
        F.lit("Evidence:"),
        F.when(F.size(snippets) > 0, F.array_join(lines, "\n")).otherwise(F.lit("- (no review snippets)")),
        F.lit(""),
    )


def user_prompt(playstyle: Column, aesthetic: Column, blocks: Column) -> Column:
    """The whole prompt: the shopper's profile, the candidates' evidence, and what is to be made of it."""
    said = lambda c: F.coalesce(F.nullif(trimmed(c), F.lit("")), F.lit("(not provided)"))
    return F.concat_ws(
        "\n",
        F.lit("Shopper profile:"),
        F.concat(F.lit("- Playstyle: "), said(playstyle)),
        F.concat(F.lit("- Aesthetic: "), said(aesthetic)),
        F.lit("\nCandidates (explain each in order):\n"),
        blocks,
        F.lit("Produce one recommendation card per candidate in the same order."),
    )


def request_words(position: Column, styles: Column, free_text: Column) -> Column:
    """The words of a request from what an intake form holds: position, list of styles, free text."""
    parts = [position, F.array_join(styles, ", "), trimmed(free_text)]
    return F.concat_ws(" — ", *[F.nullif(p, F.lit("")) for p in parts])
