"""Units and money as Column expressions; every builder takes a string column and gives null on a miss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OUNCES_PER_GRAM = 0.03527396
NUMBER = r"(\d+(?:\.\d+)?)"


def _captured(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def weight(text: Column) -> Column:
    """struct<oz, g> from '13.9 oz' or '394 g'; ounces are looked for first, the other unit is computed."""
    oz = _captured(text, rf"(?i){NUMBER}\s*oz").try_cast("double")
    g = _captured(text, rf"(?i){NUMBER}\s*g(?:rams)?\b").try_cast("double")
    return F.struct(
        F.coalesce(oz, F.bround(g * OUNCES_PER_GRAM, 2)).alias("oz"),
        F.when(oz.isNotNull(), F.bround(oz / OUNCES_PER_GRAM, 1)).otherwise(g).alias("g"),
    )


def millimetres(text: Column) -> Column:
    """'8 mm', '8.5mm' or a bare number."""
    return F.coalesce(_captured(text, rf"(?i){NUMBER}\s*mm"), _captured(text, rf"(?U)^\s*{NUMBER}\s*$")).try_cast("double")


def usd_cents(text: Column) -> Column:
    """The first number of the text, in cents."""
    return F.bround(_captured(text, NUMBER).try_cast("decimal(20,6)") * 100, 0).cast("int")


def price_of_cents(cents: Column) -> Column:
    """Cents as decimal(10,2)."""
    return (cents.cast("decimal(12,0)") / 100).cast("decimal(10,2)")


def budget(text: Column) -> Column:
    """A budget choice: blank or ending in '+' is no limit, else its digits."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(F.btrim(text).endswith("+"), F.lit(None)).otherwise(F.nullif(digits, F.lit("")).try_cast("double"))


def price_label(price: Column) -> Column:
    """'$' and the whole price, or a dash."""
    return F.coalesce(F.concat(F.lit("$"), F.round(price, 0).cast("bigint").cast("string")), F.lit("—"))
