"""Best representative of each duplicate group: field-by-field survivorship.

One aggregation takes, for each field, the maximum of a composite struct (source priority, instant,
ordinal, value), so a group of any size is reduced by partial aggregates on the map side; no group is
ever collected. Only the keys and the merged fields are read and shuffled.

Defined results: a row with a null or impossible value never wins; a source missing from the registry
is the least trusted; an empty, null or unreadable ``fetched_at`` is the oldest; ties end with the
smallest ``ord``; rows delivered twice count as two rows; a link listed twice counts once; empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtmill.session import named, small

#: Least and greatest possible value of each mergeable number, ends included.
BOUNDS = {"msrp_usd_cents": (2_000, 60_000), "weight_oz": (5, 30)}
WORST_RANK = 2**31 - 1
OLDEST = -(2**63)


def instant(stamp: Column) -> Column:
    """ISO-like text as microseconds since 1970; no zone means UTC; null if it can't be read."""
    text = F.upper(F.btrim(stamp, F.lit(" \t\r\n")))
    text = F.regexp_replace(text, r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "$1-$2-$3")
    text = F.regexp_replace(text, r"^(\d{4}-\d{1,2}-\d{1,2})\s+", "$1T")
    text = F.regexp_replace(text, r"(T[\d:.]+)\s*(?:UTC|GMT)$", "$1Z")
    text = F.regexp_replace(text, r"(T[\d:.]+)\s*([+-]\d{2}):?(\d{2})$", "$1$2:$3")
    text = F.regexp_replace(text, r"(T[\d:.]+)\s*([+-]\d{2})$", "$1$2:00")
    dated = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat(text, F.lit("T00:00:00Z")))
    zoned = dated.when(text.rlike(r"T[\d:.]+$"), F.concat(text, F.lit("Z"))).otherwise(text)
    return F.unix_micros(zoned.try_cast("timestamp"))


def possible(field: str, bounds: dict[str, tuple[float, float]]) -> Column:
    """Whether a value may survive: in its bounds, or just present and not blank where it has none."""
    value = named(field)
    if field in bounds:
        low, high = bounds[field]
        return value.between(F.lit(low), F.lit(high))
    return value.isNotNull() & (F.btrim(value.cast("string")) != "")


def memberships(canonical: DataFrame) -> DataFrame:
    """(canonical_id, source, url, fetched_at), each link once."""
    link = F.explode("sources").alias("link")
    return canonical.select("canonical_id", link).select("canonical_id", "link.source", "link.url", "link.fetched_at").distinct()


def survivors(
    canonical: DataFrame,
    records: DataFrame,
    registry: DataFrame,
    fields: tuple[str, ...] = tuple(BOUNDS),
    bounds: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """One row per canonical id that has records: ``n_records`` and a struct of each field's winner.

    Each winner struct holds ``ord``, ``value``, ``source``, ``url`` and ``fetched_at``; it is null if no
    record has a possible value.
    """
    limits = BOUNDS if bounds is None else bounds
    keys = ("source", "url", "fetched_at")
    trust = registry.groupBy("source").agg(F.min("trust_rank").alias("trust_rank"))
    rows = records.select(*keys, "ord", *[named(f) for f in fields]).join(small(trust), "source", "left")
    links = memberships(canonical).select("canonical_id", *[F.col(k).alias(f"link_{k}") for k in keys])
    same = [F.col(f"link_{k}").eqNullSafe(F.col(k)) for k in keys]
    joined = links.join(rows, same[0] & same[1] & same[2]).withColumn("at", instant(F.col("fetched_at")))

    def winner(field: str) -> Column:
        rank = F.struct(
            (-F.coalesce(F.col("trust_rank"), F.lit(WORST_RANK)).cast("long")).alias("trust"),
            F.coalesce("at", F.lit(OLDEST)).alias("at"),
            (-F.col("ord")).alias("order"),
            F.col("ord"),
            named(field).alias("value"),
            *keys,
        )
        return F.max(F.when(possible(field, limits), rank))

    best = joined.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n_records"), *[winner(f).alias(f) for f in fields])
    kept = ("ord", "value", *keys)
    return best.select(
        "canonical_id",
        "n_records",
        *[F.when(named(f).isNotNull(), F.struct(*[named(f)[k].alias(k) for k in kept])).alias(f) for f in fields],
    )


def rebuilt(best: DataFrame, fields: tuple[str, ...] = tuple(BOUNDS)) -> DataFrame:
    """The surviving record itself: the fields' values, and ``provenance`` by field."""
    entries = [
        F.when(named(f).isNotNull(), F.struct(F.lit(f).alias("key"), F.struct(*[named(f)[k].alias(k) for k in ("source", "url", "fetched_at")]).alias("value")))
        for f in fields
    ]
    provenance = F.map_from_entries(F.array_compact(F.array(*entries)))
    return best.select("canonical_id", "n_records", *[named(f)["value"].alias(f) for f in fields], provenance.alias("provenance"))


def winning_rows(best: DataFrame, fields: tuple[str, ...] = tuple(BOUNDS), least_records: int = 2) -> DataFrame:
    """(canonical_id, field_name, ord) of each surviving value of groups of ``least_records`` or more."""
    wins = F.array_compact(F.array(*[F.when(named(f).isNotNull(), F.struct(F.lit(f).alias("field_name"), named(f)["ord"].alias("ord"))) for f in fields]))
    return best.filter(F.col("n_records") >= least_records).select("canonical_id", F.explode(wins).alias("win")).select("canonical_id", "win.*")
