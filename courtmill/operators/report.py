"""Coverage: records by source, sources by shoe, fill rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtmill.schemas import MERGEABLE_NAMES, TAGS
from courtmill.session import named

CONTAINERS = ("metrics", "pros", "review_text", "image_urls")


def records_by_source(records: DataFrame) -> DataFrame:
    return records.groupBy("source").agg(F.count(F.lit(1)).alias("records"))


def n_sources(sources: str = "sources") -> Column:
    """The number of different sources of a shoe."""
    return F.size(F.array_distinct(F.transform(sources, lambda s: s["source"])))


def source_histogram(canonical: DataFrame) -> DataFrame:
    return canonical.select(n_sources().alias("n_sources")).groupBy("n_sources").agg(F.count(F.lit(1)).alias("shoes"))


def multi_source(canonical: DataFrame) -> DataFrame:
    return canonical.agg(F.count_if(n_sources() >= 2).alias("multi_source"), F.count(F.lit(1)).alias("shoes"))


def _filled(df: DataFrame, field: str) -> Column:
    kind = df.schema[field].dataType.typeName()
    return F.coalesce(F.size(named(field)) > 0, F.lit(False)) if kind in ("array", "map") else named(field).isNotNull()


def fill_rates(canonical: DataFrame) -> DataFrame:
    """(field, filled, percent): one pass over all fields; percent is null for containers, 0 for no shoes."""
    fields = [*MERGEABLE_NAMES, *TAGS, *CONTAINERS]
    once = canonical.agg(F.count(F.lit(1)).alias("shoes"), *[F.count_if(_filled(canonical, f)).alias(f) for f in fields])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), named(f).alias("filled"), F.lit(f not in CONTAINERS).alias("rated")) for f in fields])).alias("r")
    percent = F.when(F.col("r.rated"), F.when(F.col("shoes") > 0, F.bround(100.0 * F.col("r.filled") / F.col("shoes"), 1)).otherwise(0.0))
    return once.select("shoes", rows).select("r.field", "r.filled", percent.alias("percent"))


def filled_fields(fields: tuple[str, ...] = MERGEABLE_NAMES) -> Column:
    """The number of a row's fields that are filled."""
    return sum((named(f).isNotNull().cast("int") for f in fields), F.lit(0))


def pilot(canonical: DataFrame, limit: int = 30) -> DataFrame:
    """The shoes most sources describe best."""
    rated = canonical.withColumn("n_sources", n_sources()).withColumn("filled", filled_fields())
    return rated.orderBy(F.desc("n_sources"), F.desc("filled"), "canonical_id").limit(limit)


def counts(**tables: DataFrame) -> DataFrame:
    """(what, n): the sizes of several tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


#: The width of a report's rules and of its field names.
RULE, NAME = 62, 22


def coverage_text(canonical: DataFrame, records: DataFrame, unmatched: DataFrame, ambiguous: DataFrame) -> str:
    """The coverage report as text, made of a few small aggregates; sources stand by name."""
    by_source = {r.source: r.records for r in records_by_source(records).orderBy("source").collect()}  # a row per source
    multi = multi_source(canonical).first()
    shoes = multi["shoes"]
    lines = ["", "=" * RULE, "COVERAGE REPORT", "=" * RULE, f"per-source records parsed: {by_source}", f"canonical shoes: {shoes}"]
    lines += [f"  in {r.n_sources} source(s): {r.shoes}" for r in source_histogram(canonical).orderBy(F.desc("n_sources")).collect()]  # a row per number of sources
    lines += [f"  cross-source (>=2): {multi['multi_source']}", "field fill rates (canonical):"]
    rates = {r.field: r for r in fill_rates(canonical).collect()}  # a row per field
    for field in (*MERGEABLE_NAMES, *TAGS, *CONTAINERS):
        filled = f"  {field:{NAME}} {rates[field].filled:4}/{shoes}"
        lines.append(filled if field in CONTAINERS else f"{filled}  ({100 * rates[field].filled / shoes if shoes else 0:3.0f}%)")
    lines += [f"unmatched (manual review): {unmatched.count()}", f"ambiguous near-misses (manual review): {ambiguous.count()}", "=" * RULE]
    return "\n".join(lines)
