"""Browsing the catalogue: optional filters, sorted pages, totals and projections."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtmill.schemas import METADATA_FIELDS, SPEC_FIELDS


@dataclass(frozen=True)
class Filters:
    """What a shoe must satisfy; None asks nothing."""

    brand: str | None = None
    budget_min: float | Decimal | None = None
    budget_max: float | Decimal | None = None
    outdoor: str | None = None
    playstyle: str | None = None
    cut: str | None = None
    width: str | None = None
    position: str | None = None

    def checked(self, limit: int = 20, offset: int = 0) -> Filters:
        if self.budget_min is not None and self.budget_max is not None and self.budget_min > self.budget_max:
            raise ValueError("budget_min is greater than budget_max")
        if any(b is not None and b < 0 for b in (self.budget_min, self.budget_max)):
            raise ValueError("a budget is negative")
        if not 1 <= limit <= 100 or offset < 0:
            raise ValueError("limit must be 1 to 100 and offset 0 or more")
        return self

    @classmethod
    def of_request(cls, budget: float | None = None, playstyle_tag: str | None = None, **rest: str | None) -> Filters:
        """From a recommendation request, whose budget is a maximum and whose tag is a playstyle."""
        return cls(budget_max=budget, playstyle=playstyle_tag, **rest)


def conditions(f: Filters) -> list[Column]:
    """The filters as predicates on the catalogue; a null price meets no price bound."""
    out: list[Column] = []
    if f.brand is not None:
        out.append(F.lower("brand") == f.brand.lower())
    if f.budget_min is not None:
        out.append(F.col("price") >= F.lit(f.budget_min))
    if f.budget_max is not None:
        out.append(F.col("price") <= F.lit(f.budget_max))
    for field, value in (("outdoor_suitability", f.outdoor), ("cut_height", f.cut), ("width_fit", f.width)):
        if value is not None:
            out.append(F.col(f"specs.{field}") == value)
    for field, value in (("playstyle_tags", f.playstyle), ("position_tags", f.position)):
        if value is not None:
            out.append(F.array_contains(f"specs.{field}", value))
    return out


def matching(catalog: DataFrame, filters: Filters) -> DataFrame:
    return reduce(DataFrame.filter, conditions(filters), catalog)


def page(catalog: DataFrame, filters: Filters, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page, cheapest first, shoes without a price last."""
    filters.checked(limit, offset)
    return matching(catalog, filters).orderBy(F.asc_nulls_last("price"), "name", "id").offset(offset).limit(limit)


def total(catalog: DataFrame, filters: Filters) -> DataFrame:
    return matching(catalog, filters).agg(F.count(F.lit(1)).alias("total"))


def dearest_first(catalog: DataFrame, filters: Filters, limit: int | None = None) -> DataFrame:
    """Matching shoes, shoes without a price first, then the dearest."""
    rows = matching(catalog, filters).orderBy(F.desc_nulls_first("price"), "id")
    return rows if limit is None else rows.limit(limit)


def by_id(catalog: DataFrame, shoe_id: int) -> DataFrame:
    """The shoe of an id: one row or none."""
    return catalog.filter(F.col("id") == shoe_id).limit(1)


def of_ids(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """The shoes whose ids are in the one-column table ``ids``."""
    return catalog.join(ids.toDF("id").distinct(), "id", "left_semi")


def summary(catalog: DataFrame, *more: str) -> DataFrame:
    """The columns of a list of shoes, and ``more`` of the catalogue's own."""
    lifted = [F.col(f"specs.{f}").alias(f) for f in ("version", "release_year", "cut_height", "width_fit", "cushioning_tech", "outdoor_suitability", "weight_oz")]
    tags = [F.coalesce(f"specs.{t}", F.array().cast("array<string>")).alias(t) for t in ("position_tags", "playstyle_tags")]
    return catalog.select("id", "canonical_id", "brand", "name", F.col("price").cast("double").alias("price"), "currency", "image_url", "affiliate_url", *lifted, *tags, *more)


def detail(catalog: DataFrame) -> DataFrame:
    """A shoe with all it has."""
    return summary(catalog, "specs", "extra_metadata", "source_url", "created_at", "updated_at")


def catalog_columns(canonical: DataFrame, currency: str = "USD") -> DataFrame:
    """Canonical shoes as catalogue rows without ids and times."""
    return canonical.select(
        "canonical_id",
        "brand",
        F.col("model").alias("name"),
        (F.col("msrp_usd_cents").cast("decimal(12,0)") / 100).cast("decimal(10,2)").alias("price"),
        F.lit(currency).alias("currency"),
        F.try_element_at("image_urls", F.lit(1)).alias("image_url"),
        "affiliate_url",
        F.try_element_at("sources", F.lit(1))["url"].alias("source_url"),
        F.struct(*SPEC_FIELDS).alias("specs"),
        F.struct(*METADATA_FIELDS).alias("extra_metadata"),
    )
