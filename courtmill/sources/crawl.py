"""Crawls as plans over tables: references are filtered, limited and joined to fetched pages, then parsed.

Fetching itself is the caller's: ``pages`` is a table of what was fetched (source, url, status, text,
fetched_at). Nothing here fails on one bad page: it becomes a row of the failures.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtmill.functions import naming
from courtmill.operators import resolve
from courtmill.sources import html

Layout = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Source:
    """A site: the references of its listing (source, pos, url, name), its layout, and its part in a pilot.

    In a pilot, seeding sources are read first, up to ``seed_limit`` references; all others only where a
    reference names a shoe of the seeds, up to ``follow_limit``.
    """

    refs: DataFrame
    layout: Layout
    seed_limit: int | None = None
    follow_limit: int | None = None


def with_keys(refs: DataFrame, brands: dict[str, list[str]] = naming.BRANDS) -> DataFrame:
    """References with the model key of their names."""
    parts = naming.split_brand(F.col("name"), brands)
    return refs.withColumn("model_key", naming.model_key(parts["brand"], parts["model"], brands))


def limited(refs: DataFrame, limit: int | None) -> DataFrame:
    """Each url once, at its first place, and of each source the first ``limit`` in listing order."""
    first = refs.groupBy("source", "url").agg(F.min_by(F.struct(*[c for c in refs.columns if c not in ("source", "url")]), "pos").alias("r")).select("source", "url", "r.*")
    if limit is None:
        return first
    rank = F.row_number().over(Window.partitionBy("source").orderBy("pos", "url"))
    return first.withColumn("place", rank).filter(F.col("place") <= limit).drop("place")


def until_nothing_new(pages: DataFrame, refs: DataFrame, cap: int) -> DataFrame:
    """The references of a paged listing up to its first page without a new one, and of ``cap`` pages at most.

    ``pages`` has every listing page read (source, page_no, from 1), ``refs`` what stands on them (source,
    page_no, url and more).
    """
    new = refs.groupBy("source", "url").agg(F.min("page_no").alias("page_no")).select("source", "page_no").distinct()
    stop = pages.select("source", "page_no").join(new, ["source", "page_no"], "left_anti").groupBy("source").agg(F.min("page_no").alias("stop"))
    return refs.join(stop, "source", "left").filter((F.col("page_no") <= cap) & (F.col("stop").isNull() | (F.col("page_no") < F.col("stop")))).drop("stop")


def fetched(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """(source, url, fetched_at, text) of the references whose page was fetched: the latest good fetch of each."""
    good = pages.filter((F.coalesce("status", F.lit(200)) == 200) & F.col("text").isNotNull())
    latest = good.groupBy("source", "url").agg(F.max_by(F.struct("fetched_at", "text"), F.struct(F.coalesce("fetched_at", F.lit("")), F.xxhash64("text"))).alias("p"))
    return refs.select("source", "url").join(latest, ["source", "url"]).select("source", "url", "p.fetched_at", "p.text")


def scraped(refs: DataFrame, pages: DataFrame, layout: Layout, limit: int | None = None, wanted: DataFrame | None = None, brands: dict[str, list[str]] = naming.BRANDS) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of a listing: wanted references, then the limit, then fetched pages, then the layout.

    ``wanted`` (model_key) keeps only references to those shoes. Failures are (source, url, error).
    """
    chosen = with_keys(refs, brands)
    if wanted is not None:
        chosen = chosen.join(wanted.select("model_key").distinct(), "model_key", "left_semi")
    read = html.extracted(fetched(limited(chosen, limit), pages), ("source", "url", "fetched_at"))
    return layout(read.filter(F.col("page").isNotNull())), read.filter(F.col("error").isNotNull()).select("source", "url", "error")


def scrape_sources(sources: list[Source], pages: DataFrame, limit: int | None = None, pilot: bool = False, brands: dict[str, list[str]] = naming.BRANDS) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of all sources, one plan; records of layouts with fewer columns have nulls."""
    done: list[tuple[DataFrame, DataFrame]] = []
    seeds: DataFrame | None = None
    for source in sorted(sources, key=lambda s: s.seed_limit is None) if pilot else sources:
        if not pilot:
            done.append(scraped(source.refs, pages, source.layout, limit, brands=brands))
        elif source.seed_limit is not None:
            done.append(scraped(source.refs, pages, source.layout, source.seed_limit, brands=brands))
            keys = resolve.keyed(_with_names(done[-1][0]), brands).select("model_key")
            seeds = keys if seeds is None else seeds.unionByName(keys)
        else:
            wanted = seeds if seeds is not None else source.refs.limit(0).select(F.lit("").alias("model_key"))
            done.append(scraped(source.refs, pages, source.layout, source.follow_limit, wanted, brands))
    failures = done[0][1]
    for _, more in done[1:]:
        failures = failures.unionByName(more)
    return resolve.union_sources(*[r for r, _ in done]), failures


def _with_names(records: DataFrame) -> DataFrame:
    """Records with the columns a model key is made of."""
    return records.withColumns({c: F.lit(None).cast("string") for c in ("brand", "model") if c not in records.columns})
