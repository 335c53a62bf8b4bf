"""Chunks of the catalogue's texts and the incremental upkeep of their index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtmill.functions import text
from courtmill.sources import models


def summaries(catalog: DataFrame) -> DataFrame:
    """(shoe_id, section, pos, content, source): one summary of facts a shoe."""
    return catalog.select(F.col("id").alias("shoe_id"), F.lit(0).alias("section"), F.lit(0).alias("pos"), text.spec_summary(F.col("brand"), F.col("name"), "specs", F.col("price")).alias("content"), F.lit(None).cast("string").alias("source"))


def _notes(catalog: DataFrame, field: str) -> DataFrame:
    """(shoe_id, title, pos, source, note): a list's notes that aren't blank; no source is 'unknown'."""
    each = catalog.select(F.col("id").alias("shoe_id"), F.concat_ws(" ", "brand", "name").alias("title"), F.posexplode(f"extra_metadata.{field}").alias("pos", "n"))
    rows = each.select("shoe_id", "title", "pos", F.coalesce(F.nullif(F.col("n.source"), F.lit("")), F.lit("unknown")).alias("source"), text.trimmed(F.col("n.text")).alias("note"))
    return rows.filter(F.coalesce("note", F.lit("")) != "")


def reviews(catalog: DataFrame) -> DataFrame:
    """Review segments, split to size, each led by the shoe's title."""
    pieces = _notes(catalog, "review_text").select("shoe_id", "title", "pos", "source", F.posexplode(text.split(F.col("note"))).alias("part", "piece"))
    place = (F.col("pos") * 1_000_000 + F.col("part")).cast("int")
    return pieces.select("shoe_id", F.lit(1).alias("section"), place.alias("pos"), F.concat("title", F.lit(" — "), "piece").alias("content"), "source")


def opinions(catalog: DataFrame) -> DataFrame:
    """Pros and cons of a shoe and source, split to size."""

    def joined(field: str) -> DataFrame:
        notes = _notes(catalog, field).groupBy("shoe_id", "title", "source").agg(F.sort_array(F.collect_list(F.struct("pos", "note"))).alias("notes"))
        return notes.select("shoe_id", "title", "source", F.array_join(F.transform("notes", lambda n: n["note"]), "; ").alias(field))

    both = joined("pros").join(joined("cons"), ["shoe_id", "title", "source"], "full_outer")
    lines = F.concat_ws("\n", "title", F.concat(F.lit("Pros: "), "pros"), F.concat(F.lit("Cons: "), "cons"))
    return both.select("shoe_id", F.lit(2).alias("section"), F.posexplode(text.split(lines)).alias("pos", "content"), "source").select("shoe_id", "section", "pos", "content", "source")


def built(catalog: DataFrame) -> DataFrame:
    """(shoe_id, content, source, section, pos): all chunks, each content and source of a shoe once."""
    rows = summaries(catalog).unionByName(reviews(catalog)).unionByName(opinions(catalog))
    first = rows.groupBy("shoe_id", "content", "source").agg(F.min(F.struct("section", "pos")).alias("at"))
    return first.select("shoe_id", "content", "source", "at.section", "at.pos")


def sync(existing: DataFrame, desired: DataFrame, model_id: str) -> DataFrame:
    """(id, shoe_id, content, source, action): keep, delete (stale) or embed (new).

    Chunks match on shoe, content and source (null equals null) under ``model_id``; of equal existing rows
    the one with the smallest id is kept.
    """
    key = ["shoe_id", "content", "source"]
    rank = F.row_number().over(Window.partitionBy(*key, "model_id").orderBy("id"))
    old = existing.select("id", *key, "model_id").withColumn("rn", rank)
    o = old.select(F.col("id"), *[F.col(c).alias(f"old_{c}") for c in key], (F.col("rn") == 1).alias("first"), (F.col("model_id") == model_id).alias("same_model"))
    d = desired.select(*key).distinct()
    match = (F.col("old_shoe_id") == F.col("shoe_id")) & F.col("old_content").eqNullSafe(F.col("content")) & F.col("old_source").eqNullSafe(F.col("source"))
    candidates = o.filter(F.coalesce("same_model", F.lit(False)) & F.col("first"))
    both = candidates.join(d, match, "full_outer")
    action = F.when(F.col("id").isNull(), "embed").when(F.col("shoe_id").isNull(), "delete").otherwise("keep")
    matched = both.select("id", *[F.when(F.col("id").isNull(), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in key], action.alias("action"))
    rest = o.filter(~F.coalesce("same_model", F.lit(False)) | ~F.col("first")).select("id", *[F.col(f"old_{c}").alias(c) for c in key], F.lit("delete").alias("action"))
    return matched.unionByName(rest)


def counters(synced: DataFrame) -> DataFrame:
    """One row: shoes, kept, embedded, deleted."""
    return synced.agg(
        F.countDistinct(F.when(F.col("action") != "delete", F.col("shoe_id"))).alias("shoes"),
        *[F.count_if(F.col("action") == a).alias(n) for a, n in (("keep", "kept"), ("embed", "embedded"), ("delete", "deleted"))],
    )


def embedded(new_rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model_id: str, now: Column) -> DataFrame:
    """New index rows: ``embedder`` turns at most ``models.BATCH`` texts into vectors at a time, in their order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            frame["vector"] = models.embedded(embedder, frame["content"].tolist())
            yield frame

    rows = new_rows.select("shoe_id", "content", "source").mapInPandas(run, "shoe_id bigint, content string, source string, vector array<float>")
    return rows.select("*", F.lit(model_id).alias("model_id"), now.alias("created_at"))
