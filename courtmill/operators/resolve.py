"""Entity resolution: records grouped by brand and model key, merged by source priority.

A group of any size is merged by aggregates that combine on the map side: the winner of each field is a
minimum over (priority, ordinal). Only the list columns of a canonical shoe, which are its result, are
gathered per group.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtmill.functions import naming
from courtmill.schemas import MERGEABLE_NAMES, TAGS
from courtmill.session import named, small

NEAR = 0.86
ORIGIN = ("source", "url", "fetched_at")


def union_sources(*tables: DataFrame) -> DataFrame:
    """All sources' records; columns a source lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def keyed(records: DataFrame, brands: dict[str, list[str]] = naming.BRANDS) -> DataFrame:
    """Records with ``brand`` and ``model`` filled in and their ``model_key``."""
    parts = naming.split_brand(F.col("model_raw"), brands)
    found = F.coalesce(F.nullif(F.col("brand"), F.lit("")), parts["brand"])
    brand = F.coalesce(naming.brand(found, brands), found)
    model = F.coalesce(F.nullif(F.col("model"), F.lit("")), parts["model"])
    filled = records.withColumns({"brand": brand, "model": model})
    return filled.withColumn("model_key", naming.model_key(F.col("brand"), F.col("model"), brands))


def unmatched(keyed_records: DataFrame) -> DataFrame:
    return keyed_records.filter(F.col("brand").isNull()).select("ord", "source", "url", "model_raw", F.lit("no recognizable brand").alias("reason"))


def prioritised(records: DataFrame, priority: DataFrame) -> DataFrame:
    """Adds ``priority`` of each record's source from (source, trust_rank); unknown sources come last."""
    ranks = priority.groupBy("source").agg(F.min("trust_rank").alias("priority"))
    return records.join(small(ranks), "source", "left").withColumn("priority", F.coalesce("priority", F.lit(2**31 - 1)))


def _winner(field: str) -> Column:
    value = F.struct(named(field).alias("value"), *ORIGIN)
    return F.min(F.when(named(field).isNotNull(), F.struct("priority", "ord", value.alias("won"))))["won"]


def merged(records: DataFrame, fields: tuple[str, ...] = MERGEABLE_NAMES) -> DataFrame:
    """(brand, model_key, model, n_records, n_sources, <fields>, provenance): single-valued fields.

    ``records`` come from ``keyed`` and ``prioritised``; the first value in order of priority and ordinal wins.
    """
    own = records.filter(F.col("brand").isNotNull())
    first = F.struct("priority", "ord", F.coalesce(F.col("model"), F.col("model_raw")).alias("model"))
    best = own.groupBy("brand", "model_key").agg(F.min(first)["model"].alias("model"), F.count(F.lit(1)).alias("n_records"), F.countDistinct("source").alias("n_sources"), *[_winner(f).alias(f) for f in fields])
    entries = [F.when(named(f).isNotNull(), F.struct(F.lit(f).alias("key"), F.struct(*[named(f)[o].alias(o) for o in ORIGIN]).alias("value"))) for f in fields]
    provenance = F.map_from_entries(F.array_compact(F.array(*entries)))
    return best.select("brand", "model_key", "model", "n_records", "n_sources", *[named(f)["value"].alias(f) for f in fields], provenance.alias("provenance"))


def with_identity(merged_rows: DataFrame) -> DataFrame:
    """Adds ``canonical_id`` and ``version``."""
    return merged_rows.withColumn("canonical_id", naming.slug(F.col("brand"), F.col("model_key"))).withColumn("version", naming.version(F.col("model")))


def gathered(records: DataFrame) -> DataFrame:
    """(brand, model_key, sources, pros, cons, review_text, image_urls, position_tags, playstyle_tags).

    These lists are a canonical shoe's own content, in order of priority and ordinal.
    """
    own = records.filter(F.col("brand").isNotNull())
    lists = ("pros", "cons", "review_text", "image_urls", *TAGS)
    none = F.array().cast("array<string>")
    row = F.struct("priority", "ord", *ORIGIN, *[F.coalesce(named(c), none).alias(c) for c in lists])
    rows = own.groupBy("brand", "model_key").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    noted = lambda c: F.flatten(F.transform("rows", lambda r: F.transform(r[c], lambda t: F.struct(r["source"].alias("source"), t.alias("text")))))
    once = lambda c: F.array_distinct(F.flatten(F.transform("rows", lambda r: r[c])))
    return rows.select(
        "brand",
        "model_key",
        F.transform("rows", lambda r: F.struct(*[r[o].alias(o) for o in ORIGIN])).alias("sources"),
        *[noted(c).alias(c) for c in ("pros", "cons", "review_text")],
        *[once(c).alias(c) for c in ("image_urls", *TAGS)],
    )


def metrics(records: DataFrame) -> DataFrame:
    """(brand, model_key, metrics): each source's scores; its last record with scores wins, nothing is averaged."""
    scored = records.filter(F.col("brand").isNotNull() & (F.size(F.map_keys("scores")) > 0))
    last = scored.groupBy("brand", "model_key", "source").agg(F.max_by("scores", "ord").alias("scores"))
    return last.groupBy("brand", "model_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", F.to_json("scores"))))).alias("metrics"))


def canonical(records: DataFrame, priority: DataFrame, brands: dict[str, list[str]] = naming.BRANDS) -> DataFrame:
    """Canonical shoes of raw records."""
    ready = prioritised(keyed(records, brands), priority)
    keys = ["brand", "model_key"]
    whole = with_identity(merged(ready)).join(gathered(ready), keys).join(metrics(ready), keys, "left")
    empty = F.expr("map()").cast("map<string,string>")
    return whole.withColumn("metrics", F.transform_values(F.coalesce("metrics", empty), lambda _, v: F.from_json(v, "map<string,string>"))).withColumn("affiliate_url", F.lit(None).cast("string"))


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity; the order of its arguments matters."""
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def key_order(records: DataFrame) -> DataFrame:
    """(brand, model_key, first_ord): distinct keys with their first appearance."""
    return records.filter(F.col("brand").isNotNull()).groupBy("brand", "model_key").agg(F.min("ord").alias("first_ord"))


def near_blocks(keys: DataFrame, least: float = NEAR) -> DataFrame:
    """(brand, a, b): pairs of keys that can reach the ratio, a first seen before b.

    The ratio is at least ``least`` only if the keys' bigrams overlap enough, so each key is entered under
    its rarest bigrams only (a prefix filter); pairs that share none of them can't qualify. Keys without a
    bigram meet by equal text only, which distinct keys never have.
    """
    sign = F.array_join(naming.numeric_signature(F.col("model_key")), " ")
    rows = keys.select("brand", "model_key", "first_ord", sign.alias("signature"))
    spots = F.transform(F.sequence(F.lit(1), F.length("model_key") - 1), lambda i: F.substring(F.col("model_key"), i, F.lit(2)))
    grams = rows.filter(F.length("model_key") >= 2).select("*", F.posexplode(spots).alias("at", "gram"))
    # Equal bigrams of one key are told apart by their number, so that overlaps are those of multisets.
    counts = grams.groupBy("brand", "signature", "model_key", "first_ord", "gram").agg(F.count(F.lit(1)).alias("times"))
    each = counts.select("brand", "signature", "model_key", "first_ord", F.explode(F.transform(F.sequence(F.lit(1), F.col("times")), lambda t: F.concat("gram", F.lit("#"), t.cast("string")))).alias("gram"))
    often = each.groupBy("brand", "gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(often, ["brand", "gram"]).groupBy("brand", "signature", "model_key", "first_ord").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    # Characters outside the match: at most (1 - least) of both lengths; each spoils two bigrams of its key.
    length = F.length("model_key")
    longest_other = length * (2 - least) / least
    spoiled = F.floor((1 - least) * (length + longest_other)).cast("int") * 2
    prefix = F.least(F.size("grams"), spoiled + 1)
    entered = ranked.select("brand", "signature", "model_key", "first_ord", F.explode(F.slice("grams", 1, prefix)).alias("g")).select("brand", "signature", "model_key", "first_ord", "g.gram")
    a = entered.select("brand", "signature", "gram", F.col("model_key").alias("a"), F.col("first_ord").alias("ord_a"))
    b = entered.select("brand", "signature", "gram", F.col("model_key").alias("b"), F.col("first_ord").alias("ord_b"))
    size_a, size_b = F.length("a"), F.length("b")
    fits = (F.col("ord_a") < F.col("ord_b")) & (2 * F.least(size_a, size_b) >= least * (size_a + size_b))
    return a.join(b, ["brand", "signature", "gram"]).filter(fits).select("brand", "a", "b").distinct()


def ambiguous(keys: DataFrame, least: float = NEAR) -> DataFrame:
    """(brand, a, b, ratio): pairs of keys of a brand, with the same numbers, that nearly agree."""
    return near_blocks(keys, least).withColumn("ratio", _ratios("a", "b")).filter(F.col("ratio") >= least)


def evidence(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(brand, a, b, which, ord, source, model_raw, url): the records of both keys of each pair."""
    sides = pairs.select("brand", "a", "b", F.explode(F.array(F.struct(F.lit("a").alias("which"), F.col("a").alias("model_key")), F.struct(F.lit("b").alias("which"), F.col("b").alias("model_key")))).alias("side"))
    wanted = sides.select("brand", "a", "b", "side.which", "side.model_key")
    return wanted.join(records.select("brand", "model_key", "ord", "source", "model_raw", "url"), ["brand", "model_key"]).drop("model_key")


def follow_seeds(refs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Listing references whose model key is one of the seeds'; the brand doesn't matter."""
    return refs.join(seeds.select("model_key").distinct(), "model_key", "left_semi")


def in_output_order(canonical_rows: DataFrame) -> DataFrame:
    """Canonical shoes by brand and key, in the order of code points; a range partitioning, no single task."""
    return canonical_rows.orderBy("brand", "model_key")


def pairs_in_output_order(pairs: DataFrame) -> DataFrame:
    """Ambiguous pairs by brand and both keys."""
    return pairs.orderBy("brand", "a", "b")
