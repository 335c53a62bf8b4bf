"""Fetch policies without a network: cache keys, robots rules, retry delays and cached pages."""

from __future__ import annotations

import urllib.robotparser
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: HTTP statuses worth another try.
RETRYABLE = frozenset({429, 500, 502, 503, 504})


def retry_delay(retry_after: str | None, attempt: int, base: float) -> float:
    """Seconds to wait: the server's wish in seconds, at least 1, else doubling from ``base``."""
    try:
        return max(1.0, float(retry_after)) if retry_after is not None else base * 2**attempt
    except ValueError:
        return base * 2**attempt


def worth_retrying(status: Column) -> Column:
    return status.isin(*sorted(RETRYABLE))


def cache_key(url: Column) -> Column:
    """The first 24 hex digits of the URL's SHA-256."""
    return F.substring(F.sha2(url, 256), 1, 24)


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def absolute(base: Column, href: Column) -> Column:
    """A link made absolute against a page's URL: absolute, host-relative, path-relative."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.when(base.rlike(r"^[a-z]+://[^/]+/"), F.regexp_extract(base, r"^(.*/)[^/]*$", 1)).otherwise(F.concat(root, F.lit("/")))
    return F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))


def robots_rules(status: int | None, body: str | None) -> str | None:
    """What a robots answer means: the rules, None for everything allowed, 'deny' for nothing."""
    if status == 200:
        return body or ""
    return "deny" if status is None or status in (401, 403) else None


@lru_cache(maxsize=1_000)
def _rules(body: str) -> urllib.robotparser.RobotFileParser:
    parser = urllib.robotparser.RobotFileParser()
    parser.parse(body.splitlines())
    return parser


def allowed(refs: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """The references (with ``url``) their hosts' rules allow; ``robots`` has ``host, status, body``.

    A host without an answer in ``robots`` is denied.
    """

    @F.pandas_udf("boolean")
    def may(urls: pd.Series, known: pd.Series, statuses: pd.Series, bodies: pd.Series) -> pd.Series:
        def one(url, seen, status, body):
            rules = robots_rules(None if pd.isna(status) else int(status), body) if seen else "deny"
            return rules is None or (rules != "deny" and _rules(rules).can_fetch(agent, url))

        return pd.Series([one(*row) for row in zip(urls, known.fillna(False), statuses, bodies, strict=True)], dtype="boolean")

    rules = robots.dropDuplicates(["host"]).select(F.col("host").alias("rule_host"), F.col("status").alias("rule_status"), F.col("body").alias("rule_body"), F.lit(True).alias("seen"))
    joined = refs.join(rules, host(F.col("url")) == F.col("rule_host"), "left")
    return joined.filter(may("url", "seen", "rule_status", "rule_body")).select(*refs.columns)


def cached(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """References joined to their last good page by source and cache key; ``from_cache`` tells a hit."""
    good = pages.filter((F.col("status") == 200) & F.col("text").isNotNull())
    last = good.groupBy("source", cache_key(F.col("url")).alias("key")).agg(F.max_by(F.struct("text", "fetched_at"), F.struct("fetched_at", "page_id")).alias("page"))
    keyed = refs.withColumn("key", cache_key(F.col("url")))
    return keyed.join(last, ["source", "key"], "left").select(*refs.columns, "key", "page.text", "page.fetched_at", F.col("page").isNotNull().alias("from_cache"))


#: Seconds between two requests to one host, and the most that chance adds.
SPACING, JITTER = 3.0, 1.0


def schedule(refs: DataFrame, spacing: float = SPACING, jitter: float = JITTER, blocks: int = 256) -> DataFrame:
    """Adds ``wait``: seconds after the start at which each reference (with ``url``) may be fetched from its host.

    Two fetches of one host are at least ``spacing`` seconds apart. References are numbered within hashed
    blocks of a host, whose sizes give each block's start, so that a hot host is no single task.
    """
    placed = refs.withColumn("host", host(F.col("url"))).withColumn("block", F.pmod(F.xxhash64("url"), F.lit(blocks)).cast("int"))
    sizes = placed.groupBy("host", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("host").orderBy("block")) - F.col("n")  # at most `blocks` rows a host
    starts = sizes.select("host", "block", before.alias("before"))
    numbered = placed.withColumn("rn", F.row_number().over(Window.partitionBy("host", "block").orderBy("url")))
    chance = F.pmod(F.xxhash64(F.lit("jitter"), "url"), F.lit(10_007)) / F.lit(10_007.0)
    joined = numbered.join(starts, ["host", "block"])
    return joined.select(*refs.columns, "host", ((F.col("before") + F.col("rn") - 1) * (spacing + jitter) + chance * jitter).alias("wait"))


def first_seen(refs: DataFrame, key: str = "url", order: str = "ord") -> DataFrame:
    """One row per URL, the first in order."""
    rest = [c for c in refs.columns if c != key]
    kept = refs.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return kept.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in refs.columns])
