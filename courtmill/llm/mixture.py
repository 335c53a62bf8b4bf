"""Mixing sources to target weights by hash-seeded Poisson replication.

A document's number of copies inverts a Poisson distribution, cut off at its source's ``max_repeats``, at a
uniform number hashed from its id and the seed, so the draw needs no state and comes out the same after a
lost executor. The number of copies never falls when the distribution's rate rises, so each source's rate
is found by bisection as the one at which the tokens really drawn, not only the expected ones, meet the
source's goal. For that the uniform numbers are put on a grid of ``GRID`` steps, and one aggregation counts
the tokens on each step. The steps at which the copies change are then moved, within one document's
tokens, so that small sources miss their goal by no more than about one document. Copies are put in a
random global order by a range partitioning of a hash.

The total is the largest at which every source that has documents can reach its share within its cap, as
the shares are what is asked for, unless ``total_tokens`` gives it; a source that can't reach its part of a
given total is used as far as the cap allows and the report shows it. Sources without documents give their
share to the others in proportion. Copies of one text within a source count as one document (its smallest
id).

Defined results: null or blank texts and documents of sources without a target are left out; a missing
cap counts as 1, a cap below 1 or a share of 0 or less as an unused source; repeated targets of one
source are added up under the smallest cap; empty tables give an empty mixture; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtmill.session import checkpoint, small

#: A public byte-level BPE vocabulary in the format of the tokenizers library; any file of that format will do.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Steps of the grid of uniform numbers: rows per source that one task solves, at most.
GRID = 16_384
ENCODED_AT_ONCE = 64
SEED = 20_240


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    return loaded


def _text_key(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("mix"), F.reverse(text)).alias("h2")]


def _with_text(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, text) of documents with text whose source is a target."""
    rows = documents.filter(F.btrim("text", F.lit(" \t\r\n")) != "").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return rows.join(small(targets.filter("source is not null").select("source").distinct()), "source", "left_semi")


def with_tokens(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens, h1, h2) of (doc_id, source, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, counts = batch["text"].tolist(), []
            for i in range(0, len(texts), ENCODED_AT_ONCE):
                counts += [len(e) for e in _tokenizer(tokenizer).encode_batch_fast(texts[i : i + ENCODED_AT_ONCE], add_special_tokens=False)]
            out = batch.drop(columns="text")
            out["n_tokens"] = pd.Series(counts, index=batch.index, dtype="int64")
            yield out

    keyed = rows.select("doc_id", "source", *_text_key("text"), "text")
    return keyed.mapInPandas(run, "doc_id bigint, source string, h1 bigint, h2 bigint, n_tokens bigint")


def distinct_documents(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, h1, h2, doc_id, n_tokens): one row per distinct text of a source; only hashes are shuffled."""
    return with_tokens(rows, tokenizer).groupBy("source", "h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))


def poisson_steps(rate: float, cap: int) -> tuple[int, np.ndarray]:
    """(first, cdf): P(copies <= first + i) for the copies below the cap whose probability counts in doubles.

    As many numbers as the distribution is wide, whatever the cap; below ``first`` the probability is nil.
    """
    if rate <= 0.0:
        return 0, np.ones(1)
    spread = 12.0 * math.sqrt(rate) + 40.0
    first, last = max(0, int(rate - spread)), min(cap - 1, int(rate + spread))
    if last < first:
        return cap, np.empty(0)
    k = np.arange(first, last + 1, dtype=np.float64)
    start = first * math.log(rate) - rate - math.lgamma(first + 1)
    logs = start + np.concatenate([[0.0], np.cumsum(math.log(rate) - np.log(k[1:]))])
    return first, np.minimum(1.0, np.cumsum(np.exp(logs)))


def _drawn(rate: float, cap: int, below: np.ndarray) -> int:
    """Tokens drawn at a rate; ``below[s]`` holds the tokens of documents on grid steps under ``s``."""
    first, cdf = poisson_steps(rate, cap)
    total = int(below[-1])
    return first * total + int((total - below[_edges(cdf, len(below) - 1)]).sum())


def _edges(cdf: np.ndarray, grid: int) -> np.ndarray:
    return np.minimum(np.rint(cdf * grid), grid).astype(np.int64)


def solve(below: np.ndarray, cap: int, goal: float) -> tuple[int, list[int]]:
    """(first, edges): a document has ``first`` copies and one more for each edge its grid step is at or above.

    The draw's tokens are the nearest to ``goal`` that a rate of the cut-off Poisson distribution and then
    moving one of its edges along the grid can give.
    """
    total, grid = int(below[-1]), len(below) - 1
    if total <= 0 or goal <= 0:
        return 0, []
    if goal >= cap * total:
        return cap, []
    low, high = 0.0, 1.0
    while _drawn(high, cap, below) < goal and high < 1e15:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _drawn(mid, cap, below) < goal else (low, mid)
    first, cdf = poisson_steps(low, cap)
    edges = _edges(cdf, grid)
    # At the bisected rate what is missing is less than one step of an edge gives; the widest edges take it up.
    missing = goal - (first * total + int((total - below[edges]).sum()))
    for i in np.argsort(-(edges - np.concatenate([[0], edges[:-1]])), kind="stable"):
        floor = edges[i - 1] if i else 0
        at = int(np.searchsorted(below, below[edges[i]] - missing, "left"))
        best = min((s for s in (at - 1, at) if floor <= s <= edges[i]), key=lambda s: abs(missing - (below[edges[i]] - below[s])), default=None)
        if best is not None and abs(missing - (below[edges[i]] - below[best])) < abs(missing):
            missing -= int(below[edges[i]] - below[best])
            edges[i] = best
    return first, [int(e) for e in edges if e < grid]


def _on_grid(doc_id: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(GRID)).cast("int")


def goals(stock: DataFrame, targets: DataFrame, total_tokens: float | str | None = None) -> DataFrame:
    """(source, max_repeats, goal): the tokens each source with documents, a share and a cap is to give.

    ``total_tokens`` "stock" stands for as many tokens as those sources have.
    """
    goal = targets.filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    have = stock.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    able = goal.join(have, "source").filter("tokens > 0 and share > 0 and max_repeats >= 1")
    if total_tokens is None:
        most = F.min(F.col("max_repeats") * F.col("tokens") / F.col("share"))
    else:
        most = (F.sum("tokens") if total_tokens == "stock" else F.lit(float(total_tokens))) / F.sum("share")
    scale = able.agg(most.alias("scale"))  # one row
    return able.crossJoin(F.broadcast(scale)).select("source", "max_repeats", (F.col("share") * F.col("scale")).alias("goal"))


def draws(stock: DataFrame, targets: DataFrame, total_tokens: float | str | None = None, seed: int = SEED) -> DataFrame:
    """(source, first, edges): how often the documents of each source are used; at most GRID rows per task."""
    steps = stock.groupBy("source", _on_grid("doc_id", seed).alias("step")).agg(F.sum("n_tokens").alias("tokens"))
    each = steps.join(goals(stock, targets, total_tokens), "source")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(GRID + 1, dtype=np.int64)
        held[frame["step"].to_numpy() + 1] = frame["tokens"].to_numpy()
        first, edges = solve(np.cumsum(held), int(frame["max_repeats"].iloc[0]), float(frame["goal"].iloc[0]))
        return pd.DataFrame({"source": [frame["source"].iloc[0]], "first": [first], "edges": [edges]})

    return each.groupBy("source").applyInPandas(run, "source string, first bigint, edges array<bigint>")


def used_documents(rows: DataFrame, targets: DataFrame, total_tokens: float | str | None = None, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, h1, h2, n_tokens, copies) of the documents that are used, each with its number of copies."""
    stock = checkpoint(distinct_documents(rows, tokenizer))  # hashes and counts only, so that texts are tokenised once
    drawn = checkpoint(draws(stock, targets, total_tokens, seed))  # a row per target source
    counted = stock.join(small(drawn), "source").withColumn("step", _on_grid("doc_id", seed))
    copies = (F.col("first") + F.size(F.filter("edges", lambda e: F.col("step") >= e))).cast("int")
    return counted.withColumn("copies", copies).filter("copies > 0").select("doc_id", "source", "h1", "h2", "n_tokens", "copies")


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: float | str | None = None, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, copy_no, n_tokens, shuffle_key, text): the mixture, in the order of ``shuffle_key``."""
    rows = _with_text(documents, targets)
    used = used_documents(rows, targets, total_tokens, seed, tokenizer)
    texts = rows.select("doc_id", "source", *_text_key("text"), "text").dropDuplicates(["doc_id", "source", "h1", "h2"])
    each = used.join(texts, ["doc_id", "source", "h1", "h2"]).select("doc_id", "source", "n_tokens", "text", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"))
    keyed = each.select("doc_id", "source", "copy_no", "n_tokens", F.xxhash64(F.lit(seed), F.lit("order"), "doc_id", "copy_no").alias("shuffle_key"), "text")
    return keyed.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")


def report(documents: DataFrame, targets: DataFrame, total_tokens: float | str | None = None, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, target_share, max_repeats, mixed_tokens, mixed_documents, most_repeats, actual_share) of the same draw."""
    used = used_documents(_with_text(documents, targets), targets, total_tokens, seed, tokenizer)
    goal = targets.filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    got = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_documents"), F.max("copies").alias("most_repeats"))
    total = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    joined = goal.join(got, "source", "left").crossJoin(F.broadcast(total)).na.fill(0, ["mixed_tokens", "mixed_documents", "most_repeats"])  # total is one row
    share = F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0))
    return joined.select("source", "target_share", "max_repeats", "mixed_tokens", "mixed_documents", "most_repeats", share.alias("actual_share"))
