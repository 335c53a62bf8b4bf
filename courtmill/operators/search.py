"""Vector search grouped by shoe, tag-overlap fallback, recommendation and explanation.

Distances are ranked on ids only; wide catalogue rows join the few winners. Requests are a stated set of
queries: equal ones are one wish, and wishes go out in checked blocks of at most ``WISHES``, each of which is
compared with all shoes or all chunks in one scan. A batch of rows gives each wish its few best, so nothing
is joined row by row and no pair of a wish and a shoe is ever a row before it is ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtmill.functions import ranking, text, vectors, vocab
from courtmill.operators import browse
from courtmill.operators.browse import Filters
from courtmill.session import checkpoint, small
from courtmill.sources import models

LIMIT = 10
SNIPPETS = 3
OVERFETCH = 4
CHOSEN = 3
PLACES = 6
#: Wishes that go out at once, and that are compared with a batch at once.
WISHES, WISHES_AT_ONCE = 20_000, 256
#: What a request may ask for besides its words and budget.
HARD = ("brand", "outdoor", "playstyle_tag", "cut", "width", "position")


def nearest(index: DataFrame, query: Sequence[float], k: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """(key, distance): the ``k`` nearest vectors; ties go to the smaller key."""
    distance = F.round(vectors.cosine_distance(F.col(vector), query), PLACES)
    scored = index.select(key, distance.alias("distance")).filter(F.col("distance").isNotNull() & ~F.isnan("distance"))
    return scored.orderBy("distance", key).limit(k)


def hits(index: DataFrame, catalog: DataFrame, query: Sequence[float], model_id: str, filters: Filters = Filters(), limit: int = LIMIT, snippets: int = SNIPPETS) -> DataFrame:
    """(shoe_id, id, content, source, distance, rn): the nearest chunks of matching shoes.

    As in an index search, ``limit * snippets * OVERFETCH`` chunks are cut first; each shoe then keeps its
    best ``snippets`` of those, so it may have fewer.
    """
    shoes = browse.matching(catalog, filters).select(F.col("id").alias("shoe_id"))
    distance = F.round(vectors.cosine_distance(F.col("vector"), query), PLACES).alias("distance")
    chunks = index.filter(F.col("model_id") == model_id).join(shoes, "shoe_id", "left_semi").select("shoe_id", "id", distance)
    window = chunks.filter(F.col("distance").isNotNull() & ~F.isnan("distance")).orderBy("distance", "id").limit(limit * snippets * OVERFETCH)
    rank = F.row_number().over(Window.partitionBy("shoe_id").orderBy("distance", "id"))
    kept = window.withColumn("rn", rank).filter(F.col("rn") <= snippets)
    return kept.join(index.select("id", "content", "source"), "id")


def candidates(found: DataFrame, catalog: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The best ``limit`` shoes of ``hits`` with their snippets and similarity, nearest first."""
    best = found.groupBy("shoe_id").agg(
        F.min("distance").alias("distance"),
        F.transform(F.sort_array(F.collect_list(F.struct("rn", F.col("content").alias("text"), "source"))), lambda s: F.struct(s["text"].alias("text"), s["source"].alias("source"))).alias("snippets"),
    )  # at most `snippets` rows a shoe
    top = best.orderBy("distance", "shoe_id").limit(limit).withColumn("similarity", vectors.similarity(F.col("distance")))
    shoes = catalog.select(F.col("id").alias("shoe_id"), "canonical_id", "brand", "name", "price", "currency", "image_url", "affiliate_url", "specs")
    return top.join(shoes, "shoe_id").orderBy("distance", "shoe_id")


def overlap(catalog_tags: Column, wanted: Column) -> Column:
    return F.size(F.array_intersect(catalog_tags, wanted))


def shoe_tags(specs: str = "specs") -> Column:
    """The union of a shoe's playstyle and position tags."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(f"{specs}.playstyle_tags", none), F.coalesce(f"{specs}.position_tags", none))


def normal(requests: DataFrame, *more: str) -> DataFrame:
    """Requests with all their columns, and ``more``; words are trimmed, and a filter that is empty asks nothing."""
    has = set(requests.columns)
    words = [(text.trimmed(F.col(c).cast("string")) if c in has else F.lit(None).cast("string")).alias(c) for c in ("playstyle", "aesthetic")]
    hard = [(F.nullif(F.col(c).cast("string"), F.lit("")) if c in has else F.lit(None).cast("string")).alias(c) for c in HARD]
    budget = (F.col("budget") if "budget" in has else F.lit(None)).cast("double").alias("budget")
    return requests.select("request_id", *words, budget, *hard, *more)


def _attributes(catalog: DataFrame) -> DataFrame:
    """What a shoe is filtered and ranked by."""
    return catalog.select(
        F.col("id").alias("shoe_id"),
        F.col("price").cast("double").alias("price"),
        F.lower("brand").alias("brand"),
        F.col("specs.outdoor_suitability").alias("outdoor"),
        F.col("specs.cut_height").alias("cut"),
        F.col("specs.width_fit").alias("width"),
        F.col("specs.playstyle_tags").alias("playstyle_tag"),
        F.col("specs.position_tags").alias("position"),
        shoe_tags().alias("tags"),
    )


def _codes(wanted: pd.Series, held: pd.Series) -> np.ndarray:
    """For each wish and row whether the wished value is held; a null wish is met by all."""
    codes, _ = pd.factorize(pd.concat([wanted, held], ignore_index=True))
    mine, theirs = codes[: len(wanted)], codes[len(wanted) :]
    return (mine[:, None] == theirs[None, :]) | (mine[:, None] == -1)


def _members(wanted: list[set], held: pd.Series) -> np.ndarray:
    """How many of each wish's values are in each row's list."""
    place = {v: i for i, v in enumerate(sorted(set().union(*wanted)))} if wanted else {}
    mine = np.zeros((len(wanted), len(place)), dtype=np.float32)
    for i, values in enumerate(wanted):
        mine[i, [place[v] for v in values]] = 1
    theirs = np.zeros((len(place), len(held)), dtype=np.float32)
    for j, values in enumerate(held):
        for v in values if values is not None else ():
            if v in place:
                theirs[place[v], j] = 1
    return (mine @ theirs).astype(np.int64)


def _meets(wishes: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
    """For each wish and row whether the row meets the wish's budget and filters; no price meets no budget."""
    budget, price = wishes["budget"].to_numpy(dtype=float)[:, None], rows["price"].to_numpy(dtype=float)[None, :]
    ok = np.isnan(budget) | (price <= budget)
    for c in ("outdoor", "cut", "width"):
        ok &= _codes(wishes[c], rows[c])
    ok &= _codes(wishes["brand"].str.lower(), rows["brand"])
    for c in ("playstyle_tag", "position"):
        asked = [{v} if isinstance(v, str) else set() for v in wishes[c]]
        ok &= _members(asked, rows[c]) == np.array([[len(a)] for a in asked])
    return ok


def _smallest(keys: list[np.ndarray], ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Wish and row of each wish's first ``k`` rows in order of the keys, of those that are ``ok``."""
    order = np.lexsort([*reversed(keys), ~ok], axis=1)[:, :k]
    good = np.take_along_axis(ok, order, 1)
    wish = np.broadcast_to(np.arange(len(ok))[:, None], order.shape)
    return wish[good], order[good]


def _in_blocks(wishes: DataFrame, plan: Callable[[pd.DataFrame], DataFrame]) -> DataFrame | None:
    """The union of ``plan`` over blocks of wishes (with ``wish``, a hash of each); at most WISHES leave at a time."""
    parts = -(-wishes.count() // WISHES)
    out = None
    for part in range(parts):
        block = wishes.filter(F.pmod("wish", F.lit(parts)) == part).orderBy("wish").toPandas()  # about WISHES rows
        done = plan(block)
        out = done if out is None else out.unionByName(done)
    return out


def by_tags(requests: DataFrame, catalog: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(request_id, shoe_id, overlap, rn): for each request the shoes that meet it, by tags shared with its words."""
    asked = normal(requests).withColumn("wanted", F.array_sort(vocab.tags_in(F.coalesce("playstyle", F.lit("")))))
    asked = asked.withColumn("wish", F.xxhash64("budget", *[F.coalesce(c, F.lit("\u0000")) for c in HARD], F.array_join("wanted", ",")))
    shoes = _attributes(catalog)

    def plan(block: pd.DataFrame) -> DataFrame:
        shared = catalog.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for at in range(0, len(shared.value), WISHES_AT_ONCE):
                    part = shared.value.iloc[at : at + WISHES_AT_ONCE]
                    common = _members([set(w) for w in part["wanted"]], rows["tags"])
                    ids = np.broadcast_to(rows["shoe_id"].to_numpy(), common.shape)
                    wish, row = _smallest([-common, ids], _meets(part, rows), limit)
                    yield pd.DataFrame({"wish": part["wish"].to_numpy()[wish], "shoe_id": ids[wish, row], "overlap": common[wish, row].astype(np.int32)})

        return shoes.mapInPandas(run, "wish bigint, shoe_id bigint, overlap int")

    found = _in_blocks(asked.dropDuplicates(["wish"]).select("wish", "budget", *HARD, "wanted"), plan)
    if found is None:
        return catalog.sparkSession.createDataFrame([], f"request_id {requests.schema['request_id'].dataType.simpleString()}, shoe_id bigint, overlap int, rn int")
    rank = F.row_number().over(Window.partitionBy("wish").orderBy(F.desc("overlap"), "shoe_id"))
    best = found.withColumn("rn", rank).filter(F.col("rn") <= limit)
    return asked.select("request_id", "wish").join(best, "wish").select("request_id", "shoe_id", "overlap", "rn")


def with_vectors(requests: DataFrame, embedder: models.Embedder) -> DataFrame:
    """Requests that have words, with ``vector``; null where the model failed. Each text is asked for once."""
    worded = normal(requests).filter((F.coalesce("playstyle", F.lit("")) != "") | (F.coalesce("aesthetic", F.lit("")) != ""))
    asked = worded.withColumn("said", text.query_text(F.coalesce("playstyle", F.lit("")), F.coalesce("aesthetic", F.lit(""))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                batch["vector"] = models.embedded(embedder, batch["said"].tolist())
            except models.ModelError:
                batch["vector"] = None
            yield batch

    made = asked.select("said").distinct().mapInPandas(run, "said string, vector array<double>")
    return asked.join(checkpoint(made), "said").drop("said")  # a row per different text


def retrieve(asked: DataFrame, catalog: DataFrame, index: DataFrame, model_id: str, limit: int = LIMIT, snippets: int = SNIPPETS) -> DataFrame:
    """(request_id, shoe_id, id, distance, rn): for each request the nearest chunks of the shoes that meet it.

    ``asked`` has ``request_id``, ``vector`` and what else ``normal`` knows. As in an index search,
    ``limit * snippets * OVERFETCH`` chunks a request are cut first; each shoe keeps its best ``snippets``.
    """
    k = limit * snippets * OVERFETCH
    whole = normal(asked, "vector").filter(F.size("vector") > 0)
    keyed = whole.withColumn("wish", F.xxhash64("budget", *[F.coalesce(c, F.lit("\u0000")) for c in HARD], F.col("vector").cast("array<double>")))
    chunks = index.filter(F.col("model_id") == model_id).select("shoe_id", "id", "vector").join(small(_attributes(catalog).drop("tags")), "shoe_id")

    def plan(block: pd.DataFrame) -> DataFrame:
        shared = catalog.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for width, rows in batch.groupby(batch["vector"].map(lambda v: len(v) if v is not None else 0), sort=False):
                    mine = shared.value[shared.value["vector"].map(len) == width]
                    held = np.stack(rows["vector"].to_numpy()).astype(np.float64) if width and len(mine) else None
                    for at in range(0, len(mine) if held is not None else 0, WISHES_AT_ONCE):
                        part = mine.iloc[at : at + WISHES_AT_ONCE]
                        query = np.stack(part["vector"].to_numpy()).astype(np.float64)
                        with np.errstate(all="ignore"):
                            distance = np.round(1.0 - query @ held.T / np.linalg.norm(query, axis=1)[:, None] / np.linalg.norm(held, axis=1)[None, :], PLACES) + 0.0
                        ids = np.broadcast_to(rows["id"].to_numpy(), distance.shape)
                        wish, row = _smallest([distance, ids], np.isfinite(distance) & _meets(part, rows), k)
                        yield pd.DataFrame({"wish": part["wish"].to_numpy()[wish], "shoe_id": rows["shoe_id"].to_numpy()[row], "id": ids[wish, row], "distance": distance[wish, row]})

        return chunks.mapInPandas(run, "wish bigint, shoe_id bigint, id bigint, distance double")

    found = _in_blocks(keyed.dropDuplicates(["wish"]).select("wish", "budget", *HARD, "vector"), plan)
    if found is None:
        return catalog.sparkSession.createDataFrame([], f"request_id {asked.schema['request_id'].dataType.simpleString()}, shoe_id bigint, id bigint, distance double, rn int")
    cut = found.withColumn("n", F.row_number().over(Window.partitionBy("wish").orderBy("distance", "id"))).filter(F.col("n") <= k).drop("n")
    kept = cut.withColumn("rn", F.row_number().over(Window.partitionBy("wish", "shoe_id").orderBy("distance", "id"))).filter(F.col("rn") <= snippets)
    return keyed.select("request_id", "wish").join(kept, "wish").select("request_id", "shoe_id", "id", "distance", "rn")


def retrieved_candidates(found: DataFrame, index: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(request_id, shoe_id, distance, similarity, snippets): the best ``limit`` shoes of each request of ``retrieve``."""
    best = found.groupBy("request_id", "shoe_id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("distance", "shoe_id"))
    top = best.withColumn("place", rank).filter(F.col("place") <= limit).drop("place")
    notes = found.join(top.select("request_id", "shoe_id"), ["request_id", "shoe_id"]).join(index.select("id", "content", "source"), "id")
    gathered = notes.groupBy("request_id", "shoe_id").agg(F.sort_array(F.collect_list(F.struct("rn", F.col("content").alias("text"), "source"))).alias("noted"))  # at most `snippets` each
    told = gathered.select("request_id", "shoe_id", F.transform("noted", lambda s: F.struct(s["text"].alias("text"), s["source"].alias("source"))).alias("snippets"))
    return top.join(told, ["request_id", "shoe_id"]).withColumn("similarity", vectors.similarity(F.col("distance")))


def tie_groups(ranked: DataFrame, key: str = "rank_key", order: str = "shoe_id", by: str = "request_id") -> DataFrame:
    """Adds ``tie_group``, ``group_size`` and ``before``: the place of each group of equal keys."""
    w = Window.partitionBy(by).orderBy(F.desc(key))
    each = ranked.withColumn("tie_group", F.dense_rank().over(w)).withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy(by, key)))
    return each.withColumn("before", F.rank().over(w) - 1)


def choose(ranked: DataFrame, n: int = CHOSEN, by: str = "request_id", kind: str = "bigint") -> DataFrame:
    """(request_id, shoe_id, place): ``n`` shoes a request, the last group of equals sampled by ``seed``.

    ``ranked`` has ``request_id, seed, shoe_id, rank_key`` with at most LIMIT rows a request.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        chosen = ranking.pick(list(zip(frame["rank_key"], frame["shoe_id"], strict=True)), n, int(frame["seed"].iloc[0]))
        return pd.DataFrame({by: frame[by].iloc[0], "shoe_id": chosen, "place": range(1, len(chosen) + 1)})

    return ranked.select(by, "seed", "shoe_id", "rank_key").groupBy(by).applyInPandas(one, f"{by} {kind}, shoe_id bigint, place int")


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests that ask for something: some words or a filter that isn't empty; a budget of 0 counts."""
    said = [F.btrim(F.coalesce(c, F.lit(""))) != "" for c in ("playstyle", "aesthetic")]
    picked = [F.coalesce(c, F.lit("")) != "" for c in ("brand", "outdoor", "playstyle_tag", "cut", "width", "position") if c in requests.columns]
    ok = F.col("budget").isNotNull()
    for c in [*said, *picked]:
        ok = ok | c
    return requests.filter(ok)


def ranked_candidates(requests: DataFrame, catalog: DataFrame, index: DataFrame | None = None, embedder: models.Embedder | None = None, model_id: str = "", limit: int = LIMIT) -> DataFrame:
    """(request_id, shoe_id, similarity, overlap, snippets): found by vectors, or by tags where that finds nothing."""
    asked = valid_requests(requests)
    kind = "array<struct<text:string,source:string>>"
    found = None
    if index is not None and embedder is not None:
        hits_ = retrieve(with_vectors(asked, embedder), catalog, index, model_id, limit)
        found = checkpoint(retrieved_candidates(hits_, index, limit).select("request_id", "shoe_id", "similarity", F.lit(None).cast("int").alias("overlap"), "snippets"))  # at most `limit` rows a request
    left_out = asked if found is None else asked.join(found.select("request_id").distinct(), "request_id", "left_anti")
    tagged = by_tags(left_out, catalog, limit).select("request_id", "shoe_id", F.lit(None).cast("double").alias("similarity"), "overlap", F.lit(None).cast(kind).alias("snippets"))
    return tagged if found is None else found.unionByName(tagged)


def recommend(requests: DataFrame, catalog: DataFrame, index: DataFrame | None = None, embedder: models.Embedder | None = None, model_id: str = "", model: models.LanguageModel | None = None, n: int = CHOSEN) -> DataFrame:
    """Recommendations of a batch of requests, each with its explanation.

    Requests with words are searched by vector in one scan of the index; those without words, or for which
    the model or the search gives nothing, get the tag ranking. All eight filters hold in both. Where a
    language ``model`` is given its cards replace the templates' of every request it answers well.
    """
    asked = normal(valid_requests(requests))
    whole = {c: (F.col(c) if c in requests.columns else F.lit(None).cast("double" if c == "budget" else "string")) for c in ranking.SEED_FIELDS}
    seeded = valid_requests(requests).select("request_id", ranking.request_seed(**whole).alias("seed"))
    found = checkpoint(ranked_candidates(requests, catalog, index, embedder, model_id))  # at most LIMIT rows a request; read twice
    ranked = found.withColumn("rank_key", ranking.primary_key(F.col("similarity"), F.col("overlap"))).join(seeded, "request_id")
    picked = choose(ranked, n, kind=requests.schema["request_id"].dataType.simpleString())
    shoes = catalog.select(F.col("id").alias("shoe_id"), "brand", "name", "price", "image_url", "affiliate_url", "specs")
    wide = picked.join(found, ["request_id", "shoe_id"]).join(asked.select("request_id", "playstyle", "aesthetic"), "request_id").join(shoes, "shoe_id")
    best = F.get("snippets", F.lit(0))
    cards = wide.withColumns(
        {
            "chips": text.spec_chips("specs"),
            "explanation": text.explanation(F.col("brand"), F.col("name"), "specs", F.coalesce("playstyle", F.lit("")), best["text"], best["source"]),
        }
    )
    if model is not None:
        cards = _by_model(cards, model)
    return cards.select("request_id", "place", "shoe_id", "brand", F.col("name").alias("model"), "price", "image_url", "affiliate_url", "similarity", F.col("chips").alias("specs"), "explanation")


def prompts(cards: DataFrame) -> DataFrame:
    """(request_id, prompt): the profile and the evidence of a request's candidates, in their places."""
    block = text.prompt_block(F.col("place"), F.col("brand"), F.col("name"), F.col("price"), F.col("specs"), F.col("similarity"), F.coalesce("snippets", F.expr("array()").cast("array<struct<text:string,source:string>>")))
    blocks = cards.groupBy("request_id", "playstyle", "aesthetic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", block.alias("block")))), lambda b: b["block"]), "\n").alias("blocks"))  # at most CHOSEN each
    return blocks.select("request_id", text.user_prompt(F.col("playstyle"), F.col("aesthetic"), F.col("blocks")).alias("prompt"))


def _by_model(cards: DataFrame, model: models.LanguageModel) -> DataFrame:
    """The cards with the model's words; a request that it fails or answers badly keeps the template's."""
    asked = prompts(cards)
    kind = asked.schema["request_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["answer"] = [models.answered(model, p) for p in batch["prompt"]]
            yield batch[["request_id", "answer"]]

    answers = asked.mapInPandas(run, f"request_id {kind}, answer string").filter("answer is not null")
    made = cards_of_model(cards.select("request_id", "place", "shoe_id"), answers).select("request_id", "place", F.col("specs").alias("made_chips"), F.col("explanation").alias("made"))
    return cards.join(made, ["request_id", "place"], "left").withColumns({"chips": F.coalesce("made_chips", "chips"), "explanation": F.coalesce("made", "explanation")})


def cards_of_model(candidates_df: DataFrame, answers: DataFrame) -> DataFrame:
    """A language model's cards joined to the candidates by position.

    ``candidates_df`` has ``request_id, place, shoe_id``; ``answers`` has ``request_id, answer`` (JSON). A
    request whose answer is unreadable, has another number of cards or an empty explanation gives no row,
    so that its template cards stand.
    """
    shape = "struct<cards:array<struct<specs:array<string>,explanation:string>>>"
    cards = answers.select("request_id", F.from_json("answer", shape)["cards"].alias("cards"))
    counted = candidates_df.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    fine = cards.join(counted, "request_id").filter((F.size("cards") == F.col("n")) & F.forall("cards", lambda c: F.coalesce(text.one_line(c["explanation"]), F.lit("")) != ""))
    each = fine.select("request_id", F.posexplode("cards").alias("pos", "card")).withColumn("place", F.col("pos") + 1)
    chips = F.slice(F.filter(F.transform("card.specs", text.trimmed), lambda s: s != ""), 1, text.MOST_CHIPS)
    made = each.select("request_id", "place", F.coalesce(chips, F.array().cast("array<string>")).alias("specs"), text.shortened(F.col("card.explanation"), 400).alias("explanation"))
    return candidates_df.join(made, ["request_id", "place"])


def podium(cards: DataFrame) -> DataFrame:
    """Adds ``shown_at``: the first of three stands in the middle, the second to its left."""
    return cards.withColumn("shown_at", F.when(F.col("place") == 1, 2).when(F.col("place") == 2, 1).otherwise(F.col("place")))
