"""The registered queries of the core operators; each reads its whole tables under a scale-factor folder."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtmill.functions import naming, ranking, text, units, vectors, vocab
from courtmill.operators import browse, chunks, report, resolve, search, upsert
from courtmill.operators.browse import Filters
from courtmill.schemas import MERGEABLE, SPEC_FIELDS, TAGS
from courtmill.sources import html, http, models, sites
from courtmill.streaming import feedback
from courtmill.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FILTERS = Filters(brand="veltrix", budget_max=Decimal("170.00"))
MODEL = "hoopvec-m1"
#: The tests' own brands, in the form of the fixed table.
OWN_BRANDS = {
    "Veltrix": ["veltrix", "vlx"],
    "Kordane": ["kordane"],
    "Norvica": ["norvica"],
    "Haldane Court": ["haldane court", "haldane"],
    "Port Ember": ["port ember"],
    "Jun-Tai": ["jun-tai", "jun tai"],
}
#: Requests of the recommendation queries: (request_id, playstyle, aesthetic, budget, brand, outdoor, playstyle_tag, cut, width, position).
REQUESTS = [
    (1, "shifty guard who defends", "", 180.0, None, None, None, None, None, None),
    (2, "post scorer, big man", "clean white", None, None, None, None, "mid", None, None),
    (3, "all-around wing", "", 120.0, "VELTRIX", None, None, None, None, None),
    (4, "", "retro", 90.0, None, "good", None, None, None, ""),
    (5, "  ", "", None, None, None, None, None, None, None),
    (6, None, None, None, None, None, "slasher", "low", "standard", "guard"),
]
REQUEST = "request_id bigint, playstyle string, aesthetic string, budget double, brand string, outdoor string, playstyle_tag string, cut string, width string, position string"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def browse_page(spark, d):
    rows = browse.page(table(spark, d, "shoes"), FILTERS, limit=20, offset=5)
    return rows.select("id", "brand", "name", F.col("price").cast("double").alias("price"))


@query
def browse_total(spark, d):
    return browse.total(table(spark, d, "shoes"), FILTERS)


@query
def browse_filters(spark, d):
    f = Filters(outdoor="good", cut="low", width="standard", playstyle="slasher", position="guard", budget_min=Decimal("80.00"))
    return browse.matching(table(spark, d, "shoes"), f).select("id", "brand", "name")


@query
def enum_filter(spark, d):
    rows = table(spark, d, "shoes").filter((F.col("specs.cut_height") == "mid") & (F.col("specs.width_fit") == "wide"))
    return rows.select("id", "name")


@query
def tag_contains(spark, d):
    return table(spark, d, "shoes").filter(F.array_contains("specs.playstyle_tags", "shooter")).select("id")


@query
def json_scalar_filter(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").filter(k == "7").select("event_id", "user_id", k.alias("k"))


@query
def point_lookup(spark, d):
    return browse.by_id(table(spark, d, "shoes"), 7).select("id", "canonical_id", "name")


@query
def shoes_of_ids(spark, d):
    ids = table(spark, d, "chunk_embedding").filter("model_id = 'hoopvec-s0'").select("shoe_id")
    return browse.of_ids(table(spark, d, "shoes"), ids).select("id", "name")


@query
def dearest_first(spark, d):
    rows = browse.dearest_first(table(spark, d, "shoes"), Filters(brand="kordane"))
    return rows.select("id", F.col("price").cast("double").alias("price"))


@query
def catalog_summary(spark, d):
    rows = browse.summary(table(spark, d, "shoes"))
    rows = rows.withColumn("release_year", F.col("release_year").cast("double"))
    return rows.select(*[c for c in rows.columns if not c.endswith("_tags")], F.array_join("position_tags", ",").alias("positions"), F.array_join("playstyle_tags", ",").alias("playstyles"))


@query
def catalog_detail(spark, d):
    return browse.detail(table(spark, d, "shoes")).select("id", "name", "source_url", F.col("specs.traction_pattern").alias("traction"), F.size("extra_metadata.sources").alias("n_sources"), F.col("updated_at").cast("string").alias("updated_at"))


@query
def catalog_columns(spark, d):
    rows = browse.catalog_columns(table(spark, d, "canonical_shoe"))
    return rows.select("canonical_id", "brand", "name", F.col("price").cast("double").alias("price"), "image_url", "source_url", F.col("specs.version").alias("version"), F.size("extra_metadata.pros").alias("n_pros"))


def _query_vector(spark: SparkSession, d: str, name: str, key: str, vector: str, where: str) -> list[float]:
    row = table(spark, d, name).filter(where).filter(f"{vector} is not null").orderBy(key).select(vector).first()  # one row
    return list(row[0]) if row else [1.0]


@query
def vector_topk(spark, d):
    q = _query_vector(spark, d, "embeddings", "vec_id", "embedding", "vec_id >= 0")
    rows = search.nearest(table(spark, d, "embeddings"), q, 25, "vec_id", "embedding")
    return rows.select("vec_id", (F.col("distance") + 0.0).alias("distance"), F.round(vectors.similarity(F.col("distance")), 6).alias("similarity"))


@query
def vector_entity_search(spark, d):
    q = _query_vector(spark, d, "chunk_embedding", "id", "vector", f"model_id = '{MODEL}' and exists(vector, x -> x != 0)")
    rows = search.hits(table(spark, d, "chunk_embedding"), table(spark, d, "shoes"), q, MODEL, Filters.of_request(budget=Decimal("200.00")))
    return rows.select("shoe_id", "id", "source", (F.col("distance") + 0.0).alias("distance"), "rn")


@query
def vector_candidates(spark, d):
    q = _query_vector(spark, d, "chunk_embedding", "id", "vector", f"model_id = '{MODEL}' and exists(vector, x -> x != 0)")
    catalog = table(spark, d, "shoes")
    rows = search.candidates(search.hits(table(spark, d, "chunk_embedding"), catalog, q, MODEL, Filters.of_request(budget=Decimal("200.00"))), catalog)
    return rows.select("shoe_id", "brand", "name", (F.col("distance") + 0.0).alias("distance"), F.round("similarity", 6).alias("similarity"), F.size("snippets").alias("n_snippets"), F.get("snippets", F.lit(0))["source"].alias("first_source"))


def _requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUESTS, REQUEST)


@query
def fallback_rank(spark, d):
    return search.by_tags(_requests(spark), table(spark, d, "shoes"))


@query
def request_validation(spark, d):
    rows = table(spark, d, "source_record")
    asked = rows.select(F.col("ord").alias("request_id"), F.col("cushioning_tech").alias("playstyle"), F.col("traction_pattern").alias("aesthetic"), F.col("drop_mm").alias("budget"), F.col("cut_height").alias("cut"))
    return search.valid_requests(asked).select("request_id")


@query
def request_seed(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("event_type").alias("playstyle"), F.col("props").alias("aesthetic"), F.col("value").alias("budget"))
    none = F.lit(None).cast("string")
    return rows.select("request_id", ranking.request_seed(**({c: none for c in ranking.SEED_FIELDS} | {c: F.col(c) for c in ("playstyle", "aesthetic", "budget")})).alias("seed"))


def _asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    """One request per 50th vector of the index, asking for what is like it, some with filters."""
    rows = table(spark, d, "chunk_embedding").filter((F.col("model_id") == MODEL) & (F.col("id") % 50 == 0) & F.exists("vector", lambda x: x != 0))
    return rows.select(
        F.col("id").alias("request_id"),
        "vector",
        F.when(F.col("id") % 100 == 0, F.lit(150.0)).alias("budget"),
        F.when(F.col("id") % 150 == 0, "low").when(F.col("id") % 150 == 50, "").alias("cut"),
        F.when(F.col("id") % 250 == 0, "Kordane").alias("brand"),
        F.when(F.col("id") % 350 == 0, "guard").alias("position"),
    )


@query
def retrieve_hits(spark, d):
    return search.retrieve(_asked_vectors(spark, d), table(spark, d, "shoes"), table(spark, d, "chunk_embedding"), MODEL)


@query
def retrieve_candidates(spark, d):
    index = table(spark, d, "chunk_embedding")
    found = search.retrieve(_asked_vectors(spark, d), table(spark, d, "shoes"), index, MODEL)
    rows = search.retrieved_candidates(found, index)
    return rows.select("request_id", "shoe_id", "distance", F.round("similarity", 6).alias("similarity"), F.array_join(F.transform("snippets", lambda s: F.coalesce(s["source"], F.lit("-"))), ",").alias("sources"))


@query
def topn_tie_groups(spark, d):
    ranked = search.by_tags(_requests(spark), table(spark, d, "shoes"), 20).withColumn("rank_key", ranking.primary_key(F.lit(None).cast("double"), F.col("overlap")))
    return search.tie_groups(ranked).select("request_id", "shoe_id", "rank_key", "tie_group", "group_size", "before")


@query
def topn_seeded_sample(spark, d):
    ranked = search.by_tags(_requests(spark), table(spark, d, "shoes")).withColumn("rank_key", ranking.primary_key(F.lit(None).cast("double"), F.col("overlap")))
    seeds = _requests(spark).select("request_id", ranking.request_seed(**{c: F.col(c) for c in ranking.SEED_FIELDS}).alias("seed"))
    return search.choose(ranked.join(seeds, "request_id"))


def _word_index(spark: SparkSession, d: str) -> DataFrame:
    """The chunks under vectors of the offline embedder."""
    rows = table(spark, d, "chunk").filter(F.col("content").isNotNull())
    made = chunks.embedded(rows, models.hash_embedder(), "words", F.lit("2027-01-01 00:00:00").cast("timestamp"))
    return made.withColumn("id", F.xxhash64("shoe_id", "content", F.coalesce("source", F.lit(""))))


@query
def ranked_candidates(spark, d):
    rows = search.ranked_candidates(_requests(spark), table(spark, d, "shoes"), _word_index(spark, d), models.hash_embedder(), "words")
    return rows.select("request_id", "shoe_id", F.round("similarity", 6).alias("similarity"), "overlap", F.size("snippets").alias("n_snippets"))


@query
def recommendations(spark, d):
    rows = search.recommend(_requests(spark), table(spark, d, "shoes"), _word_index(spark, d), models.hash_embedder(), "words")
    return rows.withColumn("specs", F.array_join("specs", "; ")).withColumns({c: F.col(c).cast("double") for c in ("price", "similarity")})


@query
def recommendations_by_tags(spark, d):
    rows = search.recommend(_requests(spark), table(spark, d, "shoes"))
    return rows.withColumn("specs", F.array_join("specs", "; ")).withColumn("price", F.col("price").cast("double"))


@query
def template_card(spark, d):
    shoes = table(spark, d, "shoes")
    why = text.explanation(F.col("brand"), F.col("name"), "specs", F.lit("slasher"), F.get("extra_metadata.pros", F.lit(0))["text"], F.get("extra_metadata.pros", F.lit(0))["source"])
    return shoes.select("id", F.array_join(text.spec_chips("specs"), "; ").alias("chips"), why.alias("explanation"))


@query
def query_text(spark, d):
    return table(spark, d, "source_record").select("ord", text.query_text(F.col("cut_height"), F.col("cushioning_tech")).alias("query_text"))


@query
def request_words(spark, d):
    return table(spark, d, "source_record").select("ord", text.request_words(F.col("cut_height"), F.col("playstyle_tags"), F.col("cushioning_tech")).alias("playstyle"))


@query
def prompt_blocks(spark, d):
    notes = F.transform(F.coalesce("extra_metadata.pros", F.array().cast("array<struct<source:string,text:string>>")), lambda p: F.struct(p["text"].alias("text"), p["source"].alias("source")))
    block = text.prompt_block(F.lit(1), F.col("brand"), F.col("name"), F.col("price"), F.struct("specs.cut_height"), F.lit(None).cast("double"), notes)
    return table(spark, d, "shoes").select("id", block.alias("block"))


@query
def unit_parse(spark, d):
    t = F.col("model_raw")
    w = units.weight(t)
    return table(spark, d, "listing_record").select("ord", w["oz"].alias("oz"), w["g"].alias("g"), units.millimetres(t).alias("mm"), units.usd_cents(t).cast("double").alias("cents"), units.budget(t).alias("budget"))


@query
def weights_of_records(spark, d):
    said = F.concat(F.col("weight_oz").cast("string"), F.lit(" oz"))
    return table(spark, d, "source_record").select("ord", units.weight(said)["g"].alias("g"), units.price_of_cents(F.col("msrp_usd_cents")).cast("double").alias("price"))


@query
def enum_map(spark, d):
    t = F.col("t")
    fields = ("cut_height", "width_fit", "length_fit", "outdoor_suitability", "cushioning_tech", "traction_pattern")
    said = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("t")) for f in fields])).alias("s")
    rows = table(spark, d, "source_record").select("ord", said).select("ord", "s.*")
    return rows.select("ord", "field", vocab.cut_height(t).alias("cut"), vocab.width_fit(t).alias("width"), vocab.length_fit(t).alias("length"), vocab.outdoor(t).alias("outdoor"), vocab.surface(t).alias("surface"))


@query
def tag_map(spark, d):
    t = F.array_join(F.concat(F.coalesce("position_tags", F.array().cast("array<string>")), F.coalesce("playstyle_tags", F.array().cast("array<string>"))), " and ")
    join = lambda c: F.array_join(c, ",")
    rows = table(spark, d, "source_record").select("ord", t.alias("t"))
    return rows.select("ord", join(vocab.positions(F.col("t"))).alias("positions"), join(vocab.playstyles(F.col("t"))).alias("playstyles"))


@query
def tags_in_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(vocab.tags_in(F.col("text")), ",").alias("tags"))


@query
def score_thresholds(spark, d):
    score = F.explode(F.map_entries("scores")).alias("s")
    rows = table(spark, d, "source_record").select("ord", score).select("ord", "s.key", "s.value")
    number = F.regexp_replace("value", "%", "").try_cast("double")
    return rows.select("ord", "key", vocab.outdoor_of_score(number).alias("by_score"), vocab.outdoor_of_percent(F.when(F.col("value").endswith("%"), number)).alias("by_percent"))


@query
def brand_split(spark, d):
    parts = naming.split_brand(F.col("model_raw"), OWN_BRANDS)
    return table(spark, d, "source_record").select("ord", parts["brand"].alias("brand"), parts["model"].alias("model"))


@query
def brand_normalized(spark, d):
    return table(spark, d, "source_record").select("ord", naming.brand(F.col("brand"), OWN_BRANDS).alias("brand"))


@query
def model_key(spark, d):
    parts = naming.split_brand(F.col("model_raw"))
    signature = F.array_join(naming.numeric_signature(naming.model_key(F.lit(None).cast("string"), F.col("model_raw"))), " ")
    return table(spark, d, "source_record").select("ord", naming.model_key(parts["brand"], parts["model"]).alias("model_key"), naming.version(F.col("model_raw")).alias("version"), signature.alias("signature"), naming.slug(parts["brand"], parts["model"]).alias("slug"))


@query
def version_signature(spark, d):
    rows = resolve.keyed(table(spark, d, "source_record"), OWN_BRANDS)
    return rows.select("ord", "model_key", naming.version(F.col("model")).alias("version"), F.array_join(naming.numeric_signature(F.col("model_key")), " ").alias("signature"))


@query
def boilerplate_strip(spark, d):
    return table(spark, d, "documents").select("doc_id", text.without_advertising(F.col("text")).alias("text"))


@query
def text_shorten(spark, d):
    return table(spark, d, "documents").select("doc_id", text.shortened(F.col("text"), 180).alias("short"))


def _ready(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "source_record")
    return resolve.prioritised(resolve.keyed(records, OWN_BRANDS), table(spark, d, "source_registry"))


@query
def union_sources(spark, d):
    both = resolve.union_sources(table(spark, d, "source_record"), table(spark, d, "listing_record"))
    return both.select("source", "ord", "model_raw", "brand", "weight_oz", "review_text").select("source", "ord", "model_raw", "brand", "weight_oz", F.size("review_text").cast("double").alias("n_segments"))


@query
def unmatched_records(spark, d):
    return resolve.unmatched(resolve.keyed(table(spark, d, "source_record"), OWN_BRANDS))


@query
def entity_merge(spark, d):
    rows = resolve.with_identity(resolve.merged(_ready(spark, d)))
    values = [F.col(f).cast("double" if k in ("int", "double") else k).alias(f) for f, k in MERGEABLE]
    made = [F.try_element_at(F.col("provenance"), F.lit(f))["url"].alias(f"{f}_url") for f, _ in MERGEABLE]
    return rows.select("brand", "model_key", "canonical_id", "n_records", "n_sources", *values, *made)


@query
def entity_lists(spark, d):
    rows = resolve.gathered(_ready(spark, d))
    noted = lambda c: F.array_join(F.transform(c, lambda n: F.concat(F.coalesce(n["source"], F.lit("")), F.lit(":"), n["text"])), "|")
    return rows.select("brand", "model_key", F.size("sources").alias("n"), noted("pros").alias("pros"), F.array_join("position_tags", ",").alias("positions"), F.size("image_urls").alias("n_images"), F.size("review_text").alias("n_reviews"))


@query
def entity_metrics(spark, d):
    rows = resolve.metrics(_ready(spark, d)).select("brand", "model_key", F.explode("metrics").alias("source", "scores"))
    return rows.select("brand", "model_key", "source", F.map_from_entries(F.map_entries(F.from_json("scores", "map<string,string>"))).alias("m")).select("brand", "model_key", "source", F.size("m").alias("n_scores"))


@query
def canonical_shoes(spark, d):
    rows = resolve.canonical(table(spark, d, "source_record"), table(spark, d, "source_registry"), OWN_BRANDS)
    return rows.select("canonical_id", "brand", "model_key", "version", "n_records", F.size("metrics").alias("n_metrics"), F.size("provenance").alias("n_provenance"))


@query
def canonical_values(spark, d):
    """The gathered lists and metrics of each canonical shoe, as text."""
    rows = resolve.in_output_order(resolve.canonical(table(spark, d, "source_record"), table(spark, d, "source_registry"), OWN_BRANDS))
    sources = F.array_join(F.transform("sources", lambda s: s["url"]), "|")
    measured = F.array_join(F.array_sort(F.map_keys("metrics")), ",")
    proven = F.array_join(F.array_sort(F.map_keys("provenance")), ",")
    return rows.select("canonical_id", "brand", "model_key", "model", "n_records", sources.alias("urls"), measured.alias("measured"), proven.alias("proven"), F.array_join("image_urls", "|").alias("images"))


@query
def near_miss_block(spark, d):
    return resolve.near_blocks(resolve.key_order(_ready(spark, d))).agg(F.count(F.lit(1)).alias("pairs"))


@query
def near_miss_ratio(spark, d):
    pairs = resolve.ambiguous(resolve.key_order(_ready(spark, d)))
    return pairs.select("brand", "a", "b", F.round("ratio", 6).alias("ratio"))


@query
def near_miss_evidence(spark, d):
    ready = _ready(spark, d)
    return resolve.evidence(resolve.ambiguous(resolve.key_order(ready)), ready).select("brand", "a", "b", "which", "ord", "source")


@query
def seed_follow(spark, d):
    keyed = resolve.keyed(table(spark, d, "source_record"), OWN_BRANDS)
    seeds = keyed.filter("source = 'rimvale'")
    return resolve.follow_seeds(keyed.filter("source = 'tractvale'"), seeds).select("ord", "model_key")


@query
def records_by_source(spark, d):
    return report.records_by_source(table(spark, d, "source_record"))


@query
def source_histogram(spark, d):
    return report.source_histogram(table(spark, d, "canonical_shoe"))


@query
def multi_source(spark, d):
    return report.multi_source(table(spark, d, "canonical_shoe"))


@query
def coverage_report(spark, d):
    return report.fill_rates(table(spark, d, "canonical_shoe"))


@query
def report_counts(spark, d):
    keyed = resolve.keyed(table(spark, d, "source_record"), OWN_BRANDS)
    return report.counts(records=keyed, unmatched=resolve.unmatched(keyed), canonical=table(spark, d, "canonical_shoe"))


@query
def pilot_shoes(spark, d):
    return report.pilot(table(spark, d, "canonical_shoe")).select("canonical_id", "n_sources", "filled")


def _upsert(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "shoes"), browse.catalog_columns(table(spark, d, "canonical_shoe"))


@query
def upsert_actions(spark, d):
    return upsert.actions(*_upsert(spark, d)).withColumn("id", F.col("id").cast("double"))


@query
def upsert_counters(spark, d):
    return upsert.counters(upsert.actions(*_upsert(spark, d)))


@query
def upsert_snapshot(spark, d):
    """The whole next catalogue; the ids of new shoes, which no order fixes, are shown as whether they are new."""
    old, batch = _upsert(spark, d)
    rows = upsert.applied(old, batch, F.lit("2027-01-01 00:00:00").cast("timestamp_ntz"))
    top = old.agg(F.max("id").alias("top"))  # one row
    rows = rows.crossJoin(F.broadcast(top))
    notes = [F.array_join(F.transform(f"extra_metadata.{f}", lambda n: F.concat_ws(":", n["source"], n["text"])), "|").alias(f) for f in ("pros", "cons", "review_text")]
    kept = [F.col(f"specs.{f}").cast("string" if f in ("version", "signature_player", "cut_height", "width_fit", "length_fit", "cushioning_tech", "traction_pattern", "outdoor_suitability") else "double").alias(f) for f in SPEC_FIELDS if f not in TAGS]
    tags = [F.array_join(f"specs.{t}", ",").alias(t) for t in TAGS]
    times = [F.col(c).cast("string").alias(c) for c in ("created_at", "updated_at")]
    return rows.select(
        F.when(F.col("id") <= F.col("top"), F.col("id").cast("double")).alias("id"), "canonical_id", "brand", "name", F.col("price").cast("double").alias("price"), "currency", "image_url", "affiliate_url", "source_url",
        *kept, *tags, *notes, F.array_join("extra_metadata.image_urls", "|").alias("image_urls"), F.array_join(F.transform("extra_metadata.sources", lambda x: x["url"]), "|").alias("urls"),
        F.array_join(F.array_sort(F.map_keys("extra_metadata.provenance")), ",").alias("proven"), F.array_join(F.array_sort(F.map_keys("extra_metadata.metrics")), ",").alias("measured"), *times,
    )


@query
def upsert_new_ids(spark, d):
    old, batch = _upsert(spark, d)
    rows = upsert.applied(old, batch, F.lit("2027-01-01 00:00:00").cast("timestamp_ntz"))
    return rows.agg(F.count(F.lit(1)).alias("shoes"), F.countDistinct("id").alias("ids"), F.max("id").alias("top_id"))


@query
def orphan_cleanup(spark, d):
    few = table(spark, d, "shoes").filter(F.col("canonical_id").isNotNull())
    return upsert.without_orphans(table(spark, d, "chunk_embedding"), few).select("id", "shoe_id")


@query
def spec_summary(spark, d):
    return chunks.summaries(table(spark, d, "shoes")).select("shoe_id", "content")


@query
def chunk_build(spark, d):
    return chunks.built(table(spark, d, "shoes")).select("shoe_id", "content", "source")


@query
def chunk_opinions(spark, d):
    return chunks.opinions(table(spark, d, "shoes")).select("shoe_id", "content", "source")


@query
def chunk_split(spark, d):
    pieces = F.posexplode(text.split(F.col("text"))).alias("part", "piece")
    return table(spark, d, "documents").select("doc_id", pieces)


@query
def chunk_windows(spark, d):
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(text.CHUNK_CHARS))).alias("at")
    return table(spark, d, "documents").filter("length(text) > 0").select("doc_id", "text", at).select("doc_id", "at", F.substring(F.col("text"), F.col("at") + 1, F.lit(text.CHUNK_CHARS)).alias("piece"))


def _synced(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "chunk").select("shoe_id", "content", "source")
    return chunks.sync(table(spark, d, "chunk_embedding"), wanted, MODEL)


@query
def chunk_sync(spark, d):
    return _synced(spark, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query
def chunk_sync_rows(spark, d):
    return _synced(spark, d).filter("action != 'embed'").select("id", "action")


@query
def chunk_sync_counters(spark, d):
    return chunks.counters(_synced(spark, d))


@query
def doc_dedup(spark, d):
    return table(spark, d, "documents").groupBy("source", "text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return html.extracted(table(spark, d, "fetch_result").filter("status = 200"))


@query
def html_titles(spark, d):
    return _pages(spark, d).select("page_id", F.col("page.title").alias("title"), F.col("page.h1").alias("h1"))


@query
def html_links(spark, d):
    pages = _pages(spark, d)
    return sites.anchor_links(pages.filter("page is not null"), r"^/[a-z0-9-]+/$").groupBy("source", "url").agg(F.count(F.lit(1)).alias("n"))


@query
def html_spec_records(spark, d):
    rows = sites.spec_table(_pages(spark, d).filter("page is not null"))
    return rows.select("source", "url", "model_raw", "weight_oz", "drop_mm", "cut_height")


@query
def html_headings(spark, d):
    rows = _pages(spark, d).select("page_id", F.posexplode("page.headings").alias("pos", "h"))
    return rows.select("page_id", "pos", F.col("h.level").alias("level"), F.col("h.text").alias("heading"), F.size("h.body").alias("paragraphs"))


@query
def page_cache(spark, d):
    pages = table(spark, d, "fetch_result")
    refs = pages.select("source", "url").distinct()
    return http.cached(refs, pages).select("source", "url", "key", "fetched_at", "from_cache")


@query
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "fetch_result").select("page_id", http.host(u).alias("host"), http.cache_key(u).alias("key"), http.absolute(u, F.lit("/brands/")).alias("brands_url"), http.worth_retrying(F.col("status")).alias("retry"))


@query
def first_seen_urls(spark, d):
    refs = table(spark, d, "source_record").select("ord", "source", "url", "model_raw")
    return http.first_seen(refs)


@query
def robots_allowed(spark, d):
    refs = table(spark, d, "source_record").select("ord", "url")
    rules = table(spark, d, "source_registry").select(http.host(F.col("base_url")).alias("host"), F.when(F.col("trust_rank") % 4 == 0, 403).when(F.col("trust_rank") % 4 == 1, 404).otherwise(200).alias("status"), F.lit("User-agent: *\nDisallow: /private/").alias("body"))
    return http.allowed(refs, rules).select("ord")


@query
def review_titles(spark, d):
    return table(spark, d, "source_record").select("ord", naming.review_title(F.concat("model_raw", F.lit(" Performance Review"))).alias("title"), naming.key_slug(F.col("model_raw")).alias("slug"))


@query
def price_labels(spark, d):
    return table(spark, d, "shoes").select("id", units.price_label(F.col("price")).alias("label"))


@query
def feedback_last_vote(spark, d):
    return feedback.last_votes(table(spark, d, "events"))


@query
def feedback_windows(spark, d):
    rows = feedback.windows(table(spark, d, "events"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def latest_requests(spark, d):
    return feedback.latest_only(table(spark, d, "events").select("user_id", "event_id", "event_type", "props"))


@query
def fetch_schedule(spark, d):
    """For each host the number of fetches, and whether any two come closer than the spacing."""
    rows = http.schedule(table(spark, d, "fetch_result").select("page_id", "url").dropDuplicates(["url"]))
    gap = F.col("wait") - F.lag("wait").over(Window.partitionBy("host").orderBy("wait"))
    return rows.withColumn("gap", gap).groupBy("host").agg(F.count(F.lit(1)).alias("fetches"), F.coalesce(F.min("gap") >= http.SPACING, F.lit(True)).alias("spaced"))
