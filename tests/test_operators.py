"""Operators on small tables."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from courtmill.functions import ranking
from courtmill.operators import browse, chunks, report, resolve, search, upsert
from courtmill.operators.browse import Filters
from courtmill.sources import http, models
from courtmill.streaming import feedback

SPECS = "version string, release_year int, signature_player string, weight_oz double, weight_g double, drop_mm double, stack_heel_mm double, stack_forefoot_mm double, cut_height string, width_fit string, length_fit string, cushioning_tech string, traction_pattern string, outdoor_suitability string, position_tags array<string>, playstyle_tags array<string>"


def shoes(spark, rows):
    """rows: (id, canonical_id, brand, name, price, tags)."""
    df = spark.createDataFrame([(i, c, b, n, None if p is None else Decimal(p), t) for i, c, b, n, p, t in rows], "id bigint, canonical_id string, brand string, name string, price decimal(10,2), tags array<string>")
    struct = F.struct(*[(F.col("tags") if f == "playstyle_tags" else F.lit(None).cast(k)).alias(f) for f, k in (x.strip().split(" ", 1) for x in SPECS.split(", "))])
    notes = F.lit(None).cast("array<struct<source:string,text:string>>")
    meta = F.struct(notes.alias("review_text"), notes.alias("pros"), notes.alias("cons"))
    stamp = F.lit(datetime(2026, 1, 1))
    none = F.lit(None).cast("string")
    return df.select("id", "canonical_id", "brand", "name", "price", F.lit("USD").alias("currency"), none.alias("image_url"), none.alias("affiliate_url"), none.alias("source_url"), struct.alias("specs"), meta.alias("extra_metadata"), stamp.alias("created_at"), stamp.alias("updated_at"))


@pytest.fixture(scope="module")
def catalog(spark):
    return shoes(spark, [(1, "a", "Nike", "A", "150.00", ["slasher"]), (2, "b", "nike", "B", None, []), (3, "c", "Peak", "C", "90.00", ["shooter", "post"]), (4, None, "Peak", "D", "90.00", None)]).cache()


def test_browse(catalog):
    assert [r.id for r in browse.page(catalog, Filters()).collect()] == [3, 4, 1, 2]
    assert [r.id for r in browse.page(catalog, Filters(), limit=2, offset=2).collect()] == [1, 2]
    assert browse.total(catalog, Filters(brand="NIKE")).first()["total"] == 2
    assert [r.id for r in browse.matching(catalog, Filters(budget_min=100, budget_max=200)).collect()] == [1]
    assert [r.id for r in browse.matching(catalog, Filters(playstyle="post")).collect()] == [3]
    assert [r.id for r in browse.dearest_first(catalog, Filters(), 2).collect()] == [2, 1]
    assert browse.by_id(catalog, 99).count() == 0
    for bad in (lambda: browse.page(catalog, Filters(budget_min=2, budget_max=1)), lambda: browse.page(catalog, Filters(), limit=0), lambda: browse.page(catalog, Filters(budget_min=-1))):
        with pytest.raises(ValueError):
            bad()


def test_two_stage_search(spark, catalog):
    index = spark.createDataFrame([(i, 1 + i % 3, f"c{i}", None if i % 2 else "s", "m", [1.0, float(i) / 10]) for i in range(12)] + [(99, 1, "zero", None, "m", [0.0, 0.0]), (98, 1, "other", None, "x", [1.0, 0.0])], "id bigint, shoe_id bigint, content string, source string, model_id string, vector array<float>")
    found = search.hits(index, catalog, [1.0, 0.0], "m", limit=1, snippets=1)
    assert sorted((r.shoe_id, r.id, r.rn) for r in found.collect()) == [(1, 0, 1), (2, 1, 1), (3, 2, 1)]
    best = search.candidates(found, catalog, 2).collect()
    assert [r.shoe_id for r in best] == [1, 2] and best[0].similarity == 1.0 and best[0].snippets[0]["text"] == "c0"


def test_fallback_and_recommend(spark, catalog):
    requests = spark.createDataFrame([(1, "post shooter", "", None), (2, "slasher", "", 100.0), (3, " ", None, None)], "request_id bigint, playstyle string, aesthetic string, budget double")
    ranked = search.by_tags(requests, catalog)
    assert [(r.shoe_id, r.overlap) for r in ranked.filter("request_id = 1").orderBy("rn").collect()] == [(3, 2), (1, 0), (2, 0), (4, 0)]
    assert [r.shoe_id for r in ranked.filter("request_id = 2").orderBy("rn").collect()] == [3, 4]
    assert "NestedLoop" not in ranked._jdf.queryExecution().toString()
    cards = search.recommend(requests, catalog).collect()
    assert {r.request_id for r in cards} == {1, 2} and all(r.explanation for r in cards)
    assert [r.shoe_id for r in cards if r.request_id == 1 and r.place == 1] == [3]
    again = search.recommend(requests, catalog).collect()
    assert sorted((r.request_id, r.place, r.shoe_id) for r in cards) == sorted((r.request_id, r.place, r.shoe_id) for r in again)


def test_filters_hold_in_both_searches(spark, catalog):
    asked = [(1, "post", None, None, "PEAK", None, None), (2, "post", None, 100.0, None, "shooter", ""), (3, None, None, None, "Nike", None, None), (4, "post", None, None, "None", None, None), (5, "x", None, -1.0, None, None, None)]
    requests = spark.createDataFrame(asked, "request_id int, playstyle string, aesthetic string, budget double, brand string, playstyle_tag string, cut string")
    index = spark.createDataFrame([(i, 1 + i % 4, f"post shoe {i}", None, "m", models.hash_embedder(16)([f"post shoe {i % 3}"])[0]) for i in range(30)] + [(90, 3, "bad", None, "m", None), (91, 3, "short", None, "m", [1.0])], "id bigint, shoe_id bigint, content string, source string, model_id string, vector array<float>")
    calls = []

    def broken(texts):
        raise models.Unavailable("down")

    found = search.ranked_candidates(requests, catalog, index, models.hash_embedder(16), "m").collect()
    of = lambda n: {r.shoe_id for r in found if r.request_id == n}
    assert of(1) == {3, 4} and of(2) == {3} and of(3) == {1, 2} and of(4) == set() and of(5) == set()
    assert all((r.similarity is None) == (r.request_id == 3) for r in found)
    exact = search.retrieve(search.with_vectors(requests, models.hash_embedder(16)), catalog, index, "m", limit=1, snippets=2).filter("request_id = 1").collect()
    assert len(exact) == 4 and {r.rn for r in exact} == {1, 2}
    models.RETRIES, old = 0, models.RETRIES
    try:
        down = search.ranked_candidates(requests, catalog, index, lambda texts: [[1.0]], "m")
        assert {r.request_id for r in down.collect()} >= {1, 2, 3}
    finally:
        models.RETRIES = old
    with pytest.raises(models.ModelError):
        models.embedded(broken, ["a"], sleep=calls.append)
    assert calls == [2.0, 4.0, 8.0, 16.0]
    assert models.in_order([(1, [2.0]), (0, [1.0])]) == [[1.0], [2.0]]
    with pytest.raises(models.ModelError):
        models.embedded(lambda t: [[1.0]], ["a", "b"])


def test_model_explains_or_templates_stand(spark, catalog):
    class Echo:
        """A model that makes cards for prompts that ask for it, and fails for others."""

        def complete_json(self, system, user, schema_name, schema):
            if "Playstyle: slasher" not in user:
                raise RuntimeError("no")
            return {"cards": [{"specs": ["own"], "explanation": f"card {i}"} for i in range(user.count("Evidence:"))]}

    requests = spark.createDataFrame([(1, "slasher", "red", None), (2, "post", "", None)], "request_id bigint, playstyle string, aesthetic string, budget double")
    cards = search.recommend(requests, catalog, model=Echo()).collect()
    assert all((r.explanation == f"card {r.place - 1}" and r.specs == ["own"]) == (r.request_id == 1) for r in cards) and {r.request_id for r in cards} == {1, 2}


def test_seed_is_of_all_fields():
    base = {c: None for c in ranking.SEED_FIELDS}
    seeds = {ranking.seed_of(base | {c: "é"}) for c in ranking.SEED_FIELDS} | {ranking.seed_of(base)}
    assert len(seeds) == len(ranking.SEED_FIELDS) + 1


def test_model_cards(spark):
    placed = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 12), (3, 1, 13)], "request_id bigint, place int, shoe_id bigint")
    answers = spark.createDataFrame([(1, '{"cards":[{"specs":[" a ","","b"],"explanation":" x  y "},{"specs":null,"explanation":"z"}]}'), (2, "no json"), (3, '{"cards":[{"specs":[],"explanation":" "}]}')], "request_id bigint, answer string")
    rows = {(r.request_id, r.place): (r.specs, r.explanation) for r in search.cards_of_model(placed, answers).collect()}
    assert rows == {(1, 1): (["a", "b"], "x y"), (1, 2): ([], "z")}


def records(spark, rows):
    """rows: (ord, source, brand, model, weight, pros, scores)."""
    kind = "ord bigint, source string, brand string, model string, weight_oz double, pros array<string>, scores map<string,string>"
    df = spark.createDataFrame(rows, kind)
    extra = {"url": F.concat(F.lit("u"), F.col("ord").cast("string")), "fetched_at": F.lit("t"), "model_raw": F.coalesce("model", F.lit("raw"))}
    lists = {c: F.array().cast("array<string>") for c in ("cons", "review_text", "image_urls", "position_tags", "playstyle_tags")}
    return df.withColumns(extra | lists)


def test_resolve(spark):
    rows = records(spark, [(1, "low", "Nike", "G.T. Cut 3", 13.0, ["p1"], {"a": "1"}), (2, "top", "nike", "GT Cut 3", None, ["p2"], {"b": "2"}), (3, "top", "Nike", "GT Cut 3", 12.0, None, {"c": "3"}), (4, "low", "Nike", "GT Cuts 3", 11.0, None, None), (5, "low", None, "Mystery", 1.0, None, None), (6, "new", "Nike", "GT Cut 4", None, None, {})])
    priority = spark.createDataFrame([("top", 1), ("low", 2)], "source string, trust_rank int")
    ready = resolve.prioritised(resolve.keyed(rows), priority)
    merged = {r.model_key: r for r in resolve.with_identity(resolve.merged(ready, ("weight_oz",))).collect()}
    assert set(merged) == {"gt cut 3", "gt cuts 3", "gt cut 4"}
    cut = merged["gt cut 3"]
    assert (cut.canonical_id, cut.version, cut.weight_oz, cut.provenance["weight_oz"]["url"], cut.n_records) == ("nike-gt-cut-3", "3", 12.0, "u3", 3)
    assert merged["gt cut 4"].weight_oz is None and merged["gt cut 4"].provenance == {}
    lists = {r.model_key: r for r in resolve.gathered(ready).collect()}
    assert [p["text"] for p in lists["gt cut 3"].pros] == ["p2", "p1"]
    scores = {r.model_key: r.metrics for r in resolve.metrics(ready).collect()}
    assert scores["gt cut 3"] == {"top": '{"c":"3"}', "low": '{"a":"1"}'}
    assert [r.ord for r in resolve.unmatched(ready).collect()] == [5]
    near = resolve.ambiguous(resolve.key_order(ready)).collect()
    assert [(r.a, r.b) for r in near] == [("gt cut 3", "gt cuts 3")] and near[0].ratio == resolve.ratio("gt cut 3", "gt cuts 3")
    told = resolve.evidence(resolve.ambiguous(resolve.key_order(ready)), ready)
    assert sorted((r.which, r.ord) for r in told.collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 4)]


def test_near_blocks_lose_nothing(spark):
    names = ["alpha wolf", "alpha wolfs", "alpa wolf", "beta wolf", "wolf alpha", "a", "ab", "abc", "abcd", "aaaaaa", "aaaaab", "alphawolf", "alpha volf x"]
    keys = spark.createDataFrame([("B", n, i) for i, n in enumerate(names)], "brand string, model_key string, first_ord bigint")
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if resolve.ratio(a, b) >= 0.86}
    assert {(r.a, r.b) for r in resolve.ambiguous(keys).collect()} == want and want


def test_upsert(spark, catalog):
    batch = catalog.filter("canonical_id in ('a', 'c')").select("canonical_id", "brand", F.when(F.col("canonical_id") == "c", "C2").otherwise(F.col("name")).alias("name"), "price")
    new = spark.createDataFrame([("z", "New", "Z", Decimal("1.00"))], "canonical_id string, brand string, name string, price decimal(10,2)")
    whole = batch.unionByName(new)
    values = ("brand", "name", "price")
    acted = upsert.actions(catalog, whole, values)
    assert upsert.counters(acted).first().asDict() == {"inserted": 1, "updated": 1, "deleted": 2, "unchanged": 1}
    after = upsert.applied(catalog, whole, F.lit(datetime(2027, 1, 1)), values)
    assert sorted((r.id, r.name) for r in after.collect()) == [(1, "A"), (3, "C2"), (5, "Z")]
    assert upsert.counters(upsert.actions(after.withColumn("x", F.lit(1)), whole, values)).first().asDict() == {"inserted": 0, "updated": 0, "deleted": 0, "unchanged": 3}
    assert upsert.counters(upsert.actions(catalog, whole.limit(0), values)).first()["deleted"] == 4
    assert upsert.duplicates(whole.unionByName(new)).first()["n"] == 2
    with pytest.raises(Exception, match="canonical_id twice in a batch: z"):
        upsert.counters(upsert.actions(catalog, whole.unionByName(new), values)).collect()
    with pytest.raises(ValueError):
        upsert.applied(catalog, whole.limit(0), F.lit(datetime(2027, 1, 1)), values)


def test_upsert_sees_nested_values(spark, catalog):
    whole = catalog.filter("canonical_id is not null").drop("id", "created_at", "updated_at")
    same = upsert.counters(upsert.actions(catalog, whole)).first().asDict()
    assert same == {"inserted": 0, "updated": 0, "deleted": 1, "unchanged": 3}
    wiped = whole.withColumn("specs", F.lit(None).cast(whole.schema["specs"].dataType))
    assert upsert.counters(upsert.actions(catalog, wiped)).first()["updated"] == 3
    after = upsert.applied(catalog, wiped, F.lit(datetime(2027, 1, 1)))
    assert {"specs", "extra_metadata"} <= set(after.columns) and after.filter("specs is not null").count() == 0
    maps = spark.createDataFrame([("a", {"x": {"p": "1", "q": "2"}, "y": {}}), ("b", {"x": {"p": "1"}})], "canonical_id string, m map<string,map<string,string>>").withColumn("id", F.lit(1))
    other = spark.createDataFrame([("a", {"y": {}, "x": {"q": "2", "p": "1"}}), ("b", {"x": {"p": "3"}})], "canonical_id string, m map<string,map<string,string>>")
    assert {r.canonical_id: r.action for r in upsert.actions(maps, other, ("m",)).collect()} == {"a": "unchanged", "b": "update"}


def test_catalog_stream(spark, catalog, tmp_path):
    folder, inbox = str(tmp_path / "catalog"), str(tmp_path / "inbox")
    catalog.write.parquet(f"{folder}/version=0")
    rows = catalog.filter("canonical_id = 'c'").drop("id", "created_at", "updated_at")
    rows.withColumn("name", F.lit("old")).withColumn("ord", F.lit(1)).unionByName(rows.withColumn("name", F.lit("new")).withColumn("ord", F.lit(2))).unionByName(rows.withColumn("canonical_id", F.lit("z")).withColumn("ord", F.lit(3))).write.parquet(inbox)
    stream = spark.readStream.schema(spark.read.parquet(inbox).schema).parquet(inbox)
    feedback.catalog_stream(stream, folder, str(tmp_path / "c"), F.lit(datetime(2027, 1, 1))).awaitTermination(120)
    after = {r.canonical_id: (r.id, r.name) for r in spark.read.parquet(f"{folder}/version=1").collect()}
    assert after == {"a": (1, "A"), "b": (2, "B"), "c": (3, "new"), "z": (5, "C")}


def test_chunk_sync(spark):
    old = spark.createDataFrame([(1, 1, "a", None, "m"), (2, 1, "a", None, "m"), (3, 1, "b", "s", "old"), (4, 2, "gone", "s", "m")], "id bigint, shoe_id bigint, content string, source string, model_id string")
    want = spark.createDataFrame([(1, "a", None), (1, "b", "s"), (3, "c", "s")], "shoe_id bigint, content string, source string")
    rows = chunks.sync(old, want, "m")
    assert sorted((r.id or 0, r.content, r.action) for r in rows.collect()) == [(0, "b", "embed"), (0, "c", "embed"), (1, "a", "keep"), (2, "a", "delete"), (3, "b", "delete"), (4, "gone", "delete")]
    made = chunks.embedded(rows.filter("action = 'embed'"), models.hash_embedder(8), "m", F.lit(datetime(2026, 1, 1))).collect()
    assert len(made) == 2 and all(len(r.vector) == 8 for r in made)
    kept = rows.filter("action = 'keep'").select("id", "shoe_id", "content", "source").withColumn("model_id", F.lit("m"))
    again = chunks.sync(kept.unionByName(spark.createDataFrame([(10, 1, "b", "s", "m"), (11, 3, "c", "s", "m")], kept.schema)), want, "m")
    assert chunks.counters(again).first().asDict() == {"shoes": 2, "kept": 3, "embedded": 0, "deleted": 0}


def test_report(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/canonical_shoe.parquet")
    rates = {r.field: r for r in report.fill_rates(df).collect()}
    assert rates["release_year"].filled <= df.count() and rates["pros"].percent is None
    assert {r.percent for r in report.fill_rates(df.limit(0)).collect()} == {0.0, None}


def test_fetch_policies(spark):
    assert http.retry_delay("0.2", 3, 5.0) == 1.0 and http.retry_delay("7", 0, 5.0) == 7.0 and http.retry_delay("soon", 2, 5.0) == 20.0 and http.retry_delay(None, 1, 2.0) == 4.0
    refs = spark.createDataFrame([("https://a.example/x",), ("https://a.example/private/x",), ("https://b.example/x",), ("https://c.example/x",), ("https://d.example/x",)], "url string")
    rules = spark.createDataFrame([("a.example", 200, "User-agent: *\nDisallow: /private/"), ("b.example", 403, None), ("c.example", 404, None)], "host string, status int, body string")
    assert sorted(r.url for r in http.allowed(refs, rules).collect()) == ["https://a.example/x", "https://c.example/x"]
    base = F.lit("https://a.example/x/y")
    links = spark.createDataFrame([("/z",), ("z",), ("//o.example/z",), ("http://o.example/",)], "h string")
    assert [r[0] for r in links.select(http.absolute(base, F.col("h"))).collect()] == ["https://a.example/z", "https://a.example/x/z", "https://o.example/z", "http://o.example/"]
