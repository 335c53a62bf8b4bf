"""Page layouts, staging, streams and the registered queries."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from courtmill import schemas, tables
from courtmill.sources import crawl, html, sites
from courtmill.streaming import feedback

ROOT = Path(__file__).resolve().parents[1]
SPEC = """<html><head><meta property="og:image" content="/o.jpg"><title>T</title></head><body><main><img src="/hero.jpg"><h1>GT Cut 3</h1>
<table class="spec-table"><tr><th>Brand</th><td>Nike</td></tr><tr><th>Year</th><td>2024</td></tr><tr><th>Weight</th><td>13.9 oz</td></tr><tr><th>Drop</th><td>8 mm</td></tr>
<tr><th>Cut height</th><td>Low</td></tr><tr><th>Surface</th><td>Indoor</td></tr><tr><th>Best position</th><td>PG/SG</td></tr><tr><th>Best play style</th><td>Slasher;Shooter</td></tr></table>
<h2>Build notes</h2><p>Small run.</p></main></body></html>"""
COMPARE = """<html><body><script type="application/ld+json">not json</script><script type="application/ld+json">[{"@type":"Product","name":"Ace 1","brand":{"name":"Puma"},"image":["/a.jpg","/b.jpg"]}]</script>
<h1>Ace 1</h1><h2>Our verdict</h2><p>Fine shoe.</p><ul><li>Outdoor 10</li><li>Outdoor 70</li><li>Grip 91</li></ul><h3>Pros</h3><ul><li>light</li></ul>
<table><tr><td>Our score</td><td>88 Great!</td></tr><tr><td>Ranking</td><td>#4</td></tr><tr><td>Price</td><td>$140</td></tr><tr><td>Weight lab</td><td>12 oz</td></tr><tr><td>Traction</td><td>High</td></tr><tr><td>Price</td><td>$150</td></tr></table>
<h3>Torsional rigidity</h3><table><tr><td>Ace 1</td><td>4.5</td></tr><tr><td>Average</td><td>3.9</td></tr></table><table><tr><td>Ace 1</td><td>9</td></tr><tr><td>Average</td><td>1</td></tr></table>
<h2>Who should buy</h2><p>Guards.</p><ul><li>fast ones</li></ul><div class="good-bad-x"><p>Never shown</p></div></body></html>"""
CARDS = """<html><body><h1>Ky 1</h1><p>Released 11 / 2023 , High Top , Mara Ilves , Add to Favourites</p><p>Official Retail Price: $ 125.00</p><p>9.1 EXPERT RATING 12 reviews</p>
<p>Performance Summary A quick shoe that holds every cut you make on court Pros grip</p><p>Best Suitable For: wings who drive 1.5 times a game. More text</p>
<div><span>88%</span><div>Outdoor</div><div>Lasts on asphalt</div></div><div><div>Fit</div><div>Runs slightly small</div><span>7.5</span></div><div><div>Fit</div><div>second card</div><span>1</span></div>
<div><b>Width</b><div><i>Fits narrow feet</i></div></div><div><div>Pros</div><div><div>+</div><div>light</div></div><div><div>+</div><div>cheap</div></div></div><div><div>Cons</div><div><div>-</div><div>loud</div></div></div></body></html>"""
SECTIONS = """<html><body><h1>Zed Low Performance Review</h1><p>Release Date: 3/9/2025 Price: $ 110 Sizing: true to size Buy</p><p>Scored by: Ann Lee 7.5 / 10 Total Score</p><h2>Traction</h2><p>It grips well on every floor we tried and never let go of it.</p>
<h2>Disclosure</h2><p>This section has more than forty characters but no known title.</p><h4>Pros</h4><ul><li>cheap</li></ul></body></html>"""
LISTING = """<html><body><article class="x category-outdoor-basketball-shoes"><h2><a href="/reviews/zed-low/">Zed Low</a></h2></article><a href="/shoes/ace-1/">Ace</a><a href="/shoes/ace-1/"></a>
<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"name":"Ace","url":"https://s.example/ace"}]}</script></body></html>"""


def pages(spark, *markup):
    rows = [(i, "s", f"https://s.example/p/{i}", "t", m) for i, m in enumerate(markup)]
    return html.extracted(spark.createDataFrame(rows, "page_id bigint, source string, url string, fetched_at string, text string"))


def test_spec_table(spark):
    r = sites.spec_table(pages(spark, SPEC, None, "", "<<<>>")).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.model_raw, r.brand, r.release_year, r.weight_oz, r.drop_mm, r.cut_height, r.outdoor_suitability) == ("GT Cut 3", "Nike", 2024, 13.9, 8.0, "low", "bad")
    assert r.position_tags == ["guard"] and r.playstyle_tags == ["slasher", "shooter"] and r.image_urls == ["https://s.example/hero.jpg"] and r.extras["build_notes"] == "Small run."


def test_comparison(spark):
    r = sites.comparison(pages(spark, COMPARE, SPEC)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.model_raw, r.brand, r.msrp_usd_cents, r.weight_oz, r.outdoor_suitability, r.pros, r.image_urls) == ("Ace 1", "Puma", 15000, 12.0, "fair", ["light"], ["/a.jpg"])
    assert r.scores == {"corescore": "88", "traction": "High", "torsional_rigidity": "4.5", "score_outdoor": "70", "score_grip": "91"}
    assert r.review_text == ["[our verdict] Fine shoe.", "[who should buy] Guards.\n- fast ones"]


def test_rating_cards(spark):
    r = sites.rating_cards(pages(spark, CARDS)).first()
    assert (r.release_year, r.cut_height, r.signature_player, r.msrp_usd_cents, r.scores["overall"]) == (2023, "high", "Mara Ilves", 12500, "9.1")
    assert r.review_text == ["[summary] A quick shoe that holds every cut you make on court", "[fit] Runs slightly small", "[outdoor] Lasts on asphalt", "[best for] wings who drive 1.5 times a game."]
    assert (r.length_fit, r.width_fit, r.outdoor_suitability, r.pros, r.cons) == ("slightly_small", "narrow", "good", ["light", "cheap"], ["loud"])
    assert r.scores == {"overall": "9.1", "expert_review_count": "12", "outdoor": "88%", "fit": "7.5"} and r.extras["width_note"] == "Fits narrow feet"


def test_sections_and_listings(spark):
    listed = pages(spark, LISTING)
    cards = sites.card_links(listed)
    assert [(r.url, r.name, r.tags) for r in cards.collect()] == [("https://s.example/reviews/zed-low/", "Zed Low", ["outdoor"])]
    assert [r.name for r in sites.anchor_links(listed).collect()] == ["Zed Low", "Ace"]
    assert [(r.url, r.name) for r in sites.item_list_links(listed).collect()] == [("https://s.example/ace", "Ace")]
    tags = spark.createDataFrame([("https://s.example/p/0", ["outdoor", "high-top"])], "url string, tags array<string>")
    r = sites.sections(pages(spark, SECTIONS), tags).first()
    assert (r.model_raw, r.release_year, r.msrp_usd_cents, r.length_fit, r.cut_height, r.outdoor_suitability, r.pros) == ("Zed Low", 2025, 11000, "true_to_size", "low", "good", ["cheap"])
    assert [t.split("]")[0] for t in r.review_text] == ["[intro", "[traction"]
    assert r.scores == {"reviewer_score": "7.5"} and r.extras == {"sizing_note": "true to size", "reviewer": "Ann Lee", "categories": "outdoor, high-top"}


def test_crawl_filters_limits_and_survives_bad_pages(spark):
    seeds = [(0, "a", f"https://a.example/{i}", f"Nike Zed {i}") for i in range(4)]
    follow = [(i, "b", f"https://b.example/{i}", f"Nike Zed {i}") for i in (7, 1, 0, 1, 3)] + [(9, "b", "https://b.example/gone", "Nike Zed 1")]
    refs = lambda rows: spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "pos int, source string, url string, name string")
    spec = lambda n: f"<h1>Nike Zed {n}</h1><table><tr><th>Brand</th><td>Nike</td></tr><tr><th>Model</th><td>Zed {n}</td></tr></table>"
    rows = [(s, u, 200, spec(n.split()[-1]), t) for _, s, u, n in {r[2]: r for r in [*seeds, *follow]}.values() if "gone" not in u for t in ("2024", "2025")] + [("b", "https://b.example/gone", 404, "x", "2026")]
    pages_ = spark.createDataFrame(rows, "source string, url string, status int, text string, fetched_at string")
    one, none = crawl.scraped(refs(seeds), pages_, sites.spec_table, limit=2)
    assert [(r.url, r.fetched_at) for r in one.orderBy("url").collect()] == [("https://a.example/0", "2025"), ("https://a.example/1", "2025")] and none.count() == 0
    both = [crawl.Source(refs(follow), sites.spec_table, follow_limit=2), crawl.Source(refs(seeds), sites.spec_table, seed_limit=2)]
    records, _ = crawl.scrape_sources(both, pages_, pilot=True)
    assert sorted(r.url for r in records.collect()) == ["https://a.example/0", "https://a.example/1", "https://b.example/0", "https://b.example/1"]
    whole, _ = crawl.scrape_sources(both, pages_, limit=3)
    assert sorted(r.url for r in whole.filter("source = 'b'").collect()) == ["https://b.example/0", "https://b.example/1", "https://b.example/7"]


def test_paged_listings_stop_where_nothing_is_new(spark):
    pages_ = spark.createDataFrame([("a", n) for n in range(1, 6)] + [("b", n) for n in range(1, 4)], "source string, page_no int")
    refs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("a", 4, "z"), ("b", 1, "p"), ("b", 2, "q"), ("b", 3, "r")], "source string, page_no int, url string")
    assert sorted(r.url for r in crawl.until_nothing_new(pages_, refs, 2).collect()) == ["p", "q", "x", "y"]
    assert sorted(r.url for r in crawl.until_nothing_new(pages_, refs, 9).collect()) == ["p", "q", "r", "x", "y"]


def test_staging(spark, tmp_path, data):
    df = spark.read.parquet(f"{data}/canonical_shoe.parquet")
    tables.write_staging(df, str(tmp_path / "c"))
    back = tables.read_staging(spark, str(tmp_path / "c"), schemas.CANONICAL)
    assert back.count() == df.count() and back.filter("size(sources) > 0").count() == df.filter("size(sources) > 0").count()


def test_stream_equals_batch(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    folder = str(tmp_path / "events")
    events.orderBy("ts").coalesce(1).write.parquet(folder)
    stream = feedback.windowed_stream(feedback.event_stream(spark, folder, events.schema), late="400 days")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(120)
    key = lambda rows: sorted((str(r.window_start), r.event_type, r.n, round(r.total, 4)) for r in rows)
    assert key(spark.table("windows").collect()) == key(feedback.windows(events).collect())


def test_every_core_query_runs_and_is_whole(spark, data):
    from courtmill.plans import oracle, queries

    assert set(oracle.ORACLE) <= set(queries.QUERIES)
    for name in ("vector_entity_search", "entity_merge", "upsert_counters", "chunk_sync", "coverage_report"):
        assert len(queries.QUERIES[name](spark, data).columns) > 0


def test_one_pass_plans(spark, data):
    from courtmill.plans.queries import QUERIES

    plan = QUERIES["browse_total"](spark, data)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "IsNotNull(brand)" in plan


def test_core_stands_without_the_llm_package():
    code = "import sys; sys.modules['courtmill.llm'] = None; import __spark_entry__ as e; n = e.queries(); assert 'browse_page' in n and not any(k.startswith('p1_') for k in n)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for path in (ROOT / "courtmill").rglob("*.py"):
        if "llm" not in path.parts:
            assert "courtmill.llm" not in path.read_text()
