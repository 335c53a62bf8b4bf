"""Canonical values, leakage, personal information, mixtures and page bodies."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtmill.llm import boilerplate, canonical, leakage, mixture, pii

REF = "ref_id int, field_name string, canonical_value string, aliases array<string>"


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame([(1, "brand", "Veltrix", ["VLX"]), (2, "brand", "Port Ember", []), (3, "brand", "Élanor", None), (4, "cut_height", "low", []), (5, "cut_height", "mid", []), (6, "cut_height", "high", []), (7, "cushioning_tech", "Aerloft", []), (8, "cushioning_tech", "Aerloft Pro", [])], REF)


VALUES = [
    ("brand", "veltrix ", 1), ("brand", "V3ltrix", 1), ("brand", "Vletrix Footwear", 1), ("brand", "vlx", 1), ("brand", "PortEmber", 2), ("brand", "Brand: Port-Ember", 2), ("brand", "elanor", 3), ("brand", "Marrowby", 0), ("brand", "n/a", 0), ("brand", "???", 0),
    ("cut_height", "Low-Top", 4), ("cut_height", "lwo", 4), ("cut_height", "md_rise", 5), ("cut_height", "HI", 6), ("cut_height", "slip-on", 0), ("cut_height", "below the ankle / low", 4),
    ("cushioning_tech", "with Aerloft", 7), ("cushioning_tech", "aerlotf-PRO", 8), ("cushioning_tech", "Aerloft foam", 7), ("cushioning_tech", "cork bed", 0),
]


def test_values_mapped(spark, reference):
    fields = ("brand", "cushioning_tech", "cut_height")
    rows = [(i, *[v if f == field else None for f in fields], "clash", want) for i, (field, v, want) in enumerate(VALUES)] + [(900, "Veltrix", "\t ", "", "c", 0), (901, None, None, None, None, 0)]
    df = spark.createDataFrame(rows, "ord bigint, brand string, cushioning_tech string, cut_height string, value string, ref_id int")
    want = {(i, f, w) for i, (f, _, w) in enumerate(VALUES)}
    assert {(r.ord, r.field_name, r.ref_id) for r in canonical.map_values(df, reference).collect()} == want
    joined = {(r.ord, r.field_name, r.ref_id) for r in canonical.map_values(df, reference, broadcast_terms=2).collect()}
    assert joined == want
    assert {r.value for r in canonical.misses(canonical.map_values(df, reference)).collect()} == {v for _, v, w in VALUES if w == 0}
    assert canonical.map_values(df.limit(0), reference).count() == 0
    assert {r.ref_id for r in canonical.map_values(df, reference.limit(0)).collect()} == {0}
    assert canonical.map_values(df.withColumn("brand", F.repeat(F.lit("x y "), 5000)), reference).filter("field_name = 'brand' and ref_id = 0").count() == len(rows)


def test_both_paths_on_fallbacks_and_ties(spark):
    """Acronyms, leading words, the reference frequency and words parted by dots, with the list broadcast and joined."""
    entries = [(1, "Velo Trixon Nord"), (2, "Marrow Kite"), (3, "Marrow Gale"), (4, "Solenne Park"), (5, "Tarnak"), (6, "Tarnok"), (7, "Ori.Bel.Dun"), (8, "Velo Quist"), (9, "Q" * 50 + "x" * 60)]
    reference = spark.createDataFrame([(i, "brand", v, None) for i, v in entries], REF)
    want = {"VTN": 1, "mk": 2, "Solenne": 4, "Marrow": 0, "Velo": 0, "Tarnek": 6, "Quist": 0, "o r i b e l d u n": 0, "Ori Bel Dun shoes": 7, "ob": 0, "the " + "q" * 50 + "X" * 60: 9, "q" * 50 + "x" * 59: 0}
    values = [*want, *["Tarnok"] * 3, "Tarnak"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "ord int, brand string")
    for most in (50_000, 2):
        got = canonical.map_values(df, reference, fields=("brand",), broadcast_terms=most).collect()
        assert {r.value: r.ref_id for r in got} == want, most


def test_distance_against_plain():
    def plain(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(1)
    for _ in range(500):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
        if plain(a, b) <= 2:
            assert canonical.deletes(a) & canonical.deletes(b)
        assert canonical.distance(a, b, 99.0) <= plain(a, b) + 0.5


def test_leaks(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 12, 30])))) for i in range(25)] + [(90, None), (91, "")]
    docs = []
    for i in range(200):
        words = rng.choices(vocabulary, k=30)
        source = rng.choice(items[:25])[1].split()
        n = rng.choice([0, 11, 12, 20])
        words[10:10] = [w.upper() if rng.random() < 0.5 else w for w in source[:n]]
        docs.append((i, rng.choice([" ", ", ", " - "]).join(words)))
    docs += [(900, None), (901, ""), (0, docs[0][1])]
    grams = lambda t: {tuple(t.lower().replace(",", " ").replace("-", " ").split()[i : i + 12]) for i in range(len(t.lower().replace(",", " ").replace("-", " ").split()) - 11)}
    want = {(d, i) for d, t in docs for i, s in items if t and s and grams(t) & grams(s)}
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1)).withColumn("pos", F.lit(1))
    e = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    assert {tuple(r) for r in leakage.exact_pairs(d, e).collect()} == want and want
    assert leakage.exact_pairs(d.limit(0), e).count() == 0 and leakage.exact_pairs(d, e.limit(0)).count() == 0


def test_replaced_slots(spark):
    item = "A train leaves the old station with twelve coaches and needs forty five minutes to reach the next town on the line"
    renamed = item.replace("twelve", "nine").replace("forty five", "55")
    longer = item.replace("twelve", "one hundred and").replace("forty five", "thirty")
    mixed = "twelve and twelve coaches of the old line need twelve minutes for twelve towns on the line again"
    other = mixed.replace("twelve", "six", 1).replace("twelve", "seven", 1)
    named = "Before noon the baker Marta sells her warm bread to the miller Jonas Heide near the stone bridge by the river"
    replaced = named.replace("Marta", "Ines").replace("Jonas Heide", "Ole")
    table = " ".join(str(i) for i in range(30))
    e = spark.createDataFrame([(1, item), (2, mixed), (3, named), (4, table)], "item_id bigint, text string")
    d = spark.createDataFrame([(1, renamed), (2, item), (3, other), (4, replaced), (5, " ".join(str(i + 7) for i in range(30))), (6, longer), (7, table), (8, item.upper())], "doc_id bigint, text string")
    for most in (500_000, 1):
        rows = {(r.doc_id, r.item_id): (r.exact_windows, r.template_windows) for r in leakage.leaks(d, e, broadcast_windows=most).collect()}
        assert rows[2, 1][0] > 0 and rows[8, 1][0] == rows[2, 1][0] and rows[2, 1][1] == 0
        assert rows[1, 1] == (0, 10) and rows[4, 3][1] > 0 and rows[6, 1][1] > 0
        assert rows[3, 2] == (4, 0) and (5, 4) not in {k for k, v in rows.items() if v[1]} and rows[7, 4] == (19, 0)


def test_template_windows_many_slots(spark):
    """A corpus of number tables meets a held-out table only where all words are equal."""
    rng = random.Random(2)
    tables = [(i, " ".join(str(rng.randrange(50)) for _ in range(40))) for i in range(300)]
    tables.append((900, tables[0][1]))
    d = spark.createDataFrame(tables, "doc_id bigint, text string")
    e = spark.createDataFrame([(1, tables[0][1])], "item_id bigint, text string")
    got = {r.doc_id for r in leakage.leaks(d, e).collect()}
    assert got == {0, 900}
    assert leakage.leaks(d, e.limit(0)).count() == 0 and leakage.leaks(d.limit(0), e).count() == 0


PRIVATE = [
    ("My name is Helen J. Hartenvale and I bought it. Mail: lucie.k@uni-ostwick9.test, phone 030/23125290.", {("name", "Helen J. Hartenvale"), ("email", "lucie.k@uni-ostwick9.test"), ("phone", "030/23125290")}),
    ("Ich heiße oskar mereworthy, erreichbar unter (617) 555-0133.", {("name", "oskar mereworthy"), ("phone", "(617) 555-0133")}),
    ("Please ship to 1738 Cedar Hollow Drive #76, Eastmere 00284. Or Calle de la Mora 29, 7ºB. Or Am Mühlgraben 57, 00460 Neustrelau", {("address", "1738 Cedar Hollow Drive #76, Eastmere 00284"), ("address", "Calle de la Mora 29, 7ºB"), ("address", "Am Mühlgraben 57, 00460 Neustrelau")}),
    ("passport 666 98 7088, nothing else. national ID is QQ 63 33 10 C. wrote X0922055T", {("id_number", "666 98 7088"), ("id_number", "QQ 63 33 10 C"), ("id_number", "X0922055T")}),
    ("gartquist62 at quickpost dot test is quick; v35 @ inbox.brackwater.example too; +1-312-555-0165 ext. 93", {("email", "gartquist62 at quickpost dot test"), ("email", "v35 @ inbox.brackwater.example"), ("phone", "+1-312-555-0165 ext. 93")}),
    ("Refund went to Sra. Osseninga instead of me.\n- Hugo Taverncombe Heel to toe it rolls.", {("name", "Osseninga"), ("name", "Hugo Taverncombe")}),
    ("Marrick Sool told me. I saw Marrick Sool. Tickets for hoops@night 38, row 12@B. @court_rat42", set()),
    ("I spoke with Maria Lopez about it. Contact: Dr. Jane Smith. Frau Meier-Schulz called.\nBest,\nJohn Carter", {("name", "Maria Lopez"), ("name", "Jane Smith"), ("name", "Meier-Schulz"), ("name", "John Carter")}),
    ("IBAN DE89 3704 0044 0532 0130 00 please, card 4111 1111 1111 1111 or 12345678Z", {("id_number", "DE89 3704 0044 0532 0130 00"), ("id_number", "4111 1111 1111 1111"), ("id_number", "12345678Z")}),
    ("not issued: 000-00-0000, 12345678A; card 4111-1111-1111-1112; Mark Trail of the shoe", {("name", "Mark Trail")}),
    ("x " + "a" * 64 + "@" + "d" * 60 + "." + "e" * 60 + ".example", {("email", "a" * 64 + "@" + "d" * 60 + "." + "e" * 60 + ".example")}),
    ("Barcode 0410132784067. Order no. 20265204-8. Style code FZ6416-646. Batch 112.240.25. Sizes 7-13 drop on 2026-04-11. 8.9/10 at 18:56", set()),
    ("Meet at court 39, Riverside Drive entrance. The Main Street colourway sold out @ noon.", set()),
    ("", set()),
]


@pytest.mark.parametrize(("text", "want"), PRIVATE)
def test_mentions(text, want):
    found = pii.find(text, frozenset({"marrick sool"}))
    assert {(k, text[a:b]) for k, a, b in found} == want
    clean = pii.redact(text, found)
    assert not pii.find(clean, frozenset({"marrick sool"})) and all(v not in clean for _, v in want)


def test_mentions_of_rows(spark):
    rows = [(1, None), (2, ""), (3, PRIVATE[0][0]), (3, PRIVATE[0][0]), (4, ("plain words " * 20_000) + "x@y.example")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("pii_type", F.lit(1)).withColumn("k", F.lit(1))
    out = pii.mentions(df).collect()
    assert sum(r.doc_id == 3 for r in out) == 6 and [(r.pii_type, r.start_pos) for r in out if r.doc_id == 4] == [("email", 240_000)]
    clean = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert clean[1] is None and clean[2] == "" and "[NAME]" in clean[3]
    assert pii.mentions(df.limit(0)).count() == 0


def test_public_names_joined_beyond_the_bound(spark):
    """More public names than may be broadcast are anti-joined, with the same mentions and texts."""
    public = spark.createDataFrame([("Helen Hart",), ("Jonas  Loxmoor",), (None,), ("Third One",)], "p string")
    texts = ["I met with Helen Hart and with Sofia Brand, mail a@b.example", "My name is Jonas Loxmoor.", None, "", "Dr. Ruth Heller, Dr. Ruth Heller"]
    d = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts * 2)], "doc_id int, text string")
    few, many = pii.public_names(public), pii.public_names(public, most=2)
    assert isinstance(few, frozenset) and not isinstance(many, frozenset)
    got = [sorted(map(tuple, pii.mentions(d, p).collect())) for p in (few, many)]
    assert got[0] == got[1] and {k for _, k, *_ in got[0]} == {"name", "email"}
    clean = [sorted(map(str, pii.redacted(d, p).collect())) for p in (few, many)]
    assert clean[0] == clean[1] and any("Helen Hart and with [NAME]" in c for c in clean[0])


def test_poisson():
    for rate, cap in ((0.3, 1), (1.5, 2), (3.0, 8), (900.0, 1000), (900.0, 5), (2.5e5, 10**12)):
        first, cdf = mixture.poisson_steps(rate, cap)
        assert first + len(cdf) <= cap and np.all(np.diff(cdf) >= 0) and len(cdf) < 30 * rate**0.5 + 100
        if cap > 2 * rate + 5:
            mean = first + (1 - cdf).sum()
            assert abs(mean - rate) < 1e-4 * rate and cdf[-1] > 1 - 1e-6
    assert abs(mixture.poisson_steps(3.0, 8)[1][2] - math.exp(-3) * (1 + 3 + 4.5)) < 1e-12


def test_draw_meets_the_goal_within_a_document():
    rng = random.Random(4)
    for n, cap, part in ((3, 5, 0.5), (1, 3, 0.4), (40, 2, 0.7), (2000, 4, 0.33), (2000, 1, 0.5), (500, 1000, 0.9), (500, 10**9, 1e-6)):
        held, biggest = np.zeros(mixture.GRID + 1, dtype=np.int64), 0
        steps = [(rng.randrange(mixture.GRID), rng.randrange(20, 300)) for _ in range(n)]
        for step, size in steps:
            held[step + 1] += size
            biggest = max(biggest, held[step + 1])
        total = int(held.sum())
        first, edges = mixture.solve(np.cumsum(held), cap, part * cap * total)
        copies = [first + sum(s >= e for e in edges) for s, _ in steps]
        assert max(copies) <= cap and abs(sum(c * t for c, (_, t) in zip(copies, steps, strict=True)) - part * cap * total) <= biggest
    assert mixture.solve(np.zeros(mixture.GRID + 1, dtype=np.int64), 3, 5.0) == (0, [])


def test_mixture(spark):
    rng = random.Random(2)
    docs = [(i, "abc"[min(2, i % 10 // 4)], " ".join(rng.choices(["shoe", "court", "grip", "lace"], k=rng.randrange(20, 60)))) for i in range(3000)]
    docs += [(9000, "a", docs[0][2]), (9001, "a", None), (9002, "a", " "), (9003, None, "x"), (9004, "other", "x"), (9005, "d", "one small text " * 9), (9006, "d", "another small text " * 9)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("copies", F.lit(1))
    t = spark.createDataFrame([("a", 0.2, 1), ("b", 0.3, 2), ("c", 0.45, 4), ("empty", 0.05, 3), ("d", 0.001, 500), (None, 0.5, 1), ("unused", 0.1, 0)], "source string, target_share double, max_repeats int")
    mixed = mixture.mixture(d, t)
    rows = mixed.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixture.mixture(d, t).collect()))
    assert {r.source for r in rows} == {"a", "b", "c", "d"} and not {r.doc_id for r in rows} & {9000, 9001, 9002, 9003, 9004}
    assert all(r.text == dict((i, x) for i, _, x in docs)[r.doc_id] for r in rows[:300]) and len(set((r.doc_id, r.copy_no) for r in rows)) == len(rows)
    got = {r.source: r for r in mixture.report(d, t).collect()}
    assert {s: sum(r.n_tokens for r in rows if r.source == s) for s in "abcd"} == {s: got[s].mixed_tokens for s in "abcd"}
    for s, want in (("a", 0.2), ("b", 0.3), ("c", 0.45), ("d", 0.001)):
        assert abs(got[s].actual_share - want / 0.951) < 0.0005 and got[s].most_repeats <= got[s].max_repeats
    assert got["empty"].mixed_tokens == 0 and got["unused"].mixed_tokens == 0
    short = {r.source: r for r in mixture.report(d, t, total_tokens=1e9).collect()}
    assert all(short[s].most_repeats == short[s].max_repeats for s in "abcd")
    stock = {r.source: r for r in mixture.report(d, t, total_tokens="stock").collect()}
    assert stock["a"].actual_share < 0.35 and stock["d"].most_repeats <= 500
    assert mixture.mixture(d.limit(0), t).count() == 0 and mixture.mixture(d, t.limit(0)).count() == 0


def page(i: int, host: str) -> tuple:
    rng = random.Random(i)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    body = [f"Zed Model {i} review", "Traction", f"{words(25)}.", f"{words(9)}", f"{words(14)}.", "Weight: 12 oz", "Pros: light, firm"]
    aside = [f"By Jo Doe · {i} comments · 3 min read", "Share this page now", f"Related: Other Pair {i}", f"fan{i}: {words(12)}", "Terms of use"]
    lines = [f"Welcome to {host} the place for every player who loves shoes and courts", "Home | Forum | Shop", body[0], aside[0], *body[1:], aside[1], *aside[2:]]
    return (i, host, f"https://{host}/reviews/zed-model-{i}/", 200, "\n".join(lines), "t", True)


KIND = "page_id bigint, source string, url string, status int, text string, fetched_at string, from_cache boolean"


def test_page_bodies(spark, monkeypatch):
    rows = [page(i, "one.example") for i in range(40)]
    again = [(100 + i, *rows[i][1:]) for i in range(20)]  # fetched again: no evidence of boilerplate
    odd = [(900, "one.example", None, 200, None, None, None), (901, "one.example", "u", 404, "gone", None, None), (902, None, None, 200, " \n", None, None), (903, "x.example", "https://x.example/", None, "<html><head><title>t</title></head><body><p></p></body></html>", None, None)]
    df = spark.createDataFrame(rows + again + odd, KIND).withColumn("runs", F.lit(1)).withColumn("line", F.lit(1))
    got: dict = {}
    for r in boilerplate.body_lines(df).collect():
        got.setdefault(r.page_id, set()).add(r.line_no)
    for i in [*range(40), *range(100, 120)]:
        assert got[i] == {2, 4, 5, 6, 7, 8, 9}, (i, got[i])
    assert not {900, 901, 902} & set(got)
    text = {r.page_id: r.text for r in boilerplate.main_text(df).collect()}
    assert text[3].startswith("Zed Model 3 review\nTraction\n") and "Welcome" not in text[3]
    assert boilerplate.body_lines(df.limit(0)).count() == 0
    # Runs too many to send to all, and hosts of several blocks: the same rows.
    want = sorted(map(tuple, boilerplate.body_lines(df).collect()))
    assert sorted(map(tuple, boilerplate.body_lines(df, broadcast_runs=1).collect())) == want
    monkeypatch.setattr(boilerplate, "BLOCK_PAGES", 10)
    assert sorted(map(tuple, boilerplate.body_lines(df, broadcast_runs=1).collect())) == want
    # Neither the url nor the host's name decides.
    nameless = df.withColumn("url", F.xxhash64("url").cast("string"))
    assert sorted(map(tuple, boilerplate.body_lines(nameless).collect())) == want


def test_markup_is_told_anywhere():
    for start in (" " * 300, "<?xml version='1.0'?>\n", "<!-- note -->\n", ""):
        shown = boilerplate.visible(start + "<div>\n<head><title>x</title>\n</head>\n<table><tr><th>Cut</th><td>mid</td></tr>\n<p>a &amp; b</p></div>")
        assert [s for s in shown if s] == ["Cut: mid", "a & b"]
    assert boilerplate.visible("a < b\n3 > 2 &lt; 5") == ["a < b", "3 > 2 < 5"]


def test_runs_counted_over_all_blocks(spark, monkeypatch):
    """Runs and short lines just over and under the limit, in blocks that hold one or two of them at most."""
    rng = random.Random(8)
    words = lambda n: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))
    rare = {words(12): 4, words(4): 4, words(15): 3, words(5): 3}  # the limit is 4 of 200 pages
    held = {i: [words(30)] for i in range(200)}
    for line, n in rare.items():
        for i in rng.sample(range(200), n):
            held[i].append(line)
    rows = [(i, "h", f"https://h/{i}", "\n".join(lines)) for i, lines in held.items()]
    df = spark.createDataFrame(rows * 3, "page_id int, source string, url string, text string")
    want = {int(boilerplate._hashes(c, 12)[0]) if len(c) == 12 else boilerplate._line_hash(c) for line, n in rare.items() if n == 4 for c in boilerplate.page_lines(line)[1]}
    for pages, chars in ((256, 4_000_000), (10, 4_000_000), (256, 2_500)):
        monkeypatch.setattr(boilerplate, "BLOCK_PAGES", pages)
        monkeypatch.setattr(boilerplate, "BLOCK_CHARS", chars)
        found = boilerplate.repeated_runs(boilerplate.in_blocks(df)).collect()
        assert {(r.source, r.run) for r in found} == {("h", w) for w in want} and len(found) == len(want)


def test_suffix_array_against_brute_force():
    import numpy as np

    rng = random.Random(4)
    streams = [np.array([rng.randrange(3) for _ in range(rng.randrange(0, 40))], dtype=np.uint64) for _ in range(12)]
    order, group, owner = boilerplate.suffix_groups(streams, 5)
    starts = np.cumsum([0, *[len(s) for s in streams]])
    flat = np.concatenate(streams)
    want: dict = {}
    for i, s in enumerate(streams):
        for j in range(len(s) - 4):
            want.setdefault(tuple(s[j : j + 5]), set()).add((i, int(starts[i] + j)))
    got: dict = {}
    for p, g, o in zip(order, group, owner, strict=True):
        got.setdefault(int(g), set()).add((int(o), int(p)))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert [tuple(flat[p : p + 5]) for p in order] == sorted(tuple(flat[p : p + 5]) for p in order)
