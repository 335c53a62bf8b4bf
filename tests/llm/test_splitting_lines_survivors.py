"""Splitting, site lines and survivorship against brute force and on awkward rows."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from courtmill.llm import sitelines, splitting, survivorship


def check_pieces(text: str, limit: int, overlap: int) -> None:
    pieces = splitting.cut(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in pieces)
    for (a, b), (c, d) in zip(pieces, pieces[1:], strict=False):
        assert a < c <= b < d
        assert abs((b - c) - min(overlap, b)) <= splitting.SLACK or b - c <= overlap + splitting.SLACK


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n\r\t。é", min_size=201, max_size=1500))
def test_pieces_cover_the_text(text):
    text = text.strip(" \t\r\n")
    if len(text) > 200:
        check_pieces(text, 200, 30)


def test_boundaries_and_long_texts():
    assert splitting.cut("", 100, 10) == [] and splitting.cut("abc", 100, 10) == [(0, 3)]
    prose = ("A sentence of some words here. " * 40 + "\n\n") * 3
    for a, b in splitting.cut(prose.strip(), 1500, 150)[:-1]:
        assert prose[:b].rstrip(" \n").endswith(".") and a < b
    check_pieces("x" * 400_000, 1500, 150)
    check_pieces(" ".join(["word"] * 100_000), 1500, 150)
    for marks in ("a" + "\u0301" * 4000, "\u200d" * 5000, "x " * 700 + "\u0301" * 4000 + " y" * 700):
        check_pieces(marks, 1500, 150)
        check_pieces(marks, 12, 0)
    for a, b in splitting.cut("e\u0301" * 3000, 1500, 150):
        assert a % 2 == 0 and b % 2 == 0


def test_split_rows(spark):
    df = spark.createDataFrame([(1, None), (2, " \r\n"), (3, "  short  "), (4, "w " * 2000), (4, "w " * 2000)], "id bigint, t string").withColumn("piece", F.lit("clash")).withColumn("key_0", F.lit(0))
    rows = splitting.split_oversized(df, ["id"], "t").collect()
    assert {r.id for r in rows} == {3, 4} and [r.piece for r in rows if r.id == 3] == ["short"]
    assert len({(r.piece_no, r.start_pos) for r in rows if r.id == 4}) * 2 == sum(r.id == 4 for r in rows)
    assert splitting.split_oversized(df.limit(0), ["id"], "t").count() == 0


LINES = "ord bigint, source string, review_text array<string>, site string, k1 int"


def site_rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        source = rng.choice(["hot", "hot", "a", "b", None])
        lines = [f"own line {rng.randrange(10**9)}"]
        if source == "hot" and rng.random() < 0.6:
            lines.append("  Legal \t NOTICE ")
        if source == "a" and rng.random() < 0.5:
            lines += ["share this", "share  this"]
        if source == "b" and rng.random() < 0.5:
            lines.append("share this")
        if rng.random() < 0.03:
            lines.append("common phrase")
        rows.append((i, source, [None, "\n".join(lines), ""], "x", 1))
    return rows


def test_site_lines_match_counts(spark):
    rows = site_rows()
    df = spark.createDataFrame(rows, LINES)
    normal = lambda s: " ".join(s.replace("\t", " ").replace("\r", " ").split(" ")).strip().lower()
    squeeze = lambda s: " ".join(normal(s).split())
    seen: dict = {}
    for o, s, segments, *_ in rows:
        for segment in segments:
            for line in (segment or "").split("\n"):
                if squeeze(line):
                    seen.setdefault((s, squeeze(line)), set()).add(o)
    often = {k for k, v in seen.items() if len(v) >= 15}
    want = {(o, i, j) for o, s, segments, *_ in rows for i, seg in enumerate(segments) for j, line in enumerate((seg or "").split("\n")) if (s, squeeze(line)) in often}
    got = {tuple(r) for r in sitelines.repeated_occurrences(df).collect()}
    assert got == want and len(often) == 3
    kept = {r.ord: r for r in sitelines.strip_repeated_lines(df).collect()}
    assert len(kept) == 400 and all("legal" not in (seg or "").lower() for r in kept.values() for seg in r.review_text)
    assert all(kept[o].review_text[1].split("\n")[0] == segs[1].split("\n")[0] for o, _, segs, *_ in rows)
    twice = {tuple(r) for r in sitelines.repeated_occurrences(df.unionByName(df)).distinct().collect()}
    assert twice == want
    assert sitelines.repeated_occurrences(df.limit(0)).count() == 0


def test_one_site_alone_has_its_own_background(spark):
    rows = [(i, "only", [f"line {i}\nfooter"], "x", 1) for i in range(60)]
    got = sitelines.repeated_occurrences(spark.createDataFrame(rows, LINES)).collect()
    assert {(r.ord, r.line_no) for r in got} == {(i, 1) for i in range(60)}


def test_ratio_rejects_what_is_common_everywhere(spark):
    """A phrase in 5 % of the records of every source is no site line, though one source has it in 20 of them."""
    rows = [(i, "big", [f"line {i}" + ("\nfits true to size" if i % 20 == 0 else "") + ("\nbig's notice" if i % 20 == 1 else "")], "x", 1) for i in range(400)]
    rows += [(1000 + i, f"s{i // 40}", [f"line {i}" + ("\nfits true to size" if i % 20 == 0 else "")], "x", 1) for i in range(2400)]
    df = spark.createDataFrame(rows, LINES)
    excess = sitelines.excess_lines(df).collect()
    assert [(r.site, r.n) for r in excess] == [("big", 20)]
    assert {r.ord for r in sitelines.repeated_occurrences(df).collect()} == {i for i in range(400) if i % 20 == 1}


def test_instants(spark):
    same = ["2024-05-11T08:21:59+00:00", "2024-05-11T08:21:59Z", "2024-05-11 08:21:59", "2024-05-11T03:21:59-05:00", "2024/05/11 08:21:59", " 2024-05-11t08:21:59z", "2024-05-11T13:51:59+0530", "2024-05-11 08:21:59 UTC"]
    rows = spark.createDataFrame([(s,) for s in [*same, "", None, "soon"]], "s string").select(survivorship.instant(F.col("s")).alias("i")).collect()
    assert len({r.i for r in rows[: len(same)]}) == 1 and [r.i for r in rows[len(same) :]] == [None, None, None]
    assert spark.createDataFrame([("2024-05-11",)], "s string").select(survivorship.instant(F.col("s")).alias("i")).first().i is not None


def test_survivors(spark):
    link = "array<struct<source:string,url:string,fetched_at:string>>"
    late, early = "2024-01-02T00:00:00Z", "2024-01-01T23:30:00-01:00"
    canonical = spark.createDataFrame(
        [("x", [("a", "u", late), ("b", "u", ""), ("b", "u", ""), ("zz", "u", None)], 1), ("one", [("c", "u", "")], 2), ("none", None, 3), ("bad", [("d", "u", ""), ("d", "v", "")], 4)],
        f"canonical_id string, sources {link}, ord int",
    )
    records = spark.createDataFrame(
        [(1, "a", "u", late, None, 12.0), (2, "a", "u", late, 100, 12.5), (3, "b", "u", "", 9000, 31.0), (4, "b", "u", "", 9000, None), (5, "zz", "u", None, 2000, 5.0), (6, "c", "u", "", 5000, 10.0), (7, "d", "u", "", 1999, 4.9), (8, "d", "v", "", 60001, None)],
        "ord bigint, source string, url string, fetched_at string, msrp_usd_cents int, weight_oz double",
    )
    registry = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "source string, trust_rank int")
    best = survivorship.survivors(canonical, records, registry)
    assert {tuple(r) for r in survivorship.winning_rows(best).collect()} == {("x", "msrp_usd_cents", 3), ("x", "weight_oz", 1)}
    rebuilt = {r.canonical_id: r for r in survivorship.rebuilt(best).collect()}
    assert rebuilt["x"].msrp_usd_cents == 9000 and rebuilt["x"].provenance["weight_oz"]["source"] == "a" and rebuilt["x"].n_records == 5
    assert rebuilt["bad"].msrp_usd_cents is None and rebuilt["bad"].provenance == {} and "none" not in rebuilt
    assert survivorship.survivors(canonical.limit(0), records, registry).count() == 0
    assert survivorship.survivors(canonical, records.limit(0), registry.limit(0)).count() == 0
    other = survivorship.survivors(canonical, records.withColumns({"seen": F.col("url"), "trust_rank": F.lit(9)}), registry, ("seen",), {})
    assert {r.canonical_id: r.seen["value"] for r in other.collect()}["x"] == "u"
    assert early < late
