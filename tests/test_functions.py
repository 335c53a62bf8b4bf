"""Golden pairs of the column functions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from courtmill.functions import naming, ranking, text, units, vectors, vocab


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(build(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(("said", "oz", "g"), [("13.9 oz", 13.9, 394.1), ("366g", 12.91, 366.0), ("12.9 oz / 366g", 12.9, 365.7), ("none", None, None), (None, None, None)])
def test_weight(spark, said, oz, g):
    r = one(spark, said, units.weight)
    assert (r["oz"], r["g"]) == (oz, g)


@pytest.mark.parametrize(("said", "mm"), [("8 mm", 8.0), ("28.9mm", 28.9), (" 7 ", 7.0), ("no number", None)])
def test_millimetres(spark, said, mm):
    assert one(spark, said, units.millimetres) == mm


@pytest.mark.parametrize(("said", "cents"), [("$120", 12000), ("129.99", 12999), ("$1,299", 100), ("free", None)])
def test_cents(spark, said, cents):
    assert one(spark, said, units.usd_cents) == cents


@pytest.mark.parametrize(("said", "limit"), [("$180+", None), ("$150", 150.0), ("", None), (None, None)])
def test_budget(spark, said, limit):
    assert one(spark, said, units.budget) == limit


@pytest.mark.parametrize(
    ("build", "said", "want"),
    [
        (vocab.cut_height, "Low-cut", "low"),
        (vocab.cut_height, "High Top", "high"),
        (vocab.cut_height, "Below ankle", "low"),
        (vocab.width_fit, "Medium", "standard"),
        (vocab.width_fit, "Fits narrow feet", "narrow"),
        (vocab.length_fit, "True to size", "true_to_size"),
        (vocab.length_fit, "Slightly small", "slightly_small"),
        (vocab.length_fit, "Runs large", "runs_large"),
        (vocab.outdoor, "decent", "fair"),
        (vocab.surface, "Indoor", "bad"),
        (vocab.positions, "PG/SG", ["guard"]),
        (vocab.positions, "SF, PF", ["wing", "big"]),
        (vocab.playstyles, "Slasher;Shooter", ["slasher", "shooter"]),
        (vocab.tags_in, "a quick guard, no posters", ["guard", "speedster"]),
        (vocab.tags_in, "c safeguard", []),
        (text.without_advertising, "Great. We may earn a commission if you buy", "Great."),
        (naming.review_title, "GT Cut 3 Performance Review ", "GT Cut 3"),
        (naming.version, "GT Cut 3", "3"),
        (naming.version, "GT Cut", None),
    ],
)
def test_vocabulary(spark, build, said, want):
    assert one(spark, said, build) == want


def test_brands_and_keys(spark):
    pairs = [("Nike G.T. Cut 3", "Nike", "G.T. Cut 3"), ("Air Jordan 39", "Jordan", "39"), ("Mystery Shoe 5", None, "Mystery Shoe 5"), ("Way of Wade 11", "Li-Ning", "Way of Wade 11")]
    for name, brand, model in pairs:
        r = one(spark, name, naming.split_brand)
        assert (r["brand"], r["model"]) == (brand, model)
    same = [("GT Cut 3", "G.T. Cut 3"), ("D.O.N. Issue #6", "DON Issue 6"), ("XXXVIII", "38"), ("Zer0.4", "Zero.4"), ("Ja v2", "Ja 2"), ("T-Mac Millenium", "T-Mac Millennium"), ("MB.01 Lo", "MB 01 Low"), ("Two Way", "Two WXY"), ("Kobe AD 360", "Kobe 360"), ("Fly.By", "fly by"), ("Air Zoom X", "Zoom X")]
    for a, b in same:
        keys = [one(spark, x, lambda t: naming.model_key(F.lit("Nike"), t)) for x in (a, b)]
        assert keys[0] == keys[1], (a, b, keys)
    assert one(spark, "Way of Wade 11", lambda t: naming.model_key(F.lit("Li-Ning"), t)) == "11"


def test_shortened_and_summary(spark):
    assert one(spark, "a  b c", lambda t: text.shortened(t, 180)) == "a b c"
    long = one(spark, "x" * 200, lambda t: text.shortened(t, 180))
    assert len(long) == 180 and long.endswith("…")
    assert one(spark, " ", lambda t: text.query_text(t, F.lit(""))) == "Basketball shoe recommendation."


def test_split_text():
    assert text.split_text("") == [] and text.split_text(" a ") == ["a"]
    assert [len(p) for p in text.split_text("x" * 3100)] == [1500, 1500, 100]
    paragraphs = "\n\n".join("p%d " % i + "w" * 600 for i in range(6))
    pieces = text.split_text(paragraphs)
    assert all(len(p) <= 1500 for p in pieces) and "".join(pieces).replace("\n", "") == paragraphs.replace("\n", "")


def test_seed(spark):
    request = {"aesthetic": None, "brand": None, "budget": 150.0, "cut": None, "outdoor": None, "playstyle": "slasher", "playstyle_tag": None, "position": None, "width": None}
    cols = {k: F.lit(v).cast("double" if k == "budget" else "string") for k, v in request.items()}
    seed = spark.range(1).select(ranking.request_seed(**cols).alias("s")).first()["s"]
    assert int(seed) == ranking.seed_of(request) == 14264700552075638046


def test_pick():
    equals = [(1.0, i) for i in range(5)]
    assert ranking.pick(equals, 3, 42) == random.Random(42).sample([4, 3, 2, 1, 0], 3) == [4, 0, 2]
    assert ranking.pick([(0.9, 1), (0.8, 2), (0.7, 3)], 2, 1) == [1, 2]
    assert ranking.pick([], 3, 1) == [] and ranking.pick(equals, 0, 1) == []


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), (None,), ([1.0],)], "v array<double>")
    rows = [r.s for r in df.select(vectors.similarity(vectors.cosine_distance(F.col("v"), [2.0, 0.0])).alias("s")).collect()]
    assert rows == [1.0, 0.0, 0.0, 0.0]
