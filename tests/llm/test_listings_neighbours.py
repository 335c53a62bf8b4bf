"""Listing groups and nearest vectors."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from courtmill.llm import listings, neighbours

KIND = "ord bigint, source string, url string, model_raw string, brand string"
BASES = "tarobeki vozafine zikebado fefotebe nolorina sezojama pikajita lofehini gihelipe bozatori".split()
SUFFIXES = "rally vertex comet ridge ember".split()
NOISE = ["SALE", "Ships today", "12mm drop", "340 grams", "US 9", "ice blue", "2021 release", "Best seller"]


def titles(seed: int = 1) -> tuple[list[tuple], dict[int, tuple]]:
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(600):
        b = rng.randrange(len(BASES))
        brand = "Norvica" if b % 2 else "Port Ember"
        version, cut, youth = rng.choice([0, 2, 5]), rng.choice(["", "low", "mid"]), rng.random() < 0.2
        how = {0: "", 2: rng.choice(["2", "v2", "Gen 2", "II", "#2"]), 5: rng.choice(["5", "V", "Vol. 5", "v.5"])}[version]
        name = f"{BASES[b]} {SUFFIXES[b % 5]}".title()
        if rng.random() < 0.05:
            at = rng.randrange(1, 6)
            name = name[:at] + name[at + 1] + name[at] + name[at + 2 :] if name[at] != name[at + 1] else name
        where = {"": "", "low": rng.choice(["Low", "low-top", "Lo"]), "mid": "Mid Cut"}[cut]
        shown = " ".join(x for x in (brand if rng.random() < 0.8 else "", name, how, where, rng.choice(["GS", "Youth", "Kids'"]) if youth else rng.choice(["", "Men's", "Women's"]), "Basketball Shoe") if x)
        title = rng.choice([" | ", " / ", ", "]).join([shown, *rng.sample(NOISE, 2)])
        rows.append((i, f"s{i % 5}", f"u{i}", title, brand if rng.random() < 0.8 else None))
        truth[i] = (b, version, cut, youth)
    return rows, truth


def test_groups(spark):
    rows, truth = titles()
    extra = [(900, "s", "u", None, None), (901, "s", "u", " ", "Norvica"), (902, "s", "a", "Insole set for Norvica Vozafine Vertex 2", "Norvica"), (903, "s", "a", "Insole set for Norvica Vozafine Vertex 2", "Norvica"), (904, "s", "b", "Heel grips for Norvica Vozafine Vertex 2", None), (905, "s", "c", "x" * 50_000, None)]
    df = spark.createDataFrame(rows + extra, KIND).withColumn("word", F.lit(1)).withColumn("group_id", F.lit("clash"))
    group = {r.ord: r.group_id for r in listings.groups(df).collect()}
    assert not {900, 901} & set(group) and group[902] == group[903] != group[904]
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    got = {(r.ord_a, r.ord_b) for r in listings.matching_pairs(listings.groups(df)).collect()} - {(902, 903)}
    assert len(want & got) / len(want) > 0.97 and len(want & got) / len(got) > 0.97
    assert listings.groups(df.limit(0)).count() == 0


def test_accessories_are_told_by_what_they_are_for():
    for title in ("Shoe bag - fits NORVICA Vozafine Vertex 2", "Laces: compatible with Zed 3", "Insole set for Zed 3", "Heel grips to fit Zed"):
        assert listings.Parser.accessory(title)
    for title in ("Norvica Vozafine Vertex for men", "Norvica Vertex for women, red", "Norvica Zed 3 low, for outdoor courts"):
        assert not listings.Parser.accessory(title)


def test_titles_without_a_head_take_their_best_combination(spark):
    """Lines whose second word has one partner only, words in between and brands of two words."""
    rows = [(i, "s", f"u{i}", t, "Oak Town") for i, t in enumerate(["Oak Town Zumo Prellix Kardan 3 | red", "zumo prellix kardan 3 by Oak Town", "Zumo Prellix Kardan v3, sale", "Oak Town Melbrio Tandor 3 | red", "Melbrio Tandor 3 by Oak Town, sale", "Oak Town 7"])]
    group = {r.ord: r.group_id for r in listings.groups(spark.createDataFrame(rows, KIND)).collect()}
    assert group[0] == group[1] == group[2] != group[3] and group[3] == group[4] and len(set(group.values())) == 3


def test_pairs_of_large_groups(spark):
    df = spark.range(1500).select(F.col("id").alias("ord"), F.when(F.col("id") < 1200, "hot").otherwise(F.col("id").cast("string")).alias("group_id"))
    assert listings.matching_pairs(df).count() == 1200 * 1199 // 2
    assert listings.matching_pairs(df).distinct().filter("ord_a >= ord_b").count() == 0


VECTOR = "id bigint, model_id string, vector array<float>"


def brute(rows, k=5, least=0.9):
    out = set()
    spaces: dict = {}
    for i, m, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            spaces.setdefault((m, len(v)), {})[i] = np.array(v, dtype="f4").astype("f8")
    for members in spaces.values():
        ids = sorted(members)
        unit = np.stack([members[i] / np.linalg.norm(members[i]) for i in ids])
        s = np.round(unit @ unit.T, 9)
        np.fill_diagonal(s, -9)
        for i, row in enumerate(np.argsort(-s, axis=1, kind="stable")[:, :k]):
            out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in row if s[i, j] >= least}
    return out


def test_close_pairs_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        centre = np.random.default_rng(i % 200).normal(size=24)
        rows.append((i, "m", [float(x) for x in (centre + rng.normal(size=24) * rng.choice([0.05, 0.2, 1.0])) * rng.uniform(0.1, 9)]))
    rows += [(2000 + i, "m", rows[7][2]) for i in range(300)]  # one vector, many copies
    rows += [(3000, "m", None), (3001, "m", [0.0] * 24), (3002, "m", []), (3003, "m", [1.0] * 8), (3004, "m", [1.0] * 8), (3005, None, [1.0] * 8), (3006, "m", [float("nan")] * 24), (3007, "m", [None] * 24)]
    df = spark.createDataFrame(rows, VECTOR).withColumn("space", F.lit(1)).withColumn("v", F.lit(1))
    want, got = brute(rows), {(r.id_a, r.id_b) for r in neighbours.close_pairs(df).collect()}
    assert len(want & got) / len(want) >= 0.98 and len(want & got) / len(got) >= 0.99
    assert (3003, 3004) in got
    near = neighbours.neighbours(df).groupBy("id").agg(F.count("*").alias("n"), F.max("rank").alias("r")).agg(F.max("n").alias("n"), F.max("r").alias("r")).first()
    assert near.n == 5 and near.r == 5
    assert neighbours.close_pairs(df.limit(0)).count() == 0


def test_hilbert_is_a_walk():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = neighbours.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_heavy_keys_are_spread(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "m", [float(x) for x in np.ones(16) + rng.normal(size=16) * 1e-3]) for i in range(6000)]
    near = neighbours.neighbours(spark.createDataFrame(rows, VECTOR), min_similarity=0.9)
    assert near.groupBy("id").count().filter("count = 5").count() == 6000


def test_stream_keeps_every_window():
    """Batches of any size give the same finds as whole curves, each vector against its window on both sides."""
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(3000, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    frame = pd.DataFrame({"curve": np.sort(rng.integers(0, 3, 3000)), "id": np.arange(3000), "code": neighbours.to_bytes(unit)})
    decoded = neighbours.of_bytes(frame["code"].tolist())
    assert np.abs((decoded @ decoded.T) - unit @ unit.T).max() < neighbours.BYTE_ERROR
    want = set()
    for i in range(3000):
        near = [j for j in range(max(0, i - 40), min(3000, i + 41)) if j != i and frame["curve"][i] == frame["curve"][j] and decoded[i] @ decoded[j] >= 0.8]
        want |= {(i, j) for j in near}
    for size in (1, 700, 3000):
        parts = iter([frame.iloc[i : i + size] for i in range(0, 3000, size)] if size > 1 else [frame.iloc[:0], frame])
        old, neighbours.ROWS_AT_ONCE = neighbours.ROWS_AT_ONCE, 128
        try:
            rows = pd.concat(list(neighbours._along(parts, 40, 200, 0.8)))
        finally:
            neighbours.ROWS_AT_ONCE = old
        got = set(zip(rows["a"].tolist(), rows["b"].tolist(), strict=True))
        assert len(got) == len(rows) and len(got & want) / len(want) == 1.0
        assert all(neighbours.ROWS_AT_ONCE >= abs(i - j) - 40 for i, j in got)


def test_exact_queries_and_recall(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(150, 32))
    rows = [(i, "ab"[i % 2], [float(x) for x in centre[i % 150] + rng.normal(size=32) * 0.4]) for i in range(4000)]
    df = spark.createDataFrame(rows, VECTOR)
    asked = df.filter("id % 20 = 0").select("id")
    exact = {(r.id, r.rank): r.neighbour_id for r in neighbours.exact_neighbours(asked, df, at_once=60).collect()}
    unit = np.stack([np.array(v, dtype="f4").astype("f8") for _, _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for i in range(0, 4000, 20):
        s = np.round(unit @ unit[i], 9)
        s[i] = -9
        s[(i + 1) % 2 :: 2] = -9
        assert [exact[i, r] for r in range(1, 6)] == np.lexsort((np.arange(4000), -s))[:5].tolist()
    found = {(r.id, r.neighbour_id) for r in neighbours.neighbours(df).collect()}
    want = {(i, n) for (i, _), n in exact.items()}
    assert len(want & found) / len(want) >= 0.9
    assert neighbours.exact_neighbours(asked.limit(0), df).count() == 0
