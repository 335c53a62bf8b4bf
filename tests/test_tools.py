"""Command line, saved pages, schedules and the coverage report."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from courtmill import cli
from courtmill.operators import report, resolve, search
from courtmill.sources import http
from courtmill.sources.saved import SavedPages
from courtmill.streaming import feedback


def test_saved_pages(spark, tmp_path):
    for i in range(450):
        (tmp_path / "big").mkdir(exist_ok=True)
        (tmp_path / "big" / f"{i}.json").write_text(json.dumps({"url": f"https://big.example/{i}", "status": 200, "text": "t", "fetched_at": "2025"}))
    (tmp_path / "small").mkdir()
    for name, body in (("a.json", "no json"), ("b.json", "[]"), ("c.json", '{"url": "https://s.example/", "status": null}'), ("d.txt", "x")):
        (tmp_path / "small" / name).write_text(body)
    spark.dataSource.register(SavedPages)
    pages = spark.read.format("saved_pages").load(str(tmp_path))
    assert pages.count() == 453 and pages.filter("error is not null").count() == 2 and pages.rdd.getNumPartitions() == 4
    assert spark.read.format("saved_pages").option("sources", "small").load(str(tmp_path)).filter("error is null").first().url == "https://s.example/"


def test_schedule_keeps_hosts_apart(spark):
    refs = spark.range(3000).select(F.concat(F.lit("https://"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), (F.col("id") % 50).cast("string"))), F.lit(".example/"), F.col("id").cast("string")).alias("url"))
    rows = http.schedule(refs).collect()
    assert len(rows) == 3000
    waits: dict = {}
    for r in rows:
        waits.setdefault(r.host, []).append(r.wait)
    assert all(b - a >= http.SPACING for w in waits.values() for a, b in zip(sorted(w), sorted(w)[1:], strict=False))
    assert max(waits["hot.example"]) < 1000 * (http.SPACING + http.JITTER)


def test_latest_only_and_podium(spark):
    asked = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 3, "c")], "user_id int, event_id int, q string")
    assert sorted(map(tuple, feedback.latest_only(asked).collect())) == [(1, 9, "b"), (2, 3, "c")]
    cards = spark.createDataFrame([(1,), (2,), (3,)], "place int")
    assert [r.place for r in search.podium(cards).orderBy("shown_at").collect()] == [2, 1, 3]


def test_command_line(spark, data, tmp_path, capsys):
    files = ["--records", f"{data}/source_record.parquet", "--registry", f"{data}/source_registry.parquet"]
    assert cli.main(["report", *files, "--staging", str(tmp_path / "s"), "--dry-run"], spark) == 0
    told = capsys.readouterr().out
    assert "COVERAGE REPORT" in told and "cross-source (>=2)" in told and not (tmp_path / "s").exists()
    shoes = spark.read.parquet(f"{data}/shoes.parquet")
    shoes.write.parquet(str(tmp_path / "catalog/version=0"))
    up = ["upsert", "--canonical", f"{data}/canonical_shoe.parquet", "--catalog", str(tmp_path / "catalog"), "--version", "1", "--now", "2027-01-01 00:00:00"]
    assert cli.main([*up, "--dry-run"], spark) == 0 and not (tmp_path / "catalog/version=1").exists()
    assert cli.main(up, spark) == 0 and cli.main(up, spark) == 0
    after = spark.read.parquet(str(tmp_path / "catalog/version=1"))
    assert after.count() == spark.read.parquet(f"{data}/canonical_shoe.parquet").count() and set(after.columns) == set(shoes.columns)
    sync = ["chunks", "--catalog", f"{data}/shoes.parquet", "--index", f"{data}/chunk_embedding.parquet", "--limit", "5"]
    assert cli.main([*sync, "--dry-run"], spark) == 0 and cli.main(sync, spark) == 1
    assert cli.main([*sync, "--out", str(tmp_path / "index")], spark) == 0 and spark.read.parquet(str(tmp_path / "index")).count() > 0
    assert cli.main(["report", "--records", "/none", "--registry", "/none"], spark) == 1


def test_report_text_of_nothing(spark, data):
    none = spark.read.parquet(f"{data}/canonical_shoe.parquet").limit(0)
    records = spark.read.parquet(f"{data}/source_record.parquet").limit(0)
    assert "canonical shoes: 0" in report.coverage_text(none, records, records, records)


def test_output_order(spark):
    rows = spark.createDataFrame([("b", "z"), ("B", "a"), ("b", "a")], "brand string, model_key string")
    assert [tuple(r) for r in resolve.in_output_order(rows).collect()] == [("B", "a"), ("b", "a"), ("b", "z")]
