"""The command line: ``python -m courtmill.cli report|upsert|chunks ...``, for spark-submit or a local session.

Exit code 0 is success, 1 a refused or failed run, 2 wrong arguments. With ``--dry-run`` nothing is written.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtmill import schemas, tables
from courtmill.operators import browse, chunks, report, resolve, upsert
from courtmill.session import get_spark, ship
from courtmill.sources import models


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table: a staging file of JSON lines under its schema, or parquet."""
    return tables.read_staging(spark, path, schema) if path.endswith(".json") and schema else spark.read.parquet(path)


def run_report(spark: SparkSession, args: argparse.Namespace) -> None:
    records, registry = _read(spark, args.records, schemas.SOURCE_RECORD), spark.read.parquet(args.registry)
    if args.source:
        records = records.filter(F.col("source").isin(args.source))
    keyed = resolve.keyed(records)
    pairs = resolve.ambiguous(resolve.key_order(resolve.prioritised(keyed, registry)))
    canonical = resolve.canonical(records, registry)
    if args.pilot:
        canonical = report.pilot(canonical, args.limit or 30)
    if args.staging and not args.dry_run:
        tables.write_staging(resolve.in_output_order(canonical), f"{args.staging}/canonical.json")
        tables.write_staging(resolve.pairs_in_output_order(pairs), f"{args.staging}/ambiguous.json")
    print(report.coverage_text(canonical, records, resolve.unmatched(keyed), pairs))


def run_upsert(spark: SparkSession, args: argparse.Namespace) -> None:
    batch = browse.catalog_columns(_read(spark, args.canonical, schemas.CANONICAL))
    now = F.lit(args.now).cast("timestamp_ntz") if args.now else F.localtimestamp()
    if args.dry_run:
        old = spark.read.parquet(f"{args.catalog}/version={args.version - 1}")
        print(upsert.counters(upsert.actions(old, batch)).first().asDict())
    else:
        print(upsert.upsert_batch({"catalog": args.catalog}, batch, now, args.version))


def run_chunks(spark: SparkSession, args: argparse.Namespace) -> None:
    shoes, index = spark.read.parquet(args.catalog), spark.read.parquet(args.index)
    if args.limit:
        shoes = shoes.orderBy("id").limit(args.limit)
    desired = chunks.built(shoes)
    synced = chunks.sync(index.limit(0) if args.refresh else index, desired, args.model)
    print(chunks.counters(synced).first().asDict())
    if args.dry_run:
        return
    if not args.out:
        raise ValueError("--out names the folder of the next index")
    kept = index.join(synced.filter("action = 'keep'").select("id"), "id", "left_semi")
    new = chunks.embedded(synced.filter("action = 'embed'"), models.hash_embedder(), args.model, F.current_timestamp())
    kept.unionByName(new.withColumn("id", F.xxhash64("shoe_id", "content", F.coalesce("source", F.lit("")), "model_id")), allowMissingColumns=True).write.mode("errorifexists").parquet(args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="courtmill")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("report", help="resolve records and print their coverage")
    one.add_argument("--records", required=True)
    one.add_argument("--registry", required=True)
    one.add_argument("--source", action="append")
    one.add_argument("--pilot", action="store_true")
    one.add_argument("--staging")
    one.add_argument("--limit", type=int)
    one.set_defaults(run=run_report)
    two = commands.add_parser("upsert", help="make the catalogue equal to canonical shoes")
    two.add_argument("--canonical", required=True)
    two.add_argument("--catalog", required=True, help="folder of snapshots, version=N below it")
    two.add_argument("--version", type=int, required=True, help="the snapshot to write")
    two.add_argument("--now")
    two.set_defaults(run=run_upsert)
    three = commands.add_parser("chunks", help="bring the chunk index in step with the catalogue")
    three.add_argument("--catalog", required=True)
    three.add_argument("--index", required=True)
    three.add_argument("--model", default="words")
    three.add_argument("--limit", type=int)
    three.add_argument("--refresh", action="store_true")
    three.add_argument("--out")
    three.set_defaults(run=run_chunks)
    for p in (one, two, three):
        p.add_argument("--dry-run", action="store_true")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    for name in ("records", "registry", "canonical", "index"):
        path = getattr(args, name, None)
        if path and "://" not in path and not Path(path).exists():
            print(f"{name}: {path} does not exist", file=sys.stderr)
            return 1
    session = spark or get_spark("courtmill")
    ship(session)
    try:
        args.run(session, args)
    except Exception as error:
        print(f"{type(error).__name__}: {str(error)[:500]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
