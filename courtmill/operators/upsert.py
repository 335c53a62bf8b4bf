"""Upserts: the catalogue made equal to a batch, with stable ids and counted changes.

All ten value columns are compared, nested ones too; entries of maps in any order are equal. What is
shuffled for the comparison is an id and a digest of a row's values. A batch that holds an id twice fails
the job, and an empty batch, which would delete every shoe, must be allowed by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtmill.session import named

VALUES = ("brand", "name", "price", "currency", "image_url", "affiliate_url", "source_url", "specs", "extra_metadata")


def duplicates(batch: DataFrame) -> DataFrame:
    """(canonical_id, n): ids that a batch holds more than once; a batch must have none."""
    return batch.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _comparable(value: Column, kind: T.DataType) -> Column:
    """A value with its maps as sorted entries, so that equal values print alike."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_comparable(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _comparable(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _comparable(x, kind.elementType))
    return value.cast("string")


def _digest(df: DataFrame, values: tuple[str, ...]) -> Column:
    """128 bits of a row's values."""
    return F.md5(F.to_json(F.struct(*[_comparable(named(v), df.schema[v].dataType).alias(v) for v in values]), {"ignoreNullFields": "false"}))


def checked(batch: DataFrame) -> DataFrame:
    """The batch; an id that it holds more than once ends the job that reads it."""
    n = F.count(F.lit(1)).over(Window.partitionBy("canonical_id"))
    said = F.concat(F.lit("canonical_id twice in a batch: "), F.coalesce("canonical_id", F.lit("null")))
    counted = batch.withColumn("times", n)
    return counted.withColumn("canonical_id", F.when(F.col("times") > 1, F.raise_error(said)).otherwise(F.col("canonical_id"))).drop("times")


def actions(existing: DataFrame, batch: DataFrame, values: tuple[str, ...] = VALUES) -> DataFrame:
    """(canonical_id, id, action): insert, update, unchanged or delete; rows without a canonical id are deleted."""
    old = existing.select("id", F.col("canonical_id").alias("old_id"), _digest(existing, values).alias("old"))
    new = checked(batch.select("canonical_id", _digest(batch, values).alias("new"))).withColumnRenamed("canonical_id", "new_id")
    both = old.join(new, F.col("old_id") == F.col("new_id"), "full_outer")
    action = F.when(F.col("new_id").isNull(), "delete").when(F.col("id").isNull(), "insert").when(F.col("old") == F.col("new"), "unchanged").otherwise("update")
    return both.select(F.coalesce("new_id", "old_id").alias("canonical_id"), "id", action.alias("action"))


def counters(acted: DataFrame) -> DataFrame:
    """One row: inserted, updated, deleted, unchanged."""
    return acted.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("insert", "inserted"), ("update", "updated"), ("delete", "deleted"), ("unchanged", "unchanged"))])


def new_ids(acted: DataFrame, blocks: int = 1024) -> DataFrame:
    """(canonical_id, id) of inserts: ids after the greatest one, in order of canonical id within blocks.

    Rows are numbered within hashed blocks whose sizes give each block's start, so no single task sorts all.
    """
    top = acted.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = acted.filter("action = 'insert'").select("canonical_id", F.pmod(F.xxhash64("canonical_id"), F.lit(blocks)).alias("block"))
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))  # at most `blocks` rows
    starts = sizes.withColumn("start", F.sum("n").over(Window.orderBy("block")) - F.col("n")).drop("n")
    numbered = rows.withColumn("rn", F.row_number().over(Window.partitionBy("block").orderBy("canonical_id")))
    joined = numbered.join(F.broadcast(starts), "block").crossJoin(F.broadcast(top))  # at most `blocks` rows, and one row
    return joined.select("canonical_id", (F.col("top") + F.col("start") + F.col("rn")).alias("id"))


def applied(existing: DataFrame, batch: DataFrame, now: Column, values: tuple[str, ...] = VALUES, allow_empty: bool = False) -> DataFrame:
    """The next snapshot of the catalogue; write it beside the old one and swap."""
    if not allow_empty and batch.isEmpty():
        raise ValueError("an empty batch would delete every shoe; pass allow_empty")
    acted = actions(existing, batch, values)
    ids = acted.filter("action != 'delete'").select("canonical_id", F.col("id").alias("old_id"), "action").join(new_ids(acted).withColumnRenamed("id", "new_id"), "canonical_id", "left")
    times = existing.filter(F.col("canonical_id").isNotNull()).select("canonical_id", "created_at", "updated_at")
    rows = batch.join(ids, "canonical_id").join(times, "canonical_id", "left")
    changed = F.col("action") != "unchanged"
    return rows.select(F.coalesce("old_id", "new_id").alias("id"), "canonical_id", *values, F.coalesce("created_at", now).alias("created_at"), F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"))


def without_orphans(index: DataFrame, catalog: DataFrame) -> DataFrame:
    """The chunk index without rows of shoes that are gone."""
    return index.join(catalog.select(F.col("id").alias("shoe_id")), "shoe_id", "left_semi")


def upsert_batch(paths: dict[str, str], batch: DataFrame, now: Column, version: int) -> dict[str, int]:
    """Write the snapshot ``version`` of the catalogue from the one before, and return the counters.

    ``paths`` names the folder of the snapshots ("catalog"), one below it per version. A version that was
    written before, as after a restart, is left as it is, so a repeated call changes nothing.
    """
    spark = batch.sparkSession
    existing = spark.read.parquet(f"{paths['catalog']}/version={version - 1}")
    done = f"{paths['catalog']}/version={version}"
    counted = counters(actions(existing, batch)).first().asDict()
    if counted["inserted"] + counted["updated"] + counted["unchanged"] == 0 and counted["deleted"]:
        raise ValueError("an empty batch would delete every shoe")
    applied(existing, batch, now).write.mode("ignore").parquet(done)
    return counted
