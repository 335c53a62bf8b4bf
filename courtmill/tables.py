"""Readers and writers of the catalogue's tables, and the staging files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_staging(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A staging table, replaced as a whole."""
    df.write.mode("overwrite").format(fmt).save(path)


def read_staging(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """A staging table under its declared schema (DDL); nothing is inferred."""
    return spark.read.schema(schema).format(fmt).load(path)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """A database table; with ``key`` and (lowest, highest, parts) it is read in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if key and bounds:
        low, high, parts = bounds
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, name: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", name).mode("append").save()
