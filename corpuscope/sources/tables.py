"""Readers with declared schemas, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpuscope import schemas
from corpuscope.functions.text import strip


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = schemas.SUBTOPICS,
               list_column: str = "matching_categories") -> DataFrame:
    """One JSON object per line; a missing list becomes an empty one."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn(list_column, F.coalesce(F.col(list_column), F.array().cast(schema[list_column].dataType)))


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of keywords to a one-column frame."""
    return explode_keywords(spark.read.text(path, wholetext=True), "value")


def explode_keywords(df: DataFrame, column: str) -> DataFrame:
    """JSON arrays in a text column to one keyword per row."""
    return df.select(F.explode(F.from_json(column, "array<string>")).alias("keyword"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.PREDICTIONS) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, escape='"')


def read_ids(spark: SparkSession, path: str, key: str = "video_id") -> DataFrame:
    """One id per line, blank lines skipped."""
    return spark.read.text(path).select(strip(F.col("value")).alias(key)).where(F.col(key) != "")


def read_embeddings(spark: SparkSession, path: str, key: str = "video_id", vector: str = "embedding") -> DataFrame:
    """Vectors addressed by id."""
    return spark.read.parquet(path).select(key, F.col(vector).cast("array<float>").alias(vector))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def replace_table(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    """One dataset for all splits, partitioned so that a reader prunes to its own."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, split: str, column: str = "split") -> DataFrame:
    return spark.read.parquet(path).where(F.col(column) == split).drop(column)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Managed table bucketed by ``key``: later joins and upserts on it need no shuffle of this side."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
