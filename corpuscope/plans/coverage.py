"""Subtopic coverage: how a taxonomy is covered by labelled items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from corpuscope.functions.scalars import duration_minutes, numeric
from corpuscope.operators.filters import coverage_flags, explode_values, invalid_values, valid_values
from corpuscope.operators.ordered import medians
from corpuscope.session import materialise

CATEGORIES = "matching_categories"


def exploded(items: DataFrame, key: str = "video_id") -> DataFrame:
    return explode_values(items, CATEGORIES, "category", key)


def category_frequency(items: DataFrame, taxonomy: DataFrame, key: str = "video_id") -> DataFrame:
    """Mentions of each known category."""
    known = valid_values(exploded(items, key), "category", taxonomy)
    return known.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def frequency_totals(frequency: DataFrame) -> DataFrame:
    return frequency.agg(F.count(F.lit(1)).alias("categories"), F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"))


def invalid_frequency(items: DataFrame, taxonomy: DataFrame, key: str = "video_id") -> DataFrame:
    """Mentions of each category the taxonomy does not know."""
    unknown = invalid_values(exploded(items, key), "category", taxonomy)
    return unknown.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def coverage_counts(items: DataFrame, known: Sequence[str]) -> DataFrame:
    """Items in total, without any category, and with unknown categories only; one pass."""
    flags = coverage_flags(F.col(CATEGORIES), known)
    return items.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(flags["no_category"]).alias("no_category"),
        F.count_if(flags["only_invalid"]).alias("only_invalid"),
    )


def missing_categories(items: DataFrame, taxonomy: DataFrame, key: str = "video_id") -> DataFrame:
    """Categories of the taxonomy that no item names."""
    seen = exploded(items, key).select("category").distinct()
    return taxonomy.select("category").distinct().join(seen, "category", "left_anti")


def category_engagement(items: DataFrame, taxonomy: DataFrame, videos: DataFrame, key: str = "video_id") -> DataFrame:
    """Exact median views, likes, comments and minutes per known category.

    Junk values are skipped column by column; a video counts once per mention.
    """
    facts = videos.select(
        key, numeric(F.col("view_count")).alias("median_views"), numeric(F.col("like_count")).alias("median_likes"),
        numeric(F.col("comment_count")).alias("median_comments"),
        duration_minutes(F.col("duration")).alias("median_minutes"),
    )
    known = valid_values(exploded(items, key), "category", taxonomy)
    # The medians read the mentions several times, so they are written once.
    joined = materialise(known.join(facts, key).drop(key), "mentions")
    return medians(joined, ["median_views", "median_likes", "median_comments", "median_minutes"], ["category"])


def report(items: DataFrame, taxonomy: DataFrame, known: Sequence[str], key: str = "video_id") -> DataFrame:
    """All coverage figures as (section, name, n) rows from one stored read of the items."""
    items = materialise(items.select(key, CATEGORIES), "items")
    rows = lambda section, df: df.select(F.lit(section).alias("section"), F.col("category").alias("name"), "n")
    counts = coverage_counts(items, known)
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in counts.columns])
    missing = missing_categories(items, taxonomy, key).withColumn("n", F.lit(0).cast("bigint"))
    return (
        counts.select(F.lit("items").alias("section"), F.explode(cells).alias("c")).select("section", "c.*")
        .unionByName(rows("known", category_frequency(items, taxonomy, key)))
        .unionByName(rows("unknown", invalid_frequency(items, taxonomy, key)))
        .unionByName(rows("missing", missing))
    )
