"""Keyword frequencies, sampling weights, samples and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from corpuscope.fixed_values import KEYWORDS, TRAINING_SAMPLE_ROWS
from corpuscope.functions.hashing import hash_uniform
from corpuscope.functions.text import split_trim
from corpuscope.operators.ordered import positions


def keyword_dim(df: DataFrame, keywords: Sequence[str] = tuple(KEYWORDS)) -> DataFrame:
    """The keyword list as a one-column frame, made from a literal."""
    listed = F.explode(F.array(*[F.lit(k) for k in keywords]))
    return df.sparkSession.range(1).select(listed.alias("keyword"))


def keyword_counts(df: DataFrame, column: str, keywords: Sequence[str] = tuple(KEYWORDS)) -> DataFrame:
    """Occurrences of listed keywords in a comma list, found ones only.

    Each occurrence counts, also a repeated one in the same row.
    """
    found = df.select(F.explode(split_trim(F.col(column))).alias("keyword"))
    return found.where(F.col("keyword").isin(list(keywords))).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


def keyword_frequency(df: DataFrame, column: str, keywords: Sequence[str] = tuple(KEYWORDS)) -> DataFrame:
    """Occurrences of every listed keyword, zero where it never occurs."""
    counts = keyword_counts(df, column, keywords)
    return keyword_dim(df, keywords).join(counts, "keyword", "left").na.fill(0, ["n"])


def sampling_weights(df: DataFrame, column: str, keywords: Sequence[str] = tuple(KEYWORDS)) -> DataFrame:
    """Adds ``sampling_weight``: sum of 1/count over the row's listed keywords, normalised to 1.

    The counts have at most one entry per listed keyword, so they come back as one
    scalar map and no row is shuffled.
    """
    counts = keyword_counts(df, column, keywords)
    lookup = counts.agg(F.map_from_entries(F.collect_list(F.struct("keyword", "n"))).alias("m")).scalar()
    tagged = df.withColumn("_counts", lookup)
    parts = F.coalesce(split_trim(F.col(column)), F.array().cast("array<string>"))
    share = F.aggregate(
        parts, F.lit(0.0),
        lambda total, k: total + F.coalesce(1.0 / F.try_element_at(F.col("_counts"), k), F.lit(0.0)),
    )
    raw = tagged.withColumn("_raw", share).drop("_counts")
    total = raw.agg(F.sum("_raw").alias("t")).scalar()
    return raw.withColumn("sampling_weight", F.try_divide(F.col("_raw"), total)).drop("_raw")


def weighted_sample(df: DataFrame, key: str, weight: str, n: int = TRAINING_SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, chance by weight (exponential keys); zero weights never.

    Top-n of a keyed draw: each task keeps n rows, so only n per task travel.
    """
    clock = -F.ln(hash_uniform(F.col(key), seed=seed)) / F.col(weight)
    drawn = df.where(F.col(weight) > 0).withColumn("_clock", clock)
    return drawn.orderBy("_clock", key).limit(n).drop("_clock")


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones on any partitioning."""
    drawn = df.withColumn("_u", hash_uniform(F.col(key), seed=seed))
    return drawn.orderBy("_u", key).limit(n).drop("_u")


def stratified_split(df: DataFrame, key: str, label: str, fraction: float = 0.5, seed: int = 42,
                     names: tuple[str, str] = ("val", "test")) -> DataFrame:
    """Adds ``split``: the first round(fraction * n) rows of each class by seeded draw, and the rest.

    Exact sizes per class come from global positions, not from a window per class.
    """
    drawn = df.where(F.col(label).isNotNull()).withColumn("_u", hash_uniform(F.col(key), seed=seed))
    placed = positions(drawn, "_u", [key], by=[label])
    first = F.col("position") < F.round(F.col("group_n") * fraction)
    return placed.withColumn("split", F.when(first, names[0]).otherwise(names[1])).drop("_u", "position", "group_n")


def batch_label(df: DataFrame, prompt: str, scorer, reply: str = "reply") -> DataFrame:
    """Adds ``reply``: ``scorer`` maps a pandas Series of prompts to a Series of replies.

    The scorer runs per Arrow batch inside tasks; a served model or any function fits.
    """
    labeller = F.pandas_udf(scorer, "string")
    return df.withColumn(reply, labeller(F.col(prompt)))


def label_rejects(df: DataFrame, label: str) -> DataFrame:
    """Rows in total and rows whose reply was not a label."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label).isNull()).alias("rejected"))


