"""Valence and density of texts by a sentiment lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.operators.joins import dim_join


def tokens(col: Column) -> Column:
    """Lower-case letter runs and single other signs, as a word tokenizer gives them."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"[\p{L}\p{N}']+|[^\p{L}\p{N}'\s]"), F.lit(0))


def valence_density(df: DataFrame, key: str, text: str, lexicon: DataFrame, stopwords: DataFrame) -> DataFrame:
    """(key, valence, density) per text.

    valence: mean of pos - neg over scored tokens, 0 if none; density: scored tokens
    over all tokens, 0 for an empty text. ``lexicon`` is (token, pos, neg) and
    ``stopwords`` (token); stop words are never scored.
    """
    scores = lexicon.join(stopwords.select("token"), "token", "left_anti").select(
        "token", (F.col("pos") - F.col("neg")).alias("_score"))
    listed = df.select(key, F.explode_outer(tokens(F.col(text))).alias("token"))
    # A text's tokens are exploded in one task, so partial sums shrink to a row per text before the shuffle.
    totals = dim_join(listed, scores, "token", "left").groupBy(key).agg(
        F.sum("_score").alias("_sum"), F.count("_score").alias("_n"), F.count("token").alias("_all"))
    return totals.select(
        key,
        F.coalesce(F.try_divide(F.col("_sum"), F.col("_n")), F.lit(0.0)).alias("valence"),
        F.coalesce(F.try_divide(F.col("_n"), F.col("_all")), F.lit(0.0)).alias("density"),
    )
