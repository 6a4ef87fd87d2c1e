"""Row filters, explode-based membership and group-size filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.fixed_values import MIN_GROUP_SIZE
from corpuscope.operators.joins import dim_join, weighted_lookup_join


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(subset) if subset else None)


def row_max_below(df: DataFrame, columns: Sequence[str], bound: float) -> DataFrame:
    """Rows whose largest value over ``columns`` is below ``bound``; NULLs are skipped."""
    return df.where(F.greatest(*columns) < bound)


def group_sizes(df: DataFrame, group: str, min_n: int = MIN_GROUP_SIZE) -> DataFrame:
    """Groups with at least ``min_n`` rows as (group, group_n); the NULL group is left out."""
    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("group_n"))
    return counts.where(F.col("group_n") >= min_n)


def min_group_filter(df: DataFrame, group: str, min_n: int = MIN_GROUP_SIZE) -> DataFrame:
    """Rows of groups with at least ``min_n`` rows."""
    return weighted_lookup_join(df, group_sizes(df, group, min_n), group, "group_n").drop("group_n")


def select_prefix(df: DataFrame, prefixes: Sequence[str], exclude: Sequence[str] = ()) -> list[str]:
    """Column names that start with one of ``prefixes``."""
    return [c for c in df.columns if c.startswith(tuple(prefixes)) and c not in exclude]


def explode_values(df: DataFrame, column: str, alias: str, *carry: str) -> DataFrame:
    """One row per array element, NULL elements and empty arrays dropped."""
    return df.select(*carry, F.explode(column).alias(alias)).where(F.col(alias).isNotNull())


def valid_values(exploded: DataFrame, column: str, dim: DataFrame) -> DataFrame:
    return dim_join(exploded, dim.select(column).distinct(), column, "left_semi")


def invalid_values(exploded: DataFrame, column: str, dim: DataFrame) -> DataFrame:
    return dim_join(exploded, dim.select(column).distinct(), column, "left_anti")


def coverage_flags(categories: Column, valid: Sequence[str]) -> dict[str, Column]:
    """Flags of an item's category list: none given, or given but all unknown."""
    known = F.array(*[F.lit(v) for v in valid])
    listed = F.coalesce(categories, F.array().cast("array<string>"))
    return {
        "no_category": F.size(listed) == 0,
        "only_invalid": (F.size(listed) > 0) & F.forall(listed, lambda c: ~F.array_contains(known, c)),
    }
