"""Keyed table mutation as DataFrame transformations.

First and last row per key are ``min_by``/``max_by`` aggregates: they combine on
the map side, so a key with very many rows never gathers in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from corpuscope.operators.joins import as_list


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    keys = as_list(keys)
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, "_row.*").select(*df.columns)


def keep_first(df: DataFrame, keys, order: Sequence[str]) -> DataFrame:
    """First row of each key; ``order`` must be unique within a key."""
    return _pick(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys, order: Sequence[str]) -> DataFrame:
    """Last row of each key; ``order`` must be unique within a key."""
    return _pick(df, keys, order, F.max_by)


def prefer_transcript(segments: DataFrame, key: str, generated: str = "is_generated", position: str = "position") -> DataFrame:
    """One track per item: the first creator-made one, else the first generated one."""
    return keep_first(segments, key, [generated, position])


def upsert_ignore(target: DataFrame, batch: DataFrame, keys, order: Sequence[str]) -> DataFrame:
    """Insert rows of new keys; existing keys win, then the first row of the batch."""
    keys = as_list(keys)
    fresh = keep_first(batch, keys, order).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def upsert_replace(target: DataFrame, batch: DataFrame, keys, order: Sequence[str]) -> DataFrame:
    """Insert or replace; the last row of the batch wins over the table."""
    keys = as_list(keys)
    latest = keep_last(batch, keys, order)
    kept = target.join(latest.select(*keys), keys, "left_anti").select(*target.columns)
    return kept.unionByName(latest.select(*target.columns))


class DuplicateKeyError(ValueError):
    """An append would store a key twice."""


def append_checked(target: DataFrame, batch: DataFrame, keys) -> DataFrame:
    """Append ``batch``; a key already stored or repeated in the batch is an error."""
    keys = as_list(keys)
    repeated = batch.groupBy(*keys).count().where("count > 1").select(*keys)
    stored = batch.join(target.select(*keys), keys, "left_semi").select(*keys)
    clash = repeated.unionByName(stored).head(1)
    if clash:
        raise DuplicateKeyError(f"key already stored: {clash[0].asDict()}")
    return target.unionByName(batch.select(*target.columns))


def update_by_key(target: DataFrame, updates: DataFrame, keys, columns: Sequence[str],
                  order: Sequence[str] = ()) -> DataFrame:
    """Set ``columns`` where a matching update row exists; other updates have no effect.

    Of several updates of a key the last by ``order`` counts, as if they ran one after
    the other; ties, and all rows without an order, go by the values. A matched NULL
    does overwrite.
    """
    keys = as_list(keys)
    latest = keep_last(updates.select(*dict.fromkeys([*keys, *order, *columns])), keys, [*order, *columns])
    new = latest.select(*keys, F.struct(*columns).alias("_new"))
    joined = target.join(new, keys, "left")
    return joined.select(*[
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
        if c in columns else F.col(c)
        for c in target.columns
    ])


def merge_keyword_tables(tables: Sequence[DataFrame], key: str = "video_id", keyword: str = "keyword",
                         collected: str = "collected_at") -> DataFrame:
    """Union of per-keyword tables: one row per item with all its keywords, comma-joined.

    The other columns come from the most recently collected row. ``collect_set`` holds
    one entry per search keyword, a list the user supplies, never one per row.
    """
    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table)
    rest = [c for c in stacked.columns if c not in (key, keyword)]
    # Distinct (item, keyword) first, so that repeated finds shrink before the final shuffle.
    per_keyword = stacked.groupBy(key, keyword).agg(
        F.max_by(F.struct(*rest), F.struct(collected, F.struct(*rest))).alias("_row")
    )
    return per_keyword.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set(keyword)), ",").alias("keywords"),
        F.max_by(F.col("_row"), F.struct(F.col(f"_row.{collected}"), F.col(keyword))).alias("_row"),
    ).select(key, "keywords", "_row.*")


def dead_letter(batch: DataFrame, succeeded) -> tuple[DataFrame, DataFrame]:
    """Split a batch into (succeeded, failed); an undecided row counts as failed."""
    ok = F.coalesce(succeeded, F.lit(False))
    return batch.where(ok), batch.where(~ok)
