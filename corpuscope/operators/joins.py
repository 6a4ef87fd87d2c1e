"""Joins that stay balanced when one key holds a large share of the rows.

``skew_join`` finds the heavy keys first. A key is heavy when it holds more rows than
two average shuffle partitions, so there are fewer of them than half the partitions:
that bound is what makes broadcasting them safe at any data size. Rows of a heavy key
are salted over twice as many tasks as average partitions would hold them, and its one lookup
row is repeated for each of its salts; all other keys join as usual. It is one pass over
the facts and one join, and no row is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

HEAVY_PARTITIONS = 2
BROADCAST_BYTES = 64 << 20


def as_list(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def _partitions(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _heavy_of(counts: DataFrame, weight: str) -> DataFrame:
    """The heavy keys of a table of counts, with ``_salts``, twice the partitions that their rows would fill: salts may fall together."""
    total = counts.agg(F.sum(weight).cast("double").alias("_t")).scalar()
    filled = F.col(weight) * _partitions(counts) / total
    return counts.where(filled > HEAVY_PARTITIONS).withColumn("_salts", F.ceil(2 * filled).cast("int"))


def heavy_keys(facts: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Keys of more rows than ``HEAVY_PARTITIONS`` average shuffle partitions, with their ``_salts``."""
    keys = as_list(on)
    counts = facts.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return _heavy_of(counts, "_n").select(*keys, "_salts")


def _salted_join(facts: DataFrame, lookup: DataFrame, heavy: DataFrame, keys: list[str], how: str) -> DataFrame:
    flags = F.broadcast(heavy)
    null_key = F.lit(False)
    for key in keys:
        null_key = null_key | F.col(key).isNull()
    # The salt is a hash of the row, so a recomputed task salts its rows the same way. NULL keys meet no lookup row.
    salts = F.when(null_key, F.lit(_partitions(facts))).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = facts.join(flags, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*facts.columns), salts).cast("int")).drop("_salts")
    repeated = (
        lookup.join(flags, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def skew_join(facts: DataFrame, lookup: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join facts to a lookup that is unique on ``on``.

    ``how`` is inner, left, left_semi or left_anti. Rows with a NULL key never
    match and stay with the outer and anti joins, as in a plain join. Fact rows should
    carry an id or be counted first: rows equal in all columns share a salt.
    """
    keys = as_list(on)
    return _salted_join(facts, lookup, heavy_keys(facts, keys), keys, how)


def weighted_lookup_join(
    facts: DataFrame, lookup: DataFrame, on: str | Sequence[str], weight: str, how: str = "inner",
) -> DataFrame:
    """``skew_join`` for a lookup that already carries the number of fact rows per key."""
    keys = as_list(on)
    heavy = _heavy_of(lookup, weight).select(*keys, "_salts")
    return _salted_join(facts, lookup, heavy, keys, how)


def checked_broadcast(dim: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """``dim`` with a broadcast hint when its plan's size is at most ``max_bytes``, else None. Starts no job."""
    size = int(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(dim) if size <= max_bytes else None


def dim_join(
    facts: DataFrame, dim: DataFrame, on: str | Sequence[str], how: str = "inner", max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join to a dimension unique on ``on``: broadcast if its bytes are checked small, else skew join."""
    small = checked_broadcast(dim, max_bytes)
    if small is not None:
        return facts.join(small, as_list(on), how)
    return skew_join(facts, dim, on, how)


def semi_filter(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``ids``."""
    return df.join(ids.select(key), key, "left_semi")


def anti_filter(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``ids``."""
    return df.join(ids.select(key), key, "left_anti")


def pending(items: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Keys that are neither done nor failed."""
    return anti_filter(anti_filter(items.select(key), done, key), failed, key)


def sampling_frame(items: DataFrame, transcripts: DataFrame, labelled: DataFrame, key: str, text: str) -> DataFrame:
    """Unlabelled items that have a text."""
    texts = transcripts.where(F.col(text).isNotNull()).select(key, text)
    return anti_filter(items, labelled, key).join(texts, key)


def feature_join(videos: DataFrame, channels: DataFrame, transcripts: DataFrame,
                 channel_key: str = "channel_id", video_key: str = "video_id") -> DataFrame:
    """One row per transcript with its video and channel columns.

    A channel may own a large share of all videos, hence the skew join. Clashing
    column names get the suffix ``_channel``.
    """
    clash = set(videos.columns) & set(channels.columns) - {channel_key}
    channels = channels.withColumnsRenamed({c: f"{c}_channel" for c in clash})
    enriched = skew_join(videos, channels, channel_key, "left")
    return enriched.join(transcripts, video_key, "right")


def search_stats_join(found: DataFrame, stats: DataFrame, key: str = "video_id") -> DataFrame:
    """Search rows with their statistics; rows without statistics keep NULLs."""
    return found.join(stats, key, "left")


def align_labels(embeddings: DataFrame, train: DataFrame, heldout: DataFrame, key: str, label: str) -> DataFrame:
    """Vectors with label and split; a training label wins over a held-out one."""
    def labels(df: DataFrame, split: str, rank: int) -> DataFrame:
        return df.select(key, F.col(label), F.lit(split).alias("split"), F.lit(rank).alias("_rank"))

    both = labels(train, "train", 0).unionByName(labels(heldout, "heldout", 1))
    chosen = both.groupBy(key).agg(F.min_by(F.struct(label, "split"), F.struct("_rank", label)).alias("_s"))
    return embeddings.join(chosen.select(key, "_s.*"), key)


