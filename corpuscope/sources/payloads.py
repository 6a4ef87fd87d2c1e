"""Landed JSON responses to rows.

``raw`` is a frame with one response per row in column ``json``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SEARCH = "items array<struct<id struct<videoId string>, snippet struct<title string, channelTitle string, publishedAt string>>>, nextPageToken string"
STATS = (
    "items array<struct<id string,"
    " snippet struct<description string, tags array<string>, defaultAudioLanguage string, defaultLanguage string>,"
    " contentDetails struct<duration string, definition string, caption string>,"
    " statistics struct<viewCount string, likeCount string, commentCount string>,"
    " paidProductPlacementDetails struct<hasPaidProductPlacement string>>>"
)
CHANNEL = (
    "items array<struct<id string,"
    " snippet struct<title string, description string, localized struct<title string, description string>,"
    " publishedAt string, country string>,"
    " statistics struct<viewCount string, subscriberCount string, videoCount string>,"
    " contentDetails struct<relatedPlaylists struct<likes string, uploads string>>>>"
)
_COMMENT = "snippet struct<textDisplay string, likeCount bigint, publishedAt string, updatedAt string>"
THREADS = (
    f"items array<struct<id string, snippet struct<videoId string, topLevelComment struct<{_COMMENT}>, totalReplyCount bigint>,"
    f" replies struct<comments array<struct<id string, {_COMMENT}>>>>>"
)


def _items(raw: DataFrame, schema: str, *carry: str) -> DataFrame:
    parsed = raw.select(*carry, F.from_json("json", schema).alias("r"))
    return parsed.select(*carry, F.explode("r.items").alias("i"))


def _or(path: str, default) -> Column:
    return F.coalesce(F.col(path), F.lit(default))


def flatten_search(raw: DataFrame) -> DataFrame:
    return _items(raw, SEARCH).select(
        F.col("i.id.videoId").alias("video_id"), F.col("i.snippet.title").alias("title"),
        F.col("i.snippet.channelTitle").alias("channel_title"), F.col("i.snippet.publishedAt").alias("published_at"),
    )


def flatten_stats(raw: DataFrame) -> DataFrame:
    """Statistics per video; missing fields read 'N/A' and a missing duration 'PT0S'."""
    return _items(raw, STATS).select(
        F.col("i.id").alias("video_id"), _or("i.snippet.description", "N/A").alias("description"),
        F.coalesce(F.array_join("i.snippet.tags", ", "), F.lit("N/A")).alias("tags"),
        _or("i.snippet.defaultAudioLanguage", "N/A").alias("audio_language"),
        _or("i.snippet.defaultLanguage", "N/A").alias("textual_language"),
        _or("i.contentDetails.duration", "PT0S").alias("duration"),
        _or("i.contentDetails.definition", "N/A").alias("definition"),
        _or("i.contentDetails.caption", "N/A").alias("caption_availability"),
        _or("i.statistics.viewCount", "N/A").alias("view_count"),
        _or("i.statistics.likeCount", "N/A").alias("like_count"),
        _or("i.statistics.commentCount", "N/A").alias("comment_count"),
        _or("i.paidProductPlacementDetails.hasPaidProductPlacement", "N/A").alias("paid_product_placement"),
    )


def flatten_channel(raw: DataFrame) -> DataFrame:
    """Channel rows; text defaults to '', counts to 0, country and playlists to NULL."""
    count = lambda name: F.coalesce(F.col(f"i.statistics.{name}").try_cast("bigint"), F.lit(0))
    return _items(raw, CHANNEL).select(
        F.col("i.id").alias("channel_id"), _or("i.snippet.title", "").alias("title"),
        _or("i.snippet.description", "").alias("description"),
        _or("i.snippet.localized.title", "").alias("localized_title"),
        _or("i.snippet.localized.description", "").alias("localized_description"),
        _or("i.snippet.publishedAt", "").alias("published_at"), F.col("i.snippet.country").alias("country"),
        count("viewCount").alias("view_count"), count("subscriberCount").alias("subscriber_count"),
        count("videoCount").alias("video_count"),
        F.col("i.contentDetails.relatedPlaylists.likes").alias("likes_playlist"),
        F.col("i.contentDetails.relatedPlaylists.uploads").alias("uploads_playlist"),
    )


def flatten_threads(raw: DataFrame) -> DataFrame:
    top = "i.snippet.topLevelComment.snippet"
    return _items(raw, THREADS).select(
        F.col("i.id").alias("thread_id"), F.col("i.snippet.videoId").alias("video_id"),
        F.col(f"{top}.textDisplay").alias("top_level_text"), _or(f"{top}.likeCount", 0).alias("top_level_like_count"),
        F.col(f"{top}.publishedAt").alias("top_level_published_at"),
        F.col(f"{top}.updatedAt").alias("top_level_updated_at"),
        _or("i.snippet.totalReplyCount", 0).alias("total_reply_count"),
    )


def flatten_replies(raw: DataFrame) -> DataFrame:
    """One row per reply; threads without replies give none."""
    rows = _items(raw, THREADS).select(
        F.col("i.id").alias("thread_id"), F.col("i.snippet.videoId").alias("video_id"),
        F.explode("i.replies.comments").alias("c"),
    )
    return rows.select(
        F.col("c.id").alias("reply_id"), "thread_id", "video_id", F.col("c.snippet.textDisplay").alias("reply_text"),
        _or("c.snippet.likeCount", 0).alias("reply_like_count"),
        F.col("c.snippet.publishedAt").alias("reply_published_at"),
        F.col("c.snippet.updatedAt").alias("reply_updated_at"),
    )


def join_segments(segments: Column, separator: str = " ") -> Column:
    """Text of an array of (…, text) segments in array order."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), separator)


def assemble_transcripts(rows: DataFrame, key: str, position: str, text: str, separator: str = " ",
                         run: int = 1000) -> DataFrame:
    """Segment rows to one text per item in order of the numeric ``position``.

    Runs of ``run`` positions are joined first, so that a very long item is put together
    by many tasks; the last step only strings its runs into the item's one text cell.
    """
    def joined(by: list[str], place: str):
        parts = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(text).alias("text"))))
        return lambda df: df.groupBy(*by).agg(join_segments(parts, separator).alias(text))

    runs = rows.select(key, position, text).withColumn("_run", F.floor(F.col(position) / run))
    return runs.transform(joined([key, "_run"], position)).transform(joined([key], "_run")).withColumnRenamed(text, "transcript")


def taxonomy_terms(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines ``Category: 'term', 'term'`` to (category, term) rows."""
    shape = r"^\s*([^:]*?)\s*:\s*(.*)$"
    named = lines.where(F.col(column).rlike(shape)).select(
        F.regexp_extract(column, shape, 1).alias("category"),
        F.regexp_extract_all(F.regexp_extract(column, shape, 2), F.lit("'([^']*)'"), F.lit(1)).alias("terms"),
    )
    return named.select("category", F.explode("terms").alias("term")).withColumn("term", F.trim("term"))


def taxonomy_from_text(spark, text: str) -> DataFrame:
    """Taxonomy given as literal text, one category per line."""
    lines = F.explode(F.split(F.lit(text), "\n")).alias("line")
    return taxonomy_terms(spark.range(1).select(lines))
