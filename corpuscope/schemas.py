"""Declared schemas of the durable tables and create-if-absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


# Counts stay text at the edge because the source writes 'N/A' into them.
VIDEOS = _schema(
    video_id="string", title="string", channel_title="string", published_at="string",
    description="string", tags="string", audio_language="string", textual_language="string",
    duration="string", definition="string", caption_availability="string",
    view_count="string", like_count="string", comment_count="string",
    paid_product_placement="string", collected_at="string", keywords="string",
    channel_id="string", predicted_label="int", confidence="double",
)
CHANNELS = _schema(
    channel_id="string", title="string", description="string", localized_title="string",
    localized_description="string", published_at="string", country="string",
    view_count="bigint", subscriber_count="bigint", video_count="bigint",
    likes_playlist="string", uploads_playlist="string",
)
COMMENTS = _schema(
    thread_id="string", video_id="string", top_level_text="string", top_level_like_count="bigint",
    top_level_published_at="string", top_level_updated_at="string", total_reply_count="bigint",
)
REPLIES = _schema(
    reply_id="string", thread_id="string", video_id="string", reply_text="string",
    reply_like_count="bigint", reply_published_at="string", reply_updated_at="string",
)
TRANSCRIPTS = _schema(
    video_id="string", transcript="string", punctuated_transcript="string",
    type="string", translatable="string",
)
FAILED_VIDEOS = _schema(video_id="string")
TRAINING_SAMPLE = _schema(
    video_id="string", title="string", description="string", transcript="string",
    keywords="string", sampling_weight="double",
)
TRAINING_LABELS = _schema(video_id="string", gpt_label="int")
MANUAL_LABELS = _schema(video_id="string", relevance="int")
PREDICTIONS = _schema(video_id="string", predicted_label="int", confidence="double")
EMBEDDINGS = _schema(video_id="string", embedding="array<float>")
SUBTOPICS = _schema(
    video_id="string", title="string", description="string", matching_categories="array<string>",
)

TABLES = {
    "videos": VIDEOS,
    "channels": CHANNELS,
    "comments": COMMENTS,
    "replies": REPLIES,
    "transcripts": TRANSCRIPTS,
    "failed_videos": FAILED_VIDEOS,
    "training_sample": TRAINING_SAMPLE,
    "training_labels": TRAINING_LABELS,
    "manual_labels": MANUAL_LABELS,
}


def create_if_absent(spark: SparkSession, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Create an empty Parquet table unless it exists; return the table."""
    schema = schema or TABLES[name]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
    return spark.table(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def add_column_if_missing(df: DataFrame, name: str, kind: str) -> DataFrame:
    """``df`` with a NULL column ``name`` of type ``kind`` unless it has one."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(None).cast(kind))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the declared column order and types; absent columns are NULL."""
    return df.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])
