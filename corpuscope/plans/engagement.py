"""Engagement model: text and channel features, rank statistics, components, regression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from corpuscope.fixed_values import KEYWORDS, MIN_GROUP_SIZE, SNAPSHOT_DATE, TOPIC_KEYWORDS
from corpuscope.functions import scalars, text
from corpuscope.operators import features, filters, joins, lexicon, models, stats
from corpuscope.session import materialise

RATES = ["views_per_day", "likes_per_day", "comments_per_day"]
CONTINUOUS = [
    "duration_seconds", "subscriber_count", "channel_productivity", "num_tags", "channel_view_count",
    "days_since_published", "days_since_channel_created", "title_word_count", "valence", "density",
    "readability_fk_grade",
]
NOMINAL = ["audio_language", "textual_language", "country"]

VIDEO_NAMES = {
    "published_at": "video_published_at", "view_count": "video_view_count", "like_count": "video_like_count",
    "comment_count": "video_comment_count", "title": "video_title",
}
CHANNEL_NAMES = {
    "published_at": "channel_created_at", "view_count": "channel_view_count", "title": "channel_title",
    "video_count": "channel_video_count",
}


def transcript_features(transcripts: DataFrame, lexicon_rows: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Creator-made transcripts with readability, valence and density."""
    kept = transcripts.where(text.not_contains(F.col("type"), "auto-generated")).select(
        "video_id", text.clean_text(F.col("punctuated_transcript")).alias("clean_transcript"))
    scored = kept.select(
        "video_id", "clean_transcript",
        text.readability_fk(F.col("clean_transcript")).alias("readability_fk_grade"),
        text.readability_ari(F.col("clean_transcript")).alias("readability_ari"),
    ).drop("clean_transcript")
    moods = lexicon.valence_density(kept, "video_id", "clean_transcript", lexicon_rows, stopwords)
    return scored.join(moods, "video_id", "left")


def engagement_frame(videos: DataFrame, channels: DataFrame, transcripts: DataFrame, snapshot: str = SNAPSHOT_DATE) -> DataFrame:
    """One row per transcript with ages, rates, counts and flags, complete in all three rates."""
    v = stats.rename_columns(videos, VIDEO_NAMES).drop("channel_title", "description")
    c = stats.rename_columns(channels, CHANNEL_NAMES)
    joined = joins.feature_join(v, c, transcripts)
    present = joined.dropna(subset=["video_view_count", "channel_view_count", "duration"])
    aged = present.withColumns({
        "days_since_published": scalars.age_days(scalars.parse_timestamp(F.col("video_published_at")), snapshot),
        "days_since_channel_created": scalars.age_days(scalars.parse_timestamp(F.col("channel_created_at")), snapshot),
        **{f"_{k}": scalars.numeric(F.col(f"video_{k}_count")) for k in ("view", "like", "comment")},
        "subscriber_count": scalars.numeric(F.col("subscriber_count")),
        "channel_view_count": scalars.numeric(F.col("channel_view_count")),
    })
    age = F.col("days_since_published")
    return aged.select(
        "video_id", "keywords", *NOMINAL, "days_since_published", "days_since_channel_created",
        scalars.rate_per_day(F.col("_view"), age).alias("views_per_day"),
        scalars.rate_per_day(F.col("_like"), age).alias("likes_per_day"),
        scalars.rate_per_day(F.col("_comment"), age).alias("comments_per_day"),
        text.word_count(F.col("video_title")).alias("title_word_count"),
        scalars.duration_seconds(F.col("duration")).alias("duration_seconds"),
        "subscriber_count", "channel_view_count",
        scalars.rate_per_day(scalars.numeric(F.col("channel_video_count")), F.col("days_since_channel_created")).alias("channel_productivity"),
        text.tag_count(F.col("tags")).alias("num_tags"),
        scalars.binary_encode(F.col("paid_product_placement")).alias("paid_product_placement"),
        scalars.binary_encode(F.col("caption_availability")).alias("has_captions"),
        scalars.binary_encode(F.col("definition"), "hd", "sd").alias("is_hd"),
        "readability_fk_grade", "readability_ari", "valence", "density",
    ).dropna(subset=RATES)


class EngagementModel:
    """Statistics of one engagement frame.

    The frame is written once to the shared folder; every statistic reads only the
    columns it needs from there.
    """

    def __init__(self, frame: DataFrame, topics: Mapping[str, Sequence[str]] = TOPIC_KEYWORDS,
                 min_group: int = MIN_GROUP_SIZE, continuous: Sequence[str] = tuple(CONTINUOUS)):
        self.topics, self.min_group, self.continuous = topics, min_group, list(continuous)
        frame = materialise(frame, "engagement")
        self.components = features.fit_components(frame, RATES)
        scored = self.components.score(frame)
        logged = features.log1p_columns(
            scored, ["engagement_index", "duration_seconds", "subscriber_count", "channel_view_count"])
        self.scored = logged.withColumn("topics", text.topics_of(F.col("keywords"), topics))
        needed = ["log1p_engagement_index", "engagement_index", *self.continuous, "is_hd", "paid_product_placement"]
        self.complete = materialise(self.scored.dropna(subset=needed), "engagement-complete")

    def correlations(self, targets: Sequence[str] = (*RATES, "engagement_index")) -> DataFrame:
        """Spearman correlation of every feature with every target, with stars."""
        pairs = [(f, t) for f in self.continuous for t in targets]
        found = stats.spearman_pairs(self.scored, "video_id", pairs)
        return found.withColumn("significance", scalars.significance(F.col("p_value")))

    def rate_correlations(self) -> DataFrame:
        return stats.spearman_matrix(self.scored, "video_id", RATES)

    def group_tests(self, target: str = "log1p_engagement_index") -> DataFrame:
        """Kruskal-Wallis test of the target by each nominal column."""
        tests = None
        for column in NOMINAL:
            row = stats.kruskal_wallis(self.complete, column, target, self.min_group).select(
                F.lit(column).alias("feature"), "h", "p_value", "groups_tested")
            tests = row if tests is None else tests.unionByName(row)
        return tests

    def group_boxes(self, column: str, target: str = "log1p_engagement_index") -> DataFrame:
        kept = filters.min_group_filter(self.complete, column, self.min_group)
        return stats.box_stats(kept, target, column).orderBy("median", column)

    def topic_sizes(self) -> DataFrame:
        """Topics with at least the minimum number of items."""
        listed = filters.explode_values(self.complete, "topics", "topic", "video_id")
        return filters.group_sizes(listed, "topic", self.min_group)

    def topic_tests(self, target: str = "log1p_engagement_index") -> DataFrame:
        # The topic names are a user-supplied list, so their survivors fit the driver.
        names = sorted(row["topic"] for row in self.topic_sizes().select("topic").collect())
        return stats.topic_correlation(self.complete, "topics", target, names)

    def design(self, topic: str = "SQL") -> tuple[DataFrame, list[str]]:
        """Regression rows and feature names: interval columns, one topic flag, dummies."""
        rows = self.complete
        for column, prefix in zip(NOMINAL, ("audio", "text", "country")):
            rows = features.merge_rare(rows, column, self.min_group)
            rows = features.one_hot(rows, f"{column}_grouped", prefix)
        rows = rows.withColumn(f"topic_{topic}", F.array_contains("topics", topic).cast("int"))
        logged = {c: f"log1p_{c}" for c in ("duration_seconds", "subscriber_count", "channel_view_count")}
        interval = [logged.get(c, c) for c in self.continuous]
        raw = [*NOMINAL, *[f"{c}_grouped" for c in NOMINAL]]
        dummies = filters.select_prefix(rows, ["audio_", "text_", "country_"], exclude=raw)
        dummies = [c for c in dummies if c not in ("textual_language", "textual_language_grouped")]
        return rows, [*interval, f"topic_{topic}", *dummies]

    def regression(self, topic: str = "SQL", drop_country: bool = False, target: str = "log1p_engagement_index") -> tuple[DataFrame, DataFrame]:
        """(coefficient table, VIF table) of the ordinary least squares fit."""
        rows, names = self.design(topic)
        if drop_country:
            names = [n for n in names if not n.startswith("country_")]
        rows = materialise(rows.select(target, *names), "engagement-design")
        kept = models.independent_columns(rows, names)
        model = models.fit_ols(rows, kept, target)
        return models.ols_summary(rows.sparkSession, model, kept), models.vif(rows, kept)


def order_frames(spark, sf_dir):
    """The given tables in the shape of videos, channels and transcripts."""
    from corpuscope.plans import standins
    from corpuscope.plans.registry import load

    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("likes"), F.count(F.lit(1)).alias("lines"))
    keywords = F.array(*[F.lit(k) for k in KEYWORDS])
    orders = load(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    number = F.coalesce(F.col("lines"), F.lit(1))
    videos = orders.select(
        F.col("o_orderkey").cast("string").alias("video_id"), F.col("o_custkey").cast("string").alias("channel_id"),
        F.concat_ws(" ", F.col("o_orderpriority"), F.repeat(F.lit("word "), number.cast("int"))).alias("title"),
        F.lit(None).cast("string").alias("channel_title"), F.lit(None).cast("string").alias("description"),
        standins.iso(F.col("o_orderdate")).alias("published_at"), F.col("o_totalprice").cast("string").alias("view_count"),
        F.coalesce(F.col("likes").cast("string"), F.lit("N/A")).alias("like_count"),
        F.coalesce(F.col("lines").cast("string"), F.lit("N/A")).alias("comment_count"),
        scalars.clock_text(F.col("o_custkey") * 97).alias("duration"),
        F.array_join(F.array_repeat(F.col("o_orderstatus"), number.cast("int")), ",").alias("tags"),
        F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("false").alias("paid_product_placement"),
        F.lit("false").alias("caption_availability"),
        F.when(F.col("o_orderkey") % 3 == 0, "sd").otherwise("hd").alias("definition"),
        F.element_at(keywords, (F.col("o_orderkey") % len(KEYWORDS) + 1).cast("int")).alias("keywords"),
        F.col("o_orderpriority").alias("audio_language"), F.col("o_orderstatus").alias("textual_language"),
    )
    customers = load(spark, sf_dir, "customer")
    channels = customers.select(
        F.col("c_custkey").cast("string").alias("channel_id"), F.col("c_name").alias("title"),
        F.date_format(F.date_sub(F.to_date(F.lit("1994-12-31")), (F.col("c_custkey") % 900).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'").alias("published_at"),
        (F.col("c_custkey") * 31).alias("view_count"), (F.abs("c_acctbal") * 10).cast("bigint").alias("subscriber_count"),
        (F.col("c_nationkey") + 1).cast("bigint").alias("video_count"), F.col("c_mktsegment").alias("country"),
    )
    transcripts = load(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("video_id"), F.col("text").alias("punctuated_transcript"),
        F.when(F.col("source") == "src0", "auto-generated").otherwise("creator-uploaded").alias("type"))
    return videos, channels, transcripts


def order_report(spark, sf_dir: str) -> DataFrame:
    """Main figures of the engagement model over the given tables as (section, name, value) rows."""
    from corpuscope.plans import standins
    from corpuscope.plans.scalar_queries import lexicon_frames

    videos, channels, transcripts = order_frames(spark, sf_dir)
    frame = engagement_frame(videos, channels, transcript_features(transcripts, *lexicon_frames(spark)), standins.SNAPSHOT)
    model = EngagementModel(frame)
    coefficients, inflation = model.regression()
    rows = lambda section, df, name, value: df.select(
        F.lit(section).alias("section"), name.alias("name"), F.round(value.cast("double"), 4).alias("value"))
    return (
        rows("spearman", model.correlations(), F.concat_ws("|", "feature", "target"), F.col("rho"))
        .unionByName(rows("kruskal", model.group_tests(), F.col("feature"), F.col("h")))
        .unionByName(rows("topic", model.topic_tests(), F.col("topic"), F.col("rho")))
        .unionByName(rows("ols", coefficients, F.col("term"), F.col("coef")))
        .unionByName(rows("vif", inflation, F.col("feature"), F.col("vif")))
    )
