"""Filters, projections and scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.functions import scalars, text
from corpuscope.operators import filters, joins, lexicon, mutation, sampling, stats
from corpuscope.plans import coverage, standins
from corpuscope.plans.registry import load, query, rounded, to_bigint
from corpuscope.plans.standins import SQL_WORDS

_W = SQL_WORDS.format("text")

# --- filters -------------------------------------------------------------------

_DOC_LABELS = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _doc_labels(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(load(spark, sf_dir, "labels"), "doc_id", "left")


@query("filter_null", f"SELECT d.doc_id, lang FROM {_DOC_LABELS} WHERE quality IS NULL")
def filter_null(spark, sf_dir):
    return _doc_labels(spark, sf_dir).where(F.col("quality").isNull()).select("doc_id", "lang")


@query("filter_not_contains", "SELECT doc_id, n_chars FROM documents WHERE NOT coalesce(contains(text, 'worthless'), false)")
def filter_not_contains(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return docs.where(text.not_contains(F.col("text"), "worthless")).select("doc_id", "n_chars")


@query("dropna_subset", f"""
SELECT d.doc_id, lang, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM {_DOC_LABELS} WHERE quality IS NOT NULL
""")
def dropna_subset(spark, sf_dir):
    return to_bigint(filters.drop_nulls(_doc_labels(spark, sf_dir), ["quality"]), "quality", "toxic")


@query("filter_rowmax", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE greatest(l_quantity, l_discount * 100, l_tax * 100) < 10
""")
def filter_rowmax(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").withColumns({"d": F.col("l_discount") * 100, "t": F.col("l_tax") * 100})
    kept = filters.row_max_below(lines, ["l_quantity", "d", "t"], 10)
    return to_bigint(kept.select("l_orderkey", "l_linenumber"), "l_linenumber")


@query("semi_filter", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
""")
def semi_filter(spark, sf_dir):
    ids = load(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.semi_filter(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")


@query("anti_filter", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
""")
def anti_filter(spark, sf_dir):
    ids = load(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.anti_filter(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")


@query("category_valid", f"WITH {standins.ITEMS_SQL} SELECT video_id, category FROM mentions WHERE category IN ({standins.SQL_KNOWN})")
def category_valid(spark, sf_dir):
    mentions = coverage.exploded(standins.items(spark, sf_dir))
    return filters.valid_values(mentions, "category", standins.taxonomy(spark))


@query("category_invalid", f"WITH {standins.ITEMS_SQL} SELECT video_id, category FROM mentions WHERE category NOT IN ({standins.SQL_KNOWN})")
def category_invalid(spark, sf_dir):
    mentions = coverage.exploded(standins.items(spark, sf_dir))
    return filters.invalid_values(mentions, "category", standins.taxonomy(spark))


@query("coverage_flags", f"""
WITH {standins.ITEMS_SQL}
SELECT video_id, len(matching_categories) = 0 AS no_category,
       len(matching_categories) > 0 AND len(list_filter(matching_categories, lambda c: c IN ({standins.SQL_KNOWN}))) = 0 AS only_invalid
FROM items
""")
def coverage_flags(spark, sf_dir):
    flags = filters.coverage_flags(F.col("matching_categories"), standins.KNOWN)
    return standins.items(spark, sf_dir).select("video_id", *[c.alias(n) for n, c in flags.items()])


@query("min_group_filter", """
SELECT doc_id, source FROM documents QUALIFY count(*) OVER (PARTITION BY source) >= 50
""")
def min_group_filter(spark, sf_dir):
    return filters.min_group_filter(load(spark, sf_dir, "documents").select("doc_id", "source"), "source", 50)


@query("threshold_label", f"WITH {standins.SCORES_SQL} SELECT id, CAST(p >= 0.02 AS BIGINT) AS predicted FROM s")
def threshold_label(spark, sf_dir):
    scored = standins.scores(spark, sf_dir)
    return to_bigint(scored.select("id", scalars.threshold_label(F.col("p"), 0.02).alias("predicted")), "predicted")


@query("select_prefix", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def select_prefix(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return orders.select(*filters.select_prefix(orders, ["o_order"], exclude=["o_orderdate"]))


# --- projections -----------------------------------------------------------------

@query("rename_columns", "SELECT o_orderkey AS video_id, o_totalprice AS video_view_count FROM orders")
def rename_columns(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return stats.rename_columns(orders, {"o_orderkey": "video_id", "o_totalprice": "video_view_count"})


@query("numeric_coerce", """
SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'N/A' ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE) AS views FROM orders
""")
def numeric_coerce(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 5 == 0, "N/A").otherwise(F.col("o_custkey").cast("string"))
    return load(spark, sf_dir, "orders").select("o_orderkey", scalars.numeric(raw).alias("views"))


@query("ts_parse", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS published FROM orders")
def ts_parse(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", standins.iso(F.col("o_orderdate")).alias("published_at"))
    return orders.select("o_orderkey", F.unix_seconds(scalars.parse_timestamp(F.col("published_at"))).alias("published"))


@query("age_days", """
SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-01-15') - epoch_us(ts)) / 86400000000.0) AS BIGINT) AS age FROM events
""")
def age_days(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", scalars.age_days(F.col("ts"), "2024-01-15").alias("age"))


@query("rate_per_day", f"""
WITH {standins.METRICS_SQL}
SELECT o_orderkey, age, views_per_day, likes_per_day, comments_per_day FROM m
""")
def rate_per_day(spark, sf_dir):
    rates = ["views_per_day", "likes_per_day", "comments_per_day"]
    return standins.order_metrics(spark, sf_dir).select("o_orderkey", "age", *rates)


@query("duration_seconds", "SELECT o_orderkey, CAST(o_custkey * 97 AS DOUBLE) AS seconds FROM orders")
def duration_seconds(spark, sf_dir):
    clock = scalars.clock_text(F.col("o_custkey") * 97)
    return load(spark, sf_dir, "orders").select("o_orderkey", scalars.duration_seconds(clock).alias("seconds"))


@query("duration_minutes", """
SELECT o_orderkey, round(CASE WHEN o_custkey * 97 < 86400 THEN floor(o_custkey * 97 / 60) + (o_custkey * 97 % 60) / 60.0 END, 6) AS minutes FROM orders
""")
def duration_minutes(spark, sf_dir):
    clock = scalars.clock_text(F.col("o_custkey") * 97)
    return rounded(load(spark, sf_dir, "orders").select("o_orderkey", scalars.duration_minutes(clock).alias("minutes")), "minutes")


@query("iso_duration", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0.0
       ELSE CAST(o_custkey % 7 * 3600 + o_custkey % 59 * 60 + o_orderkey % 60 AS DOUBLE) END AS seconds FROM orders
""")
def iso_duration(spark, sf_dir):
    iso = F.when(F.col("o_orderkey") % 4 != 0, F.format_string(
        "PT%dH%dM%dS", F.col("o_custkey") % 7, F.col("o_custkey") % 59, F.col("o_orderkey") % 60))
    return load(spark, sf_dir, "orders").select("o_orderkey", scalars.iso_duration_seconds(iso).alias("seconds"))


@query("word_count", f"SELECT doc_id, CAST(len({_W}) AS BIGINT) AS words FROM documents")
def word_count(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", text.word_count(F.col("text")).cast("bigint").alias("words"))


@query("tag_count", """
SELECT p_partkey, CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE len(string_split(replace(p_name, ' ', ', '), ',')) END AS BIGINT) AS tags FROM part
""")
def tag_count(spark, sf_dir):
    tags = standins.part_keywords(spark, sf_dir).withColumn("keywords", F.when(F.col("p_partkey") % 5 != 0, F.col("keywords")))
    return tags.select("p_partkey", text.tag_count(F.col("keywords")).cast("bigint").alias("tags"))


@query("binary_encode", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(CASE l_returnflag WHEN 'r' THEN NULL WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS BIGINT) AS flag FROM lineitem
""")
def binary_encode(spark, sf_dir):
    word = F.when(F.col("l_returnflag") == "R", "true").when(F.col("l_returnflag") == "A", "false").otherwise("N/A")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.binary_encode(word).alias("flag"))
    return to_bigint(lines, "l_linenumber", "flag")


@query("clean_text", """
SELECT doc_id, trim(regexp_replace(regexp_replace('[Music] ' || text || ' [a' || chr(10) || 'b]', '\\[[^\\n]*?\\]', '', 'g'), '\\s+', ' ', 'g')) AS clean FROM documents
""")
def clean_text(spark, sf_dir):
    marked = F.concat(F.lit("[Music] "), F.col("text"), F.lit(" [a\nb]"))
    return load(spark, sf_dir, "documents").select("doc_id", text.clean_text(marked).alias("clean"))


@query("truncate_words", f"SELECT doc_id, array_to_string({_W}[1:150], ' ') AS short FROM documents")
def truncate_words(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.truncate_words(F.col("text"), 150).alias("short"))


_PROMPT_SQL = f"""
SELECT doc_id, 'T: ' || source || ' D: ' || array_to_string({_W}[1:150], ' ') || ' X: ' || array_to_string({_W}[1:500], ' ')
       || ' K: ["red", "blue"]' AS prompt FROM documents
"""


def _prompts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.build_prompt(
        F.col("source"), F.col("text"), F.col("text"), ["red", "blue"], "T: %s D: %s X: %s K: ").alias("prompt"))


@query("build_prompt", _PROMPT_SQL)
def build_prompt(spark, sf_dir):
    return _prompts(spark, sf_dir)


@query("parse_label", """
SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality END AS BIGINT) AS label FROM labels
""")
def parse_label(spark, sf_dir):
    reply = F.when(F.col("doc_id") % 3 == 0, "unsure").otherwise(F.concat(F.lit(" "), F.col("quality").cast("string"), F.lit("\n")))
    return load(spark, sf_dir, "labels").select("doc_id", text.parse_label(reply).cast("bigint").alias("label"))


@query("label_rejects", """
SELECT count(*) AS n, count(*) FILTER (TRY_CAST(trim(text) AS INTEGER) IS NULL) AS rejected FROM conversations
""")
def label_rejects(spark, sf_dir):
    """Replies in total, and those that are no label."""
    replies = load(spark, sf_dir, "conversations").select(text.parse_label(F.col("text")).alias("label"))
    return sampling.label_rejects(replies, "label")


@query("log1p_dropped", "SELECT count(c_acctbal) AS n, count(*) FILTER (c_acctbal / 1000 <= -1) AS dropped FROM customer")
def log1p_dropped(spark, sf_dir):
    from corpuscope.operators.features import dropped_by_log1p

    return dropped_by_log1p(load(spark, sf_dir, "customer").select((F.col("c_acctbal") / 1000).alias("balance")), "balance")


@query("log1p_features", """
SELECT c_custkey, CASE WHEN c_acctbal / 1000 > -1 THEN round(ln(1 + c_acctbal / 1000), 6) END AS log1p_balance FROM customer
""")
def log1p_features(spark, sf_dir):
    from corpuscope.operators.features import log1p_columns

    rows = load(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("balance"))
    return rounded(log1p_columns(rows, ["balance"]).drop("balance"), "log1p_balance")


@query("split_trim", f"WITH {standins.KEYWORDS_SQL} SELECT p_partkey, unnest(list_transform(string_split(keywords, ','), lambda x: trim(x))) AS keyword FROM k")
def split_trim(spark, sf_dir):
    rows = standins.part_keywords(spark, sf_dir)
    return rows.select("p_partkey", F.explode(text.split_trim(F.col("keywords"))).alias("keyword"))


_TOPIC_SQL = """
CASE WHEN {w} IN ('red', 'blue', 'green') THEN ['color'] ELSE [] END || CASE WHEN {w} IN ('red', 'hot') THEN ['warm'] ELSE [] END
  || CASE WHEN {w} IN ('ring', 'bolt') THEN ['shape'] ELSE [] END
"""
TOPICS_CTE = f"""
topics AS (
  SELECT p_partkey, p_brand, p_retailprice, list_sort(list_distinct(({_TOPIC_SQL.format(w="string_split(p_name, ' ')[1]")}) || ({_TOPIC_SQL.format(w="string_split(p_name, ' ')[2]")}))) AS topics
  FROM part
)
"""


@query("topics_per_item", f"WITH {TOPICS_CTE} SELECT p_partkey, array_to_string(topics, '|') AS topics FROM topics")
def topics_per_item(spark, sf_dir):
    rows = standins.part_keywords(spark, sf_dir)
    return rows.select("p_partkey", F.array_join(text.topics_of(F.col("keywords"), standins.PART_TOPICS), "|").alias("topics"))


@query("significance", """
SELECT event_id, CASE WHEN value / 1000 < 0.001 THEN '***' WHEN value / 1000 < 0.01 THEN '**' WHEN value / 1000 < 0.05 THEN '*' ELSE '' END AS stars FROM events
""")
def significance(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", scalars.significance(F.col("value") / 1000).alias("stars"))


@query("transcript_type", """
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'auto-generated' ELSE 'creator-uploaded' END
       || CASE WHEN role = 'system' THEN '' ELSE ' (Translated from ' || role || ')' END AS type FROM conversations
""")
def transcript_type(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", text.transcript_type(
        F.col("role") == "assistant", F.when(F.col("role") != "system", F.col("role"))).alias("type"))


@query("prefer_transcript", """
SELECT conv_id, role, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY role = 'user', turn) = 1
""")
def prefer_transcript(spark, sf_dir):
    tracks = load(spark, sf_dir, "conversations").withColumn("is_generated", F.col("role") == "user")
    return mutation.prefer_transcript(tracks, "conv_id", position="turn").select("conv_id", "role", "text")


@query("keyword_slug", "SELECT o_orderkey, replace(replace(o_orderpriority, ' ', '_'), '-', '_') AS slug FROM orders")
def keyword_slug(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", scalars.keyword_slug(F.col("o_orderpriority")).alias("slug"))


_SENTENCES = "greatest(1, len(regexp_extract_all(text, '[.!?]+(\\s|$)')))"
READABILITY_SQL = f"""
SELECT doc_id, round(0.39 * w / s + 11.8 * syl / w - 15.59, 8) AS fk, round(4.71 * chars / w + 0.5 * w / s - 21.43, 8) AS ari
FROM (
  SELECT doc_id, CAST(len(ws) AS DOUBLE) AS w, {_SENTENCES} AS s,
         list_sum(list_transform(ws, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+'))))) AS syl,
         list_sum(list_transform(ws, lambda x: length(x))) AS chars
  FROM (SELECT doc_id, text, {_W} AS ws FROM documents)
)
"""


@query("readability_fk", f"SELECT doc_id, fk FROM ({READABILITY_SQL})")
def readability_fk(spark, sf_dir):
    return rounded(load(spark, sf_dir, "documents").select("doc_id", text.readability_fk(F.col("text")).alias("fk")), "fk", digits=8)


@query("readability_ari", f"SELECT doc_id, ari FROM ({READABILITY_SQL})")
def readability_ari(spark, sf_dir):
    return rounded(load(spark, sf_dir, "documents").select("doc_id", text.readability_ari(F.col("text")).alias("ari")), "ari", digits=8)


LEXICON = {"worthless": (0.0, 0.75), "in": (0.125, 0.0), "and": (0.25, 0.0), "pour": (0.0, 0.125), "und": (0.5, 0.25), "the": (1.0, 0.0)}
STOPWORDS = ["the", "of"]
_VALENCE_CASE = " ".join(f"WHEN '{w}' THEN {p - n}" for w, (p, n) in LEXICON.items() if w not in STOPWORDS)


def lexicon_frames(spark):
    words = F.explode(F.array(*[F.struct(F.lit(w).alias("token"), F.lit(p).alias("pos"), F.lit(n).alias("neg"))
                                for w, (p, n) in LEXICON.items()])).alias("x")
    stop = F.explode(F.array(*[F.lit(w) for w in STOPWORDS])).alias("token")
    return spark.range(1).select(words).select("x.*"), spark.range(1).select(stop)


@query("valence_density", f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}'']+|[^\\p{{L}}\\p{{N}}''\\s]')) AS token FROM documents),
     v AS (SELECT doc_id, CASE token {_VALENCE_CASE} END AS score FROM t)
SELECT d.doc_id, round(coalesce(avg(score), 0), 6) AS valence, round(coalesce(CAST(count(score) AS DOUBLE) / count(v.doc_id), 0), 6) AS density
FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id GROUP BY 1
""")
def valence_density(spark, sf_dir):
    lexicon_rows, stopwords = lexicon_frames(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return rounded(lexicon.valence_density(docs, "doc_id", "text", lexicon_rows, stopwords), "valence", "density")


@query("interaction_feature", """
SELECT vec_id, label, CAST(len(embedding) + 1 AS BIGINT) AS width, round(CAST(embedding[1] AS DOUBLE) * CAST(embedding[2] AS DOUBLE), 6) AS product FROM embeddings
""")
def interaction_feature(spark, sf_dir):
    from corpuscope.operators.features import interaction

    rows = load(spark, sf_dir, "embeddings").select("vec_id", "label", interaction(F.col("embedding").cast("array<double>")).alias("v"))
    return rows.select("vec_id", "label", F.size("v").cast("bigint").alias("width"), F.round(F.element_at("v", -1), 6).alias("product"))


@query("label_map", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'English' ELSE lang END AS language FROM documents
""")
def label_map(spark, sf_dir):
    from corpuscope.fixed_values import LANGUAGE_LABELS

    return load(spark, sf_dir, "documents").select("doc_id", scalars.label_map(F.col("lang"), LANGUAGE_LABELS).alias("language"))


# --- joins -----------------------------------------------------------------------

@query("pending_transcripts", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')
""")
def pending_transcripts(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return joins.pending(docs, load(spark, sf_dir, "labels"), docs.where("lang = 'fr'"), "doc_id")


@query("sampling_frame", """
SELECT o_orderkey, o_custkey, status FROM orders JOIN (
  SELECT l_orderkey, CASE WHEN min(l_returnflag) = 'A' THEN NULL ELSE min(l_linestatus) END AS status FROM lineitem GROUP BY 1) t
  ON o_orderkey = l_orderkey
WHERE status IS NOT NULL AND o_orderkey NOT IN (SELECT doc_id FROM labels)
""")
def sampling_frame(spark, sf_dir):
    transcripts = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.when(F.min("l_returnflag") != "A", F.min("l_linestatus")).alias("status"))
    labelled = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("o_orderkey"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return joins.sampling_frame(orders, transcripts, labelled, "o_orderkey", "status")


@query("labelled_results", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def labelled_results(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return joins.semi_filter(docs, load(spark, sf_dir, "labels"), "doc_id")


@query("feature_join", """
SELECT t.video_id, t.lines, o.o_custkey AS channel_id, o.o_orderpriority AS title, c.c_mktsegment AS title_channel
FROM (SELECT l_orderkey + 5 AS video_id, count(*) AS lines FROM lineitem GROUP BY 1) t
LEFT JOIN orders o ON t.video_id = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey
""")
def feature_join(spark, sf_dir):
    videos = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("video_id"), F.col("o_custkey").alias("channel_id"), F.col("o_orderpriority").alias("title"))
    channels = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel_id"), F.col("c_mktsegment").alias("title"))
    # Shifted ids: some transcripts have no video.
    transcripts = load(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") + 5).alias("video_id")).agg(
        F.count(F.lit(1)).alias("lines"))
    return joins.feature_join(videos, channels, transcripts)


@query("category_engagement", f"""
WITH {standins.ITEMS_SQL}, {standins.VIDEOS_SQL}
SELECT category, round(median(views), 6) AS median_views, round(median(likes), 6) AS median_likes,
       round(median(comments), 6) AS median_comments, round(median(minutes), 6) AS median_minutes
FROM mentions m JOIN videos v ON m.video_id = v.video_id WHERE category IN ({standins.SQL_KNOWN}) GROUP BY 1
""")
def category_engagement(spark, sf_dir):
    found = coverage.category_engagement(
        standins.items(spark, sf_dir), standins.taxonomy(spark), standins.videos(spark, sf_dir))
    return rounded(found, "median_views", "median_likes", "median_comments", "median_minutes")


@query("search_stats_join", """
SELECT o_orderkey, o_orderpriority, q FROM orders LEFT JOIN (
  SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) ON o_orderkey = l_orderkey
""")
def search_stats_join(spark, sf_dir):
    found = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    totals = load(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").groupBy(
        F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    return joins.search_stats_join(found, totals, "o_orderkey")


@query("feature_attach", f"""
SELECT d.doc_id, lang, fk FROM documents d LEFT JOIN (
  SELECT doc_id, fk FROM ({READABILITY_SQL}) WHERE doc_id IN (SELECT doc_id FROM labels)) r ON d.doc_id = r.doc_id
""")
def feature_attach(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    computed = joins.semi_filter(docs, load(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", F.round(text.readability_fk(F.col("text")), 8).alias("fk"))
    return docs.select("doc_id", "lang").join(computed, "doc_id", "left")


@query("label_align", """
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value, CAST(l.value AS BIGINT) AS value, l.split
FROM embeddings JOIN (
  SELECT doc_id, quality AS value, 'train' AS split FROM labels WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, toxic, 'heldout' FROM labels WHERE doc_id % 2 <> 0) l ON vec_id = l.doc_id
""")
def label_align(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    train = labels.where("doc_id % 2 = 0").select(F.col("doc_id").alias("vec_id"), F.col("quality").alias("value"))
    heldout = labels.select(F.col("doc_id").alias("vec_id"), F.col("toxic").alias("value"))
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value"))
    return to_bigint(joins.align_labels(vectors, train, heldout, "vec_id", "value"), "value")


@query("feature_select", f"""
WITH {standins.METRICS_SQL}
SELECT o_orderkey, round(ln(1 + views_per_day), 6) AS log1p_views_per_day, likes_per_day, o_orderpriority
FROM m WHERE views_per_day IS NOT NULL AND likes_per_day IS NOT NULL
""")
def feature_select(spark, sf_dir):
    from corpuscope.operators.features import log1p_columns

    columns = ["views_per_day", "likes_per_day"]
    frame = log1p_columns(standins.order_metrics(spark, sf_dir).dropna(subset=columns), columns)
    kept = frame.select("o_orderkey", "log1p_views_per_day", "likes_per_day", "o_orderpriority")
    return rounded(kept, "log1p_views_per_day")
