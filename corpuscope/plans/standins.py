"""The given tables in the roles of items, channels, transcripts, labels and scores.

Each frame has a SQL twin (``*_SQL``) used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuscope.functions.scalars import age_days, clock_text, literal_map, rate_per_day
from corpuscope.functions.text import words
from corpuscope.plans.registry import load
from corpuscope.sources.payloads import taxonomy_from_text

SNAPSHOT = "2001-08-01"

TAXONOMY = """
    Articles: 'the', 'les', 'los', 'das'
    Conjunctions: 'and', 'und', 'the'
    Prepositions: 'in', 'for', 'by'
    Absent: 'zzzz'
"""
KNOWN = ["Articles", "Conjunctions", "Prepositions", "Absent"]
WORD_CATEGORY = {
    "the": "Articles", "les": "Articles", "los": "Articles", "das": "Articles", "and": "Conjunctions",
    "und": "Conjunctions", "in": "Prepositions", "for": "Prepositions", "with": "Particles", "que": "Pronouns",
}

SQL_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
_SQL_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in WORD_CATEGORY.items()) + "}"
_SQL_CANDIDATES = "[" + ", ".join(f"'{k}'" for k in WORD_CATEGORY) + "]"
SQL_KNOWN = ", ".join(f"'{k}'" for k in KNOWN)

ITEMS_SQL = f"""
items AS (
  SELECT CAST(doc_id AS VARCHAR) AS video_id,
         list_transform(list_filter({_SQL_CANDIDATES}, lambda c: list_contains(ws, c)), lambda c: {_SQL_MAP}[c]) AS matching_categories
  FROM (SELECT doc_id, {SQL_WORDS.format('lower(text)')} AS ws FROM documents)
), mentions AS (SELECT video_id, unnest(matching_categories) AS category FROM items)
"""

VIDEOS_SQL = """
videos AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS video_id, n_chars AS views, quality AS likes, toxic AS comments,
         CASE WHEN n_chars < 86400 THEN floor(n_chars / 3600) * 60 + floor((n_chars % 3600) / 60) + (n_chars % 60) / 60.0 END AS minutes
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)
"""

METRICS_SQL = """
m AS (
  SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, views, likes, comments, age,
         CASE WHEN age <> 0 THEN views / age END AS views_per_day,
         CASE WHEN age <> 0 THEN likes / age END AS likes_per_day,
         CASE WHEN age <> 0 THEN CAST(comments AS DOUBLE) / age END AS comments_per_day
  FROM (
    SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_totalprice AS views, likes, comments,
           CAST(floor((epoch(TIMESTAMP '2001-08-01') - epoch(o_orderdate)) / 86400) AS BIGINT) AS age
    FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS likes, count(*) AS comments FROM lineitem GROUP BY 1)
      ON o_orderkey = l_orderkey
  )
)
"""

SCORES_SQL = """
s AS (
  SELECT d.doc_id AS id, quality AS y, toxic AS pred, n_chars / (SELECT CAST(max(n_chars) AS DOUBLE) FROM documents) AS p
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id
)
"""

KEYWORDS_SQL = "k AS (SELECT p_partkey, p_brand, replace(p_name, ' ', ', ') AS keywords FROM part)"
PART_WORDS = ["red", "blue", "small", "ring", "bolt", "hot", "neverused"]
SQL_PART_WORDS = ", ".join(f"'{w}'" for w in PART_WORDS)
PART_TOPICS = {"color": ["red", "blue", "green"], "shape": ["ring", "bolt"], "warm": ["red", "hot"]}


def taxonomy(spark: SparkSession) -> DataFrame:
    return taxonomy_from_text(spark, TAXONOMY)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the categories of the marker words they contain."""
    found = F.array_intersect(words(F.lower("text")), F.array(*[F.lit(w) for w in WORD_CATEGORY]))
    lookup = literal_map(WORD_CATEGORY)
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("video_id"),
        F.transform(found, lambda w: F.element_at(lookup, w)).alias("matching_categories"),
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as videos: characters as views and seconds, labels as likes and comments."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.join(load(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("video_id"), F.col("n_chars").cast("string").alias("view_count"),
        F.coalesce(F.col("quality").cast("string"), F.lit("N/A")).alias("like_count"),
        F.coalesce(F.col("toxic").cast("string"), F.lit("N/A")).alias("comment_count"),
        clock_text(F.col("n_chars")).alias("duration"),
    )


def order_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as videos with rates per day of age; ages of 0 days give NULL rates."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("likes"), F.count(F.lit(1)).alias("comments"))
    base = load(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.col("o_totalprice").alias("views"),
        "likes", "comments", age_days(F.col("o_orderdate"), SNAPSHOT).alias("age"),
    )
    return base.withColumns({
        f"{c}_per_day": rate_per_day(F.col(c), F.col("age")) for c in ("views", "likes", "comments")
    })


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: truth, a predicted class and a score from the text length."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    longest = docs.agg(F.max("n_chars").cast("double").alias("m")).scalar()
    scored = docs.withColumn("p", F.col("n_chars") / longest)
    return load(spark, sf_dir, "labels").join(scored, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y"), F.col("toxic").alias("pred"), "p")


def part_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", F.replace("p_name", F.lit(" "), F.lit(", ")).alias("keywords"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
