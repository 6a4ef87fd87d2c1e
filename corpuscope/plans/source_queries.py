"""Sources, sinks and keyed mutation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope import schemas
from corpuscope.functions.hashing import hash_uniform
from corpuscope.operators import models, mutation, sampling
from corpuscope.plans import standins
from corpuscope.plans.registry import load, query, rounded, to_bigint
from corpuscope.session import scratch_path
from corpuscope.sources import payloads, tables
from corpuscope.sources.snapshots import SnapshotTable


# --- scans -----------------------------------------------------------------

@query("scan_table", "SELECT * FROM customer")
def scan_table(spark, sf_dir):
    return tables.read_table(spark, f"{sf_dir}/customer.parquet")


@query("scan_project", "SELECT o_orderkey FROM orders")
def scan_project(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey")


@query("table_exists", """
SELECT 'doc_id' AS name, true AS present, count(doc_id) AS n FROM documents
UNION ALL SELECT 'lang', true, count(lang) FROM documents
UNION ALL SELECT 'channel_id', false, count(NULL) FROM documents
""")
def column_probe(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    wanted = ["doc_id", "lang", "channel_id"]
    filled = docs
    for name in wanted:
        filled = schemas.add_column_if_missing(filled, name, "string")
    cells = F.array(*[
        F.struct(F.lit(c).alias("name"), F.lit(c in docs.columns).alias("present"), F.col(c).alias("n")) for c in wanted
    ])
    counts = filled.agg(*[F.count(c).alias(c) for c in wanted])
    return counts.select(F.explode(cells).alias("c")).select("c.*")


@query("jsonl_scan", f"""
WITH {standins.ITEMS_SQL}
SELECT video_id, CAST(len(matching_categories) AS BIGINT) AS n_categories FROM items
""")
def jsonl_scan(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    # Empty lists are left out of the written lines, as a labeller may do.
    found = standins.items(spark, sf_dir)
    found.withColumn(
        "matching_categories", F.when(F.size("matching_categories") > 0, F.col("matching_categories"))
    ).write.json(path)
    rows = tables.read_jsonl(spark, path)
    return rows.select("video_id", F.size("matching_categories").cast("bigint").alias("n_categories"))


@query("keyword_dim", """
SELECT keyword, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS keyword FROM part) GROUP BY 1
""")
def keyword_dim(spark, sf_dir):
    listed = load(spark, sf_dir, "part").select(F.to_json(F.split("p_name", " ")).alias("json"))
    return tables.explode_keywords(listed, "json").groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


@query("csv_scan", """
SELECT CAST(doc_id AS VARCHAR) AS video_id, CAST(quality AS BIGINT) AS predicted_label, toxic / 2.0 AS confidence FROM labels
""")
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = load(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("video_id"), F.col("quality").alias("predicted_label"), (F.col("toxic") / 2).alias("confidence"))
    tables.write_csv(rows, path)
    return to_bigint(tables.read_csv(spark, path), "predicted_label")


@query("embedding_scan", """
SELECT CAST(vec_id AS VARCHAR) AS video_id, CAST(len(embedding) AS BIGINT) AS width,
       round(CAST(embedding[1] AS DOUBLE), 6) AS first_value
FROM embeddings
""")
def embedding_scan(spark, sf_dir):
    rows = tables.read_embeddings(spark, f"{sf_dir}/embeddings.parquet", key="vec_id")
    return rows.select(
        F.col("vec_id").cast("string").alias("video_id"), F.size("embedding").cast("bigint").alias("width"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value"))


@query("id_list_scan", "SELECT CAST(doc_id AS VARCHAR) AS video_id FROM labels")
def id_list_scan(spark, sf_dir):
    path = scratch_path(spark, "ids")
    load(spark, sf_dir, "labels").select(F.col("doc_id").cast("string")).write.text(path)
    return tables.read_ids(spark, path)


# --- landed JSON -------------------------------------------------------------

@query("flatten_search", """
SELECT CAST(o_orderkey AS VARCHAR) AS video_id, o_orderpriority AS title, CAST(o_custkey AS VARCHAR) AS channel_title,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS published_at
FROM orders
""")
def flatten_search(spark, sf_dir):
    item = F.struct(
        F.struct(F.col("o_orderkey").cast("string").alias("videoId")).alias("id"),
        F.struct(
            F.col("o_orderpriority").alias("title"), F.col("o_custkey").cast("string").alias("channelTitle"),
            standins.iso(F.col("o_orderdate")).alias("publishedAt"),
        ).alias("snippet"),
    )
    # Pages of at most 50 items, as the search interface returns them.
    pages = load(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 50).alias("page")).agg(
        F.collect_list(item).alias("items"))
    return payloads.flatten_search(pages.select(F.to_json(F.struct("items")).alias("json")))


@query("flatten_stats", """
SELECT CAST(o_orderkey AS VARCHAR) AS video_id, 'N/A' AS description,
       CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE array_to_string(string_split(o_orderpriority, '-'), ', ') END AS tags,
       'N/A' AS audio_language, o_orderstatus AS textual_language, 'PT0S' AS duration, 'hd' AS definition, 'N/A' AS caption_availability,
       CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE CAST(o_custkey AS VARCHAR) END AS view_count,
       'N/A' AS like_count, 'N/A' AS comment_count, 'N/A' AS paid_product_placement
FROM orders
""")
def flatten_stats(spark, sf_dir):
    item = F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.struct(
            F.when(F.col("o_orderkey") % 3 != 0, F.split("o_orderpriority", "-")).alias("tags"),
            F.col("o_orderstatus").alias("defaultLanguage"),
        ).alias("snippet"),
        F.struct(F.lit("hd").alias("definition")).alias("contentDetails"),
        F.struct(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey").cast("string")).alias("viewCount")).alias("statistics"),
    )
    raw = load(spark, sf_dir, "orders").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("json"))
    return payloads.flatten_stats(raw)


@query("flatten_channel", """
SELECT CAST(c_custkey AS VARCHAR) AS channel_id, c_name AS title, '' AS description, c_mktsegment AS localized_title,
       '' AS localized_description, '' AS published_at,
       CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS country,
       CAST(c_custkey AS BIGINT) AS view_count, CAST(0 AS BIGINT) AS subscriber_count, CAST(c_nationkey AS BIGINT) AS video_count,
       CAST(NULL AS VARCHAR) AS likes_playlist, c_name AS uploads_playlist
FROM customer
""")
def flatten_channel(spark, sf_dir):
    item = F.struct(
        F.col("c_custkey").cast("string").alias("id"),
        F.struct(
            F.col("c_name").alias("title"), F.struct(F.col("c_mktsegment").alias("title")).alias("localized"),
            F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey").cast("string")).alias("country"),
        ).alias("snippet"),
        F.struct(F.col("c_custkey").cast("string").alias("viewCount"), F.col("c_nationkey").cast("string").alias("videoCount")).alias("statistics"),
        F.struct(F.struct(F.col("c_name").alias("uploads")).alias("relatedPlaylists")).alias("contentDetails"),
    )
    raw = load(spark, sf_dir, "customer").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("json"))
    return payloads.flatten_channel(raw)


def _thread_payloads(spark, sf_dir):
    """Each turn as a thread whose text lines after the first are its replies."""
    turns = load(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("tid"),
        F.col("conv_id").cast("string").alias("vid"), F.split("text", "\n").alias("lines"))
    comment = lambda text: F.struct(F.struct(text.alias("textDisplay")).alias("snippet"))
    replies = F.transform(
        F.slice("lines", 2, F.size("lines")),
        lambda line, i: F.struct(
            F.concat_ws(".", F.col("tid"), i.cast("string")).alias("id"), F.struct(line.alias("textDisplay")).alias("snippet")))
    item = F.struct(
        F.col("tid").alias("id"),
        F.struct(
            F.col("vid").alias("videoId"), comment(F.get("lines", F.lit(0))).alias("topLevelComment"),
            (F.size("lines") - 1).cast("bigint").alias("totalReplyCount"),
        ).alias("snippet"),
        F.when(F.size("lines") > 1, F.struct(replies.alias("comments"))).alias("replies"),
    )
    return turns.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("json"))


@query("flatten_threads", """
SELECT conv_id || '-' || turn AS thread_id, CAST(conv_id AS VARCHAR) AS video_id, string_split(text, chr(10))[1] AS top_level_text,
       CAST(0 AS BIGINT) AS top_level_like_count, CAST(NULL AS VARCHAR) AS top_level_published_at,
       CAST(NULL AS VARCHAR) AS top_level_updated_at, CAST(len(string_split(text, chr(10))) - 1 AS BIGINT) AS total_reply_count
FROM conversations
""")
def flatten_threads(spark, sf_dir):
    return payloads.flatten_threads(_thread_payloads(spark, sf_dir))


@query("flatten_replies", """
SELECT thread_id || '.' || (i - 2) AS reply_id, thread_id, video_id, lines[i] AS reply_text, CAST(0 AS BIGINT) AS reply_like_count,
       CAST(NULL AS VARCHAR) AS reply_published_at, CAST(NULL AS VARCHAR) AS reply_updated_at
FROM (
  SELECT conv_id || '-' || turn AS thread_id, CAST(conv_id AS VARCHAR) AS video_id, string_split(text, chr(10)) AS lines,
         unnest(range(2, len(string_split(text, chr(10))) + 1)) AS i
  FROM conversations
)
""")
def flatten_replies(spark, sf_dir):
    return payloads.flatten_replies(_thread_payloads(spark, sf_dir))


@query("transcript_assemble", """
SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS transcript FROM conversations GROUP BY 1
""")
def transcript_assemble(spark, sf_dir):
    return payloads.assemble_transcripts(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("taxonomy_terms", """
SELECT p_brand AS category, unnest(string_split(p_name, ' ')) AS term FROM part
""")
def taxonomy_terms(spark, sf_dir):
    line = F.concat(F.lit("  "), F.col("p_brand"), F.lit(": '"), F.replace("p_name", F.lit(" "), F.lit("', '")), F.lit("'"))
    return payloads.taxonomy_terms(load(spark, sf_dir, "part").select(line.alias("line")))


# --- mutation ----------------------------------------------------------------

_EVENT_KEY = "user_id, CAST(ts AS DATE)"


# All events, half of them as the stored table and half as the batch, by a hash of the id.
_HALF = {"target": "< 0.5", "batch": ">= 0.5"}
_EVENT_DRAW = "(CAST('0x' || substr(md5(event_id || ':42'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"


def _events_half(spark, sf_dir, half):
    events = load(spark, sf_dir, "events").withColumn("_u", hash_uniform(F.col("event_id")))
    return events.where(f"_u {_HALF[half]}").drop("_u")


def _daily(spark, sf_dir, half):
    return _events_half(spark, sf_dir, half).select("user_id", F.to_date("ts").cast("string").alias("day"), "ts", "event_id", "value")


def _daily_sql(half, direction):
    return f"""(
  SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, value FROM events WHERE {_EVENT_DRAW} {_HALF[half]}
  QUALIFY row_number() OVER (PARTITION BY {_EVENT_KEY} ORDER BY ts {direction}, event_id {direction}) = 1)"""


@query("upsert_ignore", f"""
WITH t AS {_daily_sql('target', 'ASC')}, b AS {_daily_sql('batch', 'ASC')}
SELECT * FROM t UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = b.user_id AND t.day = b.day)
""")
def upsert_ignore(spark, sf_dir):
    keys, order = ["user_id", "day"], ["ts", "event_id"]
    target = mutation.keep_first(_daily(spark, sf_dir, "target"), keys, order)
    return mutation.upsert_ignore(target, _daily(spark, sf_dir, "batch"), keys, order).drop("ts")


@query("upsert_replace", f"""
WITH t AS {_daily_sql('target', 'ASC')}, b AS {_daily_sql('batch', 'DESC')}
SELECT * FROM b UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE t.user_id = b.user_id AND t.day = b.day)
""")
def upsert_replace(spark, sf_dir):
    keys, order = ["user_id", "day"], ["ts", "event_id"]
    target = mutation.keep_first(_daily(spark, sf_dir, "target"), keys, order)
    return mutation.upsert_replace(target, _daily(spark, sf_dir, "batch"), keys, order).drop("ts")


@query("append_checked", "SELECT event_id, user_id, value FROM events")
def append_checked(spark, sf_dir):
    half = lambda name: _events_half(spark, sf_dir, name).select("event_id", "user_id", "value")
    return mutation.append_checked(half("target"), half("batch"), "event_id")


@query("update_by_key", """
SELECT o_orderkey, o_custkey, CASE WHEN u.l_orderkey IS NOT NULL THEN 'R' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN u.l_orderkey IS NOT NULL THEN u.q ELSE o_totalprice END AS o_totalprice
FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) u
  ON o_orderkey = l_orderkey
""")
def update_by_key(spark, sf_dir):
    returned = load(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").groupBy(
        F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("o_totalprice"))
    target = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return mutation.update_by_key(
        target, returned.withColumn("o_orderstatus", F.lit("R")), "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("add_column_if_missing", "SELECT doc_id, lang, CAST(NULL AS VARCHAR) AS channel_id FROM documents")
def add_column_if_missing(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return schemas.add_column_if_missing(schemas.add_column_if_missing(docs, "lang", "string"), "channel_id", "string")


@query("schemas", """
SELECT conv_id || '-' || turn AS reply_id, CAST(conv_id AS VARCHAR) AS thread_id, CAST(NULL AS VARCHAR) AS video_id,
       text AS reply_text, CAST(turn AS BIGINT) AS reply_like_count, CAST(NULL AS VARCHAR) AS reply_published_at,
       CAST(NULL AS VARCHAR) AS reply_updated_at
FROM conversations
""")
def conform(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("reply_id"),
        F.col("conv_id").alias("thread_id"), F.col("text").alias("reply_text"), F.col("turn").alias("reply_like_count"))
    return schemas.conform(rows, schemas.REPLIES)


@query("replace_table", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def replace_table(spark, sf_dir):
    path = scratch_path(spark, "replaced")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    tables.replace_table(lines.where(F.col("l_returnflag") == "R"), path)
    return tables.replace_table(lines, path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("csv_sink", "SELECT c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal FROM customer")
def csv_sink(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    tables.write_csv(rows, path)
    return rounded(tables.read_csv(spark, path, rows.schema), "c_acctbal")


_SPLIT_SQL = """
SELECT doc_id, lang, CASE WHEN row_number() OVER (
         PARTITION BY lang ORDER BY CAST('0x' || substr(md5(doc_id || ':42'), 1, 13) AS BIGINT), doc_id)
       <= round(count(*) OVER (PARTITION BY lang) * 0.5) THEN 'val' ELSE 'test' END AS split
FROM documents
"""


@query("split_sink", f"SELECT doc_id, lang FROM ({_SPLIT_SQL}) WHERE split = 'val'")
def split_sink(spark, sf_dir):
    path = scratch_path(spark, "split")
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    tables.write_split(sampling.stratified_split(docs, "doc_id", "lang"), path)
    return tables.read_split(spark, path, "val")


@query("stratified_split", _SPLIT_SQL)
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang")


@query("model_roundtrip", "SELECT vec_id, true AS same FROM embeddings")
def model_roundtrip(spark, sf_dir):
    """Whether a saved and reloaded model, scaler included, gives each row its score again."""
    path = scratch_path(spark, "model")
    rows = load(spark, sf_dir, "embeddings").withColumn("relevant", (F.col("label") >= 5).cast("int"))
    rows = models.with_features(rows, "embedding").select("vec_id", "features", "relevant")
    model = models.fit_logreg(rows, "relevant")
    models.save_model(model, path)
    before = models.pipeline_scorer(model)(rows).withColumnRenamed("score", "before")
    both = models.load_scorer(path)(before)
    return both.select("vec_id", (F.abs(F.col("score") - F.col("before")) < 1e-12).alias("same"))


@query("merge_keyword_tables", """
WITH f AS (
  SELECT p_brand, string_split(p_name, ' ')[1] AS keyword, p_type, p_partkey FROM part
  UNION ALL SELECT p_brand, string_split(p_name, ' ')[2], p_type, p_partkey FROM part
)
SELECT p_brand, string_agg(DISTINCT keyword, ',' ORDER BY keyword) AS keywords,
       arg_max(p_type, p_partkey) AS p_type, max(p_partkey) AS p_partkey
FROM f GROUP BY 1
""")
def merge_keyword_tables(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    found = [
        part.select("p_brand", F.get(F.split("p_name", " "), F.lit(i)).alias("keyword"), "p_type", "p_partkey")
        for i in (0, 1)
    ]
    return mutation.merge_keyword_tables(found, "p_brand", "keyword", "p_partkey")


@query("snapshot_update", """
SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, 2 AS version FROM orders
UNION ALL SELECT o_orderkey, o_orderstatus, 1 FROM orders
""")
def snapshot_update(spark, sf_dir):
    """An update by key as a new version of a table; the version before it can still be read."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changes = load(spark, sf_dir, "orders").where("o_totalprice > 150000").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    table = SnapshotTable(spark, scratch_path(spark, "snapshots"))
    table.replace(orders)
    table.change(lambda rows: mutation.update_by_key(rows, changes, "o_orderkey", ["o_orderstatus"]))
    return table.read().withColumn("version", F.lit(2)).unionByName(table.read(1).withColumn("version", F.lit(1)))
