"""Model, neighbour and streaming operators over the given tables."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corpuscope.functions import text
from corpuscope.functions.hashing import hash_uniform
from corpuscope.operators import features, filters, metrics, models, mutation, neighbours, sampling
from corpuscope.plans import coverage, engagement, relevance, standins
from corpuscope.plans.aggregate_queries import COMPLETE_CTE, RATES, complete_metrics
from corpuscope.plans.registry import load, query, rounded, to_bigint
from corpuscope.plans.standins import SQL_WORDS
from corpuscope.session import materialise, scratch_path
from corpuscope.streaming import ingest

# --- principal components: closed form for three standardised variables ---------------

_PCA_SQL = f"""
{COMPLETE_CTE},
mo AS (SELECT avg(views_per_day) AS a1, avg(likes_per_day) AS a2, avg(comments_per_day) AS a3, stddev_pop(views_per_day) AS s1,
              stddev_pop(likes_per_day) AS s2, stddev_pop(comments_per_day) AS s3, corr(views_per_day, likes_per_day) AS x,
              corr(views_per_day, comments_per_day) AS y, corr(likes_per_day, comments_per_day) AS z FROM c),
p AS (SELECT *, sqrt((x * x + y * y + z * z) / 3) AS p FROM mo),
phi AS (SELECT *, acos(least(1, greatest(-1, x * y * z / (p * p * p)))) / 3 AS phi FROM p),
ev AS (SELECT *, unnest([1, 2, 3]) AS pc, unnest([1 + 2 * p * cos(phi), 1 + 2 * p * cos(phi - 2 * pi() / 3), 1 + 2 * p * cos(phi + 2 * pi() / 3)]) AS root FROM phi),
u AS (SELECT *, x * z - y * (1 - root) AS u1, y * x - (1 - root) * z AS u2, (1 - root) * (1 - root) - x * x AS u3 FROM ev),
v AS (SELECT *, sign(u1 + u2 + u3) / sqrt(u1 * u1 + u2 * u2 + u3 * u3) AS k FROM u)
"""


@query("pca_loadings", f"""
WITH {_PCA_SQL}
SELECT unnest(['views_per_day', 'likes_per_day', 'comments_per_day']) AS feature, CAST(pc AS BIGINT) AS pc,
       round(unnest([u1 * k, u2 * k, u3 * k]), 5) AS loading, round(root / 3, 5) AS explained FROM v
""")
def pca_loadings(spark, sf_dir):
    rows = complete_metrics(spark, sf_dir).select("o_orderkey", *RATES)
    found = features.fit_components(rows, RATES).loadings(rows)
    return to_bigint(rounded(found, "loading", "explained", digits=5), "pc")


@query("engagement_index", f"""
WITH {_PCA_SQL}
SELECT o_orderkey, round(k * (u1 * (views_per_day - a1) / s1 + u2 * (likes_per_day - a2) / s2 + u3 * (comments_per_day - a3) / s3), 5) AS engagement_index
FROM c, v WHERE pc = 1
""")
def engagement_index(spark, sf_dir):
    rows = complete_metrics(spark, sf_dir).select("o_orderkey", *RATES)
    scored = features.fit_components(rows, RATES, k=1).score(rows)
    return rounded(scored.select("o_orderkey", "engagement_index"), "engagement_index", digits=5)


# --- regression --------------------------------------------------------------------------

_OLS_SQL = """
g AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my,
             var_pop(l_quantity) * count(*) AS s11, var_pop(l_discount) * count(*) AS s22, var_pop(l_extendedprice) * count(*) AS syy,
             covar_pop(l_quantity, l_discount) * count(*) AS s12, covar_pop(l_quantity, l_extendedprice) * count(*) AS s1y,
             covar_pop(l_discount, l_extendedprice) * count(*) AS s2y FROM lineitem),
b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
             (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM g),
e AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, (syy - b1 * s1y - b2 * s2y) AS sse, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS s2 FROM b),
o AS (SELECT *, sqrt(s2 * s22 / det) AS e1, sqrt(s2 * s11 / det) AS e2,
             sqrt(s2 * (1 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) AS e0, 1 - sse / syy AS r2 FROM e)
"""
_OLS_FEATURES = ["l_quantity", "l_discount"]


@query("ols_summary", f"""
WITH {_OLS_SQL}
SELECT unnest(['l_quantity', 'l_discount', 'const']) AS term, round(unnest([b1, b2, b0]), 4) AS coef, round(unnest([e1, e2, e0]), 4) AS std_err,
       round(unnest([b1 / e1, b2 / e2, b0 / e0]), 4) AS t, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS adj_r2 FROM o
""")
def ols_summary(spark, sf_dir):
    model = models.fit_ols(load(spark, sf_dir, "lineitem"), _OLS_FEATURES, "l_extendedprice")
    found = models.ols_summary(spark, model, _OLS_FEATURES).drop("p_value")
    return rounded(rounded(found, "coef", "std_err", "t", digits=4), "r2", "adj_r2")


@query("ols_residuals", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, round(b0 + b1 * l_quantity, 4) AS fitted,
       round(l_extendedprice - b0 - b1 * l_quantity, 4) AS residual
FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS b0 FROM lineitem)
""")
def ols_residuals(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    model = models.fit_ols(lines, ["l_quantity"], "l_extendedprice")
    found = models.ols_residuals(lines, model, ["l_quantity"], "l_extendedprice").drop("l_quantity", "l_extendedprice")
    return to_bigint(rounded(found, "fitted", "residual", digits=4), "l_linenumber")


@query("vif", """
SELECT unnest(['l_quantity', 'l_extendedprice']) AS feature, round(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)), 6) AS vif FROM lineitem
""")
def vif(spark, sf_dir):
    return rounded(models.vif(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]), "vif")


@query("feature_matrix", f"""
WITH {COMPLETE_CTE}, w AS (SELECT 2 + count(DISTINCT o_orderpriority) AS width FROM c),
     f AS (SELECT min(o_orderpriority) AS base FROM c)
SELECT o_orderkey, CAST(width AS BIGINT) AS width, views_per_day, likes_per_day, comments_per_day,
       CAST(o_orderpriority <> base AS DOUBLE) AS dummies FROM c, w, f
""")
def feature_matrix(spark, sf_dir):
    """Rates and dummies as one vector column, taken apart again."""
    rows = features.one_hot(complete_metrics(spark, sf_dir), "o_orderpriority", "priority")
    columns = [*RATES, *filters.select_prefix(rows, ["priority_"])]
    cells = features.assemble(rows.select("o_orderkey", *columns), columns).select(
        "o_orderkey", vector_to_array("features").alias("f"))
    return cells.select(
        "o_orderkey", F.size("f").cast("bigint").alias("width"), *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(RATES)],
        F.aggregate(F.slice("f", 4, len(columns)), F.lit(0.0), lambda total, x: total + x).alias("dummies"))


# --- classifiers ---------------------------------------------------------------------------

# A label that the vector decides, so that a model which learns nothing is found out.
_LABEL = "embedding[{0}] + embedding[{1}] > 0"
_DRAW_SQL = "(CAST('0x' || substr(md5(vec_id || ':42'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"
_HELD_SQL = f"SELECT vec_id, CAST({_LABEL.format(1, 2)} AS BIGINT) AS label FROM embeddings WHERE {_DRAW_SQL} >= 0.6"
_LEAST_AUC = 0.7


def labelled_vectors(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr(f"CAST({_LABEL.format(0, 1)} AS INT) AS label"))
    return models.with_features(rows, "embedding").drop("embedding")


def _halves(spark, sf_dir):
    rows = labelled_vectors(spark, sf_dir).withColumn("_u", hash_uniform(F.col("vec_id")))
    return rows.where("_u < 0.6").drop("_u"), rows.where("_u >= 0.6").drop("_u")


def _facts(scored):
    """A row per held-out vector: whether its score is a probability, and the model's ranking beats chance by far."""
    scored = materialise(scored.select("vec_id", "label", "score"), "scored")
    learned = metrics.roc_auc(scored, "label", "score").head()["roc_auc"] > _LEAST_AUC
    return to_bigint(scored.select(
        "vec_id", "label", F.col("score").between(0.0, 1.0).alias("valid"), F.lit(learned).alias("learned")), "label")


_FACTS_SQL = f"SELECT *, true AS valid, true AS learned FROM ({_HELD_SQL})"


@query("fit_logreg", _FACTS_SQL)
def fit_logreg(spark, sf_dir):
    train, rest = _halves(spark, sf_dir)
    weight = metrics.class_weight(rest, "label").head()["weight_0"]
    return _facts(models.pipeline_scorer(models.fit_logreg(models.with_class_weight(train, "label", weight)))(rest))


@query("fit_rf", _FACTS_SQL)
def fit_forest(spark, sf_dir):
    train, rest = _halves(spark, sf_dir)
    return _facts(models.pipeline_scorer(models.fit_forest(train))(rest))


@query("fit_gbt", _FACTS_SQL)
def fit_boosted(spark, sf_dir):
    train, rest = _halves(spark, sf_dir)
    return _facts(models.pipeline_scorer(models.fit_boosted(train, val=rest))(rest))


@query("fit_svc", _FACTS_SQL)
def fit_svm(spark, sf_dir):
    train, rest = _halves(spark, sf_dir)
    return _facts(models.fit_linear_svm(train, "vec_id")(rest))


@query("fit_mlp", _FACTS_SQL)
def fit_perceptron(spark, sf_dir):
    train, rest = _halves(spark, sf_dir)
    return _facts(models.pipeline_scorer(models.fit_perceptron(train))(rest))


# Max-min form of isotonic regression over runs a..b of distinct scores.
@query("isotonic_calibrate", f"""
WITH {standins.SCORES_SQL},
g AS (SELECT p, CAST(sum(y) AS DOUBLE) AS sy, CAST(count(*) AS DOUBLE) AS w, row_number() OVER (ORDER BY p) AS i FROM s GROUP BY p),
c AS (SELECT p, i, sum(sy) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw, sy, w FROM g),
r AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.sy) / (b.cw - a.cw + a.w) AS mean FROM c a JOIN c b ON a.i <= b.i),
lo AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM r),
f AS (SELECT i, max(m) OVER (PARTITION BY i) AS fit FROM lo QUALIFY row_number() OVER (PARTITION BY i ORDER BY a) = 1)
SELECT s.id, CAST(y AS BIGINT) AS label, round(fit, 6) AS score FROM s JOIN c ON s.p = c.p JOIN f ON f.i = c.i
""")
def isotonic_calibrate(spark, sf_dir):
    scored = standins.scores(spark, sf_dir).select("id", F.col("y").alias("label"), F.col("p").alias("score"))
    return to_bigint(rounded(models.fit_isotonic(scored)(scored), "score"), "label")


_METRICS = ("roc_auc", "pr_auc", "f1_0", "f1_1", "f1_macro", "f1_micro")


@query("model_leaderboard", """
SELECT unnest(['logreg', 'forest', 'boosted', 'svm', 'mlp']) AS model, true AS valid, true AS learned
""")
def model_leaderboard(spark, sf_dir):
    """All five models in full: metrics within [0, 1], ranking of the test half well above chance."""
    train, rest = _halves(spark, sf_dir)
    val, test = rest.where("vec_id % 2 = 0"), rest.where("vec_id % 2 = 1")
    table, _ = models.compare_models(train, val, test, "vec_id")
    valid = F.lit(True)
    for name in [f"{part}_{m}" for part in ("val", "test") for m in _METRICS] + ["threshold"]:
        valid = valid & F.col(name).between(0.0, 1.0)
    return table.select("model", valid.alias("valid"), (F.col("test_roc_auc") > _LEAST_AUC).alias("learned"))


@query("score_all", f"""
SELECT doc_id, lang, vec_id IS NOT NULL AS scored, CASE WHEN vec_id IS NOT NULL THEN true END AS consistent
FROM documents LEFT JOIN embeddings ON doc_id = vec_id
""")
def score_all(spark, sf_dir):
    """Scores of all vectors written back to the document table by key; documents without vector keep NULLs."""
    train, _ = _halves(spark, sf_dir)
    scorer = models.pipeline_scorer(models.fit_logreg(train))
    scored = models.score_all(scorer, labelled_vectors(spark, sf_dir), "vec_id", 0.5)
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.lit(None).cast("int").alias("predicted_label"), F.lit(None).cast("double").alias("confidence"))
    written = mutation.update_by_key(
        docs, scored.withColumnRenamed("vec_id", "doc_id"), "doc_id", ["predicted_label", "confidence"])
    return written.select(
        "doc_id", "lang", F.col("confidence").isNotNull().alias("scored"),
        (F.col("predicted_label") == (F.col("confidence") >= 0.5).cast("int")).alias("consistent"))


@query("saved_scorer")
def saved_scorer(spark, sf_dir):
    """The best of all models saved with curve and threshold, read again, and the vectors labelled by what was read."""
    train, rest = _halves(spark, sf_dir)
    val, test = rest.where("vec_id % 2 = 0"), rest.where("vec_id % 2 = 1")
    table, scorers = models.compare_models(train, val, test, "vec_id")
    best = models.best_model(table).head()
    path = scratch_path(spark, "scorer")
    scorers[best["model"]].with_threshold(best["threshold"]).save(path)
    labelled = models.ModelScorer.load(path)(labelled_vectors(spark, sf_dir))
    return labelled.select("vec_id", F.lit(best["model"]).alias("model"), "confidence", "predicted_label")


# --- neighbours ------------------------------------------------------------------------------

_VECTORS_SQL = "e AS (SELECT vec_id, embedding, label FROM embeddings)"


def vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


@query("embedding_knn", f"""
WITH {_VECTORS_SQL}, d AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM e)
SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS similarity,
       row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id) AS rank
FROM d a JOIN d b ON a.vec_id <> b.vec_id QUALIFY rank <= 5
""")
def embedding_knn(spark, sf_dir):
    found = neighbours.cosine_neighbours(vectors(spark, sf_dir), "vec_id", "embedding", 5)
    return to_bigint(rounded(found, "similarity"), "rank")


@query("centroid_similarity", f"""
WITH {_VECTORS_SQL},
x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY i) AS m FROM x GROUP BY 1)
SELECT vec_id, CAST(e.label AS BIGINT) AS label, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), m), 6) AS similarity
FROM e JOIN c ON e.label = c.label
""")
def centroid_similarity(spark, sf_dir):
    found = neighbours.centroid_similarity(vectors(spark, sf_dir), "vec_id", "embedding", "label")
    return to_bigint(rounded(found, "similarity"), "label")


@query("smote_balance", f"""
WITH {_VECTORS_SQL}, n AS (SELECT CAST(label >= 7 AS BIGINT) AS label, count(*) AS n FROM e GROUP BY 1)
SELECT label, max(n) OVER () AS n, max(n) OVER () - n AS n_synthetic FROM n
""")
def smote_balance(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("label", (F.col("label") >= 7).cast("int"))
    balanced = neighbours.smote_balance(rows, "vec_id", "embedding", "label")
    counts = balanced.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("synthetic").alias("n_synthetic"))
    return to_bigint(counts, "label")


# --- streams and labelling ---------------------------------------------------------------------

def _event_stream(spark, sf_dir):
    schema = load(spark, sf_dir, "events").schema
    return ingest.open_stream(spark, f"{sf_dir}/event[s].parquet", schema, "parquet"), schema


@query("stream_ingest", """
SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
""")
def stream_ingest(spark, sf_dir):
    stream, schema = _event_stream(spark, sf_dir)
    path, keys = scratch_path(spark, "ingest"), ["user_id", "event_type"]
    ingest.stream_ingest(stream, path, scratch_path(spark, "ingest-checkpoint"), keys, ["ts", "event_id"])
    return ingest.read_ignore(spark, path, schema).select("user_id", "event_type", "event_id", "value")


@query("stream_replace", """
SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
""")
def stream_replace(spark, sf_dir):
    stream, schema = _event_stream(spark, sf_dir)
    path, keys = scratch_path(spark, "ingest"), ["user_id", "event_type"]
    ingest.stream_ingest(stream, path, scratch_path(spark, "ingest-checkpoint"), keys, ["ts", "event_id"], mode="replace")
    return ingest.read_replace(spark, path, schema, keys).select("user_id", "event_type", "event_id", "value")


@query("stream_two_sources", """
SELECT user_id, event_type, max(value) AS value, count(*) AS n FROM (
  SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (
    PARTITION BY user_id, event_type ORDER BY event_type IN ('click', 'view') DESC, ts, event_id) = 1)
GROUP BY 1, 2
""")
def stream_two_sources(spark, sf_dir):
    """Two sources into one table, the first once more after its checkpoint was lost: every key just once."""
    stream, schema = _event_stream(spark, sf_dir)
    path, keys = scratch_path(spark, "ingest"), ["user_id", "event_type"]
    early = F.col("event_type").isin("click", "view")
    for source in (stream.where(early), stream.where(~early), stream.where(early)):
        ingest.stream_ingest(source, path, scratch_path(spark, "ingest-checkpoint"), keys, ["ts", "event_id"])
    return ingest.read_ignore(spark, path, schema).groupBy(*keys).agg(
        F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))


@query("stream_skip_done", "SELECT event_id, user_id, value FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def stream_skip_done(spark, sf_dir):
    stream, schema = _event_stream(spark, sf_dir)
    done = load(spark, sf_dir, "events").where("event_type = 'click'").select("event_id")
    path = scratch_path(spark, "ingest")
    ingest.stream_ingest(stream, path, scratch_path(spark, "ingest-checkpoint"), "event_id", ["ts"], done=done)
    return ingest.read_ignore(spark, path, schema).select("event_id", "user_id", "value")


@query("dead_letter", """
SELECT event_id, 'ok' AS sink FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, 'failed' FROM events WHERE event_type = 'error'
""")
def dead_letter(spark, sf_dir):
    stream, schema = _event_stream(spark, sf_dir)
    path, failed = scratch_path(spark, "ingest"), scratch_path(spark, "ingest-failed")
    ingest.stream_ingest(
        stream, path, scratch_path(spark, "ingest-checkpoint"), "event_id", ["ts"],
        failed_path=failed, succeeded=F.col("event_type") != "error")
    ok = ingest.read_ignore(spark, path, schema).select("event_id", F.lit("ok").alias("sink"))
    bad = ingest.read_ignore(spark, failed, schema).select("event_id", F.lit("failed").alias("sink"))
    return ok.unionByName(bad)


def keyword_scorer(prompts: pd.Series) -> pd.Series:
    """Deterministic stand-in for a served labelling model."""
    return prompts.str.contains(" the ", regex=False).map({True: "1", False: "0"})


_W500 = f"array_to_string({SQL_WORDS.format('text')}[1:500], ' ')"


@query("batch_label", f"SELECT doc_id, CAST(contains('Transcript: ' || {_W500}, ' the ') AS BIGINT) AS label FROM documents")
def batch_label(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", text.build_prompt(
        F.lit(""), F.lit(""), F.col("text"), ["red"], "%s%sTranscript: %s [").alias("prompt"))
    labelled = sampling.batch_label(docs, "prompt", keyword_scorer)
    return labelled.select("doc_id", text.parse_label(F.col("reply")).cast("bigint").alias("label"))


def wavering_scorer(prompts: pd.Series) -> pd.Series:
    """Stand-in whose replies are not always a label."""
    transcript = prompts.str.split("Transcript: ", n=1).str[1]
    labels = transcript.str.contains("ing ", regex=False).map({True: " 1 ", False: "0"})
    return labels.where(transcript.str.contains("er ", regex=False), "unsure")


_LANGUAGES = ["en", "de", "fr", "neverused"]
_LABELLED = 300


@query("labelling_flow", f"""
WITH f AS (SELECT doc_id, lang, coalesce({_W500}, '') AS words FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels)),
r AS (SELECT *, CASE WHEN lang IN ('en', 'de', 'fr') THEN 1.0::DOUBLE / count(*) OVER (PARTITION BY lang) ELSE 0 END AS raw FROM f),
d AS (SELECT * FROM r WHERE raw > 0 ORDER BY
      -ln((CAST('0x' || substr(md5(doc_id || ':42'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / (raw / (SELECT sum(raw) FROM r)),
      CAST(doc_id AS VARCHAR) LIMIT {_LABELLED})
SELECT CAST(doc_id AS VARCHAR) AS video_id, CASE WHEN contains(words, 'er ') THEN CAST(contains(words, 'ing ') AS BIGINT) END AS label,
       NOT contains(words, 'er ') AS rejected FROM d
""")
def labelling_flow(spark, sf_dir):
    """A weighted sample of unlabelled documents, queued and labelled in batches; a second run finds nothing to do."""
    docs = load(spark, sf_dir, "documents").withColumn("video_id", F.col("doc_id").cast("string"))
    videos = docs.select("video_id", F.col("lang").alias("keywords"), F.lit("").alias("title"), F.lit("").alias("description"))
    manual = load(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("video_id"))
    sample = relevance.draw_training_sample(
        videos, docs.select("video_id", F.col("text").alias("transcript")), manual, _LANGUAGES, _LABELLED)
    job = relevance.LabellingJob(spark, scratch_path(spark, "labelling"), rows_per_file=500, files_per_batch=8)
    for _ in range(2):
        job.enqueue(sample)
        job.run(wavering_scorer, ["term"], manual)
    kept = job.labels().select("video_id", F.col("gpt_label").cast("bigint").alias("label"), F.lit(False).alias("rejected"))
    return kept.unionByName(job.rejects().select("video_id", F.lit(None).cast("bigint").alias("label"), F.lit(True).alias("rejected")))


# --- whole flows -----------------------------------------------------------------------------------

@query("coverage_report", f"""
WITH {standins.ITEMS_SQL},
f AS (SELECT unnest(['total', 'no_category', 'only_invalid']) AS name, unnest([count(*), count(*) FILTER (len(matching_categories) = 0),
        count(*) FILTER (len(matching_categories) > 0 AND len(list_filter(matching_categories, lambda c: c IN ({standins.SQL_KNOWN}))) = 0)]) AS n FROM items)
SELECT 'items' AS section, name, n FROM f
UNION ALL SELECT CASE WHEN category IN ({standins.SQL_KNOWN}) THEN 'known' ELSE 'unknown' END, category, count(*) FROM mentions GROUP BY category
UNION ALL SELECT 'missing', category, 0 FROM (SELECT unnest([{standins.SQL_KNOWN}]) AS category) WHERE category NOT IN (SELECT category FROM mentions)
""")
def coverage_report(spark, sf_dir):
    return coverage.report(standins.items(spark, sf_dir), standins.taxonomy(spark), standins.KNOWN)


@query("engagement_model")
def engagement_model(spark, sf_dir):
    return engagement.order_report(spark, sf_dir)


@query("relevance_scores", f"""
WITH v AS (SELECT vec_id, vec_id IN (SELECT doc_id FROM labels) OR {_DRAW_SQL} < 0.6 AS labelled FROM embeddings)
SELECT CAST(doc_id AS VARCHAR) AS video_id, lang, coalesce(NOT labelled, false) AS scored,
       CASE WHEN NOT labelled THEN true END AS consistent
FROM documents LEFT JOIN v ON doc_id = vec_id
""")
def relevance_scores(spark, sf_dir):
    return relevance.document_scores(spark, sf_dir)
