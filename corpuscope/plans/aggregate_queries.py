"""Aggregations, rank statistics, windows and samples over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.functions import text
from corpuscope.operators import features, filters, metrics, mutation, ordered, sampling, stats
from corpuscope.plans import coverage, standins
from corpuscope.plans.registry import load, query, rounded, to_bigint
from corpuscope.plans.scalar_queries import READABILITY_SQL, TOPICS_CTE
from corpuscope.plans.standins import ITEMS_SQL, KEYWORDS_SQL, METRICS_SQL, SCORES_SQL, SQL_KNOWN, SQL_PART_WORDS

RATES = ["views_per_day", "likes_per_day", "comments_per_day"]
COMPLETE_CTE = f"{METRICS_SQL}, c AS (SELECT * FROM m WHERE age <> 0)"


def complete_metrics(spark, sf_dir):
    return standins.order_metrics(spark, sf_dir).dropna(subset=RATES)


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"))


# --- taxonomy coverage -------------------------------------------------------------

_FREQUENCY_SQL = f"SELECT category, count(*) AS n FROM mentions WHERE category IN ({SQL_KNOWN}) GROUP BY 1"


@query("category_frequency", f"WITH {ITEMS_SQL} {_FREQUENCY_SQL}")
def category_frequency(spark, sf_dir):
    return coverage.category_frequency(standins.items(spark, sf_dir), standins.taxonomy(spark))


@query("frequency_totals", f"WITH {ITEMS_SQL} SELECT count(*) AS categories, CAST(sum(n) AS BIGINT) AS mentions FROM ({_FREQUENCY_SQL})")
def frequency_totals(spark, sf_dir):
    found = coverage.category_frequency(standins.items(spark, sf_dir), standins.taxonomy(spark))
    return coverage.frequency_totals(found)


@query("invalid_frequency", f"WITH {ITEMS_SQL} SELECT category, count(*) AS n FROM mentions WHERE category NOT IN ({SQL_KNOWN}) GROUP BY 1")
def invalid_frequency(spark, sf_dir):
    return coverage.invalid_frequency(standins.items(spark, sf_dir), standins.taxonomy(spark))


@query("coverage_counts", f"""
WITH {ITEMS_SQL}
SELECT count(*) AS total, count(*) FILTER (len(matching_categories) = 0) AS no_category,
       count(*) FILTER (len(matching_categories) > 0 AND len(list_filter(matching_categories, lambda c: c IN ({SQL_KNOWN}))) = 0) AS only_invalid
FROM items
""")
def coverage_counts(spark, sf_dir):
    return coverage.coverage_counts(standins.items(spark, sf_dir), standins.KNOWN)


@query("missing_categories", f"""
WITH {ITEMS_SQL}
SELECT category FROM (SELECT unnest([{SQL_KNOWN}]) AS category) WHERE category NOT IN (SELECT category FROM mentions)
""")
def missing_categories(spark, sf_dir):
    return coverage.missing_categories(standins.items(spark, sf_dir), standins.taxonomy(spark))


@query("category_medians", """
SELECT o_orderpriority, round(median(o_totalprice), 6) AS price, round(median(CASE WHEN o_orderstatus = 'F' THEN o_custkey END), 6) AS customer
FROM orders GROUP BY 1
""")
def category_medians(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(
        "o_orderpriority", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("customer"))
    return rounded(ordered.medians(orders, ["price", "customer"], ["o_orderpriority"]), "price", "customer")


# --- keywords ------------------------------------------------------------------------

@query("keyword_frequency", f"""
WITH {KEYWORDS_SQL}, f AS (SELECT unnest(string_split(keywords, ', ')) AS keyword FROM k)
SELECT d.keyword, count(f.keyword) AS n FROM (SELECT unnest([{SQL_PART_WORDS}]) AS keyword) d LEFT JOIN f ON d.keyword = f.keyword GROUP BY 1
""")
def keyword_frequency(spark, sf_dir):
    return sampling.keyword_frequency(standins.part_keywords(spark, sf_dir), "keywords", standins.PART_WORDS)


_WEIGHTS_SQL = f"""
{KEYWORDS_SQL}, f AS (SELECT p_partkey, unnest(string_split(keywords, ', ')) AS keyword FROM k),
n AS (SELECT keyword, count(*) AS n FROM f WHERE keyword IN ({SQL_PART_WORDS}) GROUP BY 1),
r AS (SELECT k.p_partkey, coalesce(sum(1.0 / n.n), 0) AS raw FROM k LEFT JOIN f ON k.p_partkey = f.p_partkey LEFT JOIN n ON f.keyword = n.keyword GROUP BY 1),
w AS (SELECT p_partkey, raw / (SELECT sum(raw) FROM r) AS weight FROM r)
"""


@query("sampling_weights", f"WITH {_WEIGHTS_SQL} SELECT p_partkey, round(weight, 9) AS weight FROM w")
def sampling_weights(spark, sf_dir):
    weighted = sampling.sampling_weights(standins.part_keywords(spark, sf_dir), "keywords", standins.PART_WORDS)
    return rounded(weighted.select("p_partkey", F.col("sampling_weight").alias("weight")), "weight", digits=9)


@query("weighted_sample", f"""
WITH {_WEIGHTS_SQL}
SELECT p_partkey FROM w WHERE weight > 0
ORDER BY -ln((CAST('0x' || substr(md5(p_partkey || ':42'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / weight, p_partkey LIMIT 100
""")
def weighted_sample(spark, sf_dir):
    weighted = sampling.sampling_weights(standins.part_keywords(spark, sf_dir), "keywords", standins.PART_WORDS)
    return sampling.weighted_sample(weighted, "p_partkey", "sampling_weight", 100).select("p_partkey")


@query("uniform_sample", """
SELECT event_id, value FROM events ORDER BY CAST('0x' || substr(md5(event_id || ':42'), 1, 13) AS BIGINT), event_id LIMIT 500
""")
def uniform_sample(spark, sf_dir):
    return sampling.uniform_sample(load(spark, sf_dir, "events").select("event_id", "value"), "event_id", 500)


# --- classification metrics ------------------------------------------------------------

@query("class_distribution", "SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY 1")
def class_distribution(spark, sf_dir):
    return rounded(metrics.class_distribution(load(spark, sf_dir, "documents"), "lang"), "share")


@query("confusion_matrix", "SELECT CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, count(*) AS n, quality = toxic AS correct FROM labels GROUP BY 1, 2, 4")
def confusion_matrix(spark, sf_dir):
    return to_bigint(metrics.confusion_matrix(load(spark, sf_dir, "labels"), "quality", "toxic"), "quality", "toxic")


@query("binary_metrics", """
SELECT round(avg((quality = toxic)::INT), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
       round(2 * tp / (2 * tp + fp + fn), 6) AS f1
FROM labels, (SELECT CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS DOUBLE) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
                     count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM labels)
GROUP BY tp, fp, fn
""")
def binary_metrics(spark, sf_dir):
    found = metrics.binary_metrics(load(spark, sf_dir, "labels"), "quality", "toxic")
    return rounded(found, "accuracy", "precision", "recall", "f1")


@query("class_report", """
WITH c AS (
  SELECT k, CAST(count(*) FILTER (quality = k) AS BIGINT) AS support, count(*) FILTER (toxic = k) AS predicted,
         CAST(count(*) FILTER (quality = k AND toxic = k) AS DOUBLE) AS tp
  FROM labels, (SELECT unnest([0, 1]) AS k) GROUP BY k),
r AS (SELECT CAST(k AS VARCHAR) AS row, tp / predicted AS precision, tp / support AS recall, 2 * tp / (predicted + support) AS f1, support, tp, predicted FROM c),
a AS (
  SELECT row, precision, recall, f1, support FROM r
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM r
  UNION ALL SELECT 'micro avg', sum(tp) / sum(predicted), sum(tp) / sum(support), 2 * sum(tp) / (sum(predicted) + sum(support)), sum(support) FROM r)
SELECT row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM a
""")
def class_report(spark, sf_dir):
    return rounded(metrics.class_report(load(spark, sf_dir, "labels"), "quality", "toxic"), "precision", "recall", "f1")


@query("cost_accuracy", """
SELECT round(1 - (fn + 2 * fp) / (fn + 2 * fp + ok), 6) AS cost_accuracy FROM (
  SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
         CAST(count(*) FILTER (quality = toxic) AS DOUBLE) AS ok FROM labels)
""")
def cost_accuracy(spark, sf_dir):
    return rounded(metrics.cost_accuracy(load(spark, sf_dir, "labels"), "quality", "toxic"), "cost_accuracy")


@query("roc_auc", f"""
WITH {SCORES_SQL}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM s)
SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
             / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS roc_auc FROM r
""")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(standins.scores(spark, sf_dir), "y", "p"), "roc_auc")


_CUMULATIVE_SQL = f"""
{SCORES_SQL}, g AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY 1),
t AS (SELECT p, pos, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp,
             sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g WINDOW w AS (ORDER BY p DESC))
"""


@query("average_precision", f"WITH {_CUMULATIVE_SQL} SELECT round(sum(pos / np * tp / (tp + fp)), 6) AS average_precision FROM t")
def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(standins.scores(spark, sf_dir), "y", "p"), "average_precision")


@query("roc_curve", f"""
WITH {_CUMULATIVE_SQL}
SELECT round(p, 9) AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM t
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0
""")
def roc_curve(spark, sf_dir):
    points = rounded(metrics.roc_curve(standins.scores(spark, sf_dir), "y", "p"), "fpr", "tpr")
    endless = F.col("threshold") == float("inf")
    return points.withColumn("threshold", F.when(endless, F.col("threshold")).otherwise(F.round("threshold", 9)))


@query("cost_threshold", f"""
WITH {SCORES_SQL}, g AS (SELECT CAST(unnest(range(100)) AS DOUBLE) / 99 AS t)
SELECT round(t, 6) AS threshold, CAST(count(*) FILTER (y = 1 AND p < t) + 2 * count(*) FILTER (y = 0 AND p >= t) AS DOUBLE) AS cost
FROM g, s GROUP BY t ORDER BY cost, t LIMIT 1
""")
def cost_threshold(spark, sf_dir):
    return rounded(metrics.cost_threshold(standins.scores(spark, sf_dir), "y", "p"), "threshold")


@query("class_weight", """
SELECT round(count(*) FILTER (quality = 1) / CAST(count(*) FILTER (quality = 0) AS DOUBLE), 6) AS weight_0, CAST(1 AS DOUBLE) AS weight_1 FROM labels
""")
def class_weight(spark, sf_dir):
    return rounded(metrics.class_weight(load(spark, sf_dir, "labels"), "quality"), "weight_0")


# --- descriptive statistics --------------------------------------------------------------

def _describe_sql(column, table):
    return f"""SELECT '{column}' AS feature, count({column}) AS count, round(avg({column}), 4) AS mean, round(stddev_samp({column}), 4) AS std,
  round(min({column}), 6) AS min, round(max({column}), 6) AS max, round(quantile_cont({column}, 0.25), 6) AS q1,
  round(quantile_cont({column}, 0.5), 6) AS median, round(quantile_cont({column}, 0.75), 6) AS q3 FROM {table}"""


@query("describe", _describe_sql("CAST(l_quantity AS DOUBLE)", "lineitem").replace("'CAST(l_quantity AS DOUBLE)'", "'l_quantity'")
       + " UNION ALL " + _describe_sql("l_extendedprice", "lineitem"))
def describe(spark, sf_dir):
    found = stats.describe(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rounded(rounded(found, "min", "max", "q1", "median", "q3"), "mean", "std", digits=4)


@query("nunique", """
SELECT 'l_shipdate' AS feature, count(DISTINCT l_shipdate) AS n_unique FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice) FROM lineitem
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem
""")
def nunique(spark, sf_dir):
    return stats.distinct_counts(load(spark, sf_dir, "lineitem"), ["l_shipdate", "l_extendedprice", "l_returnflag"])


@query("null_profile", f"""
WITH {METRICS_SQL}
SELECT 'views_per_day' AS feature, count(*) FILTER (views_per_day IS NULL) AS n_null, CAST(0 AS BIGINT) AS n_inf FROM m
UNION ALL SELECT 'inf_when_zero', 0, count(*) FILTER (age = 0) FROM m
""")
def null_profile(spark, sf_dir):
    rows = standins.order_metrics(spark, sf_dir).withColumn(
        "inf_when_zero", F.when(F.col("age") == 0, float("inf")).otherwise(1.0))
    return stats.null_profile(rows, ["views_per_day", "inf_when_zero"])


@query("flag_counts", """
SELECT 'quality' AS flag, CAST(sum(quality) AS BIGINT) AS ones, CAST(count(quality) - sum(quality) AS BIGINT) AS zeros FROM labels
UNION ALL SELECT 'toxic', CAST(sum(toxic) AS BIGINT), CAST(count(toxic) - sum(toxic) AS BIGINT) FROM labels
""")
def flag_counts(spark, sf_dir):
    return stats.flag_counts(load(spark, sf_dir, "labels"), ["quality", "toxic"])


@query("group_medians", f"WITH {COMPLETE_CTE} SELECT o_orderpriority, round(median(views_per_day), 6) AS median FROM c GROUP BY 1")
def group_medians(spark, sf_dir):
    return rounded(stats.group_medians(complete_metrics(spark, sf_dir), "views_per_day", "o_orderpriority"), "median")


@query("sorted_groups", f"WITH {COMPLETE_CTE} SELECT o_custkey, round(median(views_per_day), 6) AS median FROM c GROUP BY 1 HAVING count(*) >= 10 ORDER BY 2, 1")
def sorted_groups(spark, sf_dir):
    kept = filters.min_group_filter(complete_metrics(spark, sf_dir).select("o_custkey", "views_per_day"), "o_custkey", 10)
    return rounded(stats.group_medians(kept, "views_per_day", "o_custkey"), "median").orderBy("median", "o_custkey")


@query("histogram", """
WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 30)) AS INT), 29) AS bin, count(*) AS n FROM lineitem, r GROUP BY 1)
SELECT CAST(i AS BIGINT) AS bin, round(lo + i * ((hi - lo) / 30), 6) AS left_edge, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM (SELECT unnest(range(30)) AS i) LEFT JOIN b ON i = bin, r
""")
def histogram(spark, sf_dir):
    return to_bigint(rounded(stats.histogram(load(spark, sf_dir, "lineitem"), "l_extendedprice", 30), "left_edge"), "bin")


@query("box_stats", f"""
WITH {COMPLETE_CTE},
q AS (SELECT o_orderpriority AS g, count(*) AS n, quantile_cont(views_per_day, 0.25) AS q1, quantile_cont(views_per_day, 0.5) AS median,
             quantile_cont(views_per_day, 0.75) AS q3 FROM c GROUP BY 1),
x AS (SELECT q.*, views_per_day AS v, views_per_day BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM c JOIN q ON g = o_orderpriority)
SELECT g AS o_orderpriority, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(v) FILTER (inside), 6) AS whisker_low,
       round(max(v) FILTER (inside), 6) AS whisker_high, count(*) FILTER (NOT inside) AS outliers
FROM x GROUP BY g, n, q1, median, q3
""")
def box_stats(spark, sf_dir):
    found = stats.box_stats(complete_metrics(spark, sf_dir), "views_per_day", "o_orderpriority")
    return rounded(found, "q1", "median", "q3", "whisker_low", "whisker_high")


@query("normality_profile", """
WITH d AS (SELECT l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem) AS x FROM lineitem),
p AS (SELECT count(*) AS n, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4 FROM d)
SELECT n, round(m3 / pow(m2, 1.5), 6) AS skewness, round(m4 / (m2 * m2) - 3, 6) AS kurtosis,
       round(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 3) AS jarque_bera,
       round(exp(-n / 12.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4)), 6) AS p_value FROM p
""")
def normality_profile(spark, sf_dir):
    found = stats.normality(load(spark, sf_dir, "lineitem"), "l_extendedprice")
    return rounded(rounded(found, "skewness", "kurtosis", "p_value"), "jarque_bera", digits=3)


def _normal_series(terms: int) -> str:
    series = "1.0"
    for k in range(2 * terms + 1, 1, -2):
        series = f"(1.0 + {series} * c * c / {k}.0)"
    return f"0.5 + exp(-c * c / 2) / sqrt(2 * pi()) * c * {series}"


_KS_COLUMNS = ("e0", "e1", "e2")


@query("ks_test", f"""
WITH v AS (
  SELECT 'l_extendedprice' AS feature, CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem
  UNION ALL SELECT 'l_quantity', CAST(l_quantity AS DOUBLE) FROM lineitem
  {" ".join(f"UNION ALL SELECT '{c}', CAST(embedding[{i + 1}] AS DOUBLE) FROM embeddings" for i, c in enumerate(_KS_COLUMNS))}),
m AS (SELECT feature, avg(x) AS mu, stddev_samp(x) AS sd, count(x) AS n FROM v GROUP BY feature),
d AS (SELECT feature, x, count(*) AS k FROM v WHERE x IS NOT NULL GROUP BY feature, x),
r AS (SELECT feature, x, k, sum(k) OVER (PARTITION BY feature ORDER BY x) AS upto FROM d),
z AS (SELECT feature, n, k, upto, greatest(least((x - mu) / sd, 6.0), -6.0) AS c FROM r JOIN m USING (feature)),
f AS (SELECT feature, n, k, upto, {_normal_series(61)} AS phi FROM z),
s AS (SELECT feature, n, max(greatest(upto / n - phi, phi - (upto - k) / n)) AS d FROM f GROUP BY feature, n),
t AS (SELECT feature, n, d, d * sqrt(n) AS x FROM s)
SELECT feature, n, round(d, 6) AS d, round(CASE
    WHEN x < 1 THEN 1 - sqrt(2 * pi()) / x * ({" + ".join(f"exp(-pow({2 * j - 1} * pi(), 2) / (8 * x * x))" for j in range(1, 5))})
    ELSE 2 * ({" ".join(f"{'+' if j % 2 else '-'} exp(-2.0 * {j * j} * x * x)" for j in range(1, 7))}) END, 6) AS p_value
FROM t
""")
def ks_test(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").select(*[F.col("embedding")[i].alias(c) for i, c in enumerate(_KS_COLUMNS)])
    found = stats.ks_normal(load(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"]).unionByName(
        stats.ks_normal(vectors, _KS_COLUMNS))
    return rounded(found, "d", "p_value")


@query("qq_points", """
SELECT CAST(i AS DOUBLE) / 20 AS prob, round(quantile_cont(l_extendedprice, i / 20.0), 6) AS quantile
FROM lineitem, (SELECT unnest(range(1, 20)) AS i) GROUP BY i
""".replace("quantile_cont(l_extendedprice, i / 20.0)", "list_extract((SELECT quantile_cont(l_extendedprice, [" + ", ".join(str(i / 20) for i in range(1, 20)) + "]) FROM lineitem), i)").replace("FROM lineitem, (SELECT", "FROM (SELECT"))
def qq_points(spark, sf_dir):
    return rounded(stats.qq_points(load(spark, sf_dir, "lineitem"), "l_extendedprice", 19), "quantile")


_RANKS = ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in RATES)


@query("spearman", f"""
WITH {COMPLETE_CTE}, r AS (SELECT {_RANKS} FROM c)
SELECT 'views_per_day' AS a, 'likes_per_day' AS b, round(corr(views_per_day, likes_per_day), 6) AS rho, count(*) AS n FROM r
UNION ALL SELECT 'views_per_day', 'comments_per_day', round(corr(views_per_day, comments_per_day), 6), count(*) FROM r
UNION ALL SELECT 'likes_per_day', 'comments_per_day', round(corr(likes_per_day, comments_per_day), 6), count(*) FROM r
""")
def spearman(spark, sf_dir):
    matrix = stats.spearman_matrix(standins.order_metrics(spark, sf_dir), "o_orderkey", RATES)
    wanted = F.concat_ws("|", "a", "b").isin(
        "views_per_day|likes_per_day", "views_per_day|comments_per_day", "likes_per_day|comments_per_day")
    return rounded(matrix.where(wanted).drop("p_value"), "rho")


_PAIR_SQL = """SELECT '{x}' AS feature, '{y}' AS target, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM (
  SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry FROM d WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"""
_PAIRS_CTE = "d AS (SELECT d.doc_id, n_chars, quality, toxic, len(text) % 97 AS rest FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_PAIRS = [("n_chars", "quality"), ("n_chars", "rest"), ("rest", "toxic")]


def _pair_correlations(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.length("text") % 97).alias("rest"))
    rows = docs.join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return stats.spearman_pairs(rows, "doc_id", _PAIRS)


@query("spearman_pairs", f"WITH {_PAIRS_CTE} " + " UNION ALL ".join(_PAIR_SQL.format(x=x, y=y) for x, y in _PAIRS))
def spearman_pairs(spark, sf_dir):
    return rounded(_pair_correlations(spark, sf_dir).drop("p_value"), "rho")


@query("corr_pivot", f"""
WITH {_PAIRS_CTE}, p AS ({" UNION ALL ".join(_PAIR_SQL.format(x=x, y=y) for x, y in _PAIRS)})
SELECT feature, max(rho) FILTER (target = 'quality') AS quality, max(rho) FILTER (target = 'rest') AS rest,
       max(rho) FILTER (target = 'toxic') AS toxic FROM p GROUP BY 1
""")
def corr_pivot(spark, sf_dir):
    wide = stats.correlation_pivot(_pair_correlations(spark, sf_dir), ["quality", "rest", "toxic"], "quality")
    return rounded(wide, "quality", "rest", "toxic")


@query("topic_correlation", f"""
WITH {TOPICS_CTE}
SELECT t AS topic, round(corr(CAST(list_contains(topics, t) AS INT), p_retailprice), 6) AS rho, count(*) AS n
FROM topics, (SELECT unnest(['color', 'shape', 'warm']) AS t) GROUP BY 1
""")
def topic_correlation(spark, sf_dir):
    prices = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    rows = standins.part_keywords(spark, sf_dir).join(prices, "p_partkey").select(
        "p_retailprice", text.topics_of(F.col("keywords"), standins.PART_TOPICS).alias("topics"))
    return rounded(stats.topic_correlation(rows, "topics", "p_retailprice", ["color", "shape", "warm"]).drop("p_value"), "rho")


@query("kruskal_wallis", f"""
WITH {COMPLETE_CTE},
r AS (SELECT o_orderpriority AS g, rank() OVER (ORDER BY likes) + (count(*) OVER (PARTITION BY likes) - 1) / 2.0 AS rk, likes AS v FROM c),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM r),
t AS (SELECT sum(k * k * k - k) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM r GROUP BY v)),
s AS (SELECT sum(r2) AS s, count(*) AS k FROM (SELECT pow(sum(rk), 2) / count(*) AS r2 FROM r GROUP BY g))
SELECT round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS h, k AS groups_tested FROM n, t, s
""")
def kruskal_wallis(spark, sf_dir):
    return rounded(stats.kruskal_wallis(complete_metrics(spark, sf_dir), "o_orderpriority", "likes").drop("p_value"), "h", digits=4)


@query("standardize", """
SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS c_acctbal_z FROM customer
""")
def standardize(spark, sf_dir):
    rows = features.standardize(load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return rounded(rows.select("c_custkey", "c_acctbal_z"), "c_acctbal_z")


@query("kde", """
WITH r AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi, count(*) AS n, stddev_samp(n_chars) * pow(count(*), -0.2) AS h FROM documents),
g AS (SELECT i, lo + i * (hi - lo) / 49.0 AS x, h, n FROM r, (SELECT unnest(range(50)) AS i))
SELECT CAST(i AS BIGINT) AS point, round(x, 6) AS x, round(sum(exp(-pow((x - n_chars) / h, 2) / 2)) / (h * sqrt(2 * pi()) * n), 12) AS density
FROM g, documents GROUP BY i, x, h, n
""")
def kde(spark, sf_dir):
    found = stats.kernel_density(load(spark, sf_dir, "documents").select("n_chars"), "n_chars", 50)
    return to_bigint(rounded(rounded(found, "x"), "density", digits=12), "point")


@query("comment_totals", """
SELECT conv_id AS video_id, count(*) FILTER (turn = 0) AS threads, count(*) FILTER (turn > 0) AS replies, count(*) AS total FROM conversations GROUP BY 1
""")
def comment_totals(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), "turn")
    return stats.comment_totals(turns.where("turn = 0"), turns.where("turn > 0"))


# --- windows, sorts and sets ----------------------------------------------------------------

@query("average_rank", """
SELECT l_extendedprice, count(*) AS n, any_value(rk) AS avg_rank FROM (
  SELECT l_extendedprice, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS rk FROM lineitem) GROUP BY 1
""")
def average_rank(spark, sf_dir):
    ranked = ordered.average_ranks(load(spark, sf_dir, "lineitem"), "l_extendedprice")
    return ranked.select("l_extendedprice", "n", "avg_rank")


@query("keep_first", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def keep_first(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return mutation.keep_first(events, "user_id", ["ts", "event_id"]).drop("ts")


@query("keep_last", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def keep_last(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return mutation.keep_last(events, "user_id", ["ts", "event_id"]).drop("ts")


@query("top_k_desc", f"SELECT doc_id, fk FROM ({READABILITY_SQL}) ORDER BY fk DESC, doc_id LIMIT 20")
def top_k_desc(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.round(text.readability_fk(F.col("text")), 8).alias("fk"))
    return docs.orderBy(F.col("fk").desc(), "doc_id").limit(20)


@query("top_k_asc", f"SELECT doc_id, ari FROM ({READABILITY_SQL}) ORDER BY ari, doc_id LIMIT 15")
def top_k_asc(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.round(text.readability_ari(F.col("text")), 8).alias("ari"))
    return docs.where("ari IS NOT NULL").orderBy("ari", "doc_id").limit(15)


@query("sort_abs", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey")
def sort_abs(spark, sf_dir):
    return stats.sort_by_magnitude(load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("head_filtered", f"WITH {ITEMS_SQL} SELECT video_id FROM items WHERE len(matching_categories) = 0 ORDER BY video_id LIMIT 10")
def head_filtered(spark, sf_dir):
    return standins.items(spark, sf_dir).where(F.size("matching_categories") == 0).select("video_id").orderBy("video_id").limit(10)


@query("distinct_terms", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part")
def distinct_terms(spark, sf_dir):
    return load(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct()


@query("topic_explode", f"WITH {TOPICS_CTE} SELECT p_partkey, unnest(topics) AS topic FROM topics")
def topic_explode(spark, sf_dir):
    rows = standins.part_keywords(spark, sf_dir).withColumn("topics", text.topics_of(F.col("keywords"), standins.PART_TOPICS))
    return filters.explode_values(rows, "topics", "topic", "p_partkey")


_RARE_SQL = """
SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY source) >= 50 THEN source ELSE 'Other' END AS source_grouped FROM documents
"""


@query("rare_merge", _RARE_SQL)
def rare_merge(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    return features.merge_rare(docs, "source", 50).drop("source")


@query("one_hot", """
SELECT doc_id, CAST(lang = 'en' AS BIGINT) AS lang_en, CAST(lang = 'es' AS BIGINT) AS lang_es, CAST(lang = 'fr' AS BIGINT) AS lang_fr FROM documents
""")
def one_hot(spark, sf_dir):
    docs = features.one_hot(load(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "lang").drop("lang")
    return to_bigint(docs, *[c for c in docs.columns if c != "doc_id"])
