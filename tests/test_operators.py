"""Keyed mutation, skewed joins, exact order statistics, samples and splits."""

import math
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscope import schemas
from corpuscope.operators import features, filters, joins, lexicon, metrics, models, mutation, neighbours, ordered, sampling, stats


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upserts_are_idempotent(spark):
    target = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, seq int")
    batch = spark.createDataFrame([("b", 9, 1), ("c", 3, 2), ("c", 4, 3), ("d", None, 4)], "k string, v int, seq int")
    once = mutation.upsert_ignore(target, batch, "k", ["seq"])
    assert rows(once.select("k", F.coalesce("v", F.lit(-1)))) == [("a", 1), ("b", 2), ("c", 3), ("d", -1)]
    assert rows(mutation.upsert_ignore(once, batch, "k", ["seq"]).fillna(-1)) == rows(once.fillna(-1))
    replaced = mutation.upsert_replace(target, batch, "k", ["seq"])
    assert rows(replaced.select("k", F.coalesce("v", F.lit(-1)))) == [("a", 1), ("b", 9), ("c", 4), ("d", -1)]
    assert rows(mutation.upsert_replace(replaced, batch, "k", ["seq"]).fillna(-1)) == rows(replaced.fillna(-1))


def test_append_rejects_known_keys(spark):
    target = spark.createDataFrame([("a",)], "k string")
    with pytest.raises(mutation.DuplicateKeyError):
        mutation.append_checked(target, target, "k")
    with pytest.raises(mutation.DuplicateKeyError):
        mutation.append_checked(target, spark.createDataFrame([("b",), ("b",)], "k string"), "k")
    assert mutation.append_checked(target, spark.createDataFrame([("b",)], "k string"), "k").count() == 2


def test_update_overwrites_with_null_and_ignores_unmatched(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    updates = spark.createDataFrame([("a", None), ("z", 5)], "k string, v int")
    assert rows(mutation.update_by_key(target, updates, "k", ["v"]).fillna(-1)) == [("a", -1), ("b", 2)]


def test_create_if_absent(spark, tmp_path, monkeypatch):
    name = "created_once"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS scratch LOCATION '{tmp_path}/scratch'")
    assert not schemas.table_exists(spark, f"scratch.{name}")
    schemas.create_if_absent(spark, f"scratch.{name}", schemas.COMMENTS)
    assert schemas.create_if_absent(spark, f"scratch.{name}", schemas.COMMENTS).columns == schemas.COMMENTS.names
    spark.sql("DROP DATABASE scratch CASCADE")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; some keys are NULL."""
    return spark.range(30_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 1000).alias("k"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(spark, skewed, how):
    lookup = spark.range(0, 900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = joins.skew_join(skewed, lookup, "k", how)
    plain = skewed.join(lookup, "k", how)
    assert rows(got.fillna(-1)) == rows(plain.fillna(-1))


def test_skew_join_spreads_the_heavy_key(spark, skewed):
    lookup = spark.range(0, 900).select(F.col("id").alias("k"))
    heavy = joins.heavy_keys(skewed, "k")
    assert [r.k for r in heavy.collect()] == [7]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = joins.skew_join(skewed, lookup, "k").where("k = 7").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 2 and max(r["count"] for r in parts) < 10_000


def test_dim_join_has_two_ways(spark, skewed):
    dim = spark.range(0, 900).select(F.col("id").alias("k"))
    small = joins.dim_join(skewed, dim, "k", "left_semi")
    large = joins.dim_join(skewed, dim, "k", "left_semi", max_bytes=10)
    assert joins.checked_broadcast(dim, 10) is None
    assert rows(small) == rows(large)


def test_feature_join_keeps_every_transcript(spark):
    videos = spark.createDataFrame([("v1", "c1", "t"), ("v2", None, "u")], "video_id string, channel_id string, title string")
    channels = spark.createDataFrame([("c1", "C")], "channel_id string, title string")
    transcripts = spark.createDataFrame([("v1", "x"), ("v2", "y"), ("v3", "z")], "video_id string, transcript string")
    got = {r.video_id: (r.title, r.title_channel) for r in joins.feature_join(videos, channels, transcripts).collect()}
    assert got == {"v1": ("t", "C"), "v2": ("u", None), "v3": (None, None)}


@pytest.fixture(scope="module")
def heavy_values(spark):
    """Groups with a third of the rows in one group and many tied values."""
    rng = np.random.default_rng(1)
    group = np.where(rng.random(5000) < 0.34, 0, rng.integers(1, 40, 5000))
    value = np.where(rng.random(5000) < 0.3, 2.0, np.round(rng.normal(size=5000), 2))
    data = [(i, int(g), float(v)) for i, (g, v) in enumerate(zip(group, value))]
    return spark.createDataFrame(data, "id int, g int, v double"), group, value


@pytest.mark.parametrize("buckets", [1, 3, 200])
def test_quantiles_do_not_depend_on_buckets(heavy_values, buckets):
    df, group, value = heavy_values
    points = ordered.cut_points(df, "v", buckets=buckets)
    found = ordered.exact_quantiles(df, "v", {"q1": 0.25, "p9": 0.9}, by=["g"], points=points).collect()
    for r in found:
        expected = np.quantile(value[group == r.g], [0.25, 0.9])
        assert (r.q1, r.p9) == (pytest.approx(expected[0]), pytest.approx(expected[1]))
    assert len(found) == len(set(group))


def ranks(values):
    order = {v: (np.sum(values < v) + (np.sum(values == v) + 1) / 2) for v in set(values)}
    return np.array([order[v] for v in values])


def test_average_ranks(heavy_values):
    df, _, value = heavy_values
    got = {r.v: r.avg_rank for r in ordered.average_ranks(df, "v").collect()}
    assert all(got[v] == r for v, r in zip(value, ranks(value)))


def test_medians_skip_nulls_and_keep_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 4.0, None), ("b", None, 3.0), ("b", None, 5.0)], "g string, x double, y double")
    assert {r.g: (r.x, r.y) for r in ordered.medians(df, ["x", "y"], ["g"]).collect()} == {"a": (2.5, None), "b": (None, 4.0)}


def test_no_rows_at_all(spark):
    empty = spark.createDataFrame([], "id int, g string, v double, y int")
    nulls = spark.createDataFrame([(1, "a", None, 1)], "id int, g string, v double, y int")
    for df in (empty, nulls):
        assert ordered.exact_quantiles(df, "v", {"m": 0.5}, by=["g"]).count() == 0
        assert stats.box_stats(df, "v", "g").count() == 0
        assert metrics.roc_auc(df, "y", "v").head()[0] is None
        assert stats.kruskal_wallis(df, "g", "v").head().groups_tested == 0
        assert joins.skew_join(df, df.select("g").distinct(), "g").count() == df.count()


def test_kruskal_against_numpy(spark, heavy_values):
    df, group, value = heavy_values
    keep = [g for g in set(group) if np.sum(group == g) >= 30]
    mask = np.isin(group, keep)
    g, v = group[mask], value[mask]
    r, n = ranks(v), len(v)
    h = 12 / (n * (n + 1)) * sum(r[g == k].sum() ** 2 / np.sum(g == k) for k in keep) - 3 * (n + 1)
    ties = sum(float(np.sum(v == x)) ** 3 - np.sum(v == x) for x in set(v))
    got = stats.kruskal_wallis(df, "g", "v").head()
    assert got.h == pytest.approx(h / (1 - ties / (n ** 3 - n)))
    assert got.groups_tested == len(keep) and 0 <= got.p_value <= 1
    single = stats.kruskal_wallis(df.where("g = 0"), "g", "v").head()
    assert single.groups_tested == 0 and single.h is None


def test_spearman_drops_nulls_by_pair(spark):
    data = [(i, float(i % 7), float((i * 5) % 11) if i % 4 else None, float(-i)) for i in range(60)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double")
    got = {(r.feature, r.target): (r.rho, r.n) for r in stats.spearman_pairs(df, "id", [("a", "b"), ("a", "c")]).collect()}
    a, b = np.array([(x[1], x[2]) for x in data if x[2] is not None]).T
    assert got[("a", "b")] == (pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1]), 45)
    assert got[("a", "c")][1] == 60


def test_box_and_histogram_edges(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [1, 2, 3, 4, 100]] + [("b", 5.0)], "g string, v double")
    box = {r.g: r for r in stats.box_stats(df, "v", "g").collect()}
    assert (box["a"].whisker_low, box["a"].whisker_high, box["a"].outliers) == (1.0, 4.0, 1)
    bars = {r.bin: r.n for r in stats.histogram(df, "v", 4).collect()}
    assert bars == {0: 5, 1: 0, 2: 0, 3: 1}
    flat = stats.histogram(df.where("g = 'b'"), "v", 3)
    assert sum(r.n for r in flat.collect()) == 1


def test_metrics_on_ties_and_missing_class(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.1)], "y int, p double")
    assert metrics.roc_auc(df, "y", "p").head()[0] == pytest.approx(4.0 / 6)
    assert metrics.average_precision(df, "y", "p").head()[0] == pytest.approx(1 / 3 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    best = metrics.cost_threshold(df, "y", "p").head()
    grid = [(sum(y == 1 and p < t for y, p in [(1, .9), (1, .5), (0, .5), (0, .1), (1, .1)])
             + 2 * sum(y == 0 and p >= t for y, p in [(1, .9), (1, .5), (0, .5), (0, .1), (1, .1)]), t)
            for t in (i / 99 for i in range(100))]
    assert (best.cost, best.threshold) == (min(grid)[0], pytest.approx(min(grid)[1]))
    never = df.select("y", F.lit(0).alias("pred"))
    report = {r.row: r for r in metrics.class_report(never, "y", "pred").collect()}
    assert report["1"].precision == 0.0 and report["1"].support == 3
    assert metrics.cost_accuracy(never, "y", "pred").head()[0] == pytest.approx(1 - 3 / 5)


def test_samples_and_splits(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("y"), (F.col("id") % 5).cast("double").alias("w"))
    many, few = df.repartition(16), df.coalesce(1)
    assert rows(sampling.uniform_sample(many, "id", 50)) == rows(sampling.uniform_sample(few, "id", 50))
    drawn = sampling.weighted_sample(many, "id", "w", 100)
    assert drawn.count() == 100 == drawn.select("id").distinct().count() and drawn.where("w = 0").count() == 0
    assert rows(drawn) == rows(sampling.weighted_sample(few, "id", "w", 100))
    split = sampling.stratified_split(many, "id", "y")
    assert rows(split) == rows(sampling.stratified_split(few, "id", "y"))
    sizes = {(r.y, r.split): r["count"] for r in split.groupBy("y", "split").count().collect()}
    assert sizes == {(0, "val"): 167, (0, "test"): 167, (1, "val"): 167, (1, "test"): 166, (2, "val"): 167, (2, "test"): 166}


def test_sampling_weights(spark):
    df = spark.createDataFrame([("a", "x, y"), ("b", "x"), ("c", None), ("d", "other")], "id string, k string")
    got = {r.id: r.sampling_weight for r in sampling.sampling_weights(df, "k", ["x", "y"]).collect()}
    assert got == {"a": pytest.approx(0.75), "b": pytest.approx(0.25), "c": 0.0, "d": 0.0}
    assert rows(sampling.keyword_frequency(df, "k", ["x", "y", "z"])) == [("x", 2), ("y", 1), ("z", 0)]


def test_dummies_and_rare_levels(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",), (None,)], "lang string")
    merged = features.merge_rare(df, "lang", 2)
    assert sorted(r.lang_grouped for r in merged.collect()) == ["Other", "Other", "a", "a", "a", "b", "b"]
    assert [c for c in features.one_hot(merged, "lang_grouped", "audio").columns if c.startswith("audio_")] == ["audio_a", "audio_b"]
    assert [c for c in features.one_hot(df, "lang", "x", levels=["b", "a"]).columns if c.startswith("x_")] == ["x_b"]
    many = spark.range(6000).select((F.col("id") % 5000).cast("string").alias("lang"))
    vectors = features.one_hot_vector(many, "lang", "v").select("v").collect()
    assert len(vectors) == 6000 and {len(r.v) for r in vectors} == {5000}


def test_centroids_with_null_labels_and_a_hot_label(spark):
    rng = np.random.default_rng(8)
    data = [(i, [float(v) for v in rng.normal(size=3)], None if i % 10 == 0 else (0 if i % 3 else i)) for i in range(300)]
    df = spark.createDataFrame(data, "id int, v array<double>, y int")
    got = {r.id: r.similarity for r in neighbours.centroid_similarity(df, "id", "v", "y").collect()}
    means = {y: np.mean([v for _, v, w in data if w == y], axis=0) for y in {w for _, _, w in data} - {None}}
    for i, v, y in data:
        want = None if y is None else np.dot(v, means[y]) / np.linalg.norm(v) / np.linalg.norm(means[y])
        assert got[i] is None if want is None else abs(got[i] - want) < 1e-9


def test_threshold_ignores_nan_and_auc_does_not_overflow(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, float("nan")), (None, 0.5)], "y int, s double")
    assert metrics.cost_threshold(df, "y", "s").head()["threshold"] is not None
    big = spark.createDataFrame([(4_000_000_000, 4_000_000_000)], "pos_total long, neg_total long")
    product = F.max("pos_total").cast("double") * F.max("neg_total").cast("double")
    assert big.agg(product.alias("x")).head()["x"] == 1.6e19


def test_of_two_updates_the_last_counts(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (3, "z", 1)], "k int, v string, at int")
    assert rows(mutation.update_by_key(target, updates, "k", ["v"], order=["at"])) == [(1, "x"), (2, "b")]


def test_dependent_columns_alone_lose_their_inflation_factor(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 3))
    x[:, 2] += x[:, 0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    df = df.withColumn("d", F.col("b") * 2).withColumn("e", F.lit(1.0))
    got = {r.feature: r.vif for r in models.vif(df, ["a", "b", "c", "d", "e"]).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    assert got["b"] is None and got["d"] is None and got["e"] is None
    assert np.allclose([got["a"], got["c"]], want[[0, 2]])


def test_corpus_copies_follow_routed_queries(spark):
    """Points in far clusters: the queries of a cluster reach its own chunks alone, so chunks are not repeated for all."""
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(40, 4)) + 1000 * c for c in range(8)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    found = neighbours.knn_join(df, "id", "v", 3, block_rows=40, max_pivots=8)
    assert found.count() == 960
    text = found._jdf.queryExecution().toString()
    assert "knn-blocks" in text or "blocks" in text


def test_components_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) @ np.array([[1, .8, .2], [0, 1, .3], [0, 0, 1]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    model = features.fit_components(df, ["a", "b", "c"])
    z = (x - x.mean(0)) / x.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    first = vt[0] * np.sign(vt[0].sum())
    got = np.array([r.engagement_index for r in model.score(df).orderBy("id").collect()])
    assert np.allclose(got, z @ first)
    shares = {r.pc: r.explained for r in model.loadings(df).collect()}
    assert np.allclose([shares[i] for i in (1, 2, 3)], s ** 2 / (s ** 2).sum())


def test_regression_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    x[:, 2] += x[:, 0]
    y = 2 + x @ np.array([1.0, -2.0, 0.5]) + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    design = np.column_stack([np.ones(200), x])
    beta, sse = np.linalg.lstsq(design, y, rcond=None)[:2]
    error = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sse[0] / 196)
    names = ["a", "b", "c"]
    got = {r.term: r for r in models.ols_summary(spark, models.fit_ols(df, names, "y"), names).collect()}
    assert np.allclose([got[t].coef for t in ["const", *names]], beta)
    assert np.allclose([got[t].std_err for t in ["const", *names]], error)
    inflation = {r.feature: r.vif for r in models.vif(df, names).collect()}
    assert np.allclose([inflation[n] for n in names], np.diag(np.linalg.inv(np.corrcoef(x.T))))
    doubled = df.withColumn("d", F.col("a") * 2 - F.col("b")).withColumn("e", F.lit(1.0))
    assert models.independent_columns(doubled, ["a", "b", "d", "e", "c"]) == ["a", "b", "c"]


@pytest.mark.parametrize("block_rows, max_pivots, scale", [(None, 16, 1), (7, 4, 1), (16, 1, 1), (7, 4, 1e5)])
def test_neighbours_are_exact(spark, block_rows, max_pivots, scale):
    rng = np.random.default_rng(5)
    x = scale * (rng.normal(size=(120, 6)) + (100 if scale > 1 else 0))
    x[:45] = x[0]  # more than a third of the points coincide
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    found = neighbours.knn_join(df, "id", "v", 4, block_rows=block_rows, max_pivots=max_pivots).collect()
    got = {}
    for r in found:
        got.setdefault(r.id, []).append((r["rank"], r.neighbour))
    for i in range(120):
        expected = sorted(range(120), key=lambda j: (d[i, j], j))[:4]
        assert [n for _, n in sorted(got[i])] == expected


def test_over_sampling(spark):
    rng = np.random.default_rng(6)
    data = [(str(i), [float(v) for v in rng.normal(size=3)], int(i < 12)) for i in range(60)]
    df = spark.createDataFrame(data, "id string, v array<double>, y int")
    balanced = neighbours.smote_balance(df, "id", "v", "y")
    got = rows(balanced)
    assert {r.y: r["count"] for r in balanced.groupBy("y").count().collect()} == {0: 48, 1: 48}
    assert len({r[0] for r in got}) == 96
    assert got == rows(neighbours.smote_balance(df.repartition(5), "id", "v", "y"))
    low, high = np.array([d[1] for d in data if d[2]]).min(0), np.array([d[1] for d in data if d[2]]).max(0)
    assert all((np.array(r[1]) >= low - 1e-9).all() and (np.array(r[1]) <= high + 1e-9).all() for r in got if r[3])


def test_valence(spark):
    docs = spark.createDataFrame([("a", "Good, bad good the"), ("b", ""), ("c", "the xyz")], "id string, t string")
    scores = spark.createDataFrame([("good", 0.5, 0.0), ("bad", 0.0, 1.0), ("the", 1.0, 0.0)], "token string, pos double, neg double")
    stop = spark.createDataFrame([("the",)], "token string")
    got = {r.id: (r.valence, r.density) for r in lexicon.valence_density(docs, "id", "t", scores, stop).collect()}
    assert got == {"a": (0.0, pytest.approx(3 / 5)), "b": (0.0, 0.0), "c": (0.0, 0.0)}


def test_group_filter_leaves_out_null_group(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] + [(None,)] * 5, "g string")
    assert [r.g for r in filters.min_group_filter(df, "g", 2).collect()] == ["a"] * 3


def test_no_cartesian_products(spark, sf_dir):
    import __spark_entry__ as entry_points

    for name in ["kde", "cost_threshold", "histogram", "roc_curve", "class_distribution", "sampling_weights"]:
        plan = entry_points.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_kolmogorov_smirnov_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    normal, flat = rng.normal(3, 2, 2000), np.round(rng.uniform(0, 9, 2000), 1)

    def brute(x):
        x = np.sort(x)
        phi = np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in (x - x.mean()) / x.std(ddof=1)])
        upto, below = np.searchsorted(x, x, "right") / len(x), np.searchsorted(x, x, "left") / len(x)
        d = max((upto - phi).max(), (phi - below).max())
        at = d * math.sqrt(len(x))
        return d, 2 * sum((-1) ** (j - 1) * math.exp(-2 * (j * at) ** 2) for j in range(1, 200))

    rows = [(float(a), float(b), 4.0, None, float("nan")) for a, b in zip(normal, flat)]
    rows += [(None, None, None, None, None), (None, None, None, 7.0, 1.0), (None, None, None, None, float("inf"))]
    df = spark.createDataFrame(rows, "a double, b double, same double, one double, odd double")
    for parts in (1, 16):
        found = {r.feature: r for r in stats.ks_normal(df.repartition(parts), ["a", "b", "same", "one", "odd"]).collect()}
        for name, x in (("a", normal), ("b", flat)):
            d, p = brute(x)
            assert found[name].n == 2000 and abs(found[name].d - d) < 1e-8 and abs(found[name].p_value - p) < 1e-7
        assert all(found[c].d is None and found[c].p_value is None for c in ("same", "one", "odd"))
    assert found["a"].p_value > 0.1 and found["b"].p_value < 0.01
    assert stats.ks_normal(df.limit(0), ["a"]).count() == 0


def test_blocks_of_neighbours_are_read_as_arrow(spark):
    """Whole blocks as pandas rows held a Python object for each vector beside the copies."""
    df = spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(30)], "id bigint, v array<double>")
    found = neighbours.knn_join(df, "id", "v", 2, block_rows=8, max_pivots=3)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    table = pa.concat_tables(pa.table({"v": [[float(i), -1.0], [0.5, float(i)]]}) for i in range(5))
    assert neighbours._matrix(table.slice(3, 4), 2).tolist() == [[0.5, 1.0], [2.0, -1.0], [0.5, 2.0], [3.0, -1.0]]
    assert neighbours._matrix(table.slice(0, 0), 2).shape == (0, 2)
