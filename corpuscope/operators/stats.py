"""Descriptive and rank statistics as distributed aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.fixed_values import MIN_GROUP_SIZE
from corpuscope.functions.distributions import kolmogorov_upper, normal_cdf
from corpuscope.functions.tails import chi2_upper_column, correlation_p_column
from corpuscope.operators.filters import group_sizes
from corpuscope.operators.joins import weighted_lookup_join
from corpuscope.session import materialise
from corpuscope.operators.ordered import (
    average_ranks, cut_points, exact_quantiles, ordered_totals, quantile_rows, with_average_rank,
)

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def melt(df: DataFrame, columns: Sequence[str], *carry: str) -> DataFrame:
    """Long form (carry, feature, value), NULLs dropped."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns
    ])
    return df.select(*carry, F.explode(cells).alias("_c")).select(*carry, "_c.*").where(F.col("value").isNotNull())


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max of each column."""
    points = cut_points(df, *columns)
    long = melt(df, columns)
    moments = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, "value", QUARTILES, by=["feature"], points=points).drop("n")
    return moments.join(quartiles, "feature")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct count per column, NULLs not counted.

    Distinct (feature, value) pairs first: partial de-duplication before the shuffle.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    pairs = df.select(F.explode(cells).alias("_c")).select("_c.*").distinct()
    return pairs.groupBy("feature").agg(F.count("value").alias("n_unique"))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL and infinite values per column, one row per column."""
    counts = df.agg(*[
        F.struct(
            F.count_if(F.col(c).isNull()).alias("n_null"),
            F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias("n_inf"),
        ).alias(c) for c in columns
    ])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.n_null"), F.col(f"{c}.n_inf")) for c in columns])
    return counts.select(F.explode(cells).alias("_c")).select("_c.*")


def flag_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Ones and zeros of each binary flag, NULLs in neither."""
    counts = df.agg(*[
        F.struct(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias("ones"), F.count(c).alias("known")).alias(c)
        for c in flags
    ])
    cells = F.array(*[
        F.struct(F.lit(c).alias("flag"), F.col(f"{c}.ones"), (F.col(f"{c}.known") - F.col(f"{c}.ones")).alias("zeros"))
        for c in flags
    ])
    return counts.select(F.explode(cells).alias("_c")).select("_c.*")


def value_range(df: DataFrame, column: str) -> Column:
    """(lo, hi, n, sd) of a column as a scalar struct."""
    c = F.col(column).cast("double")
    return df.agg(F.struct(
        F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n"), F.stddev_samp(c).alias("sd"),
    ).alias("r")).scalar()


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between min and max, last bin closed, empty bins included."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_x"))
    span = value_range(rows, "_x")
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    width = (hi - lo) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col("_x") - lo, width)), F.lit(0))
    binned = rows.withColumn("_r", span).select(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    steps = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("_r", span)
    return steps.join(counts, "bin", "left").select(
        "bin", (lo + F.col("bin") * width).alias("left_edge"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def box_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count per group."""
    # Distinct values with counts carry all that the quartiles and the whiskers need: the input is read once.
    counted = materialise(df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, value).agg(
        F.count(F.lit(1)).alias("_k")), "counted")
    quartiles = materialise(exact_quantiles(counted, value, QUARTILES, by=[group], count=F.col("_k")), "quartiles")
    joined = weighted_lookup_join(counted, quartiles, group, "n")
    x, reach = F.col(value), 1.5 * (F.col("q3") - F.col("q1"))
    inside = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
    whiskers = joined.groupBy(group).agg(
        F.min(F.when(inside, x)).cast("double").alias("whisker_low"),
        F.max(F.when(inside, x)).cast("double").alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_k"))).alias("outliers"),
    )
    return quartiles.join(whiskers, group)


def normality(df: DataFrame, column: str) -> DataFrame:
    """Skewness, excess kurtosis and the Jarque-Bera statistic with its p-value."""
    c = F.col(column).cast("double")
    moments = df.agg(F.count(c).alias("n"), F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"))
    jb = F.col("n") / 6.0 * (F.pow("skewness", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4)
    return moments.withColumn("jarque_bera", jb).withColumn(
        "p_value", chi2_upper_column()(F.col("jarque_bera"), F.lit(2.0)))


def ks_normal(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Kolmogorov-Smirnov test of each column against the normal distribution of its own mean and deviation.

    One row per column with values: (feature, n, d, p_value). ``d`` is the exact supremum of |F_n - Phi|, taken on both
    sides of every distinct value from running totals inside value buckets; so no task sorts a column. ``p_value`` is
    that of the limit distribution. As mean and deviation come from the same rows it is too large, never too small.
    NULL and NaN are left out. Columns without spread, or with infinite values, have a NULL ``d`` and ``p_value``.
    """
    cells = melt(df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns]), columns)
    # Distinct values with counts carry all that is needed: the input is read once.
    counted = materialise(cells.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("k")), "counted")
    totals = ordered_totals(counted, "value", by=["feature"], measures={"n": F.col("k")})
    weight, x = F.col("k").cast("double"), F.col("value")
    means = counted.groupBy("feature").agg((F.sum(weight * x) / F.sum(weight)).alias("mean"), F.sum("k").alias("rows"))
    off = F.col("value") - F.col("mean")
    spread = weighted_lookup_join(counted, means, "feature", "rows").groupBy("feature").agg(
        F.max("mean").alias("mean"), F.max("rows").alias("rows"), F.sqrt(F.try_divide(F.sum(weight * off * off), F.max("rows") - 1.0)).alias("deviation"),
    )
    placed = weighted_lookup_join(totals, spread, "feature", "rows")
    phi = normal_cdf(F.nanvl(F.try_divide(off, F.col("deviation")), F.lit(None)))
    n = F.col("n_total").cast("double")
    gap = F.greatest((F.col("n_below") + F.col("n_ties")) / n - phi, phi - F.col("n_below") / n)
    found = placed.groupBy("feature").agg(F.max("n_total").alias("n"), F.max(F.when(phi.isNotNull(), gap)).alias("d"))
    return found.withColumn("p_value", kolmogorov_upper(F.col("d") * F.sqrt(F.col("n").cast("double"))))


def qq_points(df: DataFrame, column: str, grid: int = 99) -> DataFrame:
    """Exact sample quantiles at i/(grid+1) for a Q-Q plot."""
    probs = {f"p{i}": i / (grid + 1) for i in range(1, grid + 1)}
    return quantile_rows(df, column, probs).select("prob", "quantile")


def kernel_density(df: DataFrame, column: str, grid: int = 100) -> DataFrame:
    """Gaussian density with Scott's bandwidth on an even grid from min to max.

    Distinct values are counted first; each adds its kernel to every grid point
    before the shuffle, so only grid-sized partial sums travel.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_x"))
    r = value_range(rows, "_x")
    counted = rows.groupBy("_x").agg(F.count(F.lit(1)).alias("_k")).withColumn("_r", r)
    points = counted.select("_x", "_k", "_r", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    h = F.col("_r.sd") * F.pow(F.col("_r.n").cast("double"), F.lit(-0.2))
    at = F.col("_r.lo") + F.col("point") * (F.col("_r.hi") - F.col("_r.lo")) / (grid - 1)
    kernel = F.exp(-F.pow((at - F.col("_x")) / h, F.lit(2)) / 2) / (h * (2 * 3.141592653589793) ** 0.5)
    return points.groupBy("point").agg(
        F.max(at).alias("x"), F.try_divide(F.sum(F.col("_k") * kernel), F.max("_r.n").cast("double")).alias("density"))


def rank_columns(df: DataFrame, key: str, columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Average rank of each column by ``key``: one wide row per key."""
    long = materialise(melt(df, columns, key), "melted")
    ranks = average_ranks(long, "value", by=["feature"]).select("feature", "value", "n", "avg_rank")
    placed = weighted_lookup_join(long, ranks, ["feature", "value"], "n")
    return placed.groupBy(key).agg(*[
        F.max(F.when(F.col("feature") == c, F.col("avg_rank"))).alias(c) for c in columns
    ])


def spearman_matrix(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Spearman correlation of all column pairs over complete rows: (a, b, rho, n, p_value)."""
    ranks = rank_columns(df.dropna(subset=list(columns)), key, columns)
    pairs = [(a, b) for a in columns for b in columns]
    wide = ranks.agg(F.count(F.lit(1)).alias("_n"), *[
        F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"_{i}")
        for i, (a, b) in enumerate(pairs) if a < b
    ])
    rho = {pair: F.col(f"_{i}") for i, pair in enumerate(pairs) if pair[0] < pair[1]}
    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                 (F.lit(1.0) if a == b else rho[(min(a, b), max(a, b))]).alias("rho"), F.col("_n").alias("n"))
        for a, b in pairs
    ])
    long = wide.select(F.explode(cells).alias("_c")).select("_c.*")
    return long.withColumn("p_value", correlation_p_column()(F.col("rho"), F.col("n")))


def spearman_pairs(df: DataFrame, key: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Spearman correlation of (feature, target) pairs, NULLs dropped pair by pair.

    A column is ranked once for each set of NULLs it has to share a pair with: columns
    without NULLs are ranked once for all pairs, not once per pair.
    """
    columns = sorted({c for pair in pairs for c in pair})
    numbers = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    gaps = numbers.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).head()
    points = cut_points(numbers, *columns)

    def slot(column: str, pair: tuple[str, str]) -> tuple[str, tuple[str, ...]]:
        return column, tuple(sorted(c for c in set(pair) if gaps[c] and c != column))

    slots = sorted({slot(c, pair) for pair in pairs for c in pair})
    names = {s: f"s{i}" for i, s in enumerate(slots)}
    cells = [
        f"named_struct('slot', '{names[column, others]}', 'value', CASE WHEN "
        + " AND ".join([f"`{c}` IS NOT NULL" for c in (column, *others)]) + f" THEN `{column}` END)"
        for column, others in slots
    ]
    long = numbers.selectExpr(f"`{key}`", f"inline(array({', '.join(cells)}))").where("value IS NOT NULL")
    ranks = average_ranks(long, "value", by=["slot"], points=points).select("slot", "value", "n", "avg_rank")
    placed = weighted_lookup_join(long, ranks, ["slot", "value"], "n")
    wide = placed.groupBy(key).agg(*[
        F.expr(f"max(CASE WHEN slot = '{name}' THEN avg_rank END)").alias(name) for name in names.values()
    ])
    sides = [(names[slot(x, (x, y))], names[slot(y, (x, y))]) for x, y in pairs]
    found = wide.agg(*[
        F.expr(
            f"named_struct('feature', '{x}', 'target', '{y}',"
            f" 'rho', try_divide(covar_pop({a}, {b}) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL),"
            f" stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) * stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL)),"
            f" 'n', count_if({a} IS NOT NULL AND {b} IS NOT NULL))"
        ).alias(f"p{i}") for i, ((x, y), (a, b)) in enumerate(zip(pairs, sides))
    ])
    rows = found.select(F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("_p")).select("_p.*")
    return rows.withColumn("p_value", correlation_p_column()(F.col("rho"), F.col("n")))


def correlation_pivot(correlations: DataFrame, targets: Sequence[str], sort_by: str) -> DataFrame:
    """Feature x target matrix, strongest ``sort_by`` correlation first."""
    wide = correlations.groupBy("feature").pivot("target", list(targets)).agg(F.first("rho"))
    return wide.orderBy(F.col(sort_by).desc(), "feature")


def topic_correlation(df: DataFrame, topics: str, value: str, names: Sequence[str]) -> DataFrame:
    """Point-biserial correlation of each topic flag with ``value``: (topic, rho, n, p_value).

    ``corr`` of a 0/1 flag is the point-biserial coefficient; all topics share one pass.
    """
    rows = df.where(F.col(value).isNotNull())
    listed = F.coalesce(F.col(topics), F.array().cast("array<string>"))
    wide = rows.agg(F.count(F.lit(1)).alias("_n"), *[
        F.corr(F.array_contains(listed, name).cast("double"), F.col(value).cast("double")).alias(f"_{i}")
        for i, name in enumerate(names)
    ])
    cells = F.array(*[
        F.struct(F.lit(name).alias("topic"), F.nanvl(F.col(f"_{i}"), F.lit(None)).alias("rho"), F.col("_n").alias("n"))
        for i, name in enumerate(names)
    ])
    long = wide.select(F.explode(cells).alias("_c")).select("_c.*")
    return long.withColumn("p_value", correlation_p_column()(F.col("rho"), F.col("n")))


def kruskal_wallis(df: DataFrame, group: str, value: str, min_n: int = MIN_GROUP_SIZE) -> DataFrame:
    """Kruskal-Wallis H with tie correction over groups of at least ``min_n`` rows.

    One row (h, p_value, groups_tested); fewer than two groups give 0 groups and NULLs.
    """
    # Equal (group, value) rows are counted before anything is joined or ordered.
    counted = df.select(group, F.col(value).cast("double").alias("_y")).dropna().groupBy(group, "_y").agg(
        F.count(F.lit(1)).alias("_k"))
    # Group sizes count every row of the group; ranks only those with a value.
    kept = materialise(weighted_lookup_join(counted, group_sizes(df, group, min_n), group, "group_n"), "kept")
    ranked = with_average_rank(ordered_totals(kept, "_y", keep=[group], measures={"n": F.col("_k")}))
    sums = ranked.groupBy(group).agg(
        F.sum("n").alias("n_i"), F.sum(F.col("n") * F.col("avg_rank")).alias("r_i"), F.max("n_total").alias("n_all"),
        # Each tied value is spread over its groups in proportion n / n_ties, so that t^3 - t adds up once.
        F.sum(F.col("n") * (F.pow(F.col("n_ties").cast("double"), F.lit(2)) - 1)).alias("tie_i"),
    )
    # Mean ranks are taken from the middle rank: the plain form subtracts two numbers of the size of n.
    off = F.col("r_i") / F.col("n_i") - (F.col("n_all").cast("double") + 1) / 2
    total = sums.agg(
        F.count(F.lit(1)).alias("k"), F.max("n_all").cast("double").alias("n"),
        F.sum(F.col("n_i") * off * off).alias("s"), F.sum("tie_i").alias("t"),
    )
    n = F.col("n")
    raw = 12 / (n * (n + 1)) * F.col("s")
    h = F.try_divide(raw, 1 - F.col("t") / (n * n * n - n))
    tested = total.select(
        F.when(F.col("k") >= 2, h).alias("h"),
        F.when(F.col("k") >= 2, F.col("k")).otherwise(0).cast("bigint").alias("groups_tested"),
    )
    return tested.withColumn("p_value", chi2_upper_column()(F.col("h"), (F.col("groups_tested") - 1).cast("double")))


def group_medians(df: DataFrame, value: str, group: str) -> DataFrame:
    return exact_quantiles(df, value, {"median": 0.5}, by=[group]).select(group, "median")


def sort_by_magnitude(df: DataFrame, column: str, *tiebreak: str) -> DataFrame:
    return df.orderBy(F.abs(column).desc(), *tiebreak)


def comment_totals(threads: DataFrame, replies: DataFrame, key: str = "video_id") -> DataFrame:
    """Threads, replies and their sum per item."""
    t = threads.groupBy(key).agg(F.count(F.lit(1)).alias("threads"))
    r = replies.groupBy(key).agg(F.count(F.lit(1)).alias("replies"))
    both = t.join(r, key, "full_outer").na.fill(0, ["threads", "replies"])
    return both.withColumn("total", F.col("threads") + F.col("replies"))


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


