"""Exact global order without a one-task window.

Ranks, running totals and exact quantiles need every value's place in one
order. An unpartitioned window would sort everything in one task, and a window
per group would put a group with a third of the rows into one task. Here

1. rows are pre-aggregated to distinct values (map-side combine),
2. the value range is cut into buckets at approximate quantiles. The cut points
   are a short list of numbers, so they pass through the driver like those of
   any ``Bucketizer``. They steer balance only; the result does not depend on them,
3. totals per (group, bucket) give each bucket its offset,
4. a window per (group, bucket) finishes the work inside the bucket.

No task sees more than about 1/buckets of the distinct values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET = "_bucket"
LEAST_BUCKETS = 32


def _quoted(names: Sequence[str]) -> list[str]:
    return [f"`{name}`" for name in names]


def _names(names: Sequence[str]) -> str:
    return ", ".join(_quoted(names))


def default_buckets(df: DataFrame) -> int:
    """As many as shuffle partitions, which are set to follow the data; the bounds are one number each."""
    return max(LEAST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_points(df: DataFrame, *values: str, buckets: int | None = None) -> list[float]:
    """Strictly increasing bucket bounds from -inf to inf for one or more columns."""
    buckets = buckets or default_buckets(df)
    probabilities = [i / buckets for i in range(1, buckets)]
    doubles = df.select(*[F.col(v).cast("double").alias(v) for v in values])
    found = doubles.approxQuantile(list(values), probabilities, 0.5 / buckets) if probabilities else []
    # A Bucketizer needs at least one inner bound; without values any will do.
    inner = sorted({point for points in found for point in points}) or [0.0]
    return [float("-inf"), *inner, float("inf")]


def with_bucket(df: DataFrame, value: str, points: Sequence[float]) -> DataFrame:
    scaled = df.withColumn("_v", F.col(value).cast("double"))
    cutter = Bucketizer(splits=list(points), inputCol="_v", outputCol=BUCKET, handleInvalid="keep")
    # Never NULL, so that no null check on the bucket is pushed below the pre-aggregation:
    # both readers of the distinct values then share one exchange.
    return cutter.transform(scaled).withColumn(BUCKET, F.coalesce(F.col(BUCKET).cast("int"), F.lit(-1))).drop("_v")


def ordered_totals(
    df: DataFrame, value: str, by: Sequence[str] = (), keep: Sequence[str] = (),
    measures: Mapping[str, Column] | None = None, points: Sequence[float] | None = None,
    needed: Column | None = None,
) -> DataFrame:
    """Running totals of ``measures`` over ``value`` within each ``by`` group.

    One row per distinct (by, value, keep). For each measure ``m`` (default: the row
    count ``n``) it has ``m``, ``m_below`` (total of strictly smaller values),
    ``m_ties`` (total at this value) and ``m_total`` (total of the group).
    Rows with a NULL value or group are left out. ``needed`` may restrict the last
    step to some buckets by a predicate on ``m_off``, ``m_bucket`` and ``m_total``.
    """
    measures = dict(measures or {"n": F.lit(1)})
    by, keep = list(by), list(keep)
    df = df.dropna(subset=[value, *by])
    if points is None:
        points = cut_points(df, value)
    distinct = df.groupBy(*by, value, *keep).agg(*[F.sum(c).alias(m) for m, c in measures.items()])
    bucketed = with_bucket(distinct, value, points)

    # At most one row per bucket in each group: a short, bounded window.
    per_bucket = bucketed.groupBy(*by, BUCKET).agg(*[F.sum(m).alias(f"{m}_bucket") for m in measures])
    group = f"PARTITION BY {_names(by)}" if by else ""
    before = f"{group} ORDER BY {BUCKET} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    offsets = per_bucket.selectExpr(
        *_quoted(by), BUCKET, *[f"{m}_bucket" for m in measures],
        *[f"coalesce(sum({m}_bucket) OVER ({before}), 0) AS {m}_off" for m in measures],
        *[f"sum({m}_bucket) OVER ({group}) AS {m}_total" for m in measures],
    )
    if needed is not None:
        offsets = offsets.where(needed)
    placed = bucketed.join(offsets, [*by, BUCKET])

    cell = _names([*by, BUCKET])
    columns = []
    for m in measures:
        peers = f"sum({m}) OVER (PARTITION BY {cell}, `{value}`)" if keep else m
        columns += [
            m, f"{m}_off + sum({m}) OVER (PARTITION BY {cell} ORDER BY `{value}`) - {peers} AS {m}_below",
            f"{peers} AS {m}_ties", f"{m}_total",
        ]
    return placed.selectExpr(*_quoted([*by, value, *keep]), *columns)


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), keep: Sequence[str] = (),
                  points: Sequence[float] | None = None) -> DataFrame:
    """Distinct values with their multiplicity ``n`` and 1-based rank, ties averaged."""
    return with_average_rank(ordered_totals(df, value, by, keep, points=points))


def with_average_rank(totals: DataFrame) -> DataFrame:
    return totals.withColumn("avg_rank", F.col("n_below") + (F.col("n_ties") + 1) / 2)


def quantile_rows(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (),
    points: Sequence[float] | None = None, count: Column | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group and name: (by, name, prob, n, quantile).

    ``count`` is how often a row counts, for values that were counted before.

    Only buckets that hold a wanted position are sorted, and only the rows at those
    positions go on to the last aggregation.
    """
    wanted = "array(" + ", ".join(f"named_struct('name', '{name}', 'p', {p!r}D)" for name, p in probs.items()) + ")"
    low = "CAST(floor((n_total - 1) * {p}) AS BIGINT)"

    def covers(start: str, size: str, p: str, step: int) -> str:
        index = f"({low.format(p=p)} + {step})"
        return f"({start} <= {index} AND {index} < {start} + {size})"

    def holds(start: str, size: str) -> str:
        return f"s -> {covers(start, size, 's.p', 0)} OR {covers(start, size, 's.p', 1)}"

    ranked = ordered_totals(
        df, value, by, points=points, measures={"n": F.lit(1) if count is None else count}, needed=F.expr(f"exists({wanted}, {holds('n_off', 'n_bucket')})"))
    hits = ranked.selectExpr(
        *_quoted(by), f"CAST(`{value}` AS DOUBLE) AS _x", "n", "n_below", "n_total",
        f"inline(filter({wanted}, {holds('n_below', 'n')})) AS (name, prob)",
    )
    ends = hits.groupBy(*by, "name", "prob").agg(
        F.max("n_total").alias("n"),
        F.expr(f"max(CASE WHEN {covers('n_below', 'n', 'prob', 0)} THEN _x END)").alias("_low"),
        F.expr(f"max(CASE WHEN {covers('n_below', 'n', 'prob', 1)} THEN _x END)").alias("_high"),
    )
    share = "((n - 1) * prob - floor((n - 1) * prob))"
    return ends.selectExpr(
        *_quoted(by), "name", "prob", "n",
        f"CASE WHEN {share} > 0 THEN _low + (_high - _low) * {share} ELSE _low END AS quantile",
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (),
    points: Sequence[float] | None = None, count: Column | None = None,
) -> DataFrame:
    """``quantile_rows`` with one column per name: (by, n, one column per prob)."""
    rows = quantile_rows(df, value, probs, by, points, count)
    return rows.groupBy(*by).agg(
        F.max("n").alias("n"), *[F.expr(f"max(CASE WHEN name = '{name}' THEN quantile END)").alias(name) for name in probs])


def medians(df: DataFrame, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Exact medians of several columns per group, NULLs skipped: (by, one column per value).

    A group whose column is all NULL gets a NULL median.
    """
    points = cut_points(df, *values)
    long = df.select(
        *by,
        F.explode(F.array(*[
            F.struct(F.lit(v).alias("_metric"), F.col(v).cast("double").alias("_value")) for v in values
        ])).alias("_m"),
    ).select(*by, "_m.*")
    found = quantile_rows(long, "_value", {"median": 0.5}, by=[*by, "_metric"], points=points)
    wide = found.groupBy(*by).agg(*[
        F.expr(f"max(CASE WHEN _metric = '{v}' THEN quantile END)").alias(v) for v in values
    ])
    return df.select(*by).dropna(subset=list(by)).distinct().join(wide, list(by), "left")


def positions(df: DataFrame, unit: str, tiebreak: Sequence[str], by: Sequence[str] = (),
              buckets: int | None = None) -> DataFrame:
    """Rows with their exact 0-based ``position`` by (unit, tiebreak) and group size ``group_n``.

    ``unit`` is a uniform draw in (0, 1), so equal-width buckets are balanced.
    """
    buckets = buckets or default_buckets(df)
    by = list(by)
    cut = df.withColumn(BUCKET, F.floor(F.col(unit) * buckets).cast("int"))
    sizes = cut.groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    before = group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, BUCKET, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(group).alias("group_n"),
    )
    within = Window.partitionBy(*by, BUCKET).orderBy(unit, *tiebreak)
    return (
        cut.join(offsets, [*by, BUCKET])
        .withColumn("position", F.col("_off") + F.row_number().over(within) - 1)
        .drop("_off", BUCKET)
    )
