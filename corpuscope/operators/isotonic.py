"""Isotonic regression by pooling adjacent violators on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuscope.session import materialise

BLOCKS_PER_TASK = 100_000

SCHEMA = "low double, high double, total double, weight double"


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pools the sorted blocks of one partition: a block takes in the one before while that one's mean is not smaller."""
    stack: list[list[float]] = []
    for batch in batches:
        for low, high, total, weight in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "total", "weight"))):
            while stack and stack[-1][2] * weight >= total * stack[-1][3]:
                before = stack.pop()
                low, total, weight = before[0], total + before[2], weight + before[3]
            stack.append([low, high, total, weight])
    for start in range(0, len(stack), 10_000):
        columns = np.array(stack[start : start + 10_000]).T
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["low", "high", "total", "weight"])


def pooled_blocks(scored: DataFrame, label: str = "label", score: str = "score", weight: str | None = None,
                  blocks_per_task: int = BLOCKS_PER_TASK) -> DataFrame:
    """Blocks of the isotonic regression of ``label`` on ``score``: low, high (scores), fit, weight.

    Equal scores are added up first. Then each range of scores is pooled by itself; pooled blocks stand for their rows
    from there on, as violators may be pooled in any order. While the last block of a range and the first of the next
    are out of order, the ranges are cut anew at other places, so these two fall into one. A task holds one range
    of about ``blocks_per_task`` blocks; the driver sees two blocks of each range. Rows whose score or label
    is NULL or NaN are passed over; no rows give no blocks.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = scored.select(F.col(score).cast("double").alias("low"), F.col(label).cast("double").alias("y"), w.alias("w"))
    rows = rows.where("low IS NOT NULL AND y IS NOT NULL AND w > 0 AND NOT isnan(low) AND NOT isnan(y)")
    blocks = rows.groupBy("low").agg(F.sum(F.col("y") * F.col("w")).alias("total"), F.sum("w").alias("weight")).select(
        "low", F.col("low").alias("high"), "total", "weight")
    blocks = materialise(blocks, "scores")
    ranges = 0
    while True:
        wanted = -(-blocks.count() // blocks_per_task) or 1
        # Another number of ranges cuts at other places.
        ranges = wanted + 1 if wanted == ranges and wanted > 1 else wanted
        pooled = blocks.repartitionByRange(ranges, "low").sortWithinPartitions("low").mapInArrow(_pool, SCHEMA)
        blocks = materialise(pooled.withColumn("range", F.spark_partition_id()), "blocks")
        if ranges == 1:
            break
        block = F.struct("low", (F.col("total") / F.col("weight")).alias("mean"))
        ends = blocks.groupBy("range").agg(F.min(block).alias("first"), F.max(block).alias("last")).collect()
        ends.sort(key=lambda r: r["first"].low)
        if all(a["last"].mean < b["first"].mean for a, b in zip(ends, ends[1:])):
            break
        blocks = blocks.drop("range")
    return blocks.select("low", "high", (F.col("total") / F.col("weight")).alias("fit"), "weight")
