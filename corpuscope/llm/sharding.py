"""Contiguous shards of equal bytes by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpuscope.llm.common import whole_text
from corpuscope.session import materialise


def shard_by_bytes(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows are ordered by id (NULLs first, then by checksum and size) and dealt to ``runs`` ranges. Each range sums its
    own sizes; the sums of the ranges before it, one row per range, give it its offset, so no task sees the whole
    order. A row goes to the shard in which the middle of its bytes falls when the total is cut at equal targets:
    shards are contiguous and differ by at most about one document. ``slot`` numbers the rows of a shard from 0.

    Size is the UTF-8 length plus 1; a NULL text counts as empty. An empty table gives no rows. With fewer rows than
    shards some shards stay empty. Rows equal in all three keys take adjacent places in any order.
    """
    spark = docs.sparkSession
    runs = runs or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = whole_text(text_col)
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    # Written once: the ranges are drawn from a sample, so a second run of the plan could deal rows otherwise.
    ranged = materialise(
        slim.repartitionByRange(runs, "doc_id", "text_crc32", "size").withColumn("run", F.spark_partition_id()), "runs"
    )
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, whatever the input holds.
    totals = ranged.groupBy("run").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    offsets = totals.select(
        "run",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("run").orderBy("doc_id", "text_crc32", "size")
    placed = (
        ranged.withColumn("row_in_run", F.row_number().over(inside))
        .withColumn("bytes_in_run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(offsets), "run")
    )
    # Twice the middle of the row's bytes, so that all stays in whole numbers.
    shard = f"((bytes_before + bytes_in_run) * 2 - size) * {int(shards)} div (all_bytes * 2)"
    placed = placed.select(
        "doc_id", "size", "text_crc32",
        F.expr("rows_before + row_in_run - 1").alias("place"),
        F.expr(shard).cast("int").alias("shard"),
    )
    starts = placed.groupBy("shard").agg(F.min("place").alias("first_place"))  # one row per shard
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first_place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
