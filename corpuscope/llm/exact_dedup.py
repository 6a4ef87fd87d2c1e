"""Exact deduplication by counting quotient filters and byte verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.common import free_names, one_space, power_of_two, small_batches, whole_text
from corpuscope.session import materialise

RUN_BITS = 10  # runs (quotients) in a block of the filter
FINGERPRINTS_PER_BLOCK = 20_000  # blocks follow the number of rows, so a merging task stays this small
FLUSH = 1 << 20  # fingerprints that a partition holds before it writes a filter

FILTER_SCHEMA = "block long, runs binary, remainders binary, counts binary"


def _encode(values: np.ndarray, counts: np.ndarray, block_bits: int) -> Iterator[tuple]:
    """Sorted fingerprints to filter blocks: the length of each run, the remainders in order, the counters."""
    rest = 64 - block_bits
    blocks = values >> np.uint64(rest) if block_bits else np.zeros(len(values), np.uint64)
    edges = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(values) else []
    for start, end in zip(edges, [*edges[1:], len(values)]):
        low = values[start:end] & np.uint64((1 << rest) - 1)
        runs = np.bincount((low >> np.uint64(rest - RUN_BITS)).astype(np.int64), minlength=1 << RUN_BITS)
        remainders = low & np.uint64((1 << (rest - RUN_BITS)) - 1)
        yield int(blocks[start]), runs.astype("<u4").tobytes(), remainders.astype("<u8").tobytes(), counts[start:end].astype("<u8").tobytes()


def _decode(runs: bytes, remainders: bytes, block: int, block_bits: int) -> np.ndarray:
    rest = 64 - block_bits
    quotients = np.repeat(np.arange(1 << RUN_BITS, dtype=np.uint64), np.frombuffer(runs, "<u4"))
    top = np.uint64((block << rest) % (1 << 64))
    return top | (quotients << np.uint64(rest - RUN_BITS)) | np.frombuffer(remainders, "<u8")


def _builder(block_bits: int):
    """Builds counting quotient filters of one partition's fingerprints."""

    def rows_of(values: np.ndarray) -> pa.RecordBatch:
        unique, counts = np.unique(values, return_counts=True)
        columns = list(zip(*_encode(unique, counts, block_bits)))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])],
            names=["block", "runs", "remainders", "counts"],
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(held[-1])
            if size >= FLUSH:
                yield rows_of(np.concatenate(held))
                held, size = [], 0
        if size:
            yield rows_of(np.concatenate(held))

    return build


def _merger(block_bits: int):
    """Merges one block's filters by their sorted remainders; gives fingerprints counted more than once."""

    def merge(key: tuple, filters: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([_decode(r, m, int(key[0]), block_bits) for r, m in zip(filters.runs, filters.remainders)])
        counts = np.concatenate([np.frombuffer(c, "<u8") for c in filters.counts])
        order = np.argsort(values, kind="stable")  # merges runs that are sorted already
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        total = np.add.reduceat(counts, first)
        many = total > 1
        return pd.DataFrame({"fingerprint": values[first][many].view(np.int64), "copies": total[many].astype(np.int64)})

    return merge


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """Fingerprints (one long column) that occur more than once, with their counts.

    Every partition writes a counting quotient filter; blocks of equal leading bits are merged without loss, so the
    counts are exact for the fingerprints. What is shuffled is one entry per distinct fingerprint and partition: a
    group with a third of all rows is one counter in each filter.
    """
    block_bits = power_of_two(rows / FINGERPRINTS_PER_BLOCK).bit_length() - 1
    return (
        fingerprints.mapInArrow(_builder(block_bits), FILTER_SCHEMA)
        .groupBy("block")
        .applyInPandas(_merger(block_bits), "fingerprint long, copies long")
    )


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of at least two rows with equal normalised texts: text_sha256, keep_id (smallest id), group_size.

    Rows whose fingerprint is counted more than once go to byte verification: they are grouped by the normalised text
    itself, so texts that merely share a fingerprint part again. NULL texts count as empty.
    """
    small_batches(docs.sparkSession)
    normal = docs.select(F.col(id_col).alias("doc_id"), one_space(whole_text(text_col)).alias("body"))
    normal = normal.withColumn("fingerprint", F.xxhash64("body"))
    repeated = repeated_fingerprints(normal.select("fingerprint"), docs.count())
    return (
        normal.join(repeated.select("fingerprint"), "fingerprint", "left_semi")
        .groupBy("body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after each run of ASCII white space has become one space. The row with the
    smallest id stays. NULL texts are empty texts; empty texts equal one another. A NULL id never wins against an id;
    rows without id in a group without ids all stay. Rows that repeat an id share its decision. An empty table gives
    no rows; further columns of ``docs`` are not read.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(one_space(whole_text(text_col)), 256).alias("text_sha256")
    )
    joined = slim.join(duplicate_groups(docs, id_col, text_col), "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, one with the smallest id; all columns stay as they are.

    Where several rows of a group have that id (or none has an id), the row whose JSON has the smallest hash stays.
    """
    sha, keep, several = free_names(docs, "_group_sha", "_group_keep", "_several")
    groups = materialise(duplicate_groups(docs, id_col, text_col).select(
        F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep)
    ), "groups")
    text_sha = F.sha2(one_space(whole_text(text_col)), 256)
    own = F.col(f"`{id_col}`").eqNullSafe(F.col(keep))
    # Digests and ids alone are counted; nearly always, no id repeats within a group.
    digests = docs.select(F.col(f"`{id_col}`"), text_sha.alias(several))
    keepers = digests.join(groups, F.col(several) == F.col(sha)).where(own).groupBy(sha).agg(F.count(F.lit(1)).alias(several))
    repeats = materialise(keepers.where(F.col(several) > 1), "repeats")
    rest = docs.join(groups, (text_sha == F.col(sha)) & ~own, "left_anti")
    if repeats.isEmpty():
        return rest
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    ones = docs.join(groups.join(repeats, sha), (text_sha == F.col(sha)) & own).select(F.col(sha), row.alias("row"))
    ones = ones.groupBy(sha).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    singles = rest.join(repeats, text_sha == F.col(sha), "left_anti")
    return singles.unionByName(ones.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)))
