"""Resumable keyed ingest of landed files.

A table is a log of batches, dealt to slots by the hash of the key. A slot's folder holds, for every micro-batch with
keys of that slot, ``turn=T/stream=S/batch_id=N``: S is the id that Spark wrote into the stream's checkpoint, so a
second source, or the same source with a new checkpoint, never meets another one's folders; N is the batch within the
stream; T numbers the batches in the order in which they were begun. A replay finds its turn again by (S, N) and
overwrites just its own folders, so a restart after a lost driver or executor neither doubles nor loses a row. No
batch rewrites the table, and a batch reads the key columns of its own slots alone: neither grows with the rest of the
table. Several streams may feed one table one after the other.

* ignore mode: a batch stores only keys no other batch holds, so the log is unique;
* replace mode: a batch stores the latest row of each of its keys, and the reader
  takes the row of the highest turn.

``_slots`` names the number of slots, which stays as it is for the life of the table, and ``_turns`` the batches.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpuscope.operators.joins import as_list
from corpuscope.operators.mutation import dead_letter, keep_first, keep_last

SLOT, TURN, STREAM, BATCH = "slot", "turn", "stream", "batch_id"
PLACE = [
    T.StructField(SLOT, T.IntegerType()), T.StructField(TURN, T.LongType()), T.StructField(STREAM, T.StringType()),
    T.StructField(BATCH, T.LongType()),
]
SLOTS = 32  # more for tables that take many small batches of few keys


def _match(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern, in whatever store the table is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [str(f.getPath()) for f in found or []]


def _make(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def slots_of(spark: SparkSession, path: str, wanted: int = SLOTS) -> int:
    """The table's number of slots; a new table gets ``wanted``."""
    known = [int(name.rpartition("=")[2]) for name in _match(spark, f"{path}/_slots/n=*")]
    if not known:
        _make(spark, f"{path}/_slots/n={wanted}")
    return min(known, default=wanted)


def slot(keys: Sequence[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def _log(spark: SparkSession, path: str, schema: T.StructType, only: Sequence[int] | None = None) -> DataFrame:
    """The log as stored, or the slots ``only`` of it; an absent folder reads as empty."""
    full = T.StructType([*schema.fields, *PLACE])
    folders = [path]
    if only is not None:
        wanted = ",".join(map(str, only))
        folders = _match(spark, f"{path}/{SLOT}={{{wanted}}}") if only else []
    if not folders:
        return spark.createDataFrame([], full)
    try:
        return spark.read.schema(full).option("basePath", path).parquet(*folders)
    except AnalysisException:
        return spark.createDataFrame([], full)


def _batches(spark: SparkSession, path: str) -> dict[tuple[str, int], int]:
    """(stream, batch) of each batch begun, with its turn."""
    names = [re.search(rf"{TURN}=(\d+),{STREAM}=(.+),{BATCH}=(\d+)$", name) for name in _match(spark, f"{path}/_turns/*")]
    return {(m[2], int(m[3])): int(m[1]) for m in names if m}


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that a checkpoint belongs to; another one for each new checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").head()[0])["id"]


def _store(batch: DataFrame, path: str, stream: str, batch_id: int, keys: Sequence[str]) -> None:
    spark = batch.sparkSession
    slots = slots_of(spark, path)
    known = _batches(spark, path)
    turn = known.get((stream, batch_id))
    if turn is None:
        turn = max(known.values(), default=0) + 1
        _make(spark, f"{path}/_turns/{TURN}={turn},{STREAM}={stream},{BATCH}={batch_id}")
    placed = batch.withColumns({
        SLOT: slot(keys, slots), TURN: F.lit(turn).cast("long"), STREAM: F.lit(stream), BATCH: F.lit(batch_id).cast("long"),
    })
    # One file per slot and batch; only the folders that the batch writes are replaced.
    placed.repartition(SLOT).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        SLOT, TURN, STREAM, BATCH).parquet(path)


def stored_keys(batch: DataFrame, path: str, keys) -> DataFrame:
    """Keys (with the place of their batch) in those slots of the table that the keys of ``batch`` fall into."""
    keys = as_list(keys)
    spark = batch.sparkSession
    number = slots_of(spark, path)
    touched = [r[0] for r in batch.select(slot(keys, number).alias(SLOT)).distinct().collect()]  # at most all slots
    return _log(spark, path, batch.schema, sorted(touched)).select(*keys, STREAM, BATCH)


def store_ignore(batch: DataFrame, path: str, stream: str, batch_id: int, keys, order: Sequence[str]) -> None:
    """Append the batch's new keys; existing keys win, then the first row of the batch."""
    keys = as_list(keys)
    own = (F.col(STREAM) == stream) & (F.col(BATCH) == batch_id)
    others = stored_keys(batch, path, keys).where(~own).select(*keys)
    fresh = keep_first(batch, keys, order).join(others, keys, "left_anti").select(*batch.columns)
    _store(fresh, path, stream, batch_id, keys)


def store_replace(batch: DataFrame, path: str, stream: str, batch_id: int, keys, order: Sequence[str]) -> None:
    """Append the latest row of each key of the batch."""
    keys = as_list(keys)
    _store(keep_last(batch, keys, order), path, stream, batch_id, keys)


def read_ignore(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return _log(spark, path, schema).drop(SLOT, TURN, STREAM, BATCH)


def read_replace(spark: SparkSession, path: str, schema: T.StructType, keys) -> DataFrame:
    """Latest row per key."""
    return keep_last(_log(spark, path, schema), keys, [TURN]).drop(SLOT, TURN, STREAM, BATCH)


def compact(spark: SparkSession, path: str, target: str, schema: T.StructType, keys) -> DataFrame:
    """Resolve the log into the new folder ``target``, to be read and fed from there on.

    The resolved rows are a batch of a stream that no checkpoint has, so no batch can overwrite them.
    """
    keys = as_list(keys)
    slots_of(spark, target, slots_of(spark, path))
    _store(read_replace(spark, path, schema, keys), target, f"compacted-{uuid.uuid4()}", 0, keys)
    return _log(spark, target, schema)


def read_landed(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All rows of a folder of Parquet files; one that is not there yet reads as empty."""
    return spark.read.schema(schema).parquet(folder) if _match(spark, folder) else spark.createDataFrame([], schema)


def open_stream(spark: SparkSession, source: str, schema: T.StructType, fmt: str = "json",
                max_files: int = 1000) -> DataFrame:
    """Landed files as a stream; the checkpoint remembers which files were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(source)


def stream_ingest(stream: DataFrame, path: str, checkpoint: str, keys, order: Sequence[str],
                  mode: str = "ignore", failed_path: str | None = None, succeeded=None,
                  done: DataFrame | None = None, slots: int = SLOTS) -> None:
    """Drain the stream into the log at ``path`` and stop; a later call resumes.

    Rows failing ``succeeded`` go to ``failed_path``; rows whose key is in ``done``
    are skipped. ``slots`` counts for new tables.
    """
    keys = as_list(keys)
    for table in filter(None, (path, failed_path)):
        slots_of(stream.sparkSession, table, slots)
    store = {"ignore": store_ignore, "replace": store_replace}[mode]
    stream_ids: list[str] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        if not stream_ids:
            stream_ids.append(stream_id(batch.sparkSession, checkpoint))
        name = stream_ids[0]
        if done is not None:
            batch = batch.join(done.select(*keys), keys, "left_anti").select(*batch.columns)
        if succeeded is None:
            store(batch, path, name, batch_id, keys, order)
            return
        # Both sinks read the batch; it is parsed once.
        batch.persist()
        try:
            passed, failed = dead_letter(batch, succeeded)
            store_ignore(failed.select(*keys), failed_path, name, batch_id, keys, keys)
            store(passed, path, name, batch_id, keys, order)
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
