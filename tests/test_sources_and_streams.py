"""Landed JSON, text sources, and restartable ingest."""

import json
import os

import pytest

from pyspark.sql import functions as F, types as T

from corpuscope import schemas
from corpuscope.operators import joins, mutation
from corpuscope.plans import coverage
from corpuscope.sources import payloads, tables
from corpuscope.streaming import ingest


def raw(spark, *payload):
    return spark.createDataFrame([(json.dumps(p),) for p in payload], "json string")


def test_stats_defaults(spark):
    got = payloads.flatten_stats(raw(spark, {"items": [
        {"id": "v1", "snippet": {"tags": ["a", "b"]}, "statistics": {"viewCount": "7"},
         "paidProductPlacementDetails": {"hasPaidProductPlacement": True}},
        {"id": "v2"}]})).collect()
    assert (got[0].tags, got[0].view_count, got[0].like_count, got[0].paid_product_placement) == ("a, b", "7", "N/A", "true")
    assert (got[1].tags, got[1].duration, got[1].definition) == ("N/A", "PT0S", "N/A")


def test_search_and_stats_join(spark):
    found = payloads.flatten_search(raw(spark, {"items": [
        {"id": {"videoId": v}, "snippet": {"title": v.upper(), "channelTitle": "c", "publishedAt": "2024-01-01T00:00:00Z"}}
        for v in ("v1", "v2")]}))
    stats = payloads.flatten_stats(raw(spark, {"items": [{"id": "v1"}]}))
    got = {r.video_id: r.duration for r in joins.search_stats_join(found, stats).collect()}
    assert got == {"v1": "PT0S", "v2": None}


def test_threads_and_replies(spark):
    comment = lambda t: {"snippet": {"textDisplay": t, "likeCount": 1}}
    thread = lambda i, replies: {"id": i, "snippet": {"videoId": "v", "topLevelComment": comment(f"top {i}"), "totalReplyCount": len(replies)},
                                 **({"replies": {"comments": [{"id": f"{i}.{n}", **comment(r)} for n, r in enumerate(replies)]}} if replies else {})}
    landed = raw(spark, {"items": [thread("t1", ["x", "y"]), thread("t2", [])]}, {"items": [thread("t1", ["x"])]})
    assert payloads.flatten_threads(landed).count() == 3
    replies = payloads.flatten_replies(landed).withColumn("seq", F.monotonically_increasing_id())
    latest = mutation.keep_last(replies, "reply_id", ["seq"])
    assert sorted(r.reply_id for r in latest.collect()) == ["t1.0", "t1.1"]


def test_channel_defaults(spark):
    got = payloads.flatten_channel(raw(spark, {"items": [{"id": "c", "snippet": {"title": "T"}}]})).head()
    assert (got.title, got.description, got.view_count, got.country) == ("T", "", 0, None)


def test_taxonomy(spark):
    terms = payloads.taxonomy_from_text(spark, "  A & B: 'x', 'y z'\n\nBroken line\nC (D): 'x'")
    assert sorted(map(tuple, terms.collect())) == [("A & B", "x"), ("A & B", "y z"), ("C (D)", "x")]
    assert terms.select("term").distinct().count() == 2


def test_text_sources(spark, tmp_path):
    (tmp_path / "items.jsonl").write_text("\n".join(json.dumps(x) for x in [
        {"video_id": "1", "matching_categories": ["A", "A", "Z"]}, {"video_id": "2", "matching_categories": []},
        {"video_id": "3"}, {"video_id": "4", "matching_categories": ["Z"]}]))
    items = tables.read_jsonl(spark, str(tmp_path / "items.jsonl"))
    counts = coverage.coverage_counts(items, ["A", "B"]).head()
    assert (counts.total, counts.no_category, counts.only_invalid) == (4, 2, 1)
    taxonomy = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x")], "category string, term string")
    assert [tuple(r) for r in coverage.category_frequency(items, taxonomy).collect()] == [("A", 2)]
    assert [tuple(r) for r in coverage.missing_categories(items, taxonomy).collect()] == [("B",)]
    (tmp_path / "keywords.json").write_text('["SQL",\n "data mining"]')
    assert [r.keyword for r in tables.read_keywords(spark, str(tmp_path / "keywords.json")).collect()] == ["SQL", "data mining"]
    (tmp_path / "ids.txt").write_text("a\r\n\nb\n")
    assert [r.video_id for r in tables.read_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]


def test_split_dataset_prunes(spark, tmp_path):
    df = spark.range(10).select("id", F.when(F.col("id") < 4, "val").otherwise("test").alias("split"))
    tables.write_split(df, str(tmp_path / "s"))
    part = tables.read_split(spark, str(tmp_path / "s"), "val")
    assert part.count() == 4
    assert "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().executedPlan().toString()


SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType()), T.StructField("seq", T.LongType())])


def land(folder, name, records):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as out:
        out.write("\n".join(json.dumps(dict(zip("kvs", r)) | {"seq": r[2]}) for r in records))


def read(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_ingest_resumes_and_never_doubles(spark, tmp_path):
    landed = str(tmp_path / "landed")
    first, second = [("a", 1, 1), ("b", 2, 2), ("a", 3, 3)], [("b", 9, 4), ("c", 5, 5)]
    for mode, after_one, after_two in (
        ("ignore", [("a", 1), ("b", 2)], [("a", 1), ("b", 2), ("c", 5)]),
        ("replace", [("a", 3), ("b", 2)], [("a", 3), ("b", 9), ("c", 5)]),
    ):
        folder, table, memory = f"{landed}-{mode}", str(tmp_path / f"t-{mode}"), str(tmp_path / f"c-{mode}")
        reader = (lambda: ingest.read_ignore(spark, table, SCHEMA)) if mode == "ignore" else (
            lambda: ingest.read_replace(spark, table, SCHEMA, "k"))
        run = lambda: ingest.stream_ingest(ingest.open_stream(spark, folder, SCHEMA), table, memory, "k", ["seq"], mode)
        land(folder, "one", first)
        run()
        assert read(reader()) == after_one
        run()
        assert read(reader()) == after_one
        land(folder, "two", second)
        run()
        assert read(reader()) == after_two
        # A batch replayed after a crash overwrites its own folder.
        batch = spark.createDataFrame(second, SCHEMA)
        own = ingest.stream_id(spark, memory)
        {"ignore": ingest.store_ignore, "replace": ingest.store_replace}[mode](batch, table, own, 1, "k", ["seq"])
        assert read(reader()) == after_two
    compacted = ingest.compact(spark, table, str(tmp_path / "compact"), SCHEMA, "k")
    assert read(compacted) == after_two


def test_other_streams_lost_checkpoints_and_compaction_lose_nothing(spark, tmp_path):
    path = lambda name: str(tmp_path / name)
    run = lambda folder, memory, table, mode: ingest.stream_ingest(
        ingest.open_stream(spark, path(folder), SCHEMA), path(table), path(memory), "k", ["seq"], mode)
    land(path("one"), "x", [("a", 1, 1), ("b", 2, 2)])
    land(path("two"), "x", [("c", 3, 3), ("b", 7, 4)])
    for mode, after, again in (
        ("ignore", [("a", 1), ("b", 2), ("c", 3)], [("a", 1), ("b", 2), ("c", 3)]),
        ("replace", [("a", 1), ("b", 7), ("c", 3)], [("a", 1), ("b", 2), ("c", 3)]),
    ):
        reader = lambda table: read(
            ingest.read_ignore(spark, path(table), SCHEMA) if mode == "ignore" else ingest.read_replace(spark, path(table), SCHEMA, "k"))
        run("one", f"c1-{mode}", mode, mode)
        run("two", f"c2-{mode}", mode, mode)
        assert reader(mode) == after
        run("one", f"c3-{mode}", mode, mode)  # the checkpoint was lost: all is read again
        assert reader(mode) == again
        ingest.compact(spark, path(mode), path(f"{mode}-compact"), SCHEMA, "k")
        run("two", f"c4-{mode}", f"{mode}-compact", mode)  # a new checkpoint begins at batch 0
        assert reader(f"{mode}-compact") == after


def test_dead_letters_and_done(spark, tmp_path):
    folder = str(tmp_path / "landed")
    land(folder, "one", [("a", 1, 1), ("b", None, 2), ("c", 3, 3)])
    done = spark.createDataFrame([("c",)], "k string")
    ingest.stream_ingest(
        ingest.open_stream(spark, folder, SCHEMA), str(tmp_path / "ok"), str(tmp_path / "cp"), "k", ["seq"],
        failed_path=str(tmp_path / "bad"), succeeded=F.col("v").isNotNull(), done=done)
    assert read(ingest.read_ignore(spark, str(tmp_path / "ok"), SCHEMA)) == [("a", 1)]
    assert [r.k for r in ingest.read_ignore(spark, str(tmp_path / "bad"), SCHEMA.__class__([SCHEMA["k"]])).collect()] == ["b"]


def test_conform(spark):
    got = schemas.conform(spark.createDataFrame([("c", "12")], "channel_id string, view_count string"), schemas.CHANNELS)
    assert got.columns == schemas.CHANNELS.names and got.head().view_count == 12


def test_label_alignment_prefers_training(spark):
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("z", [3.0])], "video_id string, embedding array<double>")
    train = spark.createDataFrame([("a", 1), ("q", 1)], "video_id string, y int")
    held = spark.createDataFrame([("a", 0), ("b", 0)], "video_id string, y int")
    got = {r.video_id: (r.y, r.split) for r in joins.align_labels(vectors, train, held, "video_id", "y").collect()}
    assert got == {"a": (1, "train"), "b": (0, "heldout")}


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/bucketed'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("left", "right"):
            tables.write_bucketed(spark.range(100), f"bucketed.{name}_side", "id", 4)
        joined = spark.table("bucketed.left_side").join(spark.table("bucketed.right_side"), "id")
        assert joined.count() == 100
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE bucketed CASCADE")


def keyed(spark, first, last, seq=0):
    return spark.createDataFrame([(f"k{i}", i, seq) for i in range(first, last)], SCHEMA)


def test_a_batch_reads_only_its_slots(spark, tmp_path):
    path = str(tmp_path / "log")
    ingest.slots_of(spark, path, 64)
    for n in range(3):
        ingest.store_ignore(keyed(spark, n * 300, n * 300 + 400), path, "s", n, "k", ["seq"])
    assert ingest.read_ignore(spark, path, SCHEMA).count() == 1000
    batch = keyed(spark, 5, 8)
    touched = {r[0] for r in batch.select(ingest.slot(["k"], 64)).distinct().collect()}
    index = ingest.stored_keys(batch, path, "k")
    assert {int(f.split("slot=")[1].split("/")[0]) for f in index.inputFiles()} == touched and len(touched) <= 3
    plan = index.select("k")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:string>" in plan
    # A small batch writes its own slots alone.
    ingest.store_ignore(keyed(spark, 5000, 5002), path, "s", 3, "k", ["seq"])
    written = [f for f in ingest.read_ignore(spark, path, SCHEMA).inputFiles() if "batch_id=3" in f]
    assert 1 <= len(written) <= 2


def test_cost_of_a_batch_does_not_follow_the_other_slots(spark, tmp_path):
    """After many batches a batch of a hundredth of the keys lists and reads no more than the files of its slots."""
    path, slots = str(tmp_path / "log"), 200
    ingest.slots_of(spark, path, slots)
    everything = keyed(spark, 0, 4000).withColumn("place", ingest.slot(["k"], slots)).persist()
    part = lambda n: everything.where(F.col("place") % 100 == n).drop("place")
    read_before = None
    for n in range(0, 100, 4):
        ingest.store_ignore(part(n), path, "s", n, "k", ["seq"])
        if n == 0:
            read_before = (ingest.stored_keys(part(0), path, "k").count(), len(ingest.stored_keys(part(0), path, "k").inputFiles()))
    index = ingest.stored_keys(part(0), path, "k")
    assert (index.count(), len(index.inputFiles())) == read_before
    assert index.count() < 0.1 * ingest.read_ignore(spark, path, SCHEMA).count()


def test_slots_stay_as_they_were_when_the_table_began(spark, tmp_path):
    path = str(tmp_path / "log")
    assert ingest.slots_of(spark, path, 8) == 8 and ingest.slots_of(spark, path, 64) == 8
    ingest.store_ignore(keyed(spark, 0, 20), path, "s", 0, "k", ["seq"])
    ingest.store_ignore(keyed(spark, 10, 30), path, "t", 0, "k", ["seq"])
    assert ingest.read_ignore(spark, path, SCHEMA).count() == 30


def test_a_failed_batch_keeps_no_blocks(spark, tmp_path):
    folder = str(tmp_path / "landed")
    land(folder, "one", [("a", 1, 1)])
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    stream = ingest.open_stream(spark, folder, SCHEMA)
    with pytest.raises(Exception):
        ingest.stream_ingest(stream, str(tmp_path / "ok"), str(tmp_path / "cp"), "k", ["absent"],
                             failed_path=str(tmp_path / "bad"), succeeded=F.lit(True))
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == held
