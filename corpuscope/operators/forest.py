"""Forests that do not fit on the driver: trees fitted, kept and asked a few at a time."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscope.session import materialise, scratch_path

NODES_AT_ONCE = 1_000_000  # of trees that are on the driver together; it grew by 150 bytes a node once fitted, more before
NODES_PER_ROW = 1.3  # at most: a tree to purity has two nodes for each of its rows, and draws 63 % of them
FOREST = "org.apache.spark.ml.classification.RandomForestClassificationModel"


def trees_at_once(rows: int, trees: int) -> int:
    return max(1, min(trees, int(NODES_AT_ONCE / max(1.0, NODES_PER_ROW * rows))))


class PartedForest(Transformer):
    """A forest as several saved forests of fewer trees (``parts``), one of them on the driver at a time.

    Adds the columns that Spark's own model adds: votes are added up over the parts, in their order.
    """

    def __init__(self, parts: Sequence[str], features: str, output: Sequence[str] = ("rawPrediction", "probability", "prediction")):
        super().__init__()
        self.parts, self.features, self.output = list(parts), features, list(output)

    def first(self) -> RandomForestClassificationModel:
        return RandomForestClassificationModel.load(self.parts[0])

    def _transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "asked")
        path = scratch_path(spark, "votes")
        for number, part in enumerate(self.parts):
            model = RandomForestClassificationModel.load(part)
            votes = model.transform(rows.select("_row", self.features)).select(
                "_row", F.lit(number).alias("part"), vector_to_array(model.getRawPredictionCol()).alias("votes"))
            votes.write.mode("append").parquet(path)
            del model, votes
        votes = spark.read.schema("_row long, part int, votes array<double>").parquet(path)
        each = F.array_sort(F.collect_list(F.struct("part", "votes")))  # sums in one order, so that they repeat
        total = votes.groupBy("_row").agg(each.alias("each")).select("_row", F.aggregate(
            F.slice("each", 2, len(self.parts)), F.element_at("each", 1)["votes"],
            lambda held, next: F.zip_with(held, next["votes"], lambda a, b: a + b)).alias("_votes"))
        whole = F.aggregate("_votes", F.lit(0.0), lambda held, x: held + x)
        raw, probability, prediction = self.output
        return rows.join(total, "_row").withColumns({
            raw: array_to_vector("_votes"), probability: array_to_vector(F.transform("_votes", lambda x: x / whole)),
            prediction: (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double"),
        }).drop("_row", "_votes")

    def write_whole(self, spark: SparkSession, path: str) -> None:
        """Makes the first part, saved at ``path``, the whole forest in Spark's own form: no tree comes to the driver."""
        described, trees, nodes, count = _metadata(spark, path), [], [], 0
        for part in self.parts:
            nodes.append(spark.read.parquet(f"{part}/data").withColumn("treeID", F.col("treeID") + count))
            trees.append(spark.read.parquet(f"{part}/treesMetadata").withColumn("_1", F.col("_1") + count))
            count += _metadata(spark, part)["numTrees"]
        for name, tables in (("data", nodes), ("treesMetadata", trees)):
            for i, table in enumerate(tables):
                table.write.mode("append" if i else "overwrite").parquet(f"{path}/{name}")
        _write_metadata(spark, path, described, count)


def fit_parts(spark: SparkSession, trees: int, at_once: int, fit: Callable) -> list[str]:
    """Folders of the forests that ``fit`` gives for a number of trees and the number of those before."""
    parts = []
    for before in range(0, trees, at_once):
        parts.append(scratch_path(spark, "trees"))
        fit(min(at_once, trees - before), before).write().overwrite().save(parts[-1])
    return parts


def _metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata").first().value)


def _write_metadata(spark: SparkSession, path: str, described: dict, trees: int) -> None:
    described = described | {"numTrees": trees, "paramMap": described["paramMap"] | {"numTrees": trees}}
    spark.createDataFrame([(json.dumps(described),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def _split(spark: SparkSession, path: str) -> list[str]:
    """Folders of the forest at ``path`` in parts of at most ``NODES_AT_ONCE`` nodes, or of one tree."""
    sizes = spark.read.parquet(f"{path}/data").groupBy("treeID").count().orderBy("treeID").collect()  # a row per tree
    groups: list[list[int]] = []
    held = 0
    for tree, n in sizes:
        if not groups or held + n > NODES_AT_ONCE:
            groups.append([])
            held = 0
        groups[-1].append(tree)
        held += n
    if len(groups) < 2:
        return [path]
    parts = []
    for group in groups:
        parts.append(scratch_path(spark, "trees"))
        for name, tree in (("data", "treeID"), ("treesMetadata", "_1")):
            table = spark.read.parquet(f"{path}/{name}").where(F.col(tree).between(group[0], group[-1]))
            table.withColumn(tree, F.col(tree) - group[0]).write.parquet(f"{parts[-1]}/{name}")
        _write_metadata(spark, parts[-1], _metadata(spark, path), len(group))
    return parts


def _stage_path(path: str, number: int, uid: str, stages: int) -> str:
    return f"{path}/stages/{number:0{len(str(stages))}d}_{uid}"


def save_stages(model: PipelineModel, path: str) -> None:
    """A pipeline in Spark's own form, whatever the size of its forests."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    plain = [s.first() if isinstance(s, PartedForest) else s for s in model.stages]
    PipelineModel(plain).write().overwrite().save(path)
    for i, stage in enumerate(model.stages):
        if isinstance(stage, PartedForest):
            stage.write_whole(spark, _stage_path(path, i, plain[i].uid, len(plain)))


def load_stages(path: str) -> list[Transformer]:
    """Stages of a saved pipeline; a forest too large for the driver comes in parts."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    uids = _metadata(spark, path)["paramMap"]["stageUids"]
    parted = {}
    for i, uid in enumerate(uids):
        at = _stage_path(path, i, uid, len(uids))
        described = _metadata(spark, at)
        if described["class"] == FOREST and len(parts := _split(spark, at)) > 1:
            named = described["defaultParamMap"] | described["paramMap"]
            parted[i] = PartedForest(
                parts, named["featuresCol"], [named[f"{c}Col"] for c in ("rawPrediction", "probability", "prediction")])
    if not parted:
        return PipelineModel.load(path).stages
    return [
        parted[i] if i in parted else DefaultParamsReader.loadParamsInstance(_stage_path(path, i, uid, len(uids)), spark)
        for i, uid in enumerate(uids)
    ]
