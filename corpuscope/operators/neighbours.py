"""Exact nearest neighbours, label centroids and minority over-sampling.

The kNN join is the published pivot-based scheme: points are assigned to the
nearest of a few pivots, the triangle inequality rules out cells that cannot hold
a neighbour, and the remaining work is blocked. Every block has a bounded number
of rows on both sides, also when one cell holds most of the points, and a block
returns only its k best per query. The result is exact for any pivots.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscope.functions.hashing import hash_uniform
from corpuscope.operators.joins import weighted_lookup_join
from corpuscope.operators.ordered import positions
from corpuscope.session import materialise

MAX_PIVOTS = 512
BLOCK_BYTES = 64 << 20  # vectors held by one side of a block
TILE_CELLS = 4_000_000  # distances held at a time inside a block
ROUTED_ROWS = 20_000  # copies of queries held at a time on their way to the blocks


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit_vector(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: x.cast("double") / length)


def label_centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean vector per label, combined on the map side."""
    v = array_to_vector(F.col(vector).cast("array<double>"))
    return df.groupBy(label).agg(vector_to_array(Summarizer.mean(v)).alias("centroid"))


def centroid_similarity(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Cosine similarity of each row to the centroid of its own label; NULL for rows without label."""
    labelled = df.where(F.col(label).isNotNull())
    centroids = materialise(label_centroids(labelled, vector, label).join(
        labelled.groupBy(label).agg(F.count(F.lit(1)).alias("_members")), label), "centroids")
    return weighted_lookup_join(df.select(key, label, vector), centroids, label, "_members", "left").select(
        key, label, cosine(F.col(vector), F.col("centroid")).alias("similarity"))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype="float64") for v in column])


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    """The vectors of column v without a Python object for each; the chunks are copied into place one by one."""
    out, start = np.empty((len(table), width)), 0
    for chunk in table.column("v").chunks:
        out[start:start + len(chunk)] = chunk.flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), width)
        start += len(chunk)
    return out


def _squared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by expansion, and a safe bound of their rounding error."""
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    square = aa[:, None] + bb[None, :] - 2.0 * (a @ b.T)
    return np.maximum(square, 0.0), 1e-12 * (aa.max() + bb.max())


def _distances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    square, error = _squared(a, b)
    return np.sqrt(square), error ** 0.5


def knn_join(df: DataFrame, key: str, vector: str, k: int, block_rows: int | None = None,
             max_pivots: int = MAX_PIVOTS, seed: int = 42) -> DataFrame:
    """The k nearest other rows of each row by Euclidean distance: (key, neighbour, distance, rank).

    Exact; ties go to the smaller key. ``key`` must be unique. There are no more cells
    than blocks: smaller cells would only multiply the copies of the queries.
    """
    points = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    id_type = points.schema["id"].dataType.simpleString()
    sizes_row = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).head()
    n, width = sizes_row["n"], sizes_row["width"] or 1
    if n < 2:
        return df.sparkSession.createDataFrame(
            [], f"{key} {id_type}, neighbour {id_type}, distance double, rank int")
    block_rows = block_rows or max(256, BLOCK_BYTES // (8 * width))
    pivot_count = max(1, min(max_pivots, n // block_rows))
    drawn = points.orderBy(hash_uniform(F.col("id"), seed=seed), "id").limit(pivot_count)
    pivots = np.array([row.v for row in drawn.select("v").collect()], dtype="float64")

    def assign(batches):
        for batch in batches:
            if len(batch):
                d, _ = _distances(_stack(batch["v"]), pivots)
                cell = d.argmin(1)
                yield batch.assign(cell=cell.astype("int32"), to_pivot=d[np.arange(len(cell)), cell])

    assigned = materialise(
        points.mapInPandas(assign, f"id {id_type}, v array<double>, cell int, to_pivot double"), "knn-cells")
    cells = assigned.groupBy("cell").agg(
        F.count(F.lit(1)).alias("size"), F.max("to_pivot").alias("radius")).orderBy("cell").collect()
    cell_ids = np.array([c["cell"] for c in cells])
    sizes = np.array([c["size"] for c in cells])
    radii = np.array([c["radius"] for c in cells])
    chunks = np.ceil(sizes / block_rows).astype(int)
    # Distances to pivots carry rounding errors up to this, relative to the largest vector.
    far_error = 1e-6 * float(np.sqrt((pivots ** 2).sum(1).max())) + 1e-6 * float(radii.max())

    def route(batches):
        """Each query goes to the chunks of the cells that may hold one of its neighbours."""
        for batch in batches:
            if not len(batch):
                continue
            d, error = _distances(_stack(batch["v"]), pivots[cell_ids])
            slack = 4 * max(error, far_error)
            far = d + radii
            order = np.argsort(far, axis=1)
            enough = (np.cumsum(sizes[order], axis=1) >= k + 1).argmax(1)
            bound = np.take_along_axis(far, np.take_along_axis(order, enough[:, None], 1), 1)
            complete = sizes.sum() >= k + 1
            rows, columns = np.nonzero((d - radii <= bound + slack) | (not complete))
            repeat = chunks[columns]
            rows, columns = np.repeat(rows, repeat), np.repeat(columns, repeat)
            first = np.concatenate([[0], np.cumsum(repeat)[:-1]])
            chunk = np.arange(len(rows)) - np.repeat(first, repeat)
            for start in range(0, len(rows), ROUTED_ROWS):
                part = slice(start, start + ROUTED_ROWS)
                yield pd.DataFrame({
                    "id": batch["id"].to_numpy()[rows[part]], "v": batch["v"].to_numpy()[rows[part]],
                    "cell": cell_ids[columns[part]].astype("int32"), "chunk": chunk[part].astype("int32"),
                })

    # A cell's queries are cut into blocks by hash, its points into chunks: both sides stay bounded.
    routed = assigned.select("id", "v").mapInPandas(route, f"id {id_type}, v array<double>, cell int, chunk int")
    slots = assigned.sparkSession.sparkContext.defaultParallelism
    blocks_for_slots = math.ceil(slots / max(1, int(chunks.sum())))
    # A chunk is repeated for the queries that were counted for it, one copy for each block of them.
    blocks = materialise(routed.groupBy("cell", "chunk").agg(
        F.greatest(F.lit(blocks_for_slots), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int").alias("blocks")), "knn-blocks")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
    queries = routed.join(blocks, ["cell", "chunk"]).withColumn("block", block).drop("blocks")
    chunk_count = F.element_at(
        F.create_map(*[F.lit(int(x)) for pair in zip(cell_ids, chunks) for x in pair]), F.col("cell"))
    corpus = assigned.select(
        "id", "v", "cell", F.pmod(F.xxhash64("id", F.lit(2)), chunk_count).cast("int").alias("chunk"),
    ).join(blocks, ["cell", "chunk"]).select(
        "id", "v", "cell", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        qid, cid = q.column("id").to_pandas().to_numpy(), c.column("id").to_pandas().to_numpy()
        parts = [pd.DataFrame({"id": qid[:0], "neighbour": cid[:0], "distance": np.empty(0)})]
        if len(q) and len(c):
            cv, last = _matrix(c, pivots.shape[1]), min(k, len(cid)) - 1
            tile = max(1, TILE_CELLS // len(cid))
            for start in range(0, len(q), tile):
                qv, ids = _matrix(q.slice(start, tile), pivots.shape[1]), qid[start:start + tile]
                rough, error = _squared(qv, cv)
                rough[ids[:, None] == cid[None, :]] = np.inf
                kth = np.partition(rough, last, axis=1)[:, last]
                # Distances by expansion are inexact: keep near ties, measure again, then cut at k.
                rows, columns = np.nonzero((rough <= kth[:, None] + 2 * error) & np.isfinite(rough))
                exact = np.sqrt(((qv[rows] - cv[columns]) ** 2).sum(1))
                found = pd.DataFrame({"id": ids[rows], "neighbour": cid[columns], "distance": exact})
                found = found.sort_values(["id", "distance", "neighbour"], kind="stable")
                parts.append(found[found.groupby("id").cumcount() < k])
        types = {"id": q.schema.field("id").type, "neighbour": c.schema.field("id").type, "distance": pa.float64()}
        return pa.Table.from_pandas(pd.concat(parts), schema=pa.schema(list(types.items())), preserve_index=False)

    partial = queries.select("id", "v", "cell", "chunk", "block").groupBy("cell", "chunk", "block").cogroup(
        corpus.groupBy("cell", "chunk", "block")).applyInArrow(best, f"id {id_type}, neighbour {id_type}, distance double")
    # Each block gave at most k rows per query; the row_number filter prunes again before the shuffle.
    nearest = Window.partitionBy("id").orderBy("distance", "neighbour")
    ranked = partial.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.withColumnRenamed("id", key)


def cosine_neighbours(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k most cosine-similar other rows: (key, neighbour, similarity, rank).

    On unit vectors the Euclidean order is the cosine order.
    """
    directed = df.where(norm(F.col(vector)) > 0)  # a zero vector has no direction
    units = directed.select(key, unit_vector(F.col(vector)).alias("_u"))
    found = knn_join(units, key, "_u", k)
    return found.select(key, "neighbour", (1 - F.pow("distance", F.lit(2)) / 2).alias("similarity"), "rank")


def smote_balance(df: DataFrame, key: str, vector: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add synthetic rows until every class is as large as the largest: (key, vector, label, synthetic).

    A synthetic row lies between a row and one of its k nearest neighbours of the same
    class. Which rows are used how often follows from seeded draws on their ids.
    """
    rows = df.select(F.col(key).cast("string").alias(key), F.col(vector).cast("array<double>").alias(vector), label,
                     F.lit(False).alias("synthetic"))
    rows = materialise(rows, "smote-rows")
    sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    largest = max(sizes.values())
    balanced = rows
    for value, size in sorted(sizes.items()):
        need = largest - size
        if not need:
            continue
        if size < 2:
            raise ValueError(f"class {value} needs at least two rows")
        members = rows.where(F.col(label) == value)
        neighbours = knn_join(members, key, vector, min(k, size - 1), seed=seed)
        listed = neighbours.groupBy(key).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda s: s["neighbour"]).alias("_near"))
        drawn = positions(members.select(key, hash_uniform(F.col(key), F.lit("order"), seed=seed).alias("_u")), "_u", [key])
        copies = F.lit(need // size) + F.when(F.col("position") < need % size, 1).otherwise(0)
        bases = drawn.withColumn("_copies", copies).where("_copies > 0").select(
            key, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
        pick = F.floor(hash_uniform(F.col(key), F.col("_copy"), F.lit("pick"), seed=seed) * F.size("_near")).cast("int")
        chosen = bases.join(listed, key).select(
            key, "_copy", F.get("_near", pick).alias("_other"),
            hash_uniform(F.col(key), F.col("_copy"), F.lit("gap"), seed=seed).alias("_gap"))
        base = members.select(key, F.col(vector).alias("_a"))
        other = members.select(F.col(key).alias("_other"), F.col(vector).alias("_b"))
        made = chosen.join(base, key).join(other, "_other").select(
            F.concat_ws("#", F.col(key), F.col("_copy").cast("string")).alias(key),
            F.zip_with("_a", "_b", lambda a, b: a + F.col("_gap") * (b - a)).alias(vector),
            F.lit(value).alias(label), F.lit(True).alias("synthetic"),
        )
        balanced = balanced.unionByName(made)
    return balanced
