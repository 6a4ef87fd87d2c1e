"""Gradient boosting of binary trees from sums over binned rows, which arrays or a table give, evaluated in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BINS = 32
SCALE = 1 << 20  # slopes and curvatures are summed as whole multiples of 1 / SCALE: no order of rows changes a sum
ROWS = 200_000  # binned rows of a partition


@dataclass
class Tree:
    """Nodes in arrays; ``feature`` is -1 at a leaf."""

    feature: list[int] = field(default_factory=list)
    bound: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, entry in zip((self.feature, self.bound, self.left, self.right, self.value), (-1, 0.0, -1, -1, value)):
            column.append(entry)
        return len(self.value) - 1

    def leaf(self, x: np.ndarray) -> np.ndarray:
        feature, bound = np.array(self.feature), np.array(self.bound)
        left, right = np.array(self.left), np.array(self.right)
        node = np.zeros(len(x), int)
        while (inner := np.flatnonzero(feature[node] >= 0)).size:
            at = node[inner]
            node[inner] = np.where(x[inner, feature[at]] <= bound[at], left[at], right[at])
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf(x)]


@dataclass
class Boosted:
    start: float
    rate: float
    trees: list[Tree]

    def score(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for tree in self.trees:
            score += self.rate * tree.predict(x)
        return score

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.score(x), -30, 30)))


def boosted(model: tuple) -> Boosted:
    """The model of its ``astuple``."""
    start, rate, trees = model
    return Boosted(start, rate, [Tree(*tree) for tree in trees])


# Of a model over bins, a tree and some of its leaves: the slopes, curvatures and rows of each leaf, feature and bin.
Sums = Callable[[Boosted, Tree, list[int]], np.ndarray]


def leaf_sums(
    model: Boosted, tree: Tree, leaves: list[int], binned: np.ndarray, y: np.ndarray, n: np.ndarray, size: int
) -> np.ndarray:
    """The sums of some rows, each ``n`` times, as whole numbers: leaf, feature, bin, then slope, curvature and rows."""
    slots = np.full(len(tree.value), -1)
    slots[leaves] = np.arange(len(leaves))
    slot = slots[tree.leaf(binned)]
    inside = slot >= 0
    binned, slot, n = binned[inside], slot[inside], n[inside]
    p = 1 / (1 + np.exp(-model.score(binned)))
    features = binned.shape[1]
    cell = ((slot[:, None] * features + np.arange(features)) * size + binned).ravel()
    found = [
        np.bincount(cell, np.repeat(weight, features), len(leaves) * features * size)
        for weight in (np.rint((y[inside] - p) * n * SCALE), np.rint(p * (1 - p) * n * SCALE), n)
    ]
    return np.stack(found, axis=-1).astype(np.int64).reshape(len(leaves), features, size, 3)


def boost(
    cuts: list[np.ndarray], rows: int, right: int, sums: Sums, trees: int = 40, depth: int = 4, rate: float = 0.2,
    least_rows: int = 5,
) -> tuple[Boosted, Boosted]:
    """Logistic loss, Newton leaf values; one pass of ``sums`` a level. The model over values, and that over bins."""
    share = np.clip(right / rows, 1e-3, 1 - 1e-3) if rows else 0.5
    start = float(np.log(share / (1 - share)))
    model, coarse = Boosted(start, rate, []), Boosted(start, rate, [])
    if right in (0, rows):
        return model, coarse
    for _ in range(trees):
        tree = Tree()
        leaves = [tree.add(0.0)]
        for level in range(depth):
            table = sums(coarse, tree, leaves) if leaves else []
            grown = []
            for leaf, cells in zip(leaves, table):
                g, h, n = cells[0].sum(0) / (SCALE, SCALE, 1) + (0, 1, 0)
                if level == 0:
                    tree.value[leaf] = float(g / h)
                if n < 2 * least_rows:
                    continue
                gl, hl, nl = np.moveaxis(cells.cumsum(1)[:, :-1] / (SCALE, SCALE, 1), -1, 0)
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl) - g**2 / h
                gain[(nl < least_rows) | (n - nl < least_rows)] = 0
                f, k = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, k] > 1e-6:
                    tree.feature[leaf], tree.bound[leaf] = int(f), float(k)
                    tree.left[leaf] = tree.add(float(gl[f, k] / (hl[f, k] + 1)))
                    tree.right[leaf] = tree.add(float((g - gl[f, k]) / (h - hl[f, k])))
                    grown += [tree.left[leaf], tree.right[leaf]]
            leaves = grown
        coarse.trees.append(tree)
        bounds = [float(cuts[f][int(k)]) if f >= 0 else 0.0 for f, k in zip(tree.feature, tree.bound)]
        model.trees.append(Tree(tree.feature, bounds, tree.left, tree.right, tree.value))
    return model, coarse


def fit_boosted(x: np.ndarray, y: np.ndarray, **limits: float) -> Boosted:
    """Trees of a few rows in arrays; cuts at quantiles of each feature."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.empty(0) for column in x.T]
    binned = np.column_stack([np.searchsorted(cut, column) for cut, column in zip(cuts, x.T)])
    size, once = 1 + max(map(len, cuts)), np.ones(len(y))
    return boost(
        cuts, len(y), int(y.sum()), lambda model, tree, leaves: leaf_sums(model, tree, leaves, binned, y, once, size), **limits
    )[0]


def table_cuts(rows: DataFrame, groups: Column) -> list[np.ndarray]:
    """Cuts of each feature of ``rows`` (x, an array, and n, how often it occurs), from all of them.

    Each of the ``groups`` has its own, so that a rare one does not fall into one bin: all its values if there are few,
    else its quantiles, and the least and the greatest value. One task takes a feature's distinct values of one group,
    which the features must bound.
    """
    values = rows.select(groups.alias("g"), "n", F.posexplode("x").alias("f", "v")).groupBy("g", "f", "v").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("g", "f")
    upto = F.sum("n").over(whole.orderBy("v"))
    points = lambda seen: F.floor(seen * BINS / F.col("total"))
    ranked = values.select("f", "v", "n", upto.alias("upto"), F.sum("n").over(whole).alias("total"), F.count("v").over(whole).alias("kinds"))
    # The last value of a group holds its last point.
    kept = (F.col("kinds") <= BINS) | (points(F.col("upto")) > points(F.col("upto") - F.col("n"))) | (F.col("upto") == F.col("n"))
    found: dict[int, set[float]] = {}
    for row in ranked.where(kept).select("f", "v").distinct().collect():
        found.setdefault(row.f, set()).add(float(row.v))
    return [np.array(sorted(found[f])) for f in sorted(found)]


def matrix(column: pa.Array, features: int) -> np.ndarray:
    """The rows of a column of byte strings, one byte a bin."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), features).astype(int)


def binned_table(rows: DataFrame, cuts: list[np.ndarray], keys: list[str]) -> DataFrame:
    """Rows (``keys``, y, x, n) with x as a byte a feature; those that are equal then are one, with the sum of n."""
    plain = [cut.tolist() for cut in cuts]

    def coarsen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            binned = np.zeros((batch.num_rows, len(plain)), np.uint8)
            for f, column in enumerate(np.array(batch.column("x").to_pylist()).T if plain else []):
                binned[:, f] = np.searchsorted(plain[f], column)
            at = batch.schema.get_field_index("x")
            yield batch.set_column(at, "x", pa.array([row.tobytes() for row in binned], pa.binary()))

    names = [*keys, "y", "x"]
    rows = rows.select(*names, "n")
    types = ", ".join(f"{f.name} {'binary' if f.name == 'x' else f.dataType.simpleString()}" for f in rows.schema)
    # Each level of each tree reads the table, so it has no more parts than its rows need.
    return rows.mapInArrow(coarsen, types).groupBy(*names).agg(F.sum("n").alias("n")).coalesce(1 + rows.count() // ROWS)


def fit_boosted_table(rows: DataFrame, cuts: list[np.ndarray], **limits: float) -> tuple[Boosted, Boosted]:
    """Trees of all rows of a binned table (y, x, n), as ``boost`` gives them; the driver gets a level's sums alone."""
    features, size = len(cuts), 1 + max(map(len, cuts), default=0)
    cell = pa.schema([(name, pa.int32()) for name in ("leaf", "f", "bin")] + [(name, pa.int64()) for name in ("g", "h", "n")])
    slim = rows.select("y", "x", "n")
    several = slim.rdd.getNumPartitions() > 1

    def sums(model: Boosted, tree: Tree, leaves: list[int]) -> np.ndarray:
        plain, nodes = astuple(model), astuple(tree)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(leaves), features, size, 3), np.int64)
            for batch in batches:
                y, n = (batch.column(name).to_numpy() for name in ("y", "n"))
                total += leaf_sums(boosted(plain), Tree(*nodes), leaves, matrix(batch.column("x"), features), y, n, size)
            at = np.nonzero(total[..., 2])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(a, pa.int32()) for a in at), *(pa.array(v, pa.int64()) for v in total[at].T)], schema=cell)

        found = slim.mapInArrow(add, "leaf int, f int, bin int, g long, h long, n long")
        if several:  # sums, not rows, meet in one task: a few thousand of each that read the table
            found = found.repartition(1).groupBy("leaf", "f", "bin").agg(*(F.sum(c).alias(c) for c in "ghn"))
        found = found.toArrow()
        total = np.zeros((len(leaves), features, size, 3), np.int64)
        at = tuple(found.column(name).to_numpy() for name in ("leaf", "f", "bin"))
        total[at] = np.column_stack([found.column(c).to_numpy() for c in "ghn"])
        return total

    count, right = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("y")), F.lit(0))).head()
    return boost(cuts, count, right, sums, **limits)
