"""Exact attributions of boosted trees, from their node tables.

A leaf is reached when every feature on its path lies in an interval. Features that are left out
follow the shares of the training rows (cover) at their splits, so the worth of a set of known
features is, leaf by leaf, the leaf's value times a 0 or 1 for each known feature and a share for
each other one. The Shapley value of such a product has a closed form: the coefficients of the
polynomial with one factor (t + share) for each satisfied feature, weighted by the size of the set.
It depends on a row only through which of the leaf's features are satisfied, so every leaf is a
small table over those patterns and rows only look their pattern up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import quoted

#: Up to this many features on a path all patterns are tabulated, beyond it those that occur.
TABULATED = 10


@dataclass
class Leaf:
    """Value of a leaf, its features, and for each the share of cover and the (node, goes left) conditions."""

    value: float
    features: list[int] = field(default_factory=list)
    shares: list[float] = field(default_factory=list)
    conditions: list[list[tuple[int, bool]]] = field(default_factory=list)

    def attributions(self, satisfied: Sequence[bool]) -> np.ndarray:
        """Shapley value of each of the leaf's features for one pattern."""
        m = len(self.features)
        weights = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
        out = np.zeros(m)
        for j in range(m):
            polynomial, rest = np.ones(1), self.value
            for g in range(m):
                if g != j and satisfied[g]:
                    polynomial = np.convolve(polynomial, [self.shares[g], 1.0])
                elif g != j:
                    rest *= self.shares[g]
            out[j] = rest * (float(satisfied[j]) - self.shares[j]) * np.dot(polynomial, weights[: len(polynomial)])
        return out


@dataclass
class Tree:
    """Split features, thresholds and children of the inner nodes, and the leaves.

    A child below 0 is the leaf value -1 - child; node 0 is the root unless there is none.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaves: list[Leaf]
    children: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), int))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))


def read_trees(model: PipelineModel, path: str) -> list[Tree]:
    """Trees of a boosted model, with leaf values on the scale of log odds.

    The model is saved to ``path`` and its node table read back: a row per node, which is as large as
    the model that the driver holds already.
    """
    boosted = next(s for s in model.stages if isinstance(s, GBTClassificationModel))
    boosted.write().overwrite().save(path)
    from pyspark.sql import SparkSession

    table = SparkSession.active().read.parquet(f"{path}/data").select(
        "treeID", F.col("nodeData.id").alias("id"), "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.split.featureIndex").alias("feature"), F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )
    grouped: dict[int, dict[int, dict]] = {}
    for node in table.toArrow().to_pylist():
        grouped.setdefault(node["treeID"], {})[node["id"]] = node
    # Margins of a binary boosted model are half the log odds.
    return [_tree(nodes, 2.0 * boosted.treeWeights[t]) for t, nodes in sorted(grouped.items())]


def _tree(nodes: dict[int, dict], weight: float) -> Tree:
    inner = [i for i, n in sorted(nodes.items()) if n["leftChild"] >= 0]
    place = {i: k for k, i in enumerate(inner)}
    leaves, todo = [], [(0, Leaf(0.0))]
    while todo:
        i, path = todo.pop()
        node = nodes[i]
        if i not in place:
            leaves.append(Leaf(weight * node["prediction"], path.features, path.shares, path.conditions))
            continue
        for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
            share = nodes[child]["rawCount"] / node["rawCount"]
            features, shares, conditions = list(path.features), list(path.shares), [list(c) for c in path.conditions]
            if node["feature"] not in features:
                features.append(node["feature"])
                shares.append(1.0)
                conditions.append([])
            at = features.index(node["feature"])
            shares[at] *= share
            conditions[at].append((place[i], left))
            todo.append((child, Leaf(0.0, features, shares, conditions)))
    ends = [i for i in sorted(nodes) if i not in place]
    place |= {i: -1 - k for k, i in enumerate(ends)}
    children = np.array([[place[nodes[i]["leftChild"]], place[nodes[i]["rightChild"]]] for i in inner], int).reshape(-1, 2)
    values = np.array([weight * nodes[i]["prediction"] for i in ends], float)
    return Tree(
        np.array([nodes[i]["feature"] for i in inner], int), np.array([nodes[i]["threshold"] for i in inner], float), leaves, children, values
    )


def expected_margin(trees: Sequence[Tree]) -> float:
    """Log odds with no feature known: leaf values weighted by their cover."""
    return float(sum(leaf.value * np.prod(leaf.shares) for tree in trees for leaf in tree.leaves))


class Attributor:
    """Attributions of blocks of rows; leaves keep their tables from block to block."""

    def __init__(self, trees: Sequence[Tree], n_features: int):
        self.trees, self.n_features = trees, n_features
        self.tables: dict[int, np.ndarray | dict[int, np.ndarray]] = {}

    def _table(self, leaf: Leaf) -> np.ndarray:
        """Attributions (features x patterns) of a leaf with few features."""
        m, table = len(leaf.features), self.tables.get(id(leaf))
        if table is None:
            table = np.array([leaf.attributions([bool(p >> j & 1) for j in range(m)]) for p in range(1 << m)])
            table = self.tables[id(leaf)] = np.ascontiguousarray(table.T)
        return table

    def _looked_up(self, leaf: Leaf, pattern: np.ndarray) -> np.ndarray:
        m = len(leaf.features)
        table = self.tables.setdefault(id(leaf), {})
        found, place = np.unique(pattern, return_inverse=True)
        for p in found.tolist():
            if p not in table:
                table[p] = leaf.attributions([bool(p >> j & 1) for j in range(m)])
        return np.array([table[p] for p in found.tolist()])[place]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Attributions (rows x features) of the rows of ``x``; a missing value goes right, as in scoring."""
        # One run of memory per feature and per node: leaves then work on whole runs.
        columns = np.ascontiguousarray(x.T)
        out = np.zeros((self.n_features, len(x)))
        for tree in self.trees:
            left = columns[tree.feature] <= tree.threshold[:, None]
            right = ~left
            for leaf in tree.leaves:
                m = len(leaf.features)
                if not m:
                    continue
                pattern = np.zeros(len(x), np.uint8 if m <= 8 else np.int64)
                for j, conditions in enumerate(leaf.conditions):
                    node, goes_left = conditions[0]
                    met = (left if goes_left else right)[node]
                    for node, goes_left in conditions[1:]:
                        met = met & (left if goes_left else right)[node]
                    pattern |= met.astype(pattern.dtype) << pattern.dtype.type(j)
                if m <= TABULATED:
                    table = self._table(leaf)
                    for j, f in enumerate(leaf.features):
                        out[f] += table[j].take(pattern)
                else:
                    out[leaf.features] += self._looked_up(leaf, pattern).T
        return out.T


def shap_trees(df: DataFrame, row: str, features: Sequence[str], model: PipelineModel, path: str) -> tuple[DataFrame, DataFrame]:
    """((row, feature, value, phi), one-row base): exact attributions of the log odds of a boosted model.

    Base and attributions add up to the log odds. ``path`` is a folder all executors can reach.
    """
    features = list(features)
    trees = read_trees(model, path)
    spark = df.sparkSession
    n = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attribute = Attributor(trees, n)
        for batch in batches:
            flat = batch.column("_v").flatten().to_numpy(zero_copy_only=False).astype(float)
            phi = attribute(flat.reshape(batch.num_rows, n))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_v"), pa.ListArray.from_arrays(ends, pa.array(phi.ravel()))], ["_row", "_v", "_phi"]
            )

    vectors = df.select(F.col(row).alias("_row"), F.array(*[F.col(quoted(f)).cast("double") for f in features]).alias("_v"))
    kind = df.schema[row].dataType.simpleString()
    explained = vectors.mapInArrow(run, f"_row {kind}, _v array<double>, _phi array<double>")
    names = F.array(*[F.lit(f) for f in features])
    long = explained.select(F.col("_row").alias(row), F.posexplode(F.arrays_zip(F.col("_v").alias("value"), F.col("_phi").alias("phi"))))
    phi = long.select(row, names[F.col("pos")].alias("feature"), "col.value", "col.phi")
    return phi, spark.createDataFrame([(expected_margin(trees),)], "base double")
