"""Explanations of models over one array of features per row, with single values replaced while scoring.

A variant of a row is a feature number and a value. It is never laid out as a full row: linear models
adjust the row's margin; trees give the same score between two neighbouring thresholds of a feature, so a
block of rows is scored once per feature and interval and variants look their interval up. Plans do not
grow with the number of features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.feature import StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import quoted
from ..functions.ordering import block_quantiles, value_blocks, with_total
from ..session import scratch_path, stage
from .explain_global import _PRIMES, accuracy_drops, ale_curves
from .model import SCORE
from .tree_shap import Tree, read_trees

VECTOR, INDEX, VALUE = "_vector", "_index", "_value"
#: Values that a block of rows gives or takes in a permutation, over all features and repeats.
BLOCK_VALUES = 1 << 23
#: A missing value among doubles: a NaN with a mark, since a linear score of NaN is NaN and that of null is null.
_NULL = np.uint64(0x7FF8000000000DAD)


def _is_null(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64) == _NULL


class LinearBlock:
    """Scores of a block of rows under a linear margin, with one feature replaced."""

    def __init__(self, x: np.ndarray, weights: np.ndarray, bias: float):
        self.x, self.weights = x, weights
        self.null = _is_null(x).any(axis=1)
        self.margin = np.full(len(x), bias)
        for i, w in enumerate(weights):
            self.margin += x[:, i] * w

    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        """(scores, which of them are null)."""
        return 1 / (1 + np.exp(-self.margin)), self.null

    def scores(self, i: int, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of the rows ``at`` with these values of feature ``i``."""
        change = self.weights[i] * (values - self.x[at, i])
        return 1 / (1 + np.exp(-(self.margin[at] + change))), self.null[at] | _is_null(values)


class TreeBlock:
    """Scores of a block of rows under boosted trees, with one feature replaced.

    Subtrees without the feature keep their outcome; above a split on it each interval between its
    thresholds takes one side.
    """

    def __init__(self, x: np.ndarray, trees: Sequence[Tree]):
        self.rows, self.trees = len(x), trees
        self.left = [x[:, t.feature] <= t.threshold for t in trees]
        self.known = [{} for _ in trees]
        self.outcome = [self._value(k, 0 if len(t.feature) else -1, -1, 0.0) for k, t in enumerate(trees)]
        self.margin = sum(self.outcome, np.zeros(self.rows))
        self.feature, self.table, self.thresholds = -1, np.zeros((0, 0)), np.zeros(0)

    def _holds(self, k: int, node: int, i: int) -> bool:
        tree = self.trees[k]
        return node >= 0 and (tree.feature[node] == i or any(self._holds(k, c, i) for c in tree.children[node]))

    def _value(self, k: int, node: int, i: int, value: float, holds: Mapping[int, bool] | None = None) -> np.ndarray | float:
        """Outcome below a node for all rows if feature ``i`` has this value; without the feature it is kept."""
        tree = self.trees[k]
        if node < 0:
            return tree.values[-1 - node]
        if not holds or not holds[node]:
            found = self.known[k].get(node)
            if found is None:
                a, b = (self._value(k, int(c), -1, 0.0) for c in tree.children[node])
                found = self.known[k][node] = np.where(self.left[k][:, node], a, b)
            return found
        a, b = (int(c) for c in tree.children[node])
        if tree.feature[node] == i:
            return self._value(k, a if value <= tree.threshold[node] else b, i, value, holds)
        return np.where(self.left[k][:, node], self._value(k, a, i, value, holds), self._value(k, b, i, value, holds))

    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        # Leaf values are on the scale of log odds.
        return 1 / (1 + np.exp(-self.margin)), np.zeros(self.rows, bool)

    def scores(self, i: int, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if i != self.feature:
            self._tabulate(i)
        # A missing value goes right, beyond every threshold.
        return self.table[np.searchsorted(self.thresholds, values), at], np.zeros(len(at), bool)

    def _tabulate(self, i: int) -> None:
        """Scores of all rows for each interval of a feature."""
        using = [k for k, t in enumerate(self.trees) if (t.feature == i).any()]
        self.feature = i
        self.thresholds = np.unique(np.concatenate([np.zeros(0), *(self.trees[k].threshold[self.trees[k].feature == i] for k in using)]))
        margins = np.tile(sum((self.outcome[k] for k in range(len(self.trees)) if k not in using), np.zeros(self.rows)), (len(self.thresholds) + 1, 1))
        for k in using:
            tree = self.trees[k]
            holds = {node: self._holds(k, node, i) for node in range(len(tree.feature))}
            own = np.unique(tree.threshold[tree.feature == i])
            first = 0
            # An interval of the tree, represented by its upper end, covers several of all trees.
            for end in [*own, np.inf]:
                last = len(self.thresholds) if end == np.inf else int(np.searchsorted(self.thresholds, end))
                margins[first : last + 1] += self._value(k, 0, i, end, holds)
                first = last + 1
        self.table = 1 / (1 + np.exp(-margins))


@dataclass(frozen=True)
class VectorScorer:
    """``prepare`` adds what is needed once per row to (_vector), ``variant`` scores (_vector, _index, _value).

    ``block`` does both for an array of rows, inside a task.
    """

    features: tuple[str, ...]
    prepare: Callable[[DataFrame], DataFrame]
    plain: Callable[[DataFrame], DataFrame]
    variant: Callable[[DataFrame], DataFrame]
    block: Callable[[np.ndarray], LinearBlock | TreeBlock]


def feature_vector(features: Sequence[str]) -> Column:
    return F.array(*[F.col(quoted(f)).cast("double") for f in features]).alias(VECTOR)


def linear_scorer(features: Sequence[str], weights: Sequence[float], bias: float) -> VectorScorer:
    """Logistic score of a linear margin; a variant costs one product, whatever the width."""
    def given() -> Column:
        return F.array(*[F.lit(float(w)) for w in weights])

    def prepare(df: DataFrame) -> DataFrame:
        dot = F.aggregate(F.zip_with(VECTOR, given(), lambda x, w: x * w), F.lit(float(bias)), lambda a, x: a + x)
        return df.withColumn("_margin", dot)

    def logistic(margin: Column) -> Column:
        return 1 / (1 + F.exp(-margin))

    def variant(df: DataFrame) -> DataFrame:
        change = given()[F.col(INDEX)] * (F.col(VALUE) - F.col(VECTOR)[F.col(INDEX)])
        return df.withColumn(SCORE, logistic(F.col("_margin") + change))

    fixed = np.array(weights, float)
    return VectorScorer(
        tuple(features), prepare, lambda df: df.withColumn(SCORE, logistic(F.col("_margin"))), variant,
        lambda x: LinearBlock(x, fixed, float(bias)),
    )


def linear_form(model: PipelineModel) -> tuple[list[float], float]:
    """Weights and bias over raw features of a standardised logistic model; a constant feature weighs nothing."""
    logit = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    scaler = next(s for s in model.stages if isinstance(s, StandardScalerModel))
    weights = [c / d if d else 0.0 for c, d in zip(logit.coefficients.toArray(), scaler.std.toArray())]
    return [float(w) for w in weights], float(logit.intercept - sum(w * m for w, m in zip(weights, scaler.mean.toArray())))


def trained_scorer(model: PipelineModel, features: Sequence[str]) -> VectorScorer:
    """Scorer of a fitted model: logistic ones as a linear form, boosted ones on patched vectors."""
    trees = next((s for s in model.stages if isinstance(s, GBTClassificationModel)), None)
    if trees is None:
        return linear_scorer(features, *linear_form(model))

    def score(df: DataFrame, vector: Column) -> DataFrame:
        filled = F.transform(vector, lambda x: F.coalesce(x, F.lit(float("nan"))))
        scored = trees.transform(df.withColumn("_features", array_to_vector(filled)))
        return scored.withColumn(SCORE, vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")

    def variant(df: DataFrame) -> DataFrame:
        patched = F.transform(VECTOR, lambda x, i: F.when(i == F.col(INDEX), F.col(VALUE)).otherwise(x))
        return score(df, patched)

    nodes = read_trees(model, scratch_path(SparkSession.active(), "trees"))
    return VectorScorer(tuple(features), lambda df: df, lambda df: score(df, F.col(VECTOR)), variant, lambda x: TreeBlock(x, nodes))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of an array of doubles; missing values carry their mark."""
    flat = column.flatten()
    x = np.array(flat.to_numpy(zero_copy_only=False), float)
    if flat.null_count:
        x[flat.is_null().to_numpy(zero_copy_only=False)] = _NULL.view(np.float64)
    return x.reshape(-1, width)


def _shifts(n_features: int, repeats: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiplier and shift of every feature's permutations."""
    primes = np.array([p for p in _PRIMES if n % p], np.int64)
    i, r = np.divmod(np.arange(n_features * repeats, dtype=np.int64), repeats)
    return primes[(i + r) % len(primes)], (i * repeats + r + 1) * 7919 % max(1, n)


def _parcels(width: int, repeats: int, n: int, size: int):
    """What each block of ``size`` rows needs: its own rows, and the values it is given, packed by donors.

    Whole numbers below 256 travel as bytes, other values as doubles.
    """
    many, shift = _shifts(width, repeats, n)

    def given(rank: np.ndarray, x: np.ndarray, features: np.ndarray, kind: type) -> Iterator[tuple]:
        p = (features[:, None] * repeats + np.arange(repeats)).ravel()
        target = (many[p][:, None] * rank + shift[p][:, None]) % n
        to = (target // size).ravel()
        order = np.argsort(to.astype(np.uint16) if n // size < 1 << 16 else to, kind="stable")
        to, at = to[order], (target.ravel()[order] % size).astype(np.uint16)
        pair, donor = np.divmod(order, len(rank))
        values = x[donor, features[pair // repeats]].astype(kind)
        pair = pair.astype(np.uint16 if len(p) < 1 << 16 else np.uint32)
        ends = np.flatnonzero(np.append(np.diff(to) != 0, True)) + 1
        for start, end in zip(np.append(0, ends[:-1]), ends):
            counts = np.bincount(pair[start:end], minlength=len(p)).astype(np.uint32)
            yield int(to[start]), features.astype(np.int32).tobytes(), counts.tobytes(), at[start:end].tobytes(), values[start:end].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_VALUES // 2 // max(1, width * repeats))
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                # Targets are computed from 0; products stay far below 2^63.
                rank = batch.column("_rank").to_numpy().astype(np.int64) - 1
                x = _matrix(batch.column(VECTOR), width)
                label = batch.column("_label").to_numpy(zero_copy_only=False).astype(float)
                sent = []
                for block in np.unique(rank // size):
                    own = rank // size == block
                    sent.append((int(block), b"", label[own].tobytes(), (rank[own] % size).astype(np.uint16).tobytes(), x[own].tobytes()))
                with np.errstate(invalid="ignore"):
                    small = ((x >= 0) & (x < 256) & (x == np.floor(x)) & ~np.signbit(x)).all(axis=0)
                for chosen, kind in ((small, np.uint8), (~small, np.float64)):
                    if chosen.any():
                        sent.extend(given(rank, x, np.flatnonzero(chosen), kind))
                for at in range(0, len(sent), 64):
                    part = list(zip(*sent[at : at + 64]))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), *[pa.array(c, pa.binary()) for c in part[1:]]], _PARCEL)
    return run


_PARCEL = ["block", "features", "counts", "spots", "given"]


def _block_hits(scorers: Sequence[VectorScorer], width: int, repeats: int, size: int):
    """(scorer, pair, hits, n) of one block, pair -1 for the rows as they are."""
    scorings = [s.block for s in scorers]

    def run(table: pa.Table) -> pa.Table:
        _, features, counts, spots, given = ([v.as_buffer() for v in table.column(c)] if c != "block" else None for c in _PARCEL)
        own = [j for j, f in enumerate(features) if not f.size]
        at = np.concatenate([np.frombuffer(spots[j], np.uint16) for j in own])
        x = np.empty((size, width))[: int(at.max()) + 1]
        label = np.full(len(x), np.nan)
        x[at] = np.concatenate([np.frombuffer(given[j], np.float64) for j in own]).reshape(-1, width)
        label[at] = np.concatenate([np.frombuffer(counts[j], np.float64) for j in own])
        # Parcels hold a feature's repeats one after the other; (spots, values) of each feature and repeat.
        parts: list[list] = [[] for _ in range(width * repeats)]
        for j, f in enumerate(features):
            if not f.size:
                continue
            of, n = np.frombuffer(f, np.int32), np.frombuffer(counts[j], np.uint32).astype(np.int64)
            to, ends = np.frombuffer(spots[j], np.uint16), np.cumsum(n)
            values = np.frombuffer(given[j], np.uint8 if given[j].size == len(to) else np.float64)
            for q in np.flatnonzero(n):
                parts[of[q // repeats] * repeats + q % repeats].append((to[ends[q] - n[q] : ends[q]], values[ends[q] - n[q] : ends[q]]))
        out = []

        def count(k: int, pair: int, scored: tuple[np.ndarray, np.ndarray], truth: np.ndarray) -> None:
            counted = ~scored[1] & ~np.isnan(truth)
            # A score that is not a number counts as high, as it does in Spark.
            hit = (~(scored[0] <= 0.5)).astype(float) == truth
            out.append((k, pair, int((hit & counted).sum()), int(counted.sum())))

        with np.errstate(over="ignore", invalid="ignore"):
            for k, scoring in enumerate(scorings):
                rows = scoring(x)
                count(k, -1, rows.plain(), label)
                for pair, found in enumerate(parts):
                    to = np.concatenate([np.zeros(0, np.uint16), *(a for a, _ in found)])
                    values = np.concatenate([np.zeros(0), *(v for _, v in found)])
                    count(k, pair, rows.scores(pair // repeats, to, values), label[to])
        columns = list(zip(*out))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["scorer", "pair", "hits", "n"])
    return run


def permutation_importances(
    df: DataFrame, row: str, scorers: Sequence[VectorScorer], label: str = "encoded_label", repeats: int = 10, seed: int = 42
) -> list[DataFrame]:
    """(feature, mean, std, importances) under each scorer: accuracy lost when a feature is permuted.

    The permutations are those of ``explain_global.permutation_importance``. All scorers must have the same
    features; values are sent once for all of them. Rows are dealt to blocks by rank; a block gets its own rows and,
    from every batch of donors, the values that fall into it in one piece. Each block is scored in one go.
    """
    features = scorers[0].features
    if any(s.features != features for s in scorers):
        raise ValueError("scorers of one permutation need the same features")
    slim = df.where(F.col(row).isNotNull()).select(row, F.col(label).cast("double").alias("_label"), feature_vector(features))
    ranked, n = with_total(slim, [F.md5(F.concat_ws("_", row, F.lit(str(seed)))), F.col(row)], out="_rank")
    # Spots in a block fit 16 bits.
    size = max(1, min(1 << 14, BLOCK_VALUES // max(1, len(features) * repeats)))
    parcels = ranked.select("_rank", "_label", VECTOR).mapInArrow(
        _parcels(len(features), repeats, max(1, n), size), ", ".join(["block long", *(f"{c} binary" for c in _PARCEL[1:])])
    )
    hits = parcels.groupBy("block").applyInArrow(_block_hits(scorers, len(features), repeats, size), "scorer int, pair int, hits long, n long")
    # A row per scorer, feature and repeat.
    sums = stage(hits.groupBy("scorer", "pair").agg(F.try_divide(F.sum("hits"), F.sum("n")).alias("_acc")), "hits")
    found = []
    for k in range(len(scorers)):
        own = sums.where(F.col("scorer") == k)
        pairs = own.where("pair >= 0").select(
            (F.floor(F.col("pair") / repeats) + 1).cast("int").alias("_i"), (F.col("pair") % repeats).alias("repeat"), "_acc"
        )
        found.append(accuracy_drops(pairs, own.where("pair < 0").agg(F.max("_acc")), features))
    return found


def permutation_importance(
    df: DataFrame, row: str, scorer: VectorScorer, label: str = "encoded_label", repeats: int = 10, seed: int = 42
) -> DataFrame:
    """``permutation_importances`` under one scorer."""
    return permutation_importances(df, row, [scorer], label, repeats, seed)[0]


def vector_edges(vectors: DataFrame, features: Sequence[str], bins: int, few: int) -> DataFrame:
    """(feature, _index, edges) as ``explain_global.ale_edges`` finds them, from arrays."""
    long = vectors.select(F.posexplode(VECTOR).alias(INDEX, "value"))
    blocks = value_blocks(long, [INDEX], "value")
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    quantiles = block_quantiles(blocks, [INDEX], probs)
    width = blocks.groupBy(INDEX).agg(F.count("*").alias("_width")).where(F.col("_width") < few)
    # Only features with fewer than ``few`` values are listed.
    listed = blocks.join(F.broadcast(width), INDEX, "left_semi").groupBy(INDEX).agg(F.sort_array(F.collect_list("_v")).alias("_values"))
    names = F.array(*[F.lit(f) for f in features])
    edges = quantiles.select(INDEX, F.array_sort(F.array_distinct(F.array(*probs))).alias("_quantiles"))
    return edges.join(F.broadcast(listed), INDEX, "left").select(
        names[F.col(INDEX)].alias("feature"), INDEX, F.coalesce("_values", "_quantiles").alias("edges")
    )


def ale(
    df: DataFrame, scorer: VectorScorer, bins: int = 20, few: int = 10, targets: tuple[str, str] = ("deviant", "regular")
) -> DataFrame:
    """(feature, target, bin, edge, ale, ale0): first-order accumulated local effects."""
    vectors = df.select(feature_vector(scorer.features))
    edges = stage(vector_edges(vectors, scorer.features, bins, few), "edges")
    # One row per feature with at most bins + 1 edges.
    known = {r[INDEX]: np.array(r["edges"], float) for r in edges.where(F.size("edges") > 1).select(INDEX, "edges").collect()}
    steps = vectors.mapInArrow(_ale_steps(scorer, known), f"{INDEX} int, bin int, n long, step double").groupBy(INDEX, "bin").agg(
        F.sum("n").cast("double").alias("_n"), (F.sum("step") / F.sum("n")).alias("_step")
    )
    names = F.array(*[F.lit(f) for f in scorer.features])
    return ale_curves(edges.drop(INDEX), steps.withColumn("feature", names[F.col(INDEX)]).drop(INDEX), targets)


def _ale_steps(scorer: VectorScorer, edges: Mapping[int, np.ndarray]):
    """(feature number, bin, rows, sum of the changes in score from the lower to the upper edge) of a batch."""
    scoring, width = scorer.block, len(scorer.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Batches are added up, so that a task sends one row per bin.
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {i: (np.zeros(len(e), np.int64), np.zeros(len(e))) for i, e in edges.items()}
        scored = {i: np.zeros(len(e), np.int64) for i, e in edges.items()}
        for batch in batches:
            x = _matrix(batch.column(VECTOR), width)
            with np.errstate(over="ignore", invalid="ignore"):
                rows, every = scoring(x), np.arange(len(x))
                for i, own in edges.items():
                    # A missing value counts to the first bin.
                    place = np.where(_is_null(x[:, i]), 1, np.maximum(1, np.searchsorted(own, x[:, i])))
                    upper, null = rows.scores(i, every, own[place])
                    lower, _ = rows.scores(i, every, own[place - 1])
                    total[i][0][:] += np.bincount(place, minlength=len(own))
                    total[i][1][:] += np.bincount(place[~null], (upper - lower)[~null], minlength=len(own))
                    scored[i] += np.bincount(place[~null], minlength=len(own))
        out = [
            (i, int(b), int(n[b]), float(step[b]) if scored[i][b] else None)
            for i, (n, step) in total.items() for b in np.flatnonzero(n)
        ]
        if out:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [INDEX, "bin", "n", "step"])
    return run
