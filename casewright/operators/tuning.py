"""Tuning of outcome models by a tree-structured Parzen estimator.

Trials are chosen from what earlier ones scored: for every parameter the better part of the trials and
the rest each give a density (a mixture of bells around their values, cut off at the range), and of some
candidates drawn from the better density the one with the greatest ratio of both is tried next. Fits of a
trial's folds and buckets run at the same time, each in a scheduler pool of its own.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import quoted
from ..session import stage
from .metrics import counted_auc, score_counts
from .model import SCORE, TRAINERS, VECTOR, concurrently, model_scorer, scaling, stage_partitions, with_vector

Space = Mapping[str, tuple[str, float, float]]

# Tuning ranges of the two kinds of models.
SPACES: dict[str, Space] = {
    "logit": {"c": ("real", -15.0, 15.0)},
    "boosted": {
        "learning_rate": ("real", 0.0, 1.0), "subsample": ("real", 0.5, 1.0), "max_depth": ("whole", 4, 30),
        "colsample": ("real", 0.5, 1.0), "min_child": ("whole", 1, 6),
    },
}


class Parzen:
    """Mixture of one bell per value and one as wide as the range, cut off at the range."""

    def __init__(self, values: Sequence[float], low: float, high: float):
        self.low, self.high = low, high
        whole = max(high - low, 1e-12)
        spots = sorted(values)
        self.centres, self.widths = [(low + high) / 2], [whole]
        for i, v in enumerate(spots):
            left = v - (spots[i - 1] if i else low)
            right = (spots[i + 1] if i + 1 < len(spots) else high) - v
            self.centres.append(v)
            self.widths.append(min(whole, max(left, right, whole / min(100, 1 + len(spots)))))

    def draw(self, rng: random.Random) -> float:
        i = rng.randrange(len(self.centres))
        for _ in range(100):
            v = rng.gauss(self.centres[i], self.widths[i])
            if self.low <= v <= self.high:
                return v
        return min(self.high, max(self.low, self.centres[i]))

    def log_density(self, v: float) -> float:
        total = 0.0
        for m, s in zip(self.centres, self.widths):
            inside = (math.erf((self.high - m) / (s * math.sqrt(2))) - math.erf((self.low - m) / (s * math.sqrt(2)))) / 2
            total += math.exp(-((v - m) ** 2) / (2 * s * s)) / (s * math.sqrt(2 * math.pi) * max(inside, 1e-12))
        return math.log(max(total / len(self.centres), 1e-300))


def next_trial(
    space: Space, done: Sequence[tuple[Mapping[str, float], float]], rng: random.Random, first: int = 5, share: float = 0.25, candidates: int = 24
) -> dict[str, float]:
    """Parameters to try after (parameters, score) of the trials so far; the greatest score is the best.

    The first trials are drawn evenly. Trials without a score are left out of both densities.
    """
    scored = sorted((t for t in done if t[1] is not None and not math.isnan(t[1])), key=lambda t: -t[1])
    if len(done) < first or len(scored) < 2:
        return {p: rng.randint(int(low), int(high)) if kind == "whole" else rng.uniform(low, high) or high / 2 for p, (kind, low, high) in space.items()}
    n_good = max(1, math.ceil(share * math.sqrt(len(scored))))
    out = {}
    for p, (kind, low, high) in space.items():
        # A whole number stands for the half unit around it.
        edge = 0.5 if kind == "whole" else 0.0
        good, rest = (Parzen([t[p] for t, _ in part], low - edge, high + edge) for part in (scored[:n_good], scored[n_good:]))
        drawn = [good.draw(rng) for _ in range(candidates)]
        if kind == "whole":
            drawn = [float(min(high, max(low, round(v)))) for v in drawn]
        best = max(drawn, key=lambda v: good.log_density(v) - rest.log_density(v))
        out[p] = int(best) if kind == "whole" else best or high / 2
    return out


def tpe_search(
    evaluate: Callable[[dict[str, float]], float], space: Space, trials: int = 50, seed: int = 22, first: int = 5
) -> list[tuple[dict[str, float], float]]:
    """(parameters, score) of all trials in the order they were made."""
    rng, done = random.Random(seed), []
    for _ in range(trials):
        chosen = next_trial(space, done, rng, first)
        done.append((chosen, evaluate(chosen)))
    return done


def fold_scores(
    folded: DataFrame, features: Sequence[str], method: str, params: Mapping[str, Any], default: float = 0.5, parallel: int = 4,
    fold: str = "fold", bucket: str = "bucket", label: str = "encoded_label", known: dict[Any, Any] | None = None,
) -> DataFrame:
    """(fold, bucket, label, score): every row scored by a model of its bucket's rows in the other folds.

    ``folded`` is a table partitioned by fold and bucket, so each fit and each scoring reads its folders
    alone. A one-class training part answers with its class, an empty one with ``default``. Trials over one table
    share in ``known`` what does not depend on parameters: class counts and the scaling of each training part.
    """
    known = {} if known is None else known
    if "classes" not in known:
        # A row per fold and bucket.
        counted = folded.groupBy(fold, bucket).agg(F.count("*").alias("n_train"), F.sum(F.col(label).cast("long")).alias("_positive"))
        known["classes"] = {(r[fold], r[bucket]): (r["n_train"], r["_positive"]) for r in counted.collect()}
    classes = known["classes"]

    def fit(k, b):
        n = sum(c[0] for (f, g), c in classes.items() if g == b and f != k)
        positive = sum(c[1] for (f, g), c in classes.items() if g == b and f != k)
        if n == 0:
            return float(default)
        if positive in (0, n):
            return float(positive > 0)
        train = folded.where((F.col(bucket) == b) & (F.col(fold) != k))
        if method != "logit":
            return TRAINERS[method](train, features, label, **params)
        if (k, b) not in known:
            known[k, b] = scaling(train, features)
        return TRAINERS[method](train, features, label, scaled=known[k, b], **params)

    jobs = sorted(classes)
    fitted = concurrently([lambda k=k, b=b: fit(k, b) for k, b in jobs], parallel, folded.sparkSession)
    scored = None
    for (k, b), model in zip(jobs, fitted):
        own = folded.where((F.col(fold) == k) & (F.col(bucket) == b))
        answer = own.withColumn(SCORE, F.lit(model)) if isinstance(model, float) else model_scorer(model)(own)
        part = answer.select(fold, bucket, label, SCORE)
        scored = part if scored is None else scored.unionByName(part)
    return scored


def fold_auc(scored: DataFrame, fold: str = "fold", bucket: str = "bucket", label: str = "encoded_label") -> dict[Any, float]:
    """Mean fold AUC per bucket (0.5 for one class, 0 for a missing fold) and, as None, over all rows of each fold.

    Rows are scored once, to count each distinct score; both kinds of AUC come from the counts.
    """
    counts = stage(score_counts(scored, SCORE, label, [bucket, fold]), "counts")
    # A row per fold and bucket, and a row per fold.
    each = sorted((r[bucket], r[fold], r["auc"]) for r in counted_auc(counts, [bucket, fold]).collect())
    folds, buckets = len({k for _, k, _ in each}), sorted({b for b, _, _ in each})
    whole = [a for _, _, a in each]
    if len(buckets) > 1:
        merged = counts.groupBy(fold, "_score").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
        whole = [r["auc"] for r in counted_auc(merged, [fold]).orderBy(fold).collect()]
    whole = [a for a in whole if a is not None]
    means = {b: sum(0.5 if a is None else a for own, _, a in each if own == b) / folds for b in buckets}
    return {**means, None: sum(whole) / len(whole) if whole else None}


def tune(
    encoded: DataFrame, features: Sequence[str], method: str, trials: int = 50, seed: int = 22, space: Space | None = None,
    fixed: Mapping[str, Any] | None = None, dataset: str = "log", encoding: str = "single_agg", parallel: int = 4,
    fold: str = "fold", bucket: str = "bucket", label: str = "encoded_label",
) -> DataFrame:
    """Trial table (iter, dataset, cls, method, bucket, param, value, score) of a search; bucket 0 holds the overall score.

    ``encoded`` carries the fold of every prefix. It is written once, partitioned by fold and bucket, and
    the objective is the mean AUC over the folds. ``best_params`` picks from the result. Linear models read features as
    one column; boosted ones draw subsamples by the files of single columns.
    """
    spark = encoded.sparkSession
    given = encoded.select(fold, bucket, label, *[F.col(quoted(f)) for f in features])
    if method == "logit":
        given = with_vector(given, features).select(fold, bucket, label, VECTOR)
    folded = stage_partitions(given, [fold, bucket], "folds")
    default = folded.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    rows, known = [], {}

    def evaluate(chosen: dict[str, float]) -> float:
        scores = fold_auc(fold_scores(folded, features, method, {**chosen, **(fixed or {})}, default, parallel, fold, bucket, label, known), fold, bucket, label)
        number = 1 + len({r[0] for r in rows})
        rows.extend((number, int(b or 0), p, float(v), s) for b, s in scores.items() for p, v in chosen.items())
        return scores[None]

    tpe_search(evaluate, space or SPACES[method], trials, seed)
    table = spark.createDataFrame(rows, f"iter int, {bucket} long, param string, value double, score double")
    return table.select("iter", F.lit(dataset).alias("dataset"), F.lit(method).alias("cls"), F.lit(encoding).alias("method"), bucket, "param", "value", "score")


def chosen_params(best: DataFrame, method: str, bucket: str = "bucket") -> dict[Any, dict[str, float]]:
    """Trainer arguments per bucket from ``best_params``; those of bucket 0 hold for buckets without their own."""
    whole = {p for p, (kind, _, _) in SPACES[method].items() if kind == "whole"}
    out: dict[Any, dict[str, float]] = {}
    for r in best.collect():
        key = r[bucket] or None
        out.setdefault(key, {})[r["param"]] = int(r["value"]) if r["param"] in whole else r["value"]
    return out
