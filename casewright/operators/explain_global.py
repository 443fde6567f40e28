"""Explanations of a model as a whole.

Every operator takes a scorer: a function that adds a ``score`` column to a frame, so all
variants of all rows are scored in one job and aggregated at once.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import quoted, to_long
from ..functions.ordering import block_quantiles, value_blocks, with_total
from .model import SCORE, Scorer

IMPORTANCE_TYPES = ("weight", "gain", "cover", "total_gain", "total_cover")
# Primes above any repeat number, used as multipliers of a permutation.
_PRIMES = (1000003, 1000033, 1000037, 1000039, 1000081, 1000099, 1000117, 1000121, 1000133, 1000151)


def tree_importances(model: PipelineModel, features: Sequence[str], path: str) -> DataFrame:
    """(type, feature, score) for the five importance types of a boosted model.

    ``path`` is a folder all executors can reach; the model is saved there and its node
    table read back.
    """
    trees = next(s for s in model.stages if isinstance(s, GBTClassificationModel))
    trees.write().overwrite().save(path)
    spark = SparkSession.active()
    nodes = spark.read.parquet(f"{path}/data").select("nodeData.*")
    splits = nodes.where(F.col("leftChild") >= 0).groupBy(F.col("split.featureIndex").alias("_index")).agg(
        F.count("*").cast("double").alias("weight"), F.avg("gain").alias("gain"), F.avg("rawCount").cast("double").alias("cover"),
        F.sum("gain").alias("total_gain"), F.sum("rawCount").cast("double").alias("total_cover"),
    )
    names = spark.createDataFrame(list(enumerate(features)), "_index int, feature string")
    named = splits.join(F.broadcast(names), "_index").drop("_index")
    return named.unpivot(["feature"], list(IMPORTANCE_TYPES), "type", "score").select("type", "feature", "score")


def logit_coefficients(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(variable, coef) of a logistic model, in descending order of coef."""
    logit = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    rows = [(f, float(c)) for f, c in zip(features, logit.coefficients)]
    return SparkSession.active().createDataFrame(rows, "variable string, coef double").orderBy(F.col("coef").desc(), "variable")


def importance_trials(importances: DataFrame, dataset: str, seconds: Mapping[str, float] | None = None) -> DataFrame:
    """Importance rows with dataset and, in a row of its own per type, the time taken."""
    rows = importances.select(
        F.lit(dataset).alias("dataset"), "type", "feature", "score", F.lit(None).cast("double").alias("generation_time")
    )
    if not seconds:
        return rows
    times = importances.sparkSession.createDataFrame(
        [(dataset, t, None, 0.0, float(s)) for t, s in seconds.items()],
        "dataset string, type string, feature string, score double, generation_time double",
    )
    return rows.unionByName(times)


def permutation_importance(
    df: DataFrame, row: str, features: Sequence[str], scorer: Scorer, label: str = "encoded_label", repeats: int = 10, seed: int = 42
) -> DataFrame:
    """(feature, mean, std, importances): accuracy lost when a column is permuted.

    Rows get a seeded random rank once. In each repeat of each feature the row of rank d gives
    its value to the row of rank (a * d + b) mod n, with a prime to n: a permutation without
    another sort, and only single values are shuffled. All variants are scored together.
    """
    features = list(features)
    # Columns that are not permuted stay: the scorer may need them.
    slim = df.where(F.col(row).isNotNull())
    ranked, n = with_total(slim, [F.md5(F.concat_ws("_", row, F.lit(str(seed)))), F.col(row)], out="_rank")
    primes = F.array(*[F.lit(p).cast("long") for p in _PRIMES if n % p])
    i, r = F.floor(F.col("_p") / repeats).cast("long"), F.col("_p") % repeats
    a = F.element_at(primes, ((i + r) % F.size(primes) + 1).cast("int"))
    b = F.pmod((i * repeats + r + 1) * 7919, F.lit(max(1, n)))
    target = F.pmod(a * (F.col("_rank") - 1) + b, F.lit(max(1, n))) + 1
    values = F.array(*[F.col(quoted(f)).cast("double") for f in features])
    sent = ranked.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(len(features) * repeats - 1)))).select(
        target.alias("_rank"), (i + 1).cast("int").alias("_i"), r.alias("repeat"),
        F.element_at(values, (i + 1).cast("int")).alias("_given"),
    )
    moved = ranked.join(sent, "_rank")
    moved = moved.withColumns({
        f: F.when(F.col("_i") == k, F.col("_given")).otherwise(F.col(quoted(f))) for k, f in enumerate(features, 1)
    })
    hit = ((F.col(SCORE) > 0.5).cast("int") == F.col(label)).cast("int")
    accuracy = scorer(moved).groupBy("_i", "repeat").agg(F.avg(hit).alias("_acc"))
    return accuracy_drops(accuracy, scorer(slim).agg(F.avg(hit)), features)


def accuracy_drops(accuracy: DataFrame, base: DataFrame, features: Sequence[str]) -> DataFrame:
    """Importances from (_i, repeat, _acc) of every feature number from 1 and the accuracy of the rows as they are."""
    names = F.array(*[F.lit(f) for f in features])
    drops = accuracy.select(F.element_at(names, F.col("_i")).alias("feature"), "repeat", (base.scalar() - F.col("_acc")).alias("drop"))
    return drops.groupBy("feature").agg(
        F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("std"),
        F.transform(F.array_sort(F.collect_list(F.struct("repeat", "drop"))), lambda s: s["drop"]).alias("importances"),
    )


def ale_edges(df: DataFrame, features: Sequence[str], bins: int = 20, few: int = 10) -> DataFrame:
    """(feature, edges): distinct quantiles, or all values of a feature with fewer than ``few``."""
    blocks = value_blocks(to_long(df, [], features), ["feature"], "value")
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    quantiles = block_quantiles(blocks, ["feature"], probs)
    width = blocks.groupBy("feature").agg(F.count("*").alias("_width")).where(F.col("_width") < few)
    # Only features with fewer than ``few`` values are listed.
    listed = blocks.join(F.broadcast(width), "feature", "left_semi").groupBy("feature").agg(
        F.sort_array(F.collect_list("_v")).alias("_values")
    )
    edges = quantiles.select("feature", F.array_sort(F.array_distinct(F.array(*probs))).alias("_quantiles"))
    return edges.join(F.broadcast(listed), "feature", "left").select(
        "feature", F.coalesce("_values", "_quantiles").alias("edges")
    )


def ale(
    df: DataFrame, features: Sequence[str], scorer: Scorer, bins: int = 20, few: int = 10, targets: tuple[str, str] = ("deviant", "regular")
) -> DataFrame:
    """(feature, target, bin, edge, ale, ale0): first-order accumulated local effects.

    Every row is scored at both ends of its bin, for all features in one job. Bins close on
    the right; effects are centred by the bin-weighted mean of their midpoints.
    """
    features = list(features)
    edges = ale_edges(df, features, bins, few)
    # One row per feature with at most bins + 1 edges.
    slim = df.select(*[F.col(quoted(c)) for c in df.columns])
    of_row = F.create_map(*[x for f in features for x in (F.lit(f), F.col(quoted(f)).cast("double"))])
    names = F.array(*[F.lit(f) for f in features])
    spread = (
        slim.withColumn("_f", F.explode(names)).withColumn("_x", of_row[F.col("_f")])
        .join(F.broadcast(edges.withColumnRenamed("feature", "_f")), "_f")
    )
    place = F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col("_x"))))
    binned = spread.where(F.size("edges") > 1).withColumn("_bin", place)
    ends = binned.withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
    at = F.element_at("edges", F.col("_bin") + F.col("_side"))
    ends = ends.withColumns({f: F.when(F.col("_f") == f, at).otherwise(F.col(quoted(f))) for f in features})
    sign = F.when(F.col("_side") == 1, 1.0).otherwise(-1.0)
    steps = scorer(ends).groupBy(F.col("_f").alias("feature"), F.col("_bin").alias("bin")).agg(
        (F.count("*") / 2).alias("_n"), (F.sum(F.col(SCORE) * sign) / (F.count("*") / 2)).alias("_step")
    )
    return ale_curves(edges, steps, targets)


def ale_curves(edges: DataFrame, steps: DataFrame, targets: tuple[str, str]) -> DataFrame:
    """Centred curves from (feature, edges) and (feature, bin, _n, _step): one row per edge and target."""
    grid = edges.where(F.size("edges") > 1).select("feature", F.posexplode("edges").alias("bin", "edge"))
    joined = grid.join(steps, ["feature", "bin"], "left")
    upto = Window.partitionBy("feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("feature")
    summed = joined.select(
        "feature", "bin", "edge", F.coalesce("_n", F.lit(0.0)).alias("_n"), F.coalesce("_step", F.lit(0.0)).alias("_step")
    ).withColumn("_acc", F.sum("_step").over(upto))
    mid = (F.col("_acc") - F.col("_step") / 2) * F.col("_n")
    centred = summed.withColumn("ale0", F.sum(mid).over(whole) / F.sum("_n").over(whole))
    sides = F.array(*[
        F.struct(F.lit(t).alias("target"), ((F.col("_acc") - F.col("ale0")) * s).alias("ale"), (F.col("ale0") * s).alias("ale0"))
        for t, s in zip(targets, (1.0, -1.0))
    ])
    return centred.select("feature", "bin", "edge", F.explode(sides).alias("t")).select(
        "feature", "t.target", "bin", "edge", "t.ale", "t.ale0"
    )


def shap_linear(
    df: DataFrame, row: str, weights: Mapping[str, float], bias: float = 0.0, background: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """((row, feature, value, phi), one-row base): attributions w * (x - mean) of a linear score.

    Means are those of ``background``, or of ``df`` itself.
    """
    means = (df if background is None else background).agg(*[F.avg(F.col(quoted(c)).cast("double")).alias(f"_m{i}") for i, c in enumerate(weights)])
    at = means.first()
    base = F.lit(float(bias))
    for i, w in enumerate(weights.values()):
        base = base + F.lit(float(w)) * F.col(f"_m{i}")
    entries = [
        F.struct(
            F.lit(c).alias("feature"), F.col(quoted(c)).cast("double").alias("value"),
            (F.lit(float(w)) * (F.col(quoted(c)) - F.lit(at[i]))).alias("phi"),
        )
        for i, (c, w) in enumerate(weights.items())
    ]
    phi = df.select(row, F.explode(F.array(*entries)).alias("e")).select(row, "e.*")
    return phi, means.select(base.alias("base"))


def feature_orders(n: int, orders: int, seed: int = 42) -> list[list[int]]:
    """Seeded random orders of n features."""
    rng = random.Random(seed)
    return [rng.sample(range(n), n) for _ in range(orders)]


def shap_sampled(
    df: DataFrame, row: str, features: Sequence[str], scorer: Scorer, orders: int = 10, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """((row, feature, value, phi), one-row base): sampled Shapley values of any scorer.

    For each of ``orders`` feature orders, features switch one by one from the background (the
    column means) to the row's values; a feature gets the change in score when it switches.
    Each scored variant counts for the feature just switched and against the next one, so
    attributions add up to the score minus the base.
    """
    features = list(features)
    steps = []
    for order in feature_orders(len(features), orders, seed):
        for k in range(len(features) + 1):
            on = [i in order[:k] for i in range(len(features))]
            steps.append(F.struct(
                F.array(*[F.lit(x) for x in on]).alias("on"),
                F.lit(order[k - 1] if k else None).cast("int").alias("gain"),
                F.lit(order[k] if k < len(features) else None).cast("int").alias("loss"),
            ))
    means = df.agg(*[F.avg(F.col(quoted(f)).cast("double")).alias(f"_m{i}") for i, f in enumerate(features)])
    at = means.first()
    # Columns that are not attributed keep each row's value: the scorer may need them.
    slim = df.withColumns({f: F.col(quoted(f)).cast("double") for f in features})
    variants = slim.withColumn("_s", F.explode(F.array(*steps))).withColumns({
        f: F.when(F.col("_s.on")[i], F.col(quoted(f))).otherwise(F.lit(at[i])) for i, f in enumerate(features)
    })
    scored = scorer(variants)
    names = F.array(*[F.lit(f) for f in features])
    shares = F.array_compact(F.array(
        F.when(F.col("_s.gain").isNotNull(), F.struct(F.col("_s.gain").alias("i"), F.col(SCORE).alias("p"))),
        F.when(F.col("_s.loss").isNotNull(), F.struct(F.col("_s.loss").alias("i"), (-F.col(SCORE)).alias("p"))),
    ))
    phi = scored.select(row, F.explode(shares).alias("e")).groupBy(row, F.element_at(names, F.col("e.i") + 1).alias("feature")).agg(
        (F.sum("e.p") / orders).alias("phi")
    )
    values = to_long(slim, [row], features)
    held = [c for c in df.columns if c != row and c not in features]
    if held:
        # The base is the mean score of the rows with their own values of the other columns.
        means = slim.select(row, *[F.col(quoted(c)) for c in held]).withColumns({f: F.lit(at[i]) for i, f in enumerate(features)})
        base = scorer(means).agg(F.avg(SCORE).alias("base"))
    else:
        background = means.select(*[F.col(f"_m{i}").alias(f) for i, f in enumerate(features)])
        base = scorer(background).select(F.col(SCORE).alias("base"))
    return phi.join(values, [row, "feature"]).select(row, "feature", "value", "phi"), base


def shap_ranking(phi: DataFrame, top: int | None = 10) -> DataFrame:
    """(feature, total): features by summed absolute attribution."""
    totals = phi.groupBy("feature").agg(F.sum(F.abs("phi")).alias("total"))
    ordered = totals.orderBy(F.col("total").desc(), "feature")
    return ordered.limit(top) if top else ordered


def shap_dependence(phi: DataFrame, row: str, extra: DataFrame | None = None, top: int = 5) -> DataFrame:
    """(row, feature, value, phi) of the top features and of those in ``extra``."""
    chosen = shap_ranking(phi, top).select("feature")
    if extra is not None:
        chosen = chosen.unionByName(extra.select("feature")).distinct()
    # A list of feature names, bounded by the number of columns.
    return phi.join(F.broadcast(chosen), "feature", "left_semi").select(row, "feature", "value", "phi")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
