"""Comparisons of explanations between models, trials and running times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def important_features(gain: DataFrame, coefs: DataFrame, n: int = 1) -> DataFrame:
    """(rank, source, feature): the n best features by gain and by signed coefficient.

    For n = 1 the two are merged if equal. Nothing if either table is empty. ``gain`` has
    (feature, score), ``coefs`` has (variable, coef): a row per feature.
    """
    best = gain.orderBy(F.col("score").desc(), "feature").limit(n).select(F.col("score").alias("s"), "feature", F.lit("boosted").alias("source"))
    top = coefs.orderBy(F.col("coef").desc(), "variable").limit(n).select(
        F.col("coef").alias("s"), F.col("variable").alias("feature"), F.lit("logit").alias("source")
    )
    w = Window.partitionBy("source").orderBy(F.col("s").desc(), "feature")
    both = best.unionByName(top).withColumn("rank", F.row_number().over(w))
    ready = both.select("source").distinct().agg(F.count("*")).scalar() == 2
    chosen = both.where(ready).select("rank", "source", "feature")
    if n == 1:
        return chosen.groupBy("rank", "feature").agg(F.min("source").alias("source")).select("rank", "source", "feature")
    return chosen


def compare_ale(first: DataFrame, second: DataFrame, features: DataFrame, names: tuple[str, str] = ("boosted", "logit")) -> DataFrame:
    """ALE values of two models side by side at each edge, for the given features."""
    wanted = features.select("feature").distinct()
    keys = ["feature", "target", "bin", "edge"]
    a = first.select(*keys, F.col("ale").alias(f"ale_{names[0]}"))
    b = second.select(*keys, F.col("ale").alias(f"ale_{names[1]}"))
    # A list of feature names.
    return a.join(b, keys, "full").join(F.broadcast(wanted), "feature", "left_semi")


def correlated_features(matrix: DataFrame, least: float = 0.8, limit: int | None = None, label: str = "encoded_label") -> DataFrame:
    """Features of pairs with absolute correlation of at least ``least``, in name order.

    ``limit`` keeps the first few, as many as a picture has room for.
    """
    pairs = matrix.where(
        (F.abs("r") >= least) & (F.col("feature_a") != F.col("feature_b")) & (F.col("feature_b") != label)
    )
    found = pairs.select(F.explode(F.array("feature_a", "feature_b")).alias("feature")).distinct().orderBy("feature")
    return found.limit(limit) if limit else found


def compare_permutation(
    first: DataFrame, second: DataFrame, features: DataFrame, names: tuple[str, str] = ("boosted", "logit")
) -> DataFrame:
    """(feature, repeat, importance of both models): repeat by repeat for the given features."""
    def spread(df: DataFrame, name: str) -> DataFrame:
        return df.select("feature", F.posexplode("importances").alias("_at", f"importance_{name}")).withColumn("repeat", F.col("_at") + 1).drop("_at")

    joined = spread(first, names[0]).join(spread(second, names[1]), ["feature", "repeat"], "full")
    return joined.join(F.broadcast(features.select("feature").distinct()), "feature", "left_semi")


def compare_shap(
    first: DataFrame, second: DataFrame, row: str, features: DataFrame, names: tuple[str, str] = ("boosted", "logit")
) -> DataFrame:
    """(row, feature, value, phi of both models) for the given features."""
    wanted = F.broadcast(features.select("feature").distinct())
    a = first.join(wanted, "feature", "left_semi").select(row, "feature", "value", F.col("phi").alias(f"phi_{names[0]}"))
    b = second.join(wanted, "feature", "left_semi").select(row, "feature", F.col("phi").alias(f"phi_{names[1]}"))
    return a.join(b, [row, "feature"])


def compare_trials_logit(trials: DataFrame, n: int = 5) -> DataFrame:
    """(details, type, variable, score, trial): the n largest coefficients of each trial, stacked.

    ``trials`` has (details, trial, variable, coef), a row per feature.
    """
    w = Window.partitionBy("details", "trial").orderBy(F.col("coef").desc(), "variable")
    best = trials.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return best.select("details", F.lit("Coefficient").alias("type"), "variable", F.col("coef").alias("score"), "trial", "rank")


def compare_trials_boosted(trials: DataFrame, n: int = 4) -> DataFrame:
    """Per importance type and rank: variable and score of trial 1 and trial 2 side by side.

    ``trials`` has (details, trial, type, feature, score).
    """
    keys = ["details", "type", "rank"]
    w = Window.partitionBy("details", "trial", "type").orderBy(F.col("score").desc(), "feature")
    best = trials.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    sides = [
        best.where(F.col("trial") == t).select(*keys, F.col("feature").alias(f"variable{t}"), F.col("score").alias(f"score{t}"))
        for t in (1, 2)
    ]
    return sides[0].join(sides[1], keys, "full")


def timing_table(
    prediction: DataFrame, shap: DataFrame, ale: DataFrame, permutation: DataFrame
) -> DataFrame:
    """One row per (dataset, method, cls, prefix length): mean train time and explanation times.

    ``prediction`` has (..., n_iter, train_time), where n_iter -1 is a summary row and left
    out; the others have one ``seconds`` per key. Missing times are 0.
    """
    keys = ["dataset", "method", "cls", "prfx_len"]
    base = prediction.groupBy(*keys).agg(
        F.avg(F.when(F.col("n_iter") != -1, F.col("train_time").cast("double"))).alias("prediction_time")
    )
    for name, times in (("shap_time", shap), ("ale_time", ale), ("perm_time", permutation)):
        base = base.join(times.select(*keys, F.col("seconds").alias(name)), keys, "left")
    return base.fillna(0.0, subset=["prediction_time", "shap_time", "ale_time", "perm_time"])


def timing_by_model(table: DataFrame, columns: Sequence[str] = ("prediction_time", "shap_time", "ale_time", "perm_time")) -> DataFrame:
    """Per (dataset, method, cls): times as lists over the prefix length, with their range.

    A list holds one entry per prefix length.
    """
    def listed(c: str):
        return F.transform(F.array_sort(F.collect_list(F.struct("prfx_len", c))), lambda s: s[c]).alias(c)

    lengths = F.array_sort(F.collect_list("prfx_len")).alias("prfx_len")
    low = F.least(*[F.min(c) for c in columns]).alias("least")
    high = F.greatest(*[F.max(c) for c in columns]).alias("greatest")
    return table.groupBy("dataset", "method", "cls").agg(lengths, *[listed(c) for c in columns], low, high)
