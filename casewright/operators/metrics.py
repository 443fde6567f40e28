"""ROC AUC and run-time metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import scan_within


def auc(
    df: DataFrame, score: str = "score", label: str = "encoded_label", by: Sequence[str] = (), one_class: float | None = None
) -> DataFrame:
    """Exact ROC AUC per group, ties averaged; ``one_class`` (null by default) if a class is missing.

    Rows are first counted per distinct score. The share of positive-negative pairs in the
    right order follows from a running count of negatives, which no single task has to hold.
    """
    return counted_auc(score_counts(df, score, label, by), by, one_class)


def score_counts(df: DataFrame, score: str = "score", label: str = "encoded_label", by: Sequence[str] = ()) -> DataFrame:
    """(by, _score, _pos, _neg): positive and other rows of each distinct score."""
    return df.groupBy(*by, F.col(score).cast("double").alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg")
    )


def counted_auc(counts: DataFrame, by: Sequence[str] = (), one_class: float | None = None) -> DataFrame:
    """``auc`` from ``score_counts``."""
    by = list(by)
    running = scan_within(counts, by, ["_score"], sums={"_below": "_neg"})
    won = F.col("_pos") * (F.col("_below") - F.col("_neg") / 2.0)
    totals = running.groupBy(*by).agg(
        F.sum(won).alias("_won"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_q")
    )
    value = F.try_divide(F.col("_won"), F.col("_p") * F.col("_q"))
    return totals.select(*by, F.coalesce(value, F.lit(one_class).cast("double")).alias("auc"))


def auc_by_prefix(df: DataFrame, score: str = "score", label: str = "encoded_label", events: str = "nr_events") -> DataFrame:
    """AUC per number of events, and over all rows as ``nr_events`` -1."""
    each = auc(df, score, label, [events])
    whole = auc(df, score, label).select(F.lit(-1).cast(df.schema[events].dataType).alias(events), "auc")
    return each.unionByName(whole)


def auc_by_bucket(df: DataFrame, score: str = "score", label: str = "encoded_label", fold: str = "fold", bucket: str = "bucket") -> DataFrame:
    """Per bucket: sum of fold AUCs over the number of folds; 0.5 for one class, 0 for a missing fold."""
    each = auc(df, score, label, [bucket, fold], one_class=0.5)
    folds = df.select(fold).distinct().agg(F.count("*"))
    return each.groupBy(bucket).agg((F.sum("auc") / folds.scalar()).alias("auc"))


def run_times(timings: DataFrame) -> DataFrame:
    """Long metric rows from a timing table ``(dataset, method, cls, n_iter, kind, seconds)``.

    ``kind`` is ``online`` (one row per scored prefix) or ``offline`` (one per iteration).
    Standard deviations are those of the population.
    """
    keys = ["dataset", "method", "cls"]
    online, offline = timings.where(F.col("kind") == "online"), timings.where(F.col("kind") == "offline")

    def stats(rows: DataFrame, by: list[str], names: tuple[str, str], values=("avg", "std")) -> DataFrame:
        both = rows.groupBy(*by).agg(F.avg("seconds").alias("avg"), F.stddev_pop("seconds").alias("std"))
        pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(v).alias("score")) for n, v in zip(names, values)])
        return both.select(*by, F.explode(pairs).alias("m")).select(*by, "m.metric", "m.score")

    per_iteration = stats(online, [*keys, "n_iter"], ("online_time_average", "online_time_standard"))
    total = stats(online, keys, ("online_time_avg", "online_time_std")).unionByName(
        stats(offline, keys, ("offline_time_total_avg", "offline_time_total_std"))
    )
    per_offline = offline.groupBy(*keys, "n_iter").agg(F.sum("seconds").alias("score")).select(
        *keys, "n_iter", F.lit("total_offline_time").alias("metric"), "score"
    )
    rows = per_iteration.unionByName(per_offline).unionByName(total.withColumn("n_iter", F.lit(-1).cast(timings.schema["n_iter"].dataType)))
    return rows.select(*keys, F.lit(-1).alias("nr_events"), "n_iter", "metric", "score")
