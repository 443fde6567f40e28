"""Bucketing of prefixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_sizes(prefixes: DataFrame, case: str = "prefix_id") -> DataFrame:
    """(case, size) of every prefix."""
    return prefixes.groupBy(case).agg(F.count("*").alias("size"))


def bucket_single(prefixes: DataFrame, case: str = "prefix_id", fitted: DataFrame | None = None) -> DataFrame:
    """Every prefix in bucket 1."""
    return prefixes.select(case).distinct().withColumn("bucket", F.lit(1))


def fit_sizes(prefixes: DataFrame, case: str = "prefix_id") -> DataFrame:
    """Distinct prefix sizes of the training part."""
    return prefix_sizes(prefixes, case).select("size").distinct()


def floor_sizes(sizes: DataFrame, fitted: DataFrame) -> DataFrame:
    """(size, bucket): the largest fitted size not above each size, null below all of them.

    Works on distinct sizes, whose number grows with the square root of the events at most.
    """
    marked = sizes.select("size").distinct().select("size", F.lit(None).cast("long").alias("_fit")).unionByName(
        fitted.select("size", F.col("size").alias("_fit"))
    )
    upward = Window.partitionBy(F.lit(1)).orderBy("size")
    return (
        marked.groupBy("size").agg(F.max("_fit").alias("_fit"))
        .select("size", F.last("_fit", ignorenulls=True).over(upward).alias("bucket"))
    )


def bucket_prefix_length(prefixes: DataFrame, case: str = "prefix_id", fitted: DataFrame | None = None) -> DataFrame:
    """Bucket = own size if it was fitted, else the next smaller fitted size."""
    sizes = prefix_sizes(prefixes, case)
    fitted = fit_sizes(prefixes, case) if fitted is None else fitted
    # Sizes are few but hold many prefixes each; a row per distinct size (at most the square root of
    # twice the events) goes to every task instead of all prefixes to a task per size.
    return sizes.join(F.broadcast(floor_sizes(sizes, fitted)), "size", "left").select(case, "size", "bucket")


BUCKETERS: dict[str, Callable[..., DataFrame]] = {"single": bucket_single, "prefix": bucket_prefix_length}


def get_bucketer(method: str) -> Callable[..., DataFrame]:
    if method not in BUCKETERS:
        raise ValueError(f"unknown bucketer {method!r}; use one of {sorted(BUCKETERS)}")
    return BUCKETERS[method]
