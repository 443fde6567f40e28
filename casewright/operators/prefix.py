"""Prefixes of cases and their length rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import nulls_last
from ..functions.keyed import spread_join
from ..schema import LogSchema


def length_histogram(log: DataFrame, schema: LogSchema, positive_only: bool = False) -> DataFrame:
    """(length, n_cases); its size grows with the square root of the log at most."""
    rows = log.where(F.col(schema.label) == schema.positive) if positive_only else log
    sizes = rows.where(F.col(schema.case).isNotNull()).groupBy(schema.case).agg(F.count("*").alias("length"))
    return sizes.groupBy("length").agg(F.count("*").alias("n_cases"))


def pos_length_quantile(log: DataFrame, schema: LogSchema, share: float = 0.9) -> DataFrame:
    """Quantile of the length of positive cases, rounded up."""
    lengths = length_histogram(log, schema, positive_only=True)
    return lengths.agg(F.ceil(F.percentile("length", F.lit(share), F.col("n_cases"))).alias("length_quantile"))


def max_prefix_rule(log: DataFrame, schema: LogSchema, share: float = 0.9) -> int:
    """Longest prefix to use: fixed for some logs, else the capped quantile."""
    if schema.prefix_fixed is not None:
        return schema.prefix_fixed
    quantile = pos_length_quantile(log, schema, share).first()[0]
    return schema.prefix_cap if quantile is None else min(schema.prefix_cap, int(quantile))


def case_length(log: DataFrame, schema: LogSchema, out: str = "case_length") -> DataFrame:
    """Number of events of the case on every event."""
    lengths = log.groupBy(schema.case).agg(F.count("*").alias(out))
    return spread_join(log, lengths, schema.case)


def case_heads(log: DataFrame, schema: LogSchema, max_length: int) -> DataFrame:
    """The first ``max_length`` events of each case with ``pos`` and the capped ``case_length``.

    Spark limits each case before the shuffle, so a long case ships a few rows only, and the
    capped length is the number of rows kept.
    """
    inside = Window.partitionBy(schema.case).orderBy(*nulls_last(schema.order))
    heads = (
        log.where(F.col(schema.case).isNotNull())
        .withColumn("pos", F.row_number().over(inside)).where(F.col("pos") <= max_length)
    )
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return heads.withColumn("case_length", F.count("*").over(whole).cast("int"))


def generate_prefixes(log: DataFrame, schema: LogSchema, min_length: int, max_length: int, gap: int = 1) -> DataFrame:
    """First n events of every case with at least n, for n = min, min + gap, ... up to max.

    Adds ``original_case_id``, ``prefix_id`` (``<case>_<n>``, the plain id for the first n),
    ``prefix_nr`` (n, but 1 for the first n) and the capped ``case_length``.
    """
    heads = case_heads(log, schema, max(min_length, max_length))
    numbers = F.when(
        F.col("case_length") >= min_length,
        F.sequence(F.lit(min_length), F.greatest(F.lit(min_length), F.least(F.lit(max_length), "case_length")), F.lit(gap)),
    )
    copies = heads.withColumn("_n", F.explode(numbers)).where(F.col("pos") <= F.col("_n"))
    first = F.col("_n") == min_length
    named = F.when(first, F.col(schema.case)).otherwise(F.concat_ws("_", schema.case, "_n"))
    return (
        copies.withColumn("original_case_id", F.col(schema.case)).withColumn("prefix_id", named)
        .withColumn("prefix_nr", F.when(first, 1).otherwise(F.col("_n")))
        .withColumn("case_length", F.least(F.lit(max_length), "case_length"))
        .drop("_n")
    )
