"""Joins and groupings on keys one of which may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000          # a key with more than 1/HOT_SHARE of the rows is hot: fewer than HOT_SHARE keys
HOT_MIN_ROWS = 1_000_000  # below this a key fits a task whatever its share
CHECK_BYTES = 256 << 20   # inputs smaller than this are not searched for hot keys


def input_bytes(df: DataFrame) -> int:
    """Size of all tables the frame reads.

    The optimizer's own estimate multiplies the sides of a join, which is far off for the
    lookups made here.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def hot_keys(
    df: DataFrame, key: str, share: int = HOT_SHARE, min_rows: int = HOT_MIN_ROWS, check_bytes: int = CHECK_BYTES
) -> list:
    """Keys with more than a ``1/share`` part of the rows: at most ``share`` values."""
    if input_bytes(df) < check_bytes:
        return []
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    limit = max(min_rows, total // share)
    return [r[0] for r in counts.where(F.col("_n") > limit).select(key).collect()]


def row_salt(df: DataFrame, salts: int) -> Column:
    """Salt that depends on the row alone, so that a repeated task gives it again."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]
    return F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")


def spread_join(
    rows: DataFrame, facts: DataFrame, key: str, how: str = "inner", hot: Sequence | None = None
) -> DataFrame:
    """Join many rows per key with at most one fact per key.

    Hot keys are salted: their rows spread over all shuffle partitions and their fact is
    copied to each salt. Without hot keys it is a plain join. ``how`` is any left-preserving type.
    """
    hot = hot_keys(rows, key) if hot is None else list(hot)
    if not hot:
        return rows.join(facts, key, how)
    salts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    is_hot = F.col(key).isin(hot)
    salted = rows.withColumn("_salt", F.when(is_hot, row_salt(rows, salts)).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = facts.withColumn("_salt", F.explode(copies))
    return salted.join(copied, [key, "_salt"], how).drop("_salt")
