"""The encoded set of a log: split, prefixes, buckets, features and label in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import with_total
from ..operators.bucket import floor_sizes
from ..operators.encode import METHODS, EncoderModel, encode_heads, fit_heads, running_heads
from ..operators.prefix import max_prefix_rule
from ..schema import LogSchema
from ..session import stage


class EncodedSet(NamedTuple):
    rows: DataFrame
    features: list[str]
    categorical: list[str]
    models: Sequence[EncoderModel]
    max_length: int

    @property
    def numeric(self) -> list[str]:
        hidden = set(self.categorical)
        return [f for f in self.features if f not in hidden]


def encoded_with_label(
    log: DataFrame, schema: LogSchema, encoding: str = "agg", bucketing: str = "single", ratio: float = 0.8,
    gap: int = 1, max_length: int | None = None, drop_empty: bool = True,
) -> EncodedSet:
    """Train and test prefixes with features and label; ``set`` is training or testing.

    The vocabulary comes from the training part, bucket by bucket. Test prefixes whose
    bucket has no training part are dropped unless ``drop_empty`` is false.
    """
    kinds = METHODS[encoding]
    longest = max_prefix_rule(log, schema) if max_length is None else max_length
    # The log is shuffled by case once; everything below works on the first events of each case.
    heads = stage(running_heads(log, schema, longest), "heads")
    heads = mark_sets(heads, schema, ratio)
    train = heads.where(F.col("set") == "training")
    by_length = bucketing == "prefix"
    buckets = None
    if by_length:
        # The cut may have shortened training cases.
        whole = Window.partitionBy(schema.case)
        train = train.withColumn("case_length", F.max("pos").over(whole))
        fitted = train.select(F.col("pos").cast("long").alias("size")).distinct()
        every = log.sparkSession.range(1, longest + 1).withColumnRenamed("id", "size")
        buckets = floor_sizes(every, fitted)
    models = fit_heads(kinds, train, schema, by_length)
    rows = encode_heads(heads, schema, models, gap, buckets, keep=("set",))
    if drop_empty:
        rows = rows.where(F.col("bucket").isNotNull())
    features = [f"{m.kind}__{c}" for m in models for c in m.columns]
    categorical = [f"{m.kind}__{c}" for m in models for c in m.categorical_columns]
    return EncodedSet(rows, features, categorical, models, longest)


def mark_sets(heads: DataFrame, schema: LogSchema, ratio: float) -> DataFrame:
    """Heads with their ``set``: the split of ``temporal_split`` without a join.

    Whether a case trains follows from its start and id alone, once the first test case in
    (start, id) order is known; cases without any time come last. Without a time to cut at, as in
    ``temporal_split``, no event trains.
    """
    starts = heads.where(F.col("pos") == 1).select(schema.case, "case_start")
    ranked, total = with_total(starts, [F.col("case_start").asc_nulls_last(), F.col(schema.case)])
    last = int(ratio * total)
    edge = {r["rank"]: r for r in ranked.where(F.col("rank").isin(last, last + 1)).collect()}
    if last + 1 not in edge:
        return heads.limit(0).withColumn("set", F.lit("training"))
    first_test = edge[last + 1]
    start, case = F.lit(first_test["case_start"]), F.lit(first_test[schema.case])
    undated = F.col("case_start").isNull()
    if first_test["case_start"] is None:
        return heads.where(undated & (F.col(schema.case) >= case)).withColumn("set", F.lit("testing"))
    tested = undated | (F.col("case_start") > start) | ((F.col("case_start") == start) & (F.col(schema.case) >= case))
    marked = heads.withColumn("set", F.when(tested, "testing").otherwise("training"))
    return marked.where((F.col("set") == "testing") | (F.col(schema.ts) < start))


def catalogue(encoded: EncodedSet, dataset: str, method: str) -> DataFrame:
    """One row per bucket and set: sizes, prefix length and number of features.

    A bucket's features are those its training part fills in: the fitted columns of its vocabulary.
    """
    sizes = encoded.rows.groupBy("bucket", "set").agg(
        F.count("*").alias("bucket_size"), F.min("prefix_nr").alias("_least")
    )
    widths = encoded.rows.sparkSession.createDataFrame(
        [(int(b), int(n)) for b, n in bucket_widths(encoded).items()], "bucket long, feature_num int"
    )
    return sizes.join(F.broadcast(widths), "bucket").select(
        F.lit(dataset).alias("dataset"), F.lit(method).alias("method"), F.col("set").alias("dataset_type"),
        "bucket_size", F.col("_least").alias("prefix_length"), "feature_num",
    )


def bucket_widths(encoded: EncodedSet) -> dict[int, int]:
    """Number of fitted columns of every bucket."""
    by_length = any(m.bucket_max or any(s for v in m.levels.values() for s in v.values()) for m in encoded.models)
    buckets = range(1, encoded.max_length + 1) if by_length else [1]
    widths = {}
    for b in buckets:
        n = 0
        for m in encoded.models:
            levels = [s for found in m.levels.values() for s in found.values()]
            n += sum(1 for s in levels if not s or b in s)
            if m.kind == "index":
                n += len(m.num) * (min(b, m.max_events) if m.bucket_max else m.max_events)
            else:
                n += len(m.num) * (1 if m.kind == "static" else 5)
        widths[b] = n
    return widths
