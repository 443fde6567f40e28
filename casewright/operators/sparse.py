"""Encoded sets with vocabularies of any size: features in long form, numbered by a table, as sparse vectors.

Nothing is collected and no plan grows with the vocabulary: features are rows, a feature's number is
its rank among the fitted ones, and a prefix's vector is an aggregation of its (number, value) pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import first_non_null, quoted, to_long
from ..functions.keyed import spread_join
from ..functions.ordering import with_total
from ..schema import LogSchema
from ..session import scratch_path, stage
from .encode import NUMERIC_STATS, encode_index_long

#: Features up to which their table is sent to all tasks.
BROADCAST_FEATURES = 200_000
#: Fields of a stored vector; type 0 is sparse.
_LAYOUT = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


class SparseSet(NamedTuple):
    """``rows`` with a vector column ``features``; ``vocabulary`` has (feature, feature_id) from 0; ``width`` its size."""

    rows: DataFrame
    vocabulary: DataFrame
    width: int

    def long(self, *keys: str) -> DataFrame:
        """(keys, feature, value) of all entries that are not zero."""
        raw = self.rows.select(*keys, F.posexplode("feature_ids").alias("_at", "feature_id"), "feature_values")
        values = raw.select(*keys, "feature_id", F.col("feature_values")[F.col("_at")].alias("value"))
        return values.join(self.vocabulary, "feature_id").select(*keys, "feature", "value")


def encode_long(prefixes: DataFrame, schema: LogSchema, encoding: str = "agg", case: str = "prefix_id") -> DataFrame:
    """(case, feature, value) of all non-zero features of a prefix log, named as the wide encoders name them."""
    return _static_long(prefixes, schema, case).unionByName(
        _agg_long(prefixes, schema, case) if encoding == "agg" else encode_index_long(prefixes, schema, case).select(
            case, F.concat(F.lit("index__"), "feature").alias("feature"), "value")
    )


def _named(kind: str, *parts) -> Column:
    return F.concat(F.lit(f"{kind}__"), F.concat_ws("_", *parts)).alias("feature")


def _static_long(prefixes: DataFrame, schema: LogSchema, case: str) -> DataFrame:
    fixed = [*schema.static_num, *schema.static_cat]
    if not fixed:
        return prefixes.select(case, F.lit("").alias("feature"), F.lit(0.0).alias("value")).limit(0)
    firsts = prefixes.groupBy(case).agg(*[first_non_null(quoted(c), schema.order).alias(c) for c in fixed])
    parts = []
    if schema.static_num:
        parts.append(to_long(firsts, [case], schema.static_num).select(case, _named("static", F.col("feature")), "value"))
    if schema.static_cat:
        levels = to_long(firsts, [case], schema.static_cat, "string").where(F.col("value").isNotNull())
        parts.append(levels.select(case, _named("static", F.col("feature"), F.col("value")), F.lit(1.0).alias("value")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.where(F.col("value") != 0)


def _agg_long(prefixes: DataFrame, schema: LogSchema, case: str) -> DataFrame:
    parts = []
    if schema.dynamic_cat:
        levels = to_long(prefixes, [case], schema.dynamic_cat, "string").where(F.col("value").isNotNull())
        counts = levels.groupBy(case, "feature", "value").agg(F.count("*").cast("double").alias("_n"))
        parts.append(counts.select(case, _named("agg", F.col("feature"), F.col("value")), F.col("_n").alias("value")))
    if schema.dynamic_num:
        functions = dict(zip(NUMERIC_STATS, (F.avg, F.max, F.min, F.sum, F.stddev_samp)))
        numbers = to_long(prefixes, [case], schema.dynamic_num).groupBy(case, "feature").agg(*[f("value").alias(s) for s, f in functions.items()])
        stats = numbers.unpivot([case, "feature"], list(functions), "_stat", "value")
        parts.append(stats.select(case, _named("agg", F.col("_stat"), F.col("feature")), "value"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.where(F.col("value") != 0)


def fit_vocabulary(long: DataFrame) -> tuple[DataFrame, int]:
    """((feature, feature_id) in name order, number of features) of a training part."""
    ranked, width = with_total(long.select("feature").distinct(), ["feature"], "_rank")
    return ranked.select("feature", (F.col("_rank") - 1).cast("int").alias("feature_id")), width


def sparse_set(
    prefixes: DataFrame, schema: LogSchema, encoding: str = "agg", case: str = "prefix_id", keep: Sequence[str] = ("set",),
    training: str = "set = 'training'", label: str = "encoded_label",
) -> SparseSet:
    """Encode a prefix log whose ``keep`` columns are constant in a prefix; the vocabulary is that of the rows where ``training``.

    Features that the training part lacks are dropped, prefixes without any known feature have an empty
    vector. The result is written out once, with the pairs beside the vector.
    """
    spark = prefixes.sparkSession
    keys = prefixes.groupBy(case).agg(
        *[F.first(c).alias(c) for c in keep], first_non_null(quoted(schema.label), schema.order).alias("_label")
    ).select(case, *keep, F.when(F.col("_label") == schema.positive, 1).otherwise(0).alias(label))
    long = stage(encode_long(prefixes, schema, encoding, case), "long")
    fitted = long.join(keys.where(training).select(case), case, "left_semi")
    vocabulary, width = fit_vocabulary(fitted)
    vocabulary = stage(vocabulary, "vocabulary")
    if width <= BROADCAST_FEATURES:
        numbered = long.join(F.broadcast(vocabulary), "feature")
    else:
        numbered = spread_join(long, vocabulary, "feature")
    # A vector holds no more entries than its prefix has events and columns.
    vectors = numbered.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("feature_id", "value"))).alias("_pairs"))
    empty = F.array().cast("array<struct<feature_id:int,value:double>>")
    rows = keys.join(vectors, case, "left").withColumn("_pairs", F.coalesce("_pairs", empty)).select(
        case, *keep, label, F.col("_pairs.feature_id").alias("feature_ids"), F.col("_pairs.value").alias("feature_values")
    ).withColumn("features", F.struct(F.lit(0).cast("tinyint"), F.lit(width), "feature_ids", "feature_values").cast(_LAYOUT))
    path = scratch_path(spark, "vectors")
    rows.write.parquet(path)
    # The stored layout is the one vectors have, so they are read back as vectors.
    kinds = T.StructType([f if f.name != "features" else T.StructField("features", VectorUDT()) for f in rows.schema.fields])
    return SparseSet(spark.read.schema(kinds).parquet(path), vocabulary, width)


def train_logit(df: DataFrame, label: str = "encoded_label", c: float = 0.0, max_iter: int = 100) -> PipelineModel:
    """Logistic regression on scaled sparse vectors, C = 2 ** c.

    Vectors are not centred, which would fill them up; the intercept carries no penalty, so the fit is the same.
    """
    typed = df.withColumn(label, F.col(label).cast("double"))
    logit = LogisticRegression(
        featuresCol="_scaled", labelCol=label, regParam=1.0 / (2.0**c * max(1, typed.count())), elasticNetParam=0.0, standardization=False,
        maxIter=max_iter,
    )
    scaler = StandardScaler(inputCol="features", outputCol="_scaled", withMean=False, withStd=True)
    return Pipeline(stages=[scaler, logit]).fit(typed)


def train_boosted(df: DataFrame, label: str = "encoded_label", n_trees: int = 500, learning_rate: float = 0.1, max_depth: int = 6, seed: int = 22) -> PipelineModel:
    """Gradient-boosted trees on sparse vectors."""
    trees = GBTClassifier(featuresCol="features", labelCol=label, maxIter=n_trees, stepSize=learning_rate, maxDepth=min(30, max_depth), seed=seed)
    return Pipeline(stages=[trees]).fit(df.withColumn(label, F.col(label).cast("double")))
