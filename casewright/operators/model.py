"""Training and scoring of outcome models, bucket by bucket, with Spark ML."""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import quoted
from ..functions.keyed import row_salt
from ..session import scratch_path
from .metrics import auc

Scorer = Callable[[DataFrame], DataFrame]
SCORE = "score"
#: Column of assembled features. A table that has it is not assembled again by fits and scorings.
VECTOR = "_features"
#: Rows of a file of ``stage_partitions``: a file is what a task reads at least, and a fit keeps its rows in memory.
FILE_ROWS = 1 << 14


def closed_form(weights: Mapping[str, float], bias: float = 0.0, out: str = SCORE) -> Scorer:
    """Scorer 1 / (1 + exp(-(bias + w.x))) over named columns."""
    def score(df: DataFrame) -> DataFrame:
        return df.withColumn(out, 1 / (1 + F.exp(-linear(weights, bias))))
    return score


def linear(weights: Mapping[str, float], bias: float = 0.0) -> Column:
    total = F.lit(float(bias))
    for c, w in weights.items():
        total = total + F.lit(float(w)) * F.col(quoted(c))
    return total


def model_scorer(model: PipelineModel, out: str = SCORE) -> Scorer:
    """Scorer that adds the positive-class probability of a fitted model."""
    def score(df: DataFrame) -> DataFrame:
        scored = model.transform(df)
        made = [c for c in scored.columns if c not in df.columns]
        return scored.withColumn(out, vector_to_array("probability")[1]).drop(*made)
    return score


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR, handleInvalid="keep")


def _assembly(df: DataFrame, features: Sequence[str]) -> list[VectorAssembler]:
    return [] if VECTOR in df.columns else [_assembler(features)]


def with_vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with its features as one column, for tables that many fits and scorings read."""
    return _assembler(features).transform(df)


def train_boosted(
    df: DataFrame, features: Sequence[str], label: str = "encoded_label", n_trees: int = 500, learning_rate: float = 0.1,
    max_depth: int = 6, subsample: float = 1.0, colsample: float = 1.0, min_child: int = 1, seed: int = 22,
) -> PipelineModel:
    """Gradient-boosted trees with a logistic loss."""
    trees = GBTClassifier(
        featuresCol=VECTOR, labelCol=label, maxIter=n_trees, stepSize=learning_rate, maxDepth=min(30, max_depth),
        subsamplingRate=subsample, featureSubsetStrategy=str(float(colsample)) if colsample < 1 else "all",
        minInstancesPerNode=max(1, min_child), seed=seed,
    )
    typed = df.withColumn(label, F.col(label).cast("double"))
    stages = _assembly(df, features)
    # The fit reads its rows several times: they are assembled once, and stay in their partitions, by which subsamples are drawn.
    vectors = PipelineModel(stages).transform(typed).select(label, VECTOR).persist()
    try:
        return PipelineModel([*stages, trees.fit(vectors)])
    finally:
        vectors.unpersist()


def scaling(df: DataFrame, features: Sequence[str]) -> tuple[int, StandardScalerModel]:
    """Number of rows and fitted scaler of a training part, which fits with other parameters can share."""
    scaler = StandardScaler(inputCol=VECTOR, outputCol="_scaled", withMean=True, withStd=True)
    return df.count(), scaler.fit(PipelineModel(_assembly(df, features)).transform(df))


def train_logit(
    df: DataFrame, features: Sequence[str], label: str = "encoded_label", c: float = 0.0, max_iter: int = 100,
    scaled: tuple[int, StandardScalerModel] | None = None,
) -> PipelineModel:
    """Standardised logistic regression with L2 penalty, C = 2 ** c; ``scaled`` is the ``scaling`` of ``df`` if it is known."""
    typed = df.withColumn(label, F.col(label).cast("double"))
    n, scaler = scaled or scaling(df, features)
    logit = LogisticRegression(
        featuresCol="_scaled", labelCol=label, regParam=1.0 / (2.0**c * max(1, n)), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter,
    )
    return Pipeline(stages=[*_assembly(df, features), scaler, logit]).fit(typed)


TRAINERS: dict[str, Callable[..., PipelineModel]] = {"boosted": train_boosted, "logit": train_logit}


def concurrently(jobs: Sequence[Callable[[], Any]], parallel: int, spark: SparkSession) -> list[Any]:
    """Results of jobs that run ``parallel`` at a time, each in a scheduler pool of its own."""
    if parallel < 2 or len(jobs) < 2:
        return [job() for job in jobs]
    batch = uuid.uuid4().hex[:8]

    def pooled(number: int) -> Any:
        def run() -> Any:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{batch}-{number % parallel}")
            return jobs[number]()
        return inheritable_thread_target(spark)(run)()

    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(pooled, range(len(jobs))))


def stage_partitions(df: DataFrame, by: Sequence[str], name: str = "buckets") -> DataFrame:
    """Write ``df`` once with a folder per value of ``by`` and read it back; filters on ``by`` read their folders alone.

    Rows are dealt by ``by`` and a salt of as many values as there are cores, so that folders get few
    files and a large bucket is still written by many tasks. Salts may meet in one task; the bound on the rows
    of a file lets the readers of a large folder share it evenly all the same.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    salts = max(1, int(spark.sparkContext.defaultParallelism))
    dealt = df.withColumn("_salt", row_salt(df, salts)).repartition(*[F.col(c) for c in by], F.col("_salt")).drop("_salt")
    dealt.write.partitionBy(*by).option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[F.col(quoted(c)) for c in df.columns])


def bucket_facts(train: DataFrame, bucket: str = "bucket", label: str = "encoded_label") -> DataFrame:
    """(bucket, n_train, n_classes, mean_label) of the training part."""
    return train.groupBy(bucket).agg(
        F.count("*").alias("n_train"), F.count_distinct(label).alias("n_classes"),
        F.avg(F.col(label).cast("double")).alias("mean_label"),
    )


def fallback_score(min_cases: int = 30) -> Column:
    """Score without a model: the mean label of a small bucket, the class of a one-class bucket, else null."""
    small = (F.col("n_train") < min_cases) & (F.col("n_train") > 0)
    return F.when(small, F.col("mean_label")).when(F.col("n_classes") < 2, F.col("mean_label"))


def fallback_predictor(
    scored: DataFrame, train: DataFrame, bucket: str = "bucket", label: str = "encoded_label",
    score: str = SCORE, min_cases: int = 30, default: float = 0.5, two_columns: bool = False,
) -> DataFrame:
    """Replace model scores where the bucket's training part is too small or of one class.

    Buckets without a training part get ``default``.
    """
    facts = bucket_facts(train, bucket, label).withColumn("_fallback", fallback_score(min_cases))
    # One row per bucket.
    joined = scored.join(F.broadcast(facts), bucket, "left")
    value = F.when(F.col("n_train").isNull(), F.lit(default)).otherwise(F.coalesce("_fallback", score))
    out = joined.withColumn(score, value).drop("n_train", "n_classes", "mean_label", "_fallback")
    return out.withColumn(f"{score}_negative", 1 - F.col(score)) if two_columns else out


@dataclass(frozen=True)
class BucketModels:
    """One fitted model per bucket with two classes, and what to answer elsewhere."""

    models: dict[Any, PipelineModel]
    constants: dict[Any, float]
    default: float

    def score(self, df: DataFrame, bucket: str = "bucket", out: str = SCORE) -> DataFrame:
        """Positive-class probability of every prefix, all buckets in one frame."""
        parts = []
        for b, model in self.models.items():
            parts.append(model_scorer(model, out)(df.where(F.col(bucket) == b)))
        rest = df
        if self.models:
            rest = df.where(F.col(bucket).isNull() | ~F.col(bucket).isin(list(self.models)))
        value = F.lit(float(self.default))
        for b, constant in self.constants.items():
            value = F.when(F.col(bucket) == b, F.lit(float(constant))).otherwise(value)
        parts.append(rest.withColumn(out, value))
        scored = parts[0]
        for p in parts[1:]:
            scored = scored.unionByName(p)
        return scored


def bucket_models(
    train: DataFrame, features: Sequence[str], method: str = "boosted", params: Mapping[Any, Mapping] | None = None,
    default: float = 0.5, bucket: str = "bucket", label: str = "encoded_label", parallel: int = 1,
) -> BucketModels:
    """Fit one model per bucket; ``params`` maps a bucket (or None for all) to trainer arguments.

    A one-class bucket answers with its class, a bucket unseen in training with ``default``
    (the class ratio). Buckets are few: one, or one per prefix length. Over a table of
    ``stage_partitions`` each fit reads the folder of its bucket alone; ``parallel`` fits run at a time.
    """
    constants, several = {}, []
    params = params or {}
    for r in bucket_facts(train, bucket, label).orderBy(bucket).collect():
        if r["n_classes"] < 2:
            constants[r[bucket]] = r["mean_label"]
        else:
            several.append(r[bucket])

    def fit(b: Any) -> PipelineModel:
        chosen = params.get(b, params.get(None, {}))
        return TRAINERS[method](train.where(F.col(bucket) == b), features, label, **chosen)

    fitted = concurrently([lambda b=b: fit(b) for b in several], parallel, train.sparkSession)
    return BucketModels(dict(zip(several, fitted)), constants, default)


def score_cases(models: BucketModels, test: DataFrame, keys: Sequence[str] = ("prefix_id", "bucket"), label: str = "encoded_label") -> DataFrame:
    """(keys, label, score) for all test prefixes at once."""
    return models.score(test).select(*keys, label, F.col("prefix_nr").alias("nr_events"), SCORE)


def search_space(method: str, trials: int, seed: int = 22) -> list[dict[str, float]]:
    """Seeded random trials over the tuning ranges."""
    rng = random.Random(seed)
    out = []
    for _ in range(trials):
        if method == "logit":
            out.append({"c": rng.uniform(-15, 15)})
            continue
        out.append({
            "learning_rate": rng.uniform(0, 1) or 0.5, "subsample": rng.uniform(0.5, 1),
            "max_depth": rng.randint(4, 30), "colsample": rng.uniform(0.5, 1),
            "min_child": rng.randint(1, 6),
        })
    return out


def cv_trials(
    encoded: DataFrame, features: Sequence[str], trials: Sequence[Mapping[str, float]], method: str = "logit",
    dataset: str = "log", encoding: str = "single_agg", fold: str = "fold", bucket: str = "bucket", label: str = "encoded_label",
    fixed: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Trial table (iter, dataset, cls, method, bucket, param, value, score).

    ``encoded`` carries the fold of every prefix; a fold is scored by models of the others.
    The score of a trial is the mean fold AUC, per bucket and, as bucket 0, over all rows.
    """
    folds = [r[0] for r in encoded.select(fold).distinct().orderBy(fold).collect()]
    tables = []
    for i, trial in enumerate(trials, 1):
        scored = None
        for k in folds:
            train, test = encoded.where(F.col(fold) != k), encoded.where(F.col(fold) == k)
            ratio = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
            fitted = bucket_models(train, features, method, {None: {**trial, **(fixed or {})}}, ratio or 0.0, bucket, label)
            part = fitted.score(test, bucket).select(fold, bucket, label, SCORE)
            scored = part if scored is None else scored.unionByName(part)
        each = auc(scored, SCORE, label, [bucket, fold], one_class=0.5).groupBy(bucket).agg(F.sum("auc").alias("_sum"))
        whole = auc(scored, SCORE, label, [fold]).agg(F.sum("auc").alias("_sum")).withColumn(bucket, F.lit(0).cast("long"))
        results = each.withColumn(bucket, F.col(bucket).cast("long")).unionByName(whole)
        params = F.array(*[F.struct(F.lit(p).alias("param"), F.lit(float(v)).alias("value")) for p, v in trial.items()])
        tables.append(results.withColumn("_p", F.explode(params)).select(
            F.lit(i).alias("iter"), F.lit(dataset).alias("dataset"), F.lit(method).alias("cls"),
            F.lit(encoding).alias("method"), bucket, "_p.param", "_p.value", (F.col("_sum") / len(folds)).alias("score"),
        ))
    table = tables[0]
    for t in tables[1:]:
        table = table.unionByName(t)
    return table


def best_params(trials: DataFrame, bucket: str = "bucket") -> DataFrame:
    """(dataset, cls, method, bucket, param, value, score) of the best trial of each bucket.

    The table has a few rows per trial.
    """
    keys = ["dataset", "cls", "method", bucket]
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "iter")
    first = trials.select(*keys, "iter", "score").distinct().withColumn("_at", F.row_number().over(w)).where(F.col("_at") == 1)
    return trials.join(first.select(*keys, "iter"), [*keys, "iter"]).select(*keys, "iter", "param", "value", "score")
