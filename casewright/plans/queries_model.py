"""Training, scoring, metrics and streaming as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import quoted
from ..functions.keyed import spread_join
from ..operators import encode as E
from ..operators import metrics as K
from ..operators import model as M
from ..operators.split import fold_numbers
from ..session import scratch_path, stage
from ..sources.tables import ORDERS, SESSIONS, orders_log, sessions_log
from ..streaming.ending_cases import score_ending_cases
from ..streaming.running_cases import score_running_cases
from . import oracle_parts as O
from .encoded import encoded_with_label
from .queries_profile import encoded_orders, rounded_columns
from .registry import query, rounded

r6 = O.r6
SCORED = f"""{O.ENCODED_SET}, scored AS (SELECT part, prefix_id, original_case_id, nr, y, round({O.score_sql()}, 6) AS s FROM enc)"""


def scored_orders(spark, d) -> DataFrame:
    """Encoded rows with the score of the closed-form model, rounded so that ties are stable."""
    rows = M.closed_form(O.WEIGHTS, O.BIAS)(encoded_orders(spark, d).rows)
    return rows.withColumn("score", F.round("score", 6)).withColumn("nr_events", F.col("prefix_nr"))


def auc_sql(source: str, by: str = "") -> str:
    """Pairwise definition by ranks with averaged ties."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}(sum(rk) FILTER (y = 1) - p * (p + 1) / 2) / nullif(p * q, 0) AS auc FROM (
      SELECT {keys}y, rank() OVER ({part}ORDER BY s) + (count(*) OVER (PARTITION BY {keys}s) - 1) / 2.0::DOUBLE AS rk,
        CAST(count(*) FILTER (y = 1) OVER ({part}) AS DOUBLE) AS p, CAST(count(*) FILTER (y <> 1) OVER ({part}) AS DOUBLE) AS q FROM {source}) GROUP BY {keys}p, q"""


@query(f"WITH {SCORED}, a AS ({auc_sql('scored')}) SELECT {r6('auc')} AS auc FROM a")
def auc(spark, d):
    return rounded_columns(K.auc(scored_orders(spark, d)), "auc")


@query(f"WITH {SCORED}, a AS ({auc_sql('scored', 'nr')}), b AS ({auc_sql('scored')}) SELECT nr AS nr_events, {r6('auc')} AS auc FROM a UNION ALL SELECT -1, {r6('auc')} FROM b")
def auc_by_prefix(spark, d):
    return rounded_columns(K.auc_by_prefix(scored_orders(spark, d)), "auc")


FOLDS = """c AS (SELECT case_id, max(label) AS label FROM log GROUP BY case_id),
f AS (SELECT case_id, (row_number() OVER (PARTITION BY label ORDER BY md5(case_id || '_22'), case_id) - 1
  + CASE WHEN label = 'regular' THEN (SELECT count(*) FROM c WHERE label = 'deviant') ELSE 0 END) % 3 AS fold FROM c)"""


@query(f"""WITH {SCORED}, {FOLDS}, x AS (SELECT nr AS bucket, fold, y, s FROM scored JOIN f ON f.case_id = original_case_id), a AS ({auc_sql('x', 'bucket, fold')})
SELECT bucket, {r6('sum(coalesce(auc, 0.5)) / 3')} AS auc FROM a GROUP BY bucket""")
def auc_by_bucket(spark, d):
    folds = fold_numbers(orders_log(spark, d), ORDERS, 3).withColumnRenamed("case_id", "original_case_id")
    rows = scored_orders(spark, d).drop("bucket").withColumn("bucket", F.col("prefix_nr"))
    return rounded_columns(K.auc_by_bucket(spread_join(rows, folds, "original_case_id")), "auc")


TIMINGS = """t AS (SELECT event_type AS dataset, 'single_agg' AS method, CASE WHEN user_id % 2 = 0 THEN 'boosted' ELSE 'logit' END AS cls,
  user_id % 3 AS n_iter, CASE WHEN event_id % 4 = 0 THEN 'offline' ELSE 'online' END AS kind, value AS seconds FROM events)"""


def timings(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.col("event_type").alias("dataset"), F.lit("single_agg").alias("method"),
        F.when(F.col("user_id") % 2 == 0, "boosted").otherwise("logit").alias("cls"), (F.col("user_id") % 3).alias("n_iter"),
        F.when(F.col("event_id") % 4 == 0, "offline").otherwise("online").alias("kind"), F.col("value").alias("seconds"),
    )


@query(f"""WITH {TIMINGS}, m AS (
SELECT dataset, method, cls, n_iter, 'online_time_average' AS metric, avg(seconds) AS score FROM t WHERE kind = 'online' GROUP BY ALL
UNION ALL SELECT dataset, method, cls, n_iter, 'online_time_standard', stddev_pop(seconds) FROM t WHERE kind = 'online' GROUP BY ALL
UNION ALL SELECT dataset, method, cls, n_iter, 'total_offline_time', sum(seconds) FROM t WHERE kind = 'offline' GROUP BY ALL
UNION ALL SELECT dataset, method, cls, -1, 'online_time_avg', avg(seconds) FROM t WHERE kind = 'online' GROUP BY ALL
UNION ALL SELECT dataset, method, cls, -1, 'online_time_std', stddev_pop(seconds) FROM t WHERE kind = 'online' GROUP BY ALL
UNION ALL SELECT dataset, method, cls, -1, 'offline_time_total_avg', avg(seconds) FROM t WHERE kind = 'offline' GROUP BY ALL
UNION ALL SELECT dataset, method, cls, -1, 'offline_time_total_std', stddev_pop(seconds) FROM t WHERE kind = 'offline' GROUP BY ALL)
SELECT dataset, method, cls, -1 AS nr_events, n_iter, metric, {r6('score')} AS score FROM m""")
def run_times(spark, d):
    return rounded_columns(K.run_times(timings(spark, d)), "score")


# --- fallbacks and models ----------------------------------------------------------------

@query(f"""WITH {SCORED}, tr AS (SELECT nr AS bucket, count(*) AS n, count(DISTINCT y) AS k, avg(y) AS m FROM scored WHERE part = 'training' GROUP BY nr)
SELECT prefix_id, {r6('CASE WHEN n IS NULL THEN 0.5 WHEN n < 400 THEN m WHEN k < 2 THEN m ELSE s END')} AS score,
 {r6('1 - CASE WHEN n IS NULL THEN 0.5 WHEN n < 400 THEN m WHEN k < 2 THEN m ELSE s END')} AS score_negative
FROM scored LEFT JOIN tr ON tr.bucket = nr WHERE part = 'testing'""")
def fallback_predictor(spark, d):
    rows = scored_orders(spark, d).drop("bucket").withColumn("bucket", F.col("prefix_nr"))
    got = M.fallback_predictor(
        rows.where(F.col("set") == "testing"), rows.where(F.col("set") == "training"), min_cases=400, two_columns=True
    )
    return rounded_columns(got.select("prefix_id", "score", "score_negative"), "score", "score_negative")


@query(f"""WITH {SCORED} SELECT nr AS bucket, count(*) AS n_train, count(DISTINCT y) AS n_classes, {r6('avg(y)')} AS mean_label,
{r6('CASE WHEN count(*) < 30 OR count(DISTINCT y) < 2 THEN avg(y) END')} AS fallback FROM scored WHERE part = 'training' GROUP BY nr""")
def bucket_models(spark, d):
    rows = scored_orders(spark, d).where(F.col("set") == "training").drop("bucket").withColumn("bucket", F.col("prefix_nr"))
    facts = M.bucket_facts(rows).withColumn("fallback", M.fallback_score(30))
    return rounded_columns(facts, "mean_label", "fallback")


def fitted_orders(spark, d, method: str, **params):
    es = encoded_orders(spark, d)
    rows = stage(es.rows, "encoded")
    features = es.features
    train = rows.where(F.col("set") == "training")
    return rows, features, M.bucket_models(train, features, method, {None: params})


SMALL_TREES = {"n_trees": 8, "max_depth": 3, "learning_rate": 0.2, "subsample": 0.8, "seed": 22}


@query()
def train_boosted(spark, d):
    """Scores of a small boosted model on all prefixes."""
    rows, _, models = fitted_orders(spark, d, "boosted", **SMALL_TREES)
    return models.score(rows).select("set", "prefix_id", "encoded_label", rounded("score").alias("score"))


@query()
def train_logit(spark, d):
    """Scores of the logistic model on all prefixes."""
    rows, _, models = fitted_orders(spark, d, "logit", c=-2.0, max_iter=50)
    return models.score(rows).select("set", "prefix_id", "encoded_label", rounded("score").alias("score"))


@query()
def score_cases(spark, d):
    """Test prefixes scored by one model per prefix length."""
    es = encoded_with_label(orders_log(spark, d, gaps=True), ORDERS, "agg", "prefix")
    rows = stage(es.rows, "encoded")
    models = M.bucket_models(rows.where(F.col("set") == "training"), es.features, "logit", {None: {"c": -2.0, "max_iter": 10}})
    return M.score_cases(models, rows.where(F.col("set") == "testing"))


@query()
def cv_trials(spark, d):
    """Seeded random search over two trials and three folds."""
    es = encoded_orders(spark, d)
    folds = fold_numbers(orders_log(spark, d), ORDERS, 3).withColumnRenamed("case_id", "original_case_id")
    rows = stage(spread_join(es.rows.where(F.col("set") == "training"), folds, "original_case_id"), "folds")
    return M.cv_trials(rows, es.features, M.search_space("logit", 2), "logit", "orders", fixed={"max_iter": 10})


TRIALS = """t AS (SELECT CAST(o_orderkey % 5 + 1 AS INT) AS iter, o_orderpriority AS dataset, 'logit' AS cls, 'prefix_index' AS method,
  CAST(month(o_orderdate) AS BIGINT) AS bucket, count(*) AS n, round(avg(o_totalprice), 4) AS score, sum(o_custkey) % 31 - 15 AS c FROM orders GROUP BY ALL)"""


@query(f"""WITH {TRIALS}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, cls, method, bucket ORDER BY score DESC, iter) AS k FROM t),
b AS (SELECT * FROM r WHERE k = 1)
SELECT dataset, cls, method, bucket, iter, 'C' AS param, CAST(c AS DOUBLE) AS value, score FROM b UNION ALL SELECT dataset, cls, method, bucket, iter, 'n', CAST(n AS DOUBLE), score FROM b""")
def best_params(spark, d):
    base = spark.read.parquet(f"{d}/orders.parquet").groupBy(
        (F.col("o_orderkey") % 5 + 1).cast("int").alias("iter"), F.col("o_orderpriority").alias("dataset"),
        F.month("o_orderdate").cast("long").alias("bucket"),
    ).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("score"), (F.sum("o_custkey") % 31 - 15).alias("c"))
    params = F.array(
        F.struct(F.lit("C").alias("param"), F.col("c").cast("double").alias("value")),
        F.struct(F.lit("n").alias("param"), F.col("n").cast("double").alias("value")),
    )
    trials = base.withColumn("p", F.explode(params)).select(
        "iter", "dataset", F.lit("logit").alias("cls"), F.lit("prefix_index").alias("method"), "bucket", "p.param", "p.value", "score"
    )
    return M.best_params(trials)


#: Events of a file of a replayed log at least, where its parts take several.
FILE_EVENTS = 250_000


# --- running cases -----------------------------------------------------------------------

RUNNING = {"agg__sum_value": 0.001, "agg__std_value": 0.01, "agg__activity_click": 0.1}


@query(f"""WITH {O.SESSIONS_GAPS}, e AS (SELECT case_id, coalesce(sum(value), 0) AS "agg__sum_value", coalesce(stddev_samp(value), 0) AS "agg__std_value",
  count(*) FILTER (activity = 'click') AS "agg__activity_click" FROM log GROUP BY case_id)
SELECT case_id, {r6(O.score_sql(RUNNING, -1.0))} AS score FROM e""", "score_running_cases")
def score_running_cases_query(spark, d):
    """Replay the sessions log as a stream of files; the last score of each case."""
    log = sessions_log(spark, d, gaps=True)
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    source, out = scratch_path(spark, "stream"), scratch_path(spark, "scores")
    log.repartitionByRange(3, "ts").write.parquet(source)
    model = E.fit("agg", log, SESSIONS, case="case_id")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def sink(scores: DataFrame, number: int) -> None:
        scores.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    # All files count, whatever their order, so the limit for late events spans the log.
    scorer = M.closed_form(RUNNING, -1.0)
    score_running_cases(stream, SESSIONS, model, scorer, sink, scratch_path(spark, "progress"), "3650 days").awaitTermination()
    scores = spark.read.parquet(out)
    return scores.groupBy("case_id").agg(rounded(F.max_by("score", "batch")).alias("score"))


@query(f"""WITH {O.SESSIONS_GAPS}, e AS (SELECT case_id, max(ts) AS last, coalesce(sum(value), 0) AS "agg__sum_value", coalesce(stddev_samp(value), 0) AS "agg__std_value",
  count(*) FILTER (activity = 'click') AS "agg__activity_click", count(*) AS events FROM log GROUP BY case_id)
SELECT case_id, events, last + INTERVAL 7 DAY <= (SELECT max(ts) FROM log) - INTERVAL 2 HOUR AS final, {r6(O.score_sql(RUNNING, -1.0))} AS score FROM e""", "score_ending_cases")
def score_ending_cases_query(spark, d):
    """Replay the sessions log in order of time; the last score of each case and whether it has ended."""
    log = stage(sessions_log(spark, d, gaps=True).withColumn("ts", F.col("ts").cast("timestamp")), "sessions")
    source, out = scratch_path(spark, "stream"), scratch_path(spark, "scores")
    low, high = log.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    # Files come in the order in which they are written.
    part = F.least(F.lit(3), F.floor((F.unix_micros("ts") - low) * 4 / max(1, high - low))).cast("int")
    # Each part has as many files; rows are dealt in turn, so that none of them is left without rows.
    sizes = {r["part"]: r["count"] for r in log.groupBy(part.alias("part")).count().collect()}
    files = max(1, min(int(spark.sparkContext.defaultParallelism), *(sizes.get(k, 0) // FILE_EVENTS for k in range(4))))
    for k in range(4):
        own = log.where(part == k)
        (own.repartition(files) if files > 1 else own.coalesce(1)).write.mode("append").parquet(source)
    model = E.fit("agg", log, SESSIONS, case="case_id")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(source)

    def sink(scores: DataFrame, number: int) -> None:
        scores.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    scorer = M.closed_form(RUNNING, -1.0)
    score_ending_cases(stream, SESSIONS, model, scorer, sink, scratch_path(spark, "progress"), "7 days", "2 hours").awaitTermination()
    last = F.struct("final", "batch")
    return spark.read.parquet(out).groupBy("case_id").agg(
        F.max("events").alias("events"), F.max("final").alias("final"), rounded(F.max_by("score", last)).alias("score")
    )
