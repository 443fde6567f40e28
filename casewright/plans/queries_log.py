"""Sources, preparation, splits, prefixes, buckets and encoders as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import quoted, to_long
from ..operators import bucket as B
from ..operators import encode as E
from ..operators import prefix as P
from ..operators import prepare as R
from ..operators import sparse as Z
from ..operators import split as S
from ..session import scratch_path
from ..sources import artefacts as A
from ..sources.logs import read_event_log
from ..sources.tables import LINES, ORDERS, SESSIONS, lines_log, orders_log, sessions_log
from . import oracle_parts as O
from .encoded import catalogue, encoded_with_label
from .registry import query, rounded, stamp

LOG_COLUMNS = ["case_id", "event_id", "activity", "resource", "totalprice", "segment", "nation", "acctbal", "label"]
LOG_SQL = "case_id, event_id, activity, resource, totalprice, segment, nation, acctbal, label"


def full_log(df: DataFrame) -> DataFrame:
    return df.select(*LOG_COLUMNS, stamp("ts").alias("ts"))


FULL_SQL = f"SELECT {LOG_SQL}, epoch_us(ts) AS ts"


# --- sources and sinks -------------------------------------------------------------------

@query(f"WITH {O.ORDERS_GAPS} {FULL_SQL} FROM log")
def read_event_log_csv(spark, d):
    log, path = orders_log(spark, d, gaps=True), scratch_path(spark, "log")
    log.write.option("sep", ";").option("header", True).option("encoding", "ISO-8859-1").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return full_log(read_event_log(spark, ORDERS, path).withColumn("event_id", F.col("event_id").cast("long")))


@query(f"WITH {O.ORDERS_GAPS} {FULL_SQL} FROM log", "read_event_log")
def read_event_log_parquet(spark, d):
    path = scratch_path(spark, "log")
    orders_log(spark, d, gaps=True).write.parquet(path)
    return full_log(read_event_log(spark, ORDERS, path, "parquet"))


@query(f"WITH {O.SESSIONS_GAPS} SELECT case_id, event_id, activity, resource, value, segment, acctbal, label, epoch_us(ts) AS ts FROM log")
def sessions_event_log(spark, d):
    return sessions_log(spark, d, gaps=True).select(
        "case_id", "event_id", "activity", "resource", "value", "segment", "acctbal", "label", stamp("ts").alias("ts")
    )


@query(f"WITH {O.LINES} SELECT case_id, activity, count(*) AS n, {O.r6('sum(extendedprice)', 2)} AS price, min(epoch_us(ts)) AS first_ts, max(label) AS label, max(priority) AS priority FROM log GROUP BY case_id, activity")
def lines_event_log(spark, d):
    return lines_log(spark, d).groupBy("case_id", "activity").agg(
        F.count("*").alias("n"), rounded(F.sum("extendedprice"), 2).alias("price"), F.min(stamp("ts")).alias("first_ts"),
        F.max("label").alias("label"), F.max("priority").alias("priority"),
    )


def stored_sets(spark, d) -> str:
    """Encoded sets of the orders log, written as a partitioned table."""
    es = encoded_with_label(orders_log(spark, d, gaps=True), ORDERS)
    path = scratch_path(spark, "sets")
    keyed = es.rows.withColumn("dataset", F.lit("orders")).withColumn("method", F.lit("single_agg")).withColumn("prefix_length", F.lit(1))
    for _ in range(2):  # a repeated run replaces its set
        A.write_encoded(keyed, path, "replace")
    return path


@query(f"WITH {O.ENCODED_SET} SELECT prefix_id, y AS encoded_label, {O.r6(O.q('agg__sum_totalprice'))} AS total FROM enc WHERE part = 'training'")
def read_artefact(spark, d):
    rows = A.read_artefact(spark, stored_sets(spark, d), dataset="orders", method="single_agg", set="training")
    return rows.select("prefix_id", "encoded_label", rounded("agg__sum_totalprice").alias("total"))


def _corr_sql(source: str, kinds: dict[str, list[str]], label: str = "y") -> str:
    parts = []
    for kind, features in kinds.items():
        names = features + ["encoded_label"]
        col = {n: (label if n == "encoded_label" else O.q(n)) for n in names}
        for a in names:
            for b in names:
                r = f"corr(CAST({col[a]} AS DOUBLE), CAST({col[b]} AS DOUBLE))"
                parts.append(f"SELECT '{kind}' AS kind, '{a}' AS feature_a, '{b}' AS feature_b, CASE WHEN isnan({r}) THEN NULL ELSE {r} END AS r FROM {source}")
    return " UNION ALL ".join(parts)


@query(f"WITH {O.ENCODED_SET} SELECT kind, feature_a, feature_b, {O.r6('r', 3)} AS r FROM ({_corr_sql('enc', {'num': O.NUMERIC[1:3], 'cat': O.COUNTS[:2]})})")
def read_correlations(spark, d):
    es = encoded_with_label(orders_log(spark, d, gaps=True), ORDERS)
    table = A.correlation_table(es.rows, {"num": O.NUMERIC[1:3], "cat": O.COUNTS[:2]})
    path = scratch_path(spark, "corr")
    table.withColumn("dataset", F.lit("orders")).write.partitionBy("dataset", "kind").parquet(path)
    cat, num = A.read_correlations(spark.read.parquet(path), dataset="orders")
    both = cat.withColumn("kind", F.lit("cat")).unionByName(num.withColumn("kind", F.lit("num")))
    return both.select("kind", "feature_a", "feature_b", rounded("r", 3).alias("r"))


def lines_catalogue(spark, d) -> DataFrame:
    """One catalogue row per log of a priority, method, set and prefix length of the lines log."""
    heads = P.case_heads(lines_log(spark, d), LINES, 10)
    sets = heads.select(
        F.col("priority").alias("dataset"), F.explode(F.array(F.lit("single_agg"), F.lit("prefix_index"))).alias("method"),
        F.when(F.col("label") == "deviant", "testing").otherwise("training").alias("dataset_type"), F.col("pos").alias("prefix_length"),
    )
    return sets.groupBy("dataset", "method", "dataset_type", "prefix_length").agg(
        F.count("*").alias("bucket_size"), (3 + 2 * F.col("prefix_length")).cast("long").alias("feature_num")
    )


LINES_CATALOGUE = f"""{O.LINES},
heads AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {O.ORDER_LINE}) AS pos FROM log),
catalogue AS (
  SELECT priority AS dataset, method, CASE WHEN label = 'deviant' THEN 'testing' ELSE 'training' END AS dataset_type, pos AS prefix_length,
         count(*) AS bucket_size, 3 + 2 * pos AS feature_num
  FROM heads, (VALUES ('single_agg'), ('prefix_index')) m(method) WHERE pos <= 10 GROUP BY ALL)"""
CATALOGUE_COLUMNS = "dataset, method, dataset_type, prefix_length, bucket_size, feature_num"


@query(f"""WITH {LINES_CATALOGUE} SELECT {CATALOGUE_COLUMNS} FROM catalogue WHERE dataset_type = 'training' AND (
  (method = 'single_agg' AND dataset IN ('1-URGENT', '2-HIGH')) OR (method = 'prefix_index' AND dataset = '5-LOW' AND prefix_length IN (1, 6, 11, 16, 21, 26, 31, 36)))""")
def list_encoded_sets(spark, d):
    return A.list_encoded_sets(lines_catalogue(spark, d), {"single_agg": ["1-URGENT", "2-HIGH"], "prefix_index": ["5-LOW"]})


@query(f"WITH {O.ENCODED_SET} SELECT part AS \"set\", count(*) AS n, sum(y) AS positive FROM enc GROUP BY part")
def write_encoded(spark, d):
    rows = spark.read.parquet(stored_sets(spark, d))
    return rows.groupBy("set").agg(F.count("*").alias("n"), F.sum("encoded_label").alias("positive"))


@query(f"""WITH {O.ENCODED_SET}, w AS (SELECT {len(O.static_columns()) + len(O.agg_columns())} AS feature_num)
SELECT 'orders' AS dataset, 'single_agg' AS method, part AS dataset_type, count(*) AS bucket_size, min(nr) AS prefix_length, max(feature_num) AS feature_num FROM enc, w GROUP BY part""")
def write_catalogue(spark, d):
    es = encoded_with_label(orders_log(spark, d, gaps=True), ORDERS)
    path = scratch_path(spark, "catalogue")
    for _ in range(2):
        A.write_catalogue(catalogue(es, "orders", "single_agg"), path, "replace")
    return spark.read.parquet(path)


@query(f"WITH {O.ORDERS} SELECT activity AS metric, count(*) AS n, {O.r6('avg(totalprice)')} AS score FROM log GROUP BY activity UNION ALL SELECT 'all', count(*), {O.r6('avg(totalprice)')} FROM log")
def write_metrics(spark, d):
    log, path = orders_log(spark, d), scratch_path(spark, "metrics")
    stats = [F.count("*").alias("n"), rounded(F.avg("totalprice")).alias("score")]
    for _ in range(2):
        A.write_metrics([log.groupBy(F.col("activity").alias("metric")).agg(*stats), log.groupBy(F.lit("all").alias("metric")).agg(*stats)], path, mode="replace")
    return spark.read.parquet(path).drop("run")


@query(f"WITH {O.ORDERS} SELECT activity, resource, count(*) AS n FROM log GROUP BY ALL")
def write_matrix(spark, d):
    path = scratch_path(spark, "matrix")
    A.write_matrix(orders_log(spark, d).groupBy("activity", "resource").agg(F.count("*").alias("n")), path)
    return spark.read.option("sep", ";").option("header", True).schema("activity string, resource string, n long").csv(path)


# --- preparation -------------------------------------------------------------------------

@query(f"WITH {O.ORDERS} SELECT event_id, CASE WHEN label = 'deviant' THEN 1 ELSE 0 END AS encoded_label FROM log")
def encode_label(spark, d):
    return R.encode_label(orders_log(spark, d), ORDERS).select("event_id", "encoded_label")


@query(f"WITH {O.SESSIONS} SELECT case_id, max(CASE WHEN label = 'deviant' THEN 1 ELSE 0 END) AS encoded_label FROM log GROUP BY case_id")
def case_label(spark, d):
    return R.case_label(sessions_log(spark, d), SESSIONS)


@query(f"""WITH {O.SESSIONS_GAPS}, a AS (SELECT activity, row_number() OVER (ORDER BY activity) - 1 AS c FROM (SELECT DISTINCT activity FROM log)),
b AS (SELECT resource, row_number() OVER (ORDER BY resource) - 1 AS c FROM (SELECT DISTINCT resource FROM log WHERE resource IS NOT NULL))
SELECT event_id, a.c AS activity_code, coalesce(b.c, -1) AS resource_code FROM log LEFT JOIN a USING (activity) LEFT JOIN b USING (resource)""")
def ordinal_codes(spark, d):
    coded = R.ordinal_codes(sessions_log(spark, d, gaps=True), ["activity", "resource"])
    return coded.select("event_id", "activity_code", "resource_code")


@query(f"""WITH {O.SESSIONS_GAPS} SELECT case_id, max(acctbal) AS acctbal, max(segment) AS segment, max(CASE WHEN label = 'deviant' THEN 1 ELSE 0 END) AS encoded_label,
arg_min(resource, (ts, activity, event_id)) FILTER (resource IS NOT NULL) AS resource FROM log GROUP BY case_id""")
def static_view(spark, d):
    from dataclasses import replace
    schema = replace(SESSIONS, static_cat=("segment", "resource"))
    return R.static_view(sessions_log(spark, d, gaps=True), schema)


@query(f"WITH {O.ORDERS_GAPS} SELECT totalprice, activity, resource, case_id, epoch_us(ts) AS ts, CASE WHEN label = 'deviant' THEN 1 ELSE 0 END AS encoded_label FROM log")
def dynamic_view(spark, d):
    return R.dynamic_view(orders_log(spark, d, gaps=True), ORDERS).withColumn("ts", stamp("ts"))


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def drop_constant(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", "o_totalprice", "o_orderpriority", F.lit("same").alias("origin"), F.lit(1).alias("version")
    )
    return R.drop_constant(rows)


@query(f"WITH {O.ORDERS} SELECT event_id, case_id, CASE WHEN case_id IN (SELECT case_id FROM log WHERE resource = 'P') THEN 'in' ELSE 'out' END AS side FROM log")
def filter_cases(spark, d):
    log = orders_log(spark, d)
    cases = log.where(F.col("resource") == "P")
    inside = R.filter_cases(log, ORDERS, cases).select("event_id", "case_id", F.lit("in").alias("side"))
    return inside.unionByName(R.filter_cases(log, ORDERS, cases, keep=False).select("event_id", "case_id", F.lit("out").alias("side")))


@query(f"WITH {O.LINES} SELECT DISTINCT case_id FROM log")
def case_index(spark, d):
    return R.case_index(lines_log(spark, d), LINES)


PREFIXES_O = f"{O.ORDERS_GAPS}, {O.longest()}, {O.prefixes('log', 'pre')}"


def order_prefixes(spark, d, gaps: bool = True) -> DataFrame:
    log = orders_log(spark, d, gaps)
    return P.generate_prefixes(log, ORDERS, 1, P.max_prefix_rule(log, ORDERS))


@query(f"WITH {PREFIXES_O} SELECT DISTINCT prefix_id, CASE WHEN nr > 1 THEN case_id ELSE prefix_id END AS original_case_id FROM pre WHERE nr > 1")
def original_case_ids(spark, d):
    ids = order_prefixes(spark, d).where(F.col("prefix_nr") > 1).select("prefix_id").distinct()
    return R.original_case_ids(ids, "prefix_id", nr_events=2)


@query(f"WITH {PREFIXES_O} SELECT prefix_id, max(nr) AS prefix_nr FROM pre GROUP BY prefix_id")
def prefix_lengths(spark, d):
    return R.prefix_lengths(order_prefixes(spark, d), ORDERS)


SELECT_SETS = f"""WITH {LINES_CATALOGUE}, s AS (SELECT *, count(*) OVER (PARTITION BY dataset, method) AS sets,
  CASE WHEN method = 'single_agg' OR dataset = '3-MEDIUM' THEN 1 ELSE 5 END AS gap FROM catalogue WHERE dataset_type = 'training')
SELECT dataset, method, prefix_length, bucket_size, feature_num FROM s WHERE (prefix_length - 1) % gap = 0 AND prefix_length <= sets"""


@query(SELECT_SETS + " AND bucket_size > 500")
def select_encoded_sets(spark, d):
    training, _ = R.split_catalogue(lines_catalogue(spark, d))
    return R.select_encoded_sets(training, dense_logs=("3-MEDIUM",))


@query(SELECT_SETS)
def select_encoded_sets_any_size(spark, d):
    training, _ = R.split_catalogue(lines_catalogue(spark, d))
    return R.select_encoded_sets(training, min_size=None, dense_logs=("3-MEDIUM",))


@query(f"WITH {LINES_CATALOGUE} SELECT dataset, method, prefix_length, bucket_size, feature_num, dataset_type = 'training' AS is_training FROM catalogue")
def split_train_test_catalogue(spark, d):
    training, rest = R.split_catalogue(lines_catalogue(spark, d))
    return training.withColumn("is_training", F.lit(True)).unionByName(rest.withColumn("is_training", F.lit(False)))


# --- splits and sampling -----------------------------------------------------------------

def both_parts(parts: S.Parts, columns: list[str]) -> DataFrame:
    return parts.train.select(*columns, F.lit("train").alias("part")).unionByName(parts.test.select(*columns, F.lit("test").alias("part")))


TWO = "SELECT event_id, case_id, 'train' AS part FROM train UNION ALL SELECT event_id, case_id, 'test' FROM test"


@query(f"WITH {O.ORDERS}, {O.split()} {TWO}")
def temporal_split(spark, d):
    return both_parts(S.temporal_split(orders_log(spark, d), ORDERS), ["event_id", "case_id"])


@query(f"WITH {O.SESSIONS}, {O.split()} {TWO}")
def temporal_split_sessions(spark, d):
    return both_parts(S.temporal_split(sessions_log(spark, d), SESSIONS), ["event_id", "case_id"])


@query(f"WITH {O.LINES}, {O.split()} SELECT case_id, linenumber, partkey, 'train' AS part FROM train UNION ALL SELECT case_id, linenumber, partkey, 'test' FROM test")
def temporal_split_lines(spark, d):
    return both_parts(S.temporal_split(lines_log(spark, d), LINES), ["case_id", "linenumber", "partkey"])


@query(f"""WITH {O.ORDERS}, starts AS (SELECT case_id, min(ts) AS s FROM log GROUP BY case_id),
ranked AS (SELECT case_id, row_number() OVER (ORDER BY s, case_id) AS rk, count(*) OVER () AS n FROM starts)
SELECT event_id, case_id, CASE WHEN rk > n - CAST(floor(0.25::DOUBLE * n) AS BIGINT) THEN 'test' ELSE 'train' END AS part FROM log JOIN ranked USING (case_id)""")
def val_split_temporal(spark, d):
    return both_parts(S.val_split_temporal(orders_log(spark, d), ORDERS, 0.25), ["event_id", "case_id"])


@query(f"""WITH {O.ORDERS}, ranked AS (SELECT case_id, row_number() OVER (ORDER BY md5(case_id || '_22'), case_id) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT case_id FROM log))
SELECT event_id, case_id, CASE WHEN rk > n - CAST(floor(0.25::DOUBLE * n) AS BIGINT) THEN 'test' ELSE 'train' END AS part FROM log JOIN ranked USING (case_id)""")
def val_split_random(spark, d):
    return both_parts(S.val_split_random(orders_log(spark, d), ORDERS, 0.25), ["event_id", "case_id"])


@query(f"""WITH {O.SESSIONS}, c AS (SELECT case_id, max(label) AS label FROM log GROUP BY case_id),
f AS (SELECT case_id, (row_number() OVER (PARTITION BY label ORDER BY md5(case_id || '_22'), case_id) - 1
  + CASE WHEN label = 'regular' THEN (SELECT count(*) FROM c WHERE label = 'deviant') ELSE 0 END) % 5 AS fold FROM c)
SELECT event_id, case_id, fold FROM log JOIN f USING (case_id)""")
def stratified_folds(spark, d):
    return S.stratified_folds(sessions_log(spark, d), SESSIONS).select("event_id", "case_id", "fold")


@query(f"WITH {O.ORDERS} SELECT {O.r6('avg(CASE WHEN label = ' + chr(39) + 'deviant' + chr(39) + ' THEN 1.0 ELSE 0.0 END)')} AS class_ratio FROM log")
def class_ratio(spark, d):
    return S.class_ratio(orders_log(spark, d), ORDERS).select(rounded("class_ratio").alias("class_ratio"))


@query(f"SELECT {O.r6('count(*) FILTER (event_type = ' + chr(39) + 'click' + chr(39) + ') / count(*)')} AS label_share FROM events")
def label_share(spark, d):
    return S.label_share(spark.read.parquet(f"{d}/events.parquet"), "event_type", "click").select(rounded("label_share").alias("label_share"))


@query(f"""WITH {PREFIXES_O}, c AS (SELECT prefix_id, max(nr) AS bucket, max(CASE WHEN label = 'deviant' THEN 1 ELSE 0 END) AS y FROM pre GROUP BY prefix_id)
SELECT bucket, count(*) AS n_rows, {O.r6('avg(y)')} AS share_positive, avg(y) > 0.1 OR 1 - avg(y) > 0.1 AS explain FROM c GROUP BY bucket""")
def explain_gate(spark, d):
    labelled = R.case_label(order_prefixes(spark, d), ORDERS.with_case("prefix_id"))
    sized = labelled.join(B.prefix_sizes(order_prefixes(spark, d)).withColumnRenamed("size", "bucket"), "prefix_id")
    return S.explain_gate(sized).withColumn("share_positive", rounded("share_positive"))


def _nth_sql(positional: bool) -> str:
    first, second, every, repeat = (25, 125, 5, 250) if positional else (1000, 10000, 20, 10000)
    return f"""WITH {O.LINES}, c AS (SELECT case_id, max(priority) AS bucket FROM log GROUP BY case_id),
n AS (SELECT case_id, bucket, 99 + row_number() OVER (PARTITION BY bucket ORDER BY case_id) AS case_nr FROM c)
SELECT case_id, bucket, case_nr, case_nr % {every} = 0 AS explain, case_nr % {second} = 0 AS explain_more, case_nr % {every} = 0 AND case_nr % {repeat} = 0 AS stable
FROM n WHERE case_nr % {first} = 0"""


@query(_nth_sql(True))
def every_nth_case(spark, d):
    return S.every_nth_case(lines_log(spark, d), "case_id", "priority", positional=True).withColumnRenamed("priority", "bucket")


@query(_nth_sql(False))
def every_nth_case_aggregate(spark, d):
    return S.every_nth_case(lines_log(spark, d), "case_id", "priority", positional=False).withColumnRenamed("priority", "bucket")


@query(f"WITH {O.ORDERS} SELECT event_id, case_id FROM log WHERE case_id IN (SELECT DISTINCT case_id FROM log ORDER BY case_id LIMIT 50)")
def first_n_cases(spark, d):
    return S.first_n_cases(orders_log(spark, d), ORDERS, 50).select("event_id", "case_id")


# --- prefixes and buckets ----------------------------------------------------------------

@query(f"WITH {O.SESSIONS} SELECT CAST(ceil(quantile_cont(n, 0.9)) AS BIGINT) AS length_quantile FROM (SELECT count(*) AS n FROM log WHERE label = 'deviant' GROUP BY case_id)")
def pos_length_quantile(spark, d):
    return P.pos_length_quantile(sessions_log(spark, d), SESSIONS)


@query(f"WITH {O.ORDERS}, {O.longest()} SELECT m AS max_prefix FROM mx")
def max_prefix_rule(spark, d):
    log = orders_log(spark, d)
    return log.groupBy().agg(F.lit(P.max_prefix_rule(log, ORDERS)).alias("max_prefix"))


@query(f"WITH {O.LINES} SELECT case_id, linenumber, partkey, count(*) OVER (PARTITION BY case_id) AS case_length FROM log")
def case_length(spark, d):
    return P.case_length(lines_log(spark, d), LINES).select("case_id", "linenumber", "partkey", "case_length")


PREFIX_COLUMNS = "prefix_id, original_case_id, event_id, pos, prefix_nr, case_length"


@query(f"WITH {PREFIXES_O} SELECT {PREFIX_COLUMNS} FROM pre")
def generate_prefixes(spark, d):
    return order_prefixes(spark, d).select(*PREFIX_COLUMNS.split(", "))


@query(f"WITH {O.SESSIONS}, {O.prefixes('log', 'pre', low=2, gap=3, top='20')} SELECT {PREFIX_COLUMNS} FROM pre")
def generate_prefixes_gap(spark, d):
    return P.generate_prefixes(sessions_log(spark, d), SESSIONS, 2, 20, 3).select(*PREFIX_COLUMNS.split(", "))


@query(f"WITH {PREFIXES_O} SELECT DISTINCT prefix_id, 1 AS bucket FROM pre")
def bucket_single(spark, d):
    return B.get_bucketer("single")(order_prefixes(spark, d))


SPLIT_PREFIXES = f"{O.ORDERS_GAPS}, {O.longest()}, {O.split()}, {O.prefixes('train', 'ptr')}, {O.prefixes('test', 'pte')}"


@query(f"""WITH {SPLIT_PREFIXES}, fitted AS (SELECT DISTINCT count(*) AS size FROM ptr GROUP BY prefix_id),
s AS (SELECT prefix_id, count(*) AS size FROM pte GROUP BY prefix_id)
SELECT prefix_id, size, (SELECT max(f.size) FROM fitted f WHERE f.size <= s.size) AS bucket FROM s""")
def bucket_prefix_length(spark, d):
    log = orders_log(spark, d, gaps=True)
    longest = P.max_prefix_rule(log, ORDERS)
    train, test = S.temporal_split(log, ORDERS)
    fitted = B.fit_sizes(P.generate_prefixes(train, ORDERS, 1, longest))
    return B.get_bucketer("prefix")(P.generate_prefixes(test, ORDERS, 1, longest), fitted=fitted)


# --- encoders ----------------------------------------------------------------------------

def _rounded_features(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[rounded(F.col(quoted(c)), O.digits_of(c)).alias(c) for c in df.columns if c not in keys])


@query(f"WITH {PREFIXES_O} SELECT prefix_id, {O.feature_list(O.static_columns(''))} FROM pre GROUP BY prefix_id")
def encode_static(spark, d):
    pre = order_prefixes(spark, d)
    return _rounded_features(E.encode(pre, ORDERS, E.fit("static", pre, ORDERS)), ["prefix_id"])


@query(f"WITH {PREFIXES_O} SELECT prefix_id, {O.feature_list(O.agg_columns(''))} FROM pre GROUP BY prefix_id")
def encode_agg(spark, d):
    pre = order_prefixes(spark, d)
    return _rounded_features(E.encode(pre, ORDERS, E.fit("agg", pre, ORDERS)), ["prefix_id"])


@query(f"WITH {PREFIXES_O} SELECT prefix_id, {O.feature_list(O.agg_columns('', presence=True))} FROM pre GROUP BY prefix_id")
def encode_bool(spark, d):
    pre = order_prefixes(spark, d)
    return _rounded_features(E.encode(pre, ORDERS, E.fit("bool", pre, ORDERS)), ["prefix_id"])


LONGEST = 14  # longest prefix of the orders log at every scale of the test tables


def index_columns(n: int, prefix: str = "", cat=(("activity", O.ACTIVITIES), ("resource", O.STATUSES)), num=("totalprice",)) -> list[tuple[str, str]]:
    out = [(f"{prefix}{c}_{i}", f"coalesce(max({c}) FILTER (pos = {i + 1}), 0)") for i in range(n) for c in num]
    out += [(f"{prefix}{c}_{i}_{v}", f"count(*) FILTER (pos = {i + 1} AND {c} = '{v}')") for c, levels in cat for i in range(n) for v in levels]
    return out


@query(f"WITH {PREFIXES_O} SELECT prefix_id, {O.feature_list(index_columns(LONGEST))} FROM pre GROUP BY prefix_id")
def encode_index(spark, d):
    pre = order_prefixes(spark, d)
    return _rounded_features(E.encode(pre, ORDERS, E.fit("index", pre, ORDERS)), ["prefix_id"])


@query(f"""WITH {PREFIXES_O}, w AS (SELECT prefix_id, {O.feature_list(index_columns(LONGEST))} FROM pre GROUP BY prefix_id)
SELECT prefix_id, feature, value FROM (UNPIVOT w ON COLUMNS(* EXCLUDE (prefix_id)) INTO NAME feature VALUE value) WHERE value <> 0""")
def encode_index_long(spark, d):
    pre = order_prefixes(spark, d)
    return E.encode_index_long(pre, ORDERS).withColumn("value", rounded("value"))


@query(f"WITH {PREFIXES_O} {O.encoded('pre')}")
def encode_union(spark, d):
    pre = order_prefixes(spark, d)
    models = [E.fit(k, pre, ORDERS) for k in ("static", "agg")]
    return _rounded_features(E.encode(pre, ORDERS, models), ["prefix_id"])


@query(f"WITH {PREFIXES_O} SELECT prefix_id, {O.feature_list([c for c in O.agg_columns('') if '_std' not in c[0] and 'std_' not in c[0]])}, 0.0::DOUBLE AS unseen FROM pre GROUP BY prefix_id")
def align_columns(spark, d):
    pre = order_prefixes(spark, d)
    model = E.fit("agg", pre, ORDERS)
    fitted = [c for c in model.columns if not c.startswith("std_")] + ["unseen"]
    return _rounded_features(E.align_columns(E.encode(pre, ORDERS, model), fitted, ["prefix_id"]), ["prefix_id"])


@query(f"WITH {O.ORDERS_GAPS} SELECT event_id, coalesce(totalprice, 0) AS totalprice, coalesce(acctbal, 0) AS acctbal FROM log")
def fill_zero(spark, d):
    return E.fill_zero(orders_log(spark, d, gaps=True).select("event_id", "totalprice", "acctbal"), ["totalprice", "acctbal"])


FLAG = f"""WITH {SPLIT_PREFIXES}, e AS (
SELECT 'training' AS "set", prefix_id, original_case_id, max(nr) AS prefix_nr, 1 AS bucket, CASE WHEN min(label) = 'deviant' THEN 1 ELSE 0 END AS encoded_label, {O.feature_list(O.static_columns() + O.agg_columns())} FROM ptr GROUP BY prefix_id, original_case_id
UNION ALL
SELECT 'testing', prefix_id, original_case_id, max(nr), 1, CASE WHEN min(label) = 'deviant' THEN 1 ELSE 0 END, {O.feature_list(O.static_columns() + O.agg_columns())} FROM pte GROUP BY prefix_id, original_case_id)
SELECT * FROM e"""
SET_KEYS = ["set", "prefix_id", "original_case_id", "prefix_nr", "bucket", "encoded_label"]


@query(FLAG, "encoded_with_label")
def encoded_single(spark, d):
    es = encoded_with_label(orders_log(spark, d, gaps=True), ORDERS)
    return _rounded_features(es.rows, SET_KEYS)


# Bucket by prefix length in long form: features of a bucket are those its training part shows.
POSITIONAL = f"""WITH {SPLIT_PREFIXES},
fitted AS (SELECT DISTINCT nr AS size FROM ptr),
allp AS (SELECT 'training' AS part, * EXCLUDE (case_length), nr AS bucket FROM ptr
         UNION ALL SELECT 'testing', * EXCLUDE (case_length), (SELECT max(size) FROM fitted WHERE size <= nr) FROM pte),
ev AS (
  SELECT part, prefix_id, bucket, 'index__totalprice_' || CAST(pos - 1 AS VARCHAR) AS feature, totalprice AS value FROM allp WHERE pos <= bucket
  UNION ALL SELECT part, prefix_id, bucket, 'index__activity_' || CAST(pos - 1 AS VARCHAR) || '_' || activity, 1.0 FROM allp
  UNION ALL SELECT part, prefix_id, bucket, 'index__resource_' || CAST(pos - 1 AS VARCHAR) || '_' || resource, 1.0 FROM allp
  UNION ALL SELECT part, prefix_id, bucket, 'static__acctbal', acctbal FROM allp WHERE pos = 1
  UNION ALL SELECT part, prefix_id, bucket, 'static__segment_' || segment, 1.0 FROM allp WHERE pos = 1
  UNION ALL SELECT part, prefix_id, bucket, 'static__nation_' || nation, 1.0 FROM allp WHERE pos = 1),
vocab AS (SELECT DISTINCT bucket, feature FROM ev WHERE part = 'training')
SELECT ev.part AS "set", prefix_id, ev.bucket, ev.feature, {O.r6('value')} AS value
FROM ev JOIN vocab USING (bucket, feature) WHERE value <> 0"""


@query(POSITIONAL)
def encoded_with_label_positional(spark, d):
    es = encoded_with_label(orders_log(spark, d, gaps=True), ORDERS, "index", "prefix")
    long = to_long(es.rows, ["set", "prefix_id", "bucket"], es.features).where(F.col("value") != 0)
    return long.withColumn("value", rounded("value"))


@query(f"""WITH {O.ENCODED_SET}, w AS (SELECT part AS "set", prefix_id, y, {O.feature_list([(n, O.q(n)) for n, _ in O.static_columns() + O.agg_columns()])} FROM enc)
SELECT "set", prefix_id, y AS encoded_label, feature, CAST(value AS DOUBLE) AS value FROM (UNPIVOT w ON COLUMNS(* EXCLUDE ("set", prefix_id, y)) INTO NAME feature VALUE value) WHERE value <> 0""")
def encoded_sparse(spark, d):
    """All non-zero features of the orders log, from sparse vectors numbered by a vocabulary table."""
    log = orders_log(spark, d, gaps=True)
    longest = P.max_prefix_rule(log, ORDERS)
    parts = zip(("training", "testing"), S.temporal_split(log, ORDERS, 0.8))
    prefixes = [P.generate_prefixes(part, ORDERS, 1, longest).withColumn("set", F.lit(name)) for name, part in parts]
    found = Z.sparse_set(prefixes[0].unionByName(prefixes[1]), ORDERS).long("set", "prefix_id", "encoded_label")
    deviation = F.col("feature").startswith("agg__std_")
    return found.withColumn("value", F.when(deviation, rounded("value", 4)).otherwise(rounded("value", 6))).where("value <> 0")
