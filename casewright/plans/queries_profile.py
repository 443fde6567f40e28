"""Statistics, association measures and binning as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import quoted
from ..operators import associate as C
from ..operators import binning as N
from ..operators import profile as L
from ..operators import sketches
from ..operators.prepare import encode_label
from ..session import scratch_path, stage
from ..sources.tables import LINES, ORDERS, SESSIONS, lines_log, orders_log, sessions_log
from . import oracle_parts as O
from .encoded import encoded_with_label
from .registry import query, rounded, stamp

r6 = O.r6


def encoded_orders(spark, d):
    return encoded_with_label(orders_log(spark, d, gaps=True), ORDERS)


def staged_orders(spark, d):
    """The encoded set written out once, for queries that read it several times."""
    es = encoded_orders(spark, d)
    return es._replace(rows=stage(es.rows, "encoded"))


def rounded_columns(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, rounded(c, digits))
    return df


# --- statistics --------------------------------------------------------------------------

@query(f"""WITH {O.SESSIONS_GAPS}, {O.longest(20)}, len AS (SELECT case_id, count(*) AS n, max(label) AS label FROM log GROUP BY case_id),
num AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {O.ORDER_EVENT}) AS pos FROM log),
tr AS (SELECT DISTINCT string_agg(activity, '__' ORDER BY pos) AS v FROM num WHERE pos <= (SELECT m FROM mx) GROUP BY case_id),
lev AS (SELECT (SELECT count(DISTINCT activity) FROM log) AS a, (SELECT count(DISTINCT resource) + max(CASE WHEN resource IS NULL THEN 1 ELSE 0 END) FROM log) AS r, (SELECT count(DISTINCT segment) + max(CASE WHEN segment IS NULL THEN 1 ELSE 0 END) FROM log) AS s)
SELECT 'sessions' AS dataset, count(*) AS traces, min(n) AS shortest_trace, quantile_cont(n, 0.5) AS average_trace_length, max(n) AS longest_trace,
 (SELECT m FROM mx) AS max_prefix_length, (SELECT count(*) FROM tr) AS trace_variants, round(count(*) FILTER (label = 'deviant') / count(*), 5) AS positive_share,
 (SELECT a FROM lev) AS event_classes, 2 AS static_columns, 3 AS dynamic_columns, (SELECT s FROM lev) AS static_cat_levels, (SELECT a + r FROM lev) AS dynamic_cat_levels FROM len""")
def log_statistics(spark, d):
    return L.log_statistics(sessions_log(spark, d, gaps=True), SESSIONS)


@query(f"""WITH {O.LINES}, num AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {O.ORDER_LINE}) AS pos FROM log),
tr AS (SELECT case_id, string_agg(activity, '__' ORDER BY pos) AS variant FROM num WHERE pos <= 10 GROUP BY case_id)
SELECT variant, count(*) AS n_cases FROM tr GROUP BY variant""")
def trace_variants(spark, d):
    return L.trace_variants(lines_log(spark, d), LINES, 10)


@query(f"WITH {O.ORDERS} SELECT label, count(*) AS n_cases FROM (SELECT case_id, max(label) AS label FROM log GROUP BY case_id) GROUP BY label")
def case_class_frequencies(spark, d):
    return L.case_class_frequencies(orders_log(spark, d), ORDERS)


@query(f"""WITH {O.SESSIONS_GAPS} SELECT 'static' AS kind, count(DISTINCT segment) + max(CASE WHEN segment IS NULL THEN 1 ELSE 0 END) AS n_levels FROM log
UNION ALL SELECT 'dynamic', count(DISTINCT activity) + max(CASE WHEN activity IS NULL THEN 1 ELSE 0 END) + count(DISTINCT resource) + max(CASE WHEN resource IS NULL THEN 1 ELSE 0 END) FROM log""")
def categorical_levels(spark, d):
    return L.categorical_levels(sessions_log(spark, d, gaps=True), SESSIONS)


CARD = ["case_id", "event_id", "activity", "resource", "totalprice", "segment", "nation", "label"]


@query(f"WITH {O.ORDERS_GAPS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_values FROM log" for c in CARD))
def column_cardinality(spark, d):
    return L.column_cardinality(orders_log(spark, d, gaps=True), CARD)


def _profile_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count(*) AS n_rows, count(*) - count({c}) AS n_missing, {r6(f'avg({c})', 7)} AS mean, {r6(f'stddev_samp({c})')} AS std,
        CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, count(*) FILTER ({c} = 0) AS n_zero, count(DISTINCT {c}) AS n_distinct,
        {r6(f'quantile_cont({c}, 0.25)')} AS q25, {r6(f'quantile_cont({c}, 0.5)')} AS median, {r6(f'quantile_cont({c}, 0.75)')} AS q75 FROM {source}""" for c in columns)


@query(f"WITH {O.LINES} {_profile_sql('log', ['quantity', 'extendedprice', 'discount', 'totalprice'])}")
def profile(spark, d):
    got = L.profile_numeric(lines_log(spark, d), ["quantity", "extendedprice", "discount", "totalprice"])
    return rounded_columns(rounded_columns(got, "std", "q25", "median", "q75"), "mean", digits=7)


@query(f"WITH {O.SESSIONS_GAPS}, v AS (SELECT case_id, max(acctbal) AS acctbal, max(CASE WHEN label = 'deviant' THEN 1 ELSE 0 END) AS encoded_label FROM log GROUP BY case_id) {_profile_sql('v', ['acctbal', 'encoded_label'])}")
def profile_static(spark, d):
    from ..operators.prepare import static_view
    got = L.profile_numeric(static_view(sessions_log(spark, d, gaps=True), SESSIONS), ["acctbal", "encoded_label"])
    return rounded_columns(rounded_columns(got, "std", "q25", "median", "q75"), "mean", digits=7)


@query(f"""WITH {O.SESSIONS_GAPS}, v AS ({O.values_of('log', ['activity', 'resource', 'segment', 'case_id'])}),
c AS (SELECT feature, value, count(*) AS n FROM v GROUP BY ALL),
t AS (SELECT feature, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (value IS NULL), 0) AS BIGINT) AS n_missing, count(value) AS n_distinct FROM c GROUP BY feature),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rank FROM c WHERE value IS NOT NULL)
SELECT feature, value, n, rank, n_rows, n_missing, n_distinct FROM r JOIN t USING (feature) WHERE rank <= 5""")
def profile_top_values(spark, d):
    return L.profile_categorical(sessions_log(spark, d, gaps=True), ["activity", "resource", "segment", "case_id"])


@query(f"""WITH {O.LINES}, v AS ({O.values_of('log', ['quantity', 'extendedprice', 'discount'], 'DOUBLE')}),
b AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM v GROUP BY feature),
p AS (SELECT feature, lo, (hi - lo) / 10 AS w, least(9, CAST(floor((value - lo) / ((hi - lo) / 10)) AS BIGINT)) AS bin FROM v JOIN b USING (feature))
SELECT feature, bin, {r6('max(lo) + bin * max(w)')} AS lower, count(*) AS n FROM p GROUP BY feature, bin""")
def profile_histogram(spark, d):
    return rounded_columns(L.profile_histogram(lines_log(spark, d), ["quantity", "extendedprice", "discount"]), "lower")


COUNTED = O.NUMERIC + O.COUNTS + O.DUMMIES
PLAIN_NUMERIC = "('" + "', '".join(O.NUMERIC) + "')"


@query(f"""WITH {O.ENCODED_SET}, t AS (SELECT * FROM enc WHERE part = 'training'), v AS ({O.values_of('t', COUNTED, 'DOUBLE')}),
c AS (SELECT feature, value, count(*) AS n FROM v GROUP BY ALL),
w AS (SELECT feature, count(*) AS n_values, string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY value) AS all_counts FROM c GROUP BY feature)
SELECT feature, n_values, CASE WHEN feature IN {PLAIN_NUMERIC} OR n_values > 20 THEN NULL ELSE all_counts END AS value_counts,
CASE WHEN feature IN {PLAIN_NUMERIC} THEN 'Numerical Variable' WHEN n_values > 20 THEN 'more than 20 cat levels' END AS note FROM w""")
def encoded_level_counts(spark, d):
    es = encoded_orders(spark, d)
    got = L.encoded_level_counts(es.rows.where(F.col("set") == "training"), es.features, es.categorical)
    entries = F.array_sort(F.map_entries("value_counts"))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"].cast("long"), e["value"])), ",")
    return got.withColumn("value_counts", text)


@query(f"""WITH {O.ORDERS} SELECT 'activity' AS feature, activity AS value, label, count(*) AS n FROM log GROUP BY ALL
UNION ALL SELECT 'segment', segment, label, count(*) FROM (SELECT case_id, max(segment) AS segment, max(label) AS label FROM log GROUP BY case_id) GROUP BY ALL""")
def value_counts_by_label(spark, d):
    return L.value_counts_by_label(orders_log(spark, d), ORDERS, ["activity", "segment"], ORDERS.static_cat)


@query(f"""WITH {O.LINES}, b AS (SELECT min(quantity) q0, max(quantity) q1, min(extendedprice) e0, max(extendedprice) e1, min(discount) d0, max(discount) d1 FROM log),
s AS (SELECT label, least(9, CAST(floor((quantity - q0) / (q1 - q0) * 10) AS BIGINT)) AS q, least(9, CAST(floor((extendedprice - e0) / (e1 - e0) * 10) AS BIGINT)) AS e, least(9, CAST(floor((discount - d0) / (d1 - d0) * 10) AS BIGINT)) AS d FROM log, b)
SELECT 'quantity' AS x, 'extendedprice' AS y, q AS bin_x, e AS bin_y, label, count(*) AS n FROM s GROUP BY ALL
UNION ALL SELECT 'quantity', 'discount', q, d, label, count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'extendedprice', 'discount', e, d, label, count(*) FROM s GROUP BY ALL""")
def pair_scatter(spark, d):
    return L.pair_scatter(lines_log(spark, d), ["quantity", "extendedprice", "discount"], "label")


@query(f"""WITH {O.SESSIONS}, u AS (SELECT case_id, event_id, ts, activity, epoch_us(ts) / 1e6 AS sec FROM log),
p AS (SELECT *, row_number() OVER w AS event_nr, lag(sec) OVER w AS before, min(sec) OVER (PARTITION BY case_id) AS start FROM u WINDOW w AS (PARTITION BY case_id ORDER BY {O.ORDER_EVENT})),
sp AS (SELECT case_id, min(sec) AS s, max(sec) AS e FROM u GROUP BY case_id),
m AS (SELECT s AS t0, 1 AS step, 0 AS gone FROM sp UNION ALL SELECT e, 0, 1 FROM sp UNION ALL SELECT DISTINCT sec, 0, 0 FROM u),
g AS (SELECT t0, sum(step) AS i, sum(gone) AS o FROM m GROUP BY t0),
o AS (SELECT t0, CAST(sum(i) OVER (ORDER BY t0) - sum(o) OVER (ORDER BY t0) + o AS BIGINT) AS open_cases FROM g)
SELECT event_id, case_id, event_nr, {r6('coalesce(sec - before, 0)')} AS timesincelastevent, {r6('sec - start')} AS timesincecasestart,
 {r6("sec - epoch_us(date_trunc('day', ts)) / 1e6")} AS timesincemidnight, month(ts) AS month, isodow(ts) - 1 AS weekday, hour(ts) AS hour, open_cases
FROM p JOIN o ON o.t0 = p.sec""")
def derive_time_features(spark, d):
    got = L.derive_time_features(sessions_log(spark, d), SESSIONS).select(
        "event_id", "case_id", "event_nr", "timesincelastevent", "timesincecasestart", "timesincemidnight", "month", "weekday", "hour", "open_cases"
    )
    return rounded_columns(got, "timesincelastevent", "timesincecasestart", "timesincemidnight")


# --- associations ------------------------------------------------------------------------

def safe_corr(a: str, b: str) -> str:
    r = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
    return f"CASE WHEN isnan({r}) THEN NULL ELSE {r} END"


def matrix_sql(source: str, columns: list[str], label: str | None = None, digits: int = 6, kind: str | None = None, drop_null: bool = False) -> str:
    """One SELECT with all pairs, unpivoted."""
    names = columns + ([label] if label else [])
    at = {c: ("y" if c == label else O.q(c)) for c in names}
    entries = ", ".join(
        f"{{'a': '{a}', 'b': '{b}', 'r': {safe_corr(at[a], at[b])}}}" for a in names for b in names
    )
    head = f"'{kind}' AS kind, " if kind else ""
    tail = " WHERE e.r IS NOT NULL" if drop_null else ""
    return f"SELECT {head}e.a AS feature_a, e.b AS feature_b, {r6('e.r', digits)} AS r FROM (SELECT unnest([{entries}]) AS e FROM {source}){tail}"


MEASURES = ["quantity", "extendedprice", "discount", "totalprice", "flat"]


@query(f"WITH {O.LINES}, x AS (SELECT CASE WHEN linenumber = 1 THEN NULL ELSE quantity END AS quantity, extendedprice, discount, CASE WHEN linenumber = 2 THEN NULL ELSE totalprice END AS totalprice, 1.0 AS flat FROM log) {matrix_sql('x', MEASURES)}")
def pearson_matrix(spark, d):
    log = lines_log(spark, d).withColumn("flat", F.lit(1.0)).withColumn("quantity", F.when(F.col("linenumber") != 1, F.col("quantity"))).withColumn(
        "totalprice", F.when(F.col("linenumber") != 2, F.col("totalprice")))
    return rounded_columns(C.pearson_matrix(log, MEASURES), "r")


WIDE = O.NUMERIC + O.COUNTS + O.DUMMIES
HOLES = ", ".join(f'CASE WHEN length(prefix_id) % {2 + i % 3} <> 0 THEN "{c}" END AS "{c}"' for i, c in enumerate(WIDE))


@query(f"WITH {O.ENCODED_SET}, x AS (SELECT {HOLES} FROM enc) {matrix_sql('x', WIDE)}")
def pearson_matrix_wide_nulls(spark, d):
    """More columns than one aggregation would take, with missing values in all of them."""
    rows = staged_orders(spark, d).rows
    holes = [F.when(F.length("prefix_id") % (2 + i % 3) != 0, F.col(quoted(c))).alias(c) for i, c in enumerate(WIDE)]
    return rounded_columns(C.pearson_matrix(rows.select(*holes), WIDE), "r")


@query(f"WITH {O.ENCODED_SET}, x AS (SELECT * FROM enc) {matrix_sql('x', O.NUMERIC + O.COUNTS + O.DUMMIES)}")
def pearson_matrix_wide(spark, d):
    es = staged_orders(spark, d)
    return rounded_columns(C.pearson_matrix(es.rows, O.NUMERIC + O.COUNTS + O.DUMMIES), "r")


@query(f"""WITH {O.ORDERS_GAPS}, x AS (SELECT totalprice, acctbal, CASE WHEN label = 'deviant' THEN 1 ELSE 0 END AS y FROM log)
SELECT 'totalprice' AS feature, {r6(safe_corr('totalprice', 'y'))} AS r FROM x UNION ALL SELECT 'acctbal', {r6(safe_corr('acctbal', 'y'))} FROM x""")
def pearson_with_label(spark, d):
    log = encode_label(orders_log(spark, d, gaps=True), ORDERS)
    return rounded_columns(C.pearson_with_label(log, ["totalprice", "acctbal"]), "r")


CORR = f"""{O.ENCODED_SET}, corr_num AS ({matrix_sql('enc', O.NUMERIC, 'encoded_label', 3, 'num', True)}),
corr_cat AS ({matrix_sql('enc', O.COUNTS + O.DUMMIES, 'encoded_label', 3, 'cat', True)}),
m AS (SELECT * FROM corr_num UNION ALL SELECT * FROM corr_cat)"""


def orders_correlations(spark, d) -> DataFrame:
    es = staged_orders(spark, d)
    return C.encoded_correlations(es.rows, es.features, es.categorical)


@query(f"WITH {CORR} SELECT * FROM m")
def encoded_correlations(spark, d):
    return rounded_columns(orders_correlations(spark, d), "r", digits=3)


@query(f"WITH {O.SESSIONS_GAPS} SELECT activity, resource, count(*) AS n FROM log WHERE resource IS NOT NULL GROUP BY ALL")
def crosstab(spark, d):
    return C.crosstab(sessions_log(spark, d, gaps=True), "activity", "resource")


def cramers_sql(source: str, pairs: list[tuple[str, str]], one_sided: bool = False) -> str:
    rows = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in pairs)
    names = "a AS feature, " if one_sided else "a AS feature_a, b AS feature_b, "
    return f"""pairs AS ({rows}), obs AS (SELECT a, b, x, y, count(*) AS o FROM pairs GROUP BY ALL),
gx AS (SELECT a, b, x, sum(o) AS nx FROM obs GROUP BY ALL), gy AS (SELECT a, b, y, sum(o) AS ny FROM obs GROUP BY ALL),
grid AS (SELECT gx.a, gx.b, x, y, nx, ny, sum(nx) OVER (PARTITION BY gx.a, gx.b, y) AS n FROM gx JOIN gy ON gx.a = gy.a AND gx.b = gy.b),
cell AS (SELECT grid.*, coalesce(o, 0) AS o, nx * ny / n AS e FROM grid LEFT JOIN obs USING (a, b, x, y)),
dims AS (SELECT a, b, max(n) AS n, count(DISTINCT x) AS r, count(DISTINCT y) AS k FROM cell GROUP BY a, b),
chi AS (SELECT a, b, sum(CASE WHEN r = 2 AND k = 2 THEN (abs(o - e) - least(0.5, abs(o - e))) ^ 2 / e ELSE (o - e) ^ 2 / e END) AS chi2,
  max(dims.n) AS n, max(r) AS r, max(k) AS k FROM cell JOIN dims USING (a, b) GROUP BY a, b),
v AS (SELECT {names} greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) AS phi, r - (r - 1) ^ 2 / (n - 1) AS rc, k - (k - 1) ^ 2 / (n - 1) AS kc FROM chi)
SELECT {'feature' if one_sided else 'feature_a, feature_b'}, {r6('CASE WHEN least(kc - 1, rc - 1) = 0 THEN NULL ELSE sqrt(phi / least(kc - 1, rc - 1)) END', 3)} AS v FROM v"""


CATS = ["activity", "resource", "segment", "label", "flat"]


@query(f"WITH {O.SESSIONS_GAPS}, x AS (SELECT activity, resource, segment, label, 'one' AS flat FROM log), {cramers_sql('x', [(a, b) for a in CATS for b in CATS])}")
def cramers_v(spark, d):
    log = sessions_log(spark, d, gaps=True).withColumn("flat", F.lit("one"))
    return rounded_columns(C.cramers_v_matrix(log, CATS), "v", digits=3)


@query(f"WITH {O.ORDERS}, x AS (SELECT activity, resource, segment, nation, label FROM log), {cramers_sql('x', [(a, 'label') for a in ['activity', 'resource', 'segment', 'nation']], True)}")
def cramers_v_with_label(spark, d):
    return rounded_columns(C.cramers_v_with_label(orders_log(spark, d), [*ORDERS.categorical, "label"], "label"), "v", digits=3)


PARTNERS = "abs(r) >= {t} AND feature_a <> feature_b AND feature_b <> 'encoded_label'"


def partners_sql(t: float) -> str:
    return f"WITH {CORR} SELECT feature_a AS feature, string_agg(feature_b, ',' ORDER BY feature_b) AS others FROM m WHERE {PARTNERS.format(t=t)} AND kind = 'num' GROUP BY feature_a"


def number_matrix(spark, d) -> DataFrame:
    return orders_correlations(spark, d).where(F.col("kind") == "num").drop("kind")


@query(partners_sql(0.8))
def correlated_with_others(spark, d):
    return C.correlated_with_others(number_matrix(spark, d)).withColumn("others", F.array_join("others", ","))


@query(partners_sql(0.35))
def correlated_with_others_loose(spark, d):
    return C.correlated_with_others(number_matrix(spark, d), 0.35).withColumn("others", F.array_join("others", ","))


@query(f"WITH {CORR} SELECT feature_a AS feature, {r6('r', 3)} AS r FROM m WHERE feature_b = 'encoded_label' AND feature_a <> 'encoded_label' AND abs(r) >= 0.02")
def correlated_with_target(spark, d):
    return rounded_columns(C.correlated_with_target(orders_correlations(spark, d).drop("kind"), 0.02), "r", digits=3)


@query(f"WITH {CORR} SELECT DISTINCT feature_a AS feature FROM m WHERE feature_b = 'encoded_label' AND feature_a <> 'encoded_label' AND (r >= 0.02 OR r <= -0.02)")
def interaction_columns(spark, d):
    return C.interaction_columns(orders_correlations(spark, d).drop("kind"), 0.02)


@query(f"""WITH {CORR}, k AS (SELECT feature_a, feature_b, r, {PARTNERS.format(t=0.8)} AS hit FROM m WHERE kind = 'num')
SELECT feature_a AS feature, count(*) FILTER (hit) AS n_partners, coalesce(string_agg(feature_b || '=' || CAST(CAST(round(r * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY feature_b) FILTER (hit), '') AS partners FROM k GROUP BY feature_a""")
def correlation_counts(spark, d):
    got = C.correlation_counts(number_matrix(spark, d))
    text = F.transform("partners", lambda p: F.concat(p["other"], F.lit("="), F.round(p["r"] * 1000).cast("long").cast("string")))
    return got.withColumn("partners", F.array_join(text, ","))


MI_CATS = ["activity", "resource", "segment"]


@query(f"""WITH {O.SESSIONS_GAPS}, v AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, coalesce({c}, '-') AS x, label AS y FROM log" for c in MI_CATS)}),
c AS (SELECT feature, x, y, count(*) AS o FROM v GROUP BY ALL),
j AS (SELECT feature, o, sum(o) OVER (PARTITION BY feature, x) AS nx, sum(o) OVER (PARTITION BY feature, y) AS ny, sum(o) OVER (PARTITION BY feature) AS n FROM c)
SELECT feature, {r6('greatest(0, sum(o / n * ln((o / n) / (nx / n * (ny / n)))))')} AS mi FROM j GROUP BY feature""")
def mutual_info_discrete(spark, d):
    return rounded_columns(C.mutual_info_discrete(sessions_log(spark, d, gaps=True), MI_CATS, "label"), "mi")


def digamma_sql(x: str) -> str:
    y = f"(({x}) + 6.0::DOUBLE)"
    z = f"(1.0::DOUBLE / ({y} * {y}))"
    shift = " + ".join(f"1.0::DOUBLE / (({x}) + {i})" for i in range(6))
    return f"(ln({y}) - 0.5::DOUBLE / {y} - {z} * (1.0::DOUBLE / 12 - {z} * (1.0::DOUBLE / 120 - {z} * (1.0::DOUBLE / 252 - {z} * (1.0::DOUBLE / 240 - {z} / 132)))) - ({shift}))"


# Brute force in SQL: distances to all rows of the class by position, counts by comparing all rows.
NEAR = f"""{O.SESSIONS_GAPS}, v AS (SELECT event_id, label, value FROM log WHERE value IS NOT NULL),
w AS (SELECT event_id, label, value, count(*) OVER (PARTITION BY label) AS size,
  list_sort(list_filter([value - lag(value, 1) OVER o, value - lag(value, 2) OVER o, value - lag(value, 3) OVER o,
   lead(value, 1) OVER o - value, lead(value, 2) OVER o - value, lead(value, 3) OVER o - value], lambda x: x IS NOT NULL)) AS near
  FROM v WINDOW o AS (PARTITION BY label ORDER BY value, event_id)),
p AS (SELECT event_id, label, value, size, least(3, size - 1) AS k, near[least(3, size - 1)] AS radius FROM w WHERE size > 1),
inside AS (SELECT a.event_id, count(*) AS inside FROM p a JOIN p b ON (a.radius > 0 AND b.value > a.value - a.radius AND b.value < a.value + a.radius) OR (a.radius = 0 AND a.value = b.value) GROUP BY a.event_id)"""


@query(f"WITH {NEAR} SELECT event_id, k, {r6('radius')} AS radius, inside FROM p JOIN inside USING (event_id)")
def mutual_info_neighbours(spark, d):
    from ..functions.frames import to_long
    long = to_long(sessions_log(spark, d, gaps=True), ["event_id", "label"], ["value"])
    return rounded_columns(C.neighbour_counts(long, "event_id", "label").select("event_id", "k", "radius", "inside"), "radius")


@query(f"""WITH {NEAR} SELECT 'value' AS feature, {r6(f"greatest(0, {digamma_sql('count(*)')} + avg({digamma_sql('k')}) - avg({digamma_sql('size')}) - avg({digamma_sql('inside')}))")} AS mi FROM p JOIN inside USING (event_id)""")
def mutual_info_continuous(spark, d):
    return rounded_columns(C.mutual_info_continuous(sessions_log(spark, d, gaps=True), "event_id", ["value"], "label"), "mi")


DISCRETE = O.COUNTS + O.DUMMIES


@query(f"""WITH {O.ENCODED_SET}, v AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, CAST({O.q(c)} AS VARCHAR) AS x, y FROM enc" for c in DISCRETE)}),
c AS (SELECT feature, x, y, count(*) AS o FROM v GROUP BY ALL),
j AS (SELECT feature, o, sum(o) OVER (PARTITION BY feature, x) AS nx, sum(o) OVER (PARTITION BY feature, y) AS ny, sum(o) OVER (PARTITION BY feature) AS n FROM c),
s AS (SELECT feature, {r6('greatest(0, sum(o / n * ln((o / n) / (nx / n * (ny / n)))))')} AS mi FROM j GROUP BY feature)
SELECT feature, mi FROM s ORDER BY mi DESC, feature LIMIT 21""")
def mutual_info_rank(spark, d):
    es = staged_orders(spark, d)
    return C.mutual_info_rank(rounded_columns(C.mutual_info_discrete(es.rows, DISCRETE, "encoded_label"), "mi"))


def near_sql(source: str, features: list[str]) -> str:
    """Brute-force neighbour counts of several columns: inequality joins with all rows of the column."""
    rows = " UNION ALL ".join(f"SELECT '{f}' AS feature, prefix_id AS id, y, round(CAST({O.q(f)} AS DOUBLE), 4) AS value FROM {source}" for f in features)
    gaps = ", ".join([f"value - lag(value, {i}) OVER o" for i in (1, 2, 3)] + [f"lead(value, {i}) OVER o - value" for i in (1, 2, 3)])
    return f"""nv AS ({rows}),
nw AS (SELECT feature, id, y, value, count(*) OVER (PARTITION BY feature, y) AS size, list_sort(list_filter([{gaps}], lambda x: x IS NOT NULL)) AS near
  FROM nv WINDOW o AS (PARTITION BY feature, y ORDER BY value, id)),
np AS (SELECT feature, id, y, value, size, least(3, size - 1) AS k, near[least(3, size - 1)] AS radius FROM nw WHERE size > 1),
far AS (SELECT feature, id, value, value - radius AS low, value + radius AS high FROM np WHERE radius > 0),
ni AS (SELECT a.feature, a.id, count(*) AS inside FROM far a JOIN np b ON a.feature = b.feature AND b.value > a.low AND b.value < a.high GROUP BY ALL
  UNION ALL SELECT a.feature, a.id, count(*) FROM np a JOIN np b ON a.feature = b.feature AND a.value = b.value WHERE a.radius = 0 GROUP BY ALL),
nmi AS (SELECT feature, {r6(f"greatest(0, {digamma_sql('count(*)')} + avg({digamma_sql('k')}) - avg({digamma_sql('size')}) - avg({digamma_sql('inside')}))")} AS mi FROM np JOIN ni USING (feature, id) GROUP BY feature)"""


@query(f"""WITH {O.ENCODED_SET}, {near_sql('enc', O.NUMERIC)}, v AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, CAST({O.q(c)} AS VARCHAR) AS x, y FROM enc" for c in DISCRETE)}),
c AS (SELECT feature, x, y, count(*) AS o FROM v GROUP BY ALL),
j AS (SELECT feature, o, sum(o) OVER (PARTITION BY feature, x) AS nx, sum(o) OVER (PARTITION BY feature, y) AS ny, sum(o) OVER (PARTITION BY feature) AS n FROM c),
s AS (SELECT feature, {r6('greatest(0, sum(o / n * ln((o / n) / (nx / n * (ny / n)))))')} AS mi FROM j GROUP BY feature UNION ALL SELECT feature, mi FROM nmi)
SELECT feature, mi FROM s ORDER BY mi DESC, feature LIMIT 21""")
def mutual_info_encoded(spark, d):
    """Mutual information of all encoded features, continuous ones by neighbours."""
    es = staged_orders(spark, d)
    numbers = es.rows.select("prefix_id", "encoded_label", *[F.round(F.col(quoted(f)), 4).alias(f) for f in es.numeric])
    scores = C.mutual_info_continuous(numbers, "prefix_id", es.numeric, "encoded_label").unionByName(
        C.mutual_info_discrete(es.rows, es.categorical, "encoded_label")
    )
    return C.mutual_info_rank(rounded_columns(scores, "mi"))


# --- binning -----------------------------------------------------------------------------

def discretize_sql(columns: list[str], last_decides: bool) -> str:
    counts = {c: f"(SELECT CASE WHEN count(DISTINCT {O.q(c)}) >= 10 THEN 4 ELSE count(DISTINCT {O.q(c)}) END FROM enc)" for c in columns}
    if last_decides:
        counts = {c: counts[columns[-1]] for c in columns}
    parts = []
    for c in columns:
        lo, hi = f"(SELECT min({O.q(c)}) FROM enc)", f"(SELECT max({O.q(c)}) FROM enc)"
        b = counts[c]
        parts.append(f"CASE WHEN {lo} = {hi} OR {b} < 2 THEN 0.0 ELSE least(floor((CAST({O.q(c)} AS DOUBLE) - {lo}) / ({hi} - {lo}) * CAST({b} AS DOUBLE)), {b} - 1) END AS {O.q(c)}")
    return f"WITH {O.ENCODED_SET} SELECT prefix_id, y AS encoded_label, {', '.join(parts)} FROM enc"


BINNED = ["static__acctbal", "agg__max_totalprice", "agg__min_totalprice", "agg__activity_1-URGENT", "agg__resource_P"]


@query(discretize_sql(BINNED, False))
def discretize_uniform(spark, d):
    rows = staged_orders(spark, d).rows.select("prefix_id", "encoded_label", *[F.col(quoted(c)) for c in BINNED])
    return N.discretize_uniform(rows, BINNED)


@query(discretize_sql(BINNED, True))
def discretize_uniform_compat(spark, d):
    rows = staged_orders(spark, d).rows.select("prefix_id", "encoded_label", *[F.col(quoted(c)) for c in BINNED])
    return N.discretize_uniform(rows, BINNED, compat=True)


@query(f"""WITH {O.LINES}, x AS (SELECT 'extendedprice' AS feature, extendedprice AS value FROM log UNION ALL SELECT 'discount', discount FROM log UNION ALL SELECT 'quantity', CASE WHEN quantity > 45 THEN quantity * 10 ELSE quantity END FROM log),
l AS (SELECT feature, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM x GROUP BY feature),
c AS (SELECT feature, a - (b - a) * 1.5::DOUBLE AS lower, b + (b - a) * 1.5::DOUBLE AS upper FROM l),
g AS (SELECT feature, lower, upper, count(*) AS n, count(*) FILTER (value < lower OR value > upper) AS outliers FROM x JOIN c USING (feature) GROUP BY ALL)
SELECT feature, {r6('lower')} AS lower, {r6('upper')} AS upper, n, outliers, CASE WHEN outliers > n * 0.05 THEN 'skip' WHEN upper - lower < 0.5 THEN 'tight' ELSE 'wide' END AS flag FROM g""")
def iqr_range(spark, d):
    log = lines_log(spark, d).withColumn("quantity", F.when(F.col("quantity") > 45, F.col("quantity") * 10).otherwise(F.col("quantity")))
    return rounded_columns(N.iqr_range(log, ["extendedprice", "discount", "quantity"]), "lower", "upper")


@query(f"""WITH {O.ORDERS}, l AS (SELECT quantile_cont(totalprice, 0.25) AS a, quantile_cont(totalprice, 0.75) AS b FROM log)
SELECT event_id FROM log, l WHERE totalprice BETWEEN a - (b - a) * 1.5::DOUBLE AND b + (b - a) * 1.5::DOUBLE""")
def iqr_rows(spark, d):
    log = orders_log(spark, d)
    return N.without_outliers(log, "totalprice", N.iqr_range(log, ["totalprice"])).select("event_id")


@query(f"""WITH {O.LINES}, x AS (SELECT least(CAST(floor((extendedprice - 1000.0::DOUBLE) / 5000.0::DOUBLE) AS BIGINT), 18) AS bin FROM log WHERE extendedprice >= 1000 - 1000 % 5000 AND extendedprice <= 95000)
SELECT bin, {r6('bin * 5000.0')} AS edge, count(*) AS n FROM (SELECT least(CAST(floor(extendedprice / 5000.0::DOUBLE) AS BIGINT), 18) AS bin FROM log WHERE extendedprice >= 0 AND extendedprice <= 95000) GROUP BY bin""")
def histogram_bins(spark, d):
    return rounded_columns(N.histogram_bins(lines_log(spark, d), "extendedprice", 1000.0, 92000.0, 5000.0), "edge")


@query(f"""WITH {O.SESSIONS_GAPS}, c AS (SELECT 'value' AS feature, count(*) AS n, count(*) - count(value) AS missing, min(value) AS least, max(value) AS most FROM log
UNION ALL SELECT 'activity', count(*), count(*) - count(activity), NULL, NULL FROM log UNION ALL SELECT 'resource', count(*), count(*) - count(resource), NULL, NULL FROM log)
SELECT feature, n, missing, {r6('least')} AS least, {r6('most')} AS most FROM c""")
def profile_sketches(spark, d):
    """What daily sketches of the sessions log add up to exactly; tests hold distinct counts and quantiles to their error."""
    log, path = sessions_log(spark, d, gaps=True), scratch_path(spark, "sketches")
    sketches.update_profile(log, path, "ts", ["activity", "resource"], ["value"])
    found = sketches.merged_profile(spark, path).select("feature", "n", "missing", "least", "most")
    return rounded_columns(found, "least", "most")
