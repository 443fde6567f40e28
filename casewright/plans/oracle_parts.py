"""SQL building blocks for the checks: the three logs, the split, the prefixes and the encoded set.

The level lists below are those of the test tables.
"""

from __future__ import annotations

ACTIVITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NATIONS = sorted(f"NATION_{i}" for i in range(25))
STATS = ["mean", "max", "min", "sum", "std"]


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def r6(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


ORDERS_LOG = """
log0 AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS case_id, o.o_orderkey AS event_id, o.o_orderpriority AS activity,
         o.o_orderdate AS ts, o.o_orderstatus AS resource, o.o_totalprice AS price, c.c_mktsegment AS segment,
         n.n_name AS nation, c.c_acctbal AS acctbal,
         CASE WHEN first_value(o.o_orderstatus) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) = 'F'
              THEN 'deviant' ELSE 'regular' END AS label
  FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey),
"""
ORDERS = ORDERS_LOG + "log AS (SELECT *, price AS totalprice FROM log0)"
ORDERS_GAPS = ORDERS_LOG + "log AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN price END AS totalprice FROM log0)"

_SESSIONS = """
ev AS (
  SELECT CAST(user_id AS VARCHAR) || '_' || CAST(CAST(floor(floor(epoch_us(ts) / 1e6 - epoch_us(TIMESTAMP '2024-01-01') / 1e6) / 604800) AS BIGINT) AS VARCHAR) AS case_id,
         user_id, event_id, event_type AS activity, ts, {resource} AS resource, {value} AS value
  FROM events),
lab AS (
  SELECT case_id, CASE WHEN count(*) FILTER (activity = 'purchase') > count(*) FILTER (activity = 'error') THEN 'deviant' ELSE 'regular' END AS label
  FROM ev GROUP BY case_id),
log AS (
  SELECT ev.*, lab.label, c.c_mktsegment AS segment, c.c_acctbal AS acctbal
  FROM ev JOIN lab USING (case_id) LEFT JOIN customer c ON c.c_custkey = ev.user_id)
"""
_RES = "'r' || CAST(CAST(json_extract(props, '$.k') AS INT) % 10 AS VARCHAR)"
SESSIONS = _SESSIONS.format(resource=_RES, value="value")
SESSIONS_GAPS = _SESSIONS.format(
    resource=f"CASE WHEN event_id % 11 <> 0 THEN {_RES} END", value="CASE WHEN event_id % 7 <> 0 THEN value END"
)
LINES = """
log AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag || l_linestatus AS activity, l_shipdate AS ts,
         l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_linenumber AS linenumber,
         l_partkey AS partkey, l_suppkey AS suppkey, o_orderpriority AS priority, o_totalprice AS totalprice,
         CASE WHEN o_orderstatus = 'F' THEN 'deviant' ELSE 'regular' END AS label
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
"""
ORDER_EVENT = "ts, activity, event_id"
ORDER_LINE = "ts, activity, linenumber, partkey, suppkey, extendedprice"


def split(ratio: float = 0.8) -> str:
    return f"""
starts AS (SELECT case_id, min(ts) AS s FROM log GROUP BY case_id),
ranked AS (SELECT case_id, s, row_number() OVER (ORDER BY s, case_id) AS rk, count(*) OVER () AS n FROM starts),
cut AS (SELECT min(s) AS t FROM ranked WHERE rk > floor({ratio}::DOUBLE * n)),
train AS (SELECT log.* FROM log JOIN ranked USING (case_id) WHERE rk <= floor({ratio}::DOUBLE * n) AND ts < (SELECT t FROM cut)),
test AS (SELECT log.* FROM log JOIN ranked USING (case_id) WHERE rk > floor({ratio}::DOUBLE * n))"""


def longest(cap: int = 40) -> str:
    return f"""
mx AS (SELECT least({cap}, CAST(ceil(quantile_cont(n, 0.9)) AS INT)) AS m
       FROM (SELECT count(*) AS n FROM log WHERE label = 'deviant' GROUP BY case_id))"""


def prefixes(source: str, out: str, order: str = ORDER_EVENT, low: int = 1, gap: int = 1, top: str = "(SELECT m FROM mx)") -> str:
    return f"""
{out}_num AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {order}) AS pos,
                     count(*) OVER (PARTITION BY case_id) AS len FROM {source}),
{out} AS (
  SELECT l.* EXCLUDE (len), k.n AS nr, CASE WHEN k.n = {low} THEN 1 ELSE k.n END AS prefix_nr, case_id AS original_case_id,
         CASE WHEN k.n = {low} THEN case_id ELSE case_id || '_' || CAST(k.n AS VARCHAR) END AS prefix_id,
         least({top}, len) AS case_length
  FROM {out}_num l JOIN range({low}, 100, {gap}) k(n) ON k.n <= least({top}, len) AND pos <= k.n)"""


def static_columns(prefix: str = "static__") -> list[tuple[str, str]]:
    out = [(f"{prefix}acctbal", "coalesce(arg_min(acctbal, pos) FILTER (acctbal IS NOT NULL), 0)")]
    for c, levels in (("segment", SEGMENTS), ("nation", NATIONS)):
        first = f"arg_min({c}, pos) FILTER ({c} IS NOT NULL)"
        out += [(f"{prefix}{c}_{v}", f"CASE WHEN {first} = '{v}' THEN 1.0 ELSE 0.0 END") for v in levels]
    return out


def agg_columns(prefix: str = "agg__", presence: bool = False) -> list[tuple[str, str]]:
    out = []
    for c, levels in (("activity", ACTIVITIES), ("resource", STATUSES)):
        for v in levels:
            count = f"count(*) FILTER ({c} = '{v}')"
            out.append((f"{prefix}{c}_{v}", f"least(1, {count})" if presence else count))
    functions = {"mean": "avg", "max": "max", "min": "min", "sum": "sum", "std": "stddev_samp"}
    out += [(f"{prefix}{s}_totalprice", f"coalesce({functions[s]}(totalprice), 0)") for s in STATS]
    return out


def digits_of(feature: str) -> int:
    """Deviations are compared at four digits: their last digits depend on the order of summation."""
    return 4 if feature.removeprefix("agg__").startswith("std_") else 6


def feature_list(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"{r6(e, digits_of(n))} AS {q(n)}" for n, e in columns)


def encoded(source: str, keys: str = "prefix_id") -> str:
    """Static and aggregate features of a prefix table."""
    return f"SELECT {keys}, {feature_list(static_columns() + agg_columns())} FROM {source} GROUP BY {keys}"


RAW_FEATURES = ", ".join(f"CAST({e} AS DOUBLE) AS {q(n)}" for n, e in static_columns() + agg_columns())
# The encoded set of the orders log with gaps: train and test, features unrounded.
ENCODED_SET = (
    ORDERS_GAPS + "," + longest() + "," + split() + "," + prefixes("train", "ptr") + "," + prefixes("test", "pte")
    + f""",
enc AS (
  SELECT 'training' AS part, prefix_id, original_case_id, max(nr) AS nr, CASE WHEN min(label) = 'deviant' THEN 1 ELSE 0 END AS y, {RAW_FEATURES}
  FROM ptr GROUP BY prefix_id, original_case_id
  UNION ALL
  SELECT 'testing', prefix_id, original_case_id, max(nr), CASE WHEN min(label) = 'deviant' THEN 1 ELSE 0 END, {RAW_FEATURES}
  FROM pte GROUP BY prefix_id, original_case_id)"""
)
NUMERIC = ["static__acctbal"] + [f"agg__{s}_totalprice" for s in STATS]
COUNTS = [f"agg__activity_{a}" for a in ACTIVITIES] + [f"agg__resource_{s}" for s in STATUSES]
DUMMIES = [n for n, _ in static_columns() if n != "static__acctbal"]
WEIGHTS = {"static__acctbal": -0.0001, "agg__mean_totalprice": 0.00001, "agg__activity_1-URGENT": 0.3}
BIAS = -2.5


def linear_sql(weights: dict[str, float] | None = None, bias: float = BIAS, alias: str = "", over: dict[str, str] | None = None) -> str:
    over = over or {}
    dot = f"{alias}." if alias else ""
    return " + ".join([f"({bias})::DOUBLE"] + [f"({w})::DOUBLE * {over.get(c, dot + q(c))}" for c, w in (weights or WEIGHTS).items()])


def score_sql(weights: dict[str, float] | None = None, bias: float = BIAS, alias: str = "", over: dict[str, str] | None = None) -> str:
    return f"(1 / (1 + exp(-({linear_sql(weights, bias, alias, over)}))))"


def long_of(source: str, ids: str, features: list[str], cast: str = "DOUBLE") -> str:
    """UNION ALL of (ids, feature, value)."""
    return " UNION ALL ".join(f"SELECT {ids}, '{f}' AS feature, CAST({q(f)} AS {cast}) AS value FROM {source}" for f in features)


def values_of(source: str, features: list[str], cast: str = "VARCHAR") -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({q(f)} AS {cast}) AS value FROM {source}" for f in features)
