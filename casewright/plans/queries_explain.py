"""Global and local explanations and comparisons as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import quoted
from ..operators import associate as C
from ..operators import cluster as U
from ..operators import compare as X
from ..operators import explain_global as G
from ..operators import explain_local as Y
from ..operators import model as M
from ..operators import overlay as V
from ..operators.split import every_nth_case
from ..session import scratch_path, stage
from . import oracle_parts as O
from .queries_model import SMALL_TREES, fitted_orders
from .queries_profile import CORR, encoded_orders, rounded_columns, staged_orders
from .registry import query, rounded

r6 = O.r6
USED = list(O.WEIGHTS)
SCORER = M.closed_form(O.WEIGHTS, O.BIAS)
OTHER = {"static__acctbal": 0.0002, "agg__mean_totalprice": 0.000004, "agg__activity_1-URGENT": -0.2}
OTHER_BIAS = -1.0


def used_rows(spark, d) -> DataFrame:
    rows = staged_orders(spark, d).rows
    return rows.select("set", "prefix_id", "original_case_id", "prefix_nr", "encoded_label", *[F.col(quoted(c)) for c in USED])


# --- models ------------------------------------------------------------------------------

@query()
def tree_importances(spark, d):
    """Five importance types of a small boosted model."""
    _, features, models = fitted_orders(spark, d, "boosted", **SMALL_TREES)
    return G.tree_importances(models.models[1], features, scratch_path(spark, "trees"))


@query()
def logit_coefficients(spark, d):
    _, features, models = fitted_orders(spark, d, "logit", c=-2.0, max_iter=50)
    return G.logit_coefficients(models.models[1], features)


@query()
def importance_trials(spark, d):
    """Importances of two seeds in one long table."""
    tables = []
    for seed in (22, 23):
        _, features, models = fitted_orders(spark, d, "boosted", **{**SMALL_TREES, "n_trees": 4, "seed": seed})
        found = G.tree_importances(models.models[1], features, scratch_path(spark, "trees"))
        tables.append(G.importance_trials(found, f"orders_{seed}"))
    return G.union_all(tables)


# --- global explanations -----------------------------------------------------------------

def permutation_sql(part: str, weights: dict[str, float], bias: float, repeats: int = 10) -> str:
    primes = ", ".join(str(p) for p in G._PRIMES)
    variants = " UNION ALL ".join(
        f"SELECT rk, t.y, '{f}' AS feature, r, {O.score_sql(weights, bias, 't', {f: 'g' + str(i)})} AS s FROM moved{i} t" for i, f in enumerate(weights)
    )
    moved = ", ".join(
        f"""moved{i} AS (SELECT t.*, k.r, d.{O.q(f)} AS g{i} FROM plan k JOIN base d ON TRUE JOIN base t
          ON t.rk = (d.primes[CAST(({i} + k.r) % len(d.primes) AS BIGINT) + 1] * (d.rk - 1) + (({i} * {repeats} + k.r + 1) * 7919) % d.n) % d.n + 1)"""
        for i, f in enumerate(weights)
    )
    return f"""base AS (SELECT *, row_number() OVER (ORDER BY md5(prefix_id || '_42'), prefix_id) AS rk, count(*) OVER () AS n,
        list_filter([{primes}]::BIGINT[], lambda p: count(*) OVER () % p <> 0) AS primes FROM enc WHERE part = '{part}'),
plan AS (SELECT unnest(range(0, {repeats})) AS r), {moved}, variants AS ({variants}),
acc AS (SELECT feature, r, avg(CASE WHEN (s > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS a FROM variants GROUP BY ALL),
b AS (SELECT avg(CASE WHEN ({O.score_sql(weights, bias)} > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS b FROM base),
perm AS (SELECT feature, r, b - a AS drop_ FROM acc, b)"""


def flat_importances(df: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("importances", lambda x: F.round(x * 1e6).cast("long").cast("string")), ",")
    return rounded_columns(df.withColumn("importances", text), "mean", "std")


def _perm_query(part: str) -> str:
    return f"""WITH {O.ENCODED_SET}, {permutation_sql(part, O.WEIGHTS, O.BIAS)}
SELECT feature, {r6('avg(drop_)')} AS mean, {r6('stddev_pop(drop_)')} AS std, string_agg(CAST(CAST(round(drop_ * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY r) AS importances FROM perm GROUP BY feature"""


@query(_perm_query("training"))
def permutation_importance(spark, d):
    rows = used_rows(spark, d).where(F.col("set") == "training")
    return flat_importances(G.permutation_importance(rows, "prefix_id", USED, SCORER))


def _every_feature(columns: str) -> str:
    names = ", ".join(f"'{f}'" for f in [*O.NUMERIC, *O.COUNTS, *O.DUMMIES])
    return f"SELECT feature, {columns} FROM (SELECT unnest([{names}]) AS feature)"


@query(_every_feature("10 AS n_repeats, true AS bounded"))
def permutation_importance_logit(spark, d):
    """Permutation importance of a trained model, for every one of its features."""
    rows, features, models = fitted_orders(spark, d, "logit", c=-2.0, max_iter=50)
    train = rows.where(F.col("set") == "training")
    found = V.permutation_importance(train, "prefix_id", V.trained_scorer(models.models[1], features))
    bounded = F.forall("importances", lambda x: F.abs(x) <= 1)
    return found.select("feature", F.size("importances").alias("n_repeats"), bounded.alias("bounded"))


@query(_every_feature("true AS centred"))
def ale_logit(spark, d):
    """Accumulated effects of a trained model: of every feature that has a bin, with means near zero."""
    rows, features, models = fitted_orders(spark, d, "logit", c=-2.0, max_iter=50)
    found = V.ale(rows.where(F.col("set") == "training"), V.trained_scorer(models.models[1], features))
    sides = found.groupBy("feature").agg((F.abs(F.min("ale")) <= 1).alias("centred"))
    names = spark.createDataFrame([(f,) for f in features], "feature string")
    # A constant feature has no bins and no effects.
    return names.join(sides, "feature", "left").select("feature", F.coalesce("centred", F.lit(True)).alias("centred"))


@query(_perm_query("testing"))
def permutation_importance_test(spark, d):
    rows = used_rows(spark, d).where(F.col("set") == "testing")
    return flat_importances(G.permutation_importance(rows, "prefix_id", USED, SCORER))


def ale_sql(weights: dict[str, float], bias: float, out: str = "ale", bins: int = 20) -> str:
    probs = ", ".join(f"{i / bins!r}" for i in range(bins + 1))
    edges = " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, CASE WHEN count(DISTINCT {O.q(f)}) < 10 THEN list_sort(list(DISTINCT {O.q(f)}))
          ELSE list_sort(list_distinct(quantile_cont({O.q(f)}, [{probs}]))) END AS e FROM src""" for f in weights
    )
    ends = " UNION ALL ".join(
        f"""SELECT feature, b AS bin, {O.score_sql(weights, bias, '', {f: 'e[b + 1]'})} - {O.score_sql(weights, bias, '', {f: 'e[b]'})} AS delta
          FROM (SELECT src.*, feature, e, greatest(1, len(list_filter(e, lambda x: x < {O.q(f)}))) AS b FROM src, {out}_edges WHERE feature = '{f}')""" for f in weights
    )
    return f"""{out}_edges AS ({edges}), {out}_delta AS ({ends}),
{out}_step AS (SELECT feature, bin, count(*) AS n, avg(delta) AS step FROM {out}_delta GROUP BY ALL),
{out}_grid AS (SELECT feature, unnest(range(0, len(e))) AS bin, unnest(e) AS edge FROM {out}_edges),
{out}_acc AS (SELECT feature, bin, edge, coalesce(n, 0) AS n, coalesce(step, 0) AS step, sum(coalesce(step, 0)) OVER (PARTITION BY feature ORDER BY bin) AS acc
  FROM {out}_grid LEFT JOIN {out}_step USING (feature, bin)),
{out}_mid AS (SELECT feature, sum((acc - step / 2) * n) / sum(n) AS ale0 FROM {out}_acc GROUP BY feature),
{out} AS (SELECT feature, 'deviant' AS target, bin, edge, acc - ale0 AS ale, ale0 FROM {out}_acc JOIN {out}_mid USING (feature)
  UNION ALL SELECT feature, 'regular', bin, edge, -(acc - ale0), -ale0 FROM {out}_acc JOIN {out}_mid USING (feature))"""


TRAIN_SRC = "src AS (SELECT * FROM enc WHERE part = 'training')"


@query(f"""WITH {O.ENCODED_SET}, {TRAIN_SRC}, {ale_sql(O.WEIGHTS, O.BIAS)}
SELECT feature, target, bin, {r6('edge')} AS edge, {r6('ale')} AS ale, {r6('ale0')} AS ale0 FROM ale""")
def ale(spark, d):
    rows = used_rows(spark, d).where(F.col("set") == "training")
    return rounded_columns(G.ale(rows, USED, SCORER), "edge", "ale", "ale0")


def phi_sql(weights: dict[str, float], out: str = "phi", source: str = "src") -> str:
    return f"{out} AS (" + " UNION ALL ".join(
        f"SELECT prefix_id, '{f}' AS feature, CAST({O.q(f)} AS DOUBLE) AS value, ({w})::DOUBLE * ({O.q(f)} - (SELECT avg({O.q(f)}) FROM {source})) AS phi FROM {source}"
        for f, w in weights.items()
    ) + ")"


def base_sql(weights: dict[str, float], bias: float, source: str = "src") -> str:
    return " + ".join([f"({bias})::DOUBLE"] + [f"({w})::DOUBLE * (SELECT avg({O.q(f)}) FROM {source})" for f, w in weights.items()])


PHI = f"WITH {O.ENCODED_SET}, {TRAIN_SRC}, {phi_sql(O.WEIGHTS)}"


def train_phi(spark, d, weights=None, bias=O.BIAS):
    rows = used_rows(spark, d).where(F.col("set") == "training")
    return G.shap_linear(rows, "prefix_id", weights or O.WEIGHTS, bias)


@query(f"{PHI} SELECT prefix_id, feature, {r6('value')} AS value, {r6('phi', 9)} AS phi, {r6(base_sql(O.WEIGHTS, O.BIAS), 9)} AS base FROM phi")
def shap_linear(spark, d):
    phi, base = train_phi(spark, d)
    return rounded_columns(rounded_columns(phi.withColumn("base", base.scalar()), "value"), "phi", "base", digits=9)


def sampled_sql(orders: int = 4) -> str:
    """Change in score when a feature switches from its mean to the row's value, averaged over the orders."""
    def score(on: list[int]) -> str:
        return O.score_sql(O.WEIGHTS, O.BIAS, "src", {f: f"avgs.m{i}" for i, f in enumerate(USED) if i not in on})

    gains: dict[int, list[str]] = {i: [] for i in range(len(USED))}
    for order in G.feature_orders(len(USED), orders):
        for k, i in enumerate(order):
            gains[i].append(f"({score(order[:k + 1])} - {score(order[:k])})")
    means = ", ".join(f"avg({O.q(f)}) AS m{i}" for i, f in enumerate(USED))
    rows = " UNION ALL ".join(
        f"SELECT prefix_id, '{f}' AS feature, {r6(O.q(f))} AS value, {r6('(' + ' + '.join(gains[i]) + f') / {orders}', 9)} AS phi, {r6(score([]), 9)} AS base FROM src, avgs"
        for i, f in enumerate(USED)
    )
    return f"WITH {O.ENCODED_SET}, {TRAIN_SRC}, avgs AS (SELECT {means} FROM src) {rows}"


@query(sampled_sql())
def shap_sampled(spark, d):
    rows = used_rows(spark, d).where(F.col("set") == "training")
    phi, base = G.shap_sampled(rows, "prefix_id", USED, SCORER, orders=4)
    return rounded_columns(phi.withColumn("base", base.scalar()).withColumn("value", rounded("value")), "phi", "base", digits=9)


@query(f"{PHI} SELECT feature, {r6('sum(abs(phi))', 4)} AS total FROM phi GROUP BY feature ORDER BY total DESC LIMIT 10")
def shap_ranking(spark, d):
    return rounded_columns(G.shap_ranking(train_phi(spark, d)[0]), "total", digits=4)


@query(f"""{PHI}, top AS (SELECT feature FROM phi GROUP BY feature ORDER BY sum(abs(phi)) DESC LIMIT 2)
SELECT prefix_id, feature, {r6('value')} AS value, {r6('phi', 9)} AS phi FROM phi WHERE feature IN (SELECT feature FROM top)""")
def shap_dependence(spark, d):
    return rounded_columns(G.shap_dependence(train_phi(spark, d)[0], "prefix_id", top=2).withColumn("value", rounded("value")), "phi", digits=9)


# --- all features ------------------------------------------------------------------------

# A closed form over every feature of the encoded set, so that SQL can follow it.
EVERY = {f: -0.0001 if f.startswith("static") else 0.000001 * (i - 3) for i, f in enumerate(O.NUMERIC)}
EVERY |= {f: 0.1 * (i % 3 - 1) + 0.05 for i, f in enumerate(O.COUNTS)}
EVERY |= {f: 0.05 * (i % 7 - 3) + 0.02 for i, f in enumerate(O.DUMMIES)}
EVERY_BIAS = -1.0
EVERY_SCORER = V.linear_scorer(list(EVERY), list(EVERY.values()), EVERY_BIAS)


@query(f"""WITH {O.ENCODED_SET}, {permutation_sql("training", EVERY, EVERY_BIAS)}
SELECT feature, {r6('avg(drop_)')} AS mean, {r6('stddev_pop(drop_)')} AS std, string_agg(CAST(CAST(round(drop_ * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY r) AS importances FROM perm GROUP BY feature""")
def permutation_importance_all(spark, d):
    """Permutation importance of all features, over patched vectors."""
    rows = staged_orders(spark, d).rows.where(F.col("set") == "training")
    return flat_importances(V.permutation_importance(rows, "prefix_id", EVERY_SCORER))


@query(f"""WITH {O.ENCODED_SET}, {TRAIN_SRC}, {ale_sql(EVERY, EVERY_BIAS)}
SELECT feature, target, bin, {r6('edge', 3)} AS edge, {r6('ale', 5)} AS ale, {r6('ale0', 5)} AS ale0 FROM ale""")
def ale_all(spark, d):
    """Accumulated local effects of all features, over patched vectors."""
    rows = staged_orders(spark, d).rows.where(F.col("set") == "training")
    return rounded_columns(rounded_columns(V.ale(rows, EVERY_SCORER), "ale", "ale0", digits=5), "edge", digits=3)


TEST_PHI = f"""WITH {O.ENCODED_SET}, {TRAIN_SRC}, tst AS (SELECT * FROM enc WHERE part = 'testing'),
means AS (SELECT {', '.join(f'avg({O.q(f)}) AS {O.q(f)}' for f in EVERY)} FROM src),
phi AS (""" + " UNION ALL ".join(
    f"SELECT t.prefix_id, '{f}' AS feature, {r6('t.' + O.q(f), O.digits_of(f))} AS value, ({w})::DOUBLE * (t.{O.q(f)} - m.{O.q(f)}) AS phi FROM tst t, means m"
    for f, w in EVERY.items()
) + ")"


def every_phi(spark, d) -> DataFrame:
    rows = staged_orders(spark, d).rows
    return G.shap_linear(rows.where(F.col("set") == "testing"), "prefix_id", EVERY, EVERY_BIAS, rows.where(F.col("set") == "training"))[0]


def rounded_attributions(phi: DataFrame) -> DataFrame:
    value = F.when(F.col("feature").startswith("agg__std_"), rounded("value", 4)).otherwise(rounded("value"))
    return rounded_columns(phi.withColumn("value", value), "phi")


@query(f"{TEST_PHI} SELECT prefix_id, feature, value, {r6('phi')} AS phi FROM phi")
def shap_linear_all(spark, d):
    """Attributions of all features of the test prefixes against the training means."""
    return rounded_attributions(every_phi(spark, d))


@query(f"""{TEST_PHI}, top AS (SELECT feature FROM phi GROUP BY feature ORDER BY sum(abs(phi)) DESC LIMIT 5)
SELECT prefix_id, feature, value, {r6('phi')} AS phi FROM phi WHERE feature IN (SELECT feature FROM top)""")
def shap_dependence_all(spark, d):
    """Values and attributions of the five features with the largest attributions."""
    found = G.shap_dependence(stage(every_phi(spark, d), "phi"), "prefix_id")
    return rounded_attributions(found)


# --- local explanations ------------------------------------------------------------------

EXPLAINED = f"""picked AS (SELECT prefix_id FROM (SELECT prefix_id, 99 + row_number() OVER (ORDER BY prefix_id) AS k FROM enc WHERE part = 'training') WHERE k % 25 = 0)"""


def explained_cases(rows: DataFrame) -> DataFrame:
    chosen = every_nth_case(rows.withColumn("bucket", F.lit(1)), "prefix_id", positional=True)
    return rows.join(chosen.select("prefix_id"), "prefix_id", "left_semi")


@query()
def lime_explain(spark, d):
    """Local surrogates of the numbered training cases."""
    rows = used_rows(spark, d).where(F.col("set") == "training")
    found = Y.lime_explain(rows, explained_cases(rows), "prefix_id", USED, SCORER, samples=200)
    return found.withColumn("explanation", F.to_json("explanation"))


@query()
def lime_repeats(spark, d):
    """Stability of repeated local surrogates of the numbered training cases."""
    rows = used_rows(spark, d).where(F.col("set") == "training")
    table = Y.lime_repeats(rows, explained_cases(rows), "prefix_id", USED, SCORER, calls=3, samples=100)
    return Y.lime_stability(table, "prefix_id")


REPEATS = """rep AS (SELECT l_orderkey, l_linenumber AS repeat, l_returnflag || l_linestatus AS feature, round(avg(l_discount), 6) AS weight, round(avg(l_tax), 6) / 10 + 0.001::DOUBLE AS se
  FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {REPEATS}, shape AS (SELECT l_orderkey, count(DISTINCT repeat) AS calls, count(*) / count(DISTINCT repeat) AS size FROM rep GROUP BY l_orderkey),
pairs AS (SELECT a.l_orderkey, a.feature, CASE WHEN greatest(a.weight - 1.96::DOUBLE * a.se, b.weight - 1.96::DOUBLE * b.se) <= least(a.weight + 1.96::DOUBLE * a.se, b.weight + 1.96::DOUBLE * b.se) THEN 1.0 ELSE 0.0 END AS met
  FROM rep a JOIN rep b ON a.l_orderkey = b.l_orderkey AND a.feature = b.feature AND a.repeat < b.repeat),
f AS (SELECT l_orderkey, feature, count(*) AS shared, avg(met) AS met FROM pairs GROUP BY ALL),
p AS (SELECT l_orderkey, sum(shared) AS shared, avg(met) AS met FROM f GROUP BY ALL)
SELECT s.l_orderkey, {r6('100 * coalesce(shared, 0) / nullif(calls * (calls - 1) / 2 * size, 0)')} AS vsi, {r6('100 * met')} AS csi FROM shape s LEFT JOIN p USING (l_orderkey)""")
def lime_stability(spark, d):
    repeats = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(
        "l_orderkey", F.col("l_linenumber").alias("repeat"), F.concat("l_returnflag", "l_linestatus").alias("feature")
    ).agg(F.round(F.avg("l_discount"), 6).alias("weight"), (F.round(F.avg("l_tax"), 6) / 10 + 0.001).alias("se"))
    return rounded_columns(Y.lime_stability(repeats, "l_orderkey"), "vsi", "csi")


@query(f"WITH {O.ENCODED_SET} SELECT prefix_id, {r6(O.score_sql())} AS probability, CASE WHEN y = 1 THEN 'Deviant' ELSE 'Regular' END AS class_type FROM enc WHERE part = 'testing'")
def lime_split_by_class(spark, d):
    scored = SCORER(used_rows(spark, d).where(F.col("set") == "testing"))
    split = Y.split_by_class(scored, "encoded_label")
    return split.select("prefix_id", rounded("score").alias("probability"), "class_type")


@query(f"""{PHI}, {EXPLAINED}, b AS (SELECT {base_sql(O.WEIGHTS, O.BIAS)} AS base),
o AS (SELECT phi.*, base, row_number() OVER w AS step, base + sum(phi) OVER w AS upto FROM phi, b WHERE prefix_id IN (SELECT prefix_id FROM picked) WINDOW w AS (PARTITION BY prefix_id ORDER BY abs(phi), feature))
SELECT prefix_id, feature, {r6('value')} AS value, {r6('phi', 9)} AS phi, {r6('base', 9)} AS base, step, {r6('upto', 9)} AS upto FROM o""")
def shap_local(spark, d):
    rows = used_rows(spark, d).where(F.col("set") == "training")
    phi, base = G.shap_linear(rows, "prefix_id", O.WEIGHTS, O.BIAS)
    path = Y.shap_local(phi, base, "prefix_id", explained_cases(rows)).withColumn("value", rounded("value"))
    return rounded_columns(path, "phi", "base", "upto", digits=9)


# --- comparisons -------------------------------------------------------------------------

GAIN = "gain AS (SELECT n_name AS feature, round(sum(o_totalprice), 2) AS score FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name)"
COEFS = "coefs AS (SELECT n_name AS variable, round(avg(c_acctbal), 4) AS coef FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name)"


def importance_tables(spark, d) -> tuple[DataFrame, DataFrame]:
    """Stand-ins for the two models' importances: order value and balance by nation."""
    orders, customer, nation = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer", "nation"))
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    gain = orders.join(placed, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("n_name").alias("feature")).agg(F.round(F.sum("o_totalprice"), 2).alias("score"))
    return gain, placed.groupBy(F.col("n_name").alias("variable")).agg(F.round(F.avg("c_acctbal"), 4).alias("coef"))


@query(f"""WITH {GAIN}, {COEFS}, a AS (SELECT row_number() OVER (ORDER BY score DESC, feature) AS rank, 'boosted' AS source, feature FROM gain),
b AS (SELECT row_number() OVER (ORDER BY coef DESC, variable) AS rank, 'logit' AS source, variable AS feature FROM coefs)
SELECT * FROM a WHERE rank <= 3 UNION ALL SELECT * FROM b WHERE rank <= 3""")
def important_features(spark, d):
    return X.important_features(*importance_tables(spark, d), n=3)


@query(f"""WITH {GAIN}, {COEFS}, a AS (SELECT 1 AS rank, 'boosted' AS source, feature FROM gain ORDER BY score DESC, feature LIMIT 1),
b AS (SELECT 1 AS rank, 'logit' AS source, variable AS feature FROM coefs ORDER BY coef DESC, variable LIMIT 1)
SELECT rank, min(source) AS source, feature FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY rank, feature""")
def important_feature_first(spark, d):
    return X.important_features(*importance_tables(spark, d), n=1)


# The features both models find important, by the size of their attributions.
TOP_TWO = """chosen AS (SELECT DISTINCT feature FROM (
  (SELECT feature FROM phi GROUP BY feature ORDER BY sum(abs(phi)) DESC LIMIT 1) UNION ALL (SELECT feature FROM phi2 GROUP BY feature ORDER BY sum(abs(phi)) DESC LIMIT 1)))"""


def top_features(rows: DataFrame) -> DataFrame:
    first, _ = G.shap_linear(rows, "prefix_id", O.WEIGHTS, O.BIAS)
    second, _ = G.shap_linear(rows, "prefix_id", OTHER, OTHER_BIAS)
    best = [G.shap_ranking(p, 1).select("feature", F.col("total").alias("score")) for p in (first, second)]
    return X.important_features(best[0], best[1].select(F.col("feature").alias("variable"), F.col("score").alias("coef")), n=1)


@query(f"""WITH {O.ENCODED_SET}, {TRAIN_SRC}, {phi_sql(O.WEIGHTS)}, {phi_sql(OTHER, 'phi2')}, {TOP_TWO}, {ale_sql(O.WEIGHTS, O.BIAS, 'a')}, {ale_sql(OTHER, OTHER_BIAS, 'b')}
SELECT feature, target, bin, {r6('a.edge')} AS edge, {r6('a.ale')} AS ale_boosted, {r6('b.ale')} AS ale_logit FROM a JOIN b USING (feature, target, bin) WHERE feature IN (SELECT feature FROM chosen)""")
def compare_ale(spark, d):
    rows = used_rows(spark, d).where(F.col("set") == "training")
    first, second = G.ale(rows, USED, SCORER), G.ale(rows, USED, M.closed_form(OTHER, OTHER_BIAS))
    return rounded_columns(X.compare_ale(first, second, top_features(rows)), "edge", "ale_boosted", "ale_logit")


def _perm_pair(out: str, weights: dict[str, float], bias: float) -> str:
    body = permutation_sql("training", weights, bias)
    for name in ("base", "plan", "moved0", "moved1", "moved2", "variants", "acc", "perm"):
        for before in (" ", "(", "\n", ","):
            for after in (" ", ")", ",", "\n"):
                body = body.replace(f"{before}{name}{after}", f"{before}{out}_{name}{after}")
        if body.startswith(f"{name} "):
            body = f"{out}_{body}"
    return body.replace("\nb AS (", f"\n{out}_b AS (").replace("_acc, b)", f"_acc, {out}_b)")


@query(f"""WITH {O.ENCODED_SET}, {TRAIN_SRC}, {phi_sql(O.WEIGHTS)}, {phi_sql(OTHER, 'phi2')}, {TOP_TWO}, {_perm_pair('u', O.WEIGHTS, O.BIAS)}, {_perm_pair('v', OTHER, OTHER_BIAS)}
SELECT feature, r + 1 AS repeat, {r6('u.drop_')} AS importance_boosted, {r6('v.drop_')} AS importance_logit FROM u_perm u JOIN v_perm v USING (feature, r) WHERE feature IN (SELECT feature FROM chosen)""")
def compare_permutation(spark, d):
    rows = used_rows(spark, d).where(F.col("set") == "training")
    first = G.permutation_importance(rows, "prefix_id", USED, SCORER)
    second = G.permutation_importance(rows, "prefix_id", USED, M.closed_form(OTHER, OTHER_BIAS))
    got = X.compare_permutation(first, second, top_features(rows))
    return rounded_columns(got, "importance_boosted", "importance_logit")


@query(f"""WITH {CORR}, p AS (SELECT feature_a, feature_b FROM m WHERE kind = 'num' AND abs(r) >= 0.6 AND feature_a <> feature_b AND feature_b <> 'encoded_label')
SELECT DISTINCT feature FROM (SELECT feature_a AS feature FROM p UNION ALL SELECT feature_b FROM p) ORDER BY feature LIMIT 8""")
def correlated_features(spark, d):
    es = staged_orders(spark, d)
    matrix = C.encoded_correlations(es.rows, es.features, es.categorical).where(F.col("kind") == "num").drop("kind")
    return X.correlated_features(matrix, 0.6)


@query(f"""WITH {O.ENCODED_SET}, {TRAIN_SRC}, {phi_sql(O.WEIGHTS)}, {phi_sql(OTHER, 'phi2')}, {TOP_TWO}
SELECT prefix_id, feature, {r6('phi.value')} AS value, {r6('phi.phi', 9)} AS phi_boosted, {r6('phi2.phi', 9)} AS phi_logit FROM phi JOIN phi2 USING (prefix_id, feature) WHERE feature IN (SELECT feature FROM chosen)""")
def compare_shap(spark, d):
    rows = used_rows(spark, d).where(F.col("set") == "training")
    first, _ = G.shap_linear(rows, "prefix_id", O.WEIGHTS, O.BIAS)
    second, _ = G.shap_linear(rows, "prefix_id", OTHER, OTHER_BIAS)
    both = X.compare_shap(first, second, "prefix_id", top_features(rows)).withColumn("value", rounded("value"))
    return rounded_columns(both, "phi_boosted", "phi_logit", digits=9)


TRIAL_LOGIT = "t AS (SELECT o_orderstatus AS details, CAST(o_orderkey % 2 + 1 AS INT) AS trial, CAST(month(o_orderdate) AS VARCHAR) AS variable, round(avg(o_totalprice), 4) AS coef FROM orders GROUP BY ALL)"


@query(f"""WITH {TRIAL_LOGIT}, r AS (SELECT *, row_number() OVER (PARTITION BY details, trial ORDER BY coef DESC, variable) AS rank FROM t)
SELECT details, 'Coefficient' AS type, variable, coef AS score, trial, rank FROM r WHERE rank <= 5""")
def compare_trials_logit(spark, d):
    trials = spark.read.parquet(f"{d}/orders.parquet").groupBy(
        F.col("o_orderstatus").alias("details"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("trial"), F.month("o_orderdate").cast("string").alias("variable")
    ).agg(F.round(F.avg("o_totalprice"), 4).alias("coef"))
    return X.compare_trials_logit(trials)


TRIAL_TREES = """g AS (SELECT 'orders' AS details, CAST(o_orderkey % 2 + 1 AS INT) AS trial, o_orderpriority AS feature, count(*) AS weight, round(avg(o_totalprice), 4) AS gain, round(sum(o_totalprice), 2) AS total_gain FROM orders GROUP BY ALL),
t AS (SELECT details, trial, feature, 'weight' AS type, CAST(weight AS DOUBLE) AS score FROM g UNION ALL SELECT details, trial, feature, 'gain', gain FROM g UNION ALL SELECT details, trial, feature, 'total_gain', total_gain FROM g)"""


@query(f"""WITH {TRIAL_TREES}, r AS (SELECT *, row_number() OVER (PARTITION BY details, trial, type ORDER BY score DESC, feature) AS rank FROM t)
SELECT a.details, a.type, a.rank, a.feature AS variable1, a.score AS score1, b.feature AS variable2, b.score AS score2 FROM r a JOIN r b ON a.details = b.details AND a.type = b.type AND a.rank = b.rank WHERE a.trial = 1 AND b.trial = 2 AND a.rank <= 4""")
def compare_trials_boosted(spark, d):
    g = spark.read.parquet(f"{d}/orders.parquet").groupBy(
        F.lit("orders").alias("details"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("trial"), F.col("o_orderpriority").alias("feature")
    ).agg(F.count("*").cast("double").alias("weight"), F.round(F.avg("o_totalprice"), 4).alias("gain"), F.round(F.sum("o_totalprice"), 2).alias("total_gain"))
    return X.compare_trials_boosted(g.unpivot(["details", "trial", "feature"], ["weight", "gain", "total_gain"], "type", "score"))


# --- clusters ----------------------------------------------------------------------------

def vectors(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


CENTRES = """x AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i),
dist AS (SELECT vec_id, x.label, sqrt(sum((v - m) * (v - m))) AS distance FROM x JOIN c ON x.label = c.label AND x.i = c.i GROUP BY vec_id, x.label)"""


@query(f"WITH {CENTRES} SELECT vec_id, label, {r6('distance')} AS distance FROM dist")
def centroid_distance(spark, d):
    return rounded_columns(U.centroid_distance(vectors(spark, d), "v", "label").select("vec_id", "label", "distance"), "distance")


@query(f"""WITH {CENTRES}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS near, row_number() OVER (PARTITION BY label ORDER BY distance DESC, vec_id) AS far FROM dist)
SELECT a.label, a.vec_id AS nearest, {r6('a.distance')} AS nearest_distance, b.vec_id AS farthest, {r6('b.distance')} AS farthest_distance FROM r a JOIN r b ON a.label = b.label AND a.near = 1 AND b.far = 1""")
def nearest_farthest(spark, d):
    got = U.nearest_farthest(U.centroid_distance(vectors(spark, d), "v", "label"), "vec_id", "label", complete=["v"])
    return rounded_columns(got, "nearest_distance", "farthest_distance")


def silhouette_sql(label: str) -> str:
    return f"""e AS (SELECT vec_id, {label} AS g, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id, a.g, b.g AS h, sum(list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS s, count(*) AS n FROM e a JOIN e b ON TRUE GROUP BY ALL),
w AS (SELECT vec_id, max(CASE WHEN g = h THEN s / greatest(1, n - 1) END) AS a, min(CASE WHEN g <> h THEN s / n END) AS b, max(CASE WHEN g = h THEN n END) AS n FROM p GROUP BY vec_id),
sil AS (SELECT avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM w)"""


@query(f"WITH {silhouette_sql('label')} SELECT {r6('silhouette')} AS silhouette FROM sil")
def silhouette(spark, d):
    return rounded_columns(U.silhouette(vectors(spark, d), "v", "label"), "silhouette")


@query()
def scan_clusters(spark, d):
    """Silhouettes of k-means for two to six clusters of the encoded set."""
    es = encoded_orders(spark, d)
    rows = stage(es.rows.where(F.col("set") == "training"), "encoded")
    return U.scan_clusters(rows, es.features)


SCORES = "s AS (SELECT n_name AS dataset, CAST(c_custkey % 5 + 2 AS INT) AS n_clusters, round(avg(c_acctbal), 4) AS silhouette FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY silhouette DESC, n_clusters) AS k FROM s) SELECT dataset, n_clusters, silhouette FROM r WHERE k = 1")
def best_k(spark, d):
    customer, nation = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation"))
    scores = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_name").alias("dataset"), (F.col("c_custkey") % 5 + 2).cast("int").alias("n_clusters")
    ).agg(F.round(F.avg("c_acctbal"), 4).alias("silhouette"))
    return U.best_k(scores, ["dataset"])


def clustered(spark, d, k: int = 3):
    es = encoded_orders(spark, d)
    rows = stage(es.rows.where(F.col("set") == "training"), "encoded")
    labelled = U.cluster_scaled(rows, es.features, k)
    return rows, U.centroid_distance(labelled, "scaled", "cluster_label")


@query()
def cluster_scaled(spark, d):
    """Cluster and centroid distance of every training prefix."""
    _, labelled = clustered(spark, d)
    return labelled.select("prefix_id", "cluster_label", rounded("distance").alias("distance"))


@query()
def explain_cluster_extremes(spark, d):
    """Local surrogate and attributions of the nearest and farthest member of each cluster, for both models."""
    rows, labelled = clustered(spark, d)
    ends = U.nearest_farthest(stage(labelled, "clusters"), "prefix_id", "cluster_label", complete=USED)
    chosen = ends.select(F.explode(F.array("nearest", "farthest")).alias("prefix_id")).distinct()
    cases = stage(rows.join(chosen, "prefix_id", "left_semi"), "extremes")
    parts = []
    for name, weights, bias in (("boosted", O.WEIGHTS, O.BIAS), ("logit", OTHER, OTHER_BIAS)):
        lime = Y.lime_explain(rows, cases, "prefix_id", USED, M.closed_form(weights, bias), samples=200)
        phi, base = G.shap_linear(rows, "prefix_id", weights, bias)
        path = Y.shap_local(phi, base, "prefix_id", chosen).groupBy("prefix_id").agg(
            F.to_json(F.array_sort(F.collect_list(F.struct("step", "feature", "phi", "upto")))).alias("path")
        )
        parts.append(lime.join(path, "prefix_id").select(
            F.lit(name).alias("model"), "prefix_id", "probability", F.to_json("explanation").alias("explanation"), "path"
        ))
    return G.union_all(parts)


# --- timing ------------------------------------------------------------------------------

def timing_tables(spark, d) -> tuple[DataFrame, ...]:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("method"),
        F.when(F.col("l_suppkey") % 2 == 0, "boosted").otherwise("logit").alias("cls"), F.col("l_linenumber").alias("prfx_len"),
        (F.col("l_partkey") % 4 - 1).alias("n_iter"), (F.col("l_quantity") / 10).alias("train_time"),
        F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("q"), F.col("l_tax").alias("t"),
    )
    keys = ["dataset", "method", "cls", "prfx_len"]
    shap = lines.where(F.col("prfx_len") > 1).groupBy(*keys).agg(F.avg("p").alias("seconds"))
    return lines, shap, lines.groupBy(*keys).agg(F.avg("q").alias("seconds")), lines.groupBy(*keys).agg(F.max("t").alias("seconds"))


TIMES = """t AS (SELECT l_returnflag AS dataset, l_linestatus AS method, CASE WHEN l_suppkey % 2 = 0 THEN 'boosted' ELSE 'logit' END AS cls, l_linenumber AS prfx_len,
  coalesce(avg(l_quantity / 10) FILTER (l_partkey % 4 - 1 <> -1), 0) AS prediction_time, coalesce(avg(l_extendedprice) FILTER (l_linenumber > 1), 0) AS shap_time, avg(l_discount) AS ale_time, max(l_tax) AS perm_time
  FROM lineitem GROUP BY ALL)"""
TIME_COLUMNS = ["prediction_time", "shap_time", "ale_time", "perm_time"]


@query(f"WITH {TIMES} SELECT dataset, method, cls, prfx_len, {', '.join(r6(c) + ' AS ' + c for c in TIME_COLUMNS)} FROM t")
def timing_table(spark, d):
    return rounded_columns(X.timing_table(*timing_tables(spark, d)), *TIME_COLUMNS)


@query(f"""WITH {TIMES} SELECT dataset, method, cls, string_agg(CAST(prfx_len AS VARCHAR), ',' ORDER BY prfx_len) AS prfx_len,
{', '.join(f"string_agg(CAST(CAST(round({c} * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY prfx_len) AS {c}" for c in TIME_COLUMNS)},
{r6('least(' + ', '.join(f'min({c})' for c in TIME_COLUMNS) + ')')} AS least, {r6('greatest(' + ', '.join(f'max({c})' for c in TIME_COLUMNS) + ')')} AS greatest FROM t GROUP BY dataset, method, cls""")
def timing_by_model(spark, d):
    got = X.timing_by_model(X.timing_table(*timing_tables(spark, d)))
    for c in TIME_COLUMNS:
        got = got.withColumn(c, F.array_join(F.transform(c, lambda x: F.round(x * 1e6).cast("long").cast("string")), ","))
    return rounded_columns(got.withColumn("prfx_len", F.array_join("prfx_len", ",")), "least", "greatest")
