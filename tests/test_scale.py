"""What has to hold on large and skewed data: salting, blocks of hot groups, plans."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casewright.functions import keyed, ordering
from casewright.functions.frames import to_long
from casewright.operators import associate, prefix
from casewright.operators.encode import encode_running, fit
from casewright.operators.prepare import filter_cases
from casewright.sources.tables import ORDERS, orders_log
from casewright.operators.profile import derive_time_features
from casewright.plans import registry
from casewright.plans.encoded import encoded_with_label

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def several_blocks(spark):
    """Small data would be merged into a single block."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows, a third of them in one group, with many equal values."""
    rng = np.random.default_rng(1)
    n = 20000
    groups = np.where(rng.random(n) < 0.34, "hot", np.char.add("g", rng.integers(0, 500, n).astype(str)))
    pdf = pd.DataFrame({"g": groups, "v": np.round(rng.normal(size=n), 1), "id": np.arange(n)})
    return pdf, spark.createDataFrame(pdf).repartition(6).cache()


def test_hot_keys_and_salted_join(spark, skewed):
    pdf, df = skewed
    hot = keyed.hot_keys(df, "g", share=10, min_rows=100, check_bytes=0)
    assert hot == ["hot"]
    facts = spark.createDataFrame(pd.DataFrame({"g": sorted(set(pdf.g) - {"g7"}), "w": range(pdf.g.nunique() - 1)}))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = df.join(facts, "g", how)
        salted = keyed.spread_join(df, facts, "g", how, hot=hot)
        assert sorted(salted.columns) == sorted(plain.columns)
        assert salted.select(*plain.columns).exceptAll(plain).count() == 0 and salted.count() == plain.count()


def test_salt_spreads_a_hot_key(spark, skewed):
    _, df = skewed
    sizes = [r[1] for r in df.where("g = 'hot'").groupBy(keyed.row_salt(df, 8)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_small_inputs_are_not_searched(skewed):
    assert keyed.hot_keys(skewed[1], "g") == []


def test_scan_within_over_several_blocks(spark, skewed):
    pdf, df = skewed
    got = ordering.scan_within(df, ["g"], ["v", "id"], rank="r", sums={"s": "id"}, lags={"p": "id"}).toPandas()
    want = pdf.sort_values(["g", "v", "id"])
    want["r"] = want.groupby("g").cumcount() + 1
    want["s"] = want.groupby("g")["id"].cumsum()
    want["p"] = want.groupby("g")["id"].shift(1)
    both = want.merge(got, on=["g", "v", "id"], suffixes=("", "_got"))
    assert len(both) == len(pdf)
    assert (both.r == both.r_got).all() and (both.s == both.s_got).all()
    assert (both.p.fillna(-1) == both.p_got.fillna(-1)).all()


def test_hot_group_spans_blocks(skewed):
    blocks = ordering.sorted_blocks(skewed[1], ["g", "v", "id"])
    spread = blocks.where("g = 'hot'").select(ordering._BLOCK).distinct().count()
    assert spread > 1


def test_global_rank(spark, skewed):
    pdf, df = skewed
    ranked, total = ordering.with_total(df, ["v", "id"])
    got = ranked.orderBy("rank").toPandas()
    assert total == len(pdf) and list(got["rank"]) == list(range(1, total + 1))
    assert list(got["id"]) == list(pdf.sort_values(["v", "id"])["id"])


def test_exact_quantiles(skewed):
    pdf, df = skewed
    probs = {"a": 0.0, "b": 0.1, "c": 0.333, "d": 0.5, "e": 1.0}
    got = ordering.exact_quantiles(df, ["g"], "v", probs).toPandas().set_index("g")
    want = pdf.groupby("g")["v"].quantile(list(probs.values())).unstack()
    for name, p in probs.items():
        assert np.allclose(got[name].loc[want.index], want[p])
    whole = ordering.exact_quantiles(df, [], "v", {"m": 0.25}).first()[0]
    assert whole == pytest.approx(np.quantile(pdf.v, 0.25))


def test_neighbour_counts_with_small_runs(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(300), "y": rng.integers(0, 3, 300), "value": np.round(rng.normal(size=300), 1)})
    long = spark.createDataFrame(pdf).withColumn("feature", F.lit("f"))
    got = associate.neighbour_counts(long, "id", "y", 3, block=16).toPandas().set_index("id")
    for _, a in pdf.iterrows():
        own = pdf[(pdf.y == a.y) & (pdf.id != a.id)]
        radius = np.sort(np.abs(own.value - a.value))[2]
        assert got.loc[a.id, "radius"] == pytest.approx(radius)
        gap = np.abs(pdf.value - a.value)
        inside = (gap == 0).sum() if radius == 0 else ((pdf.value > a.value - got.loc[a.id, "radius"]) & (pdf.value < a.value + got.loc[a.id, "radius"])).sum()
        assert got.loc[a.id, "inside"] == inside


def test_a_case_with_a_third_of_all_events(spark):
    """Split, encoding and time features of a log with one very long case, against pandas."""
    rng = np.random.default_rng(8)
    n = 9000
    case = np.where(rng.random(n) < 0.33, "long", np.char.add("c", rng.integers(0, 400, n).astype(str)))
    pdf = pd.DataFrame({
        "case_id": case, "event_id": np.arange(n), "activity": rng.choice(["p", "q"], n), "resource": rng.choice(["r", "s"], n),
        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 5_000_000, n), unit="s"), "totalprice": rng.normal(size=n),
        "segment": "x", "nation": "y", "acctbal": 1.0,
    })
    pdf["label"] = np.where(pdf.case_id.str.len() % 2 == 0, "deviant", "regular")
    log = spark.createDataFrame(pdf)
    got = encoded_with_label(log, ORDERS, max_length=6).rows.groupBy("set").agg(F.count("*").alias("n"), F.sum("agg__sum_totalprice").alias("s")).collect()
    starts = pdf.groupby("case_id")["ts"].min().reset_index().sort_values(["ts", "case_id"])
    first = set(starts["case_id"][: int(0.8 * len(starts))])
    test = pdf[~pdf.case_id.isin(first)]
    train = pdf[pdf.case_id.isin(first) & (pdf.ts < test.ts.min())]
    for r in got:
        part = (train if r["set"] == "training" else test).sort_values(["ts", "activity", "event_id"])
        heads = part.groupby("case_id").head(6)
        assert r["n"] == len(heads)
        assert r["s"] == pytest.approx(heads.groupby("case_id")["totalprice"].cumsum().sum())
    timed = derive_time_features(log, ORDERS).toPandas().set_index("event_id")
    ordered = pdf.sort_values(["case_id", "ts", "activity", "event_id"])
    assert (timed.loc[ordered.event_id, "event_nr"].to_numpy() == ordered.groupby("case_id").cumcount() + 1).all()
    gaps = ordered.groupby("case_id")["ts"].diff().dt.total_seconds().fillna(0)
    assert np.allclose(timed.loc[ordered.event_id, "timesincelastevent"], gaps)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_case_heads_limit_before_the_shuffle(spark):
    text = plan(prefix.case_heads(orders_log(spark, FOLDER), ORDERS, 14))
    assert "WindowGroupLimit" in text and text.count("Partial") >= 1


def test_running_encoder_shuffles_once(spark):
    log = spark.read.parquet(f"{FOLDER}/orders.parquet").selectExpr(
        "cast(o_custkey as string) case_id", "o_orderkey event_id", "o_orderpriority activity", "o_orderdate ts", "o_orderstatus resource",
        "o_totalprice totalprice", "o_orderstatus segment", "o_orderstatus nation", "o_totalprice acctbal", "o_orderstatus label",
    )
    models = [fit(k, prefix.generate_prefixes(log, ORDERS, 1, 5), ORDERS) for k in ("static", "agg")]
    assert len(re.findall(r"Exchange hashpartitioning", plan(encode_running(log, ORDERS, models, 5)))) == 1


def test_scan_reads_only_needed_columns(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    text = plan(lines.where("l_quantity > 10").groupBy("l_returnflag").count())
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in text
    assert re.search(r"ReadSchema: struct<l_quantity:double,l_returnflag:string>", text)


def test_no_cross_joins_in_registered_plans(spark):
    registry.load()
    for name in ("log_statistics", "generate_prefixes", "cramers_v", "pair_scatter", "shap_linear", "centroid_distance", "timing_table"):
        text = plan(registry.QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_filter_cases_with_a_hot_case(spark, monkeypatch):
    monkeypatch.setattr("casewright.operators.prepare.hot_keys", lambda df, key: ["1"])
    log = orders_log(spark, FOLDER)
    cases = log.where("activity = '5-LOW'")
    kept = filter_cases(log, ORDERS, cases)
    assert "_salt" in plan(kept)
    assert kept.count() == log.join(cases.select("case_id").distinct(), "case_id", "left_semi").count()


def test_mutual_information_scans_values_and_not_points(spark, monkeypatch):
    rng = np.random.default_rng(5)
    few, many = rng.integers(0, 6, 400).astype(float), rng.integers(0, 300, 400) / 4
    # Ids that are null or come again, a class of one point, and rows without a class or a value.
    data = [
        (None if i % 50 == 7 else i - i % 40 % 2 * (i % 5 == 0), None if i % 60 == 11 else 9 if i == 3 else int(v > 2), float(v), None if i % 30 == 1 else float(w))
        for i, (v, w) in enumerate(zip(few, many))
    ]
    rows = spark.createDataFrame(data, "id int, y int, few double, many double")
    counts = associate.neighbour_counts(to_long(rows, ["id", "y"], ["few", "many"]), "id", "y", 3).toPandas()

    def digamma(n):
        return -np.euler_gamma + sum(1 / i for i in range(1, int(n)))

    want = {}
    for f, own in counts[counts.y.notna()].groupby("feature"):
        size = own.groupby("y").id.transform("size")
        want[f] = max(0.0, digamma(len(own)) + np.mean([digamma(k) - digamma(s) - digamma(m) for k, s, m in zip(own.k, size, own.inside)]))
    scanned, blocks = [], []
    scan, sort = associate.scan_within, ordering.sorted_blocks
    monkeypatch.setattr(associate, "scan_within", lambda df, *args, **kw: scanned.append(df.count()) or scan(df, *args, **kw))

    def counted(*args, **kw):
        got = sort(*args, **kw)
        blocks.extend(r["count"] for r in got.groupBy("__block").count().collect())
        return got

    # The session has fewer shuffle partitions than this needs.
    monkeypatch.setattr(ordering, "sorted_blocks", counted)
    monkeypatch.setattr(associate, "SCAN_ROWS", 100)
    got = {r["feature"]: r["mi"] for r in associate.mutual_info_continuous(rows, "id", ["few", "many"], "y").collect()}
    assert got == pytest.approx(want, abs=1e-9)
    distinct = sum(len({(r[1], r[c]) for r in data if r[c] is not None}) for c in (2, 3))
    assert max(scanned) <= 3 * distinct and distinct < 500
    # Ranges are cut by a sample of the rows.
    assert max(blocks) <= 300
