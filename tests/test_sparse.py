"""Sparse encoded sets against the wide ones, and with more levels than columns can hold."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.operators import encode as E
from casewright.operators import model as M
from casewright.operators import prepare, sparse
from casewright.operators.prefix import generate_prefixes
from casewright.schema import LogSchema
from casewright.sources.artefacts import write_encoded, write_metrics
from casewright.sources.tables import ORDERS, orders_log

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def prefixes(spark):
    log = orders_log(spark, SMALL, gaps=True)
    part = F.when(F.crc32(F.col("original_case_id").cast("binary")) % 5 > 0, "training").otherwise("testing")
    return generate_prefixes(log, ORDERS, 1, 6).withColumn("set", part).cache()


@pytest.mark.parametrize("encoding", ["agg", "index"])
def test_entries_equal_the_wide_form(prefixes, encoding):
    got = sparse.sparse_set(prefixes, ORDERS, encoding)
    train = prefixes.where("set = 'training'")
    models = [E.fit(k, train, ORDERS) for k in ("static", encoding)]
    wide = E.encode(prefixes, ORDERS, models)
    names = [c for c in wide.columns if c != "prefix_id"]
    want = {}
    for r in wide.collect():
        want.update({(r["prefix_id"], c): float(r[c]) for c in names if r[c]})
    entries = {(r["prefix_id"], r["feature"]): r["value"] for r in got.long("prefix_id").collect()}
    assert entries.keys() == want.keys() and all(entries[k] == pytest.approx(want[k]) for k in want)
    assert got.rows.count() == wide.count() and got.width == got.vocabulary.count()
    first = got.rows.first()
    assert first["features"].size == got.width and first["features"].indices.tolist() == first["feature_ids"]


def test_a_sparse_fit_equals_a_wide_one(prefixes):
    got = sparse.sparse_set(prefixes, ORDERS)
    train = prefixes.where("set = 'training'")
    models = [E.fit(k, train, ORDERS) for k in ("static", "agg")]
    wide = E.encode(prefixes, ORDERS, models, keep=("set",)).join(got.rows.select("prefix_id", "encoded_label"), "prefix_id")
    features = [c for c in wide.columns if c not in ("prefix_id", "set", "encoded_label")]
    one = M.model_scorer(M.train_logit(wide.where("set = 'training'"), features, c=-4.0))(wide)
    two = M.model_scorer(sparse.train_logit(got.rows.where("set = 'training'"), c=-4.0))(got.rows)
    a, b = ({r["prefix_id"]: r["score"] for r in df.select("prefix_id", "score").collect()} for df in (one, two))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 2e-3


def test_twenty_thousand_levels_encode_and_train(spark):
    schema = LogSchema("w", case="case", activity="act", ts="ts", resource="res", label="label", dynamic_cat=("act", "res"), dynamic_num=("x",), tiebreak=("id",))
    start = dt.datetime(2024, 1, 1)
    rows = [
        (str(i // 10), "p" if i % 3 else "q", f"r{i}" if i % 2 else None, "deviant" if i // 10 % 2 else "regular", start + dt.timedelta(minutes=i), float(i % 7), i)
        for i in range(42_000)
    ]
    log = spark.createDataFrame(rows, "case string, act string, res string, label string, ts timestamp, x double, id long")
    whole = log.withColumn("prefix_id", F.col("case")).withColumn("set", F.when(F.col("case") % 20 == 0, "testing").otherwise("training"))
    got = sparse.sparse_set(whole, schema)
    assert got.width > 19_000
    fitted = sparse.train_logit(got.rows.where("set = 'training'"), max_iter=5)
    scored = M.model_scorer(fitted)(got.rows.where("set = 'testing'")).collect()
    # Resources of test cases are unknown, so their vectors hold the other features alone.
    assert len(scored) == 210 and all(r["features"].numNonzeros() <= 7 for r in scored)
    few = M.model_scorer(sparse.train_boosted(got.rows.where("set = 'training'").limit(200), n_trees=2, max_depth=2))(got.rows.limit(50))
    assert few.count() == 50


def test_codes_by_broadcast_and_by_join(spark, monkeypatch):
    rows = [(i, "a" if i % 3 else "b", None if i % 5 == 0 else f"v{i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, p string, q string")
    one = prepare.ordinal_codes(df, ["p", "q"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    # Only the ranked levels are shuffled, not the rows.
    assert "SortMergeJoin" not in plan
    monkeypatch.setattr(prepare, "CODES", 1)
    two = prepare.ordinal_codes(df, ["p", "q"])
    assert one.columns == two.columns
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert {r["q_code"] for r in two.collect() if r["q"] is None} == {-1}


def test_runs_can_be_repeated(spark, tmp_path):
    def sets(n):
        return spark.createDataFrame([("d", "m", n, "training", i) for i in range(3)], "dataset string, method string, prefix_length int, set string, v int")

    path = str(tmp_path / "sets")
    for n in (1, 2, 1):
        write_encoded(sets(n), path, "replace")
    assert spark.read.parquet(path).groupBy("prefix_length").count().orderBy("prefix_length").collect() == [(1, 3), (2, 3)]
    metrics = str(tmp_path / "metrics")
    rows = spark.createDataFrame([("auc", 0.5)], "metric string, score double")
    for run, score in (("one", 0.5), ("two", 0.6), ("one", 0.7)):
        write_metrics([rows.withColumn("score", F.lit(score))], metrics, run, "replace")
    got = {r["run"]: r["score"] for r in spark.read.parquet(metrics).collect()}
    assert got == {"one": 0.7, "two": 0.6} and np.isfinite(list(got.values())).all()
