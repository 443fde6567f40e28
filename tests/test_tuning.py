"""Sequential tuning, fits by bucket and the chain from trials to test AUC."""

import random
import re
import threading

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.operators import metrics as K
from casewright.operators import model as M
from casewright.operators import tuning as T
from casewright.session import scratch_path

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 2))
    y = (x[:, 0] * (1 + np.arange(900) % 3) - x[:, 1] + rng.normal(scale=0.7, size=900) > 0).astype(int)
    data = [(i, float(v[0]), float(v[1]), int(t), i % 3 + 1, int(i // 3 % 3)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id int, a double, b double, encoded_label int, bucket long, fold int").cache()


def test_densities_integrate_to_one_and_draw_inside():
    p = T.Parzen([0.1, 0.15, 0.9], 0.0, 1.0)
    grid = np.linspace(0, 1, 20_001)
    assert np.mean(np.exp([p.log_density(v) for v in grid])) == pytest.approx(1, abs=1e-3)
    rng = random.Random(1)
    assert all(0 <= p.draw(rng) <= 1 for _ in range(500))
    assert p.log_density(0.12) > p.log_density(0.5)


def test_search_beats_even_draws_at_equal_trials():
    def score(t):
        return -((t["x"] - 3.3) ** 2) - abs(t["k"] - 7) - 0.5 * (t["z"] - 0.2) ** 2

    space = {"x": ("real", -15.0, 15.0), "k": ("whole", 1, 30), "z": ("real", 0.0, 1.0)}
    ahead, found, drawn = 0, [], []
    for seed in range(20):
        one = max(s for _, s in T.tpe_search(score, space, 40, seed))
        two = max(s for _, s in T.tpe_search(score, space, 40, seed, first=40))
        ahead += one > two
        found.append(one)
        drawn.append(two)
    assert ahead >= 14 and np.median(found) > np.median(drawn)
    one = T.tpe_search(score, space, 12, 3)
    assert one == T.tpe_search(score, space, 12, 3)
    assert all(isinstance(t["k"], int) and 1 <= t["k"] <= 30 and -15 <= t["x"] <= 15 for t, _ in one)
    # Failed trials do not stop the search.
    assert len(T.tpe_search(lambda t: float("nan"), space, 8)) == 8


def test_fits_run_at_the_same_time_in_pools(spark):
    seen, gate = [], threading.Barrier(3, timeout=60)

    def job(n):
        gate.wait()
        seen.append(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        return n

    assert M.concurrently([lambda n=n: job(n) for n in range(3)], 3, spark) == [0, 1, 2]
    assert len(set(seen)) == 3 and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_each_bucket_reads_its_own_folder(spark, rows):
    many = rows.withColumn("bucket", (F.col("id") % 40).cast("long"))
    staged = M.stage_partitions(many, ["bucket"])
    assert staged.columns == many.columns and staged.count() == 900
    own = staged.where("bucket = 7")
    plan = own._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "PushedFilters: []" in plan
    files = [r[0] for r in own.select(F.input_file_name()).distinct().collect()]
    assert files and all("bucket=7/" in f for f in files)
    # An empty and a null bucket do no harm.
    odd = M.stage_partitions(rows.limit(3).withColumn("bucket", F.lit(None).cast("long")), ["bucket"])
    assert odd.count() == 3 and odd.where("bucket = 1").count() == 0


def test_parallel_fits_equal_single_ones(rows):
    staged = M.stage_partitions(rows, ["bucket"])
    one = M.bucket_models(rows, FEATURES, "logit").score(rows)
    two = M.bucket_models(staged, FEATURES, "logit", parallel=3).score(staged)
    a, b = ({r["id"]: r["score"] for r in df.collect()} for df in (one, two))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


@pytest.mark.parametrize("method", ["logit", "boosted"])
def test_trials_and_their_auc(spark, rows, method):
    fixed = {"max_iter": 15} if method == "logit" else {"n_trees": 2}
    space = None if method == "logit" else {**T.SPACES["boosted"], "max_depth": ("whole", 2, 3)}
    trials = T.tune(rows, FEATURES, method, 3, space=space, fixed=fixed)
    got = trials.collect()
    n_params = len(T.SPACES[method])
    assert len(got) == 3 * n_params * 4 and {r["iter"] for r in got} == {1, 2, 3} and {r["bucket"] for r in got} == {0, 1, 2, 3}
    best = M.best_params(trials)
    params = T.chosen_params(best, method)
    assert set(params) == {None, 1, 2, 3} and all(set(p) == set(T.SPACES[method]) for p in params.values())
    models = M.bucket_models(M.stage_partitions(rows, ["bucket"]), FEATURES, method, {b: {**p, **fixed} for b, p in params.items()}, parallel=2)
    assert len(models.models) == 3
    # The AUC of the staged scores, by the pairwise definition.
    scored = T.fold_scores(M.stage_partitions(rows, ["fold", "bucket"]), FEATURES, method, {**params[None], **fixed})
    path = scratch_path(spark, "fold-scores").removeprefix("file:")
    scored.write.parquet(path)
    want = dict(duckdb.sql(f"""
        SELECT bucket, sum(auc) / 3 FROM (SELECT a.bucket, a.fold, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc
        FROM '{path}/*.parquet' a JOIN '{path}/*.parquet' b ON a.bucket = b.bucket AND a.fold = b.fold AND a.encoded_label = 1 AND b.encoded_label = 0
        GROUP BY ALL) GROUP BY bucket""").fetchall())
    found = T.fold_auc(spark.read.parquet(path))
    assert {b: round(v, 9) for b, v in want.items()} == {b: round(v, 9) for b, v in found.items() if b is not None}
    assert found[None] == pytest.approx(K.auc(spark.read.parquet(path), by=["fold"]).agg(F.avg("auc")).first()[0])


def test_folds_without_rows_or_classes(rows):
    # Bucket 9 exists in one fold alone, bucket 8 has one class.
    odd = rows.unionByName(rows.limit(4).withColumns({"bucket": F.lit(9).cast("long"), "fold": F.lit(0)}))
    odd = odd.unionByName(rows.where("encoded_label = 1").limit(9).withColumns({"bucket": F.lit(8).cast("long"), "fold": (F.col("id") % 3).cast("int")}))
    scored = T.fold_scores(M.stage_partitions(odd, ["fold", "bucket"]), FEATURES, "logit", {"max_iter": 5}, default=0.25).collect()
    assert len(scored) == odd.count()
    assert {r["score"] for r in scored if r["bucket"] == 9} == {0.25}
    assert {r["score"] for r in scored if r["bucket"] == 8} <= {1.0, 0.25}


def test_trials_share_scalings(rows, monkeypatch):
    parts = []
    monkeypatch.setattr(T, "scaling", lambda *args: parts.append(1) or M.scaling(*args))
    shared = T.tune(rows, FEATURES, "logit", 2, fixed={"max_iter": 5}).collect()
    assert len(parts) == 9 and {r["iter"] for r in shared} == {1, 2}


def test_rows_are_scored_once_for_both_aucs(spark, rows):
    scored, seen = rows, spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(a):
        seen.add(1)
        return round(a, 1)

    scored = scored.withColumn("score", score("a"))
    found = T.fold_auc(scored)
    assert seen.value == 900
    plain = scored.withColumn("score", F.round("a", 1))
    assert found[None] == pytest.approx(K.auc(plain, by=["fold"]).agg(F.avg("auc")).first()[0])
    one = T.fold_auc(plain.where("bucket = 2"))
    assert one[2] == one[None] == pytest.approx(found[2])


def test_a_boosted_fit_assembles_its_rows_once(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def same(a):
        seen.add(1)
        return a

    plain = M.train_boosted(rows, FEATURES, n_trees=2, max_depth=2, subsample=0.7)
    model = M.train_boosted(rows.withColumn("a", same("a")), FEATURES, n_trees=2, max_depth=2, subsample=0.7)
    assert seen.value == 900 and model.stages[-1].toDebugString.split("\n")[1:] == plain.stages[-1].toDebugString.split("\n")[1:]
