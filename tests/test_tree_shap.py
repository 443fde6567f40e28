"""Exact tree attributions against all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.operators import model as M
from casewright.operators import tree_shap as T

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def forest(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 4)).round(2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.2)).astype(int)
    rows = [(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, encoded_label int").cache()
    fitted = M.train_boosted(df, FEATURES, n_trees=6, max_depth=4, seed=3)
    path = str(tmp_path_factory.mktemp("trees") / "model")
    return df, fitted, path


def worth(nodes, i, x, known):
    """Expected value of a tree when only some features are known."""
    node = nodes[i]
    if node["leftChild"] < 0:
        return node["prediction"]
    sides = [node["leftChild"], node["rightChild"]]
    if node["feature"] in known:
        return worth(nodes, sides[0] if x[node["feature"]] <= node["threshold"] else sides[1], x, known)
    return sum(nodes[s]["rawCount"] / node["rawCount"] * worth(nodes, s, x, known) for s in sides)


def test_attributions_equal_all_subsets(spark, forest):
    df, fitted, path = forest
    phi, base = T.shap_trees(df.limit(12), "id", FEATURES, fitted, path)
    nodes = {}
    for n in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        split = n["split"]
        nodes.setdefault(n["treeID"], {})[n["id"]] = {
            "leftChild": n["leftChild"], "rightChild": n["rightChild"], "prediction": n["prediction"], "rawCount": n["rawCount"],
            "feature": split["featureIndex"], "threshold": (split["leftCategoriesOrThreshold"] or [None])[0],
        }
    weights = fitted.stages[-1].treeWeights

    def margin(x, known):
        return sum(2 * w * worth(nodes[t], 0, x, known) for t, w in enumerate(weights))

    assert base.first()[0] == pytest.approx(margin([0.0] * 4, ()))
    got = {(r["id"], r["feature"]): r["phi"] for r in phi.collect()}
    for r in df.limit(12).collect():
        x = [r[f] for f in FEATURES]
        for j, f in enumerate(FEATURES):
            others = [k for k in range(4) if k != j]
            want = sum(
                factorial(n) * factorial(3 - n) / factorial(4) * (margin(x, {*s, j}) - margin(x, s))
                for n in range(4) for s in combinations(others, n)
            )
            assert got[r["id"], f] == pytest.approx(want, abs=1e-9)


def test_attributions_add_up_to_the_log_odds(forest):
    df, fitted, path = forest
    # Missing values take the way they take in scoring.
    some = df.withColumn("a", F.when(F.col("id") % 5 > 0, F.col("a")))
    phi, base = T.shap_trees(some, "id", FEATURES, fitted, path)
    start = base.first()[0]
    sums = phi.groupBy("id").agg(F.sum("phi").alias("s"), F.count("*").alias("n"))
    rows = sums.join(M.model_scorer(fitted)(some), "id").collect()
    assert len(rows) == 500 and {r["n"] for r in rows} == {4}
    for r in rows:
        assert start + r["s"] == pytest.approx(np.log(r["score"] / (1 - r["score"])), abs=1e-6)


def test_long_paths_and_single_leaves(forest, monkeypatch):
    df, fitted, path = forest
    trees = T.read_trees(fitted, path)
    x = np.array([[r[f] for f in FEATURES] for r in df.limit(50).collect()])
    plain = T.Attributor(trees, 4)(x)
    monkeypatch.setattr(T, "TABULATED", 1)
    assert np.allclose(T.Attributor(trees, 4)(x), plain)
    assert not T.Attributor([T.Tree(np.zeros(0, int), np.zeros(0), [T.Leaf(3.0)])], 4)(x).any()
    assert T.expected_margin([T.Tree(np.zeros(0, int), np.zeros(0), [T.Leaf(3.0)])]) == 3.0


def test_empty_input(forest):
    df, fitted, path = forest
    phi, base = T.shap_trees(df.limit(0), "id", FEATURES, fitted, path)
    assert phi.count() == 0 and base.count() == 1
