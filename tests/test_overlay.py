"""Explanations over patched vectors against those over full rows."""

import numpy as np
import pytest

from casewright.operators import explain_global as G
from casewright.operators import model as M
from casewright.operators import overlay as V

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)).round(3)
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(scale=0.4, size=300) > 0).astype(int)
    data = [(i, *map(float, v[:2]), float(i % 4), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id int, a double, b double, c double, encoded_label int").cache()


def table(df):
    return sorted([tuple(np.round(v, 9).tolist() if isinstance(v, (float, list)) else v for v in r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("method", ["logit", "boosted"])
def test_patched_vectors_score_as_rows(rows, method):
    fitted = M.TRAINERS[method](rows, FEATURES, **({"n_trees": 4, "max_depth": 3} if method == "boosted" else {"max_iter": 20}))
    plain, vectors = M.model_scorer(fitted), V.trained_scorer(fitted, FEATURES)
    scored = vectors.plain(vectors.prepare(rows.select("id", V.feature_vector(FEATURES)))).select("id", "score")
    assert table(scored) == table(plain(rows).select("id", "score"))
    assert table(V.permutation_importance(rows, "id", vectors, repeats=3)) == table(
        G.permutation_importance(rows, "id", FEATURES, plain, repeats=3))
    assert table(V.ale(rows, vectors, bins=6)) == table(G.ale(rows, FEATURES, plain, bins=6))


def test_a_thousand_features_keep_the_plan_small(spark):
    n = 1000
    names = [f"f{i}" for i in range(n)]
    rng = np.random.default_rng(1)
    data = [(i, *map(float, rng.normal(size=n)), i % 2) for i in range(20)]
    wide = spark.createDataFrame(data, ", ".join(["id int", *(f"f{i} double" for i in range(n)), "encoded_label int"]))
    scorer = V.linear_scorer(names, [1.0, *[0.0] * (n - 1)], 0.0)
    found = V.permutation_importance(wide, "id", scorer, repeats=10)
    # Columns of the variants: rank, label, vector, margin, number and value; never one per feature.
    got = found.collect()
    assert len(got) == n and all(len(r["importances"]) == 10 for r in got)
    assert all(r["mean"] == 0 for r in got if r["feature"] != "f0")


def test_queries_load_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120).stdout.strip() == "True"
