"""Permutations and local effects scored in blocks, against those over full rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.operators import explain_global as G
from casewright.operators import model as M
from casewright.operators import overlay as V
from casewright.operators import tree_shap as T

FEATURES = ["a", "b", "c"]


def table(df):
    return sorted([tuple(np.round(v, 9).tolist() if isinstance(v, (float, list)) else v for v in r) for r in df.collect()], key=repr)


def made(spark, missing, n=500):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 3)).round(3)
    x[:, 2] = np.arange(n) % 4
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.2 * x[:, 2] + rng.normal(scale=0.4, size=n) > 0).astype(int)
    data = []
    for i in range(n):
        a, b, c = map(float, x[i])
        hole = missing and i % 7 == 0
        # Ids come twice, and some are missing.
        data.append((None if missing and i % 41 == 0 else i // 2, None if hole else a, b, None if hole and i % 2 else c, None if missing and i % 13 == 0 else int(y[i])))
    return spark.createDataFrame(data, "id int, a double, b double, c double, encoded_label int").cache()


def by_hand(rows, weights, bias, repeats):
    """Importances where a missing value or label gives no score: neither hit nor row."""
    known = sorted((r for r in rows.collect() if r["id"] is not None), key=lambda r: (hashlib.md5(f"{r['id']}_42".encode()).hexdigest(), r["id"]))
    x, y, n = np.array([r[1:4] for r in known], float), np.array([r[4] for r in known], float), len(known)
    primes = [p for p in G._PRIMES if n % p]

    def accuracy(change):
        margin = x @ weights + bias + change
        counted = ~np.isnan(margin) & ~np.isnan(y)
        return ((margin > 0) == y)[counted].mean()

    out = []
    for i, f in enumerate(FEATURES):
        drops = []
        for r in range(repeats):
            given = np.empty(n)
            given[(primes[(i + r) % len(primes)] * np.arange(n) + (i * repeats + r + 1) * 7919) % n] = x[:, i]
            drops.append(accuracy(0) - accuracy(weights[i] * (given - x[:, i])))
        out.append((f, *np.round([np.mean(drops), np.std(drops)], 9).tolist(), np.round(drops, 9).tolist()))
    return sorted(out, key=repr)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(V, "BLOCK_VALUES", 300)


@pytest.mark.parametrize("missing", [False, True])
def test_linear_blocks_are_rows(spark, small_blocks, missing):
    rows, weights = made(spark, missing), [1.0, -0.5, 0.3]
    # Equal ids need equal rows for the order of the permutation to be the same.
    rows = rows.dropDuplicates(["id"]) if missing else rows.withColumn("id", rows["id"] + rows["a"])
    rows = rows.cache()
    plain = M.closed_form(dict(zip(FEATURES, weights)), -0.1)
    vectors = V.linear_scorer(FEATURES, weights, -0.1)
    found = table(V.permutation_importance(rows, "id", vectors, repeats=4))
    if not missing:
        assert found == table(G.permutation_importance(rows, "id", FEATURES, plain, repeats=4))
        assert table(V.ale(rows, vectors, bins=6)) == table(G.ale(rows, FEATURES, plain, bins=6))
    else:
        assert found == by_hand(rows, weights, -0.1, 4)


@pytest.mark.parametrize("missing", [False, True])
def test_tree_blocks_are_rows(spark, small_blocks, missing):
    rows = made(spark, missing)
    rows = (rows.dropDuplicates(["id"]) if missing else rows.withColumn("id", rows["id"] + rows["a"])).cache()
    fitted = M.train_boosted(made(spark, False), FEATURES, n_trees=5, max_depth=4)
    plain, vectors = M.model_scorer(fitted), V.trained_scorer(fitted, FEATURES)
    known = rows.where("encoded_label IS NOT NULL")
    assert table(V.permutation_importance(known, "id", vectors, repeats=4)) == table(G.permutation_importance(known, "id", FEATURES, plain, repeats=4))
    assert table(V.ale(known, vectors, bins=6)) == table(G.ale(known, FEATURES, plain, bins=6))


def test_two_scorers_share_the_values(spark, small_blocks):
    rows = made(spark, False)
    scorers = [V.linear_scorer(FEATURES, w, 0.0) for w in ([1.0, -0.5, 0.3], [0.0, 1.0, 0.0])]
    both = [table(f) for f in V.permutation_importances(rows, "id", scorers, repeats=3)]
    assert both == [table(V.permutation_importance(rows, "id", s, repeats=3)) for s in scorers]


def test_values_travel_in_parcels(spark):
    """A batch sends a block at most three rows, whatever the numbers of features and repeats."""
    import pyarrow as pa

    n, size = 1000, 100
    x = np.column_stack([np.arange(n) % 5, np.linspace(0, 1, n)]).astype(float)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(1, n + 1)), pa.array(np.zeros(n)), pa.array(x.tolist())], ["_rank", "_label", V.VECTOR]
    )
    sent = [r for b in V._parcels(2, 10, n, size)(iter([batch])) for r in b.to_pylist()]
    assert len(sent) <= 3 * n // size
    # Every row gets a value for each feature and repeat; whole numbers take a byte.
    values = [r for r in sent if r["features"]]
    assert sum(len(r["spots"]) // 2 for r in values) == n * 2 * 10
    assert sum(len(r["given"]) for r in values) == n * 10 * (1 + 8)


def test_staged_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(M, "FILE_ROWS", 60)
    rows = M.stage_partitions(made(spark, False), ["encoded_label"])
    files = rows.select(F.input_file_name().alias("file")).groupBy("file").count().collect()
    assert sum(r["count"] for r in files) == 500 and max(r["count"] for r in files) <= 60


def test_attributions_of_one_batch_equal_those_row_by_row(spark):
    """Also for leaves with more features than are tabulated, and for leaves with more than eight."""
    rng = np.random.default_rng(3)
    for m in (3, 9, 12):
        leaf = T.Leaf(1.5, list(range(m)), rng.uniform(0.2, 0.8, m).tolist(), [[(j, bool(j % 2))] for j in range(m)])
        tree = T.Tree(np.arange(m), np.zeros(m), [leaf])
        x = rng.normal(size=(40, m))
        want = np.array([leaf.attributions([(r[j] <= 0) == bool(j % 2) for j in range(m)]) for r in x])
        assert np.allclose(T.Attributor([tree], m)(x), want, rtol=1e-12, atol=1e-15)
