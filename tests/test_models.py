"""Invariants of models, explanations, clusters and the stream."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.functions.frames import to_long
from casewright.operators import cluster, compare, encode, explain_global as G, explain_local as Y, model as M
from casewright.operators.overlay import trained_scorer
from casewright.sources.tables import SESSIONS, sessions_log
from casewright.streaming.running_cases import score_running_cases

FOLDER = "/root/testdata/sf0.001"
FEATURES = ["a", "b", "c"]
WEIGHTS = {"a": 1.0, "b": -0.5}
SCORER = M.closed_form(WEIGHTS, 0.2)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(scale=0.5, size=400) > 0).astype(int)
    data = [(i, float(v[0]), float(v[1]), float(v[2]), int(t), 1 if i < 380 else 2) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id int, a double, b double, c double, encoded_label int, bucket int").cache()


def test_logit_matches_its_optimum(rows):
    fitted = M.train_logit(rows, FEATURES, c=0.0)
    pdf = rows.toPandas()
    z = pdf[FEATURES].to_numpy()
    z = (z - z.mean(axis=0)) / z.std(axis=0, ddof=1)
    w, b = np.array(fitted.stages[-1].coefficients), fitted.stages[-1].intercept
    p = 1 / (1 + np.exp(-(z @ w + b)))
    gradient = z.T @ (p - pdf.encoded_label) + w
    assert np.abs(gradient).max() < 1e-3


def test_boosted_repeats_and_importances(rows, tmp_path):
    params = {"n_trees": 5, "max_depth": 3, "seed": 1}
    one, two = (M.train_boosted(rows, FEATURES, **params) for _ in range(2))
    score = lambda m: [r["score"] for r in M.model_scorer(m)(rows).orderBy("id").collect()]
    assert score(one) == score(two)
    imp = {(r["type"], r["feature"]): r["score"] for r in G.tree_importances(one, FEATURES, str(tmp_path / "t")).collect()}
    for f in FEATURES:
        if ("weight", f) in imp:
            assert imp["total_gain", f] == pytest.approx(imp["gain", f] * imp["weight", f])
            assert imp["total_cover", f] == pytest.approx(imp["cover", f] * imp["weight", f])
    assert imp["total_gain", "a"] > imp.get(("total_gain", "c"), 0)


def test_buckets_and_fallbacks(spark, rows):
    train = rows.where("bucket = 1").unionByName(rows.where("bucket = 2").withColumn("encoded_label", F.lit(1)))
    models = M.bucket_models(train, FEATURES, "logit", default=0.3)
    other = rows.limit(3).withColumn("bucket", F.lit(9))
    scored = models.score(rows.unionByName(other)).collect()
    assert {r["score"] for r in scored if r["bucket"] == 2} == {1.0}
    assert {r["score"] for r in scored if r["bucket"] == 9} == {0.3}
    assert len(scored) == 403
    few = M.fallback_predictor(SCORER(rows), rows, min_cases=30, two_columns=True).collect()
    assert len({r["score"] for r in few if r["bucket"] == 2}) == 1
    assert all(r["score"] + r["score_negative"] == pytest.approx(1) for r in few)


def test_search_space_is_seeded():
    assert M.search_space("boosted", 3) == M.search_space("boosted", 3)
    assert all(4 <= t["max_depth"] <= 30 and 1 <= t["min_child"] <= 6 for t in M.search_space("boosted", 50))


def test_permutation_of_unused_feature_is_zero(rows):
    got = {r["feature"]: r for r in G.permutation_importance(rows, "id", FEATURES, SCORER, repeats=4).collect()}
    assert got["c"]["importances"] == [0.0] * 4 and got["a"]["mean"] > 0.1
    assert len(got["a"]["importances"]) == 4


def test_permutation_plan_is_a_permutation():
    for n in (400, 1000003, 7):
        for p in [p for p in G._PRIMES if n % p][:3]:
            m = min(n, 5000)
            assert n > 5000 or sorted((p * d + 11) % n for d in range(n)) == list(range(n))
            assert math.gcd(p, n) == 1 and m


def test_ale_is_centred_and_mirrored(rows):
    got = G.ale(rows, FEATURES, SCORER, bins=8).collect()
    for f in FEATURES:
        up = sorted([r for r in got if r["feature"] == f and r["target"] == "deviant"], key=lambda r: r["bin"])
        down = sorted([r for r in got if r["feature"] == f and r["target"] == "regular"], key=lambda r: r["bin"])
        assert [r["ale"] for r in up] == [-r["ale"] for r in down]
    line = [r["ale"] for r in sorted((r for r in got if r["feature"] == "a" and r["target"] == "deviant"), key=lambda r: r["bin"])]
    assert line == sorted(line) and line[0] < 0 < line[-1]
    assert all(r["ale"] == 0 for r in got if r["feature"] == "c")


def test_sampled_attributions_add_up(rows):
    phi, base = G.shap_sampled(rows, "id", FEATURES, SCORER, orders=3)
    start = base.first()[0]
    total = phi.groupBy("id").agg(F.sum("phi").alias("s")).join(SCORER(rows), "id").collect()
    assert len(total) == 400
    assert all(start + r["s"] == pytest.approx(r["score"]) for r in total)
    assert phi.where("feature = 'c'").agg(F.max(F.abs("phi"))).first()[0] == pytest.approx(0)


def test_linear_attributions_add_up(rows):
    phi, base = G.shap_linear(rows, "id", WEIGHTS, 0.2)
    start = base.first()[0]
    for r in phi.groupBy("id").agg(F.sum("phi").alias("s")).join(rows, "id").limit(20).collect():
        assert start + r["s"] == pytest.approx(0.2 + r["a"] - 0.5 * r["b"])


def test_lime_finds_the_features_and_repeats(rows):
    cases = rows.where("id in (1, 2, 3)")
    explain = lambda: Y.lime_explain(rows, cases, "id", FEATURES, SCORER, samples=300, top=2).orderBy("id").collect()
    first, second = explain(), explain()
    assert first == second and len(first) == 3
    for r in first:
        assert len(r["explanation"]) == 2 and r["class_type"] in ("Deviant", "Regular")
        assert any("a" in e["rule"] for e in r["explanation"])
    stable = Y.lime_stability(Y.lime_repeats(rows, cases, "id", FEATURES, SCORER, calls=3, samples=200, top=2), "id").collect()
    assert all(0 <= r["vsi"] <= 100 for r in stable)


def test_surrogates_from_sums_equal_a_fit_over_the_samples(spark):
    rng = np.random.default_rng(9)
    names, k = ["a", "b", "c", "d"], 4
    data = []
    for case in ("x", "y", "z"):
        for repeat in (1, 2):
            for _ in range(150):
                z = rng.integers(0, 2, k).astype(float)
                data.append((case, repeat, z.tolist(), float(1 / (1 + np.exp(-(z @ [1.0, -2.0, 0.1, 0.0]) + rng.normal(scale=0.1))))))
    samples = spark.createDataFrame(data, "id string, repeat int, same array<double>, p double")
    # Parts of a case in several partitions add up.
    got = {(r["id"], r["repeat"], r["feature"]): r for r in Y.lime_fit(samples.repartition(5), "id", names, top=2).collect()}
    assert len(got) == 3 * 2 * 2
    width = 0.75 * np.sqrt(k)
    for case in ("x", "y", "z"):
        for repeat in (1, 2):
            z, y = (np.array([r[i] for r in data if r[:2] == (case, repeat)]) for i in (2, 3))
            w = np.sqrt(np.exp(-((1 - z).sum(axis=1)) / width**2))

            def ridge(columns):
                x = z[:, columns]
                xc, yc = x - np.average(x, axis=0, weights=w), y - np.average(y, weights=w)
                gram = (xc * w[:, None]).T @ xc + np.eye(len(columns))
                beta = np.linalg.solve(gram, (xc * w[:, None]).T @ yc)
                scale = (w * (yc - xc @ beta) ** 2).sum() / max(1.0, w.sum() - len(columns))
                return beta, np.sqrt(scale * np.diag(np.linalg.inv(gram))), np.average(y, weights=w) - np.average(x, axis=0, weights=w) @ beta

            chosen = sorted(np.argsort(-np.abs(ridge([0, 1, 2, 3])[0]))[:2].tolist())
            for j, beta, se in zip(chosen, *ridge(chosen)[:2]):
                r = got[case, repeat, names[j]]
                assert (r["weight"], r["se"], r["intercept"]) == pytest.approx((beta, se, ridge(chosen)[2]), abs=1e-9)
    assert Y.lime_fit(samples.limit(0), "id", names).count() == 0


def test_lime_draws_follow_from_the_hash_of_row_sample_and_feature(spark):
    keys = [("case_1", 1), ("x" * 40, 3), (None, 2)]
    spots = spark.createDataFrame(keys, "id string, repeat int").select(
        "id", "repeat", F.xxhash64("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    spaces = {tag: F.pmod(F.xxhash64("id", "n", "i", F.lit(42), "repeat", F.lit(tag)), F.lit(1 << 30)) / float(1 << 30) for tag in ("bin", "spot")}
    found = spots.select("*", *[x.alias(tag) for tag, x in spaces.items()]).collect()
    assert len(found) == 3 * 5 * 3
    for r in found:
        u, v = Y._draws(r["start"], r["repeat"], 5, 3, 42)
        assert (u[r["n"], r["i"]], v[r["n"], r["i"]]) == (r["bin"], r["spot"])


def test_quartile_bins_read_the_rows_once(spark, monkeypatch):
    rows = spark.createDataFrame([(float(i % 7), None if i % 3 else float(i)) for i in range(50)], "a double, b double")
    reads = []
    monkeypatch.setattr(Y, "to_long", lambda *args: reads.append(1) or to_long(*args))
    bins = Y.quartile_bins(rows, ["a", "b"])
    assert len(reads) == 1
    for f, values in (("a", [float(i % 7) for i in range(50)]), ("b", [float(i) for i in range(0, 50, 3)])):
        edges = sorted(set(np.quantile(values, [0.25, 0.5, 0.75])))
        place = np.searchsorted(edges, values)
        own = {b: [v for v, p in zip(values, place) if p == b] for b in sorted(set(place))}
        assert bins[f] == {
            "edges": edges, "bins": list(own), "n": [len(v) for v in own.values()], "lo": [min(v) for v in own.values()], "hi": [max(v) for v in own.values()]
        }


@pytest.mark.parametrize("method", ["boosted", "logit"])
def test_surrogates_scored_in_blocks_equal_those_scored_as_rows(rows, method, monkeypatch):
    params = {"n_trees": 3, "max_depth": 3, "seed": 1} if method == "boosted" else {"c": 0.0}
    fitted = M.TRAINERS[method](rows, FEATURES, **params)
    cases = rows.where("id < 4").withColumn("a", F.when(F.col("id") != 2, F.col("a")))
    scorer, block = M.model_scorer(fitted), trained_scorer(fitted, FEATURES).block
    bins = Y.quartile_bins(rows, FEATURES)
    by_rows, by_blocks = (
        {(r["id"], r["repeat"], r["feature"]): (r["weight"], r["se"]) for r in Y.lime_repeats(rows, cases, "id", FEATURES, scorer, 2, 100, 3, bins=bins, block=b).collect()}
        for b in (None, block)
    )
    assert len(by_rows) == 4 * 2 * 3 and by_rows.keys() == by_blocks.keys()
    for key, found in by_blocks.items():
        assert found == pytest.approx(by_rows[key], abs=1e-9, nan_ok=True)
    monkeypatch.setattr(Y, "lime_samples", lambda *args: pytest.fail("samples became rows"))
    Y.lime_explain(rows, cases, "id", FEATURES, scorer, samples=50, bins=bins, block=block).collect()


def test_identical_repeats_are_fully_stable(spark):
    table = spark.createDataFrame([(1, k, f, 0.5, 0.1) for k in range(4) for f in "ab"], "id int, repeat int, feature string, weight double, se double")
    row = Y.lime_stability(table, "id").first()
    assert (row["vsi"], row["csi"]) == (100.0, 100.0)


def test_silhouette_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v, g = rng.normal(size=(60, 4)), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(x.tolist(), int(k)) for x, k in zip(v, g)], "v array<double>, g int")
    d = ((v[:, None, :] - v[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(60):
        own = d[i][(g == g[i]) & (np.arange(60) != i)].mean()
        other = min(d[i][g == k].mean() for k in set(g) - {g[i]})
        s.append((other - own) / max(own, other))
    assert cluster.silhouette(df, "v", "g").first()[0] == pytest.approx(np.mean(s))


def test_clusters(rows):
    scores = cluster.scan_clusters(rows, FEATURES, ks=(2, 3))
    assert {r["n_clusters"] for r in scores.collect()} == {2, 3}
    best = cluster.best_k(scores).first()["n_clusters"]
    labelled = cluster.centroid_distance(cluster.cluster_scaled(rows, FEATURES, best), "scaled", "cluster_label")
    ends = cluster.nearest_farthest(labelled, "id", "cluster_label").collect()
    assert len(ends) == best and all(r["nearest_distance"] <= r["farthest_distance"] for r in ends)


def test_silhouettes_of_a_scan_read_assembled_rows(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def same(a):
        seen.add(1)
        return a

    found = cluster.scan_clusters(rows.withColumn("a", same("a")), FEATURES, ks=(2, 3)).collect()
    assert seen.value == 400
    vectors = cluster._vectors(rows, FEATURES)
    for r in found:
        labelled = cluster.KMeans(k=r["n_clusters"], seed=42, featuresCol="_features", predictionCol="g").fit(vectors).transform(vectors)
        want = cluster.silhouette(labelled.select("g", cluster.vector_to_array("_features").alias("v")), "v", "g").first()[0]
        assert r["silhouette"] == pytest.approx(want, abs=1e-12)
    # One point leaves a single cluster, whose silhouette is 0.
    alone = spark.createDataFrame([(1.0, 2.0, None)] * 5, "a double, b double, c double")
    assert [r["silhouette"] for r in cluster.scan_clusters(alone, FEATURES, ks=(2,)).collect()] == [0.0]


def test_important_features_need_both_models(spark):
    gain = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "feature string, score double")
    coefs = spark.createDataFrame([("a", 3.0), ("c", -9.0)], "variable string, coef double")
    assert [r["feature"] for r in compare.important_features(gain, coefs, 1).collect()] == ["a"]
    assert compare.important_features(gain, coefs, 2).count() == 4
    assert compare.important_features(gain.limit(0), coefs, 1).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    log = sessions_log(spark, FOLDER, gaps=True)
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    log.repartition(3).write.parquet(str(tmp_path / "in"))
    model = encode.fit("agg", log, SESSIONS, case="case_id")
    scorer = M.closed_form({"agg__sum_value": 0.001, "agg__activity_click": 0.1})
    got = {}
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = score_running_cases(
        stream, SESSIONS, model, scorer, lambda df, n: got.update({r[0]: r[1] for r in df.collect()}), str(tmp_path / "ck"), None
    )
    query.awaitTermination()
    want = {r["case_id"]: r["score"] for r in scorer(encode.encode(log, SESSIONS, [model], case="case_id")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
