"""Hand cases for the rules on nulls, order, prefixes, buckets and edges."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from casewright.operators import associate, binning, bucket, encode, metrics, prefix, prepare, profile, split
from casewright.operators.explain_local import rule_text
from casewright.plans.encoded import encoded_with_label
from casewright.schema import LogSchema, known_logs
from casewright.sources import artefacts
from casewright.sources.logs import read_event_log

S = LogSchema(
    "hand", "case", "act", "ts", "res", "label", dynamic_cat=("act", "res"), dynamic_num=("x",), static_cat=("kind",),
    static_num=("age",), tiebreak=("id",),
)
LAYOUT = "case string, id int, act string, res string, ts timestamp, x double, kind string, age double, label string"


def day(n):
    return datetime(2024, 1, n)


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        ("a", 1, "p", None, day(1), None, None, None, None),
        ("a", 2, "q", "r1", day(2), 4.0, "k2", 30.0, "deviant"),
        ("a", 3, "q", "r2", day(2), 6.0, "k1", 40.0, "regular"),
        ("b", 4, "p", "r1", day(2), 1.0, "k1", 50.0, "regular"),
        ("c", 5, "q", "r1", day(3), 2.0, "k1", None, None),
        ("c", 6, "p", "r1", day(4), None, "k1", None, None),
    ]
    return spark.createDataFrame(rows, LAYOUT)


def table(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_first_label_skips_nulls(log):
    assert table(prepare.case_label(log, S), "case", "encoded_label") == [("a", 1), ("b", 0), ("c", 0)]


def test_static_view_takes_first_non_null(log):
    row = {r["case"]: r for r in prepare.static_view(log, S).collect()}
    assert (row["a"]["kind"], row["a"]["age"]) == ("k2", 30.0)
    assert row["c"]["age"] is None


def test_ordinal_codes_give_null_minus_one(log):
    got = table(prepare.ordinal_codes(log, ["res"]), "id", "res_code")
    assert got == [(1, -1), (2, 0), (3, 1), (4, 0), (5, 0), (6, 0)]


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, None)], "a int, b int, c string")
    assert prepare.constant_columns(df) == ["b", "c"]


def test_split_drops_overlap_and_keeps_cases_whole(log):
    train, test = split.temporal_split(log, S, 0.67)
    assert {r["case"] for r in test.collect()} == {"c"}
    assert train.agg(F.max("ts")).first()[0] < test.agg(F.min("ts")).first()[0]
    train, test = split.temporal_split(log, S, 0.34)
    assert table(train, "id") == [(1,)]
    assert table(test, "id") == [(4,), (5,), (6,)]


def test_split_without_test_cases_has_no_training_either(log):
    train, test = split.temporal_split(log, S, 1.0)
    assert train.count() == 0 and test.count() == 0


def test_validation_share_that_rounds_to_zero_is_empty(log):
    train, val = split.val_split_temporal(log, S, 0.1)
    assert val.count() == 0 and train.count() == log.count()


def test_folds_are_balanced(spark):
    rows = [(f"c{i}", i, "p", "r", day(1), 1.0, "k", 1.0, "deviant" if i % 3 == 0 else "regular") for i in range(50)]
    folds = split.fold_numbers(spark.createDataFrame(rows, LAYOUT), S, 5).collect()
    label = {r[0]: r[8] for r in rows}
    for classes in (("deviant", "regular"), ("deviant",), ("regular",)):
        sizes = [sum(1 for f in folds if f["fold"] == k and label[f["case"]] in classes) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    assert len(folds) == 50


def test_prefixes(log):
    got = prefix.generate_prefixes(log, S, 1, 2)
    assert table(got.select("prefix_id").distinct(), "prefix_id") == [("a",), ("a_2",), ("b",), ("c",), ("c_2",)]
    assert {r["case_length"] for r in got.where("original_case_id = 'a'").collect()} == {2}
    assert got.count() == 1 + 2 + 1 + 1 + 2


def test_first_chunk_keeps_plain_id_and_number_one(log):
    got = prefix.generate_prefixes(log, S, 2, 3)
    assert table(got.select("prefix_id", "prefix_nr").distinct(), "prefix_id", "prefix_nr") == [("a", 1), ("a_3", 3), ("c", 1)]


def test_prefix_cap():
    logs = known_logs()
    assert len(logs) == 9
    assert prefix.max_prefix_rule(None, logs["traffic_fines"]) == 10
    assert logs["BPIC2017_O_Refused"].prefix_cap == 20
    assert logs["sepsis3"].positive == "regular" and logs["sepsis1"].positive == "deviant"
    assert "isClosed" not in logs["hospital_billing_1"].dynamic_cat


def test_bucket_floor_and_none_below(spark, log):
    fitted = spark.createDataFrame([(2,)], "size long")
    got = bucket.bucket_prefix_length(prefix.generate_prefixes(log, S, 1, 3), fitted=fitted)
    assert table(got, "prefix_id", "size", "bucket")[0] == ("a", 1, None)
    assert {(r["prefix_id"], r["bucket"]) for r in got.collect() if r["size"] >= 2} == {("a_2", 2), ("a_3", 2), ("c_2", 2)}


def test_unknown_names_raise():
    with pytest.raises(ValueError):
        bucket.get_bucketer("state")
    with pytest.raises(ValueError):
        encode.fit("last", None, S)


def test_aggregate_encoding(log):
    model = encode.fit("agg", log, S, case="case")
    row = {r["case"]: r.asDict() for r in encode.encode(log, S, model, case="case").collect()}
    assert model.columns == ["act_p", "act_q", "res_r1", "res_r2", "mean_x", "max_x", "min_x", "sum_x", "std_x"]
    assert (row["a"]["act_q"], row["a"]["mean_x"], round(row["a"]["std_x"], 6)) == (2.0, 5.0, 1.414214)
    assert row["b"]["std_x"] == 0.0 and row["a"]["res_r1"] == 1.0


def test_unseen_level_is_dropped_and_missing_level_is_zero(log):
    train = log.where("case = 'b'")
    model = encode.fit("agg", train, S, case="case")
    assert model.columns[:2] == ["act_p", "res_r1"]
    row = {r["case"]: r.asDict() for r in encode.encode(log, S, model, case="case").collect()}
    assert "act_q" not in row["a"] and row["c"]["res_r1"] == 2.0


def test_index_encoding_does_not_skip_nulls(log):
    model = encode.fit("index", log, S, case="case")
    row = {r["case"]: r.asDict() for r in encode.encode(log, S, model, case="case").collect()}
    assert (row["a"]["x_0"], row["a"]["x_1"], row["a"]["x_2"]) == (0.0, 4.0, 6.0)
    assert row["a"]["act_0_p"] == 1.0 and row["b"]["x_1"] == 0.0


def test_presence_encoding(log):
    model = encode.fit("bool", log, S, case="case")
    row = {r["case"]: r.asDict() for r in encode.encode(log, S, model, case="case").collect()}
    assert row["a"]["act_q"] == 1.0


def test_vocabulary_limit(log):
    with pytest.raises(ValueError):
        encode.fit("agg", log, S, case="case", limit=2)


def test_running_and_grouped_encoding_agree(log):
    pre = prefix.generate_prefixes(log, S, 1, 3)
    for kinds in (("static", "agg"), ("static", "index"), ("static", "bool")):
        models = [encode.fit(k, pre, S) for k in kinds]
        grouped = encode.encode(pre, S, models)
        running = encode.encode_running(log, S, models, 3).select(*grouped.columns)
        assert sorted(map(tuple, grouped.collect())) == sorted(map(tuple, running.collect()))


def test_pearson_of_constant_and_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "a double, b double, c double")
    r = {(x["feature_a"], x["feature_b"]): x["r"] for x in associate.pearson_matrix(df, ["a", "b", "c"]).collect()}
    assert r["a", "b"] == pytest.approx(1.0) and r["a", "c"] is None and r["c", "c"] is None


def test_pearson_is_pairwise_at_any_width(spark):
    rng = random.Random(1)
    rows = [tuple(None if rng.random() < 0.2 else rng.gauss(i % 3, 1 + i) for i in range(30)) for _ in range(60)]
    names = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    wide = {(x[0], x[1]): x[2] for x in associate.pearson_matrix(df, names).collect()}
    assert len(wide) == 900
    for a, b in [(0, 1), (3, 29), (17, 17), (28, 5)]:
        both = [(r[a], r[b]) for r in rows if r[a] is not None and r[b] is not None]
        ma, mb = (sum(x) / len(both) for x in zip(*both))
        cov = sum((x - ma) * (y - mb) for x, y in both)
        var = sum((x - ma) ** 2 for x, _ in both) * sum((y - mb) ** 2 for _, y in both)
        assert wide[names[a], names[b]] == pytest.approx(cov / var**0.5) == wide[names[b], names[a]]
    narrow = {(x[0], x[1]): x[2] for x in associate.pearson_matrix(df, names[:2]).collect()}
    assert narrow["c0", "c1"] == pytest.approx(wide["c0", "c1"])


def test_events_without_time_come_last_and_no_case_is_lost(spark):
    rows = [("a", "x", "2024-01-03", 1), ("a", "y", None, 2), ("b", "x", "2024-01-01", 3), ("c", "z", None, 4), ("d", "x", "2024-01-02", 5), ("d", "y", "2024-01-09", 6)]
    schema = LogSchema("n", case="case", activity="act", ts="ts", resource="act", label="label", tiebreak=("id",), dynamic_cat=("act",))
    log = spark.createDataFrame(rows, "case string, act string, ts string, id long").selectExpr("case", "act", "to_timestamp(ts) AS ts", "id", "'deviant' AS label")
    first = {r["case"]: r["act"] for r in prefix.case_heads(log, schema, 5).where("pos = 1").collect()}
    assert first == {"a": "x", "b": "x", "c": "z", "d": "x"}
    for ratio in (0.25, 0.5, 0.75):
        parts = split.temporal_split(log, schema, ratio)
        encoded = encoded_with_label(log, schema, ratio=ratio, max_length=5, drop_empty=False).rows
        for part, name in ((parts.train, "training"), (parts.test, "testing")):
            want = {r["case"] for r in part.select("case").distinct().collect()}
            assert {r[0] for r in encoded.where(F.col("set") == name).select("original_case_id").distinct().collect()} == want


def test_cramers_v_edges(spark):
    df = spark.createDataFrame([("x", "u", "s"), ("x", "u", "s"), ("y", "v", "s"), ("y", None, "s")], "a string, b string, c string")
    v = {(x["feature_a"], x["feature_b"]): x["v"] for x in associate.cramers_v_matrix(df, ["a", "b", "c"]).collect()}
    assert v["a", "c"] is None and v["a", "b"] == v["b", "a"]


def test_auc_edges(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1)], "score double, encoded_label int")
    assert metrics.auc(df).first()[0] == pytest.approx(0.875)
    lifted = df.withColumn("score", F.exp(F.col("score") * 3))
    assert metrics.auc(lifted).first()[0] == pytest.approx(0.875)
    assert metrics.auc(df.where("encoded_label = 1")).first()[0] is None
    assert metrics.auc(df.where("encoded_label = 1"), one_class=0.5).first()[0] == 0.5


def test_binning(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), 7.0) for i in range(12)], "a double, b double, c double")
    got = binning.discretize_uniform(df, ["a", "b", "c"]).collect()
    assert [r["a"] for r in sorted(got, key=lambda r: r["a"])] == [0.0] * 3 + [1.0] * 3 + [2.0] * 3 + [3.0] * 3
    assert {r["b"] for r in got} == {0.0, 1.0, 2.0} and {r["c"] for r in got} == {0.0}


def test_histogram_edges():
    assert binning.histogram_edges(3.0, 11.0, 5.0) == [0.0, 5.0, 10.0, 15.0]


def test_rule_text():
    assert rule_text("f", [1.0, 2.0], 0) == "f <= 1.00"
    assert rule_text("f", [1.0, 2.0], 1) == "1.00 < f <= 2.00"
    assert rule_text("f", [1.0, 2.0], 2) == "f > 2.00"


def test_cardinality_counts_null(log):
    got = dict(table(profile.column_cardinality(log, ["res", "label", "act"]), "feature", "n_values"))
    assert got == {"res": 3, "label": 3, "act": 2}


def test_csv_with_long_and_short_lines(spark, tmp_path):
    text = "case;act;ts;res;label;x\na;p\xe9;2024-01-01 00:00:00;r;deviant;1.5\nb;p;2024-01-02 00:00:00;r;regular;2;extra\nc;q;2024-01-03 00:00:00\nd;q;2024-01-04 00:00:00;r;regular;bad\ne;\"x;y;z;w;v\"\n"
    (tmp_path / "log.csv").write_bytes(text.encode("latin-1"))
    schema = LogSchema("t", "case", "act", "ts", "res", "label", dynamic_cat=("act",), dynamic_num=("x",))
    got = {r["case"]: r for r in read_event_log(spark, schema, str(tmp_path / "log.csv")).collect()}
    assert sorted(got) == ["a", "c", "d", "e"]
    assert got["a"]["act"] == "p\xe9" and got["a"]["x"] == 1.5 and got["c"]["x"] is None and got["d"]["x"] is None
    assert got["e"]["act"] == "x;y;z;w;v" and got["e"]["ts"] is None


def test_catalogue_appends(spark, tmp_path):
    row = spark.createDataFrame([("d", "m")], "dataset string, method string")
    for _ in range(2):
        artefacts.write_catalogue(row, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_time_features(log):
    got = {r["id"]: r for r in profile.derive_time_features(log, S).collect()}
    assert [got[i]["event_nr"] for i in (1, 2, 3)] == [1, 2, 3]
    assert got[2]["timesincelastevent"] == 86400.0 and got[1]["timesincelastevent"] == 0.0
    # On day 2 a ends, b starts and ends; c has not started.
    assert (got[1]["open_cases"], got[2]["open_cases"], got[5]["open_cases"]) == (1, 2, 1)
    assert got[1]["weekday"] == 0
