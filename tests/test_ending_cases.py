"""Running cases that end: scores against the batch encoder, state that falls, late events."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casewright.operators import encode
from casewright.operators import model as M
from casewright.schema import LogSchema
from casewright.streaming.ending_cases import progress_of, score_ending_cases

SCHEMA = LogSchema("s", case="case", activity="act", ts="ts", resource="res", label="label", dynamic_cat=("act",), dynamic_num=("x",), tiebreak=("id",))
START = dt.datetime(2024, 1, 1)
LAYOUT = "case string, act string, res string, label string, ts timestamp, x double, id long"


def event(case, hours, i, act="go", x=1.0):
    return (case, act, "r", "deviant", START + dt.timedelta(hours=hours) if hours is not None else None, x, i)


def run(spark, tmp_path, batches, idle="5 hours", lateness="1 hour", model=None, **more):
    """One file a batch, in order; all rows handed to the sink, and the query."""
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, LAYOUT).coalesce(1).write.mode("append").parquet(str(folder))
    log = spark.read.schema(LAYOUT).parquet(str(folder))
    model = model or encode.fit("agg", log, SCHEMA, case="case")
    got = []
    stream = spark.readStream.schema(LAYOUT).option("maxFilesPerTrigger", 1).parquet(str(folder))
    scorer = M.closed_form({"agg__sum_x": 0.1, "agg__std_x": 0.5, "agg__act_go": 0.2, "agg__min_x": 0.01, "agg__max_x": 0.03, "agg__mean_x": -0.1})
    query = score_ending_cases(
        stream, SCHEMA, model, scorer, lambda df, n: got.extend((n, *r) for r in df.collect()), str(tmp_path / "ck"), idle, lateness, **more
    )
    query.awaitTermination()
    return got, query, log, model, scorer


def test_final_scores_equal_the_batch_encoder_and_state_falls(spark, tmp_path):
    batches = [
        [event("a", 0, 1, x=1.0), event("a", 1, 2, "stop", 4.0), event("b", 1, 3, x=None), event(None, 1, 4), event("n", None, 5)],
        [event("a", 2, 6, x=-2.0), event("a", 2, 6, x=-2.0), event("c", 3, 7, "stop", 9.0)],
        [event("d", 30, 8)],
        [event("e", 60, 9)],
        # More than the lateness behind what earlier batches have shown.
        [event("f", 100, 11), event("a", 3, 10, x=100.0)],
    ]
    got, query, log, model, scorer = run(spark, tmp_path, batches)
    kept = log.where("ts is not null and case is not null and id <> 10").dropDuplicates(["case", "id"])
    want = {r["case"]: r["score"] for r in scorer(encode.encode(kept, SCHEMA, [model], case="case")).collect()}
    finals = {case: (events, score) for _, case, events, final, score in got if final}
    assert set(finals) >= {"a", "b", "c", "d"} and "n" not in finals and None not in finals
    assert finals["a"][0] == 3
    for case, (_, score) in finals.items():
        assert score == pytest.approx(want[case])
    # A case is final once, and scored before that.
    assert len([1 for r in got if r[3]]) == len(finals) and {r[1] for r in got if not r[3]} >= set(finals)
    progress = progress_of(query)
    held = [rows for rows, _ in progress]
    assert max(held) > held[-1]
    assert sum(late for _, late in progress) >= 1


def test_cases_of_a_group_share_a_state_and_end_on_their_own(spark, tmp_path):
    # Case i has its last event at hour i / 10, some after an earlier one in the batch before.
    first = [event(f"c{i}", i / 100, i, x=i / 7) for i in range(0, 100, 2)]
    second = [event(f"c{i}", 1 + i / 10, 1000 + i, "stop", None if i % 3 else -i / 3) for i in range(100)]
    got, query, log, model, scorer = run(
        spark, tmp_path, [first, second, [event("late", 14, 5000)], [event("later", 17.5, 5001)], [event("last", 90, 5002)], [event("end", 91, 5003)]], groups=3
    )
    want = {r["case"]: r["score"] for r in scorer(encode.encode(log, SCHEMA, [model], case="case")).collect()}
    finals = {case: (number, events, score) for number, case, events, final, score in got if final}
    assert len([1 for r in got if r[3]]) == len(finals) and set(finals) == {f"c{i}" for i in range(100)} | {"late", "later"}
    for case, (_, events, score) in finals.items():
        assert score == pytest.approx(want[case]) and events == (2 if case[1:].isdigit() and int(case[1:]) % 2 == 0 else 1)
    # Watermarks of 9.9, 13 and 16.5 hours pass 1 + i / 10 + 5 hours.
    by_batch = {number: {c for c, f in finals.items() if f[0] == number} for number in {f[0] for f in finals.values()}}
    assert [by_batch[n] for n in sorted(by_batch)] == [*({f"c{i}" for i in part} for part in (range(39), range(39, 70), range(70, 100))), {"late", "later"}]
    # A group's cases are one row, its timer another (in two indexes), and events kept against copies are not counted.
    assert max(rows for rows, _ in progress_of(query)) <= 3 * 3


def test_the_provider_is_put_back(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    run(spark, tmp_path, [[event("a", 0, 1)]])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_only_aggregates_can_be_kept(spark):
    from casewright.streaming.ending_cases import case_features

    with pytest.raises(ValueError):
        case_features(spark.createDataFrame([], LAYOUT).withColumn("ts", F.col("ts")), SCHEMA, encode.EncoderModel("static", (), ()), "1 day", "1 hour")
