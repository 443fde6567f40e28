"""Profiles merged from daily sketches against exact ones."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.operators import sketches as K

START = dt.datetime(2024, 1, 1)


def test_merged_days_stay_within_their_error(spark, tmp_path):
    rng = np.random.default_rng(2)
    n = 60_000
    x = rng.exponential(size=n)
    rows = [
        (START + dt.timedelta(hours=int(h)), f"u{int(u)}", None if i % 10 == 0 else float(v))
        for i, (h, u, v) in enumerate(zip(rng.integers(0, 240, n), rng.integers(0, 20_000, n), x))
    ]
    df = spark.createDataFrame(rows, "ts timestamp, user string, x double").cache()
    path = str(tmp_path / "profile")
    early = F.col("ts") < F.lit(START + dt.timedelta(days=6))
    # The first days are written twice, the others once, each in a run of its own.
    for part in (df.where(early), df.where(early), df.where(~early)):
        K.update_profile(part, path, "ts", ["user"], ["x"])
    got = {r["feature"]: r for r in K.merged_profile(spark, path).collect()}
    exact = df.agg(F.count_distinct("user"), F.count_distinct("x"), F.avg("x"), F.min("x"), F.max("x"), F.count_if(F.col("x").isNull())).first()
    assert (got["user"]["n"], got["x"]["n"], got["x"]["missing"], got["user"]["missing"]) == (n, n, exact[5], 0)
    # Four standard errors.
    assert got["user"]["distinct"] == pytest.approx(exact[0], rel=0.033) and got["x"]["distinct"] == pytest.approx(exact[1], rel=0.033)
    assert (got["x"]["least"], got["x"]["most"]) == (exact[3], exact[4]) and got["x"]["mean"] == pytest.approx(exact[2])
    values = np.sort([r[2] for r in rows if r[2] is not None])
    for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        assert abs(np.searchsorted(values, got["x"][name]) / len(values) - p) < 0.028
        assert got["user"][name] is None
    one = {r["feature"]: r["n"] for r in K.merged_profile(spark, path, days=F.col("day") == "2024-01-03").collect()}
    assert one["x"] == df.where(F.to_date("ts") == "2024-01-03").count()


def test_events_without_time_and_empty_input(spark, tmp_path):
    df = spark.createDataFrame([(None, "a", 1.0), (START, None, None)], "ts timestamp, user string, x double")
    K.update_profile(df, str(tmp_path / "p"), "ts", ["user"], ["x"])
    got = {r["feature"]: r for r in K.merged_profile(spark, str(tmp_path / "p")).collect()}
    assert (got["user"]["n"], got["user"]["missing"], got["user"]["distinct"], got["x"]["mean"]) == (2, 1, 1, 1.0)
    assert K.day_sketches(df.limit(0), "ts", ["user"], ["x"]).count() == 0
