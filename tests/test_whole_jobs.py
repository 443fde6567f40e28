"""Registered queries do the whole job of their operators."""

import __spark_entry__ as entry
from casewright.operators import model as M
from casewright.operators import tuning as T
from casewright.plans import queries_profile

FOLDER = "/root/testdata/sf0.001"


def test_every_encoded_column_is_counted(spark):
    es = queries_profile.encoded_orders(spark, FOLDER)
    rows = {r["feature"]: r for r in entry.queries()["encoded_level_counts"](spark, FOLDER).collect()}
    assert len(es.features) == 44 and set(rows) == set(es.features) == set(queries_profile.COUNTED)
    assert {f for f, r in rows.items() if r["note"] == "Numerical Variable"} == set(es.numeric)
    n = es.rows.where("set = 'training'").count()
    counted = [r["value_counts"] for r in rows.values() if r["note"] is None]
    assert len(counted) > 30 and all(sum(int(e.split(":")[1]) for e in c.split(",")) == n for c in counted)


def test_searches_make_all_trials_with_whole_models(spark, monkeypatch):
    fits, drawn, told = [], [], T.next_trial

    def fold_scores(folded, features, method, params, *args):
        fits.append((method, params))
        return method, params

    def trial(space, done, rng, first=5, *args):
        drawn.append((len(done) >= first, space))
        return told(space, done, rng, first, *args)

    # The fits themselves are tested elsewhere; trials are scored by their parameters.
    monkeypatch.setattr(T, "fold_scores", fold_scores)
    monkeypatch.setattr(T, "fold_auc", lambda fit, *args: {1: 0.5, None: sum(fit[1].values()) % 1})
    monkeypatch.setattr(T, "next_trial", trial)
    rows = entry.queries()["cv_trials_tpe"](spark, FOLDER).collect()
    for method, space in T.SPACES.items():
        own = [r for r in rows if r["cls"] == method]
        assert len(own) == 50 * 2 * len(space) and {r["iter"] for r in own} == set(range(1, 51))
        # Nothing but the trial's parameters goes to the trainer, so its 500 trees and 100 steps stand.
        assert [set(p) for m, p in fits if m == method] == [set(space)] * 50
        assert [guided for guided, s in drawn if s == space] == [False] * 5 + [True] * 45
    assert max(p["max_depth"] for m, p in fits if m == "boosted") > 8
    assert M.train_boosted.__defaults__[1] == 500 and M.train_logit.__defaults__[2] == 100
