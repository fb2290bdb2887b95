"""Transitions, flags, state space, temporal features and drift."""

import math

from pyspark.sql import functions as F

from trailmark.operators import drift, markov, transitions

EV = "person_id long, state string, yr int, start_date string, matched_label string, university_studies boolean"


def _events(spark):
    rows = [(1, "111", 2001, "2001-01", "a", True), (1, "222", 2001, "2001-05", "b", True),
            (1, "222", 2003, "2003", "c", None), (1, "111", 2005, "2005", "d", False),
            (2, "333", 2010, "2010", "e", None),                      # one event: no transition
            (3, "111", 2000, "2000", "f", None), (3, "111", 2002, "2002", "g", None)]
    return spark.createDataFrame(rows, EV)


def test_transitions_order_ties_and_single_event(spark):
    t = transitions.build_transitions(_events(spark)).orderBy("person_id", "pos").collect()
    assert [(r.person_id, r.pos, r.cur, r.nxt, r.prev) for r in t] == [
        (1, 0, "111", "222", None), (1, 1, "222", "222", "111"), (1, 2, "222", "111", "222"),
        (3, 0, "111", "111", None)]


def test_transitions_equal_events_minus_entities(spark):
    ev = _events(spark)
    t = transitions.build_transitions(ev)
    assert t.count() == ev.count() - ev.select("person_id").distinct().count()


def test_majority_flag_and_default(spark):
    ev = _events(spark)
    f = {r.person_id: r.univ_flag for r in transitions.majority_flag(ev).collect()}
    assert f == {1: True, 2: False, 3: False}
    nf = transitions.majority_flag(ev.drop("university_studies"))
    assert {r.univ_flag for r in nf.collect()} == {False}


def test_space_rates_and_matrix_rows_sum_to_one(spark):
    t = transitions.build_transitions(_events(spark))
    sp = transitions.state_space(t)
    assert [(r.state, r.idx) for r in sp.orderBy("idx").collect()] == [("111", 0), ("222", 1)]
    rates = {r.state: r.self_rate for r in transitions.self_rates(t, sp).collect()}
    assert rates == {"111": 0.5, "222": 0.5}
    m = markov.transition_matrix(t, sp, transitions.self_rates(t, sp)).collect()
    for r in m:
        assert abs(sum(r.p) - 1.0) < 1e-12 and min(r.p) > 0
    # row 111: counts 111->111 = 1 (x mult 2.0), 111->222 = 1; row sum 3 < 10 -> +0.5 per cell
    row = {r.cur_idx: r.p for r in m}[0]
    assert abs(row[0] - 2.5 / 4.0) < 1e-12 and abs(row[1] - 1.5 / 4.0) < 1e-12


def test_logprob_floor_for_unseen_state_and_drift(spark):
    t = transitions.build_transitions(_events(spark))
    sp = transitions.state_space(t)
    m = markov.transition_matrix(t, sp, transitions.self_rates(t, sp))
    extra = spark.createDataFrame([(9, 0, "111", "999")], "person_id long, pos int, cur string, nxt string")
    lp = drift.transition_logprob(t.select("person_id", "pos", "cur", "nxt").unionByName(extra), m, sp)
    got = {(r.person_id, r.pos): r.log_prob for r in lp.collect()}
    assert abs(got[(9, 0)] - math.log(1e-9)) < 1e-9
    ev = _events(spark)
    risk = drift.drift_scores(drift.transition_logprob(t, m, sp), ev).collect()
    assert {r.person_id for r in risk} == {1}                 # >= 2 transitions
    assert all(r.drift_score >= 0 for r in risk)


def test_temporal_features_clip(spark):
    t = transitions.build_transitions(_events(spark))
    f = {(r.person_id, r.pos): r for r in transitions.temporal_features(t).collect()}
    r = f[(1, 2)]
    assert (r.rr_years_since_first, r.rr_career_span, r.rr_n_prior_trans) == (2.0, 2.0, 2.0)
    assert r.rr_transition_velocity == 1.0


def test_dominant_state_ties_to_lowest(spark):
    d = {r.person_id: r.dominant_sector for r in drift.dominant_state(_events(spark)).collect()}
    assert d[1] == "111" and d[2] == "333"


def test_permutation_and_repartition_do_not_change_transitions(spark):
    ev = _events(spark)
    a = transitions.build_transitions(ev).select("person_id", "pos", "cur", "nxt").collect()
    b = transitions.build_transitions(ev.repartition(3, F.rand(7))).select("person_id", "pos", "cur", "nxt")
    assert sorted(a) == sorted(b.collect())


def test_break_on_gap_removes_bridged_transitions(spark):
    rows = [(5, "111", 2001, "2001", "a", None), (5, None, 2002, "2002", "b", None), (5, "333", 2003, "2003", "c", None),
            (5, "333", 2004, "2004", "d", None)]
    ev = spark.createDataFrame(rows, EV)
    default = transitions.build_transitions(ev.filter("state is not null"))
    assert sorted((r.cur, r.nxt) for r in default.collect()) == [("111", "333"), ("333", "333")]
    gap = transitions.build_transitions(ev, break_on_gap=True)
    assert [(r.cur, r.nxt, r.pos) for r in gap.collect()] == [("333", "333", 2)]


def test_as_of_span_does_not_see_the_future(spark):
    t = transitions.build_transitions(_events(spark))
    f = {(r.person_id, r.pos): r for r in transitions.temporal_features(t, as_of=True).collect()}
    assert f[(1, 0)].rr_career_span == 0.0 and f[(1, 2)].rr_career_span == 2.0
    full = {(r.person_id, r.pos): r for r in transitions.temporal_features(t).collect()}
    assert full[(1, 0)].rr_career_span == 2.0
