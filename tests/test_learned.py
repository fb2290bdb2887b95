"""Listwise ranking, k-means, components and label branches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import drift, kmeans, labels, listwise, profiles, rerank, transitions

SF = "/root/testdata/sf0.001"


def _feats(spark, n=200, seed=1, signal=True):
    """Lists of 3 to 6 candidates; the true next prefers a large f_cos."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = int(rng.integers(3, 7))
        x = rng.normal(size=(k, len(rerank.FEATURES)))
        p = np.sort(rng.dirichlet(np.ones(k)))[::-1]
        x[:, rerank.FEATURES.index("f_ensemble")] = p
        truth = int(np.argmax(3 * x[:, 0] + np.log(p) + rng.gumbel(size=k))) if signal else 0
        if i % 17 == 0:
            truth = 99  # not in the list
        rows += [(i, 0, 5, truth, c, c, *[float(v) for v in x[c]]) for c in range(k)]
    schema = "person_id long, pos long, cur_idx int, nxt_idx int, rank int, cand_idx int, " + ", ".join(f"{f} double" for f in rerank.FEATURES)
    return spark.createDataFrame(rows, schema), rows


def _brute(rows, w):
    """Likelihood and gradient, one list at a time."""
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    value, gradient = 0.0, np.zeros(len(listwise.TERMS))
    for cs in by.values():
        x = []
        for r in cs:
            f = dict(zip(rerank.FEATURES, r[6:]))
            x.append([f[t] if t in f else f[t[:-5]] * f["f_self"] for t in listwise.TERMS])
        x = np.array(x)
        o = np.log(np.maximum([r[6 + rerank.FEATURES.index("f_ensemble")] for r in cs], 1e-9))
        hit = [i for i, r in enumerate(cs) if r[5] == r[3]]
        if not hit:
            continue
        z = np.exp(o + x @ w)
        p = z / z.sum()
        value += np.log(p[hit[0]])
        gradient += x[hit[0]] - p @ x
    return value, gradient


@pytest.mark.parametrize("scale", [0.0, 0.3])
def test_likelihood_and_gradient(spark, scale):
    df, rows = _feats(spark)
    w = np.random.default_rng(4).normal(size=len(listwise.TERMS)) * scale
    sums = listwise.likelihood(listwise.lists(df).repartition(3), w[None])[0]
    value, gradient = _brute(rows, w)
    assert np.isclose(sums[1], value) and np.allclose(sums[2:2 + len(w)], gradient)
    # the Hessian is the gradient's slope
    n, h = len(w), sums[2 + 2 * len(w):].reshape(len(w), len(w))
    step = np.zeros(n)
    step[0] = 1e-5
    slope = (_brute(rows, w + step)[1] - _brute(rows, w - step)[1]) / 2e-5
    assert np.allclose(-h[0], slope, atol=1e-4)


def test_fit_finds_the_signal_and_never_loses_to_the_ensemble(spark):
    df, rows = _feats(spark, 600)
    lists = listwise.lists(df).persist()
    w = listwise.fit(lists, (1.0,))[0]
    penalised = _brute(rows, w)[0]
    assert w[0] > 1.5 and penalised > _brute(rows, np.zeros(len(w)))[0]
    chosen, places = listwise.train(lists, lists)
    assert places.max() == listwise.top1(lists, chosen[None])[0] >= places[-1]
    # noise: the choice is at least the ensemble on validation
    other = listwise.lists(_feats(spark, 80, seed=9, signal=False)[0])
    chosen, places = listwise.train(lists, other)
    assert listwise.top1(other, chosen[None])[0] >= places[-1]


def test_top1_agrees_with_the_ranking(spark):
    df, _ = _feats(spark)
    w = np.random.default_rng(2).normal(size=len(listwise.TERMS))
    ranked = rerank.rerank(df, listwise.score(w)).filter("new_rank = 0").agg(F.avg((F.col("cand_idx") == F.col("nxt_idx")).cast("double"))).first()[0]
    assert np.isclose(listwise.top1(listwise.lists(df), w[None])[0], ranked)


def test_no_lists(spark):
    df, _ = _feats(spark, 3)
    empty = listwise.lists(df.limit(0))
    assert (listwise.fit(empty) == 0).all() and listwise.top1(empty, np.zeros((1, len(listwise.TERMS))))[0] == 0


def _points(spark, n=400):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0, 0], [6, 0, 0], [0, 6, 0], [0, 0, 6]])
    x = centres[rng.integers(0, 4, n)] + rng.normal(size=(n, 3))
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "person_id long, drift_score double, seq_length double, self_loop_rate double")


def test_assignment_against_numpy(spark):
    x, df = _points(spark)
    centres = [[-1, 0, 0], [1, 0, 0], [0, 1, 1], [1, 0, 0]]  # a tie goes to the lower number
    z = (x - x.mean(0)) / x.std(0)
    want = ((z[:, None] - np.array(centres)[None]) ** 2).sum(-1).argmin(1)
    got = {r.person_id: r.cluster for r in drift.assign_drift(df, centres).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist() and 3 not in want


def test_restarts_reach_a_fixed_point_with_the_lowest_cost(spark):
    x, df = _points(spark)
    std = kmeans.standardised(df, drift.FEATURES).select("person_id", "x").repartition(3)
    centres, costs = kmeans.fit(std, "person_id", k=4, restarts=6)
    z = (x - x.mean(0)) / x.std(0)
    d = ((z[:, None] - centres[None]) ** 2).sum(-1)
    assert np.allclose([z[d.argmin(1) == c].mean(0) for c in range(4)], centres)
    assert np.isclose(d.min(1).sum(), costs.min()) and len(costs) == 6
    again, _ = kmeans.fit(std.repartition(2), "person_id", k=4, restarts=6)
    assert np.allclose(centres, again)


def test_iterations_do_not_run_the_input_again(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    _, df = _points(spark)
    n = df.count()
    got = drift.cluster_drift(df.mapInArrow(counted, df.schema), k=4, restarts=6).select("person_id", "cluster").collect()
    assert len(got) == n and seen.value <= 3 * n


def test_constant_features_and_few_rows(spark):
    df = spark.createDataFrame([(1, 2.0, 3, 0.5), (2, 2.0, 3, 0.5), (3, None, 1, 0.5)], "person_id long, drift_score double, seq_length long, self_loop_rate double")
    assert [r.cluster for r in drift.cluster_drift(df, k=2, restarts=2).collect()] == [0, 0]
    assert drift.cluster_drift(df.limit(0), k=2, restarts=2).collect() == []


def test_components_are_centred_and_match_numpy(spark):
    rows = [(p, str(100 + (p * 7 + y * y) % 6), 2000 + y, str(2000 + y), f"l{y}") for p in range(40) for y in range(6)]
    t = transitions.build_transitions(spark.createDataFrame(rows, "person_id long, state string, yr int, start_date string, matched_label string"))
    sp = transitions.state_space(t)
    m = np.array([r.profile for r in profiles.profiles(t, sp).orderBy("cur_idx").collect()])
    cov = {(r.a, r.b): r["cov"] for r in profiles.covariance(profiles.profiles(t, sp)).collect()}
    assert np.allclose([[cov[a, b] for b in range(len(m))] for a in range(len(m))], np.cov(m.T))
    e, c = profiles.pca(t, sp, k=3)
    u, s, vt = np.linalg.svd(m - m.mean(0))
    got = np.array([[r.pc1, r.pc2, r.pc3] for r in c.orderBy("state").collect()])
    assert np.allclose(got.mean(0), 0)
    assert np.allclose(np.abs(got), np.abs((m - m.mean(0)) @ vt[:3].T))
    assert np.allclose([r.explained_pct for r in e.orderBy("component").collect()], np.round(s[:3] ** 2 / (s ** 2).sum() * 100, 1), atol=0.11)


def test_label_check_finds_injected_mismatches(spark):
    rows = [("1234.5", "123"), ("1234", "999"), ("55", None), (None, "777"), (" unknown ", "1"), ("Unknown", "1"), ("678.1", "678")]
    r = labels.label_check(spark.createDataFrame(rows, "matched_code string, state string")).first()
    # ' unknown ' is no valid code only when it is exactly the word
    assert r.mismatches == 2 + 1 and r.coded_rows == 5


def test_a_branch_with_scores_keeps_the_coded_one(spark):
    from trailmark.plans.catalog import _sql_scores
    from trailmark.plans.journey import JourneyContext
    code = JourneyContext(spark, SF)
    merged = JourneyContext(spark, SF, labels_from="scores", scores=_sql_scores)
    assert merged.stage_path("events") == code.stage_path("events") and merged.stage_path("risk") != code.stage_path("risk")
    n, m = code.transitions.count(), merged.transitions.count()
    added = merged.coded_events.filter("label_source = 'model'").count()
    assert added > 0 and n < m <= n + added
    with pytest.raises(ValueError):
        JourneyContext(spark, SF, labels_from="scores")


def test_forest_beats_the_majority(spark):
    from trailmark.operators import classify
    rows = [(i, ("eins zwei drei " if i % 3 == 0 else "one two three ") + f"w{i % 7}", "de" if i % 3 == 0 else "en") for i in range(120)] + [(500, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = classify.train_classifier(df.filter("doc_id % 4 <> 0"), "text", "lang", num_features=64, kind="forest", trees=5, depth=4)
    assert sorted(m.labels) == ["de", "en"]
    got = classify.score(m, df.filter("doc_id % 4 = 0 and lang is not null")).collect()
    assert sum(r.predicted == r.lang for r in got) / len(got) > 2 / 3
    with pytest.raises(ValueError):
        classify.train_classifier(df, "text", "lang", kind="other")


def test_bucket_sums_shuffle_no_tokens(spark, capsys):
    from trailmark.operators import classify
    df = spark.createDataFrame([(1, "a bb a"), (2, None)], "doc_id long, text string")
    classify.bucket_sums(df, "doc_id", "text").explain("formatted")
    plan = capsys.readouterr().out
    assert "hashpartitioning(doc_id" in plan and "token" not in [a for line in plan.splitlines() if line.startswith("Arguments: hashpartitioning") for a in line.split()]
