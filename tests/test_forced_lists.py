"""Lists of training rows, made where the rows are, against the expressions over contexts."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import ensemble, listwise, rerank, transitions
from trailmark.plans import catalog
from trailmark.plans.journey import JourneyContext


@pytest.fixture(scope="module")
def journey(spark):
    """(rows, components, weights) over 30 made states: some rows have no prior, window, segment, flag or previous state."""
    events = [(p, str(100 + (p * 7 + y * y * (1 + p % 3)) % 30 * 5), 2000 + y, str(2000 + y), f"l{y}") for p in range(40) for y in range(8)]
    t = transitions.build_transitions(spark.createDataFrame(events, "person_id long, state string, yr int, start_date string, matched_label string"))
    def here(df):
        return spark.createDataFrame(df.collect(), df.schema)
    t = here(t.withColumn("univ_flag", F.col("person_id") % 3 == 0))
    space = here(transitions.state_space(t))
    comp = ensemble.Components(t, space, here(transitions.self_rates(t, space)), window_size=3, keep=lambda name, build: here(build()))
    rows = ensemble.annotate(t, comp)
    known = rows.filter("person_id < 9").select("person_id", "pos", "nxt_idx", *ensemble.CONTEXT_KEYS[:-1])
    odd = known.filter("person_id = 1")
    odd = odd.withColumn("person_id", F.lit(None).cast("long")).withColumn("univ_flag", F.lit(None).cast("boolean")) \
        .unionByName(odd.withColumn("person_id", F.lit(900).cast("long")).withColumn("win", F.lit(-1)).withColumn("archetype", F.lit("none such"))) \
        .unionByName(odd.withColumn("prev_idx", F.lit(None).cast("int")).withColumn("nxt_idx", F.lit(29)))
    weights = spark.createDataFrame([(i, 0.1 * (i % 5), 0.3, 0.2) for i in range(25)] + [(25, None, None, None)], "cur_idx int, w_hist double, w_so double, w_arch double")
    return here(known.unionByName(odd).unionByName(odd.limit(2))), comp, weights


def _by_expressions(rows, comp, weights, k):
    keyed = rerank.with_prior_entity(rows, comp)
    sc = ensemble.scored_contexts(rows, comp, weights, k)
    j = rerank.key_join(keyed, sc, ensemble.CONTEXT_KEYS)
    out = []
    for r in j.collect():
        c = list(r["topk"])
        if r["nxt_idx"] not in c:
            c[-1] = r["nxt_idx"]
        out.append((r["person_id"], r["pos"], r["nxt_idx"], r["prev_idx"], r["win"], c, c.index(r["nxt_idx"]), *[[r[n][i] for i in c] for n in "grshp"]))
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [4, 20, 50])
def test_forced_lists_against_the_expressions(journey, k):
    rows, comp, weights = journey
    got = rerank.candidate_lists(rows, comp, weights, k, force_true=True).collect()
    got = sorted([(r["person_id"], r["pos"], r["nxt_idx"], r["prev_idx"], r["win"], r["cands"], r["true_pos"],
                   *[[c[n] for c in r["cv"]] for n in rerank.VALUES]) for r in got], key=str)
    want = _by_expressions(rows, comp, weights, k)
    assert len(got) == rows.count() and got == want
    assert k > 30 or any(r[6] == k - 1 for r in got)
    assert {len(r[5]) for r in got} == {min(k, 30)}


def test_forced_lists_are_not_shuffled(journey, capsys):
    rows, comp, weights = journey
    capsys.readouterr()
    rerank.candidate_lists(rows, comp, weights, force_true=True).explain("formatted")
    moved = re.findall(r"\n\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: (\[.*\])", capsys.readouterr().out)
    assert moved and not [c for c in moved if "cands#" in c or "cv#" in c]


def test_batches_are_scored_in_parts(journey, monkeypatch):
    rows, comp, weights = journey
    whole = rerank.forced_lists(rows, comp, weights, ["_h"]).collect()
    monkeypatch.setattr(rerank, "SCORED", 3)
    assert sorted(rerank.forced_lists(rows, comp, weights, ["_h"]).collect(), key=str) == sorted(whole, key=str)


def test_no_rows(journey):
    rows, comp, weights = journey
    assert rerank.candidate_lists(rows.limit(0), comp, weights, force_true=True).collect() == []


def test_training_takes_all_rows(spark, monkeypatch):
    df = spark.createDataFrame([(p, i, 2000 + i) for p in range(5) for i in range(4)], "person_id long, pos long, yr int")
    monkeypatch.setattr(rerank, "capped_rows", lambda rows, cap, seed: rows.limit(3))
    for options, n in (({}, 20), ({"scorer_rows": 3}, 3)):
        ctx = JourneyContext(spark, "none", **options)
        ctx.annotated, ctx.__dict__["transitions"] = (lambda name: df), df
        assert ctx._ranked_rows("train").count() == n and ctx._ranked_rows("val").count() == 20


def test_short_lists_need_their_terms(journey):
    rows, comp, weights = journey
    years = rows.withColumn("yr", F.lit(2001)).withColumn("_fy", F.lit(2000)).withColumn("_ly", F.lit(2003))
    with pytest.raises(ValueError):
        listwise.likelihood(listwise.row_lists(years, comp, weights), np.zeros((1, len(listwise.TERMS))))


def test_terms_of_short_lists_against_their_features(spark, journey):
    rows, comp, weights = journey
    # one row per (person, pos), as the table of features has it
    rows = rows.withColumn("person_id", F.coalesce("person_id", F.lit(901))).dropDuplicates(["person_id", "pos"])
    rows = rows.withColumn("yr", (2000 + F.col("pos")).cast("int")).withColumn("_fy", F.lit(2000)).withColumn("_ly", F.lit(2007))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    emb = spark.createDataFrame([(i, [float(i % 4), 1.0, float(i % 7)]) for i in range(29)], "state_idx int, emb array<double>")
    short = listwise.with_terms(listwise.row_lists(rows, comp, weights), listwise.Terms(ensemble.Arrays(comp, weights), comp, emb))
    long = listwise.lists(rerank.candidate_features(rerank.candidate_lists(rows, comp, weights, force_true=True), comp, emb, None))
    w = np.random.default_rng(3).normal(size=(2, len(listwise.TERMS))) * 0.3
    assert np.allclose(listwise.likelihood(short, w), listwise.likelihood(long, w), rtol=1e-9, atol=1e-7)
    assert (listwise.top1(short, w) == listwise.top1(long, w)).all() and np.allclose(listwise.spread(short), listwise.spread(long))


def _test_lists(spark, journey):
    """(context lists, table of features) of evaluation rows; one list is short of candidates, rows of a list differ in their years."""
    rows, comp, weights = journey
    # one row per (person, pos), as the table of features has it
    rows = rows.filter("person_id < 9").dropDuplicates(["person_id", "pos"]).withColumn("yr", (2000 + F.col("pos")).cast("int")).withColumn("_fy", F.lit(2000)).withColumn("_ly", F.lit(2007))
    rows = rows.withColumn("person_id", F.col("person_id") + 500)   # not in training: no prior
    rows = rows.unionByName(rows.withColumn("person_id", F.col("person_id") + 100).withColumn("_fy", F.lit(1990)).filter("pos % 2 = 0"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    made = rerank.context_candidates(rows, comp, weights)
    made = spark.createDataFrame(made.collect(), made.schema)
    cut = F.when(F.col("cur_idx") % 5 == 0, 3).otherwise(20)
    made = made.withColumn("cands", F.slice("cands", 1, cut)).withColumn("cv", F.slice("cv", 1, cut))
    emb = spark.createDataFrame([(i, [float(i % 4), 1.0, float(i % 7)]) for i in range(30)], "state_idx int, emb array<double>")
    once = listwise.context_lists(rows, comp, made, emb)
    each = rerank.candidate_features(rerank.candidate_lists(rows, comp, weights, made=made), comp, emb, None)
    return once, spark.createDataFrame(each.collect(), each.schema)


def test_ranking_once_per_list_against_each_row(spark, journey, monkeypatch):
    once, each = _test_lists(spark, journey)
    once = spark.createDataFrame(once.collect(), once.schema)
    monkeypatch.setattr(listwise, "EXPANDED", 5)
    w = np.random.default_rng(5).normal(size=len(listwise.TERMS)) * 3
    for by_numbers, by_column in ((listwise.FIXED, rerank.linear_score()), (listwise.Scorer(w), listwise.score(w))):
        got, want = rerank.rerank(once, by_numbers), rerank.rerank(each, by_column)
        assert sorted(rerank.rerank_eval(got).collect()) == sorted(rerank.rerank_eval(want).collect())
        full = want.groupBy("person_id", "pos").agg(F.max(F.when(F.col("cand_idx") == F.col("nxt_idx"), F.col("rank"))).alias("t"),
                                                    F.array_sort(F.collect_list(F.struct("new_rank", "rank"))).alias("o"))
        assert sorted((r.truth, r.order) for r in got.collect() for _ in range(r.n)) == \
            sorted((-1 if r.t is None else r.t, [c["rank"] for c in r.o]) for r in full.collect())


def test_learned_evaluation_scores_no_row_by_expressions(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_learned", lambda *a: ([0.1] * len(listwise.TERMS), None))
    seen = []
    monkeypatch.setattr(JourneyContext, "feature_lists", lambda self, name: seen.append(name))
    monkeypatch.setattr(JourneyContext, "ranked_lists", lambda self, name: spark.createDataFrame(
        [([0.0, -1.0], [0.5] * 2 * len(listwise.TERMS), -1, [(1, 3, 0.0, 0.0, 0.0, 0.0), (-1, 1, 0.0, 0.0, 0.0, 0.0)])],
        "o array<double>, x array<double>, self_at int, rows array<struct<truth int, n long, f_ysf double, f_span double, f_npt double, f_vel double>>"))
    got = {r.ranking: r[1:] for r in catalog.QUERIES["rerank_learned_eval"](spark, "none").collect()}
    assert not seen and got == {k: (0.0, 0.75, 0.75, 0.75) for k in ("ensemble", "rerank", "learned")}
