"""Properties of the whole journey pipeline on the sf0.001 tables."""

import math
import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sf0.001 tables not present")


@pytest.fixture(scope="module")
def ctx(spark):
    from trailmark.plans.journey import context
    return context(spark, SF)


@pytest.mark.parametrize("piece", ["glob", "rec", "wm", "so", "seg"])
def test_every_matrix_row_is_a_distribution(ctx, piece):
    m = getattr(ctx.components, piece)
    n = ctx.space.count()
    rows = m.select(F.aggregate("p", F.lit(0.0), lambda a, v: a + v).alias("s"),
                    F.array_min("p").alias("mn"), F.size("p").alias("k")).collect()
    assert rows
    for r in rows:
        assert abs(r.s - 1.0) < 1e-9 and r.mn > 0 and r.k == n


def test_split_sizes_per_stratum(ctx):
    s = ctx.split.groupBy("dominant", "split").agg(F.count(F.lit(1)).alias("c")).collect()
    by = {}
    for r in s:
        by.setdefault(r.dominant, {})[r.split] = r.c
    for parts in by.values():
        n = sum(parts.values())
        assert parts.get("train", 0) == math.floor(0.64 * n)
        assert parts.get("val", 0) == math.floor(0.80 * n) - math.floor(0.64 * n)


def test_topk_monotone_and_drift_nonnegative(spark, ctx):
    import __spark_entry__ as E
    e = E.queries()["ensemble_eval"](spark, SF).first()
    assert 0 <= e.top_1 <= e.top_3 <= e.top_5 <= 1
    assert ctx.risk.filter(F.col("drift_score") < 0).count() == 0


def test_tuned_weights_leave_the_rest_floor(ctx):
    for r in ctx.weights.collect():
        assert r.w_hist + r.w_so + r.w_arch <= 1.0 - 0.05 + 1e-9 or not r.tuned


def test_train_only_state_space(spark):
    from trailmark.operators import ensemble
    from trailmark.plans.journey import JourneyContext
    c = JourneyContext(spark, SF, space_from="train")
    train_states = {r.cur for r in c.part("train").select("cur").distinct().collect()} | \
        {r.nxt for r in c.part("train").select("nxt").distinct().collect()}
    assert {r.state for r in c.model_space.collect()} == train_states
    assert c.components.glob.count() == len(train_states)
    e = ensemble.evaluate(c.annotated("test"), c.components, c.weights).first()
    assert 0 <= e.top_1 <= e.top_3 <= e.top_5 <= 1
