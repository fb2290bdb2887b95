"""Skew paths give the same answers as the plain plans."""

import numpy as np
from pyspark.sql import functions as F

from trailmark.operators import ensemble, reports, sequence, transitions

EV = "person_id long, state string, yr int, start_date string, matched_label string"


def _skewed(spark):
    rows = [(1, str(100 + (i * 7) % 5), 1950 + i % 70, f"{1950 + i % 70}-{i:05d}", f"l{i}") for i in range(600)]
    rows += [(p, str(100 + p % 3), 2000 + k, str(2000 + k), "x") for p in range(2, 40) for k in range(3)]
    return spark.createDataFrame(rows, EV).repartition(6)


def test_hot_entity_chunked_path_matches_plain(spark):
    ev = _skewed(spark)
    cols = ["person_id", "pos", "cur", "nxt", "prev", "yr", "start_date"]
    plain = transitions.build_transitions(ev, hot_rows=10 ** 9).select(*cols).collect()
    hot = transitions.build_transitions(ev, hot_rows=50).select(*cols).collect()   # entity 1 takes the chunked path
    assert sorted(plain) == sorted(hot)
    assert len(plain) == ev.count() - ev.select("person_id").distinct().count()


def test_capped_sample_on_hot_group(spark):
    df = _skewed(spark).withColumn("pos", F.monotonically_increasing_id())
    spark.conf.set(sequence.HOT_ROWS_SETTING, "50")
    try:
        s = ensemble.capped_sample(df, "person_id", 100, 42, ["person_id", "pos"])
        per = {r.person_id: r.n for r in s.groupBy("person_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    finally:
        spark.conf.unset(sequence.HOT_ROWS_SETTING)
    assert per[1] == 100 and all(v == 3 for k, v in per.items() if k != 1)


def test_exact_quantiles_match_numpy(spark):
    vals = [float(v) for v in np.random.default_rng(3).normal(size=257)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(5)
    qs = [0.0, 0.2, 0.5, 0.75, 0.8, 1.0]
    got = reports.exact_quantiles(df, "x", qs, [f"q{i}" for i in range(len(qs))]).first()
    for i, q in enumerate(qs):
        assert abs(got[f"q{i}"] - float(np.quantile(vals, q))) < 1e-12


def _wide(spark, n=400_000):
    """One entity and the null entity hold most rows; wide rows with ties in the order."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 20 < 9, F.lit(1)).when(i % 20 < 17, F.lit(None)).otherwise(i % 1000 + 10).cast("long").alias("person_id"),
        (F.lit(100) + F.pmod(F.xxhash64(i), F.lit(50))).cast("string").alias("state"),
        (F.lit(1950) + i % 70).cast("int").alias("yr"), (F.xxhash64(i) % 5000).cast("string").alias("start_date"),
        F.concat(F.lit("label "), (i % 31).cast("string")).alias("matched_label"),
        F.sha2(i.cast("string"), 256).alias("w1"), (i * 3).alias("w2"), F.lit("x" * 40).alias("w3"))


def test_hot_path_equals_plain_on_many_wide_rows(spark, scratch):
    ev = _wide(spark)
    ev.write.parquet(scratch + "/ev")
    ev = spark.read.parquet(scratch + "/ev")
    plain = transitions.build_transitions(ev, hot_rows=10 ** 9)
    key = F.sum(F.xxhash64(*sorted(plain.columns)).cast("decimal(38,0)"))
    want = plain.agg(F.count(F.lit(1)), key).first()
    for _ in range(2):  # all columns written, twice
        transitions.build_transitions(ev, hot_rows=2000).write.mode("overwrite").parquet(scratch + "/hot")
        hot = spark.read.parquet(scratch + "/hot")
        assert tuple(hot.agg(F.count(F.lit(1)), key).first()) == tuple(want)
        assert hot.groupBy("person_id", "pos").count().filter("count > 1").count() == 0


def test_running_weight_on_hot_group(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), F.pmod(F.xxhash64("id"), F.lit(700)).alias("o"), (F.col("id") % 7).alias("w"))
    c = df.groupBy("g", "o").agg(F.sum("w").alias("w"))
    a = sequence.ordered_sequence(c, ["g"], ["o"], position="at", weight="w", hot_rows=10 ** 9).collect()
    b = sequence.ordered_sequence(c, ["g"], ["o"], position="at", weight="w", hot_rows=20).collect()
    assert sorted(a) == sorted(b)
    run = 0
    for r in sorted(a, key=lambda r: r.o):
        assert r["at"] == run
        run += r.w


def test_quantiles_with_one_value_holding_most_rows(spark):
    vals = [1.5] * 4000 + [float(i) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(7)
    got = reports.exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.9, 1.0], list("abcde"), hot_rows=50).first()
    for q, n in zip([0.0, 0.1, 0.5, 0.9, 1.0], "abcde"):
        assert abs(got[n] - float(np.quantile(vals, q))) < 1e-9
