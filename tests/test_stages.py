"""Sources, sinks and stage tables."""

import os

import pytest
from pyspark.sql import functions as F

from trailmark.sources import stages, tables


def test_load_splits_skips_missing_and_raises_when_none(spark, scratch):
    a = os.path.join(scratch, "train.parquet")
    b = os.path.join(scratch, "test.parquet")
    spark.createDataFrame([(1, "x")], "person_id long, matched_label string").write.parquet(a)
    spark.createDataFrame([(2, "y", True)], "person_id long, matched_label string, extra boolean").write.parquet(b)
    with pytest.warns(UserWarning):
        out = tables.load_splits(spark, [a, os.path.join(scratch, "validation.parquet"), b])
    assert sorted(r.person_id for r in out.collect()) == [1, 2]
    assert "extra" in out.columns
    with pytest.raises(FileNotFoundError), pytest.warns(UserWarning):
        tables.load_splits(spark, [os.path.join(scratch, "none.parquet")])


def test_stage_round_trip_and_freshness(spark, scratch):
    path = os.path.join(scratch, "stage")
    calls = []

    def build():
        calls.append(1)
        return spark.range(10).withColumn("v", F.col("id") * 2)
    first = stages.stage(spark, path, build, "fp1", "demo")
    assert sorted(r.v for r in first.collect()) == [2 * i for i in range(10)]
    stages.stage(spark, path, build, "fp1", "demo")
    assert len(calls) == 1                                     # fresh: reused
    assert stages.stage_is_fresh(spark, path, "fp1")
    assert not stages.stage_is_fresh(spark, path, "fp2")
    stages.stage(spark, path, build, "fp2", "demo")
    assert len(calls) == 2                                     # changed input: rebuilt


def test_fingerprint_is_order_free_and_counts_duplicates(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "t string")
    f1 = stages.dataset_fingerprint(df, ["t"]).first().fingerprint
    f2 = stages.dataset_fingerprint(df.orderBy(F.desc("t")).repartition(2), ["t"]).first().fingerprint
    f3 = stages.dataset_fingerprint(df.unionByName(df.limit(1)), ["t"]).first().fingerprint
    assert f1 == f2 and f1 != f3 and len(f1) == 16


def test_csv_and_json_sinks_round_trip(spark, scratch):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "name string, value double")
    stages.write_csv(df, os.path.join(scratch, "csv"))
    back = stages.read_csv(spark, os.path.join(scratch, "csv"), "name string, value double")
    assert sorted(back.collect()) == sorted(df.collect())
    stages.write_metrics(df, os.path.join(scratch, "json"))
    js = spark.read.json(os.path.join(scratch, "json"))
    assert sorted((r.name, r.value) for r in js.collect()) == [("a", 1.5), ("b", 2.0)]


def test_incremental_embeddings_encodes_only_new_texts(spark, scratch):
    store = os.path.join(scratch, "emb")
    seen = []

    def encode(df):
        seen.append(df.count())
        return df.withColumn("embedding", F.array(F.length("text").cast("double")))
    t1 = spark.createDataFrame([("ab",), ("cde",), ("ab",)], "text string")
    assert stages.incremental_embeddings(t1, store, encode).count() == 2
    t2 = spark.createDataFrame([("ab",), ("xyz1",)], "text string")
    assert stages.incremental_embeddings(t2, store, encode).count() == 3
    assert seen == [2, 1]


def test_a_lost_write_is_never_fresh(spark, scratch):
    path = os.path.join(scratch, "stage")
    spark.range(3).write.parquet(os.path.join(path, "v-lost"))   # data, but no commit
    assert not stages.stage_is_fresh(spark, path, "fp")

    def fails():
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        stages.stage(spark, path, fails, "fp")
    assert stages.manifest(spark, path) is None
    assert stages.stage(spark, path, lambda: spark.range(5), "fp").count() == 5
    with pytest.raises(RuntimeError):                            # a failed rebuild keeps what was committed
        stages.stage(spark, path, fails, "fp2")
    assert stages.stage_is_fresh(spark, path, "fp") and spark.read.parquet(stages.data_path(spark, path)).count() == 5


def test_staleness_follows_the_stages_before(spark, scratch):
    a, b = os.path.join(scratch, "a"), os.path.join(scratch, "b")
    stages.stage(spark, a, lambda: spark.range(5), "1")
    stages.stage(spark, b, lambda: spark.range(6), "1", after=[a])
    assert stages.stage_is_fresh(spark, b, "1", [a])
    stages.stage(spark, a, lambda: spark.range(7), "2")
    assert not stages.stage_is_fresh(spark, b, "1", [a])
    before = stages.data_path(spark, a)
    stages.stage(spark, a, lambda: spark.range(8), "3")
    assert spark.read.parquet(before).count() == 7               # one version back is kept
    stages.stage(spark, a, lambda: spark.range(9), "4")
    assert not stages.path_exists(spark, before)


def test_a_repeated_or_lost_batch_adds_nothing_twice(spark, scratch):
    store = os.path.join(scratch, "emb")
    encode = lambda df: df.withColumn("embedding", F.array(F.length("text").cast("double")))
    t1 = spark.createDataFrame([("ab",), ("cde",), ("ab",), (None,)], "text string")
    t2 = spark.createDataFrame([("ab",), ("xyz1",)], "text string")

    def lost(df):
        encode(df).select("key", "embedding").write.parquet(os.path.join(store, "batch-lost"))
        raise RuntimeError("lost")
    for t in (t1, t1, t2, t2, t1):
        out = stages.incremental_embeddings(t, store, encode)
    with pytest.raises(RuntimeError):
        stages.incremental_embeddings(spark.createDataFrame([("new",)], "text string"), store, lost)
    out = stages.incremental_embeddings(t2, store, encode)
    assert sorted(r.batch for r in out.collect()) == [1, 1, 2]
