"""Classification metrics, splits and the learned parts: invariants."""

import math

from pyspark.sql import functions as F

from trailmark.operators import classify, drift, profiles, transitions


def test_class_split_sizes_per_class(spark):
    rows = [(i, "a" if i < 20 else "b") for i in range(30)]
    s = classify.class_split(spark.createDataFrame(rows, "id long, y string"), "y", ["id"])
    c = {(r.y, r.split): r.n for r in s.groupBy("y", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert (c[("a", "train")], c[("a", "val")], c[("a", "test")]) == (14, 3, 3)
    assert (c[("b", "train")], c[("b", "val")], c[("b", "test")]) == (7, 1, 2)


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "y string")
    w = {r.y: r.weight for r in classify.class_weights(df, "y").collect()}
    assert w == {"a": 8 / (2 * 6), "b": 8 / (2 * 2)}


def test_class_report_by_hand(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "b")]
    r = {x.label: x for x in classify.class_report(spark.createDataFrame(rows, "t string, p string"), "t", "p").collect()}
    assert r["a"].precision == 1.0 and r["a"].recall == 0.5
    assert abs(r["b"].precision - 2 / 4) < 1e-12 and r["b"].recall == 1.0
    assert r["c"].precision == 0.0 and r["c"].f1 == 0.0
    assert r["accuracy"].f1 == 3 / 5 and r["accuracy"].support == 5


def test_hashed_embedding_unit_norm(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, "bonjour le monde"), (3, "")], "id long, text string")
    e = {r.id: r.embedding for r in classify.hashed_embedding(df, "text", "id").collect()}
    assert abs(math.sqrt(sum(x * x for x in e[1])) - 1.0) < 1e-9 and len(e[1]) == classify.EMBED_DIM
    assert sum(abs(x) for x in e[3]) == 0.0


def _trans(spark):
    rows = []
    for p in range(40):
        for y in range(6):
            rows.append((p, str(100 + (p * 7 + y * 3) % 6), 2000 + y, str(2000 + y), f"l{y}"))
    ev = spark.createDataFrame(rows, "person_id long, state string, yr int, start_date string, matched_label string")
    return transitions.build_transitions(ev)


def test_pca_explained_and_padding(spark):
    t = _trans(spark)
    sp = transitions.state_space(t)
    e, c = profiles.pca(t, sp, k=5)
    ex = [r.explained_pct for r in e.orderBy("component").collect()]
    assert len(ex) == 5 and sum(ex) <= 100.1 and ex == sorted(ex, reverse=True)
    assert c.count() == sp.count()


def test_kmeans_labels_every_row(spark):
    t = _trans(spark)
    risk = t.groupBy("person_id").agg(F.avg(F.length("cur")).alias("drift_score"),
                                      F.count(F.lit(1)).cast("double").alias("seq_length"),
                                      (F.col("person_id") % 3 / 3.0).alias("self_loop_rate"))
    cl = drift.cluster_drift(risk, k=3, restarts=3, seed=1)
    assert cl.filter(F.col("cluster").isNull()).count() == 0 and cl.count() == 40
    assert cl.select("cluster").distinct().count() <= 3


def test_confidence_gate_and_hist(spark):
    df = spark.createDataFrame([(0.10,), (0.35,), (0.50,), (1.0,)], "confidence double")
    assert classify.confidence_gate(df).count() == 3                       # >= 0.35 kept
    h = {r.bin: r for r in classify.confidence_hist(df, bins=10).collect()}
    assert h[9].n == 1 and h[1].n == 1 and h[3].n == 1 and h[5].n == 1     # 1.0 falls in the last bin
    assert all(r.kept_share == 0.75 for r in h.values())


def test_archetype_rules_first_match(spark):
    rows = [(0, 10, 1.0, 2.0, 0.9), (1, 10, 2.0, 2.0, 0.4), (2, 10, 3.0, 9.0, 0.4),
            (3, 10, 4.0, 2.0, 0.4), (4, 10, 5.0, 2.0, 0.1)]
    s = spark.createDataFrame(rows, "cluster int, n_users long, mean_drift double, mean_len double, mean_loop double")
    names = {r.cluster: r.archetype for r in drift.archetype_names(s).collect()}
    # q80(drift)=4.2, q20=1.8, q50=3.0, q75(len)=2.0
    assert names == {0: "Sector Loyalist", 1: "Stable Specialist", 2: "Career Veteran",
                     3: "Gradual Mover", 4: "Career Switcher"}


def test_classifier_has_one_class_per_label(spark):
    rows = [(i, "red apple" if i % 2 else "blue sky", "a" if i % 2 else "b") for i in range(40)] + [(99, "odd", None)]
    df = spark.createDataFrame(rows, "id long, text string, y string")
    m = classify.train_classifier(df, "text", "y", num_features=64, max_iter=5)
    assert sorted(m.labels) == ["a", "b"] and m.pipeline.stages[-1].numClasses == 2
    got = {r.id: r for r in classify.score(m, df.drop("y")).collect()}
    assert got[1].predicted == "a" and got[2].predicted == "b" and 0.5 <= got[99].confidence <= 1.0
