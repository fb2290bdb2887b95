"""Training of the toxicity network: every labelled row counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import language_id as lid
from trailmark.llm import toxicity


def _rows(n=900):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    bad = ["scumbag", "wretch", "dimwit", "lowlife", "vermin", "halfwit", "moron", "filth"]
    out = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(5, 30))]
        if i % 3 == 0:
            body.insert(rng.randrange(len(body)), rng.choice(bad))
        out.append((i, " ".join(body), int(i % 3 == 0)))
    return out


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows], "doc_id long, text string, lang string, source string").repartition(3, "doc_id")


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_rows_beyond_the_starting_sample_train_and_calibrate(spark, monkeypatch, broadcast):
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", broadcast)
    rows = _rows()
    docs = _docs(spark, rows)
    labels = spark.createDataFrame([(i, m) for i, _, m in rows], "doc_id long, toxic int")
    parser = lid.train(docs)
    seen = {}
    real_refine, real_counts = toxicity.refine, toxicity.logit_counts

    def refine(front, start, *args):
        seen["front"] = front.select("doc_id").toPandas().doc_id.tolist()
        seen["start"] = start.net.table.copy()
        return real_refine(front, start, *args)

    def counts(back, net):
        seen["back"] = back.select("doc_id").toPandas().doc_id.tolist()
        seen["counts"] = real_counts(back, net).persist()
        return seen["counts"]
    monkeypatch.setattr(toxicity, "refine", refine)
    monkeypatch.setattr(toxicity, "logit_counts", counts)
    net, share = toxicity.train(docs, labels, parser, train_rows=8, passes=1)
    assert sorted(seen["front"] + seen["back"]) == [i for i, _, _ in rows] and 150 < len(seen["back"]) < 300
    n, toxic = seen["counts"].agg(F.sum(F.col("clean") + F.col("toxic")), F.sum("toxic")).first()
    assert n == len(seen["back"]) and toxic == sum(i % 3 == 0 for i in seen["back"])
    # words of no row of the starting sample have moved
    moved = (net.table != seen["start"]).any(axis=1).sum()
    assert moved > 100 and abs(share - 1 / 3) < 1e-9


def test_a_pass_over_all_rows_learns_words_the_sample_lacks(spark):
    rows = _rows()
    docs = _docs(spark, rows)
    labels = spark.createDataFrame([(i, m) for i, _, m in rows if i < 750], "doc_id long, toxic int")
    got = toxicity.predict_toxicity(docs, labels, train_rows=30, passes=6).filter("doc_id >= 750").toPandas()
    want = np.array([m for _, _, m in rows])[got.doc_id]
    assert (got.predicted == want).mean() > 0.85


def test_threshold_against_every_cut():
    rng = np.random.default_rng(1)
    for _ in range(30):
        step = rng.integers(-9, 9, 12)
        clean, toxic = rng.integers(0, 3, 12), rng.integers(0, 3, 12)
        t = toxicity.best_threshold(step, clean, toxic)

        def f1(cut, step=step, clean=clean, toxic=toxic):
            marked = (step + 0.5) / toxicity.STEPS >= cut
            hit, wrong = toxic[marked].sum(), clean[marked].sum()
            return 2 * hit / (hit + wrong + toxic.sum()) if hit > wrong else 0.0
        assert np.isclose(f1(t), max(f1(c / toxicity.STEPS) for c in range(-10, 11)))


def test_averaged_changes_do_not_depend_on_the_order_of_sums(spark):
    rows = [(i % 2, toxicity.word_rows(["ab", "cd", f"w{i}"]).astype(np.uint16).tobytes()) for i in range(40)]
    df = spark.createDataFrame(rows, "toxic int, rows binary").repartition(4).persist()
    nets = [toxicity.refine(df, toxicity.Trainer(toxicity.Network(2), (1.0, 1.0)), 20, 20) for _ in range(2)]
    assert (nets[0].table == nets[1].table).all() and nets[0].bias == nets[1].bias
    # one task alone: its own weights
    one = toxicity.Trainer(toxicity.Network(2), toxicity.balance(20, 20))
    alone = toxicity.refine(df.coalesce(1), toxicity.Trainer(toxicity.Network(2), (1.0, 1.0)), 20, 20)
    got = df.coalesce(1).toPandas()
    one.epoch([np.frombuffer(bytes(r), np.uint16).reshape(-1, 3).astype(np.int64) for r in got["rows"]], got.toxic.to_numpy(), np.random.default_rng(5))
    assert np.allclose(alone.table, one.net.table, atol=1e-5) and np.allclose(alone.out, one.net.out, atol=1e-5)
