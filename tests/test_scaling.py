"""What grows with the input: what is shuffled, how tasks are cut, how often an input is run."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trailmark.operators import classify, listwise, rerank
from trailmark.plans import catalog
from trailmark.plans.journey import JourneyContext
from trailmark.sources import stages, tables

SF = "/root/testdata/sf0.001"


def _exchanged(df, capsys):
    """Columns of every exchange of the plan, as text."""
    capsys.readouterr()
    df.explain("formatted")
    plan = capsys.readouterr().out
    return plan, re.findall(r"\n\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: (\[.*\])", plan)


def _brute(text, dim=classify.EMBED_DIM):
    out = Counter()
    for t in [w for w in re.split("[ \t\n\x0b\f\r]+", text) if w] + [text[i:i + 3] for i in range(len(text) - 2)]:
        h = hashlib.md5(t.encode()).hexdigest()
        out[int(h[:7], 16) % dim] += 1 if h[7] < "8" else -1
    return {k: v for k, v in out.items() if v}


def test_buckets_of_texts_against_single_tokens(spark, monkeypatch):
    texts = ["", "ab", "abc", "one two x\n two", "a\U0001f600bc d", "\x0bz\x1c y" * 9]
    monkeypatch.setattr(classify, "ENCODED_CHARS", 7)
    monkeypatch.setattr(classify, "REMEMBERED", 3)
    got = classify._Buckets(classify.EMBED_DIM)(texts)
    assert [{int(i): int(r[i]) for i in np.flatnonzero(r)} for r in got] == [_brute(t) for t in texts]
    df = spark.createDataFrame([*enumerate(texts), (7, None), (2, "abd"), (None, "n")], "doc_id long, text string")
    sums = {}
    for r in classify.bucket_sums(df, "doc_id", "text").collect():
        sums.setdefault(r.doc_id, {})[r.bucket] = r.w
    want = {i: _brute(t) for i, t in enumerate(texts) if _brute(t)}
    want[2] = {k: v for k, v in (Counter(_brute("abc")) | Counter()).items()}
    both = Counter()
    for t in ("abc", "abd"):
        for k, v in _brute(t).items():
            both[k] += v
    want[2], want[None] = {k: v for k, v in both.items() if v}, _brute("n")
    assert sums == want
    e = [r.embedding for r in classify.hashed_embedding(df, "text", "doc_id").orderBy("doc_id").collect()]
    assert len(e) == df.count() and all(len(v) == classify.EMBED_DIM for v in e) and not any(e[-1])
    w = np.array([_brute(texts[3]).get(i, 0) for i in range(classify.EMBED_DIM)], float)
    assert e[[r.doc_id for r in df.orderBy("doc_id").collect()].index(3)] == (w / np.sqrt((w * w).sum())).tolist()


def test_training_tasks_follow_the_characters(spark, monkeypatch):
    from pyspark.ml import Pipeline
    monkeypatch.setattr(classify, "CHARS_PER_TASK", 100, raising=False)
    seen, real = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df, *a: seen.append(df.rdd.getNumPartitions()) or real(self, df, *a))
    df = spark.createDataFrame([(f"word{i % 2} other words", "ab"[i % 2]) for i in range(60)], "text string, lang string").coalesce(1)
    m = classify.train_classifier(df, "text", "lang", num_features=16, max_iter=2)
    assert m.labels == ["a", "b"] and seen == [11]


def test_histogram_runs_the_scores_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = spark.range(20).select((F.col("id") / 20.0).alias("confidence"))
    got = classify.confidence_hist(df.mapInArrow(counted, df.schema), bins=4).collect()
    assert seen.value == 20 and {r.kept_share for r in got} == {13 / 20} and sum(r.n for r in got) == 20


def test_events_shuffle_no_texts_of_parts(spark, capsys):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        _, moved = _exchanged(tables.job_events(spark, SF), capsys)
    finally:
        spark.conf.set(key, before)
    assert moved and not [c for c in moved if "l_orderkey" in c and "p_name" in c or "l_linenumber" in c and "p_name" in c]


def test_transitions_hold_no_texts_of_events(spark):
    assert not {"combined_text", "matched_description", "matched_code"} & set(JourneyContext(spark, SF).transitions.columns)


def test_dataset_stats_expand_no_rows(spark, capsys):
    plan, _ = _exchanged(catalog.QUERIES["dataset_stats"](spark, SF), capsys)
    assert "Expand" not in plan


def test_lists_are_shuffled_without_the_arrays_of_contexts(spark, capsys):
    ctx = JourneyContext(spark, SF)
    _, moved = _exchanged(rerank.candidate_lists(ctx.annotated("train"), ctx.components, ctx.weights, force_true=True), capsys)
    assert moved and not [c for c in moved if "topk#" in c or " h#" in c]


def test_features_are_not_written(spark, capsys):
    ctx = JourneyContext(spark, SF, scorer_rows=149_999)
    f = ctx.candidate_features("test")
    assert f.count() > 0 and not stages.manifest(spark, ctx.stage_path(f"{ctx.ens_tag}/cand-test-{ctx.scorer_rows}"))
    plan, _ = _exchanged(rerank.ablation(f), capsys)
    assert "SortAggregate" not in plan


def test_lists_of_contexts_against_a_list_per_row(spark):
    ctx = JourneyContext(spark, SF, scorer_rows=149_998)
    w = np.random.default_rng(1).normal(size=(2, len(listwise.TERMS))) * 0.2
    for name in ("val", "train"):
        once, each = ctx.ranked_lists(name), listwise.lists(ctx.candidate_features(name)).persist()
        assert once.select(F.inline("rows")).agg(F.sum("n")).first()[0] == each.count()
        assert np.allclose(listwise.likelihood(once, w), listwise.likelihood(each, w), rtol=1e-9, atol=1e-7)
        assert (listwise.top1(once, w) == listwise.top1(each, w)).all()
    # evaluation lists come once per context, not once per row
    assert ctx.ranked_lists("val").count() < ctx.ranked_lists("val").select(F.inline("rows")).agg(F.sum("n")).first()[0]


def test_a_list_with_many_rows_is_expanded_in_parts(spark, monkeypatch):
    ctx = JourneyContext(spark, SF, scorer_rows=149_998)
    b = pa.RecordBatch.from_pandas(ctx.ranked_lists("val").limit(40).toPandas(), schema=None, preserve_index=False)
    w = np.random.default_rng(2).normal(size=(1, len(listwise.TERMS))) * 0.2
    whole = [r.column("v").to_numpy() for r in listwise._sums(w)(iter([b]))][0]
    monkeypatch.setattr(listwise, "EXPANDED", 3)
    parts = [r.column("v").to_numpy() for r in listwise._sums(w)(iter([b]))][0]
    assert whole[0] > 3 and np.allclose(whole, parts)


def test_ranking_lists_shuffles_no_candidates(spark, capsys):
    ctx = JourneyContext(spark, SF)
    f, each = ctx.feature_lists("test"), ctx.candidate_features("test")
    ranked = rerank.rerank(f, lambda col: rerank.linear_score(col=col))
    _, moved = _exchanged(rerank.rerank_eval(ranked), capsys)
    assert not [c for c in moved if "f_cos" in c or "feats" in c or "cv#" in c]
    want = rerank.rerank(each, rerank.linear_score())
    key = lambda r: (r.person_id, r.pos, r.new_rank)
    a = sorted(ranked.select("person_id", "pos", F.inline("ranked")).collect(), key=key)
    b = sorted(want.select("person_id", "pos", "score", "new_rank", "rank", "cand_idx").collect(), key=key)
    assert len(a) == len(b) > 0 and all(x[:2] + x[3:] == y[:2] + y[3:] and abs(x.score - y.score) < 1e-8 for x, y in zip(a, b, strict=True))
    assert sorted(rerank.rerank_eval(ranked).collect()) == sorted(rerank.rerank_eval(want).collect())
