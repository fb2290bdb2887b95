"""Candidate reranking.

Candidates come from the ensemble: the top K states of each scoring context
(F6); a row's list is its context's list, so candidate generation is one
join from rows to contexts. Training rows may get the true next state forced
into the last slot; their contexts hold the entity's own prior, so there are nearly as many as
rows, and each row's list is made where the row is (``forced_lists``). Evaluation rows keep the honest list and report
candidate recall (the true next is never injected there). Features are
computed on the exploded (row, candidate) table, at most K rows per row.

Rankings are compared state to state: a hit at k means the true next state
is among the first k states of that ranking.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions.exprs import LOG_FLOOR, dot, round_to
from trailmark.operators import ensemble, transitions
from trailmark.operators.reports import exact_quantiles

TOP_K = 20
FEATURES = ["f_cos", "f_log_global", "f_log_recency", "f_log_second", "f_hist", "f_ysf", "f_span",
            "f_npt", "f_vel", "f_same_l1", "f_same_l2", "f_direction", "f_self", "f_log_incoming",
            "f_ensemble"]
# Feature groups for the ablation (indices into FEATURES).
FEATURE_GROUPS = {
    "A_semantic_similarity": [0],
    "B_markov_probability": [1],
    "C_recency_probability": [2],
    "D_second_order": [3],
    "E_user_history": [4],
    "F_temporal": [5, 6, 7, 8],
    "G_hierarchy": [9, 10, 11],
    "H_self_transition": [12],
    "I_global_frequency": [13],
    "J_ensemble_score": [14],
}
# A fixed linear scorer (our own weights): it makes the rerank path
# deterministic and checkable; ``listwise`` learns one.
FIXED_WEIGHTS = [0.5, 1.0, 0.5, 0.5, 1.0, 0.0, 0.0, 0.0, 0.0, 0.1, 0.1, 0.0, 0.2, 0.1, 5.0]
SCORE_DIGITS = 9
#: Ranks of a list, for packing them beside a score.
MAX_LIST = 1024
ROW = ["person_id", "pos"]
#: The component values of a candidate, as they are named in ``cv``, and rows scored at a time in a task.
VALUES = {"_g": "g", "_r": "r", "_sv": "s", "_h": "h", "_p": "p"}
SCORED = 2048


def capped_rows(rows: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """The bounded sample on which the learned scorer is fitted: the ``cap``
    rows with the lowest md5 of (entity, pos). A hash threshold leaves about
    twice as many, whose top-k is exact."""
    n = rows.count()
    if n <= cap:
        return rows
    h = ensemble.hash_rank_key(seed, *ROW)
    part = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)
    near = rows.withColumn("_h", h).filter(part <= (2.0 * cap + 100) / n)
    return near.orderBy("_h", *ROW).limit(cap).drop("_h")


def key_join(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    cond = [a[k].eqNullSafe(b[k]) for k in keys]
    return a.join(b, cond).drop(*[b[k] for k in keys])


def candidate_lists(rows: DataFrame, comp, weights: DataFrame, k: int = TOP_K, force_true: bool = False,
                    entity: str = "person_id", made: DataFrame | None = None, values: bool = True) -> DataFrame:
    """Per row the K best states of its context (``cands``), the true
    next's 0-based position (-1 when absent) and, per candidate, the values
    the features need (``cv``: global, recency, second order, history and
    ensemble probability; not with ``values`` off). ``made``: the lists of the rows' contexts, if they are there."""
    if force_true:
        out = forced_lists(rows, comp, weights, VALUES if values else (), k, entity)
        return out.withColumn("cv", F.arrays_zip(F.col("cands").alias("cand_idx"), *VALUES)).drop(*VALUES) if values else out
    keyed = with_prior_entity(rows, comp, entity)
    if made is None:
        made = context_candidates(rows, comp, weights, k, entity)
    out = key_join(keyed, made, ensemble.CONTEXT_KEYS) \
        .withColumn("true_pos", (F.array_position("cands", F.col("nxt_idx")) - 1).cast("int"))
    return out if values else out.drop("cv")


def forced_lists(rows: DataFrame, comp, weights: DataFrame, values: Sequence[str] = (), k: int = TOP_K,
                 entity: str = "person_id") -> DataFrame:
    """The rows with the list of their context, the true next forced into its last place if it is not
    there (``cands``, ``true_pos``), and an array per name in ``values`` (of VALUES). The rows meet
    their entity's sparse prior, as narrow as they come; a task scores them a batch at a time, so
    no array of n states and no list is shuffled. Give only the columns that are needed."""
    arrays = ensemble.Arrays(comp, weights)
    prior = comp.prior.groupBy(entity).agg(F.collect_list(F.struct("state_idx", "p")).alias("_own"), F.first("p_default").alias("_other")) \
        .select(entity, F.col("_own.state_idx").alias("_states"), F.col("_own.p").alias("_probs"), "_other")
    met = rows.join(prior, entity, "left")
    lists = [T.StructField("cands", T.ArrayType(T.IntegerType())), T.StructField("true_pos", T.IntegerType()),
             *[T.StructField(v, T.ArrayType(T.DoubleType())) for v in values]]
    return met.mapInArrow(_forced(arrays, k, list(values), rows.columns), T.StructType([*rows.schema.fields, *lists]))


def _forced(arrays, k: int, values: list[str], kept: list[str]):
    def flat(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(x).ravel()))

    def made(b: pa.RecordBatch) -> pa.RecordBatch:
        at, every = arrays.components(b), np.arange(b.num_rows)[:, None]
        other = b.column("_other")
        h = np.where(np.asarray(other.is_valid())[:, None], other.fill_null(0.0).to_numpy()[:, None], arrays.rows[at["g"]])
        states = b.column("_states")
        owner = np.repeat(every[:, 0], states.value_lengths().fill_null(0).to_numpy())
        h[owner, states.flatten().to_numpy()] = b.column("_probs").flatten().to_numpy()
        p = arrays.prob(at, h)
        cands, truth = arrays.best(p, k).astype(np.int32), b.column("nxt_idx").to_numpy()
        cands[(cands != truth[:, None]).all(axis=1), -1] = truth[(cands != truth[:, None]).all(axis=1)]
        place = (cands == truth[:, None]).argmax(axis=1).astype(np.int32)
        whole = {"h": h, "p": p}
        of = [whole[c][every, cands] if c in whole else arrays.rows[at[c][:, None], cands] for c in (VALUES[v] for v in values)]
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], flat(cands), pa.array(place), *[flat(x) for x in of]],
                                          names=[*kept, "cands", "true_pos", *values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, SCORED):
                yield made(b.slice(start, SCORED))
    return run


def with_prior_entity(rows: DataFrame, comp, entity: str = "person_id") -> DataFrame:
    """The rows with the last of their context keys: the entity, if it has a prior of its own."""
    with_prior = comp.prior.select(entity).distinct().withColumn("_hp", F.lit(True))
    return rows.join(with_prior, entity, "left") \
               .withColumn("prior_entity", F.when(F.col("_hp"), F.col(entity))).drop("_hp")


def context_candidates(rows: DataFrame, comp, weights: DataFrame, k: int = TOP_K,
                       entity: str = "person_id") -> DataFrame:
    """The lists of ``candidate_lists`` before they meet the rows: one per context."""
    sc = ensemble.scored_contexts(rows, comp, weights, k, entity)
    values = ["g", "r", "s", "h", "p"]
    # a generator: the arrays are made below it, not again for every candidate
    sc = sc.select(*ensemble.CONTEXT_KEYS, *values, F.explode(F.array("topk")).alias("cands"))
    # The candidates' component values (K per list) are shuffled and written,
    # not the n-long arrays of the contexts.
    cv = F.transform("cands", lambda c: F.struct(
        c.alias("cand_idx"), F.get(F.col("g"), c).alias("_g"), F.get(F.col("r"), c).alias("_r"),
        F.get(F.col("s"), c).alias("_sv"), F.get(F.col("h"), c).alias("_h"), F.get(F.col("p"), c).alias("_p")))
    return sc.withColumn("cv", cv).drop(*values)


def state_embeddings_from_text(names: DataFrame, encode, state: str = "state", name: str = "name",
                               idx: str = "idx") -> DataFrame:
    """One unit vector per state from its canonical text
    ``state [SEP] name``; ``encode(df, text_col)`` adds ``embedding``."""
    t = names.select(F.col(idx).cast("int").alias("state_idx"),
                     F.concat_ws(" [SEP] ", F.col(state), F.col(name)).alias("_text"))
    return encode(t, "_text").select("state_idx", F.col("embedding").alias("emb"))


def candidate_features(cands: DataFrame, comp, state_emb: DataFrame, years: DataFrame) -> DataFrame:
    """C10 + J2-J7: one row per (row, candidate) with the 15 features.
    ``years`` has each entity's first and last year over all its transitions
    (none: the rows have them as ``_fy`` and ``_ly``).

    Everything per row (temporal features, current state) is joined before
    the explode, on rows, not on rows x K; the candidate's component values
    come with the list (``cv``), so no n-long array travels with the
    exploded rows; the cosine is computed once per
    distinct (current, candidate) state pair, at most n x n rows, and joined
    back as one number."""
    sp = comp.space.select("state", "idx")
    rows = (transitions.temporal_features(cands, bounds=years)
                 .join(sp.select(F.col("idx").alias("cur_idx"), F.col("state").alias("_cs")), "cur_idx"))
    x = rows.select(*ROW, "cur_idx", "nxt_idx", "true_pos", "_cs", "rr_years_since_first", "rr_career_span",
                    "rr_n_prior_trans", "rr_transition_velocity", F.posexplode("cv").alias("rank", "_c"))
    x = x.select("*", "_c.*").drop("_c")
    incoming = comp.glob.select(F.posexplode("p").alias("cand_idx", "_p")) \
        .groupBy("cand_idx").agg(F.avg("_p").alias("_in"))
    pairs = cands.select("cur_idx", F.explode("cands").alias("cand_idx")).distinct()
    ce = state_emb.select(F.col("state_idx").alias("cur_idx"), F.col("emb").alias("_ce"))
    ke = state_emb.select(F.col("state_idx").alias("cand_idx"), F.col("emb").alias("_ke"))
    cos = (pairs.join(ce, "cur_idx", "left").join(ke, "cand_idx", "left")
                .select("cur_idx", "cand_idx", dot("_ce", "_ke").alias("_cos")))
    # one row per state, or per pair of states: broadcast, or every candidate row would be shuffled
    x = (x.join(F.broadcast(sp.select(F.col("idx").alias("cand_idx"), F.col("state").alias("_ks"))), "cand_idx")
          .join(F.broadcast(incoming), "cand_idx").join(F.broadcast(cos), ["cur_idx", "cand_idx"], "left"))
    feats = _features(F.col, F.col, F.col("_cs"), F.col("_ks"), F.col("_in"), F.col("_cos"))
    return x.select(*ROW, "cur_idx", "nxt_idx", "true_pos", "rank", "cand_idx",
                    *[v.alias(k) for k, v in feats.items()])


def _features(row, cand, cs: Column, ks: Column, incoming: Column, cos: Column) -> dict[str, Column]:
    """The 15 features of a candidate: ``row`` and ``cand`` get a value of the row and
    of the candidate by name; ``cs`` and ``ks`` are the current and the candidate's state."""
    def lg(v):
        return F.ln(v + F.lit(LOG_FLOOR))
    l1c, l1k = F.substring(cs, 1, 1), F.substring(ks, 1, 1)
    return {
        "f_cos": F.coalesce(cos, F.lit(0.0)),
        "f_log_global": lg(cand("_g")),
        "f_log_recency": lg(cand("_r")),
        "f_log_second": lg(cand("_sv")),
        "f_hist": cand("_h"),
        **temporal(row),
        "f_same_l1": (l1c == l1k).cast("double"),
        "f_same_l2": (F.substring(cs, 1, 2) == F.substring(ks, 1, 2)).cast("double"),
        "f_direction": F.coalesce((l1k.try_cast("int") - l1c.try_cast("int")) / 9.0, F.lit(0.0)),
        "f_self": (row("cur_idx") == cand("cand_idx")).cast("double"),
        "f_log_incoming": lg(incoming),
        "f_ensemble": cand("_p"),
    }


def temporal(row=F.col) -> dict[str, Column]:
    """The features that are the same for all candidates of a row."""
    return {
        "f_ysf": F.least(F.coalesce(row("rr_years_since_first"), F.lit(0.0)), F.lit(40.0)) / 40.0,
        "f_span": F.least(F.coalesce(row("rr_career_span"), F.lit(0.0)), F.lit(40.0)) / 40.0,
        "f_npt": F.log1p(F.coalesce(row("rr_n_prior_trans"), F.lit(0.0))),
        "f_vel": F.least(F.coalesce(row("rr_transition_velocity"), F.lit(0.0)), F.lit(10.0)) / 10.0,
    }


def feature_lists(cands: DataFrame, comp, state_emb: DataFrame) -> DataFrame:
    """The features of ``candidate_features`` with a row's candidates kept together:
    ``feats``, an array of (rank, cand_idx, features) in ensemble order. Nothing is
    shuffled: what belongs to a state or a pair of states is looked up in
    broadcast arrays. The rows have their temporal values (``temporal_features``)."""
    states = comp.space.agg(F.array_sort(F.collect_list(F.struct("idx", "state"))).alias("_s")) \
        .select(F.col("_s.state").alias("_states"))
    mean = comp.glob.select(F.posexplode("p").alias("cand_idx", "_p")).groupBy("cand_idx").agg(F.avg("_p").alias("_in")) \
        .agg(F.array_sort(F.collect_list(F.struct("cand_idx", "_in"))).alias("_i")).select(F.col("_i._in").alias("_incoming"))
    ce = state_emb.select(F.col("state_idx").alias("cur_idx"), F.col("emb").alias("_ce"))
    ke = state_emb.select(F.col("state_idx").alias("cand_idx"), F.col("emb").alias("_ke"))
    pairs = cands.select("cur_idx", F.explode("cands").alias("cand_idx")).distinct()
    cos = pairs.join(ce, "cur_idx").join(ke, "cand_idx").groupBy("cur_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("cand_idx", dot("_ce", "_ke").alias("_c")))).alias("_cosines"))
    # one row, or one row per state: broadcast
    x = cands.crossJoin(F.broadcast(states)).crossJoin(F.broadcast(mean)).join(F.broadcast(cos), "cur_idx", "left")

    def one(c: Column, i: Column) -> Column:
        at = c["cand_idx"]
        f = _features(F.col, lambda name: c[name], F.get("_states", F.col("cur_idx")), F.get("_states", at),
                      F.get("_incoming", at), F.try_element_at("_cosines", at))
        return F.struct(i.alias("rank"), at.alias("cand_idx"), *[v.alias(k) for k, v in f.items()])
    return x.withColumn("feats", F.transform("cv", one)).drop("cv", "_states", "_incoming", "_cosines")


def linear_score(weights=FIXED_WEIGHTS, zero: set[int] | None = None, col=F.col) -> Column:
    zero = zero or set()
    terms = [F.lit(float(w)) * col(f) for i, (w, f) in enumerate(zip(weights, FEATURES))
             if i not in zero and w != 0.0]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def rerank(feats: DataFrame, score) -> DataFrame:
    """Candidates of each row ordered by score (ties: ensemble rank). Of
    ``feature_lists``, each row's list is put in order where it is (``ranked``), and
    ``score`` makes the score from a function that gets a feature by name. Of ``listwise.context_lists``,
    ``score`` is a ``listwise.Scorer``, and each list is scored once for all its rows (``order``)."""
    if "self_at" in feats.columns:
        from trailmark.operators import listwise
        return listwise.ranked(feats, score)
    if "feats" in feats.columns:
        made = F.transform("feats", lambda f: F.struct((-round_to(score(lambda name: f[name]), SCORE_DIGITS)).alias("_s"),
                                                       f["rank"].alias("rank"), f["cand_idx"].alias("cand_idx")))
        return feats.withColumn("ranked", F.transform(F.array_sort(made), lambda c, i: F.struct(
            (-c["_s"]).alias("score"), i.alias("new_rank"), c["rank"].alias("rank"), c["cand_idx"].alias("cand_idx"))))
    w = Window.partitionBy(*ROW).orderBy(F.col("_s").desc(), F.col("rank"))
    return (feats.withColumn("_s", round_to(score, SCORE_DIGITS))
                 .withColumn("new_rank", (F.row_number().over(w) - 1).cast("int"))
                 .withColumnRenamed("_s", "score"))


def rerank_eval(ranked: DataFrame) -> DataFrame:
    """J11 + J15: hit rate at 1, 3, 5 of the ensemble order and of the
    reranked order, comparing states; candidate recall. One row per ranking."""
    if "order" in ranked.columns:
        new = (F.array_position("order", F.col("truth")) - 1).cast("int")
        t, n = ranked.select("n", "truth", F.when(F.col("truth") >= 0, new).alias("new")), F.sum("n")
        both = [F.struct(F.lit(name).alias("ranking"), *[(F.coalesce(F.sum(F.when((F.col("truth") >= 0) & (F.col(pos) < k), F.col("n"))), F.lit(0)) / n).alias(f"top_{k}")
                                                         for k in (1, 3, 5)],
                         (F.coalesce(F.sum(F.when(F.col("truth") >= 0, F.col("n"))), F.lit(0)) / n).alias("candidate_recall")) for name, pos in (("ensemble", "truth"), ("rerank", "new"))]
        return t.agg(F.array(*both).alias("e")).select(F.inline("e"))
    if "ranked" in ranked.columns:
        hit = F.element_at(F.filter("ranked", lambda c: c["cand_idx"] == F.col("nxt_idx")), 1)
        t = ranked.filter(F.size("ranked") > 0).select(F.when(F.exists("ranked", lambda c: c["cand_idx"] == F.col("nxt_idx")), hit).alias("t"))
        n = F.count(F.lit(1))
        both = [F.struct(F.lit(name).alias("ranking"), *[(F.count_if(F.col(f"t.{pos}") < k) / n).alias(f"top_{k}") for k in (1, 3, 5)],
                         (F.count("t") / n).alias("candidate_recall")) for name, pos in (("ensemble", "rank"), ("rerank", "new_rank"))]
        return t.agg(F.array(*both).alias("e")).select(F.inline("e"))
    t = ranked.filter(F.col("cand_idx") == F.col("nxt_idx"))
    n = ranked.select(*ROW).distinct().agg(F.count(F.lit(1))).scalar()

    def row(name, pos):
        return t.agg(F.lit(name).alias("ranking"),
                     *[(F.count_if(F.col(pos) < k) / n).alias(f"top_{k}") for k in (1, 3, 5)],
                     (F.count(F.lit(1)) / n).alias("candidate_recall"))
    return row("ensemble", "rank").unionByName(row("rerank", "new_rank"))


def ablation(feats: DataFrame, weights=FIXED_WEIGHTS) -> DataFrame:
    """Top-1 with each feature group zeroed, against all features.
    All 11 scores are columns of the candidate row; one aggregate per row
    picks each top candidate (ties to the ensemble rank)."""
    groups = list(FEATURE_GROUPS.items())
    x = feats.withColumn("_t", (F.col("cand_idx") == F.col("nxt_idx")).cast("int"))

    def top(zero=None):
        # (score, -rank, hit) as one number: sums of hash aggregates, where a struct would be sorted
        units = F.floor(linear_score(weights, zero) * F.lit(float(10 ** SCORE_DIGITS)) + 0.5).cast("long")
        return F.max((units * MAX_LIST + (MAX_LIST - 1 - F.col("rank"))) * 2 + F.col("_t"))
    per = x.groupBy(*ROW).agg(top().alias("all"), *[top(set(idxs)).alias(f"g{gi}") for gi, (_, idxs) in enumerate(groups)])
    per = per.select(*[F.pmod(c, F.lit(2)).alias(c) for c in ["all", *[f"g{gi}" for gi in range(len(groups))]]])
    tot = per.agg(F.count(F.lit(1)).alias("n"), F.sum("all").alias("h_all"),
                  *[F.sum(f"g{gi}").alias(f"h{gi}") for gi in range(len(groups))])
    rows = F.array(*[F.struct(F.lit(name).alias("feature_group"), F.col(f"h{gi}").alias("h"))
                     for gi, (name, _) in enumerate(groups)])
    e = tot.select("n", "h_all", F.inline(rows))
    return e.select("feature_group",
                    (F.col("h_all") / F.col("n")).alias("top1_with_all"),
                    (F.col("h") / F.col("n")).alias("top1_zeroed_out"),
                    ((F.col("h_all") - F.col("h")) / F.col("n")).alias("top1_drop"))


def win_margin(ranked: DataFrame) -> DataFrame:
    """Softmax of the row's scores; winning probability and its margin
    over the second. Per row."""
    w = Window.partitionBy(*ROW)
    x = ranked.withColumn("_e", F.exp(F.col("score") - F.max("score").over(w)))
    x = x.withColumn("_p", F.col("_e") / F.sum("_e").over(w))
    per = x.groupBy(*ROW).agg(F.max(F.when(F.col("new_rank") == 0, F.col("_p"))).alias("win_prob"),
                              F.max(F.when(F.col("new_rank") == 1, F.col("_p"))).alias("second_prob"))
    return per.select(*ROW, "win_prob", (F.col("win_prob") - F.coalesce("second_prob", F.lit(0.0)))
                      .alias("margin"))


def group_importance(coef) -> list[tuple[str, float]]:
    """J14 for a linear scorer: mean |coefficient| per group, normalised to 1."""
    vals = {g: sum(abs(coef[i]) for i in idx) / len(idx) for g, idx in FEATURE_GROUPS.items()}
    tot = sum(vals.values()) or 1.0
    return [(g, v / tot) for g, v in vals.items()]


def improvement(evaluated: DataFrame) -> DataFrame:
    """J11 + J15: hit rate before and after reranking and the gain in points."""
    at = lambda r, c: F.max(F.when(F.col("ranking") == r, F.col(c)))
    one = evaluated.agg(*[at(r, c).alias(f"{r}_{c}") for r in ("ensemble", "rerank") for c in ("top_1", "top_3", "top_5")])
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"ensemble_{c}").alias("before"), F.col(f"rerank_{c}").alias("after"))
                     for c in ("top_1", "top_3", "top_5")])
    return one.select(F.inline(rows)).withColumn("points", (F.col("after") - F.col("before")) * 100.0)


def ablation_report(ablated: DataFrame) -> DataFrame:
    """The ablation with the relative drop in percent, ordered by drop (one
    row per feature group)."""
    w = Window.orderBy(F.col("top1_drop").desc(), F.col("feature_group"))
    rel = F.when(F.col("top1_with_all") > 0, F.col("top1_drop") / F.col("top1_with_all") * 100.0)
    return ablated.withColumn("relative_drop_pct", rel).withColumn("rank", F.row_number().over(w))


def margin_summary(margins: DataFrame) -> DataFrame:
    """Mean and median winning probability and mean margin."""
    return margins.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("win_prob").alias("mean_win_prob"),
                       F.avg("margin").alias("mean_margin")).join(
        exact_quantiles(margins, "win_prob", [0.5], ["median_win_prob"]))
