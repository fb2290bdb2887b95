"""Markov transition models (G1-G8) and the year windows.

A matrix is a DataFrame with one row per current state (plus any key such as
a window or a segment): ``cur_idx`` and ``p``, an ``array<double>`` indexed
by the next state's ``idx`` in the state space. Rows come from pair counts
(a partial + final hash aggregate), each row's non-zero cells are gathered
into a map of at most n entries, and the dense array is written by a
``transform`` over ``sequence(0, n-1)``: no grid join, no Python.

``n`` and the training maximum year enter as scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE_SMOOTHING = 0.01
RECENCY_DECAY = 0.12
HISTORY_DECAY = 0.15
WINDOW_SIZE = 10
MIN_CONTEXT = 5
MIN_HISTORY_WEIGHT = 2.0
MIN_SEGMENT_ROWS = 50
BOOST_CLIP = (0.5, 2.0)


def n_states(space: DataFrame) -> Column:
    """Size of the state space as a literal. The space is a small dimension
    (one row per state), so counting it once is one tiny job and lets every
    plan fold ``n`` as a constant instead of re-running a subquery."""
    n = getattr(space, "_trailmark_n", None)
    if n is None:
        n = space.count()
        try:
            space._trailmark_n = n
        except AttributeError:
            pass
    return F.lit(int(n))


def _idx(space: DataFrame, name: str, idx_name: str) -> DataFrame:
    return space.select(F.col("state").alias(name), F.col("idx").alias(idx_name))


def indexed_counts(transitions: DataFrame, space: DataFrame, keys: Sequence[str] = (),
                   weight: Column | None = None, cur: str = "cur", nxt: str = "nxt") -> DataFrame:
    """E1/E2 with state indices: (keys..., cur_idx, nxt_idx, v). States outside
    the space drop (inner joins with the space, C5)."""
    if weight is not None:
        # Project first: a scalar subquery may not sit inside an aggregate.
        transitions = transitions.withColumn("_w", weight)
    v = F.count(F.lit(1)).cast("double") if weight is None else F.sum("_w").cast("double")
    c = transitions.groupBy(*keys, F.col(cur).alias("cur"), F.col(nxt).alias("nxt")).agg(v.alias("v"))
    return (c.join(_idx(space, "cur", "cur_idx"), "cur")
             .join(_idx(space, "nxt", "nxt_idx"), "nxt")
             .select(*keys, "cur_idx", "nxt_idx", "v"))


def _apply_self_mult(counts: DataFrame, rates: DataFrame) -> DataFrame:
    m = rates.select(F.col("idx").alias("cur_idx"), "mult")
    return (counts.join(m, "cur_idx", "left")
                  .withColumn("v", F.when(F.col("cur_idx") == F.col("nxt_idx"),
                                          F.col("v") * F.coalesce(F.col("mult"), F.lit(1.0)))
                              .otherwise(F.col("v")))
                  .drop("mult"))


def _gather_rows(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (keys, cur_idx): map nxt_idx -> v (at most n entries) and the row sum."""
    return counts.groupBy(*keys, "cur_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("nxt_idx", "v"))).alias("m"),
        F.sum("v").alias("row_sum"),
        F.count(F.lit(1)).alias("nnz"))


def _all_rows(space: DataFrame, key_dim: DataFrame | None, n: Column) -> DataFrame:
    """Every (key, cur_idx) row of a matrix family; the key dimension is
    expanded with ``explode(sequence(0, n-1))`` (no grid join)."""
    if key_dim is None:
        return space.select(F.col("idx").alias("cur_idx"))
    return key_dim.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("cur_idx"))


def _dense(m: Column, total: Column, sv: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1),
                       lambda i: (F.coalesce(F.try_element_at(m, i), F.lit(0.0)) + sv)
                       / (total + n * sv))


def row_tier_smoothing(row_sum: Column) -> Column:
    """G1 per-row additive smoothing: row sum < 10 -> 0.50, < 100 -> 0.10,
    else 0.01."""
    return (F.when(row_sum < 10, F.lit(0.50)).when(row_sum < 100, F.lit(0.10))
             .otherwise(F.lit(BASE_SMOOTHING)))


def sparsity_smoothing(zero_share: Column) -> Column:
    """G3 per-matrix smoothing by the share of zero cells: > 70% -> 0.5,
    > 30% -> 0.1, else 0.01."""
    return (F.when(zero_share > 0.70, F.lit(0.5)).when(zero_share > 0.30, F.lit(0.1))
             .otherwise(F.lit(BASE_SMOOTHING)))


def transition_matrix(transitions: DataFrame, space: DataFrame, rates: DataFrame | None = None,
                      keys: Sequence[str] = (), key_dim: DataFrame | None = None,
                      weight: Column | None = None, smoothing: str = "row") -> DataFrame:
    """G1 (and G2 with ``weight``, G3 with ``smoothing='sparsity'``, G8 with a
    segment key): counts, diagonal times the self-loop multiplier, additive
    smoothing, row-normalised. Returns (keys..., cur_idx, p)."""
    keys = list(keys)
    n = n_states(space)
    c = indexed_counts(transitions, space, keys, weight)
    if rates is not None:
        c = _apply_self_mult(c, rates)
    rows = _gather_rows(c, keys)
    if keys and key_dim is None:
        key_dim = c.select(*keys).distinct()
    full = (_all_rows(space, key_dim, n).join(rows, [*keys, "cur_idx"], "left")
            .withColumn("_n", n))
    n = F.col("_n")
    total = F.coalesce(F.col("row_sum"), F.lit(0.0))
    if smoothing == "row":
        sv = row_tier_smoothing(total)
    else:
        nnz = F.coalesce(F.sum("nnz").over(Window.partitionBy(*keys)), F.lit(0)) if keys else \
            F.coalesce(F.sum("nnz").over(Window.partitionBy()), F.lit(0))
        zero_share = F.lit(1.0) - nnz / (n * n).cast("double")
        full = full.withColumn("_sv", sparsity_smoothing(zero_share))
        sv = F.col("_sv")
    return full.select(*keys, "cur_idx", _dense(F.col("m"), total, sv, n).alias("p"))


def long_form(matrix: DataFrame, space: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The dense grid (keys..., cur, nxt, p) from the array rows."""
    keys = list(keys)
    cells = matrix.select(*keys, "cur_idx", F.posexplode("p").alias("nxt_idx", "p"))
    return (cells.join(_idx(space, "cur", "cur_idx"), "cur_idx")
                 .join(_idx(space, "nxt", "nxt_idx"), "nxt_idx")
                 .select(*keys, "cur", "nxt", "p"))


def max_year(transitions: DataFrame, yr: str = "yr") -> Column:
    return transitions.agg(F.max(yr)).scalar()


def recency_weight(transitions: DataFrame, decay: float = RECENCY_DECAY, yr: str = "yr") -> Column:
    """exp(decay * (year - max year)), max over the same frame."""
    return F.exp(F.lit(decay) * (F.col(yr) - max_year(transitions, yr)))


def recency_matrix(transitions: DataFrame, space: DataFrame, rates: DataFrame | None = None,
                   decay: float = RECENCY_DECAY) -> DataFrame:
    """G2."""
    return transition_matrix(transitions, space, rates, weight=recency_weight(transitions, decay))


def year_windows(transitions: DataFrame, size: int = WINDOW_SIZE, yr: str = "yr") -> DataFrame:
    """windows of ``size`` distinct years (not calendar decades): the
    sorted distinct years cut every ``size``; bounds are the first and last
    member. Returns (win, win_label, start_year, end_year). The distinct-year
    table is tiny (years were range-filtered), so a global window is fine."""
    ys = transitions.select(F.col(yr).alias("y")).distinct()
    b = ys.withColumn("win", F.floor((F.dense_rank().over(Window.orderBy("y")) - 1) / size)
                      .cast("int"))
    w = b.groupBy("win").agg(F.min("y").alias("start_year"), F.max("y").alias("end_year"))
    return w.select("win", F.concat_ws("-", F.col("start_year").cast("string"),
                                       F.col("end_year").cast("string")).alias("win_label"),
                    "start_year", "end_year")


def assign_window(df: DataFrame, windows: DataFrame, yr: str = "yr") -> DataFrame:
    """Year -> window with start <= year <= end, else 'global' (win -1).
    Windows do not overlap, so the range lookup becomes an equi-join on a
    year -> window table (one row per year inside a window: at most 75, as
    years were filtered to 1950..2024), broadcast: one hash probe per row
    instead of a nested-loop check against every window."""
    years = windows.select("win", "win_label", F.explode(F.sequence("start_year", "end_year")).alias("_wy"))
    j = df.join(F.broadcast(years), F.col(yr) == F.col("_wy"), "left")
    return (j.withColumn("win_key", F.coalesce(F.col("win_label"), F.lit("global")))
             .withColumn("win", F.coalesce(F.col("win"), F.lit(-1)))
             .drop("win_label", "_wy"))


def window_matrices(transitions: DataFrame, space: DataFrame, rates: DataFrame | None,
                    windows: DataFrame) -> DataFrame:
    """One matrix per year window with the sparsity smoothing.
    Returns (win, cur_idx, p)."""
    t = assign_window(transitions, windows).filter(F.col("win") >= 0)
    return transition_matrix(t, space, rates, keys=["win"],
                             key_dim=windows.select("win"), smoothing="sparsity")


def market_drift(wm: DataFrame, windows: DataFrame) -> DataFrame:
    """G4 (C9 + E15): Frobenius distance between consecutive window matrices,
    labelled by the later window."""
    a = wm.select(F.col("win"), "cur_idx", F.col("p").alias("pa"))
    b = wm.select((F.col("win") + 1).alias("win"), "cur_idx", F.col("p").alias("pb"))
    sq = F.aggregate(F.zip_with("pa", "pb", lambda x, y: (x - y) * (x - y)),
                     F.lit(0.0), lambda acc, v: acc + v)
    d = a.join(b, ["win", "cur_idx"]).groupBy("win").agg(F.sqrt(F.sum(sq)).alias("drift"))
    return d.join(windows.select("win", "win_label"), "win").select("win", "win_label", "drift")


def second_order(transitions: DataFrame, space: DataFrame, rates: DataFrame | None = None,
                 min_count: int = MIN_CONTEXT) -> DataFrame:
    """Contexts (prev, cur) with at least ``min_count`` rows; vector
    0.01 + count, the entry of the current state times its multiplier,
    normalised. Returns (prev_idx, cur_idx, n_context, p). Contexts below the
    minimum back off to the global row at lookup time."""
    n = n_states(space)
    t = transitions.filter(F.col("prev").isNotNull())
    t = t.join(_idx(space, "prev", "prev_idx"), "prev")  # prev must be a known state
    c = indexed_counts(t, space, ["prev_idx"])
    rows = c.groupBy("prev_idx", "cur_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("nxt_idx", "v"))).alias("m"),
        F.sum("v").alias("n_context"))
    rows = rows.filter(F.col("n_context") >= min_count).withColumn("_n", n)
    n = F.col("_n")
    if rates is not None:
        rows = rows.join(rates.select(F.col("idx").alias("cur_idx"), "mult"), "cur_idx", "left")
        mult = F.coalesce(F.col("mult"), F.lit(1.0))
    else:
        mult = F.lit(1.0)
    base = F.lit(BASE_SMOOTHING)
    vec = F.transform(F.sequence(F.lit(0), n - 1),
                      lambda i: (F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)) + base)
                      * F.when(i == F.col("cur_idx"), mult).otherwise(F.lit(1.0)))
    return (rows.withColumn("_vec", vec)
                .withColumn("_tot", F.aggregate(F.col("_vec"), F.lit(0.0), lambda acc, v: acc + v))
                .select("prev_idx", "cur_idx", F.col("n_context").cast("bigint").alias("n_context"),
                        F.transform("_vec", lambda x: x / F.col("_tot")).alias("p")))


def history_prior(transitions: DataFrame, space: DataFrame, *, entity: str = "person_id",
                  decay: float = HISTORY_DECAY, min_weight: float = MIN_HISTORY_WEIGHT) -> DataFrame:
    """G6, sparse: per (entity, state) decayed weight; entities whose total
    weight >= ``min_weight``. p(state) = (0.01 + w) / (0.01 n + total), and
    ``p_default`` = 0.01 / (0.01 n + total) for states the entity never had.
    Returns (entity, state_idx, w, total, p, p_default); no dense
    entities x states table."""
    n = n_states(space)
    wgt = F.exp(F.lit(decay) * (F.col("yr") - max_year(transitions)))
    uw = (transitions.withColumn("_w", wgt)
                     .groupBy(entity, F.col("cur").alias("state")).agg(F.sum("_w").alias("w"))
                     .join(_idx(space, "state", "state_idx"), "state"))
    tot = F.sum("w").over(Window.partitionBy(entity))
    out = uw.withColumn("total", tot).filter(F.col("total") >= min_weight)
    den = F.lit(BASE_SMOOTHING) * n + F.col("total")
    return out.select(entity, "state_idx", "w", "total",
                      ((F.lit(BASE_SMOOTHING) + F.col("w")) / den).alias("p"),
                      (F.lit(BASE_SMOOTHING) / den).alias("p_default"))


def history_maps(prior: DataFrame, entity: str = "person_id") -> DataFrame:
    """(entity, m, d): the prior of each entity as a map of its states, and of the others."""
    return prior.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct("state_idx", "p"))).alias("m"),
                                     F.first("p_default").alias("d"))


def dense_history(m: str, d: str, n: Column) -> Column:
    """The array of ``n`` states of one row of ``history_maps``."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at(F.col(m), i), F.col(d)))


def history_arrays(prior: DataFrame, space: DataFrame, entity: str = "person_id") -> DataFrame:
    """Dense prior arrays for the entities that need one (entity, p)."""
    g = history_maps(prior, entity).withColumn("_n", n_states(space))
    return g.select(entity, dense_history("m", "d", F.col("_n")).alias("p"))


def attribute_boost(transitions: DataFrame, space: DataFrame, flag: str = "univ_flag") -> DataFrame:
    """Per next state, clip(P(next | flag) / P(next), 0.5, 2) with 0.01
    additive smoothing, for flag true and false; all ones when the flag never
    holds. Returns (flag_value, p) with p an array over the state space."""
    n = n_states(space)
    lo, hi = BOOST_CLIP
    f = F.col(flag)
    per = transitions.groupBy(F.col("nxt").alias("state")).agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(f).alias("n_t"), F.count_if(~f).alias("n_f"))
    tot = transitions.agg(F.count(F.lit(1)).alias("ta"), F.count_if(f).alias("tt"),
                          F.count_if(~f).alias("tf"))
    ta, tt, tf = [tot.select(c).scalar() for c in ("ta", "tt", "tf")]
    s = BASE_SMOOTHING
    cells = space.join(per, "state", "left").fillna(0, ["n_all", "n_t", "n_f"])
    pa = (F.col("n_all") + s) / (ta + n * s)
    pt = (F.col("n_t") + s) / (tt + n * s)
    pf = (F.col("n_f") + s) / (tf + n * s)
    any_true = tt > 0
    bt = F.when(any_true, F.least(F.greatest(pt / pa, F.lit(lo)), F.lit(hi))).otherwise(F.lit(1.0))
    bf = F.when(any_true, F.least(F.greatest(pf / pa, F.lit(lo)), F.lit(hi))).otherwise(F.lit(1.0))
    cells = cells.select("idx", bt.alias("bt"), bf.alias("bf"))
    g = cells.agg(F.map_from_entries(F.collect_list(F.struct("idx", "bt"))).alias("mt"),
                  F.map_from_entries(F.collect_list(F.struct("idx", "bf"))).alias("mf"))
    g = g.withColumn("_n", n)
    seq = F.sequence(F.lit(0), F.col("_n") - 1)
    return g.select(F.inline(F.array(
        F.struct(F.lit(True).alias("flag_value"),
                 F.transform(seq, lambda i: F.try_element_at(F.col("mt"), i)).alias("p")),
        F.struct(F.lit(False).alias("flag_value"),
                 F.transform(seq, lambda i: F.try_element_at(F.col("mf"), i)).alias("p")))))


def segment_matrices(transitions: DataFrame, space: DataFrame, rates: DataFrame | None,
                     global_matrix: DataFrame, segment: str = "archetype",
                     min_rows: int = MIN_SEGMENT_ROWS) -> DataFrame:
    """One matrix per segment; segments with fewer than ``min_rows``
    transitions use the global matrix. Returns (segment, cur_idx, p)."""
    sizes = transitions.groupBy(segment).agg(F.count(F.lit(1)).alias("_n"))
    big = sizes.filter(F.col("_n") >= min_rows).select(segment)
    small = sizes.filter(F.col("_n") < min_rows).select(segment)
    own = transition_matrix(transitions.join(big, segment, "left_semi"), space, rates,
                            keys=[segment], key_dim=big)
    # Segments are few (one per cluster); the small ones are handed to the
    # global rows as an exploded list, not joined.
    small_list = small.agg(F.collect_list(segment)).scalar()
    fallback = global_matrix.select(F.explode(small_list).alias(segment), "cur_idx", "p")
    return own.unionByName(fallback)
