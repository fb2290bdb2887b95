"""Next-state ensemble.

Scoring works on **distinct contexts**, not rows: the score of a transition
depends only on (current state, year window, segment, flag, previous state,
entity prior), so evaluation rows are grouped into contexts with their
next-state counts (a map of at most n entries) and every context carries its
component rows as arrays. Weight tuning expands each context by the fixed
59-combination grid (a bounded explode), takes the argmax per combination
and sums hits per (state, combination): no row-level loop and no shuffle
before the hit sum.
"""

from __future__ import annotations

import itertools
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.exprs import round_to
from trailmark.operators import drift, markov, segments
from trailmark.operators.sequence import ordered_sequence

DEFAULT_SEGMENT = drift.DEFAULT_ARCHETYPE

# The weight grid (history, second order, segment), the base
# mix, the floor of the remaining weight and the tuning limits.
W_HIST = (0.10, 0.20, 0.30, 0.40, 0.50)
W_SO = (0.00, 0.10, 0.20, 0.30)
W_ARCH = (0.05, 0.10, 0.20)
BASE_MIX = (0.60, 0.40)          # recency, window
REST_FLOOR = 0.05
MIN_TUNE_ROWS = 15
SPLIT_CUTS = (0.64, 0.80)
TOP_K = (1, 3, 5)
RANK_DIGITS = 12
KERNEL_CHUNK = 512               # contexts per tensor product in the tuning kernel


def default_weights(rate: Column) -> Column:
    """Weights by self rate: > 0.25 -> (0.30, 0.10, 0.10); < 0.10 ->
    (0.20, 0.30, 0.10); else (0.20, 0.20, 0.10)."""
    def s(h, so, a):
        return F.struct(F.lit(h).alias("w_hist"), F.lit(so).alias("w_so"), F.lit(a).alias("w_arch"))
    return F.when(rate > 0.25, s(0.30, 0.10, 0.10)).when(rate < 0.10, s(0.20, 0.30, 0.10)) \
            .otherwise(s(0.20, 0.20, 0.10))


def weight_grid() -> list[tuple[int, float, float, float, float]]:
    """(combo_id, w_hist, w_so, w_arch, w_rest) in grid order; combinations
    leaving less than 0.05 for the base are skipped (59 of 60)."""
    out = []
    for wh, ws, wa in itertools.product(W_HIST, W_SO, W_ARCH):
        if 1.0 - wh - ws - wa < REST_FLOOR:
            continue
        out.append((len(out), wh, ws, wa, max(REST_FLOOR, 1.0 - wh - ws - wa)))
    return out


def hash_rank_key(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))


def stratified_split(events: DataFrame, seed: int = 42, cuts=SPLIT_CUTS, entity: str = "person_id",
                     state: str = "state") -> DataFrame:
    """Entities stratified by dominant state; inside a stratum ranked by
    md5(entity|seed) (reproducible, the same in any engine); cut at
    floor(n * 0.64) and floor(n * 0.80). The rank is skew-safe: a stratum
    holding most entities is split over many tasks."""
    dom = drift.dominant_state(events, entity, state, "dominant")
    keyed = dom.withColumn("_h", hash_rank_key(seed, entity))
    ranked = ordered_sequence(keyed, ["dominant"], ["_h", entity], position="_rank")
    sizes = dom.groupBy("dominant").agg(F.count(F.lit(1)).alias("_n"))
    a, b = cuts
    j = ranked.join(sizes, "dominant")
    split = (F.when(F.col("_rank") < F.floor(F.col("_n") * a), F.lit("train"))
              .when(F.col("_rank") < F.floor(F.col("_n") * b), F.lit("val"))
              .otherwise(F.lit("test")))
    return j.select(entity, "dominant", split.alias("split"))


def capped_sample(df: DataFrame, group: str, cap: int, seed: int, key: list[str]) -> DataFrame:
    """At most ``cap`` rows per group, chosen by the md5 rank of the row
    key (deterministic); groups at or under the cap keep every row."""
    keyed = df.withColumn("_h", hash_rank_key(seed, *key))
    ranked = ordered_sequence(keyed, [group], ["_h", *key], position="_rank")
    return ranked.filter(F.col("_rank") < cap).drop("_h", "_rank")


def train_segments(train: DataFrame, space: DataFrame, glob: DataFrame, method: str = "quantile",
                   seed: int = 42, entity: str = "person_id", keep=None):
    """Segments of training entities from their drift under the training
    matrix (H1, H2 with length = transitions), then named by H4. ``quantile``
    segments are deterministic; ``kmeans`` runs H3."""
    lp = drift.transition_logprob(train, glob, space)
    risk = lp.groupBy(entity).agg(
        (-F.avg("log_prob")).alias("drift_score"),
        F.count(F.lit(1)).alias("seq_length"),
        F.avg(F.col("is_self").cast("double")).alias("self_loop_rate"))
    risk = risk.filter(F.col("seq_length") >= 2)
    if method == "kmeans":
        clustered = drift.cluster_drift(risk, k=5, entity=entity, seed=seed)
    else:
        clustered = segments.quantile_segments(risk)
    if keep is not None:
        clustered = keep("clustered", clustered)
    summary = drift.archetype_names(drift.cluster_summary(clustered))
    seg_map = clustered.join(summary.select("cluster", "archetype"), "cluster").select(entity, "archetype")
    return seg_map, summary


class Components:
    """All model pieces from the training transitions, each built when first
    used. ``keep(name, df)`` materialises a piece (a stage table or a
    checkpoint) so that the pieces built on it, and the scoring plans, start
    from a small scan; every piece is at most (keys x states) rows, except the
    sparse entity prior."""

    def __init__(self, train: DataFrame, space: DataFrame, rates: DataFrame, *, window_size: int = 10,
                 segment_method: str = "quantile", seed: int = 42, entity: str = "person_id", keep=None):
        self.train, self.space, self.rates = train, space, rates
        self.window_size, self.segment_method, self.seed, self.entity = window_size, segment_method, seed, entity
        self._keep = keep or (lambda name, build: build())

    @cached_property
    def glob(self) -> DataFrame:          # (cur_idx, p)
        return self._keep("glob", lambda: markov.transition_matrix(self.train, self.space, self.rates))

    @cached_property
    def rec(self) -> DataFrame:           # (cur_idx, p)
        return self._keep("rec", lambda: markov.recency_matrix(self.train, self.space, self.rates))

    @cached_property
    def windows(self) -> DataFrame:       # (win, win_label, start_year, end_year)
        return self._keep("windows", lambda: markov.year_windows(self.train, self.window_size))

    @cached_property
    def wm(self) -> DataFrame:            # (win, cur_idx, p)
        return self._keep("wm", lambda: markov.window_matrices(self.train, self.space, self.rates, self.windows))

    @cached_property
    def so(self) -> DataFrame:            # (prev_idx, cur_idx, n_context, p)
        return self._keep("so", lambda: markov.second_order(self.train, self.space, self.rates))

    @cached_property
    def prior(self) -> DataFrame:         # sparse (entity, state_idx, w, total, p, p_default)
        return self._keep("prior", lambda: markov.history_prior(self.train, self.space, entity=self.entity))

    @cached_property
    def boost(self) -> DataFrame:         # (flag_value, p)
        return self._keep("boost", lambda: markov.attribute_boost(self.train, self.space))

    @cached_property
    def _segments(self) -> tuple[DataFrame, DataFrame]:
        seg_map, summary = train_segments(self.train, self.space, self.glob, self.segment_method, self.seed, self.entity,
                                          lambda name, df: self._keep(name, lambda: df))
        return self._keep("seg_map", lambda: seg_map), self._keep("seg_summary", lambda: summary)

    @property
    def seg_map(self) -> DataFrame:       # (entity, archetype)
        return self._segments[0]

    @property
    def cluster_summary(self) -> DataFrame:
        return self._segments[1]

    @cached_property
    def seg(self) -> DataFrame:           # (archetype, cur_idx, p)
        def build():
            named = self.cluster_summary.select("archetype").distinct()
            rows = annotate_segment(self.train, self.seg_map, self.entity).join(named, "archetype", "left_semi")
            return markov.segment_matrices(rows, self.space, self.rates, self.glob, "archetype")
        return self._keep("seg", build)

    @cached_property
    def market(self) -> DataFrame:        # (win, win_label, drift)
        return self._keep("market", lambda: markov.market_drift(self.wm, self.windows))


def annotate_segment(df: DataFrame, seg_map: DataFrame, entity: str = "person_id") -> DataFrame:
    """Per-entity segment with the default for entities without one."""
    m = seg_map.select(entity, F.col("archetype").alias("_a"))
    return (df.join(m, entity, "left")
              .withColumn("archetype", F.coalesce(F.col("_a"), F.lit(DEFAULT_SEGMENT))).drop("_a"))


def annotate(df: DataFrame, comp: Components, entity: str = "person_id") -> DataFrame:
    """C2 + C6 + state indices: segment, window, cur/nxt/prev indices.
    Rows whose current or next state is outside the space drop (C5); an
    unknown previous state becomes null (no second-order context)."""
    sp = comp.space.select("state", "idx")
    out = annotate_segment(df, comp.seg_map, entity)
    out = markov.assign_window(out, comp.windows)
    out = (out.join(sp.select(F.col("state").alias("cur"), F.col("idx").alias("cur_idx")), "cur")
              .join(sp.select(F.col("state").alias("nxt"), F.col("idx").alias("nxt_idx")), "nxt")
              .join(sp.select(F.col("state").alias("prev"), F.col("idx").alias("prev_idx")), "prev", "left"))
    return out


CONTEXT_KEYS = ["cur_idx", "win", "archetype", "univ_flag", "prev_idx", "prior_entity"]


def contexts(annotated: DataFrame, comp: Components, entity: str = "person_id") -> DataFrame:
    """Distinct scoring contexts with next-state counts ``nxt_counts``
    (map nxt_idx -> rows) and ``n_rows``. The entity enters the key only when
    it has a prior of its own."""
    with_prior = comp.prior.select(entity).distinct().withColumn("_hp", F.lit(True))
    a = annotated.join(with_prior, entity, "left") \
                 .withColumn("prior_entity", F.when(F.col("_hp"), F.col(entity)))
    c = a.groupBy(*CONTEXT_KEYS, "nxt_idx").agg(F.count(F.lit(1)).alias("_c"))
    return c.groupBy(*CONTEXT_KEYS).agg(
        F.map_from_entries(F.collect_list(F.struct("nxt_idx", "_c"))).alias("nxt_counts"),
        F.sum("_c").alias("n_rows"))


def with_component_rows(ctx: DataFrame, comp: Components, entity: str = "person_id") -> DataFrame:
    """C8 back-off: each context gets its rows g (global), r (recency), d
    (window, else global), a (segment, else global), s (second order, else
    global), h (own prior, else global) and b (flag boost). Every component
    side is one row per key and small; AQE picks broadcast joins."""
    g = comp.glob.select("cur_idx", F.col("p").alias("g"))
    r = comp.rec.select("cur_idx", F.col("p").alias("r"))
    d = comp.wm.select("win", "cur_idx", F.col("p").alias("d"))
    a = comp.seg.select("archetype", "cur_idx", F.col("p").alias("a"))
    s = comp.so.select("prev_idx", "cur_idx", F.col("p").alias("s"))
    # dense priors only for the entities asked for (evaluation entities have none)
    asked = ctx.filter(F.col("prior_entity").isNotNull()).select(F.col("prior_entity").alias(entity)).distinct()
    h = markov.history_maps(comp.prior.join(asked, entity, "left_semi"), entity) \
        .select(F.col(entity).alias("_pe"), F.col("m").alias("_hm"), F.col("d").alias("_hd"), F.lit(0).alias("_ps"))
    # contexts without a prior of their own are spread over tasks, not met under the null key
    ctx = ctx.withColumn("_salt", F.when(F.col("prior_entity").isNull(), 1 + F.pmod(F.xxhash64("cur_idx", "win", "prev_idx"), F.lit(1024)))
                                   .otherwise(0).cast("int"))
    spread = F.coalesce(F.col("prior_entity"), F.lit(0))
    b = comp.boost.select(F.col("flag_value").alias("univ_flag"), F.col("p").alias("b"))
    # the priors meet the contexts as maps and before the arrays: this join is the one that shuffles
    ctx = ctx.join(h, (spread == F.col("_pe")) & (F.col("_salt") == F.col("_ps")), "left").drop("_pe", "_ps", "_salt") \
             .withColumn("_n", markov.n_states(comp.space))
    ctx = ctx.withColumn("h", F.when(F.col("_hd").isNotNull(), markov.dense_history("_hm", "_hd", F.col("_n")))).drop("_hm", "_hd", "_n")
    out = (ctx.join(g, "cur_idx").join(r, "cur_idx")
              .join(d, ["win", "cur_idx"], "left").join(a, ["archetype", "cur_idx"], "left")
              .join(s, ["prev_idx", "cur_idx"], "left")
              .join(b, "univ_flag", "left"))
    return (out.withColumn("d", F.coalesce("d", "g")).withColumn("a", F.coalesce("a", "g"))
               .withColumn("s", F.coalesce("s", "g")).withColumn("h", F.coalesce("h", "g")))


class Arrays:
    """The component rows of ``with_component_rows`` and the weights of each state as numpy
    arrays, for kernels that look a row's components up instead of joining n-long arrays to it. They grow with
    the states (a matrix per window and segment, a row per second-order context), not with
    the data. What has no row of its own has the global one (C8)."""

    def __init__(self, comp: Components, weights: DataFrame):
        n = self.n = comp.space.count()
        own = np.arange(n)
        self.rows, self._next = [np.zeros((n, n))], n
        for r in comp.glob.collect():
            self.rows[0][r["cur_idx"]] = r["p"]
        self.r = self._places(comp.rec.select(F.lit(0).alias("key"), "cur_idx", "p"), {0: 0}, own)[0]
        self.windows = {r["win"]: i for i, r in enumerate(comp.windows.select("win").distinct().orderBy("win").collect())}
        self.d = self._places(comp.wm.select(F.col("win").alias("key"), "cur_idx", "p"), self.windows, own)
        self.segments = {r["archetype"]: i for i, r in enumerate(comp.seg.select("archetype").distinct().orderBy("archetype").collect())}
        self.a = self._places(comp.seg.select(F.col("archetype").alias("key"), "cur_idx", "p"), self.segments, own)
        self.s = self._places(comp.so.select(F.col("prev_idx").alias("key"), "cur_idx", "p"), {i: i for i in range(n)}, own)
        self.rows = np.concatenate(self.rows)
        # flag false, true, unknown
        self.b = np.ones((3, n))
        for r in comp.boost.collect():
            self.b[int(r["flag_value"])] = [1.0 if v is None else v for v in r["p"]]
        self.w = np.tile(np.array([[0.20], [0.20], [0.10]]), n)
        for r in weights.select("cur_idx", "w_hist", "w_so", "w_arch").collect():
            at = r["cur_idx"]
            self.w[:, at] = [old if v is None else v for v, old in zip(r[1:], self.w[:, at], strict=True)]

    def _places(self, matrix: DataFrame, keys: dict, own: np.ndarray) -> np.ndarray:
        """(keys + 1, n) places in ``rows``, the matrix's rows added there; the last is that of no known key."""
        places = np.tile(own, (len(keys) + 1, 1))
        for r in matrix.collect():
            if r["key"] in keys:
                places[keys[r["key"]], r["cur_idx"]] = self._next
                self.rows.append(np.array([r["p"]]))
                self._next += 1
        return places

    def components(self, b: pa.RecordBatch) -> dict[str, np.ndarray]:
        """Places of the components of each row of a batch with the columns of CONTEXT_KEYS (but the entity)."""
        cur = b.column("cur_idx").to_numpy()
        win, segment = (_codes(b.column(c), keys) for c, keys in (("win", self.windows), ("archetype", self.segments)))
        prev = b.column("prev_idx").fill_null(self.n).to_numpy()
        flag = b.column("univ_flag").cast(pa.int8()).fill_null(2).to_numpy()
        return {"cur": cur, "flag": flag, "g": cur, "r": self.r[cur], "d": self.d[win, cur], "a": self.a[segment, cur], "s": self.s[prev, cur]}

    def prob(self, at: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
        """``ensemble_prob`` normalised, (rows, n): the same operations in the same order."""
        wh, ws, wa = (w[at["cur"], None] for w in self.w)
        w_rest = np.maximum(REST_FLOOR, 1.0 - wh - ws - wa)
        mr, md = BASE_MIX
        v = w_rest * (mr * self.rows[at["r"]] + md * self.rows[at["d"]]) + wa * self.rows[at["a"]] + ws * self.rows[at["s"]] + wh * h
        v *= self.b[at["flag"]]
        return v / np.cumsum(v, axis=1)[:, -1:]

    def best(self, p: np.ndarray, k: int) -> np.ndarray:
        """``ranked_indices`` of each row: score and state packed into one number, the highest first."""
        n = self.n
        units = np.floor(p * 10.0 ** RANK_DIGITS + 0.5).astype(np.int64) * n + (n - 1 - np.arange(n))
        return n - 1 - np.sort(units, axis=1)[:, ::-1][:, :k] % n


def _codes(col: pa.Array, keys: dict) -> np.ndarray:
    """Number of each value in ``keys``; that of the others and of nulls is len(keys)."""
    d = col.dictionary_encode()
    known = np.array([*[keys.get(v, len(keys)) for v in d.dictionary.to_pylist()], len(keys)])
    return known[d.indices.fill_null(len(known) - 1).to_numpy()]


def ensemble_prob(wh: Column, ws: Column, wa: Column, w_rest: Column) -> Column:
    """G9 over the component arrays: base = 0.6 r + 0.4 d;
    w_rest * base + wa * a + ws * s + wh * h, times the boost, renormalised."""
    mr, md = BASE_MIX

    def cell(i):
        base = F.lit(mr) * F.get("r", i) + F.lit(md) * F.get("d", i)
        v = w_rest * base + wa * F.get("a", i) + ws * F.get("s", i) + wh * F.get("h", i)
        return v * F.coalesce(F.get("b", i), F.lit(1.0))
    raw = F.transform(F.sequence(F.lit(0), F.size("r") - 1), cell)
    return raw


def with_normalised(df: DataFrame, raw: Column, out: str = "p") -> DataFrame:
    """Divide an array by its sum. The raw array and its total are separate
    projections: inside one lambda the total would be recomputed per element
    (higher-order functions are interpreted, so that is O(n^2) per row)."""
    return (df.withColumn("_raw", raw)
              .withColumn("_tot", F.aggregate("_raw", F.lit(0.0), lambda acc, v: acc + v))
              .withColumn(out, F.transform("_raw", lambda x: x / F.col("_tot")))
              .drop("_raw", "_tot"))


def ranked_indices(p: Column, k: int) -> Column:
    """the k best indices, ties to the lower index (ranked on p rounded to
    12 decimals so engines that sum in another order agree)."""
    scored = F.transform(p, lambda x, i: F.struct((-round_to(x, RANK_DIGITS)).alias("k"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(scored), 1, k), lambda e: e["i"])


def tune_weights(val_annotated: DataFrame, comp: Components, rates: DataFrame,
                 min_rows: int = MIN_TUNE_ROWS, entity: str = "person_id") -> DataFrame:
    """Per current state with at least ``min_rows`` validation rows (all of
    them: rows are grouped into contexts first, so the work is that of the
    contexts), the grid combination with the best top-1 hits; the first combination in grid order wins ties. Other
    states keep the defaults from their self rate. Returns (cur_idx, w_hist,
    w_so, w_arch, tuned, hits, n_rows)."""
    sizes = val_annotated.groupBy("cur_idx").agg(F.count(F.lit(1)).alias("_rows"))
    eligible = sizes.filter(F.col("_rows") >= min_rows).select("cur_idx")
    rows = val_annotated.join(eligible, "cur_idx", "left_semi")
    ctx = with_component_rows(contexts(rows, comp, entity), comp, entity)
    per = grid_hits(ctx)
    grid = {c: (wh, ws, wa) for c, wh, ws, wa, _ in weight_grid()}
    gdf = ctx.sparkSession.createDataFrame(
        [(c, wh, ws, wa) for c, (wh, ws, wa) in grid.items()], "combo int, wh double, ws double, wa double")
    best = per.groupBy("cur_idx").agg(
        F.min_by(F.col("combo"), F.struct((-F.col("hits")).alias("h"), F.col("combo").alias("c"))).alias("combo"),
        F.max("hits").alias("hits")).join(F.broadcast(gdf), "combo")   # 59 fixed rows
    best = best.select("cur_idx", "hits", F.struct("wh", "ws", "wa").alias("bw"))
    n_rows = rows.groupBy("cur_idx").agg(F.count(F.lit(1)).alias("n_rows"))
    tuned = best.join(n_rows, "cur_idx").select(
        "cur_idx", F.col("bw.wh").alias("w_hist"), F.col("bw.ws").alias("w_so"),
        F.col("bw.wa").alias("w_arch"), F.lit(True).alias("tuned"),
        F.col("hits").cast("bigint").alias("hits"), F.col("n_rows").cast("bigint").alias("n_rows"))
    defaults = rates.select(F.col("idx").alias("cur_idx"), default_weights(F.col("self_rate")).alias("dw"))
    j = defaults.join(tuned, "cur_idx", "left")
    return j.select("cur_idx",
                    F.coalesce("w_hist", F.col("dw.w_hist")).alias("w_hist"),
                    F.coalesce("w_so", F.col("dw.w_so")).alias("w_so"),
                    F.coalesce("w_arch", F.col("dw.w_arch")).alias("w_arch"),
                    F.coalesce("tuned", F.lit(False)).alias("tuned"),
                    F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"),
                    F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"))


def _grid_kernel(batches):
    """Per Arrow batch of contexts: the boosted weight-free parts as a
    (contexts, 4, n) tensor times the (59, 4) weight grid, rounded like the
    SQL side, argmax over states (ties to the lowest index), hit counts
    looked up in each context's next-state counts."""
    import numpy as np
    import pandas as pd

    grid = np.array([[wr, wa, ws, wh] for _, wh, ws, wa, wr in weight_grid()])      # (C, 4)
    combos = np.array([c for c, *_ in weight_grid()], dtype=np.int32)
    mr, md = BASE_MIX
    scale = 10.0 ** RANK_DIGITS
    for pdf in batches:
        if pdf.empty:
            continue
        st = lambda c: np.stack(pdf[c].to_numpy())                                   # noqa: E731
        r, d, a, s, h, b = (st(c) for c in ("r", "d", "a", "s", "h", "b"))
        parts = np.stack([(mr * r + md * d) * b, a * b, s * b, h * b], axis=1)       # (m, 4, n)
        m = len(pdf)
        top = np.empty((m, len(combos)), dtype=np.int64)
        # (chunk, C, n) at a time: memory stays bounded for any batch size and n
        for lo in range(0, m, KERNEL_CHUNK):
            sc = np.einsum("ck,mkn->mcn", grid, parts[lo:lo + KERNEL_CHUNK])
            top[lo:lo + KERNEL_CHUNK] = np.argmax(np.floor(sc * scale + 0.5) / scale, axis=2)
        hits = np.zeros((m, len(combos)), dtype=np.int64)
        # next-state counts as a (rows, n) table filled from the paired arrays
        at, states = [pdf[c].to_numpy() for c in ("cnt", "nxt")]
        rows = np.repeat(np.arange(m), [len(x) for x in states])
        table = np.zeros((m, r.shape[1]), dtype=np.int64)
        table[rows, np.concatenate(states)] = np.concatenate(at)
        hits[:] = np.take_along_axis(table, top, axis=1)
        yield pd.DataFrame({"cur_idx": np.repeat(pdf["cur_idx"].to_numpy(), len(combos)),
                            "combo": np.tile(combos, m), "hits": hits.reshape(-1)})


def grid_hits(ctx: DataFrame) -> DataFrame:
    """Hits per (current state, grid combination) over scoring contexts."""
    x = ctx.select("cur_idx", F.map_keys("nxt_counts").alias("nxt"), F.map_values("nxt_counts").alias("cnt"),
                   "r", "d", "a", "s", "h", "b")
    out = x.mapInPandas(_grid_kernel, "cur_idx int, combo int, hits long")
    return out.groupBy("cur_idx", "combo").agg(F.sum("hits").alias("hits"))


def scored_contexts(annotated: DataFrame, comp: Components, weights: DataFrame, k: int = max(TOP_K),
                    entity: str = "person_id") -> DataFrame:
    """Contexts with their ensemble vector ``p`` under the per-state weights
    and the top-k indices ``topk``."""
    ctx = with_component_rows(contexts(annotated, comp, entity), comp, entity)
    ctx = ctx.join(weights.select("cur_idx", "w_hist", "w_so", "w_arch"), "cur_idx", "left")
    wh = F.coalesce("w_hist", F.lit(0.20))
    ws = F.coalesce("w_so", F.lit(0.20))
    wa = F.coalesce("w_arch", F.lit(0.10))
    wr = F.greatest(F.lit(REST_FLOOR), F.lit(1.0) - wh - ws - wa)
    ctx = with_normalised(ctx, ensemble_prob(wh, ws, wa, wr))
    return ctx.withColumn("topk", ranked_indices(F.col("p"), k))


def evaluate(annotated: DataFrame, comp: Components, weights: DataFrame,
             entity: str = "person_id") -> DataFrame:
    """Persistence baseline (next = current) and hit rate at 1, 3, 5."""
    sc = scored_contexts(annotated, comp, weights, max(TOP_K), entity)

    def hits(k):
        return F.aggregate(F.slice("topk", 1, k), F.lit(0).cast("bigint"),
                           lambda acc, i: acc + F.coalesce(F.try_element_at(F.col("nxt_counts"), i),
                                                           F.lit(0)).cast("bigint"))
    self_hits = F.coalesce(F.try_element_at(F.col("nxt_counts"), F.col("cur_idx")), F.lit(0))
    agg = sc.agg(F.sum("n_rows").alias("n"), F.sum(self_hits).alias("self"),
                 *[F.sum(hits(k)).alias(f"h{k}") for k in TOP_K])
    return agg.select(F.col("n").cast("bigint").alias("n_rows"),
                      (F.col("self") / F.col("n")).alias("persistence_top1"),
                      *[(F.col(f"h{k}") / F.col("n")).alias(f"top_{k}") for k in TOP_K])
