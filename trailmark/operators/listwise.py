"""Learned ranking over whole lists, a conditional logit.

Row r chooses candidate i of its list with probability proportional to
exp(offset_i + w . x_i); the offset is the log of the ensemble's probability, so w = 0
ranks as the ensemble does and w holds only what the features add. Fitting is
Newton's method on the penalised log-likelihood: one pass over the lists an
iteration gives likelihood, gradient and Hessian, summed in the tasks, then by
``groupBy().agg(sum)``; the driver solves a system as large as the features. All
penalties are fitted in the same passes. The validation rows choose among them
and the plain ensemble, so the choice is never below the ensemble there.

The lists of training rows hold the entity's own prior, so there are as many as rows: they are kept
short (``row_lists``: candidates, their history and ensemble probability) and the tasks of a pass add
what depends on the states only, from arrays of the size of the states (``Terms``).

A feature that is the same for all candidates of a row cannot change the row's choice, so the
temporal ones take part as products with "stays in its state".
Lists without the true next add nothing to the likelihood and count as misses.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.exprs import LOG_FLOOR
from trailmark.operators import ensemble, rerank, transitions

TEMPORAL = [rerank.FEATURES[i] for i in rerank.FEATURE_GROUPS["F_temporal"]]
TERMS = [f for f in rerank.FEATURES if f not in TEMPORAL] + [f"{f}_self" for f in TEMPORAL]
PENALTIES = (1.0, 10.0, 100.0)
MAX_PASSES = 20
TOLERANCE = 1e-7
#: Positions of an entity whose rows may stand with one list, and lists expanded at a time in a task.
CHUNK = 512
EXPANDED = 4096


def term(name: str, col=F.col) -> Column:
    return col(name) if name in rerank.FEATURES else col(name.removesuffix("_self")) * col("f_self")


def offset(col=F.col) -> Column:
    return F.ln(F.greatest(col("f_ensemble"), F.lit(LOG_FLOOR)))


def score(weights: Sequence[float], col=F.col) -> Column:
    """The ranking score as an expression over the candidate features."""
    out = offset(col)
    for name, w in zip(TERMS, weights, strict=True):
        if w:
            out = out + F.lit(float(w)) * term(name, col)
    return out


class Scorer(NamedTuple):
    """A ranking score by numbers, for lists with ``rows``: a weight per term, and whether the offset takes part."""
    weights: Sequence[float]
    offset: bool = True


#: ``rerank.linear_score``; its temporal features are the same for all candidates of a row and change no order.
FIXED = Scorer([dict(zip(rerank.FEATURES, rerank.FIXED_WEIGHTS, strict=True)).get(t, 0.0) for t in TERMS], False)


class Terms:
    """The terms that depend on states only: (current state, candidate) to all terms, those of the
    history, the ensemble, the second order and the time left at 0, and the logarithm of the second-order rows."""

    def __init__(self, arrays: ensemble.Arrays, comp, state_emb: DataFrame):
        n = self.n = arrays.n
        g, r = comp.glob.select("cur_idx", F.col("p").alias("g")), comp.rec.select("cur_idx", F.col("p").alias("r"))
        zero = F.lit(0.0)
        pairs = g.join(r, "cur_idx").withColumn("cands", F.sequence(F.lit(0), F.lit(n - 1))).withColumn("cv", F.transform("cands", lambda c: F.struct(
            c.alias("cand_idx"), F.get("g", c).alias("_g"), F.get("r", c).alias("_r"), zero.alias("_sv"), zero.alias("_h"), zero.alias("_p"))))
        none = {c: zero for c in ("rr_years_since_first", "rr_career_span", "rr_n_prior_trans", "rr_transition_velocity")}
        f = rerank.feature_lists(pairs.drop("g", "r").withColumns(none), comp, state_emb)
        self.pairs = np.zeros((n, n, len(TERMS)))
        for row in f.select("cur_idx", F.transform("feats", lambda c: F.array(*[term(t, lambda name: c[name]).cast("double") for t in TERMS])).alias("x")).collect():
            self.pairs[row["cur_idx"]] = row["x"]
        self.pairs = self.pairs.reshape(n * n, len(TERMS))
        at, places = np.unique(arrays.s, return_inverse=True)
        self.second, self.log_second = places.reshape(arrays.s.shape), np.log(arrays.rows[at] + LOG_FLOOR)

    def expanded(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(terms, offsets) of all candidates of ``row_lists``, list by list, but for the temporal terms."""
        cur = b.column("cur_idx").to_numpy()
        cands, h, p = (b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in ("cands", "_h", "_p"))
        x = self.pairs[cur[:, None] * self.n + cands]
        places = self.second[b.column("prev_idx").fill_null(self.n).to_numpy(), cur]
        x[..., TERMS.index("f_log_second")] = self.log_second[places[:, None], cands]
        x[..., TERMS.index("f_hist")], x[..., TERMS.index("f_ensemble")] = h, p
        return x.reshape(-1, len(TERMS)), np.log(np.maximum(p, LOG_FLOOR)).ravel()


def row_lists(rows: DataFrame, comp, weights: DataFrame) -> DataFrame:
    """The lists of all ``rows``, the true next forced in, one a row and as short as ``Terms`` allows. The
    rows have their entity's years (``_fy``, ``_ly``)."""
    t = transitions.temporal_features(rows)
    t = t.select("person_id", "nxt_idx", *ensemble.CONTEXT_KEYS[:-1], *[v.alias(k) for k, v in rerank.temporal().items()])
    f = rerank.forced_lists(t, comp, weights, ["_h", "_p"])
    one = F.struct(F.col("true_pos").alias("truth"), F.lit(1).cast("long").alias("n"), *TEMPORAL)
    return f.select("cur_idx", "prev_idx", "cands", "_h", "_p", F.array(one).alias("rows"))


def with_terms(lists: DataFrame, terms: Terms) -> DataFrame:
    """``row_lists`` and what its passes add to it, as one table for the functions below."""
    lists._terms = terms
    return lists


def context_lists(rows: DataFrame, comp, made: DataFrame, state_emb: DataFrame) -> DataFrame:
    """The lists of all ``rows``, from those of their contexts (``context_candidates``, written: read twice), without a copy per row. A list is that of its
    context (where the true next is forced in, of context and next state) and the same for all
    its rows but for the temporal terms of the candidate that is the current state.
    So a list comes once (offsets ``o``, flat terms ``x``, place of the current state
    ``self_at``), beside it ``rows``: place of the true next (-1: absent),
    temporal features and the number of rows that agree in all of these. The
    rows have their entity's years (``_fy``, ``_ly``)."""
    t = transitions.temporal_features(rerank.with_prior_entity(rows, comp))
    alike = t.groupBy(*ensemble.CONTEXT_KEYS, "nxt_idx", F.floor(F.col("pos") / CHUNK).alias("_chunk"),
                      *[v.alias(k) for k, v in rerank.temporal().items()]).agg(F.count(F.lit(1)).alias("n"))
    key = [c for c in [*ensemble.CONTEXT_KEYS, "nxt_idx"] if c in made.columns]
    together = alike.groupBy(*key, "_chunk").agg(F.collect_list(F.struct("nxt_idx", "n", *TEMPORAL)).alias("rows"))
    none = {c: F.lit(0.0) for c in ("rr_years_since_first", "rr_career_span", "rr_n_prior_trans", "rr_transition_velocity")}
    f = rerank.feature_lists(made.withColumns(none), comp, state_emb).drop(*none)
    f = f.select(*key, "cands", F.transform("feats", lambda c: offset(lambda name: c[name])).alias("o"),
                 F.flatten(F.transform("feats", lambda c: F.array(*[term(t, lambda name: c[name]).cast("double") for t in TERMS]))).alias("x"))
    place = F.transform("rows", lambda r: F.struct(
        (F.array_position(F.col("cands"), r["nxt_idx"]) - 1).cast("int").alias("truth"), r["n"].alias("n"), *[r[k].alias(k) for k in TEMPORAL]))
    return rerank.key_join(together, f, key).select(
        "o", "x", (F.array_position(F.col("cands"), F.col("cur_idx")) - 1).cast("int").alias("self_at"), place.alias("rows"))


def ranked(rows: DataFrame, score: Scorer) -> DataFrame:
    """J10 on ``context_lists``: per list and rows that agree, the place of the true next in ensemble order (``truth``, -1: absent),
    the places in ensemble order, best score first (``order``, ties to the ensemble), and the number of rows ``n``. A list is scored
    once; its rows add their temporal terms to the current state."""
    return rows.select("o", "x", "self_at", "rows").mapInArrow(_orders(score), "truth int, n long, order array<int>")


def _orders(score: Scorer):
    flat, temporal = score.weights[:-len(TEMPORAL)], score.weights[-len(TEMPORAL):]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            o = b.column("o")
            sizes = o.value_lengths().to_numpy()
            first = np.cumsum(sizes) - sizes
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(TERMS))
            z = o.flatten().to_numpy(zero_copy_only=False) if score.offset else np.zeros(len(x))
            for i, w in enumerate(flat):  # term by term, as the expressions add them
                if w:
                    z = z + w * x[:, i]
            rows, self_at = b.column("rows"), b.column("self_at").to_numpy()
            owner = np.repeat(np.arange(len(first)), rows.value_lengths().to_numpy())
            rows = rows.flatten()
            for at in range(0, len(owner), EXPANDED):
                own, part = owner[at:at + EXPANDED], rows.slice(at, EXPANDED)
                there = np.arange(sizes[own].max()) < sizes[own][:, None]
                each = np.full(there.shape, -np.inf)
                each[there] = z[(first[own][:, None] + np.arange(there.shape[1]))[there]]
                stays = np.flatnonzero(self_at[own] >= 0)
                for t, w in zip(TEMPORAL, temporal, strict=True):
                    if w:
                        each[stays, self_at[own][stays]] += w * part.field(t).to_numpy()[stays]
                order = np.argsort(-np.floor(each * 10.0 ** rerank.SCORE_DIGITS + 0.5), axis=1, kind="stable")
                ends = np.concatenate([[0], np.cumsum(sizes[own])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.field("truth"), part.field("n"), pa.ListArray.from_arrays(ends, pa.array(order[there].astype(np.int32)))],
                                                 names=["truth", "n", "order"])
    return run


def lists(feats: DataFrame) -> DataFrame:
    """Of any table of candidate features, one row per ranked row: its candidates in ensemble order (at most K) with
    offsets, terms (flat, candidate by candidate) and the place of the true next (-1: absent)."""
    c = F.struct("rank", (F.col("cand_idx") == F.col("nxt_idx")).alias("hit"), offset().alias("o"),
                 F.array(*[term(t).cast("double") for t in TERMS]).alias("x"))
    g = feats.groupBy(*rerank.ROW).agg(F.sort_array(F.collect_list(c)).alias("c"))
    return g.select(*rerank.ROW, F.col("c.o").alias("o"), F.flatten("c.x").alias("x"),
                    (F.array_position(F.col("c.hit"), F.lit(True)) - 1).cast("int").alias("truth"))


def _lists(b: pa.RecordBatch, terms: Terms | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, offsets, first candidate of each list, place of the true next, rows
    of the list) of ``lists`` or, at most EXPANDED lists at a time, of ``context_lists`` or ``row_lists``."""
    if not b.num_rows:
        return
    if terms is not None:
        for at in range(0, b.num_rows, EXPANDED):
            yield _short(b.slice(at, EXPANDED), terms)
        return
    o = b.column("o")
    sizes = np.diff(o.offsets.to_numpy())
    first = np.cumsum(sizes) - sizes
    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(TERMS))
    o = o.flatten().to_numpy(zero_copy_only=False)
    if "rows" not in b.schema.names:
        yield x, o, first, b.column("truth").to_numpy(), np.ones(len(first))
        return
    rows = b.column("rows")
    owner = np.repeat(np.arange(len(first)), np.diff(rows.offsets.to_numpy()))
    rows = rows.flatten()
    truth, n = rows.field("truth").to_numpy(), rows.field("n").to_numpy().astype(np.float64)
    temporal = np.stack([rows.field(t).to_numpy() for t in TEMPORAL], axis=1)
    self_at = b.column("self_at").to_numpy()
    for at in range(0, len(owner), EXPANDED):
        own = owner[at:at + EXPANDED]
        begin = np.cumsum(sizes[own]) - sizes[own]
        take = np.arange(sizes[own].sum()) + np.repeat(first[own] - begin, sizes[own])
        terms = x[take]
        stays = self_at[own] >= 0
        terms[(begin + self_at[own])[stays], -len(TEMPORAL):] = temporal[at:at + EXPANDED][stays]
        yield terms, o[take], begin, truth[at:at + EXPANDED], n[at:at + EXPANDED]


def _short(b: pa.RecordBatch, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x, o = terms.expanded(b)
    rows = b.column("rows").flatten()  # one a list
    k = len(o) // b.num_rows
    stays = np.flatnonzero(b.column("cands").flatten().to_numpy() == np.repeat(b.column("cur_idx").to_numpy(), k))
    temporal = np.stack([rows.field(t).to_numpy() for t in TEMPORAL], axis=1)
    x[stays, -len(TEMPORAL):] = temporal[stays // k]
    return x, o, np.arange(0, len(o), k), rows.field("truth").to_numpy(), rows.field("n").to_numpy().astype(np.float64)


def _known(lists: tuple) -> tuple:
    """Those of the lists that hold the true next."""
    x, o, first, truth, n = lists
    if (truth >= 0).all():
        return lists
    sizes = np.diff(np.append(first, len(o)))
    keep = truth >= 0
    cells = np.repeat(keep, sizes)
    return x[cells], o[cells], np.cumsum(sizes[keep]) - sizes[keep], truth[keep], n[keep]


def choice(x: np.ndarray, o: np.ndarray, first: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each candidate, and its logarithm."""
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(o))))
    z = o + x @ w
    z -= np.maximum.reduceat(z, first)[owner]
    log_p = z - np.log(np.add.reduceat(np.exp(z), first))[owner]
    return np.exp(log_p), log_p


def _sums(weights: np.ndarray, terms: Terms | None = None):
    """Cells of one pass per penalty: rows, log-likelihood, gradient, Hessian
    and, for the scale of the terms, their squares."""
    n = len(TERMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(weights), 2 + 2 * n + n * n))
        for x, o, first, truth, rows in (_known(part) for b in batches for part in _lists(b, terms)):
            if not len(first):
                continue
            hit = first + truth
            sizes = np.diff(np.append(first, len(o)))
            of = np.repeat(rows, sizes)
            squares = np.einsum("ij,ij->j", of[:, None] * x, x)
            alike = x.reshape(len(first), -1, n) if (sizes == sizes[0]).all() else None
            for k, w in enumerate(weights):
                p, log_p = choice(x, o, first, w)
                if alike is None:
                    mean = np.add.reduceat(p[:, None] * x, first, axis=0)
                else:
                    mean = np.einsum("ij,ijk->ik", p.reshape(alike.shape[:2]), alike)
                total[k] += np.concatenate([[rows.sum(), log_p[hit] @ rows], rows @ (x[hit] - mean), squares,
                                            (((of * p)[:, None] * x).T @ x - (rows[:, None] * mean).T @ mean).ravel()])
        k, cell = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel(), pa.int32()), pa.array(cell.ravel(), pa.int32()), pa.array(total.ravel())],
                                         names=["fit", "cell", "v"])
    return run


def _columns(rows: DataFrame) -> list[str]:
    if "cands" in rows.columns:
        return ["cur_idx", "prev_idx", "cands", "_h", "_p", "rows"]
    return ["o", "x", "self_at", "rows"] if "rows" in rows.columns else ["o", "x", "truth"]


def _terms(rows: DataFrame) -> Terms | None:
    if "cands" not in rows.columns:
        return None
    if getattr(rows, "_terms", None) is None:
        raise ValueError("row_lists need with_terms")
    return rows._terms


def likelihood(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """(fits, cells) sums over all lists; at most fits x (terms + 2)^2 numbers reach the driver."""
    n = len(TERMS)
    sums = rows.select(*_columns(rows)).mapInArrow(_sums(weights, _terms(rows)), "fit int, cell int, v double") \
        .groupBy("fit", "cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((len(weights), 2 + 2 * n + n * n))
    for r in sums:
        out[r["fit"], r["cell"]] = r["v"]
    return out


def fit(rows: DataFrame, penalties: Sequence[float] = PENALTIES, max_passes: int = MAX_PASSES) -> np.ndarray:
    """(penalties, terms) weights. A step that lowers the penalised likelihood
    is halved; a fit that no longer gains stands still, and when all do, it ends."""
    n = len(TERMS)
    w, step = np.zeros((len(penalties), n)), np.zeros((len(penalties), n))
    best = np.full(len(penalties), -np.inf)
    done = np.zeros(len(penalties), bool)
    sums = np.zeros((len(penalties), 2 + 2 * n + n * n))
    for _ in range(max_passes):
        sums[~done] = likelihood(rows, (w + step)[~done])
        for k, penalty in enumerate(penalties):
            if done[k]:
                continue
            count, value, gradient = sums[k, 0], sums[k, 1], sums[k, 2:2 + n]
            if not count:
                done[k] = True
                continue
            # the penalty is on the scale of the terms; terms that are always 0 stay at 0
            scale = np.maximum(sums[k, 2 + n:2 + 2 * n] / count, 1e-6) * penalty
            at = w[k] + step[k]
            value -= (scale * at * at).sum() / 2
            if value < best[k]:
                step[k] /= 2
                done[k] = np.abs(step[k]).max() < 1e-9
                if done[k]:
                    step[k] = 0
                continue
            done[k] = value - best[k] < TOLERANCE * abs(value)
            best[k], w[k], step[k] = value, at, 0
            if not done[k]:
                hessian = sums[k, 2 + 2 * n:].reshape(n, n) + np.diag(scale)
                step[k] = np.linalg.solve(hessian, gradient - scale * at)
        if done.all():
            break
    return w


def _first_places(weights: np.ndarray, terms: Terms | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, n = np.zeros(len(weights), np.int64), 0
        for x, o, first, truth, rows in (part for b in batches for part in _lists(b, terms)):
            n += int(rows.sum())
            for k, w in enumerate(weights):
                z = np.round(o + x @ w, rerank.SCORE_DIGITS)
                owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(o))))
                top = np.flatnonzero(z == np.maximum.reduceat(z, first)[owner])
                chosen = top[np.searchsorted(owner[top], np.arange(len(first)))] - first  # ties: ensemble order
                hits[k] += int(rows[chosen == truth].sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(weights)), pa.int32()), pa.array(hits), pa.array([n] * len(weights), pa.int64())],
                                         names=["fit", "hits", "n"])
    return run


def top1(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Share of all rows whose first place is the true next, for each set of weights."""
    got = rows.select(*_columns(rows)).mapInArrow(_first_places(weights, _terms(rows)), "fit int, hits long, n long") \
        .groupBy("fit").agg((F.sum("hits") / F.greatest(F.sum("n"), F.lit(1))).alias("top1")).collect()
    out = np.zeros(len(weights))
    for r in got:
        out[r["fit"]] = r["top1"]
    return out


def train(train_lists: DataFrame, val_lists: DataFrame, penalties: Sequence[float] = PENALTIES) -> tuple[np.ndarray, np.ndarray]:
    """(weights, validation top-1 of each penalty and, last, of the ensemble).
    The best on all validation rows wins; ties go to the heavier penalty."""
    weights = np.concatenate([fit(train_lists, sorted(penalties)), np.zeros((1, len(TERMS)))])
    places = top1(val_lists, weights)
    return weights[len(places) - 1 - int(np.argmax(places[::-1]))], places


def group_importance(weights: Sequence[float], spread: Sequence[float]) -> list[tuple[str, float]]:
    """Mean |weight x scale of its term| per feature group, normalised to 1."""
    size = {t: abs(w * s) for t, w, s in zip(TERMS, weights, spread, strict=True)}
    vals = {g: float(np.mean([size.get(rerank.FEATURES[i], size.get(f"{rerank.FEATURES[i]}_self", 0.0)) for i in idx]))
            for g, idx in rerank.FEATURE_GROUPS.items()}
    tot = sum(vals.values()) or 1.0
    return [(g, v / tot) for g, v in vals.items()]


def gradient(rows: DataFrame) -> DataFrame:
    """(term, gradient) of the log-likelihood at w = 0."""
    n = len(TERMS)
    sums = likelihood(rows, np.zeros((1, n)))[0]
    return rows.sparkSession.createDataFrame([(t, float(v)) for t, v in zip(TERMS, sums[2:2 + n], strict=True)], "term string, gradient double")


def spread(rows: DataFrame) -> np.ndarray:
    """Root mean square of each term per list."""
    n = len(TERMS)
    sums = likelihood(rows, np.zeros((1, n)))[0]
    return np.sqrt(sums[2 + n:2 + 2 * n] / max(sums[0], 1.0))
