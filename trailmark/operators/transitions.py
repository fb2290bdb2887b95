"""Transitions (F1-F3), per-entity flags (E6, C3), the state space (D2),
self-transition rates (E8) and sequence statistics (A9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.exprs import clip
from trailmark.operators.sequence import ordered_sequence

EVENT_ORDER = ("yr", "start_date", "matched_label")


def build_transitions(events: DataFrame, *, entity: str = "person_id", state: str = "state",
                      order: Sequence[str] = EVENT_ORDER, hot_rows: int | None = None,
                      break_on_gap: bool = False) -> DataFrame:
    """every event with the entity's next state (``nxt``), previous state
    (``prev``) and 0-based position (``pos``); rows without a next state are
    dropped. ``cur`` is the event's own state.

    By default ``events`` holds only labelled rows, so a dropped row between A
    and C yields A -> C (as the batch program does). With ``break_on_gap``
    pass all events, unlabelled ones with a null state: the sequence runs over
    every event and transitions that touch an unlabelled one are removed."""
    seq = ordered_sequence(events.withColumn("cur", F.col(state)), [entity], list(order),
                           lead={"nxt": "cur"}, lag={"prev": "cur"}, position="pos",
                           hot_rows=hot_rows)
    out = seq.filter(F.col("nxt").isNotNull())
    return out.filter(F.col("cur").isNotNull()) if break_on_gap else out


def majority_flag(events: DataFrame, *, entity: str = "person_id", flag: str = "university_studies",
                  out: str = "univ_flag") -> DataFrame:
    """Per entity, share of true among non-null values >= 0.5; all-null or
    absent column gives false."""
    if flag not in events.columns:
        return events.select(entity).distinct().withColumn(out, F.lit(False))
    f = F.col(flag)
    return events.groupBy(entity).agg(
        ((F.count_if(f).cast("double") / F.greatest(F.count(f), F.lit(1))) >= 0.5).alias(out))


def attach_flag(df: DataFrame, flags: DataFrame, *, entity: str = "person_id",
                out: str = "univ_flag") -> DataFrame:
    """Left join of a per-entity flag, false when missing."""
    return (df.join(flags.select(entity, F.col(out).alias("_f")), entity, "left")
              .withColumn(out, F.coalesce(F.col("_f"), F.lit(False))).drop("_f"))


def state_space(transitions: DataFrame, cur: str = "cur", nxt: str = "nxt") -> DataFrame:
    """Sorted distinct states of current and next, with a 0-based index.
    The distinct set is bounded by the number of states, so the global
    ordering window runs on a tiny input."""
    s = (transitions.select(F.col(cur).alias("state"))
         .union(transitions.select(F.col(nxt).alias("state"))).distinct()
         .filter(F.col("state").isNotNull()))
    return s.withColumn("idx", (F.row_number().over(Window.orderBy("state")) - 1).cast("int"))


def self_rates(transitions: DataFrame, space: DataFrame, default: float = 0.2,
               cur: str = "cur", nxt: str = "nxt") -> DataFrame:
    """Share of self transitions per state; ``default`` for a state with no
    outgoing row; ``mult = 1 + 2 * rate``."""
    r = transitions.groupBy(F.col(cur).alias("state")).agg(
        F.avg((F.col(cur) == F.col(nxt)).cast("double")).alias("_r"))
    return (space.join(r, "state", "left")
                 .select("state", "idx", F.coalesce("_r", F.lit(default)).alias("self_rate"))
                 .withColumn("mult", F.lit(1.0) + F.lit(2.0) * F.col("self_rate")))


def entity_years(transitions: DataFrame, entity: str = "person_id", yr: str = "yr") -> DataFrame:
    """First and last year per entity."""
    return transitions.groupBy(entity).agg(F.min(yr).alias("_fy"), F.max(yr).alias("_ly"))


def temporal_features(transitions: DataFrame, *, entity: str = "person_id", yr: str = "yr",
                      pos: str = "pos", as_of: bool = False, bounds: DataFrame | None = None) -> DataFrame:
    """years since the entity's first row, span (both clipped 0..50;
    with ``as_of`` the span ends at the current event),
    position and velocity = position / max(span, 1) clipped 0..10. Min and max
    come from an aggregate (``bounds``: that of a larger table) joined back (the join splits a skewed entity under
    AQE; a window over the entity would not), or from the rows' own ``_fy`` and ``_ly``."""
    out = transitions
    if bounds is not None or not {"_fy", "_ly"} <= set(transitions.columns):
        out = transitions.join(entity_years(transitions, entity, yr) if bounds is None else bounds, entity)
    if as_of:
        # Span up to the current event only: the order is led by the year, so
        # the running maximum year is the event's own year (no look-ahead).
        out = out.withColumn("_ly", F.col(yr))
    return (out.withColumn("rr_years_since_first", clip(F.col(yr) - F.col("_fy"), 0, 50).cast("double"))
               .withColumn("rr_career_span", clip(F.col("_ly") - F.col("_fy"), 0, 50).cast("double"))
               .withColumn("rr_n_prior_trans", F.col(pos).cast("double"))
               .withColumn("rr_transition_velocity",
                           clip(F.col("rr_n_prior_trans") / F.greatest(F.col("rr_career_span"),
                                                                       F.lit(1.0)), 0, 10))
               .drop("_fy", "_ly"))


def sequence_stats(events: DataFrame, transitions: DataFrame, *, entity: str = "person_id") -> DataFrame:
    """Transitions, entities with >= 2 events, median sequence length and
    distinct (cur, nxt) pairs."""
    lengths = events.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    per = lengths.agg(F.count_if(F.col("n") >= 2).cast("bigint").alias("entities_2plus"),
                      F.percentile(F.col("n"), 0.5).alias("median_length"))
    pairs = transitions.groupBy("cur", "nxt").agg(F.count(F.lit(1)).alias("c"))
    return per.select(
        pairs.agg(F.sum("c").cast("bigint")).scalar().alias("transitions"),
        "entities_2plus", "median_length",
        pairs.agg(F.count(F.lit(1)).cast("bigint")).scalar().alias("distinct_pairs"))
