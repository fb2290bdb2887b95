"""Drift (volatility) per entity (H1, H2, E5, E7), clustering (H3, E13) and
archetype naming (H4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.exprs import LOG_FLOOR, round_to
from trailmark.operators import kmeans, markov
from trailmark.operators.sequence import fixed

DEFAULT_ARCHETYPE = "Stable Specialist"


def transition_logprob(transitions: DataFrame, matrix: DataFrame, space: DataFrame) -> DataFrame:
    """H1: log p(cur -> nxt) under a matrix, floored at 1e-9 (an unknown
    state gets log 1e-9); ``is_self`` flag. The matrix is joined as cells
    (states x states rows), so no row carries an array."""
    cells = markov.long_form(matrix, space).select(
        F.col("cur").alias("_c"), F.col("nxt").alias("_x"), F.col("p").alias("_p"))
    t = transitions.join(cells, (F.col("cur") == F.col("_c")) & (F.col("nxt") == F.col("_x")), "left")
    return (t.withColumn("log_prob", F.ln(F.greatest(F.coalesce("_p", F.lit(0.0)), F.lit(LOG_FLOOR))))
             .withColumn("is_self", F.col("cur") == F.col("nxt"))
             .drop("_c", "_x", "_p"))


def dominant_state(events: DataFrame, entity: str = "person_id", state: str = "state",
                   out: str = "dominant_sector") -> DataFrame:
    """E5: most frequent state per entity, ties to the lowest value. Counts
    first (partial aggregation), then a window over at most n states per
    entity."""
    c = events.filter(F.col(state).isNotNull()).groupBy(entity, state).agg(
        F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(entity).orderBy(F.col("_c").desc(), F.col(state))
    return (c.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
             .select(entity, F.col(state).alias(out)))


def drift_scores(transitions_lp: DataFrame, events: DataFrame, entity: str = "person_id",
                 state: str = "state", min_transitions: int = 2) -> DataFrame:
    """H2 (E7): drift = -mean log p, number of transitions, self-loop rate;
    entities with at least ``min_transitions``; plus the number of events and
    the dominant state."""
    per = transitions_lp.groupBy(entity).agg(
        (-F.avg("log_prob")).alias("drift_score"),
        F.count(F.lit(1)).alias("total_transitions"),
        F.avg(F.col("is_self").cast("double")).alias("self_loop_rate"))
    per = per.filter(F.col("total_transitions") >= min_transitions)
    lengths = events.groupBy(entity).agg(F.count(F.lit(1)).alias("seq_length"))
    dom = dominant_state(events, entity, state)
    return per.join(lengths, entity, "left").join(dom, entity, "left")


FEATURES = ("drift_score", "seq_length", "self_loop_rate")


def cluster_drift(risk: DataFrame, k: int = 5, restarts: int = kmeans.RESTARTS, max_iter: int = kmeans.MAX_ITER,
                  features=FEATURES, entity: str = "person_id", seed: int = 42) -> DataFrame:
    """H3: standardise the features and run k-means with ``restarts`` restarts;
    adds ``cluster``, numbered by the centres."""
    x = fixed(kmeans.standardised(risk, features, "x"), "standardised")
    centres, _ = kmeans.fit(x.select(entity, "x"), entity, k, restarts, max_iter, seed)
    if not len(centres):
        return x.drop("x").withColumn("cluster", F.lit(0))
    return kmeans.assign(x, centres).drop("x")


def assign_drift(risk: DataFrame, centres, features=FEATURES) -> DataFrame:
    """H3 with given centres of the standardised features: adds ``cluster``."""
    return kmeans.assign(kmeans.standardised(risk, features, "x"), centres).drop("x")


def cluster_summary(clustered: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Entities and mean drift, length and self-loop rate per cluster."""
    return clustered.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_users"),
        F.avg("drift_score").alias("mean_drift"),
        F.avg("seq_length").alias("mean_len"),
        F.avg("self_loop_rate").alias("mean_loop"))


def archetype_names(summary: DataFrame) -> DataFrame:
    """H4: ordered rules on the cluster means against quantiles (linear
    interpolation) of the cluster means; the first rule that holds names the
    cluster. The quantiles are scalar subqueries over the (k-row) summary. A
    quantile may be a cluster's own mean, so means are compared to 9 decimals:
    the order of a sum does not decide a name."""
    drift_, len_ = round_to("mean_drift", 9), round_to("mean_len", 9)
    q = summary.agg(F.struct(F.percentile(drift_, 0.8).alias("q80"),
                             F.percentile(drift_, 0.2).alias("q20"),
                             F.percentile(drift_, 0.5).alias("q50"),
                             F.percentile(len_, 0.75).alias("q75"))).scalar()
    # Archetype names and their cut-offs.
    q80, q20, q50, q75 = q["q80"], q["q20"], q["q50"], q["q75"]
    d, loop, ln = drift_, F.col("mean_loop"), len_
    name = (F.when((d > q80) & (loop < 0.3), F.lit("Career Switcher"))
             .when((d < q20) & (loop > 0.5), F.lit("Sector Loyalist"))
             .when(ln > q75, F.lit("Career Veteran"))
             .when(d > q50, F.lit("Gradual Mover"))
             .otherwise(F.lit(DEFAULT_ARCHETYPE)))
    return summary.withColumn("archetype", name)


def drift_histogram(risk: DataFrame, bins: int = 50, col: str = "drift_score") -> DataFrame:
    """Equal-width bins between min and max; the last bin is closed on
    the right (as in NumPy)."""
    lo = risk.agg(F.min(col)).scalar()
    hi = risk.agg(F.max(col)).scalar()
    width = (hi - lo).cast("double")
    b = F.when(width <= 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - lo) / width * bins), F.lit(bins - 1))).cast("int")
    return risk.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
