"""Report tables behind the charts (K1-K8): frequency tables, histograms,
top-N lists, heatmap cells, quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.exprs import round_to
from trailmark.operators.sequence import ordered_sequence


def distribution(df: DataFrame, col: str, out_n: str = "n", out_pct: str = "pct") -> DataFrame:
    """Count per value and its percentage (2 decimals). The grand total
    is a scalar subquery over the (small) grouped result."""
    c = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out_n))
    tot = c.agg(F.sum(out_n)).scalar()
    return c.withColumn(out_pct, round_to(F.col(out_n) * 100.0 / tot, 2))


def clipped_histogram(df: DataFrame, col: str, cap: int = 15) -> DataFrame:
    """Counts of least(value, cap) (the cap bucket reads 'cap+')."""
    return df.groupBy(F.least(F.col(col), F.lit(cap)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))


def heatmap_cells(transitions: DataFrame, cur: str = "cur", nxt: str = "nxt") -> DataFrame:
    """E11/K4 long form: log(1 + n) per pair (full state names)."""
    return transitions.groupBy(cur, nxt).agg(F.count(F.lit(1)).alias("n")) \
                      .withColumn("log_n", F.log1p("n"))


def top_n_per_group(df: DataFrame, group: Sequence[str], score: str, tie: Sequence[str],
                    n: int = 3, rank: str = "rank") -> DataFrame:
    """the ``n`` best rows per group by ``score`` desc, ties by ``tie``.
    Input rows are already aggregated (one per group and item)."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), *[F.col(t) for t in tie])
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """F8: global top-N (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], names: Sequence[str],
                    hot_rows: int = 200_000) -> DataFrame:
    """E9 with linear interpolation, exact and without gathering the column in
    one task: equal values are counted first (one value may hold most rows), the
    distinct values get the running count as their first rank (the skew-safe
    order), and only the values around each (n - 1) * q are kept."""
    v = df.select(F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counted = v.groupBy("_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_g", F.lit(0))
    ranked = ordered_sequence(counted, ["_g"], ["_v"], position="_pos", weight="_c", hot_rows=hot_rows)
    ranked = ranked.withColumn("_n", counted.agg(F.sum("_c")).scalar())
    keep = F.lit(False)
    aggs = []
    for q, name in zip(qs, names):
        h = (F.col("_n") - 1) * F.lit(float(q))
        holds = lambda r: (F.col("_pos") <= r) & (r < F.col("_pos") + F.col("_c"))
        lo, hi = F.floor(h), F.ceil(h)
        keep = keep | holds(lo) | holds(hi)
        lo_v = F.max(F.when(holds(lo), F.col("_v")))
        hi_v = F.max(F.when(holds(hi), F.col("_v")))
        aggs.append((lo_v + F.max(h - lo) * (hi_v - lo_v)).alias(name))
    return ranked.filter(keep).agg(*aggs)
