"""Association rules over transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.exprs import round_to


def association_rules(transitions: DataFrame, cur: str = "cur", nxt: str = "nxt") -> DataFrame:
    """H5: support, confidence and lift per (antecedent, consequent), rounded
    to 4 decimals; lift uses the rounded confidence (as the batch program
    does) and ``lift_exact`` the unrounded one. The antecedent and consequent
    totals are one row per state (C1: broadcast-sized, chosen by AQE)."""
    pc = transitions.groupBy(F.col(cur).alias("antecedent"), F.col(nxt).alias("consequent")) \
                    .agg(F.count(F.lit(1)).alias("pair_count"))
    ac = pc.groupBy("antecedent").agg(F.sum("pair_count").alias("ant_count"))
    cc = pc.groupBy("consequent").agg(F.sum("pair_count").alias("con_count"))
    tot = pc.agg(F.sum("pair_count").cast("double")).scalar()
    r = pc.join(ac, "antecedent").join(cc, "consequent")
    conf = round_to(F.col("pair_count") / F.col("ant_count"), 4)
    return r.select(
        "antecedent", "consequent",
        round_to(F.col("pair_count") / tot, 4).alias("support"),
        conf.alias("confidence"),
        round_to(conf / (F.col("con_count") / tot), 4).alias("lift"),
        ((F.col("pair_count") / F.col("ant_count")) / (F.col("con_count") / tot)).alias("lift_exact"),
        F.col("pair_count").cast("bigint").alias("pair_count"))


def top_rules(rules: DataFrame, n: int = 20, cross_only: bool = True, by: str = "lift") -> DataFrame:
    """H6: rules between different states, top ``n`` by lift, confidence or
    support (ties by names).
    TakeOrderedAndProject: each task keeps n rows, the driver merges them."""
    r = rules.filter(F.col("antecedent") != F.col("consequent")) if cross_only else rules
    return r.orderBy(F.col(by).desc(), F.col("antecedent"), F.col("consequent")).limit(n)
