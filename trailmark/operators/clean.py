"""Cleaning (B1-B5) and the drop report (A10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.exprs import is_blank, year_from_text
from trailmark.operators.sequence import first_per_group

YEAR_MIN, YEAR_MAX = 1950, 2024


def valid_label(label: str = "matched_label"):
    """B1 predicate: label present, not blank, not 'unknown' in any case. The
    'unknown' test does not strip, so ' unknown ' is kept."""
    c = F.col(label)
    return c.isNotNull() & ~is_blank(c) & (F.lower(c) != F.lit("unknown"))


def clean_labels(df: DataFrame, label: str = "matched_label") -> DataFrame:
    """B1."""
    return df.filter(valid_label(label))


def dedup_events(df: DataFrame, keys: Sequence[str] = ("person_id", "matched_label", "start_date"),
                 order: Sequence[str] = ()) -> DataFrame:
    """B2: one row per ``keys`` (nulls equal), the first under ``order``."""
    keys = list(keys)
    order = list(order)
    values = [c for c in df.columns if c not in keys and c not in order]
    if not order:
        # No order to honour: any row of the group (only valid when the other
        # columns are not read).
        return df.dropDuplicates(keys)
    out = first_per_group(df, keys, order, values)
    return out.select(*df.columns)


def with_year(df: DataFrame, date: str = "start_date", out: str = "yr") -> DataFrame:
    """B3."""
    return df.withColumn(out, year_from_text(date))


def year_range(df: DataFrame, yr: str = "yr", lo: int = YEAR_MIN, hi: int = YEAR_MAX) -> DataFrame:
    """Keep lo <= year <= hi; null years drop."""
    return df.filter(F.col(yr).between(lo, hi))


def clean_events(df: DataFrame, *, order: Sequence[str] = (), label: str = "matched_label",
                 date: str = "start_date", lo: int = YEAR_MIN, hi: int = YEAR_MAX) -> DataFrame:
    """B1 -> B2 -> B3 -> B4. The trajectory order (B5) is not a global sort:
    it lives in the window specs of the sequence operators."""
    out = clean_labels(df, label)
    out = dedup_events(out, ("person_id", label, date), order)
    out = with_year(out, date)
    return year_range(out, "yr", lo, hi)


def clean_report(df: DataFrame, *, label: str = "matched_label", date: str = "start_date",
                 lo: int = YEAR_MIN, hi: int = YEAR_MAX) -> DataFrame:
    """A10: rows dropped at each cleaning step. One aggregate over the
    duplicate key (partial aggregation first); the year depends only on the
    date, which is part of that key, so no row needs its duplicate rank."""
    ok = valid_label(label)
    groups = (df.groupBy(F.col("person_id"), F.col(label), F.col(date), ok.alias("_ok"))
                .agg(F.count(F.lit(1)).alias("_n")))
    yr_ok = F.coalesce(year_from_text(date).between(lo, hi), F.lit(False))
    return groups.agg(
        F.sum("_n").cast("bigint").alias("rows_in"),
        F.coalesce(F.sum(F.when(~F.col("_ok"), F.col("_n"))), F.lit(0)).cast("bigint")
         .alias("dropped_label"),
        F.coalesce(F.sum(F.when(F.col("_ok"), F.col("_n") - 1)), F.lit(0)).cast("bigint")
         .alias("dropped_duplicate"),
        F.count_if(F.col("_ok") & ~yr_ok).cast("bigint").alias("dropped_year"),
        F.count_if(F.col("_ok") & yr_ok).cast("bigint").alias("rows_kept"),
    )
