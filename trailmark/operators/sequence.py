"""Ordered sequences per entity: next / previous value and position.

The plain form is a window ``partitionBy(entity).orderBy(order)``: one
shuffle by entity, one sort, and every window function shares them. A window
partition is never split, so one entity holding a large share of all rows
would land in one task. Entities above ``hot_rows`` rows therefore take a
second path. Their order is cut at bounds taken from a sample of their rows;
the bounds are written to a table first, so that every branch of the plan
reads the same ones, and a row's chunk is an expression of its order key.
Neighbours and positions are computed inside each (entity, chunk), and the
chunk edges are stitched from a per-chunk summary.

Rows that are equal in ``order`` follow a hash of the whole row, in both
paths: the order is total and equal values are cut like any others.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.session import stage_root

DEFAULT_HOT_ROWS = 2_000_000
HOT_ROWS_SETTING = "spark.trailmark.sequence.hotRows"
#: Sampled rows per chunk from which the bounds are taken.
SAMPLED_PER_CHUNK = 24
#: Bounds per step of the two-step search for a row's chunk.
STEP = 64
#: Key lists and chunk summaries of at most so many rows are broadcast.
BROADCAST_ROWS = 10_000


def _cols(cs):
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def hot_row_limit(df: DataFrame, hot_rows: int | None) -> int:
    if hot_rows is not None:
        return int(hot_rows)
    return int(df.sparkSession.conf.get(HOT_ROWS_SETTING, str(DEFAULT_HOT_ROWS)))


def hot_keys(df: DataFrame, by: Sequence[str], hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and their count ``_n`` (partial
    aggregation, so a hot key costs one row per map task before the shuffle)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)


def fixed(df: DataFrame, name: str) -> DataFrame:
    """Write a small table once, so that all its readers see the same rows."""
    path = os.path.join(stage_root(df.sparkSession), "sequence", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _same(a: DataFrame, b: DataFrame, by: Sequence[str]) -> Column:
    """Null-safe key equality: a null entity is an entity."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in by])


def _row_hash(df: DataFrame) -> Column:
    flat = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    return F.xxhash64(*[F.col(c) for c in flat])


def ordered_sequence(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
                     lead: Mapping[str, str] | None = None,
                     lag: Mapping[str, str] | None = None,
                     position: str | None = None, weight: str | None = None,
                     hot_rows: int | None = None) -> DataFrame:
    """Add ``lead`` (out -> source column: value of the next row), ``lag``
    (value of the previous row) and ``position`` (rows before this one; with
    ``weight``, the sum of that column over them) within each ``by`` group under
    ``order`` (ties by a hash of the row).

    Use a stage table as input: it is read by the key count, and by both
    paths when a key is hot.
    """
    by = list(by)
    lead = dict(lead or {})
    lag = dict(lag or {})
    limit = hot_row_limit(df, hot_rows)
    hot = fixed(hot_keys(df, by, limit), "hot")
    n_hot = hot.count()
    if not n_hot:
        return _plain(df, by, order, lead, lag, position, weight)
    keys = _sized(hot, n_hot)
    cold = _plain(df.join(keys, _same(df, keys, by), "left_anti"), by, order, lead, lag, position, weight)
    warm = _chunked(df, keys, limit, by, order, lead, lag, position, weight)
    return cold.unionByName(warm)


def _before(w, weight):
    """Rows (or weight) of the window before the current row."""
    if weight is None:
        return (F.row_number().over(w) - 1).cast("long")
    return F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")


def _plain(df, by, order, lead, lag, position, weight=None):
    w = Window.partitionBy(*by).orderBy(*_cols(order), _row_hash(df))
    out = df
    for o, s in lead.items():
        out = out.withColumn(o, F.lead(s).over(w))
    for o, s in lag.items():
        out = out.withColumn(o, F.lag(s).over(w))
    if position:
        out = out.withColumn(position, _before(w, weight))
    return out


def _with_chunk(df: DataFrame, hot: DataFrame, limit: int, by: Sequence[str], okey: Column) -> DataFrame:
    """Rows of the hot keys with ``_chunk``: how many of their key's bounds are
    at or below the row's order key (coarse bounds first, then one step)."""
    key = [F.col(c) for c in by]
    hot = hot.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_n"))
    rows = df.withColumn("_o", okey).join(
        hot, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]))
    chunks = F.ceil(F.col("_n") * 2 / F.lit(max(1, limit)))
    draw = F.pmod(F.xxhash64("_o", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(draw * F.col("_n") < chunks * SAMPLED_PER_CHUNK)
    per = sample.groupBy(*key).agg(F.array_sort(F.collect_list("_o")).alias("_s"), F.max(chunks).alias("_k"))
    every = F.greatest(F.floor(F.size("_s") / F.col("_k")), F.lit(1))
    bounds = per.select(*key, F.filter("_s", lambda x, i: i % every == every - 1).alias("_b"))
    bounds = bounds.select(*key, "_b", F.filter("_b", lambda x, i: i % STEP == STEP - 1).alias("_top"))
    bounds = fixed(bounds, "bounds")
    n = bounds.count()
    bounds = _sized(bounds.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_b", "_top"), n)
    rows = rows.drop(*[f"_by{i}" for i in range(len(by))], "_n").join(
        bounds, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]), "left")
    under = lambda a: F.size(F.filter(a, lambda x: x <= F.col("_o")))
    rows = rows.withColumn("_t", F.coalesce(under(F.col("_top")), F.lit(0)))
    fine = F.slice(F.col("_b"), F.col("_t") * STEP + 1, F.lit(STEP))
    chunk = F.when(F.col("_b").isNull(), F.lit(0)).otherwise(F.col("_t") * STEP + under(fine))
    return rows.withColumn("_chunk", chunk.cast("int")).drop(
        "_b", "_top", "_t", "_o", *[f"_by{i}" for i in range(len(by))])


def _chunked(df, hot, limit, by, order, lead, lag, position, weight=None):
    ocols = [*_cols(order), _row_hash(df)]
    okey = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(ocols)])
    rows = _with_chunk(df, hot, limit, by, okey)
    wl = Window.partitionBy(*by, "_chunk").orderBy(*ocols)
    wc = Window.partitionBy(*by, "_chunk")
    local = (rows.withColumn("_rn", F.row_number().over(wl))
                 .withColumn("_cn", F.count(F.lit(1)).over(wc)).withColumn("_in", _before(wl, weight)))
    for o, s in lead.items():
        local = local.withColumn(o, F.lead(s).over(wl))
    for o, s in lag.items():
        local = local.withColumn(o, F.lag(s).over(wl))

    aggs = [(F.sum(weight) if weight else F.count(F.lit(1))).alias("_cnt")]
    if lead:
        aggs.append(F.min_by(F.struct(*[F.col(s).alias(o) for o, s in lead.items()]), okey)
                    .alias("_first"))
    if lag:
        aggs.append(F.max_by(F.struct(*[F.col(s).alias(o) for o, s in lag.items()]), okey)
                    .alias("_last"))
    ws = Window.partitionBy(*by).orderBy("_chunk")
    summary = rows.groupBy(*by, "_chunk").agg(*aggs)
    if lead:
        summary = summary.withColumn("_next_first", F.lead("_first").over(ws))
    if lag:
        summary = summary.withColumn("_prev_last", F.lag("_last").over(ws))
    summary = summary.withColumn(
        "_offset", F.coalesce(F.sum("_cnt").over(ws.rowsBetween(Window.unboundedPreceding, -1)),
                              F.lit(0)))
    edges = summary.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_chunk").alias("_ck"), "_offset",
                           *(["_next_first"] if lead else []), *(["_prev_last"] if lag else []))
    # one row per (hot entity, chunk); Spark's size check picks the join
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)])
    j = local.join(edges, on & (F.col("_chunk") == F.col("_ck")))
    for o in lead:
        j = j.withColumn(o, F.when(F.col("_rn") == F.col("_cn"), F.col("_next_first")[o])
                         .otherwise(F.col(o)))
    for o in lag:
        j = j.withColumn(o, F.when(F.col("_rn") == 1, F.col("_prev_last")[o])
                         .otherwise(F.col(o)))
    if position:
        j = j.withColumn(position, (F.col("_offset") + F.col("_in")).cast("long"))
    return j.drop("_chunk", "_ck", "_rn", "_cn", "_in", "_offset", "_next_first", "_prev_last",
                  *[f"_by{i}" for i in range(len(by))])


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    values: Sequence[str]) -> DataFrame:
    """Keep one row per ``keys``: the lowest under ``order``. An aggregate
    (``min`` of a struct led by the order), so partial aggregation collapses a
    large group of copies before the shuffle."""
    packed = F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                            *[F.col(c) for c in values])).alias("_first")
    return (df.groupBy(*keys).agg(packed)
              .select(*keys, *[F.col("_first")[c].alias(c) for c in values],
                      *[F.col("_first")[f"_o{i}"].alias(c) for i, c in enumerate(order)]))
