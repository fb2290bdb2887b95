"""Mixing sources to target weights by weighted fair queueing (native).

Every source gets a target number of words (``source_targets``). A source's
documents are shuffled by a seeded digest of their id and taken in that order,
at most ``epochs`` times over. Copy k of a document finishes at the virtual time
(words of its source up to and including it) / target; sorting all copies of all
sources by that time interleaves the sources in proportion to their targets,
and the total budget is spent at virtual time 1, where the order is cut. The
copy that stands across the cut is taken when at least half of it lies before.

Prefix sums never see a whole source in one task: the digest order is cut into
equal ranges, words are summed per (source, range), the running sums over these
few rows are joined back, and only the rows of one range are ordered together.
There are ``SLICES`` ranges, or one per ``SLICE_ROWS`` rows if that is more, so a
source with most of the rows has about ``SLICE_ROWS`` rows in a range at any
size. The number of ranges does not change the result.

Defined cases: null or empty text has size 0 (its document is taken when its
point in the order lies before the cut); null source is a source of its own,
last in order; repeated rows are separate documents; an empty table gives no
rows; other columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import WORD

WEIGHTS = (3, 1, 2)
SLICES = 1024
SLICE_ROWS = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source, source_size, target) of a (source, size) table. Sources in code
    point order, null last, get the weights in turn; targets are proportional to
    weight, sum to ``share`` of all words, and stop at ``epochs`` times the
    source: with sources ordered by cap / weight, the level is the first one
    that does not lift its source above its cap. One row per source: the
    windows run over the pre-aggregated table."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]),
                     ((F.row_number().over(at) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w)
    per = per.withColumn("cap", F.lit(epochs).cast("long") * F.col("source_size"))
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").cast("binary").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    per = per.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(all_rows))
    per = per.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                         / F.sum("weight").over(rest))
    holds = F.col("level") * F.col("weight") <= F.col("cap")
    per = per.withColumn("_at", F.when(holds, F.row_number().over(by_cap)))
    per = per.withColumn("level", F.min_by("level", "_at").over(all_rows))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def _queued(docs: DataFrame, keep: list[str], seed: str, slices: int | None, share: float, epochs: int, weights) -> DataFrame:
    """``keep`` columns with size, source_size, target and the words of the
    source before the document in its shuffled order (``_before``)."""
    slices = slices or max(SLICES, -(-docs.count() // SLICE_ROWS))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], F.col("doc_id").alias("_id"),
                       F.col("source").alias("source"), n_words(F.col("text")).alias("size"), key.alias("_key"))
    rows = rows.withColumn("_slice", F.floor(F.conv(F.substring("_key", 1, 7), 16, 10).cast("long") * slices / (1 << 28)).cast("int"))
    # null-safe equality everywhere: a null source is a source
    rows = rows.withColumn("_src", F.struct("source"))
    sums = rows.groupBy("_src", "_slice").agg(F.sum("size").alias("_words"))
    per = source_targets(sums.select(F.col("_src.source").alias("source"), F.col("_words").alias("size")),
                         weights, share, epochs)
    ahead = Window.partitionBy("_src").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_src", "_slice", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_start"))
    starts = starts.join(per.select(F.struct("source").alias("_src"), "source_size", "target"), "_src")
    rows = rows.join(starts, ["_src", "_slice"])
    within = Window.partitionBy("_src", "_slice").orderBy("_key", "_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_before", F.col("_start") + F.sum("size").over(within) - F.col("size"))
    names = [F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)]
    return rows.select(*names, F.struct("size", "source_size", "target", "_before").alias("_q"))


def _copies(epochs: int) -> Column:
    """How many copies lie before the cut: copy k starts at k source sizes plus
    what is before the document, and is taken if its middle is within target."""
    q = F.col("_q")
    out = F.lit(0)
    for k in range(epochs):
        middle = q["_before"] + F.lit(k) * q["source_size"] + q["size"] / 2
        out = out + F.when(middle <= q["target"], 1).otherwise(0)
    return out


def mix(docs: DataFrame, seed: str = "mix", slices: int | None = None, share: float = 1.5, epochs: int = 2,
        weights=WEIGHTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words,
    repeats counted), copies and the virtual finish time of the first copy."""
    q = _queued(docs, ["doc_id"], seed, slices, share, epochs, weights)
    return (q.withColumn("copies", _copies(epochs)).select(
        "doc_id", F.col("_q.size").alias("size"), F.col("_q.source_size").alias("source_size"),
        F.col("_q.target").alias("target"), (F.col("copies") * F.col("_q.size")).cast("long").alias("taken"),
        "copies", F.when(F.col("_q.target") > 0, (F.col("_q._before") + F.col("_q.size")) / F.col("_q.target"))
        .alias("finish")))


def mixed_documents(docs: DataFrame, seed: str = "mix", slices: int | None = None, share: float = 1.5, epochs: int = 2,
                    weights=WEIGHTS) -> DataFrame:
    """The mix itself: the input's rows, each as often as it is taken, in the
    order of virtual finish times (a global range sort)."""
    cols = docs.columns
    packed = docs.select(F.struct(*[F.col(c) for c in cols]).alias("_row"),
                         *[F.col(c) for c in ("doc_id", "text", "source")])
    q = _queued(packed, ["_row"], seed, slices, share, epochs, weights).withColumn("_n", _copies(epochs))
    q = q.filter("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    words = F.col("_q._before") + F.col("_k") * F.col("_q.source_size") + F.col("_q.size")
    q = q.withColumn("_finish", F.when(F.col("_q.target") > 0, words / F.col("_q.target")).otherwise(0.0))
    return q.orderBy("_finish").select(*[F.col("_row")[c].alias(c) for c in cols])
