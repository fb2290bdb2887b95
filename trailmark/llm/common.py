"""Helpers shared by the operators of this subpackage: the shared scratch
folder, the word rule, and connected components over a link table."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.session import ensure_checkpoint_dir

#: A word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts
    the lineage, and lost executors do not lose it."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark).rstrip("/"), "llm", f"{name}-{uuid.uuid4().hex}")
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows: whole texts travel in them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """For the jobs run inside: Arrow batches of at most ``rows`` rows. The
    session's own setting holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_parts(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that few texts are
    Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def crc_mod(col: str, n: int):
    """crc32 of the column as text, modulo n (null: null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def text_slices(texts: Sequence[str | None], max_chars: int) -> Iterator[tuple[list[int], list[str]]]:
    """Slices of (row numbers, texts) with about ``max_chars`` characters each,
    so that working memory does not follow the batch. A longer text is handed
    out in consecutive parts cut after white space; nothing is left out."""
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        text = text or ""
        at = 0
        while True:
            end = len(text)
            if end - at > max_chars:
                end = at + max_chars
                while end < len(text) and not text[end - 1].isspace() and end - at < 2 * max_chars:
                    end += 1
            rows.append(i)
            parts.append(text[at:end])
            held += end - at
            at = end
            if held >= max_chars:
                yield rows, parts
                rows, parts, held = [], [], 0
            if at >= len(text):
                break
    if rows:
        yield rows, parts


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected link table: (node, root) with root
    the smallest node reachable; only nodes that have a link.

    Each round points every node at the smallest node among itself and its
    neighbours, then contracts the links by these pointers. The smallest node of
    a component always points at itself, so the contraction ends there. Sums and
    minima are aggregates (a hot node is collapsed before the shuffle); tables
    are written between the rounds, nothing goes to the driver but a count."""
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e = materialize(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    roots = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        p = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        p = materialize(p, "pointers")
        # one step of pointer jumping halves the depth of the forest
        up = p.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        p = p.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
        if roots is None:
            roots = p.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            step = p.select(F.col("u").alias("root"), F.col("p").alias("next"))
            roots = roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        roots = materialize(roots, "roots")
        pu = p.select(F.col("u"), F.col("p").alias("pu"))
        pv = p.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        e = e.join(pu, "u").join(pv, "v").filter("pu <> pv").select(
            F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        e = materialize(e, "links")
        if e.isEmpty():
            return roots
    raise RuntimeError("components did not settle")
