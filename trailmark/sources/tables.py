"""Parquet scans and journey inputs.

Readers return lazy DataFrames; Catalyst prunes columns and pushes filters
into the parquet scan, so callers select only what they use.
"""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Input schema of a journey table (one row per event).
EVENT_SCHEMA = T.StructType([
    T.StructField("person_id", T.LongType()),
    T.StructField("matched_label", T.StringType()),
    T.StructField("matched_description", T.StringType()),
    T.StructField("matched_code", T.StringType()),
    T.StructField("start_date", T.StringType()),
    T.StructField("university_studies", T.BooleanType()),
])

OPTIONAL_COLUMNS = ("matched_description", "university_studies")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def conform(df: DataFrame, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Check the input at the boundary: required columns must exist, optional
    ones are added as typed nulls, declared columns are cast to their type."""
    cols = set(df.columns)
    out = df
    for f in schema.fields:
        if f.name not in cols:
            if f.name in OPTIONAL_COLUMNS:
                out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
            else:
                raise ValueError(f"missing required column {f.name!r}")
        else:
            out = out.withColumn(f.name, F.col(f.name).cast(f.dataType))
    return out


def load_splits(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """A1: scan the split files that exist (train/validation/test), warn about
    missing ones, raise when none exist, stack the rows by column name."""
    frames = []
    for p in paths:
        if _exists(spark, p):
            frames.append(spark.read.parquet(p))
        else:
            warnings.warn(f"split file not found, skipped: {p}")
    if not frames:
        raise FileNotFoundError("no split file found")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journey fixture over the driver's TPC-H-like tables: one event per
    line item; person = customer, label = part name and brand, code from the
    part size, date from the order. Carries every awkward case the cleaning
    and labelling operators handle (blank and 'Unknown' labels, missing and
    'unknown' codes, undated rows, duplicates, a nullable flag)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # orders meet their customers first and parts come last: the texts of the
    # parts are in no shuffle of the line items
    univ = (F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(None).cast("boolean"))
             .otherwise(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD")))
    o = o.join(c.select("c_custkey", univ.alias("_univ")), o.o_custkey == c.c_custkey).drop("c_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    pk = F.col("p_partkey")
    label = (F.when(pk % 37 == 0, F.lit("Unknown"))
              .when(pk % 41 == 0, F.lit(" "))
              .otherwise(F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"))))
    desc = F.when(pk % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type"))
    code = (F.when(pk % 12 == 0, F.lit(None).cast("string"))
             .when(pk % 12 == 6, F.lit("unknown"))
             .otherwise(F.concat((F.lit(1000) + F.lit(150) * F.col("p_size")).cast("string"),
                                 F.lit("."), (pk % 20).cast("string"))))
    start = (F.when(F.col("l_linenumber") == 7, F.lit("n/a"))
              .otherwise(F.substring(F.col("o_orderdate").cast("string"), 1, 10)))
    out = j.select(
        F.col("o_custkey").alias("person_id"),
        label.alias("matched_label"),
        desc.alias("matched_description"),
        code.alias("matched_code"),
        start.alias("start_date"),
        F.col("_univ").alias("university_studies"),
        F.col("o_orderkey").alias("src_order"),
        F.col("l_linenumber").alias("src_line"),
        F.col("l_partkey").alias("src_part"),
        F.col("l_suppkey").alias("src_supp"),
    )
    return conform(out)


# Input order of the fixture rows (Spark has no file order): the first row
# of a duplicate group is the lowest of these.
JOB_EVENT_ORDER = ("src_order", "src_line", "src_part", "src_supp")
