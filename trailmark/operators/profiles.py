"""Transition profiles and their principal components (H7).

A profile is a state's outgoing count row plus 0.01, row-normalised. The
profile table has one row per state (a dimension, not data-sized): means and
covariance are aggregates over its cells, and only the n x n eigenproblem is
solved on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.exprs import major_group
from trailmark.operators import markov

PROFILE_SMOOTHING = 0.01
MAX_COMPONENTS = 5
MIN_STATES = 3


def profiles(transitions: DataFrame, space: DataFrame, smoothing: float = PROFILE_SMOOTHING) -> DataFrame:
    """(cur_idx, profile array of n)."""
    n = markov.n_states(space)
    c = markov.indexed_counts(transitions, space)
    rows = c.groupBy("cur_idx").agg(F.map_from_entries(F.collect_list(F.struct("nxt_idx", "v"))).alias("m"),
                                    F.sum("v").alias("t"))
    full = space.select(F.col("idx").alias("cur_idx")).join(rows, "cur_idx", "left").withColumn("_n", n)
    tot = F.coalesce(F.col("t"), F.lit(0.0)) + F.col("_n") * F.lit(smoothing)
    prof = F.transform(F.sequence(F.lit(0), F.col("_n") - 1),
                       lambda i: (F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)) + F.lit(smoothing)) / tot)
    return full.select("cur_idx", prof.alias("profile"))


def centred(prof: DataFrame) -> DataFrame:
    """(cur_idx, at, d): the profiles less the mean profile, cell by cell; n x n rows."""
    cells = prof.select("cur_idx", F.posexplode("profile").alias("at", "v"))
    means = cells.groupBy("at").agg(F.avg("v").alias("m"))
    return cells.join(means, "at").select("cur_idx", "at", (F.col("v") - F.col("m")).alias("d"))


def covariance(prof: DataFrame) -> DataFrame:
    """(a, b, cov): covariance of the profiles' places over the states, n x n cells."""
    d = centred(prof)
    other = d.select("cur_idx", F.col("at").alias("b"), F.col("d").alias("w"))
    n = prof.agg(F.count(F.lit(1))).scalar()
    return d.withColumnRenamed("at", "a").join(other, "cur_idx").groupBy("a", "b").agg((F.sum(F.col("d") * F.col("w")) / (n - 1)).alias("cov"))


def pca(transitions: DataFrame, space: DataFrame, k: int = MAX_COMPONENTS):
    """H7: principal components of the centred profiles. Returns (explained,
    coordinates): explained is (component 1..k, explained_pct to 1 decimal),
    padded with 0 to ``k`` rows; coordinates is (state, major_group,
    pc1..pck), each of mean 0, missing components 0. A component's sign makes
    its largest loading positive (ties: the first). Fewer than 3 states: both
    empty. The driver holds the n x n covariance (states, a dimension)."""
    spark = transitions.sparkSession
    prof = profiles(transitions, space)
    n = prof.count()
    cols = [f"pc{i + 1}" for i in range(k)]
    if n < MIN_STATES:
        e = spark.createDataFrame([], "component int, explained_pct double")
        c = spark.createDataFrame([], "state string, major_group string, " + ", ".join(f"{x} double" for x in cols))
        return e, c
    cells = covariance(prof).toArrow()
    matrix = np.zeros((n, n))
    matrix[cells["a"].to_numpy(), cells["b"].to_numpy()] = cells["cov"].to_numpy()
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    kk = min(k, n - 1)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1][:, :kk].T
    vectors = [v * np.sign(v[np.argmax(np.abs(v))]) for v in vectors]
    share = values[:kk] / (values.sum() or 1.0) * 100.0
    e = spark.createDataFrame([(i + 1, round(float(v), 1)) for i, v in enumerate([*share, *[0.0] * (k - kk)])],
                              "component int, explained_pct double")
    sp = space.select(F.col("idx").alias("cur_idx"), "state")
    loading = lambda v: F.get(F.array(*[F.lit(float(x)) for x in v]), F.col("at"))
    c = centred(prof).groupBy("cur_idx").agg(*[F.sum(F.col("d") * loading(v)).alias(cols[i]) for i, v in enumerate(vectors)],
                                             *[F.lit(0.0).alias(cols[i]) for i in range(kk, k)])
    c = c.join(sp, "cur_idx").select("state", major_group(F.col("state")).alias("major_group"), *cols)
    return e, c
