"""H3: k-means with many restarts as one aggregate per iteration.

A task assigns its rows for all running restarts and sums what moves the centres;
``groupBy(restart, cluster)`` adds the tasks' sums up, so an iteration shuffles
tasks x restarts x k rows. The rows are written once before the first iteration: an
iteration reads them and runs nothing that they come from. A restart whose centres
stand still leaves the passes. The lowest cost wins (ties: the first restart); clusters are
numbered by their centres.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESTARTS = 25
MAX_ITER = 100
#: Rows from which the starting centres are drawn (the lowest hashes).
START_ROWS = 4_000
#: Rows assigned at once in a task (memory only).
CHUNK = 20_000


def standardised(df: DataFrame, features: Sequence[str], out: str = "x") -> DataFrame:
    """Adds ``out``: the features less their mean over their standard deviation
    (of the population; a constant feature is 0). Rows with a null feature go."""
    df = df.dropna(subset=list(features))
    stats = df.agg(F.struct(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f) for f in features]).alias("q")).scalar()
    return df.withColumn(out, F.array(*[F.when(stats[f]["s"] > 0, (F.col(f) - stats[f]["m"]) / stats[f]["s"]).otherwise(F.lit(0.0)) for f in features]))


def _centres(centres: np.ndarray) -> Column:
    if centres.ndim == 1:
        return F.array(*[F.lit(float(v)) for v in centres])
    return F.array(*[_centres(c) for c in centres])


def _nearest(centres: Column, width: int, x: str) -> Column:
    """struct(cost, cluster) of the nearest centre, ties to the lower number."""
    def cost(c):
        total = (F.col(x)[0] - c[0]) * (F.col(x)[0] - c[0])
        for i in range(1, width):
            total = total + (F.col(x)[i] - c[i]) * (F.col(x)[i] - c[i])
        return total
    return F.array_min(F.transform(centres, lambda c, i: F.struct(cost(c).alias("cost"), i.alias("cluster"))))


def assign(df: DataFrame, centres: Sequence[Sequence[float]], x: str = "x", out: str = "cluster") -> DataFrame:
    """Adds the number of the nearest centre, by squared distance."""
    centres = np.asarray(centres, float)
    return df.withColumn(out, _nearest(_centres(centres), centres.shape[1], x)["cluster"])


def _starts(x: DataFrame, key: str, k: int, restarts: int, seed: int) -> np.ndarray:
    """Starting centres of each restart: drawn one after the other from a
    bounded sample, with chances by the squared distance to those drawn."""
    rows = x.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(START_ROWS).select("x").collect()
    points = np.array([r["x"] for r in rows])
    out = []
    for r in range(restarts):
        rng = np.random.default_rng((seed, r))
        chosen = [points[rng.integers(len(points))]]
        for _ in range(k - 1):
            far = np.min([((points - c) ** 2).sum(1) for c in chosen], axis=0)
            chosen.append(points[rng.choice(len(points), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(points))])
        out.append(chosen)
    return np.array(out)


def _sums(centres: np.ndarray):
    """Per task and (restart, cluster): rows, cost and the sums that move the centre."""
    runs, k, width = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((runs, k, 2 + width))
        for b in batches:
            points = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for at in range(0, len(points), CHUNK):
                part = points[at:at + CHUNK]
                for r in range(runs):
                    # the square of each feature in turn, as ``assign`` adds them
                    far = sum((part[:, None, i] - centres[r, None, :, i]) ** 2 for i in range(width))
                    near = far.argmin(axis=1)  # ties to the lower number
                    total[r, :, 0] += np.bincount(near, minlength=k)
                    total[r, :, 1] += np.bincount(near, far[np.arange(len(part)), near], minlength=k)
                    for i in range(width):
                        total[r, :, 2 + i] += np.bincount(near, part[:, i], minlength=k)
        run_, cluster = np.nonzero(total[:, :, 0])
        held = total[run_, cluster]
        yield pa.RecordBatch.from_arrays([pa.array(run_, pa.int32()), pa.array(cluster, pa.int32()), *[pa.array(held[:, i]) for i in range(2 + width)]],
                                         names=["run", "cluster", "n", "cost", *[f"s{i}" for i in range(width)]])
    return run


def _pass(x: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(moved centres, costs) of the given restarts."""
    runs, k, width = centres.shape
    cells = ["n", "cost", *[f"s{i}" for i in range(width)]]
    sums = x.select("x").mapInArrow(_sums(centres), "run int, cluster int, " + ", ".join(f"{c} double" for c in cells)) \
        .groupBy("run", "cluster").agg(*[F.sum(c).alias(c) for c in cells]).collect()
    moved, cost = centres.copy(), np.zeros(runs)
    for r in sums:  # restarts x k rows; an empty cluster keeps its centre
        moved[r["run"], r["cluster"]] = [r[f"s{i}"] / r["n"] for i in range(width)]
        cost[r["run"]] += r["cost"]
    return moved, cost


def fit(x: DataFrame, key: str, k: int = 5, restarts: int = RESTARTS, max_iter: int = MAX_ITER, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(centres, cost of every restart) for rows with a column ``x``; no rows: no
    centres. Every iteration reads ``x`` again: pass a written table."""
    if x.isEmpty():
        return np.zeros((0, 0)), np.zeros(0)
    centres = _starts(x, key, k, restarts, seed)
    costs = np.full(restarts, np.inf)
    running = np.arange(restarts)
    for _ in range(max_iter):
        moved, cost = _pass(x, centres[running])
        costs[running] = cost
        still = np.abs(moved - centres[running]).max(axis=(1, 2)) > 1e-9
        centres[running] = moved
        running = running[still]
        if not len(running):
            break
    best = centres[int(np.argmin(costs))]
    return best[np.lexsort(best.T[::-1])], costs
