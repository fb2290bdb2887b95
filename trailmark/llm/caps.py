"""Embedding near-dedup with spherical-cap filters.

Vectors with equal labels are linked when their cosine (double precision) is at
least ``threshold``. Filter directions come from a structured random product
code: after a random rotation the dimensions are cut into two blocks with
``CODE`` random unit codewords each, and a filter is a pair of codewords, scored
by the sum of the two block products. A vector lies in the caps of all filters
that reach its own height, the score of its K-th best filter. List decoding finds
them from the two sorted lists of block products without visiting the CODE * CODE
filters: a pair of ranks (i, j) can only be among the K best if i * j <= K.
Vectors meet in the filters of their label, and pairs that meet are verified.

K comes from a simulation per dimension: the smallest of its steps at which all
of ``PROBES`` random pairs at exactly the threshold share at least ``SHARED``
caps (64 dimensions: K = 64, 33 shared on average, 8 at least).

Equal vectors of a label are one class before any of this: it is decoded and met
once, and its members' links are counted from the classes' sizes.

Under a filter the rows are met in order, in a stream. A sketch of 64 sign bits
discards chance meetings (at cosine 0.93 a bit differs with chance 0.12; more
than ``SKETCH_ERRORS`` differing bits has a chance below one in ten million);
distinct pairs are then verified on the vectors.

Defined cases: vectors that are null, zero, or hold null or non-finite
components, and vectors with a null label link with nothing; vectors of unequal
length never link; repeated rows (equal vec_id and vector) are one vector as to links, and
count as no link of their own; different vectors under one vec_id are in one
component, and their links are added up; a row with a null vec_id links with
nothing, has a null component_id and is kept; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import components, materialize

CODE = 192
PROBES = 1000
SHARED = 6
SKETCH_ERRORS = 23
#: Comparisons of sketches made at once (memory only).
STEP = 1_000_000
#: Rows under one filter that one task meets; hotter filters are cut into blocks.
HOT_ROWS = 8_192


@lru_cache(maxsize=8)
def product_code(dim: int, code: int = CODE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, codewords of block 1, of block 2) of a dimension."""
    rng = np.random.default_rng(dim)
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    words = []
    for n in (max(1, dim // 2), max(1, dim - dim // 2)):
        w = rng.standard_normal((code, n))
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True))
    return rotation, words[0], words[1]


def _block_scores(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rotation, first, second = product_code(unit.shape[1])
    turned = unit @ rotation
    half = turned.shape[1] // 2
    if half == 0:
        return np.zeros((len(turned), len(first))), turned @ second.T
    return turned[:, :half] @ first.T, turned[:, half:] @ second.T


def list_decode(unit: np.ndarray, k: int) -> np.ndarray:
    """The k best filters (numbers) of each vector, (vectors, k)."""
    a, b = _block_scores(unit)
    first, second = np.argsort(-a, axis=1, kind="stable"), np.argsort(-b, axis=1, kind="stable")
    i, j = (x.ravel() for x in np.indices((a.shape[1], b.shape[1])))
    i, j = i[(i + 1) * (j + 1) <= k], j[(i + 1) * (j + 1) <= k]
    left, right = first[:, i], second[:, j]
    scores = np.take_along_axis(a, left, axis=1) + np.take_along_axis(b, right, axis=1)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(left * b.shape[1] + right, best, axis=1)


@lru_cache(maxsize=8)
def postings(dim: int, threshold: float) -> int:
    """K for a dimension and threshold."""
    rng = np.random.default_rng(2000 + dim)
    most = CODE * CODE
    if dim < 2:
        return 1  # two directions only
    u, w = rng.standard_normal((2, PROBES, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    v = threshold * u + np.sqrt(1 - threshold ** 2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    k = 32
    while k < most:
        for at in range(0, PROBES, 50):
            a, b = list_decode(u[at:at + 50], k), list_decode(v[at:at + 50], k)
            if min(len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)) < SHARED:
                break
        else:
            return k
        k = min(most, k * 2 if k > 256 else k + 32)
    return most


@lru_cache(maxsize=4)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(1000 + dim).standard_normal((dim, 64))


def sketches(unit: np.ndarray) -> np.ndarray:
    """64 sign bits of random projections."""
    bits = (unit @ _planes(unit.shape[1]) > 0).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def vectors(rows: list, ids: list) -> tuple[list[int], np.ndarray]:
    """Row numbers and double-precision vectors of the valid rows of one length group."""
    ok, out = [], []
    for i, (v, k) in enumerate(zip(rows, ids, strict=True)):
        if v is None or k is None or not len(v) or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        if np.isfinite(x).all() and x.any():
            ok.append(i)
            out.append(x)
    return ok, out


UNIT = "id long, label string, dim int, unit binary"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors with a label, scaled to length 1."""
    for big in batches:
        for at in range(0, big.num_rows, 1000):
            b = big.slice(at, 1000)
            ids, labels = b.column("vec_id").to_pylist(), b.column("label").to_pylist()
            ok, vecs = vectors(b.column("embedding").to_pylist(), [k if lab is not None else None for k, lab in zip(ids, labels, strict=True)])
            units = []
            for x in vecs:
                # scaled first: very large or small components neither overflow nor vanish
                x = x / np.abs(x).max()
                units.append((x / np.linalg.norm(x)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in ok], pa.int64()), pa.array([labels[i] for i in ok], pa.string()),
                 pa.array([len(x) for x in vecs], pa.int32()), pa.array(units, pa.binary())], names=["id", "label", "dim", "unit"])


def _post(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sketch and filters of each class."""
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                b = big.slice(at, 1000)
                dims = b.column("dim").to_numpy()
                for dim in np.unique(dims):
                    part = b.filter(pa.array(dims == dim))
                    x = np.frombuffer(b"".join(part.column("unit").to_pylist())).reshape(-1, dim)
                    filters = list_decode(x, postings(int(dim), threshold))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("c"), part.column("label"), part.column("dim"), pa.array(sketches(x)),
                         pa.array([f.astype(np.int32) for f in filters], pa.list_(pa.int32()))],
                        names=["id", "label", "dim", "sketch", "filters"])
    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key. Pairs under one key with near sketches: each part
    of a key's rows against the key's rows before it and among itself. Of a key
    that is two blocks of a hot one, only rows of different blocks meet."""
    key = None
    ids = seen = sides = np.zeros(0, np.int64)
    for b in batches:
        keys, rows, sketch, side = (b.column(c).to_numpy() for c in ("key", "id", "sketch", "side"))
        if not len(keys):
            continue
        start = np.r_[True, keys[1:] != keys[:-1]]
        edges = np.flatnonzero(start)
        ends = np.r_[edges[1:], len(keys)]
        # keys of one row that neither came before nor are last here need no look
        busy = (ends - edges > 1) | (np.arange(len(edges)) == len(edges) - 1) | (np.arange(len(edges)) == 0)
        for s, e in zip(edges[busy], ends[busy], strict=True):
            if keys[s] != key:
                key, ids, seen, sides = keys[s], rows[:0], sketch[:0], side[:0]
            old = len(ids)
            ids, seen, sides = np.r_[ids, rows[s:e]], np.r_[seen, sketch[s:e]], np.r_[sides, side[s:e]]
            step = max(1, STEP // len(ids))
            for at in range(old, len(ids), step):
                mine = np.arange(at, min(len(ids), at + step))
                apart = np.bitwise_count(seen[mine].view(np.uint64)[:, None] ^ seen[:mine[-1] + 1].view(np.uint64)[None, :])
                near = (apart <= SKETCH_ERRORS) & (np.arange(mine[-1] + 1)[None, :] < mine[:, None])
                i, j = np.nonzero(near & ((sides[mine][:, None] < 0) | (sides[mine][:, None] != sides[:mine[-1] + 1][None, :])))
                x, y = ids[mine[i]], ids[j]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [float(np.frombuffer(x.as_py()) @ np.frombuffer(y.as_py())) >= threshold
                  for x, y in zip(b.column("unit"), b.column("unit_b"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes c, id, n, label, dim, unit; members id, c): vectors that are
    equal, up to their length, under one label. ``id`` is the smallest vec_id of the n."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                       F.col("embedding").alias("embedding"))
    units = materialize(rows.mapInArrow(_units, UNIT).distinct(), "caps-units")
    found = units.groupBy("label", "dim", "unit").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    found = materialize(found.withColumn("c", F.monotonically_increasing_id()), "caps-classes")  # fixed once written
    key = ["label", "dim", F.md5("unit").alias("k")]
    members = units.select("id", *key).join(found.select("c", *key), ["label", "dim", "k"]).select("id", "c")
    return found, materialize(members, "caps-members")


def links(found: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Distinct pairs (a, b), a < b, of linked classes.

    A key's rows are one group only up to ``HOT_ROWS``; a hotter key is cut into
    blocks by hash, and each pair of blocks is a group of its own."""
    posted = materialize(found.select("c", "label", "dim", "unit").mapInArrow(
        _post(threshold), "id long, label string, dim int, sketch long, filters array<int>"), "caps")
    cells = posted.select(F.explode("filters").alias("cell"), "label", "dim", "id", "sketch")
    cells = cells.select(F.xxhash64("label", "dim", "cell").alias("key"), "id", "sketch")
    hot = cells.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_ROWS) \
               .select("key", F.ceil(F.col("_n") / HOT_ROWS).cast("int").alias("_g"))
    cells = cells.join(materialize(hot, "caps-hot"), "key", "left")
    block = F.pmod(F.xxhash64("id", F.lit(7)), F.col("_g")).cast("int")
    pairs_of = F.when(F.col("_g").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda o: F.struct(F.least(block, o).alias("i"), F.greatest(block, o).alias("j"))))
    cells = cells.withColumn("_p", F.explode(pairs_of)).select(
        F.when(F.col("_g").isNull(), F.col("key")).otherwise(F.xxhash64("key", "_p.i", "_p.j")).alias("key"), "id", "sketch",
        F.when(F.col("_g").isNull() | (F.col("_p.i") == F.col("_p.j")), F.lit(-1)).otherwise(block).cast("long").alias("side"))
    pairs = cells.repartition("key").sortWithinPartitions("key").mapInArrow(_meet, "a long, b long").filter("a < b").distinct()
    left = found.select(F.col("c").alias("a"), "label", "dim", "unit")
    right = found.select(F.col("c").alias("b"), "label", "dim", F.col("unit").alias("unit_b"))
    full = pairs.join(left, "a").join(right, ["b", "label", "dim"])
    return full.select("a", "b", "unit", "unit_b").mapInArrow(_verify(threshold), "a long, b long").distinct()


def near_duplicates(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. Equal vectors are one class:
    its members link with each other and share the links of the class, so m copies cost as
    one vector."""
    found, members = classes(rows)
    pairs = materialize(links(found, threshold), "caps-links")
    size = found.select(F.col("c").alias("o"), F.col("n").alias("m"))
    both = pairs.select(F.col("a").alias("c"), F.col("b").alias("o")).union(pairs.select(F.col("b"), F.col("a")))
    counted = both.join(size, "o").groupBy("c").agg(F.sum("m").alias("others"))
    of_class = found.select("c", "id", "n").join(counted, "c", "left").select(
        "c", "id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    # a vec_id of several vectors holds their classes together
    first = members.groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("z")).filter("a <> z").select("id", "a")
    held = members.join(first, "id").filter("c <> a").select("a", F.col("c").alias("b"))
    roots = components(pairs.unionByName(held)).select(F.col("node").alias("c"), "root")
    rooted = of_class.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    rooted = rooted.join(smallest, "root").select("c", "n_links", "component_id")
    mine = members.join(rooted, "c").groupBy(F.col("id").alias("vec_id")).agg(
        F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    ids = rows.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = ids.join(mine, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
