"""Vector code compression: product codes from a lexicographic trie.

Components become integers floor(256 x); a vector is cut into ``PARTS`` equal
consecutive parts, and each part is coded by the nearest of ``ENTRIES`` entries of its
position's codebook (squared Euclidean distance, ties to the lower index). Codebooks start
at the parts of the vectors with the smallest ids; a round assigns every part
and moves each used entry to floor(sum / count) of its parts.

Assignment, per task and part position: the distinct parts, with how often each occurs,
sorted lexicographically, are the leaves of a trie over the
dimensions. It is walked depth-first, children in blocks of ``BLOCK`` nodes: a
node adds its own dimension to the distances its prefix has gathered to all entries, so parts
with a common prefix share that work, and memory is one block per depth.
A leaf takes the argmin; weighted sums per entry leave the task. Spark adds them up, so a
round hands the driver at most PARTS * ENTRIES rows, and nothing is shuffled but these.

Defined cases: rows whose vector is null, or holds a null, NaN or infinite component,
are dropped, as is an empty one. So that sums stay exact in 64 bits, vectors with a component of
``LIMIT`` or more in size, or whose length is not that of the first kept vector (by id)
or no multiple of ``PARTS``, are dropped too. Fewer than ENTRIES kept vectors: as many entries. A null
vec_id is no seed but is coded; equal vec_ids order by their vector. Repeated rows count again. Other columns
are ignored. No kept vectors: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Components stay below this in size, so distances and a task's sums fit 64 bits.
LIMIT = 65_536.0
#: Trie nodes worked on at a time at each depth.
BLOCK = 512
#: Vectors whose tries are built together (memory only).
VECTORS = 20_000


class PartTrie:
    """Distinct parts of one position as a lexicographic trie."""

    def __init__(self, parts: np.ndarray):
        """``parts``: (rows, dimensions) integers."""
        order = np.lexsort(parts.T[::-1])
        rows = parts[order]
        differs = rows[1:] != rows[:-1]
        new = np.append(True, differs.any(axis=1))
        self.leaf_of = np.empty(len(parts), np.int64)
        self.leaf_of[order] = np.cumsum(new) - 1
        self.leaves = rows[new]
        self.weight = np.bincount(self.leaf_of, minlength=len(self.leaves))
        # the first dimension in which a leaf differs from the one before
        fork = np.append(0, differs[new[1:]].argmax(axis=1)) if len(self.leaves) > 1 else np.zeros(1, np.int64)
        #: first leaf of each node, by depth
        self.nodes = [np.flatnonzero(np.append(True, fork[1:] <= d)) for d in range(parts.shape[1])]

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each leaf."""
        code = np.empty(len(self.leaves), np.int64)
        error = np.empty(len(self.leaves), np.int64)
        depth = len(self.nodes)

        def walk(d: int, lo: int, hi: int, parent_of: np.ndarray | None, gathered: np.ndarray | None) -> None:
            """Nodes lo..hi of depth d, whose parents' distances are given."""
            first = self.nodes[d][lo:hi]
            distance = (self.leaves[first, d][:, None] - entries[None, :, d]) ** 2
            if gathered is not None:
                distance += gathered[parent_of]
            if d + 1 == depth:
                best = distance.argmin(axis=1)
                code[lo:hi], error[lo:hi] = best, distance[np.arange(len(best)), best]
                return
            below = self.nodes[d + 1]
            end = self.nodes[d][hi] if hi < len(self.nodes[d]) else len(self.leaves)
            child, last = np.searchsorted(below, [first[0], end])
            for c in range(child, last, BLOCK):
                e = min(c + BLOCK, last)
                walk(d + 1, c, e, np.searchsorted(first, below[c:e], side="right") - 1, distance)

        for at in range(0, len(self.nodes[0]), BLOCK):
            walk(0, at, min(at + BLOCK, len(self.nodes[0])), None, None)
        return code, error


def _integers(column: pa.Array, dimensions: int) -> np.ndarray:
    """(rows, PARTS, dimensions / PARTS) integers of a column of whole, finite vectors."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(x * SCALE).astype(np.int64).reshape(-1, PARTS, dimensions // PARTS)


def _vector_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= VECTORS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _sums(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's parts per (position, entry): number and sums."""
        parts, entries, width = books.shape
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for t in _vector_blocks(batches):
            x = _integers(t["embedding"].chunk(0), parts * width)
            for p in range(parts):
                trie = PartTrie(x[:, p])
                code, _ = trie.nearest(books[p])
                np.add.at(n[p], code, trie.weight)
                np.add.at(total[p], code, trie.leaves * trie.weight[:, None])
        position, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(position, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[position, entry]),
             pa.array(list(total[position, entry]), pa.list_(pa.int64()))], names=["position", "entry", "n", "sums"])
    return run


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        for t in _vector_blocks(batches):
            x = _integers(t["embedding"].chunk(0), parts * width)
            code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                trie = PartTrie(x[:, p])
                c, e = trie.nearest(books[p])
                code[:, p] = c[trie.leaf_of]
                error += e[trie.leaf_of]
            text = code.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [t["vec_id"].chunk(0), t["label"].chunk(0), pa.array([text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()),
                 pa.array(error)], names=["vec_id", "label", "code", "error"])
    return run


def kept_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows vec_id, label, embedding that take part, and their dimensions (0: none)."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < LIMIT))  # NaN is above every number
    v = vectors.select("vec_id", "label", "embedding").filter(
        F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & whole)
    first = v.select(F.size("embedding").alias("n"), "vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(1).collect()
    dimensions = first[0]["n"] if first else 0
    return v.filter(F.size("embedding") == dimensions), dimensions


def train(v: DataFrame, dimensions: int) -> np.ndarray:
    """(PARTS, entries, dimensions / PARTS) codebooks."""
    width = dimensions // PARTS
    seeds = v.filter("vec_id is not null").orderBy("vec_id", "embedding").limit(ENTRIES).select("embedding").toArrow()
    if not seeds.num_rows:  # no row has an id
        seeds = v.orderBy("embedding").limit(ENTRIES).select("embedding").toArrow()
    books = _integers(seeds["embedding"].combine_chunks(), dimensions).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        sums = v.select("embedding").mapInArrow(_sums(books), "position int, entry int, n long, sums array<bigint>")
        # sums beyond 64 bits stay exact
        sums = sums.groupBy("position", "entry").agg(
            F.sum(F.col("n").cast("decimal(38,0)")).alias("n"),
            F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(width)]).alias("sums"))
        for r in sums.collect():  # at most PARTS * ENTRIES rows
            books[r["position"], r["entry"]] = [int(s) // int(r["n"]) for s in r["sums"]]
    return books


def compress(vectors: DataFrame) -> DataFrame:
    """One row per kept vector: vec_id, label, code, error, label_error, codebooks_sha256."""
    v, dimensions = kept_vectors(vectors)
    if not dimensions:
        coded, digest = v.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), ""
    else:
        books = train(v, dimensions)
        digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
        fields = {f.name: f.dataType.simpleString() for f in v.schema}
        coded = materialize(v.mapInArrow(_codes(books), f"vec_id {fields['vec_id']}, label {fields['label']}, code string, error long"), "codes")
    by_label = coded.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_l"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assign_sql(n: int) -> str:
    """CTEs a<n>: (row_, pos, e, dist) under the codebooks b<n>."""
    return f"""a{n} as materialized (select row_, pos, unnest([arg_min(struct_pack(e := e, dist := dist), dist * 64 + e)], recursive := true)
        from (select x.row_, x.pos, b.e, sum((x.x - b.c) * (x.x - b.c)) as dist
              from x join b{n} b on b.pos = x.pos and b.i = x.i group by all) group by row_, pos)"""


def _update_sql(n: int) -> str:
    return f"""b{n + 1} as materialized (select b.pos, b.e, b.i, coalesce(m.c, b.c) as c from b{n} b left join (
        select x.pos, a.e, x.i, cast(floor(sum(x.x)::double / count(*)) as bigint) as c
        from x join a{n} a on a.row_ = x.row_ and a.pos = x.pos group by all) m on m.pos = b.pos and m.e = b.e and m.i = b.i)"""


ORACLE_SQL = f"""with v as materialized (select row_number() over (order by vec_id) as row_, vec_id, label, embedding, len(embedding) // {PARTS} as width
    from embeddings where embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
  f as (select row_, width, unnest(embedding) as y, generate_subscripts(embedding, 1) - 1 as k_ from v),
  x as materialized (select row_, k_ // width as pos, k_ % width as i, cast(floor({SCALE} * y::double) as bigint) as x from f),
  b0 as materialized (select pos, row_ - 1 as e, i, x as c from x where row_ <= {ENTRIES}),
  {_assign_sql(0)}, {_update_sql(0)}, {_assign_sql(1)}, {_update_sql(1)}, {_assign_sql(2)},
  h as (select sha256(string_agg(c::varchar, ',' order by pos, e, i)) as codebooks_sha256 from b2),
  o as (select row_, string_agg(printf('%02x', e), '' order by pos) as code, cast(sum(dist) as bigint) as error from a2 group by row_)
select v.vec_id, v.label, o.code, o.error, cast(sum(o.error) over (partition by v.label) as bigint) as label_error, h.codebooks_sha256
from v join o on o.row_ = v.row_, h"""
