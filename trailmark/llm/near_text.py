"""MinHash near-dedup by a multi-index Hamming join.

Words are lower-cased (A-Z) runs of non-blanks; a document's set holds its
distinct shingles of ``width`` words, 2 by default (fewer words: the whole sequence
as one). Documents are linked when 100 * |intersection| >= ``percent`` * |union| of the full sets.

1. Documents with the same word sequence form a class; one represents it.
2. A representative's signature is ``SYMBOLS`` b-bit minhashes. Signatures that
   differ in at most ``2 * CHUNKS - 1`` symbols agree, by the pigeonhole rule, in
   some chunk up to one symbol. So every chunk is posted once per allowed error
   place, with that symbol left out: all pairs within the signature distance
   meet under a key. (At a Jaccard value of 0.8, 100 symbols differ in 20 on
   average with deviation 4; more than 39 is about 3 in a million.)
3. Under each key the rows are met in order, in a stream, never as a group in
   memory. First come ``ROUNDS`` rounds of stars: every row is compared with the
   first row of its keys (by a 64-bit sketch of the signature), the nearest one is
   confirmed on the full sets, and confirmed links merge components; a large group
   of copies is one component then, with one pair a row. The rows that still share
   a key with another component are completed exactly: of two sets that similar,
   the rarest shingles of one (a prefix of its set in order of frequency) hold one
   of the other's, at places that leave room for the needed intersection. Rows of
   different components that meet so are confirmed on the full sets. So no link
   between components is lost, and no group is expanded into all its pairs, nor is
   a family of texts that merely share a long passage.
4. Components run over confirmed links only.

Defined cases: null or empty text, or text without words: empty set, linked
with nothing, kept; repeated rows are documents of one class, and all rows with
the kept doc_id are kept; null doc_id: the row has no number to be linked by, so
component_id is null and it is kept; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import components, materialize, small_batches

CHUNKS = 20
CHUNK = 5
SYMBOLS = CHUNKS * CHUNK
#: Sketch bits that may differ: at a Jaccard value of 0.8 they differ with chance
#: 0.1 each, so more than 22 of 64 has a chance below one in ten million.
SKETCH_ERRORS = 22
ROUNDS = 3
#: Shingle frequencies are counted in so many hash buckets (any order is exact, this one is selective).
BUCKETS = 1 << 18
#: Bytes of text worked on at once, rows of texts or sets sent to a worker at
#: once, and pairs handed on at once (memory only).
SLICE_BYTES = 2_000_000
ROWS = 250
PAIRS = 100_000

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(2_048)
_MULTIPLIERS = _rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32) | np.uint32(1)
_MASKS = _rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p)


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_UP, _DOWN = _powers(0, _BASE), _powers(0, _INVERSE)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, in order, and the
    number of words of each. A text beyond the working size is read in parts cut
    after a blank."""
    words, counts = [], []
    for t in texts if max(map(len, texts), default=0) > SLICE_BYTES else ():
        parts, at = [], 0
        while at < len(t):
            cut = _BLANK.search(t, at + SLICE_BYTES)
            end = cut.end() if cut else len(t)
            parts.append(_hashes([t[at:end]])[0])
            at = end
        words.extend(parts)
        counts.append(sum(map(len, parts)))
    if counts:
        return np.concatenate([np.zeros(0, np.uint64), *words]), np.array(counts)
    return _hashes(texts)


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A word's hash is a difference of running sums of byte * base**place,
    shifted back to place 0: no loop over words."""
    global _UP, _DOWN
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if len(data) > len(_UP):
        _UP, _DOWN = _powers(len(data) + 1024, _BASE), _powers(len(data) + 1024, _INVERSE)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * _UP[:len(low)])])
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = mixed((sums[last] - sums[first]) * _DOWN[first] + (last - first).astype(np.uint64) * _ODD)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(first, ends)]))
    return words, counts


def shingles(words: np.ndarray, counts: np.ndarray, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles of each text as sorted hashes, and their number."""
    counts = counts.astype(np.int64)
    n = len(words)
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.cumsum(counts) - counts
    left = counts[owner] - (np.arange(n) - starts[owner])  # words from here to the text's end
    h, full, parts, owners = words, left >= width, [], []
    for j in range(1, width + 1):
        # a text of j words, fewer than a shingle's, is one by itself
        short = np.flatnonzero(counts == j) if j < width else np.zeros(0, np.int64)
        parts.append(mixed(h[starts[short]] + np.uint64(j)))
        owners.append(short)
        if j < width and n:
            h = mixed(h * _ODD + np.roll(words, -j))
    # shingles of one word are the words themselves
    h = np.concatenate([h[full] if width > 1 else mixed(words), *parts])
    o = np.concatenate([owner[full], *owners])
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], np.bincount(o[new], minlength=len(counts))


def class_digests(words: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """128-bit digest of each word sequence (None: no words)."""
    ends = np.cumsum(counts)
    return [hashlib.blake2b(words[e - c:e].tobytes(), digest_size=16).digest() if c else None
            for e, c in zip(ends, counts, strict=True)]


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, SYMBOLS) minhash values; texts without shingles are not given."""
    starts = np.cumsum(sizes) - sizes
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sizes), SYMBOLS), np.uint32)
    for i in range(SYMBOLS):
        y = x ^ _MASKS[i]
        y *= _MULTIPLIERS[i]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[:, i] = np.minimum.reduceat(y, starts)
    return out


def posting_keys(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, SYMBOLS) keys, one per chunk and left-out place, and the 64-bit
    sketch (a bit of each of the first 64 symbols)."""
    sym = mixed((sig.astype(np.uint64) << np.uint64(8)) + np.arange(SYMBOLS, dtype=np.uint64)).reshape(-1, CHUNKS, CHUNK)
    # sums of position-salted symbols: leaving one out is a subtraction
    places = (np.arange(CHUNKS)[:, None] * CHUNK + np.arange(CHUNK)).astype(np.uint64)
    keys = mixed(sym.sum(axis=2, keepdims=True) - sym + mixed(places + np.uint64(77)))
    bits = (sym.reshape(-1, SYMBOLS)[:, :64] >> np.uint64(40)) & np.uint64(1)
    sketch = (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return keys.reshape(-1, SYMBOLS), sketch


def _byte_slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    at, held, start = [], 0, 0
    for i, t in enumerate(column):
        b = (t.as_py() or "").encode("utf-8", "surrogatepass")
        at.append(b)
        held += len(b)
        if held >= SLICE_BYTES:
            yield start, at
            at, held, start = [], 0, i + 1
    if at:
        yield start, at


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, class digest, set size and signature of each text."""
        for b in batches:
            ids = b.column("doc_id")
            for start, texts in _byte_slices(b.column("text")):
                words, counts = word_hashes(texts)
                sets, sizes = shingles(words, counts, width)
                sig = np.zeros((len(texts), SYMBOLS), np.uint32)
                some = sizes > 0
                if some.any():
                    sig[some] = signatures(sets, sizes[some])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, len(texts)), pa.array(class_digests(words, counts), pa.binary()),
                     pa.array(sizes.astype(np.int64)),
                     pa.array([s.tobytes() if ok else None for s, ok in zip(sig, some, strict=True)], pa.binary())],
                    names=["doc_id", "class", "n_shingles", "sig"])
    return run


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(-1, SYMBOLS)
            keys, sketch = posting_keys(sig)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part.column("id").to_numpy(), SYMBOLS)),
                 pa.array(np.repeat(sketch, SYMBOLS).view(np.int64))], names=["key", "id", "sketch"])


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key. Passes on the rows of keys that more than one row
    has; the last row of a batch waits for the next one."""
    held = None
    before = False  # whether the waiting row's key had a row before it
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        key = b.column("key").to_numpy()
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        more = np.diff(np.r_[at, len(key)]) > 1
        more[0] |= before
        out = np.repeat(more, np.diff(np.r_[at, len(key)]))
        out[-1] = False
        held, before = b.slice(b.num_rows - 1), bool(more[-1])
        yield b.filter(pa.array(out))
    if held is not None and before:
        yield held


def _to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, root, id). Each row against the first row of its
    key, if that is of another component and the sketches are near."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key, row, root, sketch = (b.column(c).to_numpy() for c in ("key", "id", "root", "sketch"))
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        first = [x[at].copy() for x in (row, root, sketch)]
        if last is not None and last[0] == key[0]:
            for x, v in zip(first, last[1:], strict=True):
                x[0] = v
        run = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(key)]))
        last = (key[-1], *[x[-1] for x in first])
        apart = np.bitwise_count(sketch.view(np.uint64) ^ first[2][run].view(np.uint64))
        near = (root != first[1][run]) & (apart <= SKETCH_ERRORS)
        if near.any():
            yield pa.RecordBatch.from_arrays([pa.array(row[near]), pa.array(first[0][run][near]),
                                              pa.array(apart[near].astype(np.int32))], names=["id", "first", "apart"])


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for x in b.column("set"):
            total += np.bincount((np.frombuffer(x.as_py(), np.uint64) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def _prefixes(percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rarest shingles of each set with their place (from 1)."""
        frequency = counts.value
        for b in batches:
            cols = [[np.zeros(0, np.uint64)], [], [], [], []]
            for row, root, x in zip(b.column("id").to_pylist(), b.column("root").to_pylist(), b.column("set"), strict=True):
                x = np.frombuffer(x.as_py(), np.uint64)
                n = len(x)
                x = x[np.lexsort((x, frequency[(x & np.uint64(BUCKETS - 1)).astype(np.int64)]))][:n + 1 + (-percent * n // 100)]
                for col, v in zip(cols, (x, *(np.full(len(x), v) for v in (row, root, n)), np.arange(1, len(x) + 1)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(cols[0]).view(np.int64)), *[pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in cols[1:]]],
                names=["token", "id", "root", "n", "place"])
    return run


def _prefix_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (token, root). A row meets the rows of the token's
        earlier components only, so the work is that of the pairs across."""
        token = root = None
        none = [np.zeros(0, np.int64)] * 3
        met, own = none, none  # ids, sizes, places
        for b in batches:
            if not b.num_rows:
                continue
            tokens, rows, roots, sizes, places = (b.column(c).to_numpy() for c in ("token", "id", "root", "n", "place"))
            edges = np.flatnonzero(np.r_[True, (tokens[1:] != tokens[:-1]) | (roots[1:] != roots[:-1])])
            a_out, b_out, held = [], [], 0
            for s, e in zip(edges, np.r_[edges[1:], len(tokens)], strict=True):
                if tokens[s] != token:
                    token, root, met, own = tokens[s], roots[s], none, none
                elif roots[s] != root:
                    root, met, own = roots[s], [np.concatenate(x) for x in zip(met, own, strict=True)], none
                step = max(1, PAIRS // max(1, len(met[0])))
                for at in range(s, e, step) if len(met[0]) else ():
                    end = min(e, at + step)
                    n, o = sizes[at:end, None], met[1][None, :]
                    needed = -(-percent * (n + o) // (100 + percent))
                    room = 1 + np.minimum(n - places[at:end, None], o - met[2][None, :])
                    i, j = np.nonzero((room >= needed) & (100 * np.minimum(n, o) >= percent * np.maximum(n, o)))
                    a_out.append(np.minimum(met[0][j], rows[at + i]))
                    b_out.append(np.maximum(met[0][j], rows[at + i]))
                    held += len(i)
                    if held >= PAIRS:
                        yield _pairs(a_out, b_out)
                        a_out, b_out, held = [], [], 0
                own = [np.concatenate(x) for x in zip(own, (rows[s:e], sizes[s:e], places[s:e]), strict=True)]
            if held:
                yield _pairs(a_out, b_out)
    return run


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id")
            for start, texts in _byte_slices(b.column("text")):
                sets, sizes = shingles(*word_hashes(texts), width)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, len(texts)), pa.array([sets[e - n:e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())],
                    names=["id", "set"])
    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                # both are sorted sets
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def full_sets(ids: DataFrame, texts: DataFrame, width: int = 2) -> DataFrame:
    """(id, set) of the given ids; ``texts`` has (id, text)."""
    with small_batches(ids.sparkSession, ROWS):
        return materialize(texts.join(ids.select("id"), "id", "left_semi").mapInArrow(_sets(width), "id long, set binary"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets pass."""
    rows = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    rows = rows.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    with small_batches(pairs.sparkSession, ROWS):
        return materialize(rows.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long"), "confirmed")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 2) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    spark = docs.sparkSession
    with small_batches(spark, ROWS):
        described = materialize(docs.mapInArrow(_describe(width), "doc_id long, class binary, n_shingles long, sig binary"), "signatures")
    # one document per class of equal word sequences stands for it
    classes = described.filter("doc_id is not null and class is not null").groupBy("class").agg(
        F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = materialize(classes, "classes")
    postings = classes.select("id", "sig").mapInArrow(_post, "key long, id long, sketch long")
    met = materialize(postings.repartition("key").sortWithinPartitions("key").mapInArrow(
        _shared_keys, "key long, id long, sketch long"), "met")
    texts = docs.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi") \
                .select(F.col("doc_id").alias("id"), "text")
    # sets of the rows that meet any other, once: all confirmations read them
    sets = full_sets(met.select("id").distinct(), texts, width)
    links = tried = roots = None
    for n in range(ROUNDS):
        rows = _open_rows(met, roots)
        stars = rows.repartition("key").sortWithinPartitions("key", "root", "id").mapInArrow(_to_first, "id long, first long, apart int")
        stars = stars.groupBy("id", "first").agg(F.min("apart").alias("apart")).select(
            "id", "apart", F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b"))
        if tried is not None:
            stars = stars.join(tried, ["a", "b"], "left_anti")
        best = stars.groupBy("id").agg(F.min(F.struct("apart", "a", "b")).alias("s")).select("s.a", "s.b").distinct()
        best = materialize(best, "stars")
        tried = best if tried is None else tried.unionByName(best)
        found = confirmed(best, sets, percent)
        links = found if links is None else links.unionByName(found)
        roots = components(links)
    rest = materialize(_open_rows(met, roots).select("id", "root").distinct(), "rest")
    left = sets.join(rest, "id")
    with small_batches(spark, ROWS):
        counted = left.select("set").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        frequency = np.zeros(BUCKETS, np.int64)
        frequency[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
        shared = spark.sparkContext.broadcast(frequency)
        rare = left.mapInArrow(_prefixes(percent, shared), "token long, id long, root long, n long, place long")
        rare = materialize(rare, "rare")
    shared.destroy()
    pairs = rare.repartition("token").sortWithinPartitions("token", "root").mapInArrow(_prefix_pairs(percent), "a long, b long")
    pairs = materialize(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "across")
    more = confirmed(pairs, sets, percent)
    roots = components(links.unionByName(more)).select(F.col("node").alias("id"), F.col("root"))
    of_class = classes.select("class", "id").join(roots, "id", "left").select("class", F.coalesce("root", "id").alias("_root"))
    out = described.select("doc_id", "class", "n_shingles").join(of_class, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _open_rows(met: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows with their component, of the keys that hold more than one component."""
    if roots is None:
        return met.withColumn("root", F.col("id"))
    rooted = met.join(roots.select(F.col("node").alias("id"), "root"), "id", "left") \
                .select("key", "id", "sketch", F.coalesce("root", "id").alias("root"))
    rooted = materialize(rooted, "rooted")
    keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    return materialize(rooted.join(keys, "key", "left_semi"), "open")


def keep_one(docs: DataFrame, percent: int = 80, width: int = 2) -> DataFrame:
    """The rows (all columns) of one document of each group: its smallest
    doc_id, of repeated rows (equal doc_id and text) one; different texts under
    one doc_id are different documents, and each stays if that doc_id is the
    group's; rows without doc_id stay."""
    kept = near_duplicates(docs, percent, width).filter("kept and doc_id is not null").select(F.col("doc_id").alias("doc_id")).distinct()
    numbered = docs.filter("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return numbered.join(kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
