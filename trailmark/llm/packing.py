"""Best-fit packing by linear grouping.

Documents become pieces of at most ``capacity`` tokens (only longer documents
are cut; their remainder comes first). What the planner sees is the histogram of
piece lengths, at most ``capacity`` numbers whatever the corpus:

1. lengths above ``small`` are ordered and cut into groups of equal cardinality;
   within a group all are rounded up to its largest (several numbers of groups
   are tried, and the plan with the fewest sequences is taken);
2. with so few sizes, configurations (multisets of sizes that fill a sequence)
   are optimised: again and again the fullest configuration the stock allows
   (a knapsack over sizes) is used as often as the stock allows;
3. the slots of a configuration are filled with actual pieces of the group,
   which are no longer than the rounded size;
4. small pieces go, longest first, into the tightest room that still takes them,
   and the last ones into new sequences.

Plans are run lengths: ``n`` equal sequences are one row. The plan says for each
length which ranks (0, 1, ... within the length) go to which sequences and
offset; tasks look their pieces up in it. The rank of a piece is its chunk's
start (counts by length and chunk) plus its place in the chunk, so no task sees
all pieces of one length: a length has ``CHUNKS`` chunks, or one per
``CHUNK_ROWS`` pieces if that is more (the full pieces of a large corpus are
many and equally long). The driver holds capacity x ``CHUNKS`` numbers and one
for every ``CHUNK_ROWS`` pieces.

Defined cases: null or empty text is the end mark alone, one piece of 1 token;
repeated rows are packed each; doc_id may be null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import materialize

CAPACITY = 2048
CHUNKS = 64
CHUNK_ROWS = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_encoders: dict[str, object] = {}


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """Byte-level BPE over the ranks file at ``path`` (one per Python worker).
    The ids equal those of the JSON vocabulary of the same name in text without
    its added tokens; ``token_ids`` takes these too."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN,
                                            mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of the JSON vocabulary beside the ranks file (one read per
    Python worker): found in a text as they stand, they are one id."""
    key = path + "#added"
    if key not in _encoders:
        with open(os.path.splitext(path)[0] + ".json", encoding="utf-8") as f:
            found = json.load(f).get("added_tokens") or []
        for t in found:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError(f"added token {t['content']!r} is not matched as it stands")
        _encoders[key] = {t["content"]: t["id"] for t in found}
    return _encoders[key]


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of the JSON vocabulary of the ranks file at ``path``, in its default
    setting without the special tokens of a template: the text is split at the
    added tokens, leftmost and longest first, and the parts are encoded."""
    enc, added = encoder(path), added_tokens(path)
    if not any(t in text for t in added):
        return enc.encode_to_numpy(text, disallowed_special=())
    marks = "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))
    return np.concatenate([np.array([added[part]], np.uint32) if part in added else enc.encode_to_numpy(part, disallowed_special=())
                           for part in re.split(f"({marks})", text)])


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all full but the first."""
    first = n_ids % capacity or capacity
    if n_ids <= capacity:
        return [(0, n_ids)]
    return [(0, first), *[(s, capacity) for s in range(first, n_ids, capacity)]]


def tokenized_pieces(docs: DataFrame, vocab: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece, without the ids themselves but for their checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            ids = b.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, b.column("text"), strict=True):
                tokens = np.concatenate([token_ids(text.as_py() or "", vocab), end]).astype("<u4")
                for k, (start, length) in enumerate(cut(len(tokens), capacity)):
                    for col, v in zip(out, (doc_id, k, start, length, zlib.crc32(tokens[start:start + length])), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                                              *[pa.array(c, pa.int64()) for c in out[2:]]],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, PIECES)


class _Stock:
    """Pieces of the large lengths of one group, taken longest first."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, taken: np.ndarray):
        self.lengths, self.counts, self.taken = lengths, counts, taken
        self.left = int(counts.sum())

    def take(self, n: int) -> list[tuple[int, int, int]]:
        """Runs (length, first rank, count) of the next n pieces."""
        out = []
        for i, length in enumerate(self.lengths):
            k = min(n, int(self.counts[i]))
            if k:
                out.append((int(length), int(self.taken[length]), k))
                self.taken[length] += k
                self.counts[i] -= k
                n -= k
                self.left -= k
            if not n:
                break
        return out


def _groups(hist: np.ndarray, small: int, capacity: int, groups: int, taken: np.ndarray) -> list[tuple[int, _Stock]]:
    """Equal-cardinality groups of the lengths in (small, capacity), with the
    rounded size. A length may be shared by neighbouring groups."""
    lengths = np.arange(capacity - 1, small, -1)
    counts = hist[lengths]
    n = int(counts.sum())
    out = []
    share = max(1, -(-n // groups))
    ends = np.cumsum(counts)
    for a in range(0, n, share):
        b = min(n, a + share)
        own = np.clip(np.minimum(ends, b) - np.maximum(ends - counts, a), 0, None)
        held = own > 0
        out.append((int(lengths[held][0]), _Stock(lengths[held].copy(), own[held].copy(), taken)))
    return out


def _fullest(sizes: list[int], stock: list[int], capacity: int, first: int) -> list[int]:
    """How many of each size fill the capacity best, at least one of ``first``,
    within stock: bounded knapsack over the totals that can be reached."""
    best = {sizes[first]: (first,)}
    for i, size in enumerate(sizes):
        most = min(stock[i] - (i == first), capacity // size)
        for _ in range(most):
            more = {}
            for total, parts in best.items():
                t = total + size
                if t <= capacity and t not in best and t not in more:
                    more[t] = (*parts, i)
            if not more:
                break
            best.update(more)
    parts = best[max(best)]
    return [parts.count(i) for i in range(len(sizes))]


#: Numbers of groups that are tried; the plan with the fewest sequences is taken.
GROUPS = (50, 100, 200, 400, 800)


def plan(hist: np.ndarray, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> tuple[np.ndarray, int]:
    """The best of the grouped plans by ``grouped_plan``: the histogram is all
    they need, so trying several numbers of groups costs seconds at any scale."""
    return min((grouped_plan(hist, capacity, g) for g in groups), key=lambda p: p[1])


def grouped_plan(hist: np.ndarray, capacity: int, groups: int, small: int | None = None) -> tuple[np.ndarray, int]:
    """(rows, number of sequences) for a histogram of lengths 0..capacity. A row
    is (length, first rank, count, first sequence, per sequence, offset): ranks
    first..first+count-1 of the length go to consecutive sequences, ``per
    sequence`` to each, the first of them at ``offset``."""
    small = capacity // 4 if small is None else small
    taken = np.zeros(capacity + 1, np.int64)
    rows: list[tuple[int, int, int, int, int, int]] = []
    n_seq = int(hist[capacity])
    if n_seq:
        rows.append((capacity, 0, n_seq, 0, 1, 0))
    stocks = _groups(hist, small, capacity, groups, taken)
    sizes = [s for s, _ in stocks]
    rooms: dict[int, list[tuple[int, int, int]]] = {}  # room left -> runs (first sequence, count, offset)
    while any(st.left for _, st in stocks):
        left = [st.left for _, st in stocks]
        first = next(i for i, n in enumerate(left) if n)
        config = _fullest(sizes, left, capacity, first)
        times = min(n // k for n, k in zip(left, config, strict=True) if k)
        # sequences of this configuration, split wherever an actual length changes
        runs = [(n_seq, times, 0)]
        for i, k in enumerate(config):
            for _ in range(k):
                nxt = []
                queue = stocks[i][1].take(times)
                for first_seq, count, used in runs:
                    while count:
                        length, rank, n = queue[0]
                        m = min(n, count)
                        rows.append((length, rank, m, first_seq, 1, used))
                        nxt.append((first_seq, m, used + length))
                        first_seq, count = first_seq + m, count - m
                        queue[0] = (length, rank + m, n - m)
                        if n == m:
                            queue.pop(0)
                runs = nxt
        n_seq += times
        for first_seq, count, used in runs:
            rooms.setdefault(capacity - used, []).append((first_seq, count, used))
    for length in range(min(small, capacity - 1), 0, -1):
        left = int(hist[length])
        rank = 0
        while left:
            room = next((r for r in range(length, capacity + 1) if rooms.get(r)), None)
            if room is None:
                per = capacity // length
                fresh = -(-left // per)
                rooms.setdefault(capacity, []).append((n_seq, fresh, 0))
                n_seq += fresh
                room = capacity
            first_seq, count, used = rooms[room].pop()
            per = room // length
            whole = min(count, left // per)
            if whole:
                rows.append((length, rank, whole * per, first_seq, per, used))
                rooms.setdefault(room - per * length, []).append((first_seq, whole, used + per * length))
                rank, left = rank + whole * per, left - whole * per
            elif left:  # fewer than one sequence takes: all of them into it
                whole = 1
                rows.append((length, rank, left, first_seq, left, used))
                rooms.setdefault(room - left * length, []).append((first_seq, 1, used + left * length))
                rank, left = rank + left, 0
            if count > whole:
                rooms[room].append((first_seq + whole, count - whole, used))
    out = np.array(rows, np.int64).reshape(-1, 6)
    return out[np.lexsort((out[:, 1], out[:, 0]))], n_seq


def pack(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, chunk_rows: int = CHUNK_ROWS,
         end_id: int = 0) -> DataFrame:
    """All pieces with sequence_id and offset."""
    pieces = materialize(tokenized_pieces(docs, vocab or vocabulary(), capacity, end_id), "pieces")
    return place(pieces, capacity, groups, chunk_rows)


def place(pieces: DataFrame, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Pack pieces (doc_id, piece, start, length, ids_crc32). Read three times: give a written table."""
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        hist[r["length"]] = r["n"]
    chunks = np.maximum(CHUNKS, -(-hist // chunk_rows))
    first = np.cumsum(chunks) - chunks  # of each length, among the chunks of all
    own = F.get(F.array(*[F.lit(int(n)) for n in chunks]), F.col("length").cast("int"))
    rows = pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), own).cast("int"))
    counted = rows.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("n")).toArrow()
    sizes = np.zeros(int(chunks.sum()), np.int64)
    sizes[first[counted["length"].to_numpy()] + counted["_chunk"].to_numpy()] = counted["n"].to_numpy()
    starts = np.cumsum(sizes) - sizes
    starts -= np.repeat(starts[first], chunks)
    table, _ = plan(hist, capacity, groups)
    shared = pieces.sparkSession.sparkContext.broadcast((first, starts, table))
    place_in_chunk = Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("_r", F.row_number().over(place_in_chunk) - 1)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, starts, table = shared.value
        wide = 1 << 44
        keys = table[:, 0] * wide + table[:, 1]
        for b in batches:
            length = b.column("length").to_numpy()
            rank = starts[first[length] + b.column("_chunk").to_numpy()] + b.column("_r").to_numpy()
            row = table[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            place = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
                 pa.array(row[:, 3] + place // row[:, 4]), pa.array(row[:, 5] + place % row[:, 4] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows.mapInArrow(look_up, PIECES + ", sequence_id long, offset long")
