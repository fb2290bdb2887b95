"""Benchmark decontamination with an FM-index per training shard.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A
window is ``WIDTH`` consecutive words of a benchmark item (an item of fewer
words, but not none, is one window). A document word inside any occurrence of a
window is hit.

1. The distinct (window, item) pairs are a written table. Their number decides
   how many blocks they are dealt into by hash; a block is at most about
   ``BLOCK_PAIRS`` pairs, so what is broadcast and sent to the driver is bounded
   whatever the benchmark's size.
2. A shard is at most 2**20 symbols of consecutive documents of a task: a number per
   word of the block, one number for a run of any other words, one end mark
   per text. Equal texts of a shard are indexed once; a longer text is several
   units that overlap by a window less one word. Suffixes are sorted by prefix
   doubling (only what is still tied is sorted again), the Burrows-Wheeler
   transform is kept as a wavelet matrix, one bit vector with counted words per
   level, and every ``SAMPLE``-th suffix position is kept.
3. All windows are searched backwards together, one word a step; a window whose
   range is empty leaves. The rows of the ranges that remain are located by
   walking back to a sampled position, and give the document's word spans, which
   are merged, and the items.

With one block the operator is a single pass without shuffle. With more, spans and items
depend on the text alone, so they are united per text digest and joined to the documents.

Defined cases: null or empty text, or text without words: no words, nothing hit;
items without words have no windows; an item with null item_id marks words but
has no id to be counted by; repeated item_ids are one item with the windows of
all its rows; repeated documents each give a row; an empty table of documents
gives no rows, an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import materialize, small_parts

WIDTH = 10
#: (window, item) pairs searched at a time.
BLOCK_PAIRS = 400_000
#: Symbols of a shard: a rank and a position are 20 bits each of a sort key.
POSITION_BITS = 20
SHARD = 1 << POSITION_BITS
_PLACE = SHARD - 1
SAMPLE = 8
#: Occurrences located at a time, bytes of text split at a time (memory only).
LOCATED = 1 << 18
SLICE_BYTES = 4_000_000

#: Blank for every byte that is no letter, digit or part of a non-ASCII character; A-Z lowered.
_WORDS = bytes(i if i >= 0x80 or 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A else i + 32 if 0x41 <= i <= 0x5A else 32 for i in range(256))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in parts cut between words."""
    rest = b""
    for at in range(0, len(text), SLICE_BYTES):
        part = rest + text[at:at + SLICE_BYTES].translate(_WORDS)
        cut = part.rfind(b" ") + 1
        yield part[:cut].split()
        rest = part[cut:]
    yield rest.split()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, text in zip(b.column("item").to_pylist(), b.column("text"), strict=True):
            words = [w for part in words_of(text.as_py() or b"") for w in part]
            for at in range(0, max(0, len(words) - WIDTH) + 1 if words else 0, 10_000):
                found = {b" ".join(words[i:i + WIDTH]) for i in range(at, min(at + 10_000, max(1, len(words) - WIDTH + 1)))}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([item] * len(found), pa.string())],
                                                 names=["window", "item"])


def suffix_array(text: np.ndarray, symbol_bits: int) -> np.ndarray:
    """Sorted suffixes of ``text`` (symbol 0 is an end mark; equal suffixes up to
    an end mark are ordered by place; the last symbol is an end mark)."""
    n = len(text)
    place = np.arange(n, dtype=np.int64)
    h = max(1, (63 - POSITION_BITS) // symbol_bits)
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(h):
        symbol = np.zeros(n, np.int64)
        symbol[:max(0, n - i)] = text[i:]
        symbol[~open_] = 0  # nothing after an end mark takes part
        key = key << symbol_bits | symbol
        open_ &= symbol != 0
    key = np.sort(key << POSITION_BITS | place)
    order = key & _PLACE
    key >>= POSITION_BITS
    new = np.ones(n, bool)
    # keys that hold an end mark are settled by place
    new[1:] = (key[1:] != key[:-1]) | ~open_[order[1:]]
    rank = np.empty(n, np.int64)
    start = np.maximum.accumulate(np.where(new, place, 0))
    rank[order] = start
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        at = order[tied]
        key = np.sort((rank[at] << POSITION_BITS | rank[at + h]) << POSITION_BITS | at)
        at = key & _PLACE
        key >>= POSITION_BITS
        order[tied] = at
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    return order


class Bits:
    """Bit vector with constant-time counts."""

    def __init__(self, bits: np.ndarray):
        self.words = np.zeros((len(bits) >> 6) + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        self.words.view(np.uint8)[:len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class FMIndex:
    """Backward search and location over ``text`` of symbols below ``2**symbol_bits``."""

    def __init__(self, text: np.ndarray, symbol_bits: int, starts: np.ndarray):
        """``starts``: places of the first symbols of the units; they are kept
        as samples, so no walk passes an end mark."""
        n = len(text)
        suffixes = suffix_array(text, symbol_bits)
        last = text[suffixes - 1]
        self.n = n
        self.levels, self.zeros = [], []
        for level in reversed(range(symbol_bits)):
            bit = (last >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(n - bit.sum()))
            last = np.concatenate([last[~bit], last[bit]])
        self.symbol_bits = symbol_bits
        counts = np.bincount(text, minlength=1 << symbol_bits)
        self.first = np.cumsum(counts) - counts
        self.base = self._down(np.arange(1 << symbol_bits), np.zeros(1 << symbol_bits, np.int64))
        sampled = suffixes % SAMPLE == 0
        is_start = np.zeros(n, bool)
        is_start[starts] = True
        sampled |= is_start[suffixes]
        self.sampled = Bits(sampled)
        self.places = suffixes[sampled]

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(i)
            i = np.where(symbol >> (self.symbol_bits - 1 - k) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in the transform before row i."""
        return self._down(symbol, i) - self.base[symbol]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the windows that occur, first rows, ends). A row of
        ``windows`` is padded on the left with -1."""
        at = np.arange(len(windows))
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        for step in reversed(range(windows.shape[1])):
            symbol = windows[at, step]
            go = symbol >= 0
            if not go.any():
                break
            s = symbol[go]
            lo[go] = self.first[s] + self.rank(s, lo[go])
            hi[go] = self.first[s] + self.rank(s, hi[go])
            some = hi > lo
            at, lo, hi = at[some], lo[some], hi[some]
        return at, lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text places of the suffixes at the given rows."""
        out, steps, left = np.empty(len(row), np.int64), np.zeros(len(row), np.int64), np.arange(len(row))
        while len(left):
            done = self.sampled.get(row)
            out[left[done]] = self.places[self.sampled.rank(row[done])] + steps[left[done]]
            left, row = left[~done], row[~done]
            steps[left] += 1
            # one step back: the row's symbol and its count, level by level
            i, symbol = row, np.zeros(len(row), np.int64)
            for bits, zeros in zip(self.levels, self.zeros, strict=True):
                one = bits.get(i)
                ones = bits.rank(i)
                symbol = symbol << 1 | one
                i = np.where(one, zeros + ones, i - ones)
            row = self.first[symbol] + i - self.base[symbol]
        return out


class Patterns:
    """A block of distinct (window, item) pairs, ready to search."""

    def __init__(self, pairs: pa.Table):
        windows, items = pairs["window"].to_pylist(), pairs["item"].to_pylist()
        of: dict[bytes, int] = {}
        self.window_of = np.array([of.setdefault(w, len(of)) for w in windows], np.int64)
        self.items = items
        order = np.argsort(self.window_of, kind="stable")
        self.pairs_of = np.split(order, np.flatnonzero(np.diff(self.window_of[order])) + 1) if len(order) else []
        self.number: dict[bytes, int] = {}
        split = [w.split(b" ") for w in of]
        self.lengths = np.array([len(w) for w in split], np.int64)
        # 1 stands for all other words, 0 for the end of a text
        self.words = np.full((len(split), WIDTH), -1, np.int64)
        for row, w in enumerate(split):
            self.words[row, WIDTH - len(w):] = [self.number.setdefault(x, len(self.number) + 2) for x in w]


def find_windows(texts: list[np.ndarray], patterns: Patterns) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the word numbers of each text: merged (start, end) spans as rows and
    the numbers of the windows that occur. Together at most about SHARD words,
    but for a single text, whose units are indexed one shard after the other."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    units, held = [], 0
    for owner, numbers in enumerate(texts):
        step = SHARD // 2 - WIDTH
        for start in range(0, max(1, len(numbers) - WIDTH + 1), step):
            unit = numbers[start:start + step + WIDTH - 1]
            if not len(unit):
                continue
            if held + len(unit) + 1 > SHARD:
                _search_shard(units, patterns, found)
                units, held = [], 0
            units.append((owner, start, unit))
            held += len(unit) + 1
    if units:
        _search_shard(units, patterns, found)
    out = []
    for hits in found:
        hit = np.concatenate(hits) if hits else np.zeros((0, 2), np.int64)
        starts, ends = hit[:, 0], hit[:, 0] + patterns.lengths[hit[:, 1]]
        out.append((merged(np.stack([starts, ends], 1)), np.unique(hit[:, 1])))
    return out


def _search_shard(units: list[tuple[int, int, np.ndarray]], patterns: Patterns, found: list[list[np.ndarray]]) -> None:
    """Appends (word place, window) rows to the owner of each unit."""
    end = np.zeros(1, np.int32)
    text = np.concatenate([x for _, _, u in units for x in (u, end)])
    lengths = np.array([len(u) + 1 for _, _, u in units])
    first = np.cumsum(lengths) - lengths
    # a run of words of no window is one symbol
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 1) | (text[:-1] != 1)
    place = np.flatnonzero(keep)
    text = text[place]
    # symbols that occur, renumbered in order; a window with any other word has no occurrence
    symbols = np.unique(np.append(text, [0, 1]))
    text = np.searchsorted(symbols, text)
    windows = np.minimum(np.searchsorted(symbols, patterns.words), len(symbols) - 1)
    there = (symbols[windows] == patterns.words) | (patterns.words < 0)
    some = np.flatnonzero(there.all(axis=1))
    if not len(some):
        return
    windows = np.where(patterns.words[some] < 0, -1, windows[some])
    index = FMIndex(text, max(1, int(len(symbols) - 1).bit_length()), np.searchsorted(place, first))
    at, lo, hi = index.search(windows)
    total = np.cumsum(hi - lo)
    for begin in range(0, int(total[-1]) if len(total) else 0, LOCATED):
        k = np.arange(begin, min(begin + LOCATED, int(total[-1])))
        which = np.searchsorted(total, k, side="right")
        where = place[index.locate(hi[which] - (total[which] - k))]
        unit = np.searchsorted(first, where, side="right") - 1
        order = np.argsort(unit, kind="stable")
        cuts = np.flatnonzero(np.diff(unit[order])) + 1
        for part in np.split(order, cuts):
            owner, start, _ = units[unit[part[0]]]
            found[owner].append(np.stack([where[part] - first[unit[part]] + start, some[at[which[part]]]], 1))


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of the spans as sorted spans that do not touch."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], 1)


def items_digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _scan(shared, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: Patterns = shared.value
        ids, texts, of, numbers, held = [], [], {}, [], 0

        def flush():
            results = find_windows(numbers, patterns)
            spans = [s for s, _ in results]
            items = [{i for w in ws for p in patterns.pairs_of[w] if (i := patterns.items[p]) is not None} for _, ws in results]
            digests = [] if with_spans else [items_digest(x) for x in items]
            rows = texts
            cols = [pa.array(ids, pa.int64()), pa.array([len(numbers[t]) for t in rows], pa.int64())]
            if with_spans:
                keys = list(of)
                cols += [pa.array([keys[t] for t in rows], pa.binary()),
                         pa.array([spans[t].ravel() for t in rows], pa.list_(pa.int64())),
                         pa.array([sorted(items[t]) for t in rows], pa.list_(pa.string()))]
                return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "digest", "spans", "items"])
            hits = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
            cols += [pa.array([hits[t] for t in rows], pa.int64()), pa.array([len(items[t]) for t in rows], pa.int64()),
                     pa.array([digests[t] for t in rows], pa.string())]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

        get = patterns.number.get
        for b in small_parts(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = text.as_py() or b""
                digest = hashlib.sha256(text).digest()
                if digest not in of:
                    parts = [np.fromiter(map(get, w, repeat(1)), np.int32, len(w)) for w in words_of(text)]
                    n = np.concatenate([np.zeros(0, np.int32), *parts])
                    if held + len(n) + 1 > SHARD and ids:
                        yield flush()
                        ids, texts, of, numbers, held = [], [], {}, [], 0
                    of[digest] = len(numbers)
                    numbers.append(n)
                    held += len(n) + 1
                ids.append(doc_id)
                texts.append(of[digest])
                if len(ids) >= 50_000:  # copies take no room in the shard, but rows do
                    yield flush()
                    ids, texts, of, numbers, held = [], [], {}, [], 0
        if ids:
            yield flush()
    return run


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        all_spans, all_items = [], []
        for spans, items in zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True):
            all_spans.append(merged(np.array([x for part in spans for x in part], np.int64).reshape(-1, 2)).ravel())
            all_items.append(sorted({x for part in items for x in part}))
        yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n_words"), pa.array(all_spans, pa.list_(pa.int64())),
                                          pa.array(all_items, pa.list_(pa.string()))], names=["digest", "n_words", "spans", "items"])


def _spans(docs: DataFrame, blocks: list) -> DataFrame:
    """One row per distinct text: digest, n_words, spans and items per block."""
    out = None
    for shared in blocks:
        rows = _bytes(docs).mapInArrow(_scan(shared, True), "doc_id long, n_words long, digest binary, spans array<bigint>, items array<string>")
        # copies of a text are equal here; one row per text and block leaves the task
        rows = rows.groupBy("digest").agg(F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.first("items").alias("items"))
        rows = materialize(rows, "spans")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("digest").agg(F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"),
                                     F.collect_list("items").alias("items"))


def spans_to_remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The general output, one row per distinct text: digest (SHA-256 of the text), n_words, the hit
    word places as merged spans (start, end, start, end, ...), and the items."""
    return _spans(docs, _blocks(benchmark)).mapInArrow(_unite, "digest binary, n_words long, spans array<bigint>, items array<string>")


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _blocks(benchmark: DataFrame):
    """The pairs of the benchmark as broadcasts of bounded size (one, of no pairs, if it is empty)."""
    spark = benchmark.sparkSession
    pairs = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")) \
        .mapInArrow(_windows, "window binary, item string").distinct()
    pairs = materialize(pairs, "windows")
    n = max(1, -(-pairs.count() // BLOCK_PAIRS))
    return [spark.sparkContext.broadcast(Patterns(
        pairs.filter(F.pmod(F.xxhash64("window", "item"), F.lit(n)) == i).orderBy("window", "item").toArrow())) for i in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    blocks = _blocks(benchmark)
    if len(blocks) == 1:
        out = _bytes(docs).mapInArrow(_scan(blocks[0], False), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    else:
        by_text = _spans(docs, blocks).mapInArrow(_unite, "digest binary, n_words long, spans array<bigint>, items array<string>")
        n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
        by_text = by_text.select("digest", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                                 F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
        keyed = _bytes(docs).select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit(b"")), 256)).alias("digest"))
        out = keyed.join(by_text, "digest").drop("digest")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


_SPLIT_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = f"""with d as materialized (select row_number() over () as row_, doc_id, {_SPLIT_SQL} as w from documents),
  b as (select item_id, {_SPLIT_SQL} as w from benchmark),
  p as (select distinct item_id, least({WIDTH}, len(w)) as n, array_to_string(w[s:s + least({WIDTH}, len(w)) - 1], ' ') as t
        from b, unnest(range(1, greatest(1, len(w) - {WIDTH - 1}) + 1)) u(s) where len(w) > 0),
  sizes as (select distinct n from p),
  x as (select d.row_, u.s, sizes.n, array_to_string(d.w[u.s:u.s + sizes.n - 1], ' ') as t
        from d, sizes, unnest(range(1, cast(len(d.w) - sizes.n + 2 as bigint))) u(s) where len(d.w) >= sizes.n),
  h as materialized (select x.row_, x.s, x.n, p.item_id from x join p on p.n = x.n and p.t = x.t),
  hit as (select row_, count(distinct s + o) as n_hit from h, unnest(range(0, cast(n as bigint))) u(o) group by row_),
  items as (select row_, count(*) as n_items, string_agg(i, ',' order by i) as names
            from (select distinct row_, cast(item_id as varchar) as i from h where item_id is not null) group by row_)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(hit.n_hit, 0) as bigint) as n_hit,
       cast(coalesce(items.n_items, 0) as bigint) as n_items, sha256(coalesce(items.names, '')) as items_sha256, coalesce(hit.n_hit, 0) > 0 as contaminated
from d left join hit on hit.row_ = d.row_ left join items on items.row_ = d.row_"""
