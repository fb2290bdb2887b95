"""Toxicity scores from a convolutional text classifier trained in numpy.

A word's embedding is the sum of three hashed rows (the word, its first four
and its first six letters). Filters of widths 1, 2 and 3 slide over the whole text, each filter
keeps its maximum over all positions (max pooling), and a logistic layer reads
the maxima. Thresholds are calibrated by language: the language comes from the
text itself (cross-parsing, ``language_id``), and a language's threshold is
moved to 0.5 by shifting the logit, so ``predicted`` is always score >= 0.5.

Training reads every labelled row, whole texts. A quarter of them (by a seeded
hash of doc_id) is held back from the gradient: all of these rows calibrate the
thresholds, by counts of their logits. All others train the network: the driver
finds starting weights on at most ``train_rows`` rows of each label (the lowest
seeded hashes), then in each of three passes every task goes over its share of all rows
with Adagrad from these weights, and the changes are averaged, weighted by the
rows of the task.

Defined cases: null or empty text is scored as a text without words; without
any labelled row of both classes every score is the share of toxic labels
(0 without labels); null labels are not learnt from; a document with several
labels is learnt from once per label; repeated rows are scored alike; other
columns are ignored.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import language_id as lid
from trailmark.llm.common import bounded_batches, crc_mod, materialize, small_parts, text_slices

WIDTHS = (1, 2, 3)
FILTERS = 12
DIM = 16
ROWS = 1 << 16
PARTS = 3
#: Characters worked on at once and distinct words remembered in a task (memory only).
SLICE_CHARS = 200_000
REMEMBERED = 60_000
#: Thresholds are found on logits in steps of 1 / STEPS, between -LIMIT and LIMIT.
STEPS = 256
LIMIT = 60
#: Up to so many labels (narrow rows) are broadcast to the texts; with more, both are shuffled.
BROADCAST_LABELS = 2_000_000
#: Averaged changes are summed as integers of this unit, so the order of the sums is of no account.
UNIT = 1 << 24


def word_rows(words: list[str]) -> np.ndarray:
    """The embedding rows of each word; row 0 is padding."""
    out = np.empty((len(words), PARTS), np.int64)
    out[:, 0] = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
    out[:, 1] = np.fromiter((zlib.crc32(b"^" + w[:4].encode()) for w in words), np.int64, len(words))
    out[:, 2] = np.fromiter((zlib.crc32(b"~" + w[:6].encode()) for w in words), np.int64, len(words))
    return out % (ROWS - 1) + 1


class Network:
    """Embedding rows, filters per width and the logistic layer."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((ROWS, DIM)) * 0.1).astype(np.float32)
        self.table[0] = 0
        self.filters = [(rng.standard_normal((k, DIM, FILTERS)) / np.sqrt(k * DIM)).astype(np.float32) for k in WIDTHS]
        self.out = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.bias = np.float32(-2.0)
        self.shift: dict[int, float] = {}

    def projections(self, rows: np.ndarray) -> np.ndarray:
        """For words given by their embedding rows: the part that a word adds to
        every filter at each place of its window, (words, places, FILTERS)."""
        e = self.table[rows].sum(axis=1)
        return np.stack([e @ w[j] for w in self.filters for j in range(len(w))], axis=1)

    @staticmethod
    def pooled(parts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Maxima by text. ``parts`` follow the words of all texts, each text
        followed by padding, so no window reaches into the next text."""
        maxima, at = [], 0
        for k in WIDTHS:
            total = parts[:len(parts) - k + 1, at].copy()
            for j in range(1, k):
                total += parts[j:len(parts) - k + 1 + j, at + j]
            maxima.append(np.maximum.reduceat(total, starts, axis=0))
            at += k
        return np.concatenate(maxima, axis=1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.bias


class Trainer:
    """Adagrad on the logistic loss; each text is an (n, PARTS) array of embedding
    rows. Only the words under a filter's maximum get a gradient."""

    def __init__(self, net: Network, class_weights: tuple[float, float], rate: float = 0.02):
        self.net, self.class_weights, self.rate = net, np.array(class_weights), rate
        self.g_table = np.full(ROWS, 1e-3, np.float32)
        self.g_filters = [np.full_like(w, 1e-3) for w in net.filters]
        self.g_out, self.g_bias = np.full_like(net.out, 1e-3), 1e-3
        self.touched = np.zeros(ROWS, bool)

    def step(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        net, rate = self.net, self.rate
        widest = max(WIDTHS)
        pad = np.zeros((widest, PARTS), np.int64)
        rows = np.concatenate([x for t in texts for x in (t, pad)])
        starts = np.cumsum([0, *[len(t) + widest for t in texts[:-1]]])
        ends = np.r_[starts[1:], len(rows)]
        e = net.table[rows].sum(axis=1)
        pooled, places = [], []
        for w in net.filters:
            k = len(w)
            total = sum(e[j:len(e) - k + 1 + j] @ w[j] for j in range(k))
            where = np.stack([a + total[a:min(b, len(total))].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])
            places.append(where)
            pooled.append(total[where, np.arange(FILTERS)])
        h = np.concatenate(pooled, axis=1)
        act = np.maximum(h, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ net.out + net.bias, -30, 30)))
        err = ((p - labels) * self.class_weights[labels] / len(texts)).astype(np.float32)
        d_out, d_bias = act.T @ err, err.sum()
        d_h = err[:, None] * net.out * (h > 0)
        touched, grads = [], []
        for n, w in enumerate(net.filters):
            d = d_h[:, n * FILTERS:(n + 1) * FILTERS]
            d_w = np.zeros_like(w)
            for j in range(len(w)):
                words = places[n] + j
                d_w[j] = np.einsum("tf,tfd->df", d, e[words])
                touched.append(rows[words].reshape(-1, PARTS))
                grads.append((d[:, :, None] * w[j].T[None]).reshape(-1, DIM))
            self.g_filters[n] += d_w ** 2
            w -= rate * d_w / np.sqrt(self.g_filters[n])
        idx = np.concatenate(touched)
        grad = np.concatenate(grads)
        for side in range(PARTS):
            keys, inverse = np.unique(idx[:, side], return_inverse=True)
            total = np.zeros((len(keys), DIM), np.float32)
            np.add.at(total, inverse, grad)
            self.g_table[keys] += (total ** 2).mean(axis=1)
            net.table[keys] -= 5 * rate * total / np.sqrt(self.g_table[keys])[:, None]
            self.touched[keys] = True
        net.table[0] = 0
        self.g_out += d_out ** 2
        self.g_bias += d_bias ** 2
        net.out -= rate * d_out / np.sqrt(self.g_out)
        net.bias -= np.float32(rate * d_bias / np.sqrt(self.g_bias))

    def epoch(self, texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, batch: int = 32) -> None:
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            picked = order[at:at + batch]
            self.step([texts[i] for i in picked], labels[picked])


def balance(clean: int, toxic: int) -> tuple[float, float]:
    """Weights of clean and toxic rows: both labels weigh half."""
    n = clean + toxic
    return 0.5 * n / max(1, clean), 0.5 * n / max(1, toxic)


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 5, epochs: int = 6) -> Trainer:
    """Trained on rows in memory."""
    trainer = Trainer(Network(seed), balance(int((labels == 0).sum()), int((labels == 1).sum())))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        trainer.epoch(texts, labels, rng)
    return trainer


def _cells(net: Network) -> np.ndarray:
    """All weights but the table's, as rows of DIM numbers."""
    flat = np.concatenate([*[w.ravel() for w in net.filters], net.out, [net.bias]]).astype(np.float64)
    return np.r_[flat, np.zeros(-len(flat) % DIM)].reshape(-1, DIM)


def _set_cells(net: Network, cells: np.ndarray) -> None:
    flat, at = cells.ravel(), 0
    for w in [*net.filters, net.out]:
        w[...] = flat[at:at + w.size].reshape(w.shape)
        at += w.size
    net.bias = np.float32(flat[at])


def encoded(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(r, np.uint16).reshape(-1, PARTS).astype(np.int64) for r in b.column("rows").to_pylist()]


def refine(rows: DataFrame, start: Trainer, clean: int, toxic: int, seed: int = 5) -> Network:
    """``start`` trained further by every row of ``rows`` (toxic, rows): each task
    goes over its rows once, the changes are averaged. A row of the embedding
    table is averaged over the tasks that met it. At most the network's size
    reaches the driver."""
    start.class_weights = np.array(balance(clean, toxic))
    start.touched[:] = False
    shared = rows.sparkSession.sparkContext.broadcast(start)
    names = ["at", "n", *[f"c{j}" for j in range(DIM)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = shared.value.net
        trainer, n = copy.deepcopy(shared.value), 0
        rng = np.random.default_rng(seed)
        for b in small_parts(batches):
            if b.num_rows:
                trainer.epoch(encoded(b), b.column("toxic").to_numpy(), rng)
                n += b.num_rows
        if not n:
            return
        met = np.flatnonzero(trainer.touched)
        change = np.concatenate([trainer.net.table[met].astype(np.float64) - before.table[met], _cells(trainer.net) - _cells(before)])
        units = np.rint(change * n * UNIT).astype(np.int64)
        at = np.r_[met, ROWS + np.arange(len(change) - len(met))]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(at), n, np.int64)),
                                          *[pa.array(np.ascontiguousarray(units[:, j])) for j in range(DIM)]], names=names)

    sums = rows.select("toxic", "rows").mapInArrow(run, "at int, n long, " + ", ".join(f"{c} long" for c in names[2:])) \
        .groupBy("at").agg(*[F.sum(c).alias(c) for c in names[1:]]).toArrow()
    shared.destroy()
    at = sums["at"].to_numpy()
    mean = np.stack([sums[c].to_numpy() for c in names[2:]], axis=1) / UNIT / sums["n"].to_numpy()[:, None]
    net = copy.deepcopy(start.net)
    table = at < ROWS
    net.table[at[table]] += mean[table].astype(np.float32)
    net.table[0] = 0
    cells = _cells(net)
    cells[at[~table] - ROWS] += mean[~table]
    _set_cells(net, cells)
    return net


def _logits_of(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    widest, out = max(WIDTHS), []
    for t in texts:
        rows = np.concatenate([t, np.zeros((widest, PARTS), np.int64)])
        out.append(net.logits(net.pooled(net.projections(rows), np.array([0])))[0])
    return np.array(out)


def logit_counts(rows: DataFrame, net: Network) -> DataFrame:
    """(lang, step, clean, toxic): all rows counted by language and logit, in steps."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list[int]] = {}
        for b in small_parts(batches):
            if not b.num_rows:
                continue
            logits = _logits_of(shared.value, encoded(b)).astype(np.float64)
            steps = np.floor(np.clip(logits, -LIMIT, LIMIT) * STEPS).astype(int).tolist()
            for lang, step, toxic in zip(b.column("lang").to_pylist(), steps, b.column("toxic").to_pylist(), strict=True):
                seen.setdefault((lang, step), [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()),
             pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())],
            names=["lang", "step", "clean", "toxic"])

    return rows.select("toxic", "lang", "rows").mapInArrow(run, "lang int, step int, clean long, toxic long") \
        .groupBy("lang", "step").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def best_threshold(step: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """Logit threshold with the best F1 among those at which most of what is
    marked is toxic (none: nothing is marked), in the middle of the widest gap of
    equal F1. ``clean`` and ``toxic`` count the rows of each step of logits; a
    threshold lies between two steps."""
    steps, at = np.unique(-step, return_inverse=True)
    steps = -steps
    hit, wrong = (np.cumsum(np.bincount(at, c, len(steps))) for c in (toxic, clean))
    f1 = np.where(hit > wrong, 2 * hit / (hit + wrong + toxic.sum()), 0)
    if not f1.any():
        return float((steps[0] + 1) / STEPS + 1)
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    edges = np.r_[steps, steps[-1] - STEPS]
    i = top[np.argmax(edges[top] - edges[top + 1])]
    return float((edges[i] + edges[i + 1] + 1) / 2 / STEPS)


def thresholds(rows: DataFrame, net: Network) -> dict[int, float]:
    """Threshold of each language (-1: of all rows) from all of ``rows``
    (toxic, lang, rows); at most LIMIT x STEPS x 2 counts a language reach the driver."""
    got = logit_counts(rows, net).toArrow()
    lang, step, clean, toxic = (got[c].to_numpy() for c in ("lang", "step", "clean", "toxic"))
    everywhere = best_threshold(step, clean, toxic)
    out = {-1: everywhere}
    for k in sorted(set(lang.tolist())):
        own = lang == k
        # a language with few examples of either label keeps the common threshold
        enough = min(toxic[own].sum(), clean[own].sum()) >= 20
        out[k] = best_threshold(step[own], clean[own], toxic[own]) if enough else everywhere
    return out


class _Rows:
    """``word_rows`` as a table for ``language_id.WordCounts``, which remembers words."""
    langs = range(PARTS)

    @staticmethod
    def counts(words: list[str]) -> np.ndarray:
        return word_rows(words).astype(np.int32)


def encode(rows: DataFrame, parser: lid.CrossParser) -> DataFrame:
    """(doc_id, toxic, part, lang, rows) of ``rows`` (doc_id, toxic, part, text):
    the language of those with part "back" or "both", the embedding rows of all words."""
    shared = rows.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = lid.WordCounts(shared.value), lid.WordCounts(_Rows)
        for b in small_parts(batches):
            texts, part = b.column("text").to_pylist(), b.column("part").to_pylist()
            back = [i for i, p in enumerate(part) if p != "front"]
            lang: list[int | None] = [None] * len(texts)
            if back:
                found, _ = lid.verdicts(shared.value, *lid.phrase_totals([texts[i] for i in back], seen))
                for i, k in zip(back, found, strict=True):
                    lang[i] = int(k)
            out = []
            for t in texts:
                at = known(lid.letter_words(t or ""))
                out.append(known.table[at].astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("toxic"), b.column("part"), pa.array(lang, pa.int32()), pa.array(out, pa.binary())],
                names=["doc_id", "toxic", "part", "lang", "rows"])

    return rows.select("doc_id", "toxic", "part", "text").mapInArrow(
        run, "doc_id long, toxic int, part string, lang int, rows binary")


def train(docs: DataFrame, labels: DataFrame, parser: lid.CrossParser, train_rows: int = 4000, seed: int = 5,
          passes: int = 3) -> tuple:
    """(network or None, share of toxic labels), from ``passes`` passes over every
    labelled row. At most ``train_rows`` rows of each label are collected, as hashed
    embedding rows, for the starting weights."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
                  .filter("toxic in (0, 1)")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    share, n_marks = marks.agg(F.avg("toxic"), F.count(F.lit(1))).first()
    if n_marks <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    held = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed + 1)), F.lit(4)) == 3
    sizes = {(r["toxic"], r["back"]): r["n"] for r in texts.select("doc_id").join(marks, "doc_id")
             .groupBy("toxic", held.alias("back")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [[sizes.get((label, back), 0) for back in (False, True)] for label in (0, 1)]
    if not (sum(n[0]) and sum(n[1])):
        return None, float(share or 0.0)
    if 0 in (*n[0], *n[1]):  # too few to hold any back
        part, n = F.lit("both"), [[sum(k), sum(k)] for k in n]
    else:
        part = F.when(held, "back").otherwise("front")
    # read in every pass below: texts are met with their labels and cut into words once
    rows = materialize(encode(texts.join(marks, "doc_id").withColumn("part", part), parser), "labelled")
    front, back = rows.filter("part <> 'back'"), rows.filter("part <> 'front'")
    h = F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("_h")
    picked = None
    for label in (0, 1):
        # the lowest hashes of each label: a top-k of narrow rows
        lowest = front.filter(F.col("toxic") == label).select("doc_id", "toxic", h).orderBy("_h", "doc_id").limit(train_rows)
        picked = lowest if picked is None else picked.unionByName(lowest)
    # at most 2 * train_rows narrow rows: broadcast; a doc_id that repeats brings no more rows than that
    got = front.join(F.broadcast(picked.distinct()), ["doc_id", "toxic"]).select("_h", "toxic", "rows").limit(2 * train_rows).toArrow()
    data = sorted(zip(got["_h"].to_pylist(), got["toxic"].to_pylist(), got["rows"].to_pylist(), strict=True))
    del got
    x = [np.frombuffer(d[2], np.uint16).reshape(-1, PARTS) for d in data]  # views, no copies
    start = fit(x, np.array([d[1] for d in data], dtype=np.int64), seed)
    del data, x
    for i in range(passes):
        start.net = refine(front, start, n[0][0], n[1][0], seed + i)
    net = start.net
    net.shift = thresholds(back, net)
    return net, float(share or 0.0)


class Scorer:
    """Scores of whole texts; remembers the distinct words of a task."""

    def __init__(self, net: Network, parser: lid.CrossParser):
        self.net, self.parser = net, parser
        self.known: dict[str, int] = {}
        # row 0 is padding; the tables grow by doubling
        self.parts = np.zeros((1 << 12, sum(WIDTHS), FILTERS), np.float32)
        self.phrases = np.zeros((1 << 12, len(parser.langs)), np.int32)

    def learn(self, words: list[str]) -> None:
        new = list(set(words).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(set(words))
        if not new:
            return
        at = len(self.known) + 1
        while at + len(new) > len(self.parts):
            self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
            self.phrases = np.concatenate([self.phrases, np.zeros_like(self.phrases)])
        self.known.update(zip(new, range(at, at + len(new)), strict=True))
        self.parts[at:at + len(new)] = self.net.projections(word_rows(new))
        self.phrases[at:at + len(new)] = self.parser.counts(new)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        widest = max(WIDTHS)
        pooled = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        total = np.zeros((len(texts), len(self.parser.langs)), np.int64)
        letters = np.zeros(len(texts), np.int64)
        last, tail = None, []
        for owners, pieces in text_slices(texts, SLICE_CHARS):
            found = [lid.letter_words(p) for p in pieces]
            if owners[0] == last:  # a text goes on: its windows reach over the cut
                found[0] = tail + found[0]
            last, tail = owners[-1], found[-1][1 - widest:]
            words = [w for ws in found for w in ws]
            self.learn(words)
            lens = np.array([len(ws) for ws in found])
            starts = np.r_[0, np.cumsum(lens + widest)[:-1]]
            rows = np.zeros(int((lens + widest).sum()), np.int64)
            if words:
                to = np.arange(len(words)) + np.repeat(starts - np.r_[0, np.cumsum(lens)[:-1]], lens)
                rows[to] = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            np.maximum.at(pooled, owners, self.net.pooled(self.parts[rows], starts))
            np.add.at(total, owners, np.add.reduceat(self.phrases[rows], starts, axis=0))
            np.add.at(letters, owners, np.array([sum(map(len, ws)) + len(ws) for ws in found]))
        lang, _ = lid.verdicts(self.parser, total, letters)
        shift = self.net.shift
        logit = self.net.logits(pooled) - np.array([shift.get(int(k), shift[-1]) for k in lang])
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def score(docs: DataFrame, net: Network | None, parser: lid.CrossParser, share: float = 0.0) -> DataFrame:
    """doc_id and score of every row, from the whole text alone."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit(float(share)).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((net, parser))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in small_parts(batches):
            out = scorer(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def held_out(col: str = "doc_id"):
    return F.coalesce(crc_mod(col, 5) == 0, F.lit(False))


def predict_toxicity(docs: DataFrame, labels: DataFrame, **training) -> DataFrame:
    """Learn from labelled rows that are not held out, score every row:
    doc_id, held_out, score, predicted."""
    bounded_batches(docs.sparkSession)
    parser = lid.train(docs.filter(~held_out()))
    net, share = train(docs.filter(~held_out()), labels.filter(~held_out()), parser, **training)
    return score(docs, net, parser, share).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, **training) -> DataFrame:
    """The rows (all columns) that score below 0.5; learns like ``predict_toxicity``."""
    bounded_batches(docs.sparkSession)
    parser = lid.train(docs.filter(~held_out()))
    net, share = train(docs.filter(~held_out()), labels.filter(~held_out()), parser, **training)
    if net is None:
        return docs if share < 0.5 else docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast((net, parser))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in small_parts(batches):
            yield b.filter(pa.array(scorer(b.column("text").to_pylist()) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
