"""Language identification by cross-parsing entropy.

Training keeps, per language, a suffix automaton of labelled text. A text is
then cross-parsed with each automaton: it is cut greedily into the longest
phrases that occur in the language's text. The number of phrases c, normalised
as c * log2(n + a) / m bits per letter (n letters of training text, m of the parsed
text, a distinct letters of all languages: a phrase is a place in the text or a
letter by itself), estimates the cross entropy; the language with the fewest wins.

Text is lower-cased and read as a stream of words of letters with one blank between
them. Phrases run over as many words as they match; streams are parsed in
consecutive pieces of ``PIECE`` letters, all pieces of a slice one letter at a time.

Training reads a bounded sample: at most ``train_docs`` labelled rows per language (the
lowest seeded hashes). Their running text is cut into passages of about ``PASSAGE``
letters, and the first passages of all rows, then the second ones and so on make the
language's text, up to ``max_chars`` letters. A language with less text keeps what it
has, and the others keep theirs.

``train`` makes another text, of the sample's most frequent distinct words, with which
``WordCounts`` parses word by word, each distinct word once: the toxicity operator finds
a text's language so, for its thresholds only. Words of more than ``LONG`` letters are
parsed in pieces there.

Defined cases: null text, or text without letters: ``und`` with score 0; no
labelled rows: ``und`` for all; ties go to the first language in code point
order; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import bounded_batches, crc_mod, materialize, small_parts, text_slices

#: Language counts of at most so many rows are broadcast.
BROADCAST_ROWS = 10_000
LETTERS = re.compile(r"[^\W\d_]+")
LONG = 64
#: Distinct words whose counts a task remembers before it starts anew (memory only).
REMEMBERED = 100_000
SLICE_CHARS = 400_000
#: Letters of a piece of running text, and of a passage of the training sample.
PIECE = 512
PASSAGE = 200
#: Weight of a bit per letter in the score.
SHARPNESS = 8.0


def suffix_automaton(text: str, alphabet: dict[str, int]) -> np.ndarray:
    """Transition table (states x letters, -1: none) of the suffix automaton."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in text:
        c = alphabet[ch]
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    table = np.full((len(step), len(alphabet) + 1), -1, dtype=np.int32)
    for s, out in enumerate(step):
        for c, t in out.items():
            table[s, c] = t
    return table


@lru_cache(maxsize=2)
def _automata(texts: tuple[str, ...]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Code of every code point (0: a letter that no language knows), and per text
    the column of each letter (0: not in this text) and the automaton over the
    text's own letters; built once in a Python worker, so that only the texts are
    shipped."""
    alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(texts))))}
    out = []
    for t in texts:
        own = {c: i + 1 for i, c in enumerate(sorted(set(t)))}
        column = np.zeros(len(alphabet) + 1, np.int16)
        for c, i in own.items():
            column[alphabet[c]] = i
        out.append((column, suffix_automaton(t, own)))
    codes = np.zeros(0x110000, np.int16)
    for c, i in alphabet.items():
        codes[ord(c)] = i
    return codes, out


class CrossParser:
    """The training texts; ``counts(words)`` gives phrases per word and language.
    ``even`` cuts all texts to the size of the smallest one's (not used by ``train``)."""

    def __init__(self, words_by_lang: dict[str, list[tuple[str, int]]], max_chars: int, even: bool = True):
        self.langs = sorted(words_by_lang, key=lambda s: s.encode())
        sizes = [sum(len(w) + 1 for w, _ in words_by_lang[x]) for x in self.langs]
        room = min([max_chars, *sizes]) if even and sizes else max_chars
        texts = []
        for x in self.langs:
            text = [" "]
            held = 1
            for w, _ in sorted(words_by_lang[x], key=lambda p: (-p[1], p[0])):
                if held >= room:
                    break
                text.append(w + " ")
                held += len(w) + 1
            texts.append("".join(text))
        self._learn(texts)

    @classmethod
    def of_texts(cls, text_by_lang: dict[str, str]) -> CrossParser:
        """A parser over running text."""
        parser = cls({}, 0)
        parser.langs = sorted(text_by_lang, key=lambda s: s.encode())
        parser._learn([text_by_lang[x] for x in parser.langs])
        return parser

    def _learn(self, texts: list[str]) -> None:
        self.texts = tuple(texts)
        letters = len(set("".join(texts)))
        self.bits = np.array([math.log2(max(2, len(t) + letters)) for t in texts])

    def counts(self, words: list[str]) -> np.ndarray:
        """Phrases of each word (with its blanks) by language."""
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
        return self.pieces("".join([" " + w + " " for w in words]), lens)

    def pieces(self, joined: str, lens: np.ndarray) -> np.ndarray:
        """Phrases by language of the consecutive pieces of ``joined`` with these
        lengths: all advance one letter at a time, longest first so that the live
        ones are a prefix."""
        codes, tables = _automata(self.texts)
        flat = codes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        order = np.argsort(-lens, kind="stable")
        sorted_lens = lens[order]
        width = int(sorted_lens[0]) if len(lens) else 0
        places = (np.cumsum(lens) - lens)[order].astype(np.int32)[None, :] + np.arange(width, dtype=np.int32)[:, None]
        np.minimum(places, max(0, len(flat) - 1), out=places)
        letters = flat[places]
        out = np.zeros((len(lens), len(self.langs)), dtype=np.int32)
        live = [int(np.searchsorted(-sorted_lens, -j, side="left")) for j in range(width)]
        for k, (column, table) in enumerate(tables):
            root = table[0]
            own = column[letters]
            state = np.zeros(len(lens), dtype=np.int32)
            phrases = np.zeros(len(lens), dtype=np.int32)
            for j in range(width):
                n = live[j]
                c = own[j, :n]
                s = state[:n]
                t = table[s, c]
                stuck = np.flatnonzero(t < 0)
                if len(stuck):
                    phrases[stuck] += s[stuck] != 0
                    again = root[c[stuck]]
                    phrases[stuck] += again < 0  # an unknown letter is a phrase of its own
                    t[stuck] = np.maximum(again, 0)
                state[:n] = t
            phrases += state != 0
            out[order, k] = phrases
        return out


class WordCounts:
    """Phrase counts of words, remembered within a task."""

    def __init__(self, parser: CrossParser):
        self.parser = parser
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(parser.langs)), dtype=np.int32)

    def __call__(self, words: list[str]) -> np.ndarray:
        """Row of ``table`` for each word."""
        new = list(set(words).difference(self.rows))
        if len(self.rows) + len(new) > REMEMBERED:
            self.rows, self.table, new = {}, self.table[:0], list(set(words))
        if new:
            at = len(self.rows)
            self.rows.update(zip(new, range(at, at + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.parser.counts(new)])
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))


def letter_words(text: str) -> list[str]:
    words = LETTERS.findall(text.lower())
    if any(len(w) > LONG for w in words):
        words = [w[i:i + LONG] for w in words for i in range(0, len(w), LONG)]
    return words


def phrase_totals(texts: list[str | None], seen: WordCounts) -> tuple[np.ndarray, np.ndarray]:
    """Phrases by language and letters (blanks included) of each whole text."""
    total = np.zeros((len(texts), len(seen.parser.langs)), dtype=np.int64)
    letters = np.zeros(len(texts), dtype=np.int64)
    for rows, parts in text_slices(texts, SLICE_CHARS):
        found = [letter_words(p) for p in parts]
        words = [w for ws in found for w in ws]
        if not words:
            continue
        owner = np.repeat(np.array(rows), [len(ws) for ws in found])
        counts = seen.table[at] if len(at := seen(words)) else None
        edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        total[owner[edge]] += np.add.reduceat(counts, edge, axis=0)
        letters[owner[edge]] += np.add.reduceat(np.fromiter(map(len, words), np.int64, len(words)) + 1, edge)
    return total, letters


def running_totals(texts: list[str | None], parser: CrossParser) -> tuple[np.ndarray, np.ndarray]:
    """As ``phrase_totals``, with phrases that run over words."""
    total = np.zeros((len(texts), len(parser.langs)), dtype=np.int64)
    letters = np.zeros(len(texts), dtype=np.int64)
    for rows, parts in text_slices(texts, SLICE_CHARS):
        words = [LETTERS.findall(p.lower()) for p in parts]
        some = [i for i, ws in enumerate(words) if ws]
        if not some:
            continue
        streams = [" " + " ".join(words[i]) + " " for i in some]
        sizes = np.fromiter(map(len, streams), np.int64, len(streams))
        np.add.at(letters, np.array(rows)[some], sizes - 1)
        n = -(-sizes // PIECE)
        lens = np.full(n.sum(), PIECE)
        lens[np.cumsum(n) - 1] = sizes - (n - 1) * PIECE
        np.add.at(total, np.repeat(np.array(rows)[some], n), parser.pieces("".join(streams), lens))
    return total, letters


def verdicts(parser: CrossParser, total: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winning language (-1: undecided) and its score in 0..1."""
    if not parser.langs:
        return np.full(len(letters), -1), np.zeros(len(letters))
    bits = total * parser.bits / np.maximum(letters, 1)[:, None]
    best = np.where(letters > 0, bits.argmin(axis=1), -1)
    share = 1 / np.exp(-SHARPNESS * (bits - bits.min(axis=1, keepdims=True))).sum(axis=1)
    return best, np.where(letters > 0, share, 0.0)


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each batch of (lang, text)."""
    for b in batches:
        seen: dict[tuple[str, str], int] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            for w in letter_words(text):
                seen[lang, w] = seen.get((lang, w), 0) + 1
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in seen], pa.string()),
                                          "word": pa.array([k[1] for k in seen], pa.string()),
                                          "n": pa.array(list(seen.values()), pa.int64())})


def _passages(max_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts' passages with their number; those beyond ``max_chars`` letters
        of a text could not be kept."""
        for b in batches:
            out = {"lang": [], "_h": [], "n": [], "passage": []}
            for lang, h, text in zip(*(b.column(c).to_pylist() for c in ("lang", "_h", "text")), strict=True):
                held, size, done = [], 0, 0
                found = []
                for w in LETTERS.findall(text.lower()):
                    held.append(w)
                    size += len(w) + 1
                    if size >= PASSAGE:
                        found.append(" ".join(held))
                        done += size
                        held, size = [], 0
                        if done >= max_chars:
                            break
                if held:
                    found.append(" ".join(held))
                out["lang"].extend([lang] * len(found))
                out["_h"].extend([h] * len(found))
                out["n"].extend(range(len(found)))
                out["passage"].extend(found)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(out["lang"], pa.string()), "_h": pa.array(out["_h"], pa.int64()),
                                              "n": pa.array(out["n"], pa.int32()), "passage": pa.array(out["passage"], pa.string())})
    return run


def train_running(docs: DataFrame, train_docs: int = 300, max_chars: int = 40_000, seed: int = 11) -> CrossParser:
    """Learn from the running text of a sample of ``docs``. What reaches the driver is
    bounded by ``max_chars`` letters, and the passage across them, per language."""
    passages = _sample(docs, train_docs, seed).mapInArrow(_passages(max_chars), "lang string, _h long, n int, passage string")
    before = Window.partitionBy("lang").orderBy("n", "_h", "passage").rowsBetween(Window.unboundedPreceding, -1)
    kept = passages.withColumn("_c", F.coalesce(F.sum(F.length("passage") + 1).over(before), F.lit(0))).filter(F.col("_c") < max_chars)
    by_lang: dict[str, list[str]] = {}
    for r in sorted(kept.select("lang", "_c", "passage").collect(), key=lambda r: r["_c"]):
        by_lang.setdefault(r["lang"], []).append(r["passage"][:max_chars])
    return CrossParser.of_texts({x: " " + " ".join(found) + " " for x, found in by_lang.items()})


def train(docs: DataFrame, train_docs: int = 300, max_chars: int = 40_000, seed: int = 11) -> CrossParser:
    """Learn from the (text, lang) of ``docs``. What reaches the driver is
    bounded by ``max_chars`` letters of distinct words per language."""
    words = _sample(docs, train_docs, seed).select("lang", "text").mapInArrow(word_counts, "lang string, word string, n long") \
                                           .groupBy("lang", "word").agg(F.sum("n").alias("n"))
    running = Window.partitionBy("lang").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, -1)
    kept = words.withColumn("_c", F.coalesce(F.sum(F.length("word") + 1).over(running), F.lit(0))) \
                .filter(F.col("_c") < max_chars)
    by_lang: dict[str, list[tuple[str, int]]] = {}
    for r in kept.select("lang", "word", "n").collect():
        by_lang.setdefault(r["lang"], []).append((r["word"], r["n"]))
    return CrossParser(by_lang, max_chars, even=False)


def _sample(docs: DataFrame, train_docs: int, seed: int) -> DataFrame:
    """(lang, text, _h) of the ``train_docs`` labelled rows of each language with the
    lowest seeded hashes, written."""
    rows = docs.select(F.col("lang").alias("lang"), F.col("text").alias("text"),
                       F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("_h")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "languages")
    if counts.count() <= BROADCAST_ROWS:
        # without the hint all texts would be shuffled by language first
        counts = F.broadcast(counts)
    # hash threshold per language: about twice the rows wanted, then the lowest ones exactly
    at = F.col("_h") / F.lit(2.0 ** 64) + 0.5
    near = rows.join(counts, "lang").filter(at * F.col("_n") <= 2 * train_docs + 10)
    lowest = Window.partitionBy("lang").orderBy("_h", "text")
    picked = near.withColumn("_r", F.row_number().over(lowest)).filter(F.col("_r") <= train_docs).select("lang", "text", "_h")
    return materialize(picked, "language-sample")


def identify(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """doc_id, lang_pred and score of every row, from the text alone."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, "und"], dtype=object)
        for b in small_parts(batches):
            best, share = verdicts(model, *running_totals(b.column("text").to_pylist(), model))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names[best], pa.string()), pa.array(share)],
                                             names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double")


def held_out(docs: DataFrame):
    return F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))


def predict_languages(docs: DataFrame, **training) -> DataFrame:
    """Learn from the rows that are not held out, predict every row."""
    parser = train_running(docs.filter(~held_out(docs)), **training)
    return identify(docs, parser).select("doc_id", held_out(docs).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, **training) -> DataFrame:
    """The rows (all columns) in whose text a language is found; learns like
    ``predict_languages``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train_running(docs.filter(~held_out(docs)), **training))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_parts(batches):
            best, _ = verdicts(shared.value, *running_totals(b.column("text").to_pylist(), shared.value))
            yield b.filter(pa.array(best >= 0))

    return docs.mapInArrow(keep, docs.schema)
