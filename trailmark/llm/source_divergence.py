"""Source divergence audit: how far the word frequencies of a language's sources
lie apart, and which words each source overuses.

Terms are runs of letters (any non-ASCII character counts as one), only A-Z lowered. ``bytes.translate``
lowers letters and blanks separators in one pass over the UTF-8 text,
``bytes.split`` gives the terms and a Counter per document their frequencies; a task
keeps sums per (lang, source, term) and hands them on when ``HELD`` are held.
Spark sums them. A language keeps the V terms that at least ``min_docs`` of its
documents have. With N the occurrences of kept terms in a group (lang, source)
or a language, p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in exact arithmetic.

- Part ``pair``: each other source of the language, with the sum of |p - q| over
  all kept terms. The kept terms are dealt by hash into blocks of at most about
  ``CELLS`` (source, term) cells, a hot language into as many as its terms need;
  a block is a matrix with each source's p of count 0 where a term is missing, and
  sums the differences of its sources. Blocks are summed by Spark; no term is
  expanded into pairs of rows.
- Part ``term``: the kept terms of a group with p above its language's, ranked by
  the difference, at most ``top``.

Defined cases: null text, lang and source are ''; a text without terms counts
as a document of its group; repeated rows count again; a language without kept
terms has pair values of 0; a language of one source has no pairs; ties rank
by the item's UTF-8 bytes; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import materialize, small_parts

MIN_DOCS = 30
TOP = 50
#: Term sums a task holds before it hands them on (memory only).
HELD = 200_000
#: Bytes of a text worked on at once (memory only).
SLICE_BYTES = 4_000_000
#: (source, term) cells of a block of the pair part.
CELLS = 50_000
SCALE = 1_000_000_000

#: Blank for ASCII other than letters; A-Z lowered.
_TERMS = bytes(i if i >= 0x80 or 0x61 <= i <= 0x7A else i + 32 if 0x41 <= i <= 0x5A else 32 for i in range(256))


def term_counter(text: bytes) -> Counter:
    """Frequencies of a text's terms; a long text is read in parts cut between terms."""
    if len(text) <= SLICE_BYTES:
        return Counter(text.translate(_TERMS).split())
    counts: Counter = Counter()
    rest = b""
    for at in range(0, len(text), SLICE_BYTES):
        part = rest + text[at:at + SLICE_BYTES].translate(_TERMS)
        cut = part.rfind(b" ") + 1
        counts.update(part[:cut].split())
        rest = part[cut:]
    counts.update(rest.split())
    return counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task per (lang, source, term): occurrences and documents. The
    empty term counts the group's documents."""
    groups: dict[tuple, tuple[dict, Counter]] = {}

    def flush():
        for (lang, source), (total, docs) in groups.items():
            terms = list(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()),
                 pa.array([total.get(t, 0) for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    for b in small_parts(batches):
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"), strict=True):
            group = groups.get((lang, source))
            if group is None:
                group = groups[lang, source] = ({}, Counter())
            total, docs = group
            counts = term_counter(text.as_py())
            docs[b""] += 1
            docs.update(counts.keys())  # a document counts once per term
            get = total.get
            for term, n in counts.items():
                total[term] = get(term, 0) + n
        if sum(len(docs) for _, docs in groups.values()) >= HELD:
            yield from flush()
    yield from flush()


def _distances(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of |p - q| over a block's terms for all ordered pairs of its sources.
    Rows without a term carry a source's p of count 0."""
    t = pa.Table.from_batches(list(batches))
    base = t.filter(pc.is_null(t["term"]))
    cells = t.filter(pc.is_valid(t["term"]))
    sources = sorted(base["source"].to_pylist())
    at = {s: i for i, s in enumerate(sources)}
    start = np.zeros(len(sources), np.int64)
    start[[at[s] for s in base["source"].to_pylist()]] = base["p"].to_numpy()
    codes = cells["term"].combine_chunks().dictionary_encode()
    matrix = np.repeat(start[:, None], len(codes.dictionary), axis=1)
    matrix[[at[s] for s in cells["source"].to_pylist()], codes.indices.to_numpy()] = cells["p"].to_numpy()
    for i, s in enumerate(sources):
        others = [j for j in range(len(sources)) if j != i]
        sums = np.abs(matrix - matrix[i]).sum(axis=1)[others]
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()] * len(others), pa.string()), pa.array([s] * len(others), pa.string()),
             pa.array([sources[j] for j in others], pa.string()), pa.array(sums)], names=["lang", "source", "item", "value"])


def _p(count, total, kept):
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exactly."""
    over = (F.lit(SCALE).cast("decimal(12,0)") * (count + 5).cast("decimal(25,0)")).cast("decimal(38,0)")
    under = (total + 5 * kept).cast("decimal(38,0)")
    return F.when(kept > 0, 1 + F.call_function("div", over, under))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Rows lang, source, part, item, value, rank of both parts."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
                        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    counts = texts.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    counts = counts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = materialize(counts, "term-counts")
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("_d")) \
                 .filter(F.col("_d") >= min_docs).drop("_d")
    kept = materialize(kept, "kept-terms")
    cells = materialize(counts.filter("term <> '' and n > 0").drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # every group, even without kept terms; sources of a language for the size of its blocks
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left") \
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), "lang_total")
    per_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("_s"))
    groups = groups.join(per_lang, "lang").withColumn(
        "blocks", F.greatest(F.lit(1), F.ceil(F.col("_s") * F.col("kept") / F.lit(CELLS))).cast("long")).drop("_s")
    groups = materialize(groups, "groups")
    valued = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _p(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        _p(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"),
        F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))
    base = groups.select("lang", "source", F.lit(None).cast("string").alias("term"),
                         F.coalesce(_p(F.lit(0), F.col("total"), F.col("kept")), F.lit(0).cast("long")).alias("p"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    pairs = valued.drop("q").unionByName(base).groupBy("lang", "block").applyInArrow(
        _distances, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = valued.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    columns = ("lang", "source", F.col("part"), "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))


ORACLE_SQL = f"""with d as (select row_number() over () as row_, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms_ from documents),
  t as (select row_, lang, source, unnest(terms_) as term from d),
  k as (select lang, term, count(*) as lang_n from t group by all having count(distinct row_) >= {MIN_DOCS}),
  l as (select lang, count(*) as kept, sum(lang_n) as lang_total from k group by lang),
  g as (select distinct lang, source from d),
  c as (select t.lang, t.source, t.term, count(*) as n from t join k on k.lang = t.lang and k.term = t.term group by all),
  s as (select lang, source, sum(n) as total from c group by all),
  x as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
               1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * l.kept) as p,
               1 + ({SCALE}::hugeint * (k.lang_n + 5)) // (l.lang_total + 5 * l.kept) as q
        from g join l on l.lang = g.lang join k on k.lang = g.lang
        left join s on s.lang = g.lang and s.source = g.source
        left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
  m as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
        from x a join x b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
  pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(m.value, 0) as bigint) as value
            from g a join g b on a.lang = b.lang and a.source <> b.source
            left join m on m.lang = a.lang and m.source = a.source and m.item = b.source),
  terms as (select lang, source, 'term' as part, term as item, cast(p - q as bigint) as value from x where n > 0 and p > q),
  ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
             from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= {TOP}"""
