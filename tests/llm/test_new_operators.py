"""Source divergence, vector codes and FM-index decontamination: small cases against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import fm_decontamination as fm
from trailmark.llm import source_divergence, vector_codes

DOCS = "doc_id long, text string, lang string, source string, window string, term string"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- FM-index

def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(ASCII_LOWER))


def brute_leaks(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i:i + 10])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found:
                    hit.update(range(i, i + n))
                    names |= {str(x) for x in found if x is not None}
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_against_sorting(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(1, 4, rng.integers(0, 40)) for _ in range(12)]
    texts += [texts[0], texts[1], np.tile(texts[2], 5)]
    text = np.concatenate([np.append(t, 0) for t in texts])
    end_of = np.searchsorted(np.flatnonzero(text == 0), np.arange(len(text)))
    ends = np.flatnonzero(text == 0)
    want = sorted(range(len(text)), key=lambda i: (text[i:ends[end_of[i]] + 1].tolist(), i))
    assert fm.suffix_array(text, 2).tolist() == want


def test_search_and_locate_against_scanning():
    rng = np.random.default_rng(5)
    units = [rng.integers(1, 6, n) for n in (300, 1, 40, 300)]
    units.append(units[0])
    text = np.concatenate([np.append(u, 0) for u in units])
    starts = np.cumsum([0] + [len(u) + 1 for u in units[:-1]])
    index = fm.FMIndex(text, 3, starts)
    patterns = np.array([rng.integers(1, 6, 4) for _ in range(200)])
    patterns[:50, 0] = -1  # shorter ones
    at, lo, hi = index.search(patterns)
    got = {int(a): sorted(index.locate(np.arange(x, y)).tolist()) for a, x, y in zip(at, lo, hi)}
    for k, p in enumerate(patterns):
        p = p[p >= 0]
        want = [i for i in range(len(text) - len(p) + 1) if (text[i:i + len(p)] == p).all()]
        assert got.get(k, []) == want


def leak_case():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "日本"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, sentence(rng.choice([3, 9, 10, 11, 40]))) for i in range(25)]
    items += [(3, "only here, of two rows"), (None, "an item without an id"), (90, None), (91, ""), (92, "?!"), (93, items[4][1])]
    docs = []
    for i in range(120):
        text = sentence(rng.randint(0, 60))
        if i % 3 == 0:
            text += "; " + rng.choice(items[:27])[1].upper() + " " + sentence(5)
        docs.append((i, text))
    docs += [docs[0], (None, docs[3][1]), (500, None), (501, ""), (502, "..."), (503, items[4][1]), (503, sentence(20)),
             (504, "An item - WITHOUT an id" + " x" * 30)]
    return docs, items


@pytest.mark.parametrize("block, shard", [(400_000, 1 << 20), (20, 1 << 20), (400_000, 128)])
def test_leaks_against_brute_force(spark, monkeypatch, block, shard):
    docs, items = leak_case()
    monkeypatch.setattr(fm, "BLOCK_PAIRS", block)
    if shard < 1 << 20:  # many shards, texts of several units: seen inside this process
        monkeypatch.setattr(fm, "SHARD", shard)
        import pyarrow as pa
        pairs = list(fm._windows(iter([pa.RecordBatch.from_arrays(
            [pa.array([None if i is None else str(i) for i, _ in items]), pa.array([None if t is None else t.encode() for _, t in items], pa.binary())],
            names=["item", "text"])])))
        p = fm.Patterns(pa.Table.from_batches(pairs).group_by(["window", "item"]).aggregate([]))
        numbers = [np.array([p.number.get(w.encode(), 1) for w in words(t)], np.int32) for _, t in docs]
        found = fm.find_windows(numbers, p)
        got = [(d, len(words(t)), int((s[:, 1] - s[:, 0]).sum())) for (d, t), (s, _) in zip(docs, found)]
        assert sorted(got, key=repr) == sorted([r[:3] for r in brute_leaks(docs, items)], key=repr)
        return
    d = spark.createDataFrame([(i, t, "en", "s", "clash", "clash") for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, window string")
    out = fm.decontaminate(d, b)
    assert out.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted([tuple(r) for r in out.collect()], key=repr) == brute_leaks(docs, items)


def test_leaks_of_empty_tables_and_long_texts(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in fm.decontaminate(d, none).orderBy("doc_id").collect()] == [0, 0]
    assert fm.decontaminate(d.filter("false"), none).collect() == []
    # beyond one shard, with occurrences across the cut of its units
    leak = " ".join(f"leak{i}" for i in range(12))
    n = fm.SHARD // 2 - fm.WIDTH
    text = "a " * (n - 4) + leak + " b" * n + " " + leak
    long = spark.createDataFrame([(1, text)], "doc_id long, text string")
    item = spark.createDataFrame([(7, leak)], "item_id long, text string")
    r = fm.decontaminate(long, item).first()
    assert (r.n_words, r.n_hit, r.n_items) == (n - 4 + 24 + n, 24, 1)


def test_spans_to_remove(spark):
    leak = " ".join(f"leak{i}" for i in range(12))
    d = spark.createDataFrame([(1, f"x y {leak} z {leak}"), (2, "clean")], "doc_id long, text string")
    item = spark.createDataFrame([(7, leak)], "item_id long, text string")
    rows = {r.n_words: (r.spans, r["items"]) for r in fm.spans_to_remove(d, item).collect()}
    assert rows == {27: ([2, 14, 15, 27], ["7"]), 1: ([], [])}


def test_words_of_a_text_in_parts(monkeypatch):
    monkeypatch.setattr(fm, "SLICE_BYTES", 7)
    for text in ("", "one", "one two", "a-b  c ééééé long" * 9, "x" * 50 + " y " + "é" * 30, "...", "abcdefg hijklmn"):
        assert [w.decode() for part in fm.words_of(text.encode()) for w in part] == words(text)


# ---------------------------------------------------------------- source divergence

def brute_audit(docs, min_docs, top):
    tf, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(ASCII_LOWER))
        groups[lang].add(source)
        tf[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]

        def p(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}
        whole = p(sum((tf[lang, s] for s in sources), Counter()))
        ps = {s: p(tf[lang, s]) for s in sources}
        for s in sources:
            pair = [(sum(abs(ps[s][t] - ps[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(ps[s][t] - whole[t], t) for t in kept if tf[lang, s][t] and ps[s][t] > whole[t]]
            for part, rows, limit in (("pair", pair, None), ("term", term, top)):
                for rank, (value, item) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1].encode()))[:limit], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("cells", [1_000_000, 40])
def test_audit_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(source_divergence, "CELLS", cells)
    rng = random.Random(11)
    docs = []
    for i in range(400):
        lang, source = rng.choice(["en", "en", "fr", None, "xx"]), rng.choice(["a", "a", "b", "c", None, "ÿ"])
        text = " ".join(rng.choice(["The", "été", "x1y", "日本", "cat", "dog's", source or "n", lang or "l"]) for _ in range(rng.randint(0, 12)))
        docs.append((lang, "only" if lang == "xx" else source, text))
    docs += [("de", "a", "rare words"), ("de", "b", None), ("de", None, ""), (None, None, None), ("en", "empty", "123 ...")]
    rows = [(i, t, g, s, "clash", "clash") for i, (g, s, t) in enumerate(docs)]
    out = source_divergence.audit(spark.createDataFrame(rows, DOCS).repartition(3), min_docs=20, top=3)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in out.collect()) == brute_audit(docs, 20, 3)
    assert source_divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_term_counter_of_a_long_text(monkeypatch):
    text = ("The été, x1y  Ölq " * 50).encode()
    whole = source_divergence.term_counter(text)
    monkeypatch.setattr(source_divergence, "SLICE_BYTES", 11)
    assert source_divergence.term_counter(text) == whole
    assert whole == {b"the": 50, "été".encode(): 50, b"x": 50, b"y": 50, "Ölq".encode(): 50}


# ---------------------------------------------------------------- vector codes

def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted([(i, v, g) for i, v, g in rows if v and all(x is not None and np.isfinite(x) for x in v)],
                  key=lambda r: (r[0] is None, r[0] or 0))
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v, _ in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return d.argmin(-1), d.min(-1)
    for _ in range(rounds):
        code, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[code[:, p] == e, p]
                if len(mine):
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    code, error = assign()
    error = error.sum(1)
    by = Counter()
    for (_, _, g), e in zip(kept, error):
        by[g] += int(e)
    digest = hashlib.sha256(",".join(str(c) for c in books.ravel()).encode()).hexdigest()
    return sorted([(i, g, "".join(f"{c:02x}" for c in cs), int(e), by[g], digest) for (i, _, g), cs, e in zip(kept, code, error)], key=repr)


@pytest.mark.parametrize("n, width", [(300, 4), (300, 1), (20, 2), (150, 3)])
def test_codes_against_brute_force(spark, n, width):
    rng = np.random.default_rng(n + width)
    v = (rng.integers(-3, 4, (n, 16 * width)) / 256 + rng.choice([0, 0, 0, 0.3], (n, 16 * width))).astype(np.float32)
    v[n // 2:] = v[n // 2]  # copies
    rows = [(int(i), [float(c) for c in x], None if i % 5 == 0 else int(i % 3)) for i, x in zip(rng.permutation(n), v)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [float("nan")] * 16 * width, 1), (1003, [None] * 16 * width, 1),
             (-5, [float("inf")] + [0.0] * (16 * width - 1), 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    out = vector_codes.compress(df)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted([tuple(r) for r in out.collect()], key=repr) == brute_codes(rows)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).collect() == []
    one = spark.createDataFrame([(None, [1.0] * 16, None), (4, [2.0] * 17, 1), (5, [1e9] * 16, 1)], schema)
    r = vector_codes.compress(one).collect()
    assert [(x.vec_id, x.code, x.error, x.label_error) for x in r] == [(None, "00" * 16, 0, 0)]


def test_trie_shares_prefixes_and_finds_the_nearest(monkeypatch):
    rng = np.random.default_rng(3)
    parts, entries = rng.integers(-4, 5, (4000, 5)), rng.integers(-4, 5, (64, 5))
    for block in (1, 7, 512):
        monkeypatch.setattr(vector_codes, "BLOCK", block)
        trie = vector_codes.PartTrie(parts[:400] if block == 1 else parts)
        assert len(trie.nodes[0]) == 9 and len(trie.nodes[1]) <= 81  # one node per distinct prefix
        code, error = trie.nearest(entries)
        d = ((trie.leaves[:, None] - entries[None]) ** 2).sum(-1)
        assert (code == d.argmin(1)).all() and (error == d.min(1)).all()


# ---------------------------------------------------------------- near-dedup: shared ids

def test_one_doc_id_with_two_texts(spark):
    from trailmark.llm import near_text
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "quite another text of its own"), (2, "a b c d e f g"), (None, "x y"), (None, "x y")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = sorted([tuple(r) for r in near_text.keep_one(d, width=5).collect()], key=repr)
    assert kept == sorted([rows[0], rows[2], rows[4], rows[5]], key=repr)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


# ---------------------------------------------------------------- extraction: what stays in an article

def page_text(page):
    from trailmark.llm import html_text
    found = html_text.blocks(page)
    return html_text.chosen_text([k for k, _ in found], [t for _, t in found], [])


@pytest.mark.parametrize("page, text", [
    ('<article class="post type-post category-social"><p>a b</article>', "a b"),
    ('<article class="post ad-free"><p>a b</article>', "a b"),
    ('<div class="content sidebar-right"><p>a b</div><div class="sidebar-right">c</div>', "a b"),
    ('<form id=aspnet><nav>x</nav><article><p>a b<form>q</form></article><p>other</form>', "a b"),
    ('<form><p>only here</form>', "only here"),
    ('<article><section id="social-effects"><p>a b</section></article>', "a b"),
    ('<article><div class="article-header"><h1>T</h1></div><p>a b</article>', "T\na b"),
    ('<main><h1>T</h1><article><p>a b</article><div>More stories</div></main>', "T\na b"),
    ('<main><p>a b</p><p>c</p></main>', "a b\nc"),
    ('<body><div class="site-header">x</div><div class="cookie-banner top">y</div><div class="share-buttons">z</div><p>a b</body>', "a b"),
    ('<article><p>a<div class="related-posts">x</div><div class="comment-list">y</div><div id="ad-slot-3">z</div></article>', "a"),
])
def test_names_and_containers(page, text):
    assert page_text(page) == text


def test_headings_and_quotes_stay_in_articles(spark):
    from trailmark.llm import html_text
    rng = random.Random(2)
    own = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    quote = "the committee said on monday that nothing at all had been decided yet"
    notice = "sign up here for our weekly letter and never miss a story again"
    rows, want = [], {}
    for i in range(6):
        x = [own(), own()]
        cited = f"<p>{quote}</p>" if i < 2 else ""
        rows.append((i, f"https://a.org/{i}", f"<article><h2>Introduction</h2><p>{x[0]}</p><p>Yes.</p>{cited}<p>{notice}</p><h2>Conclusion</h2><p>{x[1]}</p></article>"))
        want[i] = "\n".join(["Introduction", x[0], "Yes.", *([quote] if i < 2 else []), "Conclusion", x[1]])
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


@pytest.mark.parametrize("seed", [0, 1])
def test_repeated_runs_against_brute_force(spark, monkeypatch, seed):
    """Runs of RUN tokens on enough versions of a host, counted in a dictionary."""
    from trailmark.llm import html_text
    monkeypatch.setattr(html_text, "near_versions", lambda read: spark.createDataFrame([], "node long, root long"))
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefghijklm") * 3 for _ in range(rng.randint(8, 20))) for _ in range(6)]
    pages = {}
    for i in range(40):
        blocks = [" ".join(rng.choice("nopqrstuvwxyz") * rng.randint(1, 4) for _ in range(rng.randint(1, 25))) for _ in range(4)]
        blocks += rng.sample(shared, rng.randint(0, 2))
        rng.shuffle(blocks)
        pages[i] = (("article", "div")[i % 2], blocks)
    versions = defaultdict(set)
    for i, (tag, blocks) in pages.items():
        for b in blocks:
            w = b.split()
            runs = [tuple(w[k:k + 8]) for k in range(len(w) - 7)] if len(w) >= 8 else [tuple(w)] if tag == "div" else []
            for r in runs:
                versions[tag, r].add("\n".join(blocks))
    want = {}
    for i, (tag, blocks) in pages.items():
        hits, sizes = [], []
        for b in blocks:
            w = b.split()
            sizes.append(len(w))
            cover = set()
            for k in range(max(1, len(w) - 7)):
                if len(versions[tag, tuple(w[k:k + 8])]) >= (3 if tag == "article" else 2):
                    cover.update(range(k, min(len(w), k + 8)))
            hits.append(len(cover))
        copy = 2 * sum(hits) > sum(sizes)
        want[i] = "\n".join(b for b, h, n in zip(blocks, hits, sizes) if 2 * h < n or copy and n >= html_text.SHORT)
    df = spark.createDataFrame([(i, "https://h.org/x", f"<{t}>" + "".join(f"<p>{b}</p>" for b in bs) + f"</{t}>") for i, (t, bs) in pages.items()],
                               "page_id long, url string, html string").repartition(4)
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == want


# ---------------------------------------------------------------- embedding near-dedup: copies and hot filters

@pytest.mark.parametrize("hot", [8_192, 20])
def test_caps_of_copies_and_hot_filters(spark, monkeypatch, hot):
    from trailmark.llm import caps
    monkeypatch.setattr(caps, "HOT_ROWS", hot)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((260, 32))
    x[40:160] = x[40] + rng.normal(scale=0.05, size=(120, 32))   # one dense group
    x[160:220] = x[160]                                          # copies
    x[220] = x[160] * 2
    x[221:230] = x[40]
    rows = [(i, [float(c) for c in v], 1 if i < 250 else None) for i, v in enumerate(x)] + [(5, [float(c) for c in x[5]], 1), (None, [1.0] * 32, 1), (None, None, None)]
    got = {r.vec_id: r for r in caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect() if r.vec_id is not None}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.93
    link[250:] = link[:, 250:] = False
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(root, np.where(link, root[None, :], len(x)).min(axis=1))
        if (new == root).all():
            break
        root = new
    assert {i: (got[i].n_links, got[i].component_id) for i in range(len(x))} == {i: (link[i].sum(), root[i]) for i in range(len(x))}
