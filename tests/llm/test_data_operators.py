"""Extraction, archive, packing, mixing, vectors and the pipeline: small cases against brute force."""

import base64
import glob
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from trailmark.llm import caps, html_text, mixing, packing, permutation_index, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---------------------------------------------------------------- extraction

def text_of(page):
    found = html_text.blocks(page)
    return html_text.chosen_text([k for k, _ in found], [t for _, t in found], [])


def test_article_without_the_rest_of_the_page():
    page = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{x}</style></head><body class="has-sidebar">
      <header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></ul></nav><!-- <p>no</p> -->
      <div class="cookie-notice">We use</div><div id="ad-slot">Buy</div>
      <article><header><h1>Big &amp;  &eacute;</h1></header><p>One <b>bo</b>ld<br>line<p>Two &lt;i&gt;
      <script>var t="</p>";if(a<b){}</script><ul><li>a<li>b&nbsp;c</ul><aside>side</aside><form><p>q<input></form>
      <div class="share-buttons">Tweet</div><pre>x
      y</pre><section class="comments"><p>Nice!</p></section><footer>by me</footer></article>
      <div class=sidebar>more</div><footer>&copy; me</footer></body></html>"""
    assert text_of(page) == "Big & é\nOne bold line\nTwo <i>\na\nb c\nx y"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a < b and c > d", "a < b and c > d"),
    ("<p>x<a title='y", "x"), ("<p>x<!-- never ends <p>y", "x"), ("<script>never ends <p>y", ""),
    ("<div hidden>h</div><p>x", "x"), ("<p>a</i></div>b</p>c", "a\nb\nc"), ("<article></article><p>x", "x"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<P>&#65;&#x42;&bogus;</P>", "AB&bogus;"),
    ("<main><p>" + "w " * 60_000 + "</main>", ("w " * 60_000).strip()),
])
def test_odd_markup(page, text):
    assert text_of(page or "") == text


def test_repeated_runs_of_a_host_are_removed(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    notice = "please read our long standing terms of use before you go on reading"
    teaser = [" ".join(word() for _ in range(14)) for _ in range(4)]
    rows, want = [], {}
    for i in range(40):
        own = [" ".join(word() for _ in range(rng.randint(3, 40))) for _ in range(3)]
        host = "www.a.org" if i % 4 else f"h{i}.org"  # one host holds most pages
        rows.append((i, f"https://{host}/{i}", f"<div><p>{own[0]}<p>{notice}<p>{own[1]}<div>{teaser[i % 4]}</div><p>{own[2]}</div>"))
        if i % 4:
            want[i] = "\n".join(own)
    rows += [(100, "http://x.org/1", "<p>only one here<p>" + notice), (101, None, None), (102, "http://a.org/9", ""),
             (103, "http://y.org/1", f"<article><p>{notice}</article>"), (104, "http://y.org/2", f"<article><p>{notice}<p>z</article>")]
    # an exact copy of a page is no reason to drop its own text
    rows += [(1000, "https://a.org/copy", rows[1][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'t' as text", "1 as row", "'h' as host", "2 as version")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert len(got) == len(rows)
    for i, text in want.items():
        assert got[i].text == text and got[i].n_chars == len(text)
    assert got[1000].text == want[1]
    assert got[100].text == "only one here\n" + notice and got[101].text == "" and got[102].n_chars == 0
    assert got[103].text == notice and got[104].text == notice + "\nz"
    assert html_text.extract(pages.limit(0)).count() == 0


def contained_pages():
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    notice = "sign up here for our weekly letter and never miss a story again"
    rows, want = [], {}
    for i in range(12):
        own = [words(30), words(25)]
        tag = ("article", "main")[i % 2]
        rows.append((i, "https://a.org/%d" % i, f"<{tag}><p>{own[0]}<div class=box>{notice}</div><p>{own[1]}</{tag}>"))
        want[i] = "\n".join(own)
    # near copies: their own text, headings too, is one version
    body = [words(3), words(40), words(50)]
    for i in range(20, 24):
        mine = [*body[:2], body[2] + " " + words(2)]
        rows.append((i, f"https://a.org/{i}", f"<article><h2>{mine[0]}</h2><p>{mine[1]}<p>{notice}<p>{mine[2]}</article>"))
        want[i] = "\n".join(mine)
    # the teaser of an article in another page's menu
    rows.append((30, "https://a.org/30", f"<nav><p>{want[0].splitlines()[0]}</nav><article><p>{words(30)}</article>"))
    # a small element named like a container beside the body
    own = [words(5), words(60)]
    rows.append((40, "https://a.org/40", f"<div class=story><p>{own[0]}</div><div><p>{own[1]}</div>"))
    want[40] = "\n".join(own)
    return rows, want


@pytest.mark.parametrize("broadcast_rows", [html_text.BROADCAST_ROWS, 0])
def test_repeated_runs_inside_containers_are_removed(spark, broadcast_rows):
    rows, want = contained_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in html_text.extract(pages, broadcast_rows).collect()}
    assert len(got) == len(rows)
    assert {i: got[i] for i in want} == want


# ---------------------------------------------------------------- archive

def test_archive_round_trip(spark, scratch):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "u\r\nX: y", ""), (5, "u", "\r\n\r\nWARC/1.1"),
            (7, "u", "<p>é</p>"), (7, "u", "<p>é</p>"), (None, "u", "<p>é</p>"), (8, "u", "z" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as digest", "3 as address")
    warc.write_archive(pages, scratch + "/w")
    assert spark.read.parquet(scratch + "/w/payloads").count() == 4  # each payload once
    got = warc.read_records(spark, scratch + "/w")
    recs = got.collect()
    assert len(recs) == len(rows) and all(r.verified for r in recs)
    body = {r[0]: (r[2] or "").encode() for r in rows}
    for r in recs:
        assert bytes(r.payload) == body[r.page_id] and r.payload_bytes == len(body[r.page_id])
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body[r.page_id]).digest()).decode()
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in recs), key=str)
    assert kinds == sorted([(1, "revisit", 7), (2, "revisit", 7), (3, "revisit", 4), (4, "response", None), (5, "response", None),
                            (7, "response", None), (7, "response", None), (None, "revisit", 7), (8, "response", None)], key=str)
    for r in warc.warc_bytes(got).collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        length = int(head.rsplit(b"Content-Length: ", 1)[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and block[length:] == b"\r\n\r\n"
    warc.export_warc(got, scratch + "/x")
    data = b"".join(gzip.open(f).read() for f in glob.glob(scratch + "/x/*.gz"))
    at = n = 0
    while at < len(data):  # a reader that follows Content-Length
        end = data.index(b"\r\n\r\n", at)
        length = int(data[at:end].rsplit(b"Content-Length: ", 1)[1])
        assert data[end + 4 + length:end + 8 + length] == b"\r\n\r\n"
        at, n = end + 8 + length, n + 1
    assert n == len(rows)


def test_archive_threshold_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.archive_pages(pages, min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.archive_pages(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- packing

def test_ids_are_those_of_the_json_vocabulary(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    json_bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    json_bpe.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["", " ", "\n\n a\t", "é€😀 don't", "x" * 5000, "a\x00b", "<|endoftext|> it's 12345", "ÀÉ z"]
    enc = packing.encoder(packing.vocabulary())
    for t in texts:
        assert enc.encode_to_numpy(t, disallowed_special=()).tolist() == json_bpe.encode(t, add_special_tokens=False).ids


def test_added_tokens_in_text_are_those_of_the_json_default(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    json_bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"one {end} two", end, end * 3, f"{end} a", f"a{end}b", f"x\n{end}\n", "<|endoftext", "<|endof" + end, "", "it's 12345  é€😀",
             *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(50).collect()]]
    want = [json_bpe.encode(t, add_special_tokens=False).ids for t in texts]
    assert [packing.token_ids(t, packing.vocabulary()).tolist() for t in texts] == want
    assert len(want[0]) == 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in packing.pack(docs).collect():
        got.setdefault(r.doc_id, {})[r.start] = (r.length, r.ids_crc32)
    for i, ids in enumerate(want):
        ids = np.array([*ids, 0], "<u4")
        assert sum(n for n, _ in got[i].values()) == len(ids)
        assert all(crc == zlib.crc32(ids[at:at + n].tobytes()) for at, (n, crc) in got[i].items())


def check_packed(rows, capacity):
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as length", "2 as offset", "3 as _chunk")
    rows = packing.pack(docs).collect()
    n = check_packed(rows, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) * 1.03 + 1
    enc = packing.encoder(packing.vocabulary())
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        ids = np.append(enc.encode_to_numpy(d.text, disallowed_special=()), 0).astype("<u4")
        own = sorted(pieces[d.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert own[0].start == 0 and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        assert all(r.length == 2048 for r in own[1:]) and (len(own) == 1 or len(ids) > 2048)


def test_packing_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "a"), (3, "word " * 3000), (3, "word " * 3000), (4, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs).collect()
    assert sorted(r.length for r in got if r.doc_id in (1, 2)) == [1, 1]
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    check_packed(got, 2048)
    assert packing.pack(docs.limit(0)).count() == 0


def test_hot_length_gets_more_chunks(spark):
    """Most pieces equally long, one doc_id null on many rows: chunks of about ten rows pack the same number of sequences."""
    pieces = spark.range(4000).selectExpr("if(id % 3 = 0, null, id) as doc_id", "0 as piece", "0L as start",
                                          "if(id % 4 = 0, 1 + id % 60, 64L) as length", "id as ids_crc32")
    got = {rows: packing.place(pieces, capacity=64, chunk_rows=rows).collect() for rows in (10, 10 ** 6)}
    assert check_packed(got[10], 64) == check_packed(got[10 ** 6], 64) and len(got[10]) == 4000


def best_fit(hist, capacity):
    rooms, bins = np.zeros(capacity + 1, int), 0
    for n in range(capacity, 0, -1):
        for _ in range(hist[n]):
            r = next((r for r in range(n, capacity + 1) if rooms[r]), None)
            if r is None:
                bins, r = bins + 1, capacity
            else:
                rooms[r] -= 1
            rooms[r - n] += 1
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_rank_once_near_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = [16, 100, 256, 256, 512, 64][seed]
    lengths = np.clip((rng.lognormal(3, 1.2, 3000)).astype(int) + 1, 1, capacity)
    if seed == 3:
        lengths[:1500] = 130  # one length holds half of all pieces
    hist = np.bincount(lengths, minlength=capacity + 1)
    rows, n = packing.plan(hist, capacity)
    used, seen = {}, set()
    for length, rank, count, first, per, offset in rows.tolist():
        for k in range(count):
            assert (length, rank + k) not in seen
            seen.add((length, rank + k))
            used.setdefault(first + k // per, []).append((offset + k % per * length, length))
    assert len(seen) == hist[1:].sum() and set(used) == set(range(n))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert n <= best_fit(hist, capacity) * 1.01 + 2
    assert packing.plan(np.zeros(capacity + 1, np.int64), capacity)[1] == 0


# ---------------------------------------------------------------- mixing

def brute_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """Resharing round by round: the plain reading of the rule."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        got = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if got[s] > epochs * sizes[s]]
        if not over:
            return fixed | got
        for s in over:
            fixed[s] = epochs * sizes[s]
            left -= fixed[s]


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 60)), rng.choice(["a", "b", "a", "a", "é", "Z", None])) for i in range(900)]
    rows += [(900, None, "a"), (901, "", "b"), (902, " \t", None), (903, "x " * 4000, "solo"), (904, None, "empty"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "1 as size", "2 as target", "3 as _before", "4 as _slice")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, taken, target, most = {}, {}, {}, {}
    by_id = {r[0]: r for r in rows}
    for r in got:
        s = by_id[r.doc_id][2]
        assert r["size"] == len((by_id[r.doc_id][1] or "").split()) and 0 <= r.taken <= 2 * r["size"]
        size[s] = size.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        most[s] = max(most.get(s, 0), r["size"])
        target[s] = r.target
    want = brute_targets(size)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= most[s]
    assert sorted(got) == sorted(mixing.mix(docs.repartition(9)).collect())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_slices_do_not_change_the_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(mixing.mix(docs, slices=1).collect()) == sorted(mixing.mix(docs, slices=64).collect())


# ---------------------------------------------------------------- vectors

VEC = "vec_id long, embedding array<float>, label int"
ODD = [(9001, None, 1), (9002, [0.0] * 8, 1), (9003, [1.0, None] + [0.0] * 6, 1), (9004, [float("nan")] + [1.0] * 7, 1),
       (9005, [float("inf")] + [1.0] * 7, 1), (9020, [0.0] * 8, 1), (9007, [], 1)]


def clustered(n=260, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        c = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 25)):
            rows.append((c + rng.standard_normal(dim) * rng.choice([0.02, 0.1, 0.25])) * rng.choice([1.0, 3.0, 1e-3]))
    x = np.array(rows[:n], np.float32)
    x[50] = x[51]
    x[100:120] = x[100]
    return x


def test_caps_equal_brute_force(spark):
    x = clustered()
    labels = [int(i) % 3 if i % 17 else None for i in range(len(x))]
    rows = [(i, [float(v) for v in x[i]], labels[i]) for i in range(len(x))] + ODD + [(9006, [1.0, 2.0], 1), (9008, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, VEC).selectExpr("*", "1 as id", "2 as unit", "3 as filters", "4 as n_links")
    got = {r.vec_id: r for r in caps.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & np.array([[a is not None and a == b for b in labels] for a in labels])
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        new = root.copy()
        np.minimum.at(new, np.nonzero(link)[0], root[np.nonzero(link)[1]])
        if (new == root).all():
            break
        root = new
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), root[i], root[i] == i)
    for i, *_ in ODD:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[9008].component_id == 9006  # shorter vectors link among themselves
    assert caps.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 7, 64, 500])
def test_list_decoding_finds_the_best_filters(k):
    rng = np.random.default_rng(1)
    unit = rng.standard_normal((20, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    a, b = caps._block_scores(unit)
    for x, y, got in zip(a, b, caps.list_decode(unit, k), strict=True):
        scores = (x[:, None] + y[None, :]).ravel()
        assert len(set(got.tolist())) == k
        assert np.allclose(np.sort(scores[got]), np.sort(scores)[-k:])


def test_neighbours_against_brute_force(spark):
    x = clustered(1500, 24, 5)
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))] + [(9020, [0.0] * 24, 1), (9040, None, 1), (9060, [1.0, 1.0], 0),
                                                                        (9061, [2.0, 0.5], 0), (7, [float(v) for v in x[7]], 0)]
    df = spark.createDataFrame(rows, VEC).selectExpr("*", "1 as rank", "2 as score", "3 as v", "4 as block")
    got = {}
    # two blocks and two groups of queries
    for r in permutation_index.nearest(df, block=800).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    big = x.astype(np.float64)
    hits = total = 0
    for q in range(0, len(x), 20):
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21))
        exact = (big * big[q]).sum(axis=1)
        assert all(s == exact[v] for _, v, s in own) and all(v != q for _, v, _ in own)
        assert own == sorted(own, key=lambda t: (-t[2], t[1]))
        order = [i for i in np.lexsort((np.arange(len(x)), -exact)) if i != q][:20]
        hits, total = hits + len(set(order) & {v for _, v, _ in own}), total + 20
    assert hits / total >= 0.95
    assert 9020 not in got and 9040 not in got and got[9060] == [(1, 9061, 2.5)]  # fewer candidates than 20
    assert permutation_index.nearest(df.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline and SQL

def test_pipeline_stages_in_turn(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "minhash_near_dedup", "mixing", "packing"]
    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10 ** 6, None, None, None, None), (10 ** 6 + 1, "", "en", "s", 0), (10 ** 6 + 2, "123", "en", "s", 3)], DOCS)
    out, before = docs.unionByName(odd), docs.count() + 3
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf)
        n = out.count()
        if name != "packing":
            assert out.columns == docs.columns
        if name == "language_id":
            assert n == before - 3
        if name == "minhash_near_dedup":
            assert out.select("doc_id").distinct().count() == n < before
        before = n
    assert check_packed(out.collect(), 2048) > 0


def test_pipeline_takes_empty_input(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


@pytest.mark.parametrize("name", ["op3_warc", "op7_license_scan", "op9_mixing"])
def test_native_queries_equal_sql(spark, name):
    import duckdb
    import __spark_entry__ as entry
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    rel = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, rel.fetchall()))
