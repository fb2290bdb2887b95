"""Main text of web pages with a suffix array per host.

Pages are read into blocks of text (paragraphs, headings, list items, ...) with
what the markup says about them: part of an article container (``MAIN``), part
of a menu, footer, advert, form, comment section and the like (``HINTED``), or
neither (``NEUTRAL``). Scripts, styles, the head and hidden elements are no text.

The blocks of all pages of a host, as streams of tokens, make the host's suffix
array: every suffix that starts in a block, cut at ``RUN`` tokens or the block's
end. The array is a distributed table, dealt out by key; suffixes with equal cut
prefixes are neighbours in it, and a run that starts suffixes of at least two
distinct pages is a repeated one. Before that the array's sparse form is dealt out:
of every suffix only its anchor, the least hash of the ``GRAM``-token pieces of its
run. Neighbouring suffixes mostly share it, and equal runs have equal anchors, so a
run whose anchor is not on enough versions is on too few itself; only the other
suffixes are dealt out in full. Blocks inside containers are compared among
themselves and the others among themselves, so that the teaser of an article in
another page's menu does not make the article's own words repeated ones. Equal
suffixes are pre-aggregated before the shuffle; a host with a third of all pages is
no group. Pages whose main text is equal or nearly equal (shared bands of minhashes
of its word pairs and near sketches, linked to components) count as one version, so
a copied page does not make its own text boilerplate.

A page's text is its article container's blocks, or container and neutral blocks if
more unrepeated words are outside the container than in it; without a container it
is its neutral blocks. Runs have at least ``RUN`` tokens. Blocks covered (by half or more of
their tokens) by repeated runs go; a block inside a container goes only if its runs stand
on ``VERSIONS`` or more distinct versions, and a shorter one only outside containers (such a
block is a run by itself). So a heading that many articles use, or a
sentence that two articles quote, stays. If repeats cover most of such a page, it is a near copy of others: then
only covered blocks of fewer than ``SHORT`` words go.

What the markup says: class and id names count as whole names or as compounds of known
words only (``site-header``, not ``article-header`` or ``category-social``); they do not
decide on ``article`` and ``main`` themselves or on an element that is also
named as content. An article inside a page-wide form is a container. Inside ``main``,
what follows its last article is no text of the article.

Defined cases: null or empty html has the empty text; repeated rows are repeated;
markup that never ends is dropped to the end of the page; a null url is a host of
its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import near_text
from trailmark.llm.common import components, materialize

RUN = 8
#: Tokens of the pieces of a run of which one is its anchor.
GRAM = 4
SHORT = 10
#: Bands of minhashes by which nearly equal main texts meet, and the sketch bits (of 64) that may differ.
BANDS = 10
BAND = 5
SKETCH_ERRORS = 13
#: Repeated runs, or linked versions, of at most so many rows are broadcast; beyond that they are joined.
#: Of more repeated anchors none are used: all suffixes are dealt out in full, with the same result.
BROADCAST_ROWS = 4_000_000
#: The array is dealt out in at least so many parts (an even number), and parts of about so many suffixes; its
#: sparse form, with a third of the entries, in larger ones (memory only).
PARTS = 512
PART_SUFFIXES = 1_000_000
SPARSE_SUFFIXES = 4_000_000
#: Letters of text worked on at once (memory only).
SLICE_CHARS = 2_000_000
#: Distinct versions of which a run inside containers must be to be a repeated one (outside: 2).
VERSIONS = 3
MAIN, NEUTRAL, HINTED = 0, 1, 2
#: While a page is read: inside ``main`` but no article, and inside a form but no container.
OUTER, FORM = 3, 4

# Element names of HTML, by their part here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object textarea title svg math canvas audio video select datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"),
          "th": ("td", "th")}
SCOPE = frozenset("article aside body div fieldset footer form header main nav section table td ul ol dl".split())
JUNK_TAGS = frozenset("aside button dialog footer form head menu nav".split())
JUNK_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
JUNK_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner breadcrumb breadcrumbs comment "
    "comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu menubar "
    "modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related "
    "replies reply respond search share sharing sidebar signin signup social sponsor sponsored subscribe subscription toolbar "
    "widget widgets".split())
NOT_NAMES = frozenset("has is no not with without".split())
#: Words that make a compound with junk names, and names of content beside which junk names do not decide.
JUNK_WITH = frozenset(
    "area bar block bottom box btn button buttons card cards container content form global group head icons inner items left link "
    "links list main message mobile outer page panel popular post posts primary right secondary section site slot stories text top "
    "unit wrap wrapper".split())
CONTENT_NAMES = frozenset("article content entry hentry post".split())
MAIN_NAMES = frozenset(
    "article article-body article-content article-text articlebody entry-content main-content mainbody page-content post-body "
    "post-content story story-body story-content".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|$(?![\s\S])))|<[!?][^>]*+(?:>|$(?![\s\S]))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|$(?![\s\S]))"
    r"|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _kind(tag: str, attributes: str, kind: int) -> tuple[int, bool]:
    """Kind of an element inside an element of ``kind``, and whether it is hidden."""
    if kind == HINTED and not attributes:
        return HINTED, False
    at = _attributes(attributes) if attributes.strip(" /\t\n") else {}
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", at.get("style", ""), re.I):
        return HINTED, True
    names = f"{at.get('class', '')} {at.get('id', '')}".lower().split()
    role = at.get("role", "").lower()
    if kind == HINTED or role in JUNK_ROLES or tag in JUNK_TAGS and tag != "form" or tag == "header" and kind not in (MAIN, OUTER):
        return HINTED, False
    if tag == "article" or role == "article" or at.get("itemprop", "").lower() == "articlebody":
        return MAIN, False
    if tag == "main" or role == "main":
        return (MAIN if kind == MAIN else OUTER), False
    if tag == "form":
        return (HINTED if kind in (MAIN, OUTER) else FORM), False
    if tag not in ("html", "body") and CONTENT_NAMES.isdisjoint(names) and MAIN_NAMES.isdisjoint(names):
        for name in names:
            parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
            if not parts or parts[0] in NOT_NAMES or JUNK_NAMES.isdisjoint(parts):
                continue
            if all(x in JUNK_NAMES or x in JUNK_WITH or x.isdigit() for x in parts):
                return HINTED, False
    if not MAIN_NAMES.isdisjoint(names):
        return MAIN, False
    return kind, False


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the page's blocks with text, in order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = [("", NEUTRAL, False)]
    text: list[str] = []

    def close() -> None:
        words = " ".join(html.unescape("".join(text)).split())
        if words:
            out.append((stack[-1][1], words))
        text.clear()

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if page[m.start()] != "<" or m.end() == m.start() + 1:
                if not stack[-1][2]:
                    text.append(m[0])
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if any(x[0] == tag for x in stack):
                # a part of the text ends where its kind or block ends
                while True:
                    name = stack[-1][0]
                    if name in BLOCK or stack[-1][1] != stack[-2][1]:
                        close()
                    stack.pop()
                    if name == tag:
                        break
            elif tag in BLOCK:
                close()
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                at = end.end() if end else n
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            close()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in CLOSES.get(tag, ("p",) if tag in BLOCK else ()):
                del stack[i:]
                break
            if stack[i][0] in SCOPE:
                break
        if tag in VOID:
            continue
        kind, hidden = _kind(tag, attributes, stack[-1][1])
        if kind != stack[-1][1]:
            close()
        stack.append((tag, kind, hidden or stack[-1][2]))
    close()
    return _settled(out)


def _settled(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Blocks of ``main`` are text if no article is in it or one still follows;
    blocks of a form are neutral on a page that has no others."""
    last = max((i for i, (k, _) in enumerate(found) if k == MAIN), default=-1)
    any_ = any(k in (MAIN, OUTER, NEUTRAL) for k, _ in found)
    return [(MAIN if k == OUTER and (last < 0 or i < last) else HINTED if k == OUTER else (HINTED if any_ else NEUTRAL) if k == FORM else k, t)
            for i, (k, t) in enumerate(found)]


def host_of(url: str | None) -> str | None:
    """Host of a URL, lower case, without www."""
    if url is None:
        return None
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url)
    host = (m[1] if m else "").lower()
    return host[4:] if host.startswith("www.") else host


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_PLACES = near_text.mixed(np.arange(1, RUN + 1, dtype=np.uint64)) | np.uint64(1)
_INSIDE = np.uint64(0xA24BAED4963EE407)


def suffix_keys(texts: list[str], salts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Block, place, key and anchor of the suffixes of the blocks, cut at RUN tokens; a
    shorter block outside a container is one run, its own anchor. ``salts`` has a number per
    block, ``inside`` whether it is in a container: the key's lowest bit."""
    words, counts = near_text.word_hashes([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    counts = counts.astype(np.int64)
    n = len(words)
    padded = np.concatenate([words, np.zeros(RUN, np.uint64)])
    starts = np.cumsum(counts) - counts
    whole = np.zeros(n, np.uint64)
    for j in range(RUN):
        whole += padded[j:j + n] * _PLACES[j]
    block = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - starts[block]
    full = place + RUN <= counts[block]
    grams = near_text.mixed(sum(padded[j:n + RUN - GRAM + j] * _PLACES[j] for j in range(GRAM)) + np.append(salts[block], np.zeros(RUN - GRAM, np.uint64)))
    least = grams[:n].copy()
    for j in range(1, RUN - GRAM + 1):
        np.minimum(least, grams[j:n + j], out=least)
    short = np.flatnonzero((counts > 0) & (counts < RUN) & ~inside)
    part = near_text.mixed(counts[short].astype(np.uint64))
    for j in range(RUN - 1):
        part += np.where(j < counts[short], padded[starts[short] + j] * _PLACES[j], np.uint64(0))
    block, place, keys, least = block[full], place[full], whole[full], least[full]
    block, place = np.concatenate([block, short]), np.concatenate([place, np.zeros(len(short), np.int64)])
    keys = near_text.mixed(np.concatenate([keys, part]) + salts[block])
    anchors = np.concatenate([least, keys[len(least):]])
    return block, place, _marked(keys, inside[block]), _marked(anchors, inside[block])


def _marked(keys: np.ndarray, inside: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(1) << np.uint64(1) | inside.astype(np.uint64)


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _sieve_keys(anchors: np.ndarray, parts: int) -> np.ndarray:
    """Part (its lowest bit tells whether inside containers) and 32 more bits of the anchors."""
    return anchors % np.uint64(parts) << np.uint64(32) | anchors >> np.uint64(32)


READ = "row long, host string, version long, n_words long, page_id long, url string, kinds array<int>, texts array<string>"
PART = "part long, keys binary, versions binary"
SUFFIX = "row long, block int, place int, key long"
POSTING = "band long, version long, sketch long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            found = [blocks(x.as_py() or "") for x in part.column("html")]
            main = ["\n".join(t for k, t in x if k == MAIN) for x in found]
            urls = part.column("url").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array([host_of(u) for u in urls], pa.string()),
                 pa.array([_digest(m or "\n".join(t for _, t in x)) for x, m in zip(found, main, strict=True)], pa.int64()),
                 pa.array([sum(t.count(" ") + 1 for _, t in x) for x in found], pa.int64()),
                 part.column("page_id"), part.column("url"), pa.array([[k for k, _ in x] for x in found], pa.list_(pa.int32())),
                 pa.array([[t for _, t in x] for x in found], pa.list_(pa.string()))],
                names=["row", "host", "version", "n_words", "page_id", "url", "kinds", "texts"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about SLICE_CHARS letters."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.array([sum(map(len, x)) for x in b.column("texts").to_pylist()], np.int64)
        owner = (np.cumsum(sizes) - sizes) // SLICE_CHARS
        edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        for at, end in zip(edges, [*edges[1:], b.num_rows], strict=True):
            yield b.slice(at, end - at)


def _near_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands and sketch of the main text of each page with a container."""
    for b in _slices(batches):
        main = [" ".join(t for k, t in zip(kinds, texts, strict=True) if k == MAIN).encode("utf-8", "surrogatepass")
                for kinds, texts in zip(b.column("kinds").to_pylist(), b.column("texts").to_pylist(), strict=True)]
        sets, sizes = near_text.shingles(*near_text.word_hashes(main))
        some = sizes > 0
        if not some.any():
            continue
        sig = near_text.signatures(sets, sizes[some])
        _, sketch = near_text.posting_keys(sig)
        hosts = np.array([_digest(x or "") for x in b.column("host").to_pylist()], np.int64)[some].view(np.uint64)
        symbols = near_text.mixed((sig[:, :BANDS * BAND].astype(np.uint64) << np.uint64(8)) + np.arange(BANDS * BAND, dtype=np.uint64))
        bands = near_text.mixed(symbols.reshape(-1, BANDS, BAND).sum(axis=2, dtype=np.uint64) + hosts[:, None])
        versions = b.column("version").to_numpy()[some]
        # copies of a host in the slice are posted once
        _, one = np.unique(np.stack([versions, hosts.view(np.int64)]), axis=1, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(bands[one].ravel().view(np.int64)), pa.array(np.repeat(versions[one], BANDS)),
                                          pa.array(np.repeat(sketch[one].view(np.int64), BANDS))], names=["band", "version", "sketch"])


def near_versions(read: DataFrame) -> DataFrame:
    """(node, root) of the versions that are linked with another one: every
    version meets the first one of its bands, in a stream sorted by band."""
    postings = read.filter(F.array_contains("kinds", MAIN)).select("host", "version", "kinds", "texts").mapInArrow(_near_postings, POSTING)
    rows = postings.select(F.col("band").alias("key"), F.col("version").alias("id"), F.col("version").alias("root"), "sketch")
    met = rows.repartition("key").sortWithinPartitions("key", "root").mapInArrow(near_text._to_first, "id long, first long, apart int")
    met = met.filter(F.col("apart") <= SKETCH_ERRORS)
    return components(met.select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())


def _page_suffixes(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Page (in the batch), block, kind, place, key and anchor of all suffixes of the batch."""
    kinds = b.column("kinds").to_pylist()
    hosts = np.array([_digest(x or "") for x in b.column("host").to_pylist()], np.int64).view(np.uint64)
    page = np.repeat(np.arange(b.num_rows), [len(k) for k in kinds])
    kind = np.array([x for k in kinds for x in k], np.int64)
    block = np.array([i for k in kinds for i in range(len(k))], np.int64)
    salts = hosts[page] + np.where(kind == MAIN, _INSIDE, np.uint64(0))
    at, place, keys, anchors = suffix_keys([t for x in b.column("texts").to_pylist() for t in x], salts, kind == MAIN)
    return page[at], block[at], kind[at], place, keys, anchors


def _post(parts: int, linked, sieve=None, sieve_parts: int = 0, sparse: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct suffixes of a slice of pages (``sparse``: the sieve keys of their
        anchors) by part of the array, each with up to three versions that have it.
        With a sieve only those whose anchor is in it."""
        nodes, roots = linked.value if linked else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for b in _slices(batches):
            page, _, _, _, keys, anchors = _page_suffixes(b)
            if sparse:
                change = np.append(True, (anchors[1:] != anchors[:-1]) | (page[1:] != page[:-1]))[:len(anchors)]
                page, keys = page[change], _sieve_keys(anchors[change], parts)
            elif sieve is not None:
                some = _among(_sieve_keys(anchors, sieve_parts).view(np.int64), sieve.value)
                page, keys = page[some], keys[some]
            if not len(keys):
                continue
            versions = b.column("version").to_numpy().copy()
            if len(nodes):
                at = np.minimum(np.searchsorted(nodes, versions), len(nodes) - 1)
                versions = np.where(nodes[at] == versions, roots[at], versions)
            marks = (near_text.mixed(versions.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)[page]
            part = keys >> np.uint64(32) if sparse else keys % np.uint64(parts)
            order = np.lexsort((marks, keys) if sparse else (marks, keys, part))
            keys, marks, part = keys[order], marks[order], part[order].astype(np.int64)
            new = np.r_[True, keys[1:] != keys[:-1]]
            last = np.r_[new[1:], True]
            # of equal suffixes the first and the last stay, if they are of two versions, and one between
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            end = len(new) - 1 - np.maximum.accumulate(np.where(last[::-1], np.arange(len(new)), 0))[::-1]
            other = (marks != marks[first]) & (marks != marks[end]) & ~new
            third = other & ~np.append(False, other[:-1] & ~new[1:])
            keep = new | last & (marks != marks[first]) | third
            keys, marks, part = keys[keep].astype(np.uint32 if sparse else np.uint64), marks[keep], part[keep]
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = np.r_[edges[1:], len(part)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[edges]), pa.array([keys[i:j].tobytes() for i, j in zip(edges, ends, strict=True)], pa.binary()),
                 pa.array([marks[i:j].tobytes() for i, j in zip(edges, ends, strict=True)], pa.binary())],
                names=["part", "keys", "versions"])
    return run


def _repeated(sparse: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part. Keys that enough versions have."""
        def found() -> pa.RecordBatch:
            keys, marks = np.frombuffer(b"".join(held[0]), np.uint32 if sparse else np.uint64), np.frombuffer(b"".join(held[1]), np.uint32)
            order = np.lexsort((marks, keys))
            keys, marks = keys[order], marks[order]
            new = np.append(True, (keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1]))
            keys, n = np.unique(keys[new].astype(np.uint64), return_counts=True)
            keys = np.uint64(part << 32) | keys if sparse else keys
            keys = keys[n >= np.where((keys >> np.uint64(32) if sparse else keys) & np.uint64(1), VERSIONS, 2)]
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

        part, held = None, ([], [])
        for b in batches:
            for p, keys, versions in zip(b.column("part").to_pylist(), b.column("keys").to_pylist(), b.column("versions").to_pylist(), strict=True):
                if p != part:
                    if held[0]:
                        yield found()
                    part, held = p, ([], [])
                held[0].append(keys)
                held[1].append(versions)
        if held[0]:
            yield found()
    return run


def _targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of the blocks whose coverage decides."""
    for b in _slices(batches):
        page, block, kind, place, keys, _ = _page_suffixes(b)
        own = kind != HINTED
        yield pa.RecordBatch.from_arrays(
            [pa.array(b.column("row").to_numpy()[page[own]]), pa.array(block[own].astype(np.int32)), pa.array(place[own].astype(np.int32)),
             pa.array(keys[own].view(np.int64))], names=["row", "block", "place", "key"])


def chosen_text(kinds: list[int], texts: list[str], places: list[tuple[int, int]]) -> str:
    """The page's text, given where repeated runs start (block, place)."""
    covered: dict[int, set[int]] = {}
    for block, place in places:
        covered.setdefault(block, set()).update(range(place, place + RUN))
    sizes = [len(t.split()) for t in texts]
    hit = [sum(p < n for p in covered.get(i, ())) for i, n in enumerate(sizes)]
    fresh = {kind: sum(sizes[i] - hit[i] for i, k in enumerate(kinds) if k == kind) for kind in (MAIN, NEUTRAL)}
    if MAIN not in kinds:
        own = [i for i, k in enumerate(kinds) if k == NEUTRAL]
    elif fresh[NEUTRAL] > fresh[MAIN] > 0:  # a small element that is only named like a container
        own = [i for i, k in enumerate(kinds) if k != HINTED]
    else:
        own = [i for i, k in enumerate(kinds) if k == MAIN]
    copy = 2 * sum(hit[i] for i in own) > sum(sizes[i] for i in own)
    return "\n".join(texts[i] for i in own if 2 * hit[i] < sizes[i] or copy and sizes[i] >= SHORT)


def _rows_out(b: pa.RecordBatch, out: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()),
                                       pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _rows_out(b, [chosen_text(k, t, [(p["block"], p["place"]) for p in places or ()]) for k, t, places in zip(
            *(b.column(c).to_pylist() for c in ("kinds", "texts", "places")), strict=True)])


def _look_up(repeated):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = repeated.value
        for b in _slices(batches):
            page, block, _, place, keys, _ = _page_suffixes(b)
            hit = _among(keys.view(np.int64), known)
            places: dict[int, list[tuple[int, int]]] = {}
            for p, i, x in zip(page[hit].tolist(), block[hit].tolist(), place[hit].tolist(), strict=True):
                places.setdefault(p, []).append((i, x))
            yield _rows_out(b, [chosen_text(k, t, places.get(p, [])) for p, (k, t) in enumerate(zip(
                b.column("kinds").to_pylist(), b.column("texts").to_pylist(), strict=True))])
    return run


def extract(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    rows = rows.select(F.xxhash64("page_id", "url", "html").alias("row"), "page_id", "url", "html")
    read = materialize(rows.mapInArrow(_read, READ), "blocks")
    sc = pages.sparkSession.sparkContext
    roots = near_versions(read)
    linked = None
    columns = ["row", "host", "version", "kinds", "texts"]
    posted = read.select(*columns)
    if roots.count() <= broadcast_rows:
        table = roots.orderBy("node").toArrow()
        linked = sc.broadcast((table["node"].to_numpy(), table["root"].to_numpy()))
    else:
        posted = posted.join(roots, F.col("version") == F.col("node"), "left") \
                       .withColumn("version", F.coalesce("root", "version")).select(*columns)
    n_words = read.agg(F.sum("n_words")).first()[0] or 0
    parts, sparse_parts = (max(PARTS, n_words // n // 2 * 2) for n in (PART_SUFFIXES, SPARSE_SUFFIXES))

    def neighbours(array: DataFrame, sparse: bool) -> DataFrame:
        rows = array.repartition("part").sortWithinPartitions("part").mapInArrow(_repeated(sparse), "key long")
        return materialize(rows, "anchors" if sparse else "repeated")

    def shared(table: DataFrame):
        return sc.broadcast(np.sort(table.toArrow()["key"].to_numpy()))

    # neighbours in the array with equal prefixes, from at least two distinct pages: anchors first
    anchors = neighbours(posted.mapInArrow(_post(sparse_parts, linked, sparse=True), PART), True)
    sieve = shared(anchors) if anchors.count() <= broadcast_rows else None
    repeated = neighbours(posted.mapInArrow(_post(parts, linked, sieve, sparse_parts), PART), False)
    result = "page_id long, url string, text string, n_chars long"
    if repeated.count() <= broadcast_rows:
        return read.select("host", "page_id", "url", "kinds", "texts").mapInArrow(_look_up(shared(repeated)), result)
    targets = read.select(*columns).mapInArrow(_targets, SUFFIX)
    places = targets.join(repeated, "key").groupBy("row").agg(F.collect_set(F.struct("block", "place")).alias("places"))
    return read.join(places, "row", "left").select("page_id", "url", "kinds", "texts", "places").mapInArrow(_choose, result)
