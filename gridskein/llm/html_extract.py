"""Main text of HTML pages by their structure and a suffix array of each host.

A page's token stream is the words of its blocks (paragraphs, list items,
headings) in page order.  The suffix array of a host has the suffixes of what its
pages have outside their articles (``article`` or ``main``): suffixes get bucket
identifiers by prefix doubling (of 1, 2, 4 and ``words`` tokens, begun with the
host's name) and are sorted on them, so suffixes with a long common prefix are
neighbours, and a run of neighbours gives the number of distinct pages that
repeat a substring.  Repeated substrings overlap to longer ones.  Boilerplate is

* on pages without an article: what PAGES distinct pages of the host repeat,
  however many the host has;
* in articles: what half of the host's distinct pages have outside theirs (a
  notice that some templates put into the article).

Covered tokens go where they make up a whole block or ``INSIDE`` tokens of one;
what is left of a block stays.  Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments go by their markup in any
case, as text of its own on each page can't be told by repeats.  Pages with equal
streams are one page here, so copies don't make an article boilerplate.

Scale: suffixes are dealt by ranges of host, bucket and page, so a host or a
substring with a third of all pages spans many tasks; a task passes on one row
for each run of neighbours.  Articles, most of the text, aren't shuffled: their
windows pass a filter of fixed size with the boilerplate's identifiers, and only
those that it may hold are joined.  The pages themselves are joined with what was
found for them, broadcast if that is no more than ``BROADCAST_ROWS`` rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import groupby
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import keyed, materialise
from ._filter import hash_filter, may_hold

#: Words of a long substring (a power of two), words that go from inside a block, pages that make boilerplate, rows that may be broadcast.
WORDS, INSIDE, PAGES, BROADCAST_ROWS = 8, 20, 3, 50_000
#: Share of a host's distinct pages that have a substring outside articles.
OUTSIDE_SHARE = 0.5

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|math|iframe|object|audio|video|canvas|textarea|title|xmp|noembed|noframes)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s>/]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z]+")
_BLOCKS = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table caption tbody td tfoot th thead tr ul button".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUTSIDE = frozenset("head nav footer aside form dialog menu search select button fieldset".split())
#: Parts of class, id and role names that mark what isn't main text.
_OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar sidenav widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations comment comments reply replies respond disqus pagination pager footer copyright masthead toolbar search "
    "complementary contentinfo".split()
)
_HEAD_NAMES = frozenset(("header",))


class _Open:
    __slots__ = ("name", "outside", "main")

    def __init__(self, name: str, outside: bool, main: bool):
        self.name, self.outside, self.main = name, outside, main


def _is_outside(name: str, attributes: str, in_main: bool) -> bool:
    if name in _OUTSIDE or name == "header" and not in_main:
        return True
    if name in ("html", "body", "main") or not attributes:
        return False
    parts = {p for m in _NAMES.finditer(attributes) for p in _PART.findall(m[1].lower())}
    return bool(parts & _OUTSIDE_NAMES) or not in_main and bool(parts & _HEAD_NAMES)


def page_blocks(html: str) -> list[tuple[str, int]]:
    """(text, zone) of a page's blocks in order; zone 2: in an article, 1: open, 0: outside the main text by its markup."""
    blocks: list[tuple[str, int]] = []
    words: list[str] = []
    stack: list[_Open] = []
    zone = 1

    def flush():
        if words:
            text = " ".join("".join(words).split())
            if text:
                blocks.append((text, zone))
            words.clear()

    def text(raw: str):
        if raw:
            words.append(unescape(raw) if "&" in raw else raw)

    at = 0
    for m in _MARKUP.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1]:
                words.append(" ")
            continue
        if name == "br":
            words.append(" ")
            continue
        if name not in _BLOCKS:
            # Inline elements matter only if their names put them outside the main text.
            if m[2]:
                if not any(o.name == name for o in stack):
                    continue
            elif name in _VOID or m[4].endswith("/") or not _is_outside(name, m[4], zone == 2):
                continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    flush()
                    del stack[k:]
                    break
            else:
                if name in _BLOCKS:
                    flush()
                continue
        else:
            flush()
            if name in _VOID:
                continue
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1].name == name:
                stack.pop()  # its end tag may be left out
            before = stack[-1] if stack else _Open("", False, False)
            outside = before.outside or _is_outside(name, m[4], before.main)
            main = not outside and (before.main or name in ("article", "main"))
            stack.append(_Open(name, outside, main))
        zone = 1 if not stack else 0 if stack[-1].outside else 2 if stack[-1].main else 1
    text(html[at:])
    flush()
    if any(z == 2 for _, z in blocks):
        blocks = [(t, z if z == 2 else 0) for t, z in blocks]
    return blocks


def host_of(url: str | None) -> str:
    """The URL's host in lower case, without ``www.``; empty if it has none."""
    url = (url or "").strip()
    try:
        return (urlsplit(url if "://" in url else "//" + url).hostname or "").removeprefix("www.")
    except ValueError:
        return ""


_MUL = np.random.default_rng(11).integers(1, 2**63, 32, dtype=np.uint64) | np.uint64(1)
_ARTICLE = 2


def suffix_buckets(tokens: np.ndarray, words: int) -> np.ndarray:
    """Bucket identifiers of the first ``words`` tokens of all suffixes that have as many, by prefix doubling."""
    ids, size, level = tokens, 1, 0
    while size < words:
        ids = ids[:-size] * _MUL[2 * level] + ids[size:]
        ids ^= ids >> np.uint64(29)
        ids *= _MUL[2 * level + 1]
        ids ^= ids >> np.uint64(32)
        size, level = size * 2, level + 1
    return ids


def _suffixes(blocks: list[tuple[str, int]], host: str, words: int, article: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first tokens, buckets, zones) of the suffixes of each stretch of a page's stream in or outside its article; tokens count through the page."""
    seed = xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))
    at = 0
    for inside, stretch in groupby(blocks, lambda b: b[1] == _ARTICLE):
        texts = list(stretch)
        tokens = [w for t, _ in texts for w in t.split(" ")]
        if inside == article and len(tokens) >= words:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in tokens), np.uint64, len(tokens))
            zones = np.repeat([z for _, z in texts], [t.count(" ") + 1 for t, _ in texts])
            zones = np.lib.stride_tricks.sliding_window_view(zones, words).max(axis=1)
            yield at + np.arange(len(zones)), suffix_buckets(hashes, words), zones
        at += len(tokens)


def _suffix_rows(words: int):
    """Pages to the suffixes outside articles, and a row without a bucket for each page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                batch = whole.slice(s, 500)
                of, hosts, streams, first, buckets, zones = ([] for _ in range(6))
                for k, (url, html) in enumerate(zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True)):
                    host, blocks = host_of(url), page_blocks(html or "")
                    hosts.append(host)
                    streams.append(xxhash.xxh64_intdigest("\n".join(f"{z}{t}" for t, z in blocks).encode("utf-8", "surrogatepass")) - (1 << 63))
                    for a, b, z in _suffixes(blocks, host, words, article=False):
                        of.append(np.full(len(a), k))
                        first.append(a)
                        buckets.append(b)
                        zones.append(z)
                n = batch.num_rows
                of = np.concatenate([np.arange(n), *of])
                none = np.arange(len(of)) < n
                at = pa.array(of)
                columns = [batch["__id"].take(at), batch["__th"].take(at), pa.array(hosts, pa.string()).take(at), pa.array(streams, pa.int64()).take(at)]
                columns += [pa.array(np.concatenate([np.zeros(n, np.int64), *first]).astype(np.int32)), pa.array(np.concatenate([np.zeros(n, np.int64), *zones]).astype(np.int32))]
                columns += [pa.array(np.concatenate([np.zeros(n, np.uint64), *buckets]).view(np.int64), mask=none)]
                yield pa.RecordBatch.from_arrays(columns, ["__id", "__th", "host", "stream", "first", "zone", "bucket"])

    return rows


def _run_rows(min_pages: int):
    """Sorted suffixes (host, bucket, stream, zone) to runs of neighbours in a bucket: distinct pages, and those that have it outside the main text."""

    def runs(table: pa.Table) -> pa.RecordBatch:
        host = table["host"].combine_chunks().dictionary_encode()
        h, b, s, z = host.indices.to_numpy(), *(table[c].to_numpy() for c in ("bucket", "stream", "zone"))
        new = np.r_[True, (h[1:] != h[:-1]) | (b[1:] != b[:-1])]
        page = np.flatnonzero(new | np.r_[True, s[1:] != s[:-1]])
        out = np.maximum.reduceat((z == 0).astype(np.int64), page)
        first = np.flatnonzero(new[page])
        n, out = np.diff(np.r_[first, len(page)]), np.add.reduceat(out, first)
        keep = n >= min_pages
        keep[[0, -1]] = True  # the neighbours before and after may go on
        rows = pa.array(page[first][keep])
        return pa.RecordBatch.from_arrays([table["host"].combine_chunks().take(rows), table["bucket"].combine_chunks().take(rows), pa.array(n[keep]), pa.array(out[keep])], ["host", "bucket", "n", "out"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # A page's rows in a bucket stay together: those at the end wait for the next batch.
            h, b, s = (batch[c] for c in ("host", "bucket", "stream"))
            last = batch.num_rows - 1
            cut = last
            while cut > 0 and s[cut - 1] == s[last] and b[cut - 1] == b[last] and h[cut - 1] == h[last]:
                cut -= 1
            if cut:
                yield runs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield runs(pa.Table.from_batches(held))

    return rows


def _article_rows(words: int, filled: np.ndarray):
    """Pages to the windows of their articles that the filter may hold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (url, html) in enumerate(zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True)):
                host = host_of(url)
                for first, buckets, _ in _suffixes(page_blocks(html or ""), host, words, article=True):
                    at = may_hold(filled, buckets)
                    if len(at):
                        which = pa.array(np.full(len(at), k))
                        columns = [batch["__id"].take(which), batch["__th"].take(which), pa.array([host] * len(at), pa.string()), pa.array(first[at].astype(np.int32)), pa.array(buckets[at].view(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, ["__id", "__th", "host", "first", "bucket"])

    return rows


def without_runs(blocks: list[tuple[str, int]], first: Iterable[int], words: int, inside: int) -> list[str]:
    """Texts of a page's main blocks without the tokens that windows cover which begin at ``first``, where those are a whole block or ``inside`` tokens of one."""
    covered = {at + k for at in first for k in range(words)}
    texts, at = [], 0
    for text, zone in blocks:
        tokens = text.split(" ")
        gone = [at + k in covered for k in range(len(tokens))]
        at += len(tokens)
        if not zone or all(gone):
            continue
        if any(gone):
            kept: list[str] = []
            for is_gone, run in groupby(zip(tokens, gone, strict=True), lambda x: x[1]):
                own = [w for w, _ in run]
                if not is_gone or len(own) < inside:
                    kept += own
            text = " ".join(kept)
        texts.append(text)
    return texts


def _text_rows(names: list[str], words: int, inside: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, first in zip(batch["__html"].to_pylist(), batch["__first"].to_pylist(), strict=True):
                blocks = page_blocks(html or "")
                texts.append("\n".join(without_runs(blocks, first, words, inside) if first else [t for t, z in blocks if z]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(texts, pa.string())], [*names, "main_text"])

    return rows


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", words: int = WORDS, inside: int = INSIDE, min_pages: int = PAGES, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """All columns of ``pages``, and ``main_text``: the main blocks, joined by line ends.

    Character references are decoded, white space inside a block (line breaks too)
    becomes one space, and blocks are trimmed.  Null and empty pages, and pages
    without main text, have the empty text.  Unclosed elements end with their
    container or the page.  Null URLs share the empty host.  Repeated rows get
    equal texts.  An input column ``main_text`` is replaced; an empty table gives
    an empty one.
    """
    if words & (words - 1):
        raise ValueError("words must be a power of two")
    pages = pages.drop("main_text")
    names = pages.columns
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema]
    html, url = F.col(f"`{html_col}`").cast("string"), F.col(f"`{url_col}`").cast("string")
    rows = keyed(pages, id_col, html_col).withColumn("__th", F.xxhash64("__th", url))
    sources = rows.select("__id", "__th", url.alias("url"), html.alias("html"))
    suffixes = materialise(sources.mapInArrow(_suffix_rows(words), "__id string, __th long, host string, stream long, first int, zone int, bucket long"), "suffixes")
    # The suffix array: its runs of neighbours, put together where ranges and batches cut them.
    order = ["host", "bucket", "stream"]
    array = suffixes.filter("bucket IS NOT NULL").select(*order, "zone").repartitionByRange(*order).sortWithinPartitions(*order)
    runs = array.mapInArrow(_run_rows(min_pages), "host string, bucket long, n long, out long").groupBy("host", "bucket").agg(F.sum("n").alias("n"), F.sum("out").alias("out"))
    sizes = suffixes.filter("bucket IS NULL").select("host", "stream").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    least = F.greatest(F.lit(min_pages), OUTSIDE_SHARE * F.col("size"))
    repeated = materialise(runs.filter(F.col("n") >= min_pages).join(sizes, "host").select("host", "bucket", (F.col("out") >= least).alias("template")), "repeated")
    found = suffixes.filter("zone = 1 AND bucket IS NOT NULL").join(repeated, ["host", "bucket"]).select("__id", "__th", "first")
    templates = repeated.filter("template")
    if not templates.isEmpty():
        windows = sources.mapInArrow(_article_rows(words, hash_filter(templates, "bucket")), "__id string, __th long, host string, first int, bucket long")
        found = found.unionByName(windows.join(templates, ["host", "bucket"]).select("__id", "__th", "first"))
    found = materialise(found.groupBy("__id", "__th").agg(F.collect_set("first").alias("__first")), "boilerplate")
    small = F.broadcast(found) if found.count() <= broadcast_rows else found
    joined = rows.join(small, ["__id", "__th"], "left").select(*[F.col(f"`{c}`") for c in names], html.alias("__html"), "__first")
    return joined.mapInArrow(_text_rows(names, words, inside), ", ".join([*kinds, "main_text string"]))
