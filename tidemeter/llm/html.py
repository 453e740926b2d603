"""Main text of web pages by differencing them with the page of the nearest URL.

Pages of a host are put in order of their URL paths; each is paired with the
neighbour that shares the longer path prefix. Both are read as lines of text,
the longest common subsequence of their lines is found, and lines in it are
template: they go. Markup says where lines stand. Those in menus, headers,
footers, forms and the like go in any case. A check follows where a page marks
its article: mirrored pages share whole articles, which
differencing alone would delete, so the article's lines come back and others go. Pages of a host with equal lines are one class,
paired with the nearest page of other lines; every page meets the lines of its pair.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from html import unescape
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_batches, rows_of, width

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*+)>|<[!?/][^>]*>""",
    re.S | re.I,
)
_attribute = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_part = re.compile(r"[a-z]+")
#: Elements that never hold main text, those that begin a block, and those without content.
OUTSIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "object", "canvas", "video", "audio"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: What holds a paragraph or an item: an open one before it is another's.
HOLDERS = {"ul", "ol", "div", "article", "section", "main", "td", "nav", "aside", "footer", "header", "form"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of a class, id or role that mean the same as an element of OUTSIDE.
MARKS = {"nav", "navbar", "navigation", "menu", "header", "masthead", "footer", "sidebar", "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "banner", "cookie", "cookies", "consent", "notice", "notices", "popup", "modal", "promo", "newsletter", "subscribe", "share", "sharing", "social", "related", "comment", "comments", "breadcrumb", "breadcrumbs", "login", "search", "pagination", "widget", "disqus", "complementary", "contentinfo"}
MAIN, NEUTRAL, DROPPED = 2, 1, 0


def lines(page: str | None) -> list[tuple[str, int]]:
    """(text, zone) of each block with text, in page order: white space is one space, references are decoded."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []
    # how many open elements have each name, are outside and are main, and where those stand that end the search for an open p or li
    names, outsides, mains = Counter(), 0, 0
    ends: dict[str, list[int]] = {"p": [], "li": []}
    held: list[str] = []
    zone = NEUTRAL
    page = page or ""

    def flush():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((text, zone))

    def push(tag: str, outside: bool, main: bool) -> None:
        nonlocal outsides, mains
        for kind, at in ends.items():
            if tag == kind or tag in HOLDERS:
                at.append(len(stack))
        stack.append((tag, outside, main))
        names[tag] += 1
        outsides += outside
        mains += main

    def pop() -> str:
        nonlocal outsides, mains
        tag, outside, main = stack.pop()
        for at in ends.values():
            if at and at[-1] == len(stack):
                at.pop()
        names[tag] -= 1
        outsides -= outside
        mains -= main
        return tag

    def place() -> int:
        return DROPPED if outsides else MAIN if mains else NEUTRAL

    # every tag ends by the last ">": a search up to there never runs on in vain
    at, end = 0, page.rfind(">") + 1
    last = None
    for last in _token.finditer(page, 0, end):
        m = last
        if m.start() > at:
            held.append(unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1] is None and page.startswith("<![CDATA[", m.start()):
                held.append(page[m.start() + 9 : m.end()].removesuffix("]]>"))
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if m[2]:
            while names[tag] and pop() != tag:
                pass
        elif tag not in VOID and not m[4].rstrip().endswith("/"):
            words = {w for _, v in _attribute.findall(m[4]) for w in _part.findall(v.lower())} if m[4] else set()
            main = tag in ("article", "main") or "articlebody" in words or ("main" in words and tag in ("div", "section"))
            outside = tag in OUTSIDE or (bool(words & MARKS) and tag not in ("html", "body", "main"))
            if main and not outside:
                # an article does not stand in a block left open before it
                while stack and stack[-1][1] and stack[-1][0] in ("p", "div", "span", "li", "ul", "b", "i"):
                    pop()
            if tag in ends and ends[tag] and stack[ends[tag][-1]][0] == tag:
                while pop() != tag:
                    pass
            push(tag, outside, main and not outside)
        if tag in BLOCKS:
            zone = place()
    if not (last and last.end() == end and _open(last)):
        # what begins a tag that never ends is no text
        rest = re.split(r"<[A-Za-z/!?]", page[at:], maxsplit=1)[0]
        held.append(unescape(rest))
    flush()
    return out


def _open(m: re.Match) -> bool:
    """Whether a comment or an element without markup inside runs on to the end."""
    if m[1]:
        return not re.search(rf"</{m[1]}\s*>$", m[0], re.I)
    return m[0].startswith("<!--") and not m[0].endswith("-->") or m[0].startswith("<![CDATA[") and not m[0].endswith("]]>")


#: Cells of a comparison of lines whose rows are kept at once; larger ones are halved.
CELLS = 1 << 27


def common(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence with b."""
    both = {*a} & {*b}
    left, right = [i for i, x in enumerate(a) if x in both], [x for x in b if x in both]
    return [left[k] for k in _common([a[i] for i in left], right)]


def _rows(a: list, b: list) -> list[int]:
    """For each prefix of a a row of bits: zeros up to place j count the longest subsequence with b's first j."""
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [], full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _counts(a: list, b: list) -> list[int]:
    """Length of the longest common subsequence of a with each prefix of b, the empty one included."""
    v = full = (1 << len(b)) - 1
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return [0, *accumulate(1 - (v >> j & 1) for j in range(len(b)))] if len(b) < 4096 else [0, *accumulate(int(c == "0") for c in reversed(bin(v | 1 << len(b))[3:]))]


def _common(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > CELLS:
        half = len(a) // 2
        head, tail = _counts(a[:half], b), _counts(a[half:][::-1], b[::-1])
        j = max(range(len(b) + 1), key=lambda j: head[j] + tail[len(b) - j])
        return _common(a[:half], b[:j]) + [half + k for k in _common(a[half:], b[j:])]
    rows, full = _rows(a, b), (1 << len(b)) - 1
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    out, j = [], len(b)
    for k in range(len(a) - 1, -1, -1):
        if j <= 0:
            break
        # the row needs a[k] if the row above counts fewer
        mask = (1 << j) - 1
        above = rows[k - 1] if k else full
        need = (~rows[k] & mask).bit_count()
        if need > (~above & mask).bit_count():
            out.append(k)
            # the last place in b where this row's count drops
            hits, top = at.get(a[k], 0) & mask, 0
            while hits:
                top = hits.bit_length() - 1
                if (~above & ((1 << top) - 1)).bit_count() == need - 1:
                    break
                hits ^= 1 << top
            j = top
    return out[::-1]


#: Pages of a class that meet their pair's lines in one task, about.
CLASS_PAGES = 4096


def marked(own: list[tuple[str, int]]) -> bool:
    return any(z == MAIN for _, z in own)


def class_of(hashes: list[int]) -> str:
    """Pages with equal lines have the same one."""
    return xxhash.xxh128_hexdigest(b"".join(h.to_bytes(8, "little", signed=True) for h in hashes))


def line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def nearest_url(pages: DataFrame) -> DataFrame:
    """(host, key, other): for each host and key of (key, url), the key of the host's page with the nearest path and another key.

    A key's path is the least of its pages'. Keys are dealt by ranges of (host, path), so a host may spread over many
    partitions; each range's first and last rows, a row a range, link them.
    Rows whose URL names no host, and hosts of one key, have no pair.
    """
    path = F.regexp_replace(F.regexp_replace("url", r"^[^:/?#]+://[^/?#]*", ""), r"[?#].*$", "")
    keys = pages.select("key", host_of("url").alias("host"), path.alias("path")).where("host <> ''").groupBy("host", "key").agg(F.min("path").alias("path"))
    n = width(pages.sparkSession)
    ranged = cut(keys.repartitionByRange(n, "host", "path", "key").select("key", "host", "path", F.spark_partition_id().alias("part")))
    row = F.struct("host", "path", "key")
    ends = ranged.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    around = Window.orderBy("part")  # a row a partition
    ends = F.broadcast(ends.select("part", F.lag("last").over(around).alias("before"), F.lead("first").over(around).alias("after")))
    inside = Window.partitionBy("part").orderBy("host", "path", "key")
    sides = ranged.join(ends, "part").select(
        "key", "host", "path", F.coalesce(F.lag(row).over(inside), "before").alias("a"), F.coalesce(F.lead(row).over(inside), "after").alias("b")
    )

    @F.pandas_udf("int")
    def shared(x, y):
        import pandas as pd

        return pd.Series([len(os.path.commonprefix([p or "", q or ""])) for p, q in zip(x, y, strict=True)], dtype="int32")

    a, b = F.col("a.host") == F.col("host"), F.col("b.host") == F.col("host")
    fits = lambda side, same: F.when(same, shared("path", F.col(f"{side}.path"))).otherwise(F.lit(-1))
    near = sides.withColumn("pa", fits("a", F.coalesce(a, F.lit(False)))).withColumn("pb", fits("b", F.coalesce(b, F.lit(False))))
    return near.where("pa >= 0 or pb >= 0").select("host", "key", F.when(F.col("pa") >= F.col("pb"), F.col("a.key")).otherwise(F.col("b.key")).alias("other"))


def found(own: list[tuple[str, int]], hashes: list[int], other: list[int] | None) -> tuple[str, int, int]:
    """(text, shared, restored): the lines that differencing with the paired page leaves, after the check by markup; how many lines the pages share, and how many of these stay.

    Differencing comes first, on every page. Then what a page marks as its article is held against the mark: its shared lines
    come back, and what stands outside it goes. A page without a mark keeps what differencing leaves.
    """
    shared = {*common(hashes, other)} if other else set()
    if marked(own):
        stay = [k for k, (_, z) in enumerate(own) if z == MAIN]
    else:
        stay = [k for k, (_, z) in enumerate(own) if z == NEUTRAL and k not in shared] or [k for k, (_, z) in enumerate(own) if z == NEUTRAL]
    return "\n\n".join(own[k][0] for k in stay), len(shared), sum(k in shared for k in stay)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_lines, n_shared, n_restored) for every row of pages, from the whole html; an empty text if there is none.

    Every page is differenced with the page of the nearest URL; the article's mark, where there is one, is a check that follows.
    n_lines are a page's lines, n_shared those in the longest common subsequence with its pair, n_restored those of them that stay in the text.
    Null html counts as empty, a null url has no pair, repeated rows stay
    repeated, other columns are not read; deeply nested, unmatched and unfinished tags are
    read in time in proportion to the page. Pages are read twice: once for the hashes of their lines, which make the pairs, and once for the lines themselves, which travel
    compressed, without those that go in any case, to meet the hashes of the lines of their pair by host and class. That takes less disk than keeping the lines.
    """

    def keyed(batches):
        for urls, html in rows_of(batches, "url", "html"):
            hashes = [[line_hash(t) for t, _ in lines(h)] for h in html]
            columns = urls, [class_of(h) for h in hashes], hashes
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.list_(pa.int64())), strict=True)], ["url", "key", "hashes"])

    def read(batches):
        for ids, urls, html in rows_of(batches, "page_id", "url", "html"):
            got = [lines(h) for h in html]
            hashes = [[line_hash(t) for t, _ in x] for x in got]
            goes = [{DROPPED, NEUTRAL} if marked(x) else {DROPPED} for x in got]
            texts = [zlib.compress("\n".join("" if z in g else t for t, z in x).encode("utf-8", "surrogatepass"), 6) for x, g in zip(got, goes, strict=True)]
            columns = ids, urls, [class_of(h) for h in hashes], hashes, texts, [bytes(z for _, z in x) for x in got]
            kinds = pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "url", "key", "hashes", "lines", "zones"])

    def left(batches):
        for ids, urls, hashes, texts, zones, other in rows_of(batches, "page_id", "url", "hashes", "lines", "zones", "shared"):
            got = [found([*zip(zlib.decompress(t).decode("utf-8", "surrogatepass").split("\n"), z, strict=True)] if z else [], h, o) for t, z, h, o in zip(texts, zones, hashes, other, strict=True)]
            columns = ids, urls, [t for t, _, _ in got], [len(h) for h in hashes], [n for _, n, _ in got], [n for _, _, n in got]
            kinds = pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "url", "text", "n_lines", "n_shared", "n_restored"])

    known = cut(in_batches(pages.select("url", "html")).mapInArrow(keyed, "url string, key string, hashes array<long>")).withColumn("host", host_of("url"))
    pairs = nearest_url(known)
    texts = known.select(F.col("key").alias("other"), "hashes").join(pairs.select("other").distinct(), "other", "left_semi").groupBy("other").agg(F.min("hashes").alias("shared"))
    pairs = pairs.join(texts, "other").select("host", "key", "shared")
    # a class of very many equal pages is dealt over several tasks; there are fewer of them than pages by CLASS_PAGES
    many = F.broadcast(known.groupBy("host", "key").agg(F.ceil(F.count("*") / CLASS_PAGES).cast("int").alias("parts")).where("parts > 1"))
    parts, by = F.coalesce("parts", F.lit(1)), ["host", "key"]
    texts = in_batches(pages.select("page_id", "url", "html")).mapInArrow(read, "page_id long, url string, key string, hashes array<long>, lines binary, zones binary")
    dealt = texts.withColumn("host", host_of("url")).join(many, by, "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), parts).cast("int"))
    pairs = pairs.join(many, by, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    both = dealt.join(pairs, [*by, "part"], "left").select("page_id", "url", "hashes", "lines", "zones", "shared")
    return in_batches(both).mapInArrow(left, "page_id long, url string, text string, n_lines long, n_shared long, n_restored long")
