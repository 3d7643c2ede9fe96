"""Main text of web pages by differencing each page with its nearest neighbour on the same host.

1. Every page is split into text lines, one per block of its markup, each with the zone it stands
   in: `main` (inside an article or main element), `chrome` (inside a menu, header, footer, side
   bar, form, or a block whose class, id or role holds a name of `_NAMED` as a whole word) or `open`
   (anywhere else). A main element, or an article that is not itself named so, leads out of a header,
   a form or a named block again. Headings are not judged by name, nor is any part of a longer name
   (`no-sidebar`, `social-policy`): what is in doubt is left to the difference.
2. Pages are paired by URL: in order of host and path, a page's mate is the one of its two
   neighbours on the host whose path shares the longer beginning with its own.
3. The lines of page and mate are aligned by longest common subsequence and the shared ones deleted.

Markup outranks the difference: a `main` line stays though a mate has it too (two articles may quote
one passage, and copies of an article would delete each other), a `chrome` line goes though no mate
has it (menus may differ from page to page). The difference therefore decides all `open` lines, that
is, whole pages that do not mark their article. Between copies of one page, where less than a tenth of
the open lines would be left, it proves nothing and deletes nothing.

Pages meet as hashes of their lines. The pages themselves meet only the marks of deleted lines, and
only marks that change a text. Neighbours are found by a range partitioning on (host, path, key): no
task holds a host. Only the URL keys are sorted; a window runs inside one range, and the first and
last key of each range, a table of as many rows as ranges, join the ranges. A page is looked up by
two mates at most.

Cases: a null or empty page gives an empty text and 0 characters. A null URL is a host of its own
with an empty path. Pages are read whole. Repeated pages are copies. A host with one page has no
mate and nothing to delete. Character references are decoded; unclosed elements end with their
parent. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.llm import words as W
from candlewright.llm.common import written

#: NAMED is chrome by a name, a form or a header, which an article inside it takes back.
MAIN, OPEN, CHROME, NAMED = 0, 1, 2, 3

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_DROPPED = frozenset("script style noscript template svg math iframe object video audio canvas select textarea button title".split())
_CHROME = frozenset("nav footer aside form dialog menu".split())
#: Whole class, id and role words that name what is no article. Words that also name content (notice, social, promotion) are not here.
_NAMED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsored sponsor-box promo-box banner cookie-banner cookie-bar cookie-notice cookie-consent consent-banner gdpr-banner popup modal "
    "nav navbar nav-bar nav-menu navigation main-nav site-nav site-navigation main-menu menubar breadcrumb breadcrumbs sidebar side-bar footer site-footer page-footer masthead site-header page-header "
    "comments comment comment-list comment-form comment-respond comments-area comments-section respond related-posts related-articles share-buttons share-bar sharing-buttons social-share social-links "
    "newsletter-signup newsletter-form signup-form login-form pagination skip-link".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S,
)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Elements that an opening tag of the same kind closes.
_CLOSES = {"p": ("p",), "li": ("li", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",)}


def _raw_end(page: str, tag: str, at: int) -> int:
    end = re.compile(rf"</{tag}\s*>|</{tag}\Z", re.I).search(page, at)
    return end.start() if end else len(page)


def lines_of(page: str) -> list[tuple[str, int]]:
    """Text and zone of every block, in page order."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # element and the zone inside it
    parts: list[str] = []
    zone = OPEN

    def end_block() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((text, zone))

    at, raw = 0, ""
    while True:
        m = _TOKEN.search(page, at)
        data = page[at : m.start() if m else len(page)]
        if data:
            parts.append(html_lib.unescape(data))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in _DROPPED and not m[1] and not m[3].rstrip().endswith("/"):
            at = _raw_end(page, tag, at)
            raw = tag
            continue
        if tag in _DROPPED and m[1] and tag == raw:
            raw = ""
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag not in _INLINE:
            end_block()
        if tag in _VOID or m[3].rstrip().endswith("/"):
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if depth >= 0:
                if any(x[0] not in _INLINE for x in stack[depth:]):
                    end_block()
                del stack[depth:]
                zone = stack[-1][1] if stack else OPEN
            continue
        if tag in _CLOSES:
            while stack and (stack[-1][0] in _CLOSES[tag] or stack[-1][0] in _INLINE and any(x[0] in _CLOSES[tag] for x in stack)):
                stack.pop()
            zone = stack[-1][1] if stack else OPEN
        inner = zone
        names = {w.replace("_", "-") for n in _NAMES.findall(m[3]) for x in n for w in x.lower().split()} if m[3] else ()
        if zone != CHROME:
            named = tag not in ("html", "body", "main") and tag not in _HEADINGS and not _NAMED.isdisjoint(names)
            if tag in _CHROME and tag != "form" or m[3] and _HIDDEN.search(m[3]):
                inner = CHROME
            elif named or tag == "form" or tag == "header" and zone != MAIN:
                inner = NAMED
            elif tag in ("article", "main"):
                inner = MAIN
        if inner != zone:
            end_block()
        stack.append((tag, inner))
        zone = inner
    end_block()
    return out


def common_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of a belong to a longest common subsequence with b. Linear memory, by halving."""
    keep = np.zeros(len(a), bool)

    def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        row = np.zeros(len(y) + 1, np.int32)
        for v in x:
            step = row.copy()
            step[1:] = np.maximum(row[1:], row[:-1] + (y == v))
            row = np.maximum.accumulate(step)
        return row

    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            keep[a0] = True
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            keep[a1 - 1] = True
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            keep[a0] = bool((b[b0:b1] == a[a0]).any())
            continue
        mid = (a0 + a1) // 2
        cut = b0 + int(np.argmax(lengths(a[a0:mid], b[b0:b1]) + lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]))
        todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return keep


def shared_lines(lines: np.ndarray, zones: np.ndarray, mate: np.ndarray) -> np.ndarray:
    """Which lines (as hashes) the difference deletes: those in a longest common subsequence with the mate's, unless
    they leave less than a tenth of the page's open lines, as in copies of one page."""
    shared = common_subsequence(lines, mate)
    if 10 * (~shared & (zones == OPEN)).sum() < (zones == OPEN).sum():
        shared &= zones != OPEN
    return shared


def main_text(lines: list[tuple[str, int]], shared: list[bool] | None) -> str:
    """The lines left of a page: an article's own by its markup, else the open ones that the difference kept."""
    shared = shared or [False] * len(lines)
    marked = any(z == MAIN for _, z in lines)
    return "\n".join(x for (x, z), s in zip(lines, shared, strict=True) if z == MAIN or z == OPEN and not marked and not s)


def nearest_pages(keys: DataFrame, rows_per_range: int = 50_000) -> DataFrame:
    """key and mate (the mate's key) for every page of keys (key, url) with another page on its host."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*", ""), r"[?#].*$", "")
    ranges = max(1, -(-keys.count() // rows_per_range))
    order = ["host", "path", "key"]
    # Written, so that the ranges are the same for each use below.
    keys = written(keys.select("key", host.alias("host"), path.alias("path")).repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    near = F.struct("host", "path", "key")
    edges = keys.groupBy("__range").agg(F.min(near).alias("__first"), F.max(near).alias("__last"))
    every = Window.partitionBy(F.lit(0)).orderBy("__range")  # one row per range
    edges = edges.select("__range", F.lag("__last").over(every).alias("__left"), F.lead("__first").over(every).alias("__right"))
    inside = Window.partitionBy("__range").orderBy(*order)
    both = keys.withColumn("__prev", F.lag(near).over(inside)).withColumn("__next", F.lead(near).over(inside)).join(edges, "__range", "left")
    both = both.withColumn("__prev", F.coalesce("__prev", "__left")).withColumn("__next", F.coalesce("__next", "__right"))

    def alike(side: str) -> F.Column:
        return F.coalesce(F.when(F.col(side)["host"] == F.col("host"), common_prefix(F.col("path"), F.col(side)["path"])), F.lit(-1))

    left, right = alike("__prev"), alike("__next")
    mate = F.when(F.greatest(left, right) < 0, None).when(left >= right, F.col("__prev.key")).otherwise(F.col("__next.key"))
    return both.select("key", mate.alias("mate")).where("mate IS NOT NULL")


def common_prefix(a: F.Column, b: F.Column) -> F.Column:
    """Length of the longest common beginning of two strings."""
    differ = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differ == 0, F.length(a)).otherwise(differ - 1)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages (page_id, url, html)."""

    @F.arrow_udf("struct<lines:array<bigint>,zones:binary>")
    def outline(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for page in batches:
            found = [lines_of(x) if x else [] for x in page.to_pylist()]
            buf, offsets = W.text_buffer(pa.array([t for x in found for t, _ in x], pa.string()))
            hashes = pa.array(W.span_hashes(buf, offsets[:-1], offsets[1:]).view(np.int64))
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32())
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(cuts, hashes), pa.array([bytes(z for _, z in x) for x in found], pa.binary())], ["lines", "zones"])

    @F.arrow_udf("array<boolean>")
    def align(lines: pa.Array, zones: pa.Array, mate: pa.Array) -> pa.Array:
        arrays = zip(lines.to_pylist(), zones.to_pylist(), mate.to_pylist(), strict=True)
        return pa.array([shared_lines(np.array(a, np.int64), np.frombuffer(z, np.uint8), np.array(m, np.int64)) for a, z, m in arrays], pa.list_(pa.bool_()))

    @F.arrow_udf("string")
    def text_of(html: pa.Array, shared: pa.Array) -> pa.Array:
        return pa.array([main_text(lines_of(x) if x else [], s) for x, s in zip(html.to_pylist(), shared.to_pylist(), strict=True)], pa.string())

    # Equal rows are one page; they have one key.
    keyed = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("key"))
    outlines = keyed.select("key", "url", outline("html").alias("o")).groupBy("key").agg(F.min(F.struct("url", "o")).alias("x")).select("key", "x.url", "x.o.*")
    outlines = written(outlines)
    mates = nearest_pages(outlines.select("key", "url")).join(outlines.select(F.col("key").alias("mate"), F.col("lines").alias("other")), "mate")
    aligned = outlines.join(mates, "key").select("key", "zones", align("lines", "zones", "other").alias("shared"))
    # Only marks that change a text travel on; if they are few they are broadcast and no page is shuffled.
    marked = F.expr(f"locate(unhex('{MAIN:02X}'), zones) > 0")
    shared = written(aligned.where(F.exists("shared", lambda x: x) & ~marked).select("key", "shared"))
    out = keyed.join(shared, "key", "left").select("page_id", "url", text_of("html", "shared").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
