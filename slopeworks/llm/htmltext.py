"""Main text of web pages by differencing each page against the page of the nearest URL on its host.

A page is split into lines, one per block of markup. Pages of a host with equal lines are one page, and
distinct pages are numbered by host, URL path and id. Lines are aligned with those of the nearest page by
longest common subsequence, and shared lines are deleted. A neighbour that shares most of the page's text
may be a copy of it, which says nothing about what is template, so the next nearest is looked at, at first
up to REACH numbers away. A page whose neighbours all share so much is compared with the nearest pages on
either side that have found another, however far, and with what these have found. If all of them share most
of it, what it has besides its template is short, and the neighbour that leaves most of it decides; so where
all pages of a host are nearly the same, what they share counts as template.

All lines of a page take part, those of menus and footers as well. Only their hashes (64 bits) are sorted and
compared; the texts that may stay meet the outcome in one join.

Differencing alone deletes sentences that two articles happen to share and leaves adverts, notices and comments that differ
from page to page. So markup corrects it both ways: it vetoes the deletion of a line within an
article or main element, and it deletes lines that differencing has left in elements that are menus, headers, footers,
sidebars, notices, adverts, forms or comments by their name, role or class. ``n_shared`` counts the lines that go by
differencing alone, ``n_both`` those that markup deletes as well, ``n_vetoed`` those that differencing would have deleted, and
``n_marked`` those that only markup deletes. Only where ``n_shared`` is not 0 does differencing change a page's text.

Defined cases: a null or empty html has an empty text; a null url is a host and path of its own; unclosed
elements end with the page; repeated rows are copies of each other; pages without lines are no
neighbours; on a host with one distinct page only markup decides; an empty table gives an empty result; html of any length is read whole.
Extra columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from html import unescape
from itertools import accumulate, groupby
from zlib import compress, decompress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm import base

#: Distinct pages on either side that are compared at first, nearest first.
REACH = 3
#: Distinct pages that are compared together; REACH more on either side are seen with them.
BUCKET = 64
#: A neighbour with more than this share of the page's characters may be a copy.
COPY = 0.8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_MARKS = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small",
    "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_MAIN = {"article", "main"}
_ASIDE = {"nav", "footer", "aside", "form", "button", "select", "noscript", "template", "iframe", "object", "svg", "math", "dialog", "head", "menu", "canvas", "audio", "video"}
_ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
_COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}
_ASIDE_MARKS = _COMMENTS | {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "footer", "gdpr", "header",
    "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promotion", "related", "share",
    "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: What the start of an element closes, if it is open and nearest.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}


@dataclass
class Line:
    text: str
    main: bool  # within an article
    aside: bool  # within something marked as no part of one


def _marked(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is marked as aside by its name or role, by its class or id, and as comments."""
    aside = name in _ASIDE
    classed = comments = False
    for key, *values in _MARKS.findall(attributes) if attributes.strip() else ():
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "role":
            aside |= value.lower() in _ASIDE_ROLES
        elif key == "hidden" or key == "aria-hidden":
            aside |= value.lower() in ("", "true", "hidden") if key == "hidden" else value.lower() == "true"
        else:
            parts = {p.lower() for p in _PART.findall(value)}
            classed |= bool(parts & _ASIDE_MARKS)
            comments |= bool(parts & _COMMENTS)
    return aside, classed, comments


def lines_of(html: str) -> list[Line]:
    """The page's lines in order, one for each block that has text."""
    found: list[Line] = []
    text: list[str] = []
    # open elements: name, in an article, aside by name or role, aside by class, in comments
    stack: list[tuple[str, bool, bool, bool, bool]] = [("", False, False, False, False)]

    def end_line() -> None:
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                _, main, aside, classed, _ = stack[-1]
                found.append(Line(joined, main, aside or classed))
            text.clear()

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        close, name, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue  # comments, scripts, styles, declarations
        name = name.lower()
        inline = name in _INLINE
        if not inline:
            end_line()
        if close:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if depth:
                del stack[depth:]
            continue
        if name in _VOID:
            continue
        if not inline:
            shut = _CLOSES.get(name, {"p"})
            depth = len(stack) - 1
            while depth and (stack[depth][0] in _INLINE):
                depth -= 1
            if depth and stack[depth][0] in shut:
                del stack[depth:]
        _, main, aside, classed, comments = stack[-1]
        own_aside, own_classed, own_comments = _marked(name, attributes or "")
        if name in ("html", "body"):
            own_aside = own_classed = own_comments = False
        if name in _MAIN and not comments:
            main, classed = True, False  # an article within a wrapper that is only named after its sidebar
        if name == "header" and not main:
            own_aside = True
        if name == "body" and stack[-1][0] == "head":
            aside = False
        stack.append((name, main, aside or own_aside, classed or own_classed, comments or own_comments))
    if at < len(html):
        text.append(html[at:])
    end_line()
    return found


def common(a: list, b: list) -> set[int]:
    """The positions in ``a`` of a longest common subsequence with ``b``, as the longest rising run of matches."""
    places: dict = {}
    for k in range(len(b) - 1, -1, -1):
        places.setdefault(b[k], []).append(k)
    ends: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i, x in enumerate(a):
        for k in places.get(x, ()):
            at = bisect_left(ends, k)
            link = (i, links[at - 1] if at else None)
            if at == len(ends):
                ends.append(k)
                links.append(link)
            else:
                ends[at], links[at] = k, link
    found, link = set(), links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def shared_lines(lines: list, sizes: list[int], others: list[list]) -> tuple[int, set[int]]:
    """Which of the others, nearest first, is taken (-1 where there is none), and the positions of the lines shared with it."""
    whole, best, at = sum(sizes), None, -1
    for k, other in enumerate(others):
        same = common(lines, other)
        size = sum(sizes[i] for i in same)
        if size <= COPY * whole:
            return k, same
        if best is None or size < best[0]:
            best, at = (size, same), k
    return at, best[1] if best else set()


def kept_lines(page: list[Line], shared: set[int]) -> tuple[list[int], int, int, int, int]:
    """Positions of the lines that stay, and how many go as shared only, as shared and marked, were vetoed, and go by markup only."""
    gone = {k for k in shared if not page[k].main}
    left = [k for k in range(len(page)) if k not in gone]
    kept = [k for k in left if not page[k].aside]
    both = sum(page[k].aside for k in gone)
    return kept, len(gone) - both, both, len(shared) - len(gone), len(left) - len(kept)


def main_text(page: list[Line], neighbours: list[list[Line]]) -> str:
    """The page's text by lines that it shares with one of its neighbours, nearest first, and by markup."""
    texts = [x.text for x in page]
    others = [other for n in neighbours if (other := [x.text for x in n]) and other != texts]
    _, shared = shared_lines(texts, [len(t) for t in texts], others)
    return " ".join(texts[k] for k in kept_lines(page, shared)[0])


def _hash(text: str, size: int) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=size).digest()


def _key(lines: list[Line]) -> bytes:
    """Names the page's list of lines; no line has a line break in it."""
    return _hash("\n".join(x.text for x in lines), 16)


def _outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's lines as hashes with their lengths."""
    for batch in batches:
        pages = [lines_of(h or "") for h in batch.column(2).to_pylist()]
        hashes = pa.array([[int.from_bytes(_hash(x.text, 8), "little", signed=True) for x in page] for page in pages], pa.list_(pa.int64()))
        sizes = pa.array([[len(x.text) for x in page] for page in pages], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(_key, pages), pa.binary()), hashes, sizes], names=["id", "url", "key", "lines", "sizes"])


#: What a line is, in a byte: no part of an article, within one, or marked.
_PLAIN, _MAIN_LINE, _ASIDE_LINE, _ASIDE_IN_MAIN = range(4)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's kinds of lines, and the text of those that nothing marks; others go whatever differencing says."""
    for batch in batches:
        pages = [lines_of(h or "") for h in batch.column(2).to_pylist()]
        kinds = pa.array([bytes(2 * x.aside + x.main for x in page) for page in pages], pa.binary())
        texts = pa.array([compress("\n".join(x.text for x in page if not x.aside).encode("utf-8", "surrogatepass"), 1) for page in pages], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(_key, pages), pa.binary()), kinds, texts], names=["id", "url", "key", "kinds", "texts"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for kinds, packed, shared in zip(*(batch.column(c).to_pylist() for c in ("kinds", "texts", "shared"))):
            texts = iter(decompress(packed).decode("utf-8", "surrogatepass").split("\n"))
            page = [Line("" if k >= _ASIDE_LINE else next(texts), k in (_MAIN_LINE, _ASIDE_IN_MAIN), k >= _ASIDE_LINE) for k in kinds]
            kept, *counts = kept_lines(page, set(shared or ()))
            found.append((" ".join(page[k].text for k in kept), *counts))
        counts = [pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3, 4)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array([f[0] for f in found], pa.string()), *counts], names=["id", "url", "text", "n_shared", "n_both", "n_vetoed", "n_marked"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of each bucket against those within reach: whether all share most of the page, and which decides."""
    rows = (dict(zip(batch.schema.names, row)) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for bucket, group in groupby(rows, key=lambda r: r["bucket"]):
        pages, out = list(group), []
        for at, page in enumerate(pages):
            if page["rank"] // BUCKET != bucket:
                continue
            order = sorted((k for k in range(max(0, at - REACH), min(len(pages), at + REACH + 1)) if k != at and pages[k]["host"] == page["host"]), key=lambda k: (abs(k - at), k))
            k, shared = shared_lines(page["lines"], page["sizes"], [pages[k]["lines"] for k in order])
            size = sum(page["sizes"][i] for i in shared)
            out.append((page["rank"], page["host"], page["key"], size > COPY * sum(page["sizes"]), pages[order[k]]["rank"] if order else None, size, sorted(shared)))
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["rank", "host", "key", "open", "choice", "size", "shared"])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What pages share with those from farther away."""
    for batch in batches:
        found = [(sum(sizes[i] for i in same), sum(sizes), sorted(same)) for lines, sizes, other in zip(*(batch.column(c).to_pylist() for c in ("lines", "sizes", "other"))) for same in [common(lines, other)]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("rank"), batch.column("distance"), pa.array([f[0] <= COPY * f[1] for f in found], pa.bool_()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.int32()))],
            names=["rank", "distance", "good", "size", "shared"],
        )


def _beyond(held: DataFrame, step: int) -> DataFrame:
    """(rank, ptr) for open pages: the first rank in the direction of ``step`` that is not open, by doubled pointers."""
    moved = base.settled(held.select("rank", (F.col("rank") + step).alias("ptr")))
    while True:
        further = moved.select(F.col("rank").alias("ptr"), F.col("ptr").alias("further"))
        joined = base.settled(moved.join(further, "ptr", "left").select("rank", F.coalesce("further", "ptr").alias("ptr"), F.col("further").isNotNull().alias("went")))
        if joined.filter("went").isEmpty():
            return joined.select("rank", "ptr")
        moved = joined.select("rank", "ptr")


def _resolved(ranked: DataFrame, found: DataFrame) -> DataFrame:
    """``found``, where open pages are compared with what closed pages farther away offer as well."""
    held = found.filter("open").select("rank", "host")
    ends = _beyond(held, -1).unionByName(_beyond(held, 1)).join(held, "rank")
    closed = found.filter("not open").select(F.col("rank").alias("ptr"), "host", "choice")
    ends = ends.join(closed, ["ptr", "host"]).select("rank", F.explode(F.array_compact(F.array("ptr", "choice"))).alias("other_rank")).filter("rank <> other_rank").distinct()
    other = ranked.select(F.col("rank").alias("other_rank"), F.col("lines").alias("other"))
    pairs = ends.join(ranked.select("rank", "lines", "sizes"), "rank").join(other, "other_rank")
    pairs = pairs.select("rank", F.abs(F.col("rank") - F.col("other_rank")).alias("distance"), "lines", "sizes", "other")
    near = found.filter("open").select("rank", F.abs(F.col("rank") - F.col("choice")).alias("distance"), F.lit(False).alias("good"), "size", "shared")
    tried = pairs.mapInArrow(_paired, "rank long, distance long, good boolean, size long, shared array<int>").unionByName(near)
    order = F.struct(~F.col("good"), F.when(F.col("good"), F.col("distance")).otherwise(F.col("size")), F.col("distance"), F.col("shared"))
    best = tried.groupBy("rank").agg(F.min_by("shared", order).alias("better"))
    return found.join(best, "rank", "left").withColumn("shared", F.coalesce("better", "shared"))


def _ranked(outlines: DataFrame) -> DataFrame:
    """Distinct pages, numbered without gaps by host, path and id in ranges that are counted first."""
    at = F.struct("path", "id")
    pages = outlines.filter(F.size("lines") > 0).groupBy("host", "key").agg(F.min(at).alias("at"), F.first("lines").alias("lines"), F.first("sizes").alias("sizes"))
    pages, order = base.settled(pages), ["host", "at", "key"]
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = pages.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = base.settled(ranged.withColumn("part", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    before = [0, *accumulate(counts.get(k, 0) for k in range(max(counts, default=0) + 1))]
    offsets = F.array(*(F.lit(n).cast("long") for n in before))
    return ranged.withColumn("rank", F.get(offsets, F.col("part")) + F.col("k")).select("rank", "host", "key", "lines", "sizes")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: its id, ``url``, main ``text``, and ``n_shared``, ``n_both``, ``n_vetoed`` and ``n_marked`` lines."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    host = F.lower(F.regexp_extract("url", r"^[^:/?#]+://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    on_host = lambda df: df.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    ranked = _ranked(on_host(rows.mapInArrow(_outlined, f"id {kind}, url string, key binary, lines array<long>, sizes array<long>")))
    bucket = lambda c: F.floor((F.col("rank") + c) / BUCKET)
    spread = ranked.withColumn("bucket", F.explode(F.sequence(bucket(-REACH), bucket(REACH))))
    spread = spread.repartition("bucket").sortWithinPartitions("bucket", "rank").select("bucket", "rank", "host", "key", "lines", "sizes")
    found = base.settled(spread.mapInArrow(_compared, "rank long, host string, key binary, open boolean, choice long, size long, shared array<int>"))
    if not found.filter("open").isEmpty():
        found = _resolved(ranked, found)
    parsed = on_host(rows.mapInArrow(_parsed, f"id {kind}, url string, key binary, kinds binary, texts binary"))
    met = parsed.join(found.select("host", "key", "shared"), ["host", "key"], "left").select("id", "url", "kinds", "texts", "shared")
    return met.mapInArrow(_cut, f"id {kind}, url string, text string, n_shared long, n_both long, n_vetoed long, n_marked long").withColumnRenamed("id", id_col)
