"""HTML extraction: page differencing between pages whose URLs are nearest within a host.

A page becomes text lines, one for each block, with white space folded and character references decoded.
Pages are sorted by host and URL path over all machines; each has the page before and the page after it (and its
copies) in its host as neighbours. The nearest is the one with which its path shares more leading segments, the one
before if they are equal. Line lists are aligned by their longest common subsequence, and lines that a page shares
with its nearest neighbour are template: they are deleted. A line of ``LONG`` words or more may be a passage that
both pages quote, so it must be shared with the other neighbour too, where there is one. Where that would delete
every line, the neighbour is a variant of the same page, and nothing is deleted. Ranges' ends are known to the
ranges next to them, so how the pages are dealt out doesn't matter.

Differencing alone deletes passages that neighbouring articles share and keeps menus that no neighbour repeats.
Hence markup is heard first:

* Elements that are never main text (menus, footers, sidebars, controls, headers outside an article, scripts, styles)
  go.
* Class, id and role words are weak marks: what they mark goes unless nothing else is left, so no class word can
  empty a page. They don't count on ``html``, ``body``, ``main`` and ``article``, nor beside a word that names the
  content. Forms and reader comments are weak marks that an article inside them doesn't lift.
* Where a page says what its article is (``article``, ``main``, ``role=main``), that is its text, whole, and lines
  outside it go; such pages aren't aligned. On all others differencing decides.

Defined results: a null or empty page has an empty text; a null URL counts as a host and path of its own; a
page without neighbour loses what its markup says; equal rows get equal results; a tag that holds a ``<`` is text;
other columns play no part.
"""

import bisect
import json
import re
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import checkpointed

# HTML elements by role, and words of class, id and role attributes that mark what isn't main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav footer aside head button select svg object canvas audio video menu dialog".split())
ARTICLE = frozenset("article main".split())
UNMARKED = frozenset("html body article main".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promoted promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social "
    "related recommended widget copyright masthead toolbar pagination pager search skip complementary contentinfo".split()
)
MARK_BEGINNINGS = ("advert", "sidebar", "cookie", "newsletter", "sponsor", "breadcrumb", "navbar")
COMMENT_MARKS = frozenset("comment comments commentlist commentform commentbox commentarea commentsection reply replies disqus respond".split())
CONTENT_NAMES = frozenset("content main-content article article-body article-content post post-body post-content entry entry-content story story-body body-content page-content maincontent".split())
#: How little a line counts as main text: not marked, marked by a word, by a form or as a comment, never. OPEN is added outside an article.
PLAIN, WEAK, STICKY, STRONG, OPEN = 0, 1, 2, 3, 4
#: Words of a line that one neighbour alone can't make template.
LONG = 15

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_MARK = re.compile(r"(?:\s|^)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I | re.S)
_HIDDEN = re.compile(r"(?:\s|^)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*display\s*:\s*none|'[^']*display\s*:\s*none))", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
#: Elements that end an open one of the same kind, and where that kind's search for it ends.
_ENDS_OWN = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def _zone(name: str, attributes: str, zone: int) -> int:
    """The zone inside an element that begins in ``zone``."""
    mark, outside = zone & 3, zone & OPEN
    if name in NEVER or (name == "header" and outside):
        return STRONG | outside
    own, main = STICKY if name == "form" else PLAIN, name in ARTICLE
    if "=" in attributes or "hidden" in attributes:
        names = {x for m in _MARK.finditer(attributes) for x in (m[2] or m[3] or m[4] or "").lower().split()}
        words = {w for x in names for w in _PARTS.split(x)}
        main = main or ("main" in names and "role" in attributes.lower())
        if not COMMENT_MARKS.isdisjoint(words):
            own = STICKY
        elif not MARKS.isdisjoint(words) or any(w.startswith(MARK_BEGINNINGS) for w in words) or ("header" in words and outside) or _HIDDEN.search(attributes):
            own = max(own, WEAK)
        if own and name != "form" and (not CONTENT_NAMES.isdisjoint(names) or (name in UNMARKED and mark != STICKY)):
            own = PLAIN
    if main and not own and mark < STICKY:
        return PLAIN  # an article inside a weakly marked element
    if main:
        outside = 0
    return max(mark, own) | outside


def lines_of(html: str | None) -> list[tuple[int, str]]:
    """(zone, line) of each block with text: PLAIN, WEAK, STICKY or STRONG, with OPEN outside an article."""
    html = html or ""
    lines: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements and the zone inside each
    zone, held, at = OPEN, [], 0

    def close_block() -> None:
        if held:
            if line := " ".join("".join(held).split()):
                lines.append((zone, line))
            held.clear()

    def put(text: str) -> None:
        if text:
            held.append(unescape(text) if "&" in text else text)

    def leave(i: int) -> None:
        """The open elements from the i-th on end."""
        nonlocal zone
        if any(s[0] in BLOCKS for s in stack[i:]) or zone != (stack[i - 1][1] if i else OPEN):
            close_block()
        del stack[i:]
        zone = stack[-1][1] if stack else OPEN

    def implied(name: str) -> None:
        """A block ends an open p; an item, cell or row an open one of its list or table."""
        ends, until = (name, _ENDS_OWN[name]) if name in _ENDS_OWN else ("p", ("button", "td", "th", "caption"))
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in until:
                break
            if stack[i][0] == ends:
                leave(i)
                break

    while m := _TOKEN.search(html, at):
        put(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        if m[0][-1] != ">":  # a tag that the end of the page breaks off
            break
        name = name.lower()
        if name == "br":
            held.append(" ")
        elif name in RAW:
            if not m[1]:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else len(html)
        elif m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name in BLOCKS:
                        close_block()
                    leave(i)
                    break
            else:
                if name in BLOCKS:
                    close_block()
        else:
            if name in BLOCKS:
                close_block()
                implied(name)
            inside = _zone(name, m[3], zone)
            if inside != zone:
                close_block()
            plain = name in ("p", "b", "i", "em", "strong", "a", "u", "small", "font", "li") or m[3].endswith("/")
            if name not in VOID and (inside != zone or not plain):
                stack.append((name, inside))
                zone = inside
    else:
        put(html[at:])
    close_block()
    return lines


def _columns(a: list, b: list) -> list[int]:
    """For each prefix of ``a``, a number whose zero bits tell where the common subsequence with b grows."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row, out = full, []
    for x in a:
        met = row & where.get(x, 0)
        row = ((row + met) | (row - met)) & full
        out.append(row)
    return out


#: Bits of alignment that are held at once; longer pairs are halved (Hirschberg) until they fit.
ALIGN_BITS = 1 << 30


def shared(a: list, b: list, most_bits: int = ALIGN_BITS) -> list[bool]:
    """Which entries of ``a`` are in a longest common subsequence with ``b``."""
    out = [False] * len(a)
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        out[start] = True
        start += 1
    end_a, end_b = len(a), len(b)
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
        out[end_a] = True
    in_a, in_b = set(a[start:end_a]), set(b[start:end_b])
    at = [i for i in range(start, end_a) if a[i] in in_b]
    left, right = [a[i] for i in at], [x for x in b[start:end_b] if x in in_a]
    if not left or not right:
        return out
    if len(left) > 1 and len(left) * len(right) > most_bits:
        half = len(left) // 2
        ahead = _columns(left[:half], right)[-1]
        behind = _columns(left[half:][::-1], right[::-1])[-1]
        best = cut = 0
        n = len(right)
        count = total = n - behind.bit_count()  # of the whole right side, from behind
        grown = 0
        best, cut = total, 0
        for j in range(n):
            grown += not (ahead >> j) & 1
            count -= not (behind >> (n - 1 - j)) & 1
            if grown + count > best:
                best, cut = grown + count, j + 1
        found = shared(left[:half], right[:cut], most_bits) + shared(left[half:], right[cut:], most_bits)
    else:
        rows = _columns(left, right)
        found = [False] * len(left)
        i, j = len(left), len(right)
        while i and j:
            if (rows[i - 1] >> (j - 1)) & 1:
                j -= 1
            else:
                i -= 1
                if i and not (rows[i - 1] >> (j - 1)) & 1:
                    continue
                found[i] = True
                j -= 1
    for i, hit in zip(at, found, strict=True):
        out[i] = out[i] or hit
    return out


def main_text(lines: list[tuple[int, str]], near: list[tuple[int, str]] | None = None, other: list[tuple[int, str]] | None = None) -> str:
    """The article's lines; without one, open lines that aren't template by the nearest neighbour and the other one."""
    for level in (PLAIN, WEAK, STICKY):
        if kept := [x for z, x in lines if z == level]:
            return "\n".join(kept)
    for level in (PLAIN, WEAK, STICKY):
        if any(z == level | OPEN for z, _ in lines):
            break
    else:
        return ""
    texts = [x for _, x in lines]
    by_near, by_other = (shared(texts, [x for _, x in n]) if n else None for n in (near, other))
    own = [(x, by_near is not None and by_near[i] and (by_other is None or by_other[i] or x.count(" ") + 1 < LONG)) for i, (z, x) in enumerate(lines) if z == level | OPEN]
    return "\n".join([x for x, template in own if not template] or [x for x, _ in own])


_RUNS = pa.list_(pa.struct([("path", pa.string()), ("lines", pa.binary())]))
_ENDS = pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("head", _RUNS), ("tail", _RUNS)])
_URL = re.compile(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)([^?#]*)")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host in lower case without ``www.``, ``m.``, user and port; path without a last slash."""
    m = _URL.match(url or "")
    if not m:
        return "", url or ""
    host = m[1].lower().rpartition("@")[2].partition(":")[0]
    return host.removeprefix("www.").removeprefix("m."), m[2].rstrip("/")


def common_segments(a: str, b: str) -> int:
    """How many leading segments two paths share."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


def _order(host: str, path: str, page_id) -> tuple:
    """What compares as Spark sorts these columns: null first."""
    return host, path, page_id is not None, 0 if page_id is None else page_id


def beyond(ends: list) -> dict[int, tuple]:
    """By partition, the nearest run before its first and after its last, as (path, lines), in other partitions.

    ends: (part, first host, last host, first two runs of the first host, last two runs of the last host, from
    the edge inwards) of each partition that has rows, in order. A run is the pages in a row with the same lines.
    """
    out = {}
    for i, (part, first, last, head, tail) in enumerate(ends):
        found: list[tuple | None] = [None, None]
        for side, host, own, others in ((0, first, head[0][1], ends[:i][::-1]), (1, last, tail[0][1], ends[i + 1 :])):
            for _, its_first, its_last, its_head, its_tail in others:
                near, far, runs = (its_last, its_first, its_tail) if side == 0 else (its_first, its_last, its_head)
                if near != host:
                    break
                found[side] = next((tuple(r) for r in runs if r[1] != own), None)
                if found[side] or far != host:
                    break
        out[part] = tuple(found)
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and text of every page.

    Pages are dealt out by ranges of host, path and id, so a host of any size is spread over tasks; the ranges come
    from the URLs alone, so each page is parsed once. Lines travel compressed. The sorted pages are written to the
    shared folder and read twice: for the two runs at each end of a partition, of which one a side goes to its
    neighbours, and for differencing. A task walks its pages in order and holds three line lists, and of the pages
    of a run the keys and paths.
    """
    spark = pages.sparkSession
    kind = pages.schema[page_id].dataType
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    described = T.StructType([T.StructField("page_id", kind), *[T.StructField(n, T.StringType()) for n in ("url", "host", "path")], T.StructField("lines", T.BinaryType())])
    result = T.StructType([T.StructField("page_id", kind), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [host_and_path(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([p[i] for p in places], pa.string()) for i in (0, 1))], names=["page_id", "host", "path"])

    keys = rows.select("page_id", "url").mapInArrow(place, T.StructType([described[0], *described[2:4]]))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = keys.repartitionByRange(n, "host", "path", "page_id").groupBy(F.spark_partition_id()).agg(F.min(F.struct("host", "path", "page_id")).alias("k"))
    bounds = spark.sparkContext.broadcast(sorted(_order(*r.k) for r in firsts.collect()))  # one a partition

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            places = [host_and_path(u) for u in urls]
            parts = [max(0, bisect.bisect_right(bounds.value, _order(*p, i)) - 1) for i, p in zip(ids, places, strict=True)]
            lines = [zlib.compress(json.dumps(lines_of(h.as_py()), ensure_ascii=False).encode("utf-8", "replace"), 6) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p[0] for p in places], pa.string()), pa.array([p[1] for p in places], pa.string()), pa.array(lines, pa.binary()), pa.array(parts, pa.int32())], names=[*described.names, "range"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = host = None
        head, tail = [], []  # runs of the first host; runs of the present host, the last one first
        for batch in batches:
            for at, path, blob, own in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                if host is None:
                    part, first = own, at
                if at != host:
                    host, tail = at, []
                if tail and tail[0]["lines"] == blob:
                    tail[0] = {"path": path, "lines": blob}
                else:
                    tail = [{"path": path, "lines": blob}, *tail[:1]]
                    if at == first and len(head) < 2:
                        head.append(tail[0])
        if host is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "last": host, "head": head, "tail": tail}], schema=_ENDS)

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        out, size = [], 0
        host, before, after = None, None, None  # before: path and lines of the run before this one
        run, lines, waiting = None, [], []  # this run: its lines, packed and unpacked, and its pages

        def unpacked(blob: bytes) -> list:
            return [tuple(x) for x in json.loads(zlib.decompress(blob))]

        def packed() -> pa.RecordBatch:
            nonlocal out, size
            columns = list(zip(*out, strict=True))
            out, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=result.names)

        def done(following: tuple | None) -> Iterator[pa.RecordBatch]:
            nonlocal size
            texts: dict = {}
            for key, link, path in waiting:
                late = following is not None and (before is None or common_segments(path, following[0]) > common_segments(path, before[0]))
                if late not in texts:
                    near, other = (following, before) if late else (before, following)
                    texts[late] = main_text(lines, near and near[1], other and other[1])
                out.append((key, link, texts[late]))
                size += len(texts[late])
                if len(out) >= 2000 or size > 4 << 20:
                    yield packed()

        for batch in batches:
            arrow = [batch.schema.field(0).type, pa.string(), pa.string()]
            ids, urls, hosts, paths, parts = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5))
            for own, link, at, path, cell, part in zip(ids, urls, hosts, paths, batch.column(4), parts, strict=True):
                blob = cell.as_py()
                if host is None:
                    before, after = ((x[0], unpacked(x[1])) if x else None for x in edges.value[part])
                    host, run, lines = at, blob, unpacked(blob)
                elif at != host:
                    yield from done(None)
                    host, before, run, lines, waiting = at, None, blob, unpacked(blob), []
                elif blob != run:
                    fresh = unpacked(blob)
                    yield from done((path, fresh))
                    before, run, lines, waiting = (waiting[-1][2], lines), blob, fresh, []
                waiting.append((own, link, path))
        yield from done(after)
        if out:
            yield packed()

    parsed = rows.mapInArrow(describe, T.StructType([*described.fields, T.StructField("range", T.IntegerType())]))
    placed = parsed.repartitionById(n, F.col("range")).drop("range").sortWithinPartitions("host", "path", "page_id")
    placed = checkpointed(placed).withColumn("part", F.spark_partition_id())
    found = placed.mapInArrow(ends, "part int, first string, last string, head array<struct<path:string,lines:binary>>, tail array<struct<path:string,lines:binary>>").collect()
    edges = spark.sparkContext.broadcast(beyond(sorted(((r.part, r["first"], r["last"], [(x.path, bytes(x.lines)) for x in r.head], [(x.path, bytes(x.lines)) for x in r.tail]) for r in found), key=lambda r: r[0])))
    return placed.mapInArrow(difference, result)
