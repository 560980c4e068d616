"""Main text of web pages by differencing with the page of the nearest URL.

Pages are sorted by host and URL path; each is paired with the neighbour on its
host whose path has the longer beginning in common. The text lines of the two
pages are aligned by their longest common subsequence, and shared lines, which
belong to the site's template, are deleted.

Differencing alone errs on both sides: text that a template fills anew on every
page is shared with no other page, and two copies of an article share all of it.
So markup that names its role (menus, footers, adverts, forms and so on) is
dropped before, plain paragraphs and headings of a page's longest article element
are not deleted for being shared (those of further articles are), and a pair that shares most of its text is a pair of
copies and deletes nothing.

Pages are sorted by range, so a host with very many pages spreads over tasks. A
page at the edge of a range pairs with its neighbour inside.

Defined results: a null html is empty and gives an empty text; a null url has an
empty host and path; a page without any other of its host in reach loses no
lines; repeated rows give repeated rows, and do not delete each other's text; an
empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Share of a page's text beyond which two pages are copies of one another.
COPIES = 0.5

# Within a tag a quote opens a value only after an equals sign; a quote that stands elsewhere, or is never closed, is as
# any other character, so the tag ends at the next ">".
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</(?![a-zA-Z])[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|([^<]+)|(<(?![a-zA-Z/!?]))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)

# Elements of HTML by what they do here.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "search", "svg", "canvas", "object", "audio", "video", "label"}
_PLAIN = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption", "caption"}
_CLOSED_BY_NEXT = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "note"}
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|topbar|footer|foot|sidebar|side|rail|ad|ads|adv|advert|adverts|advertisement|advertising|banner|promo|promotion|sponsor|sponsored|cookie|cookies|"
    r"consent|gdpr|notice|alert|newsletter|subscribe|subscription|signup|popup|modal|overlay|comment|comments|commentlist|reply|replies|disqus|discussion|share|sharing|social|related|recommended|"
    r"breadcrumb|breadcrumbs|crumbs|pagination|pager|widget|login|search|searchbox|toolbar|masthead|legal|copyright|skip|tags|byline-links)(?:$|[\s_-])",
    re.I,
)
_TEASER = re.compile(r"(?:^|[\s_-])(?:teaser|teasers|promo|recommended)(?:$|[\s_-])", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-header|page-header|head)(?:$|[\s_-])", re.I)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(next((x for x in m.groups()[1:] if x is not None), "")) for m in _ATTRIBUTE.finditer(text)}


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's markup says that it is no part of the article."""
    if tag in _DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes.strip():
        return False
    a = _attributes(attributes)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in _ROLES or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    if tag == "article" and _TEASER.search(f"{a.get('class', '')} {a.get('id', '')}"):
        return True
    if tag in ("body", "html", "article", "main") and not re.search(r"comment|related|advert|sponsor", f"{a.get('class', '')} {a.get('id', '')}", re.I):
        return False
    names = f"{a.get('class', '')} {a.get('id', '')}"
    return bool(_NAMES.search(names)) or (not in_article and bool(_HEADER.search(names)))


def lines_of(page: str) -> list[tuple[str, int]]:
    """(line, article) of the blocks not dropped by markup; article: 0 outside, else twice its number, plus 1 for plain elements."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, int]] = []  # (tag, unwanted, article number)
    held: list[str] = []
    articles = 0

    def unwanted() -> bool:
        return bool(stack) and stack[-1][1]

    def inside() -> int:
        return stack[-1][2] if stack else 0

    def flush() -> None:
        if held:
            line = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if line and not unwanted():
                plain = next((t for t, _, _ in reversed(stack) if t in _BLOCK), "") in _PLAIN
                out.append((line, 2 * inside() + plain if inside() else 0))

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        if m is None:  # a tag that never ends
            break
        at = m.end()
        if m[4] is not None or m[5] is not None:
            if not unwanted():
                held.append(m[4] or m[5])
            continue
        if m[2] is None:  # a comment or declaration
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush() if tag in _BLOCK else None
                    del stack[i:]
                    break
            continue
        if tag in _BLOCK:
            flush()
            if stack and stack[-1][0] in _CLOSED_BY_NEXT and tag in _CLOSED_BY_NEXT[stack[-1][0]]:
                stack.pop()
            # A block ends an open paragraph, whatever inline elements are open within it.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in _BLOCK:
                    break
        elif tag in ("br", "wbr", "hr"):
            held.append(" " if tag != "wbr" else "")
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _VOID or m[3].rstrip().endswith("/") and tag not in _BLOCK:
            continue
        number = inside()
        if tag in ("article", "main") and not unwanted() and not number:
            articles += 1
            number = articles
        stack.append((tag, unwanted() or _unwanted(tag, m[3], bool(number)), number))
    flush()
    return out


def main_lines(lines: list[tuple[str, int]]) -> list[tuple[str, bool]]:
    """(line, protected) of the articles of a page, or of all lines where it has none; only the longest is protected."""
    size: dict[int, int] = defaultdict(int)
    for line, where in lines:
        size[where >> 1] += len(line)
    size.pop(0, None)
    if not size:
        return [(line, False) for line, _ in lines]
    best = max(size, key=lambda n: (size[n], -n))
    return [(line, bool(where & 1) and where >> 1 == best) for line, where in lines if where]


def common_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: equal beginnings and ends, and between them the longest rising run of matches."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    middle = _rising_matches(a[head : len(a) - tail], b[head : len(b) - tail])
    ends = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    return [(k, k) for k in range(head)] + [(head + i, head + j) for i, j in middle] + ends


def _rising_matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    where: dict[str, list[int]] = defaultdict(list)
    for j, line in enumerate(b):
        where[line].append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect_left(tails, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def without_shared(mine: list[tuple[str, bool]], other: list[tuple[str, bool]]) -> list[str]:
    """The lines of a page that its neighbour does not share, and those that its markup protects."""
    pairs = common_lines([x for x, _ in mine], [x for x, _ in other])
    total, shared = sum(len(x) for x, _ in mine), sum(len(mine[i][0]) for i, _ in pairs)
    if shared > COPIES * total:
        return [x for x, _ in mine]
    gone = {i for i, _ in pairs if not mine[i][1]}
    return [x for i, (x, _) in enumerate(mine) if i not in gone]


def _shared_beginning(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _pack_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        z = [pack(json.dumps(main_lines(lines_of(t))).encode("utf-8", "surrogatepass")) for t in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("page_id", "url", "host", "path")), pa.array(z, pa.binary())], ["page_id", "url", "host", "path", "z"])


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by host and path; each needs the rows before and after it."""
    unpack = zstandard.ZstdDecompressor().decompress

    def rows() -> Iterator[tuple]:
        for b in batches:
            for page_id, url, host, path, z in zip(*(c.to_pylist() for c in b.columns)):
                yield page_id, url, host, path, json.loads(unpack(z))

    def solve(before: tuple | None, row: tuple, after: tuple | None) -> tuple:
        near = [x for x in (before, after) if x is not None and x[2] == row[2]]
        mine = [(x, p) for x, p in row[4]]
        if near:
            best = max(near, key=lambda x: _shared_beginning(x[3], row[3]))  # the one before, if equal
            text = "\n".join(without_shared(mine, best[4]))
        else:
            text = "\n".join(x for x, _ in mine)
        return row[0], row[1], text, len(text)

    def batch(done: list[tuple]) -> pa.RecordBatch:
        ids, urls, texts, sizes = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["page_id", "url", "text", "n_chars"])

    before, row, done = None, None, []
    for after in rows():
        if row is not None:
            done.append(solve(before, row, after))
        before, row = row, after
        if len(done) >= 500:
            yield batch(done)
            done = []
    if row is not None:
        done.append(solve(before, row, None))
    if done:
        yield batch(done)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page (page_id, url, html)."""
    small_batches(pages.sparkSession, 200)
    url = F.coalesce("url", F.lit(""))
    pattern = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^#]*)"
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.lower(F.regexp_extract(url, pattern, 1)).alias("host"), F.regexp_extract(url, pattern, 2).alias("path"), F.coalesce("html", F.lit("")).alias("html")
    )
    packed = rows.mapInArrow(_pack_lines, "page_id long, url string, host string, path string, z binary")
    dealt = packed.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    return dealt.mapInArrow(_difference, "page_id long, url string, text string, n_chars long")
