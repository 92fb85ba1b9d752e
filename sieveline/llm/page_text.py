"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by host and URL path and each is paired with its nearest
neighbour. A page becomes lines (its blocks of text); lines are aligned with
the neighbour's by longest common subsequence, and shared ones are deleted as
furniture. Markup gives two kinds of proof beyond that: lines in navigation,
notices, forms and the like go even where no neighbour has them, and lines
inside an explicit article stay even where a copy of the article is next door.
Lines of <main> outside an article are differenced like the others, unless the
neighbour is a copy.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import deque
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sieveline.llm.common import saved, slices

#: Elements without text for readers, furniture, inline elements, void elements, telling names.
HIDDEN = frozenset("script style template noscript iframe object svg math canvas head title textarea select datalist".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(("article", "main"))
FRAME = frozenset(("html", "body", "main"))
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|copyright|disqus|footer|header|masthead|menu|modal|nav(?:bar|igation)?|newsletter|notices?|pagination|popup|promo\w*|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])"
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: A comment, a declaration, or a tag with its attributes; quoted values may hold '>'.
MARKUP = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|$)""", re.S)
MAIN, KEPT, PLAIN, DROPPED = 3, 2, 1, 0


def hides(tag: str, attributes: str, in_article: bool = False) -> bool:
    """Whether the element's own name or attributes tell that it is furniture; an article's own header is none."""
    if tag in FURNITURE and not (in_article and tag == "header"):
        return True
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and NAMES.search(value.replace("header", "") if in_article else value):
            return True
    return False


def lines_of(source: str | None) -> list[tuple[str, int]]:
    """Blocks of text in page order, each with KEPT (in an article), MAIN (else in <main>), PLAIN or DROPPED (in furniture).

    Unclosed elements end with the element around them; an end tag without a
    start is ignored. Character references are decoded, runs of white space
    become one space, empty blocks fall away. Null gives no line.
    """
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that matter, with the state inside
    state, at = PLAIN, 0

    def end_block() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, state))

    source = source or ""
    while at < len(source):
        m = MARKUP.search(source, at)
        if not m:
            parts.append(source[at:])
            break
        parts.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            # A hidden inline element is a block of its own, from its start to its end.
            if not hides(tag, m[3]) if not closing else all(t != tag for t, _ in stack):
                continue
        end_block()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    state = stack[-1][1] if stack else PLAIN
                    break
        elif tag in HIDDEN:
            if tag != "head":  # head holds elements of its own
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(source, at)
                at = close.end() if close else len(source)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            # An article inside furniture stays furniture; furniture inside an article goes.
            furniture = tag not in FRAME and hides(tag, m[3], state in (KEPT, MAIN))
            inside = DROPPED if state == DROPPED or furniture else KEPT if tag == "article" else MAIN if tag == "main" and state == PLAIN else state
            if inside != state or tag in ARTICLE or any(t == tag for t, _ in stack):
                stack.append((tag, inside))
                state = inside
    end_block()
    return out


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Indices of ``mine`` in a longest common subsequence with ``other`` (Hunt and Szymanski's method between equal ends)."""
    head, least = 0, min(len(mine), len(other))
    while head < least and mine[head] == other[head]:
        head += 1
    tail = 0
    while tail < least - head and mine[-1 - tail] == other[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(mine) - tail, len(mine))}
    places: dict[str, list[int]] = {}
    for j in range(head, len(other) - tail):
        places.setdefault(other[j], []).append(j)
    ends: list[int] = []  # the least end, in other, of a common run of each length
    links: list[tuple] = []
    for i in range(head, len(mine) - tail):
        for j in reversed(places.get(mine[i], ())):
            k = bisect.bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def main_text(lines: list[tuple[str, int]], neighbour: list[tuple[str, int]] | None) -> str:
    """The page's lines without furniture and without what it shares with its neighbour.

    Lines of an article stay. Shared lines of <main> stay if they outweigh all
    that would be left: then the neighbour is a copy. Without a neighbour only
    the lines in <article> or <main> are text, or all plain ones if there are none.
    """
    if not neighbour:
        return "\n".join([t for t, s in lines if s in (KEPT, MAIN)] or [t for t, s in lines if s == PLAIN])
    places = [i for i, (_, s) in enumerate(lines) if s in (PLAIN, MAIN)]
    shared = shared_lines([lines[i][0] for i in places], [t for t, s in neighbour if s in (PLAIN, MAIN)])
    gone = {places[k] for k in shared}
    left = sum(len(t) for i, (t, s) in enumerate(lines) if s != DROPPED and i not in gone)
    if sum(len(lines[i][0]) for i in gone if lines[i][1] == MAIN) > left:
        gone = {i for i in gone if lines[i][1] != MAIN}
    return "\n".join(t for i, (t, s) in enumerate(lines) if s != DROPPED and i not in gone)


def address(url: str | None) -> tuple[str, str]:
    """Host (without www, in lower case) and path of a URL; empty if there is none."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.hostname or "").removeprefix("www."), parts.path
    except ValueError:
        return "", url or ""


def nearness(a: str, b: str) -> int:
    """Leading characters that two paths share."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Run:
    """Pages of one host with the same lines, one after the other in the sorted stream; they have the same neighbours."""

    __slots__ = ("host", "digest", "packed", "first", "last", "before", "members", "_lines")

    def __init__(self, host: tuple[int, str], path: str, digest: bytes, packed: bytes, before: Run | None):
        self.host, self.digest, self.packed, self.first, self.last, self.before = host, digest, packed, path, path, before
        self.members: list[tuple] = []  # for each page: the texts of its batch, its place there, its path
        self._lines = None

    @property
    def lines(self) -> list[tuple[str, int]]:
        if self._lines is None:
            raw = zstandard.ZstdDecompressor().decompress(self.packed).decode()
            self._lines = [(x[1:], int(x[0])) for x in raw.split("\n") if x]
        return self._lines

    def settle(self, after: Run | None) -> None:
        """The text of each page, from the nearer neighbour."""
        found: dict[Run | None, str] = {}
        for texts, place, path in self.members:
            near = [(nearness(path, at), -i, run) for i, (run, at) in enumerate(((self.before, self.before and self.before.last), (after, after and after.first))) if run]
            other = max(near, key=lambda x: x[:2])[2] if near else None
            if other not in found:
                found[other] = main_text(self.lines, other.lines if other else None)
            texts[place] = found[other]
        self.before = None  # no chain of all runs


def packed_lines(lines: list[tuple[str, int]]) -> bytes:
    return "\n".join(f"{s}{t}" for t, s in lines).encode("utf-8", "replace")


def digest_of(lines: list[tuple[str, int]]) -> bytes:
    """What tells pages apart: furniture by markup does not."""
    return xxhash.xxh3_128_digest(packed_lines([x for x in lines if x[1] != DROPPED]))


def pure(x: str | bytearray) -> str | bytes:
    return bytes(x) if isinstance(x, bytearray) else x


#: Host, path and digest, the order of pages; and what a range tells of its edges.
Key = tuple[str, str, bytes]
ORDER = ["_host", "_path", "_digest"]
KEY = pa.struct([("h", pa.string()), ("p", pa.string()), ("d", pa.binary())])
ENDS = ", ".join(f"{c} struct<h string, p string, d binary>" for c in ("first", "second", "last", "previous")) + ", changed boolean"


def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range's first and last page, and the pages next to the runs of copies that these stand in, if of their host.

    ``changed`` tells that the range holds more than one run.
    """
    first = second = last = previous = None
    changed = False
    for batch in batches:
        for key in zip(*(batch.column(c).to_pylist() for c in ORDER), strict=True):
            if first is None:
                first = key
            elif (key[0], key[2]) != (last[0], last[2]):
                if not changed:
                    second = key if key[0] == first[0] else None
                previous, changed = last if key[0] == last[0] else None, True
            last = key
    if first is not None:
        edges = [pa.array([k and dict(zip("hpd", k, strict=True))], KEY) for k in (first, second, last, previous)]
        yield pa.RecordBatch.from_arrays([*edges, pa.array([changed])], names=["first", "second", "last", "previous", "changed"])


def beyond(ranges: list[dict], at: int) -> Iterator[Key]:
    """Pages of other ranges that are neighbours of the first and of the last run of copies in a range."""
    for outer, inner, near, over in ((range(at - 1, -1, -1), "first", "last", "previous"), (range(at + 1, len(ranges)), "last", "first", "second")):
        host, _, digest = ranges[at][inner]
        for other in (ranges[i] for i in outer):
            if other[near][0] != host:
                break
            if other[near][2] != digest:
                yield other[near]
                break
            if other["changed"]:  # the run goes on into that range and ends there
                if other[over]:
                    yield other[over]
                break


def extract(pages: DataFrame, *, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """The pages, without their html, with ``text`` (main text, blocks joined by newlines).

    Null or empty html has empty text. Pages without a URL share the empty host
    and are paired among themselves; a page alone on its host is judged by its
    markup. A neighbour is a page with other lines: copies, repeated rows among
    them, are passed over and extracted each, and a host of nothing but copies
    is judged by markup too. Ties between neighbours go to the earlier one.
    Pages are dealt by ranges of (host, path), so that a host with a third of
    all pages takes many tasks; a task reads its range as a stream and holds the
    lines of three pages, and the other columns of pages that wait for the end
    of their run of copies. A first pass over the pages' keys finds the ranges
    and the pages beyond each edge that are neighbours of pages within; those
    are sent along, so that the ranges don't change the result. A column named
    like a result is replaced.
    """
    keep = [c for c in pages.columns if c not in (html_col, "text")]
    schema = T.StructType([pages.schema[c] for c in keep])
    packed = T.StructType([*schema.fields, *T.StructType.fromDDL("_bucket int, _along boolean, _host string, _path string, _digest binary, _lines binary").fields])
    final = T.StructType([*schema.fields, *T.StructType.fromDDL("text string").fields])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(*address(u), digest_of(lines_of(h))) for u, h in zip(batch.column(url_col).to_pylist(), batch.column(html_col).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], names=ORDER)

    count = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = saved(pages.select(url_col, html_col).mapInArrow(keys, "_host string, _path string, _digest binary"))
    # One row of keys a range.
    found = known.repartitionByRange(count, *ORDER).sortWithinPartitions(*ORDER).mapInArrow(ends, ENDS).collect()
    ranges = sorted(({k: tuple(map(pure, v)) if isinstance(v, tuple) else v for k, v in r.asDict().items()} for r in found), key=lambda r: r["first"])
    starts = [r["first"] for r in ranges]
    wanted: dict[Key, list[int]] = {}
    for bucket in range(len(ranges)):
        for key in beyond(ranges, bucket):
            wanted.setdefault(key, []).append(bucket)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[Key] = set()
        for batch in slices(batches):
            coder = zstandard.ZstdCompressor(level=3)
            rows: list[tuple] = []
            for i, (url, source) in enumerate(zip(batch.column(url_col).to_pylist(), batch.column(html_col).to_pylist(), strict=True)):
                lines = lines_of(source)
                key = (*address(url), digest_of(lines))
                # The state is a digit before each line; lines hold no newline themselves.
                blob = coder.compress(packed_lines(lines))
                rows.append((i, max(0, bisect.bisect_right(starts, key) - 1), False, *key, blob))
                if key in wanted and key not in sent:
                    sent.add(key)
                    rows += [(i, bucket, True, *key, blob) for bucket in wanted[key]]
            places, *columns = zip(*rows, strict=True)
            added = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(places)) for c in keep), *added], names=[*keep, "_bucket", "_along", *ORDER, "_lines"])

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: Run | None = None
        waiting: deque[tuple[pa.RecordBatch, list[str | None]]] = deque()
        for batch in batches:
            texts: list[str | None] = [None] * batch.num_rows
            waiting.append((batch.select([*keep, "_along"]), texts))
            for i, (bucket, along, host, path, digest, blob) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_bucket", "_along", *ORDER, "_lines")), strict=True)):
                host = bucket, host
                if run is None or (run.host, run.digest) != (host, digest):
                    same = run is not None and run.host == host
                    new = Run(host, path, digest, blob, run if same else None)
                    if run is not None:
                        run.settle(new if same else None)
                        run.members = []
                    run = new
                run.last = path
                if not along:
                    run.members.append((texts, i, path))
            # All but the pages of the last run are settled, and it is the stream's end.
            while waiting and not (run is not None and run.members and waiting[0][1] is run.members[0][0]):
                yield finished(*waiting.popleft())
        if run is not None:
            run.settle(None)
        while waiting:
            yield finished(*waiting.popleft())

    def finished(batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])
        return out.filter(pc.invert(batch.column("_along")))

    dealt = pages.select(*keep, html_col).mapInArrow(parse, packed).repartitionById(max(1, len(ranges)), "_bucket").sortWithinPartitions("_bucket", *ORDER)
    return dealt.mapInArrow(difference, final)
