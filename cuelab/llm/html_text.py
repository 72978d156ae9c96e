"""Main text of web pages by nearest-URL page differencing.

Pages are read as lines (blocks), each line with its zone: inside an article, inside something whose tag
or class tells that it is no content, or neither. Pages of a host stand in the order of their URL paths;
each is aligned with the page before and the one after by a longest common subsequence of lines. Lines of
neither zone go if a neighbour shares them and stay if none does, whether the page has an article or not;
so do those of blocks in an article whose class or id has a word of boilerplate among others.
Lines of an article are not deleted for being shared: copies of articles and passages that many articles
quote are content. A neighbour that shares all lines is a copy and tells nothing, so copies keep theirs.

Hosts are not gathered: rows are dealt out by ranges of (host, path, URL), so a large host lies in many
tasks. Each range also gets the last page before it and the first one after it, so the text of a page does not
depend on the ranges. Pages are parsed once, before they are dealt out.

Aligning two pages takes time near linear in their lines: what begins and ends both alike, however often
it repeats, is matched at once, and so are lines that only one of them has. The rest is matched by chains if few
lines repeat, else halved over the bits of whole numbers; both find a longest common subsequence.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import col, text_of
from .url_rules import host_of, path_of

_WHITE = re.compile(r"[\x20\x09-\x0D]+")
_WORDS = re.compile(r"[a-z0-9]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
UNSEEN = set("script style noscript template head title textarea select option button svg iframe canvas object audio video map datalist".split())
#: What can stand in a head; anything else ends one that is left open.
IN_HEAD = set("base basefont bgsound head html link meta noscript script style template title".split())
BOILERPLATE = set("nav footer aside form menu dialog search".split())
MAIN = {"article", "main"}
#: Words of class, id and role that tell boilerplate.
LABELS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription popup modal overlay sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs comment comments reply replies respond discussion disqus share sharing social related widget toolbar pager "
    "pagination login signup masthead contentinfo complementary footer skip".split()
)
#: Words that tell a page's header; an article's own header is content.
HEADERS = {"header", "masthead", "banner", "topbar"}
COMMENTS = {"comment", "comments", "reply", "replies", "respond", "discussion", "disqus"}
#: Inside an article the ids of these tell nothing: they are made of headings.
TITLED = set("section h1 h2 h3 h4 h5 h6 p".split())
#: Of an article's line in DOUBT zone a neighbour decides.
ARTICLE, DOUBT, OPEN, AWAY = "a", "d", "o", "x"
#: A range has about so many pages at least; its bounds come from about so many sampled keys a range.
RANGE_PAGES, SAMPLED = 64, 20
#: Pairs of equal lines a line, up to which lines are matched by chains.
FEW = 16


class _Lines(HTMLParser):
    """The lines of a page and their zones."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.zones: list[str] = []
        self.buffer: list[str] = []
        self.stack: list[tuple[str, str, bool]] = []  # tag, zone inside it, a link in doubt
        self.places: dict[str, list[int]] = defaultdict(list)  # of each open tag in the stack
        self.blocks: list[int] = []  # places of open tags that are not inline
        self.away: int | None = None  # place of the outermost tag in AWAY zone: all further in are
        self.zone = OPEN
        self.hidden = 0
        self.links = 0  # links in doubt that are open
        self.linked = 0  # characters of the line inside such

    def flush(self) -> None:
        if self.buffer:
            line = _WHITE.sub(" ", "".join(self.buffer)).strip(" ")
            if line:
                self.lines.append(line)
                self.zones.append(AWAY if 2 * self.linked > len(line) else self.zone)
            self.buffer = []
        self.linked = 0

    def pop_to(self, n: int) -> None:
        while len(self.stack) > n:
            tag, _, link = self.stack.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            self.hidden -= tag in UNSEEN
            self.links -= link
        if self.away is not None and self.away >= n:
            self.away = None
        self.zone = self.stack[-1][1] if self.stack else OPEN

    def push(self, tag: str, zone: str, link: bool) -> None:
        n = len(self.stack)
        self.stack.append((tag, zone, link))
        self.places[tag].append(n)
        if tag not in INLINE:
            self.blocks.append(n)
        if zone == AWAY and self.away is None:
            self.away = n
        self.hidden += tag in UNSEEN
        self.links += link
        self.zone = zone

    def zone_in(self, tag: str, attrs: list[tuple[str, str | None]], words: set[str]) -> str:
        """The zone inside of a tag that opens here."""
        if tag in MAIN and not words & COMMENTS:
            return ARTICLE if self.zone == OPEN else self.zone
        if self.zone == AWAY or tag in ("html", "body"):
            return self.zone
        if self.zone == OPEN:
            return AWAY if tag in BOILERPLATE or tag == "header" or words & LABELS or words & HEADERS else OPEN
        if tag in BOILERPLATE:
            return AWAY
        if not words & (LABELS - HEADERS):
            return self.zone
        # a whole class, role or id is a label; one word of several only with a neighbour's or the links' consent
        told = [(k, v.lower()) for k, v in attrs if v and (k in ("class", "role") or k == "id" and tag not in TITLED)]
        if any(w in LABELS - HEADERS for _, v in told for w in v.split()):
            return AWAY
        labelled = any(w in LABELS - HEADERS for _, v in told for w in _WORDS.findall(v))
        return DOUBT if labelled and tag not in INLINE else self.zone

    def in_doubt(self, words: set[str]) -> bool:
        """Whether a link that opens here is in a block in doubt, or has a label's word itself inside an article."""
        return self.zone == DOUBT or self.zone == ARTICLE and bool(words & (LABELS - HEADERS))

    def end_head(self, tag: str) -> None:
        """Ends a head left open, at ``tag`` or text: with all in it at a body, else only if nothing in it is open."""
        if tag == "body" and self.places["head"]:
            self.pop_to(self.places["head"][0])
        elif tag not in IN_HEAD and self.stack[-1][0] == "head":
            self.pop_to(len(self.stack) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden:
            self.end_head(tag)
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.buffer.append(" ")
            return
        words = {w for k, v in attrs if k in ("class", "id", "role") and v for w in _WORDS.findall(v.lower())}
        if tag in MAIN and not words & COMMENTS and self.zone == AWAY:
            # an unclosed menu ends where the article begins; comments go on
            if self.stack[self.away][0] in ("nav", "header", "footer", "menu", "ul", "li", "a"):
                self.flush()
                self.pop_to(self.away)
        zone = self.zone_in(tag, attrs, words)
        if tag not in INLINE or zone != self.zone:
            self.flush()
            close = {"li": ("li",), "p": ("p",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, ())
            close = close if tag in INLINE or tag in close or tag == "li" else (*close, "p")
            if self.blocks and self.stack[self.blocks[-1]][0] in close:  # an unclosed paragraph or item ends here
                self.pop_to(self.blocks[-1])
                zone = self.zone_in(tag, attrs, words)
        self.push(tag, zone, tag == "a" and self.in_doubt(words))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.buffer.append(" ")
        if not self.places.get(tag):
            return
        i = self.places[tag][-1]
        if tag in INLINE and self.blocks and self.blocks[-1] > i:
            return
        if tag not in INLINE or self.stack[i][1] != (self.stack[i - 1][1] if i else OPEN):
            self.flush()
        self.pop_to(i)

    def handle_data(self, data: str) -> None:
        if self.hidden and not data.isspace():
            self.end_head("")
        if not self.hidden:
            self.buffer.append(data)
            self.linked += len(data) if self.links else 0


def page_lines(html: str) -> tuple[list[str], str]:
    """Lines of a page in order, and a letter for the zone of each."""
    reader = _Lines()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.lines, "".join(reader.zones)


def _chains(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence, by increasing chains of matches."""
    places: dict[str, list[int]] = defaultdict(list)
    for j, line in enumerate(b):
        places[line].append(j)
    tails: list[int] = []  # the least last place in b of a chain of each length
    chains: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect_left(tails, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chains.append(link)
            else:
                tails[k], chains[k] = j, link
    out, link = set(), chains[-1] if chains else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """The length of a longest common subsequence of ``a`` and the first 0, 1, ... lines of ``b``: a bit of a whole number for each line."""
    where: dict[str, int] = {}
    by_line: dict[str, list[int]] = defaultdict(list)
    for j, line in enumerate(b):
        by_line[line].append(j)
    for line in set(a) & by_line.keys():
        bits = np.zeros(len(b), np.uint8)
        bits[by_line[line]] = 1
        where[line] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    whole = (1 << len(b)) - 1
    row = whole
    for line in a:
        here = where.get(line)
        if here:
            met = row & here
            row = (row + met | row - met) & whole
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of both."""
    out: set[int] = set()
    todo = [(a, b, range(len(a)))]  # parts of both, and the places of the first
    while todo:
        a, b, places = todo.pop()
        n, most = 0, min(len(a), len(b))
        while n < most and a[n] == b[n]:
            out.add(places[n])
            n += 1
        m = 0
        while m < most - n and a[-1 - m] == b[-1 - m]:
            out.add(places[len(a) - 1 - m])
            m += 1
        a_lines, b_lines = a[n : len(a) - m], b[n : len(b) - m]
        both = set(a_lines) & set(b_lines)
        kept = [i for i, x in enumerate(a_lines, n) if x in both]
        if not kept:
            continue
        b_lines = [x for x in b_lines if x in both]
        a_lines, kept = [a[i] for i in kept], [places[i] for i in kept]
        often = Counter(b_lines)
        if sum(often[x] for x in a_lines) <= FEW * (len(a_lines) + len(b_lines)):
            out.update(kept[i] for i in _chains(a_lines, b_lines))
        elif len(a_lines) == 1:
            out.add(kept[0])
        else:
            half = len(a_lines) // 2
            front, back = a_lines[:half], a_lines[half:]
            best = int(np.argmax(_lengths(front, b_lines) + _lengths(back[::-1], b_lines[::-1])[::-1]))
            todo.append((front, b_lines[:best], kept[:half]))
            todo.append((back, b_lines[best:], kept[half:]))
    return out


def main_text(lines: list[str], zones: str, neighbours: list[list[str]]) -> str:
    """What stays of a page next to its neighbours."""
    left = {i for i, z in enumerate(zones) if z != AWAY}
    if any(zones[i] != ARTICLE for i in left):
        found = [shared_lines(lines, x) for x in neighbours]
        shared = set().union(*(x for x in found if not left <= x))
        left = {i for i in left if zones[i] == ARTICLE or i not in shared} or left
    return "\n".join(lines[i] for i in sorted(left))


def _differences(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            ids = batch.column(0)
            for i, r in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 7)))):
                yield (ids.slice(i, 1), *r)

    def text(before, now, after) -> str:
        _, _, place, _, host, lines, zones = now
        return main_text(lines, zones, [x[5] for x in (before, after) if x and x[2] == place and x[4] == host])

    def out(held: list) -> pa.RecordBatch:
        ids = pa.concat_arrays([x[0] for x, _ in held])
        columns = [ids, pa.array([x[1] for x, _ in held], pa.string()), pa.array([t for _, t in held], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    before = now = None
    held, size = [], 0
    for after in rows():
        if now and now[3]:  # a row of this range, not one beside it
            held.append((now, text(before, now, after)))
            size += len(held[-1][1])
        before, now = now, after
        if len(held) >= 1000 or size > 1 << 22:
            yield out(held)
            held, size = [], 0
    if now and now[3]:
        held.append((now, text(before, now, None)))
    if held:
        yield out(held)


KEY = ("host", "path", "address", "name")
Key = tuple[str, str, str, str]


def _keys(id: str, url: str) -> list[Column]:
    """What orders pages; null urls and ids count as empty here."""
    address = F.coalesce(col(url).cast("string"), F.lit(""))
    return [c.alias(k) for c, k in zip((host_of(address), path_of(address), address, F.coalesce(col(id).cast("string"), F.lit(""))), KEY)]


def _bounds(pages: DataFrame, id: str, url: str, ranges: int | None) -> tuple[list[Key], dict[Key, list[int]]]:
    """First keys of the ranges but the first one; and of the keys at their edges the ranges beside, which get these pages too.

    Reads urls and ids only. The driver gets about ``SAMPLED`` distinct keys and two edges a range, and there are at
    most ``spark.sql.shuffle.partitions`` ranges.
    """
    n = pages.count()
    most = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or max(1, min(most, n // RANGE_PAGES))
    if ranges == 1:
        return [], {}
    keys = pages.select(*_keys(id, url))
    every = max(1, n // (SAMPLED * ranges))
    sample = keys.where(F.pmod(F.xxhash64(*KEY), F.lit(every)) == 0).distinct().collect()
    sample = sorted(tuple(r) for r in sample)
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []

    @F.arrow_udf("int")
    def place(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield pa.array([bisect_right(bounds, k) for k in zip(*(c.to_pylist() for c in columns))], pa.int32())

    key = F.struct(*KEY)
    edges = keys.select(place(*KEY).alias("place"), key.alias("key")).groupBy("place").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    edges = sorted((r["place"], tuple(r["low"]), tuple(r["high"])) for r in edges.collect())  # a row a range
    beside: dict[Key, list[int]] = defaultdict(list)
    for (left, _, high), (right, low, _) in zip(edges, edges[1:]):
        beside[high].append(right)
        beside[low].append(left)
    return bounds, dict(beside)


def main_texts(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", ranges: int | None = None) -> DataFrame:
    """``id``, ``url``, ``text`` (blocks joined by line feeds, empty if none) and ``n_chars`` of each row.

    Character references are decoded, white space inside a block becomes one space. Null html has no text;
    pages with null urls or such without a host stand together as one more host. Repeated rows give
    repeated rows; other columns are left out. Pages of one URL stand in the order of their ids as text. ``ranges``
    sets the number of ranges; texts are the same for any.
    """
    bounds, beside = _bounds(pages, id, url, ranges)
    sent = pages.sparkSession.sparkContext.broadcast((bounds, beside))  # a few keys a range

    @F.arrow_udf("struct<lines:array<string>,zones:string,places:array<int>>")
    def read(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        bounds, beside = sent.value
        for texts, *keys in batches:
            found = [page_lines(x) for x in texts.to_pylist()]
            places = [[bisect_right(bounds, k), *beside.get(k, ())] for k in zip(*(c.to_pylist() for c in keys))]
            yield pa.StructArray.from_arrays(
                [pa.array([x for x, _ in found], pa.list_(pa.string())), pa.array([z for _, z in found], pa.string()), pa.array(places, pa.list_(pa.int32()))],
                names=["lines", "zones", "places"],
            )

    body = text_of(html)
    rows = pages.select(col(id).alias("id"), col(url).cast("string").alias("url"), F.xxhash64(body).alias("digest"), *_keys(id, url), read(body, *_keys(id, url)).alias("page"))
    rows = rows.select("id", "url", "digest", *KEY, "page.lines", "page.zones", F.posexplode("page.places").alias("copy", "place"))
    own = F.col("copy") == 0
    rows = rows.repartitionById(len(bounds) + 1, F.col("place")).sortWithinPartitions("place", *KEY, "digest", "copy")
    rows = rows.select("id", "url", "place", own.alias("own"), "host", "lines", "zones")
    kind = T.StructType([T.StructField(id, pages.schema[id].dataType)]).add("url", T.StringType()).add("text", T.StringType())
    names = kind.names
    return rows.mapInArrow(lambda b: _differences(b, names), kind).withColumn("n_chars", F.length("text").cast("bigint"))
