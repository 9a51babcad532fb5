"""Main text of web pages: structure, then differences to the page with the nearest URL.

1. Each page's html is cut into blocks (lines of text). Blocks inside script, style, navigation, header, footer,
   sidebar, form, advert, notice and comment parts, by tag, role or the words of class and id, are chrome. Blocks
   inside article or main are body, also where only words close a part around them, except in lists such as comments.
   All others are open, and those inside a body whose words may mark chrome as well as a part of the text.
2. Within a host, pages are ordered by URL path; a page's partner is the neighbour whose path shares more leading
   segments with its own (the earlier one, where both share as many). Pages of a host with the same lines are one
   page here, at the first of their paths, and have one partner.
3. The lines of a page, body lines too, are aligned with those of its partner by a longest common subsequence. Open
   lines in it are the site's template and are deleted. Body lines in it are deleted if the site repeats them: if they
   are aligned in REPEATED pages at least of the same host, and in half of its pages.

Differencing alone can't give the article of every page: a host may have one page, two pages of a host may hold the
same article, and a line that two articles quote isn't the site's. So structure has a veto: a page that shares half of
its body with its partner is a near copy, whose body lines stay and don't count, and a page whose lines all are its
partner's loses none.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metergrid.llm.common import Scratch, arrow_map, text_bytes, written

# Fixed values of html: elements whose content is never text, that start a block, that have no content.
HIDDEN = {"script", "style", "template", "noscript", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "title", "select", "option", "datalist", "button", "textarea"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Elements that a start tag of their own kind closes.
ALONE = {"p", "li", "dd", "dt", "td", "th", "tr", "option"}
#: Words of class and id that mark chrome.
MARKS = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "topbar", "toolbar", "breadcrumb", "breadcrumbs",
    "header", "masthead", "footer", "sidebar", "side", "aside", "widget", "related", "recommended", "share", "sharing", "social", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "popup", "modal", "overlay", "newsletter",
    "subscribe", "signup", "login", "search", "form", "comment", "comments", "disqus", "replies", "reply", "respond", "discussion", "pagination", "pager", "copyright", "legal", "skip",
}
#: Those of them that an article's own parts have, too: its heading, a notice, a section on law.
UNSURE = {"header", "masthead", "banner", "footer", "notice", "notices", "legal", "copyright", "form", "search", "side", "aside", "discussion", "skip", "menu", "overlay", "modal"}
#: Words that mark a part of the body, where no sure mark stands beside them.
BODY_MARKS = {"article", "post", "entry", "story", "content"}
#: Lists that have article elements of their own, which are no main text.
LISTS = {"comment", "comments", "disqus", "replies", "reply", "respond", "related", "recommended", "widget", "ad", "ads", "sponsor", "sponsored", "promo"}
#: A mark after one of these in the same name tells of the layout around it, as in with-sidebar.
MODIFIERS = {"has", "with", "no", "without"}

#: Nouns that a name may end with behind a mark, as in share-buttons: other ends, as in widget-design, are words of the text.
HOLDERS = {"area", "bar", "block", "box", "buttons", "button", "container", "form", "icons", "inner", "item", "items", "label", "link", "links", "list", "outer", "panel", "section", "slot", "unit", "wrap", "wrapper"}
#: Elements of running text: inside an article no sure mark closes them.
TEXTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "td", "th", "tr", "blockquote", "pre", "figcaption", "caption", "span", "a", "b", "i", "em", "strong", "u", "small", "code"}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[\"'>]")
ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+", re.I)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
SPACE = re.compile(r"\s+")

#: SOFT is out by the words of class and id only: an article or main inside is body again.
OPEN, BODY, OUT, SOFT = 0, 1, 2, 3


def _marks(value: str) -> set[str]:
    """The words of a class or id, without those that a modifier precedes in their name."""
    found = set()
    for name in value.split():
        for word in WORD.findall(CAMEL.sub(" ", name)):
            if word.lower() in MODIFIERS:
                break
            found.add(word.lower())
    return found


def _inner_marks(tag: str, name: str, value: str) -> set[str]:
    """The words that count inside an article: those of class names that end with a mark, or with a mark and a holder.
    An id counts as a whole, on a part that lists something; headings have ids made of their texts."""
    if name == "id":
        return {value.strip().lower()} & LISTS if tag in ("div", "section", "ul", "ol") else set()
    found = set()
    for one in value.split():
        words = [w.lower() for w in WORD.findall(CAMEL.sub(" ", one))]
        while len(words) > 1 and words[-1] in HOLDERS:
            words.pop()
        if words and words[-1] in MARKS and not MODIFIERS & set(words):
            found |= set(words)
    return found - (MARKS - UNSURE) if tag in TEXTS else found


def _zone(tag: str, attributes: str, inside: int) -> int:
    """The zone of an element's content."""
    if inside == OUT or tag in CHROME or tag in HIDDEN:
        return OUT
    if tag == "header" and inside != BODY:
        return OUT
    if attributes:
        for name, a, b, c in ATTR.findall(attributes):
            value = a or b or c
            if name.lower() == "role":
                if value.strip().lower() in ROLES:
                    return OUT
                if value.strip().lower() in ("main", "article"):
                    inside = BODY
                continue
            if tag in ("html", "body", "article", "main"):
                continue  # page-wide or explicit: their names describe the layout, not the content
            words = _inner_marks(tag, name.lower(), value) if inside == BODY else _marks(value)
            closed = words & MARKS
            if not closed or tag == "header" and inside == BODY:
                continue
            if closed & LISTS:
                return OUT
            if closed - UNSURE or not words & BODY_MARKS and inside != BODY:
                inside = SOFT
            elif not words & BODY_MARKS:
                inside = OPEN  # the partner's lines decide
    return BODY if tag in ("article", "main") else inside


#: Elements that a paragraph's end reaches through.
INLINE = {"b", "i", "em", "strong", "a", "span", "u", "font", "small"}
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class Scanner:
    """The tags of a page, in one pass: a quote without an end is a plain character, and so are all quotes once a tag
    would have no end for them."""

    def __init__(self, page: str):
        self.page, self.open_quotes, self.plain = page, set(), False

    def end(self, at: int) -> int:
        """The place behind the `>` of the tag whose attributes begin at `at`; -1 if there is none."""
        start = at
        while not self.plain:
            m = STOP.search(self.page, at)
            if not m:
                self.plain = True
            elif m[0] == ">":
                return m.end()
            elif m[0] in self.open_quotes:
                at = m.end()
            else:
                closed = self.page.find(m[0], m.end())
                if closed < 0:
                    self.open_quotes.add(m[0])
                at = max(closed + 1, m.end())
        return self.page.find(">", start) + 1 or -1

    def tags(self):
        """(start, end, closing, name, attributes) of tags; markup without a name has ''. The consumer may send the
        place from which to go on."""
        page, at = self.page, 0
        while True:
            start = page.find("<", at)
            if start < 0 or start + 1 >= len(page):
                return
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                at = stop + 3 if stop >= 0 else len(page)
                yield start, at, False, "", ""
                continue
            if page[start + 1] in "!?":
                stop = page.find(">", start)
                if stop < 0:
                    return
                at = stop + 1
                yield start, at, False, "", ""
                continue
            closing = page[start + 1] == "/"
            m = NAME.match(page, start + 1 + closing)
            if not m:
                at = start + 1
                continue
            stop = page.find(">", m.end()) + 1 or -1 if closing else self.end(m.end())
            if stop < 0:
                return
            at = (yield start, stop, closing, m[0].lower(), page[m.end() : stop - 1]) or stop


class Stack:
    """Open elements with the zones around them."""

    def __init__(self):
        self.held, self.count, self.solid = [], {}, []

    def push(self, tag: str, zone: int) -> None:
        if tag not in INLINE:
            self.solid.append(len(self.held))
        self.held.append((tag, zone))
        self.count[tag] = self.count.get(tag, 0) + 1

    def close(self, tag: str) -> int:
        """Closes the innermost element of this name and all in it; the zone around it."""
        while True:
            name, zone = self.held.pop()
            self.count[name] -= 1
            if self.solid and self.solid[-1] == len(self.held):
                self.solid.pop()
            if name == tag:
                return zone

    def innermost(self) -> str:
        """The innermost element that isn't inline."""
        return self.held[self.solid[-1]][0] if self.solid else ""


def page_lines(page: str) -> list[tuple[str, int]]:
    """(text, zone) of the blocks of a page, in order, without chrome; in time proportional to the page."""
    lines: list[tuple[str, int]] = []
    stack, zone, held, at = Stack(), OPEN, [], 0

    def flush():
        text = SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            lines.append((text, zone))

    tags, jump = Scanner(page).tags(), None
    while True:
        try:
            start, end, closing, tag, attributes = tags.send(jump)
        except StopIteration:
            break
        jump = None
        if start > at and zone < OUT:
            held.append(page[at:start])
        at = end
        if closing:
            if tag in BLOCK:
                flush()
            if stack.count.get(tag):
                zone = stack.close(tag)
        elif tag in ("br", "hr"):
            if zone < OUT:
                held.append(" ") if tag == "br" else flush()
        elif tag and tag not in VOID and (tag in BLOCK or not attributes.endswith("/")):
            if tag in BLOCK:
                flush()
                # an open paragraph ends where a block begins
                inner = stack.innermost()
                if inner and (inner == "p" or inner == tag and tag in ALONE):
                    zone = stack.close(inner)
            inner = _zone(tag, attributes, zone)
            if tag in RAW:
                found = RAW_END[tag].search(page, at)
                at = jump = found.end() if found else len(page)
                continue
            stack.push(tag, zone)
            zone = inner
    if zone < OUT:
        held.append(page[at:])
    flush()
    return lines


#: Cells of one alignment table. Larger alignments are halved (divide and conquer) by lengths from bit vectors, 64 cells a step,
#: so memory stays linear.
CELLS = 1 << 20
#: Places of a line from which on its bit vector is kept.
FREQUENT = 256


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The lengths of the longest common subsequences of x with every head of y. A bit vector over y holds a 0 where the
    length grows, and each line of x updates it by whole-number operations."""
    order = np.argsort(y, kind="stable")
    values, first = np.unique(y[order], return_index=True)
    places = dict(zip(values.tolist(), np.split(order, first[1:]), strict=True))
    kept: dict[int, int] = {}
    full = (1 << len(y)) - 1

    def mask(v: int) -> int:
        at = places[v]
        if len(at) < 8:
            found = 0
            for j in at.tolist():
                found |= 1 << j
            return found
        flags = np.zeros(len(y), bool)
        flags[at] = True
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    row = full
    for v in x.tolist():
        if v not in places:
            continue
        if v in kept:
            m = kept[v]
        else:
            m = mask(v)
            if len(places[v]) >= FREQUENT:
                kept[v] = m
        up = row & m
        row = ((row + up) | (row - up)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(y) // 8) or 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _row(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """For each tail of x the lengths of its longest common subsequences with every tail of y."""
    rows = [np.zeros(len(y) + 1, np.int32)]
    for v in x[::-1]:
        match = np.zeros(len(y) + 1, np.int32)
        match[:-1] = np.where(y == v, rows[-1][1:] + 1, 0)
        rows.append(np.maximum.accumulate(np.maximum(rows[-1], match)[::-1])[::-1])
    return rows[::-1]


def _aligned(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Positions of x in a longest common subsequence with y."""
    if not len(x) or not len(y):
        return []
    if len(x) == 1:
        return [0] if (y == x[0]).any() else []
    if len(x) * len(y) > CELLS:
        half = len(x) // 2
        ahead, behind = _lengths(x[:half], y), _lengths(x[half:][::-1], y[::-1])[::-1]
        cut = int((ahead + behind).argmax())
        return _aligned(x[:half], y[:cut]) + [half + k for k in _aligned(x[half:], y[cut:])]
    rows, out, j = _row(x, y), [], 0
    for k in range(len(x)):
        if rows[k][j] == rows[k + 1][j]:
            continue  # as many without this line
        while y[j] != x[k] or rows[k][j] != rows[k + 1][j + 1] + 1:
            j += 1
        out.append(k)
        j += 1
    return out


def common_lines(a: list[str], b: list[str]) -> list[bool]:
    """For each line of a whether it is in a longest common subsequence of the two."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    shared = set(x) & set(y)
    xs, ys = [i for i, t in enumerate(x) if t in shared], [t for t in y if t in shared]
    mid = [False] * len(x)
    number = {t: i for i, t in enumerate(shared)}
    for k in _aligned(np.array([number[x[i]] for i in xs], np.int64), np.array([number[t] for t in ys], np.int64)):
        mid[xs[k]] = True
    return [True] * head + mid + [True] * tail


#: Pages of a host that repeat a body line at least before it is the site's.
REPEATED = 3

#: What is kept of a page's lines to align them: for each a hash, its length and whether it is body.
BRIEF = T.StructType([T.StructField("same", T.StringType()), T.StructField("hash", T.ArrayType(T.LongType())), T.StructField("size", T.ArrayType(T.IntegerType())), T.StructField("body", T.ArrayType(T.BooleanType()))])
#: The lines themselves as one compressed text, which travels once, to the lines that it loses.
PACKED = T.StructType([T.StructField("packed", T.BinaryType())])


def _brief(column: str):
    def step(part: pa.RecordBatch):
        out = []
        for raw in text_bytes(part.column(column)):
            lines = [(t.encode("utf-8", "surrogatepass"), z) for t, z in page_lines(raw.decode("utf-8", "replace"))]
            hashes = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t, _ in lines]
            out.append((hashlib.sha256(b"\n".join(t for t, _ in lines)).hexdigest(), hashes, [len(t) for t, _ in lines], [z == BODY for _, z in lines]))
        return [list(x) for x in zip(*out, strict=True)]

    return lambda: step


def _packed(column: str):
    def make():
        pack = zstandard.ZstdCompressor(level=3)
        whole = lambda raw: "\n".join(t for t, _ in page_lines(raw.decode("utf-8", "replace"))).encode("utf-8", "surrogatepass")
        return lambda part: [[pack.compress(whole(raw)) for raw in text_bytes(part.column(column))]]

    return make


def partners(parsed: DataFrame, tmp: Scratch) -> DataFrame:
    """(key, partner): for each page the neighbour on its host in the order of paths that shares more of the path.

    Hosts are of any size, so the order is made by ranges of (host, path) rather than by host: neighbours are taken
    within a range, and across its edges from the first and last rows of the adjoining ranges."""
    order = ["host", "path", "key"]
    ranged = tmp.written(parsed.select(*order).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "urls")
    row = F.struct(*order)
    inside = Window.partitionBy("part").orderBy(*order)
    edges = ranged.groupBy("part").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    over = Window.partitionBy(F.lit(0)).orderBy("part")  # a row for each range
    edges = edges.select("part", F.lag("high").over(over).alias("ahead"), F.lead("low").over(over).alias("behind"))
    near = ranged.join(F.broadcast(edges), "part").select(
        *order, F.coalesce(F.lag(row).over(inside), F.col("ahead")).alias("a"), F.coalesce(F.lead(row).over(inside), F.col("behind")).alias("b")
    )

    def shared(side: str):
        """Leading path segments in common, -1 on another host."""
        same = F.expr(f"aggregate(sequence(0, least(size(own), size(split({side}.path, '/'))) - 1), 0, (n, i) -> if(n = i AND own[i] = split({side}.path, '/')[i], n + 1, n))")
        return F.when(F.col(f"{side}.host") == F.col("host"), same).otherwise(F.lit(-1))

    near = near.withColumn("own", F.split("path", "/"))
    picked = F.when((shared("a") >= shared("b")) & (shared("a") >= 0), F.col("a.key")).when(shared("b") >= 0, F.col("b.key"))
    return near.select("key", picked.alias("partner")).where("partner IS NOT NULL")


def _marked(batches):
    """(host, same, marks) of pages with their partner's lines: the lines that may go, which are the aligned
    ones, without body lines of near copies; none if all lines are aligned."""
    for batch in batches:
        marks = []
        for own, size, body, other in zip(*(batch.column(c).to_pylist() for c in ("hash", "size", "body", "other")), strict=True):
            gone = common_lines(own, other)
            shared = sum(n for n, b, g in zip(size, body, gone, strict=True) if g and b)
            near = 2 * shared >= sum(n for n, b in zip(size, body, strict=True) if b)
            marks.append([] if all(gone) else [{"at": k, "hash": h, "body": b} for k, (h, b, g) in enumerate(zip(own, body, gone, strict=True)) if g and not (near and b)])
        kind = pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.int64()), ("body", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("host", "same")] + [pa.array(marks, kind)], names=["host", "same", "marks"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_lost) of each page: its main blocks, joined by empty lines; '' if there are none. n_lost
    counts the lines that differencing deleted.

    Null or empty html has no text. Pages without an URL, or with an id that is null or that another page has, have no
    partner and keep their open lines. Equal URLs are neighbours, in the order of ids.
    """
    with Scratch(pages.sparkSession) as tmp:
        rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url"), F.col(html_col))
        # pages are parsed twice, since storing their lines in between takes more disk than parsing takes time
        parsed = tmp.written(arrow_map(rows, html_col, BRIEF, _brief(html_col), ["key", "url"]), "lines")
        known = parsed.select(
            "key", F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)).alias("host"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"), "same",
        )
        once = known.where("key IS NOT NULL AND host <> ''").groupBy("key").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("host", "path", "same")]).where("n = 1")
        first = once.groupBy("host", "same").agg(F.min(F.struct("path", "key")).alias("first")).select("host", "same", F.col("first.path").alias("path"), F.col("first.key").alias("key"))
        first = tmp.written(first, "pages")
        # lines travel as hashes of 8 bytes
        other = parsed.select(F.col("key").alias("partner"), F.col("hash").alias("other"))
        paired = first.join(partners(first.select("key", "host", "path"), tmp), "key").join(parsed.select("key", "hash", "size", "body"), "key")
        pairs = paired.join(other, "partner").select("host", "same", "hash", "size", "body", "other")
        marks = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("body", T.BooleanType())]))
        aligned = tmp.written(pairs.mapInArrow(_marked, T.StructType([pairs.schema[c] for c in ("host", "same")] + [T.StructField("marks", marks)])), "aligned")
        mark = aligned.select("host", "same", F.explode("marks").alias("m")).select("host", "same", "m.*")
        line = ["host", "hash"]
        counted = mark.where("body").select(*line, "same").distinct().groupBy(*line).agg(F.count("*").alias("n")).where(F.col("n") >= REPEATED)
        site = counted.join(first.groupBy("host").agg(F.count("*").alias("pages")), "host").where("2 * n >= pages").select(*line)
        lost = mark.where("NOT body").select("host", "same", "at").unionByName(mark.where("body").join(site, line, "left_semi").select("host", "same", "at"))
        lost = lost.groupBy("host", "same").agg(F.collect_list("at").alias("lost"))
        of_page = written(once.join(lost, ["host", "same"]).select(F.col("key").alias("_key"), "lost"), "lost")
        packed = arrow_map(rows, html_col, PACKED, _packed(html_col), ["key", "url"])
        both = packed.join(of_page, packed["key"].eqNullSafe(of_page["_key"]), "left").select("key", "url", "packed", "lost")
        result = T.StructType([both.schema["key"], both.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_lost", T.IntegerType())])

        def run(batches):
            unpack = zstandard.ZstdDecompressor()
            for batch in batches:
                texts, counts = [], []
                for packed, lost in zip(batch.column("packed").to_pylist(), batch.column("lost").to_pylist(), strict=True):
                    gone = set(lost or ())
                    whole = unpack.decompress(packed).decode("utf-8", "surrogatepass")
                    texts.append("\n\n".join(t for k, t in enumerate(whole.split("\n")) if k not in gone).encode("utf-8", "replace").decode())
                    counts.append(len(gone))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["key", "url", "text", "n_lost"])

        return both.mapInArrow(run, result).withColumnsRenamed({"key": id_col, "url": url_col})
