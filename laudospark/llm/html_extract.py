"""Main text of web pages by consensus of their hosts.

Each page's containers are scored by the text they hold outside of links and page furniture; the innermost container
outside of which next to nothing is left is the page's choice. Its path of tags and classes, without digits, is the
page's vote. Spark counts votes per host. It also counts the containers beside the choice and inside it: a path whose
blocks say the same on page after page of a host is furniture of that host, whatever its classes are called. Every page
is extracted again from the containers on its host's winning path, without those on recurring paths. A page without such
a container, with no text in it, or with other text outside of it, uses its own choice, outside of which it has no text.

Tags and roles of furniture are left out wherever they lie. Class and identifier words (``FURNITURE``, ``PARTS``) are a
first guess: where they would leave a page nothing but headings, the largest container that they hide is the page's text.
Character references are decoded, white space within a block becomes one space, blocks are joined in page order by one
space.

Recurring: at least ``RECURS`` pages have a block of this text on this path, and such blocks are at least half of all
blocks on the path. Blocks count once for pages with the same other text, so copies of a page make nothing recur; blocks
next to nothing in size count once for an address. Hosts with fewer pages have no consensus on furniture.

Defined results: null and empty pages give an empty text with 0 characters. Pages without a host in their address form
one host. Paths with equal votes: the one with more text, then the larger one. Rows are extracted one by one, repeated
ones too; other columns are ignored. Hosts with a thousandth of all pages or more meet their pages by a broadcast of at
most 1,000 rows, so no host is gathered in a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, written

_markup = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_attribute = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup; it ends at their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
FURNITURE_TAGS = frozenset("head script style noscript template svg math canvas object nav aside footer form button select option textarea label fieldset dialog menu iframe audio video map figcaption".split()) - {"figcaption"}
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form note".split())
CONTAINERS = frozenset("body article main section div td center".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
#: Elements that end an open one of the same group.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Beyond these an end tag or a sibling does not reach.
SCOPES = frozenset("table ul ol dl body html article section main div td".split())
#: Class and identifier words of furniture.
FURNITURE = frozenset((
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar aside footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall newsletter subscribe subscription signup login "
    "comment comments commentlist disqus replies reply respond share sharing social related recommended recommendations widget widgets skip search header"
).split())
#: Words that a name of furniture may be joined with: ``ad-slot``, ``site-header``, ``comment-list``.
PARTS = frozenset("area articles bar block body box btn button buttons col column container content form global group holder icons inner item items left link links list message outer page panel placement policy post posts primary right secondary section site slot stories text thread top bottom title unit wrap wrapper zone".split())
#: Words that make a joined name furniture as its last part, whatever comes before.
LAST = frozenset("sidebar navbar navigation breadcrumb breadcrumbs pagination pager masthead topbar toolbar advert advertisement popup modal overlay commentlist disqus newsletter".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
_digits = re.compile(r"\d+")
_joint = re.compile(r"[-_]+")
#: Characters, and share of a page's text, that next to nothing has at most.
LITTLE, LITTLE_SHARE = 15, 0.05
#: Pages that make a block recur.
RECURS = 3
#: Hosts with at least one of so many pages are broadcast; there cannot be more of them.
HOT_HOSTS = 1000


@lru_cache(4096)
def named_furniture(names: str) -> bool:
    """Whether a class or identifier is a word of furniture, alone or joined with words of ``PARTS``."""
    for name in names.lower().split():
        parts = [x for x in _joint.split(_digits.sub("", name)) if x and x != "x"]
        if parts and (parts[-1] in LAST or (any(x in FURNITURE for x in parts) and all(x in FURNITURE or x in PARTS for x in parts))):
            return True
    return False


@lru_cache(4096)
def names_comments(names: str) -> bool:
    return any(not COMMENTS.isdisjoint(_joint.split(name)) for name in names.lower().split())


@lru_cache(4096)
def label(tag: str, classes: str) -> str:
    names = sorted({_digits.sub("", c) for c in classes.lower().split()} - {""})
    return ".".join([tag, *names])


@lru_cache(16384)
def step(path: str, name: str) -> str:
    """A path is a digest of all its steps, so it has one size at any depth."""
    return hashlib.blake2b(f"{path}/{name}".encode("utf-8", "replace"), digest_size=8).hexdigest()


_of_comments = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|related|teaser)(?=$|[\s_-])")
_no_words = re.compile(r"<!--.*?-->|<(script|style|a|form|nav|aside|footer)\b.*?</\1\s*>|<[^>]*>|\s+", re.S | re.I)


def words_size(html: str) -> int:
    """About how much text markup holds outside of links."""
    return len(_no_words.sub("", html))


@lru_cache(256)
def tags_named(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


def end_of(html: str, at: int, tag: str) -> int:
    """Where the element that has just opened ends, its end tag included; -1 if it is never closed."""
    depth = 1
    for m in tags_named(tag).finditer(html, at):
        depth += -1 if m[1] else 0 if m[0][-2] == "/" else 1
        if not depth:
            return m.end()
    return -1


class Page:
    """Text outside furniture as a list of fragments, and the containers with their spans in it."""

    def __init__(self, html: str, spared: int = -1) -> None:
        #: Where the start tag ends whose class words count for nothing.
        self.spared = spared
        #: Size, and end of the start tag, of the largest container that its class words hide.
        self.hidden = (0, -1)
        self.in_heading = 0
        self.out: list[str] = []
        #: [path, start, end, text size, link text size, parent, tag, headings' size]
        self.containers: list[list] = [["", 0, 0, 0, 0, -1, "#root", 0]]
        #: [tag, is furniture, container that it opened or None, path]
        self.stack: list[list] = [["#root", False, 0, ""]]
        self.skip = self.links = 0
        self.read(html)
        while self.stack:
            self.close(self.stack.pop())
        if spared < 0 and self.hidden[1] >= 0 and self.only_headings():
            self.__init__(html, self.hidden[1])

    def only_headings(self) -> bool:
        """Whether nothing but headings and links is left, and no article or main element that holds more."""
        return self.containers[0][3] - self.containers[0][4] <= self.containers[0][7] and not any(x[6] in ("article", "main") and x[3] for x in self.containers)

    def text(self, raw: str) -> None:
        if self.skip or not raw:
            return
        raw = unescape(raw) if "&" in raw else raw
        self.out.append(raw)
        size = len(raw) - raw.count(" ") if not raw.isspace() else 0
        if size:
            box = self.containers[self.box]
            box[3] += size
            if self.links:
                box[4] += size
            elif self.in_heading:
                box[7] += size

    @property
    def box(self) -> int:
        return next(x[2] for x in reversed(self.stack) if x[2] is not None)

    def close(self, element: list) -> None:
        tag, furniture, box, _ = element
        if furniture:
            self.skip -= 1
        if tag == "a":
            self.links -= 1
        elif tag in HEADINGS:
            self.in_heading -= 1
        if tag in BLOCKS and not self.skip:
            self.out.append(" ")
        if box is not None:
            mine = self.containers[box]
            mine[2] = len(self.out)
            if mine[5] >= 0:
                self.containers[mine[5]][3] += mine[3]
                self.containers[mine[5]][4] += mine[4]
                self.containers[mine[5]][7] += mine[7]

    def end(self, tags: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        """Close the nearest open element of these tags, and what is open inside it."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                while len(self.stack) > i:
                    self.close(self.stack.pop())
                return
            if self.stack[i][0] in stop:
                return

    def open(self, tag: str, attributes: str, at: int) -> None:
        if tag == "body":
            self.end({"head"})
        if tag in ENDS_P:
            self.end({"p"}, SCOPES)
        if tag in SIBLINGS:
            self.end(SIBLINGS[tag], frozenset({"table"}) if tag in ("tr", "td", "th") else SCOPES - {tag})
        if tag in BLOCKS and not self.skip:
            self.out.append(" ")
        if tag in VOID:
            return
        if self.skip:
            self.links += tag == "a"
            self.in_heading += tag in HEADINGS
            self.stack.append([tag, False, None, ""])
            return
        classes = names = role = ""
        hidden = False
        if attributes and "=" in attributes or "hidden" in attributes:
            for m in _attribute.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "class":
                    classes = value
                if name in ("class", "id"):
                    names += " " + value
                elif name == "role":
                    role = value.lower()
                elif name == "hidden" or value.lower() == "true":
                    hidden = True
        inside = any(x[0] in ("article", "main") for x in self.stack) if tag == "header" else False
        elements = tag not in ("body", "html", "article", "main")
        furniture = elements and (tag in FURNITURE_TAGS or (tag == "header" and not inside) or role in FURNITURE_ROLES or hidden)
        self.by_name, self.names = False, names
        if not furniture and names and at != self.spared:
            self.by_name = furniture = named_furniture(names) if elements else tag == "article" and bool(_of_comments.search(names))
        path = step(self.stack[-1][3], label(tag, classes)) if tag != "html" else ""
        box = None
        if furniture:
            self.skip += 1
        elif tag in CONTAINERS and not self.skip:
            box = len(self.containers)
            self.containers.append([path, len(self.out), 0, 0, 0, self.box, tag, 0])
        if tag == "a":
            self.links += 1
        elif tag in HEADINGS:
            self.in_heading += 1
        self.stack.append([tag, furniture, box, path])

    def read(self, html: str) -> None:
        at = 0
        while m := _markup.search(html, at):
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                if tag == "br":
                    self.text(" ")
                self.end({tag}, frozenset({"table"}) if tag in ("p", "b", "i", "a", "span") else frozenset())
                continue
            skipped = self.skip
            self.open(tag, attributes, at)
            if self.skip and tag not in VOID and tag not in RAW and (end := end_of(html, at, tag)) > 0:
                if not skipped and self.by_name and tag in CONTAINERS and not names_comments(self.names):
                    self.hidden = max(self.hidden, (words_size(html[at:end]), at))
                at = end
                self.end({tag})
            elif tag in RAW:
                stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                if tag == "textarea" or tag == "title":
                    self.text(html[at : stop.start() if stop else len(html)])
                at = stop.end() if stop else len(html)
                self.end({tag})
        self.text(html[at:])

    def direct(self) -> list[int]:
        """Text of each container that lies in no inner one, links left out; 0 where most of it is links."""
        size, links = ([c[k] for c in self.containers] for k in (3, 4))
        for c in self.containers[1:]:
            size[c[5]] -= c[3]
            links[c[5]] -= c[4]
        return [s - k if s > 2 * k else 0 for s, k in zip(size, links)]

    def outside(self, boxes: list[int], known: frozenset[str] = frozenset()) -> int:
        """Text outside of the containers, without links and containers on known paths that hold none of them."""
        rest, chosen = self.direct(), set(boxes)
        holds = [i in chosen for i in range(len(rest))]
        for i in range(len(rest) - 1, 0, -1):
            parent = self.containers[i][5]
            holds[parent] |= holds[i]
            if i not in chosen and (holds[i] or self.containers[i][0] not in known):
                rest[parent] += rest[i]
        return 0 if 0 in chosen else rest[0]

    def little(self) -> float:
        return min(LITTLE, LITTLE_SHARE * sum(self.direct()))

    def choice(self, most: float = 0.0, known: frozenset[str] = frozenset()) -> int:
        """The innermost container outside of which there are only links, containers on known paths and, in other
        containers, at most so much text. One article or main element that holds most of the text is enough if all
        headings lie in it."""
        direct = self.direct()
        value = direct[:]
        for i in range(len(value) - 1, 0, -1):
            if self.containers[i][0] in known:
                value[i] = 0
            value[self.containers[i][5]] += value[i]
        inner: dict[int, list[int]] = {}
        for i, c in enumerate(self.containers[1:], 1):
            inner.setdefault(c[5], []).append(i)
        at = top = self.article(value)
        while children := inner.get(at):
            best = max(children, key=lambda i: value[i])
            if direct[at] or not value[best] or value[top] - value[best] > most:
                break
            at = best
        return at

    def article(self, value: list[int]) -> int:
        """The page's one article or main element, if it holds most of the text and all headings; else the whole page."""
        found, end = [], -1
        for i, c in enumerate(self.containers):
            if c[6] in ("article", "main") and c[1] >= end and value[i]:
                found.append(i)
                end = c[2]
        if len(found) == 1 and 2 * value[found[0]] >= value[0] and self.containers[found[0]][7] == self.containers[0][7]:
            return found[0]
        return 0

    def blocks(self, box: int) -> list[tuple[int, int, int]]:
        """Path, text and the page's whole text, as digests, of the containers that hold text and neither are the given
        one nor hold it. Those with most of the page are no furniture. Digits in a block do not count, as a year or a
        number of readers changes. A block of next to nothing has 0 for the page."""
        line = {0}
        while box > 0:
            line.add(box)
            box = self.containers[box][5]
        little, size, found, every = self.little(), self.containers[0][3], [], None
        for i, c in enumerate(self.containers):
            if i in line or not c[3] or c[6] in ("article", "main", "td") or (2 * c[3] > size and c[3] > little):
                continue
            if c[3] > little and every is None:
                every = digest(" ".join("".join(self.out).split()))
            text = _digits.sub("", " ".join("".join(self.out[c[1] : c[2]]).split()))
            found.append((int(c[0], 16) - (1 << 63), digest(text), 0 if c[3] <= little else every))
        return found

    def agreed(self, path: str | None, known: frozenset[str]) -> list[int]:
        """The containers on the host's path, or the page's own choice if that path leaves text out that does not
        recur on the host."""
        found = self.on_path(path) if path is not None else []
        own = self.choice(0.0, known)
        if found and own not in found and any(self.containers[i][3] for i in found) and self.outside(found, known) <= 0:
            return found
        return [own]

    def on_path(self, path: str) -> list[int]:
        """Containers on a path, outermost ones only, in page order."""
        found, end = [], -1
        for i, c in enumerate(self.containers):
            if c[0] == path and c[1] >= end:
                found.append(i)
                end = c[2]
        return found

    def text_of(self, boxes: list[int], known: frozenset[str] = frozenset()) -> str:
        """Text of the containers without those on known paths inside them."""
        parts = []
        for box in boxes:
            at, end = self.containers[box][1:3]
            for c in self.containers[box + 1 :] if known else ():
                if c[0] in known and at <= c[1] and c[2] <= end:
                    parts += self.out[at : c[1]]
                    at = c[2]
            parts += [*self.out[at:end], " "]
        return " ".join("".join(parts).split())


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Key, address, ``text`` and ``n_chars`` of every page."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    kind = rows.schema["key"].dataType.simpleString()
    # Hot hosts' pages are never shuffled, and the others' only if the winners are too many to broadcast.
    hosts = written(winners(rows), "hosts")
    total = hosts.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("n")).first()["n"]
    hot = hosts.where(F.col("all") * HOT_HOSTS >= total)
    cold = hosts.join(hot.select("host"), "host", "left_anti").select(F.col("host").alias("at"), F.col("path").alias("p"), F.col("known").alias("k"))
    met = rows.join(F.broadcast(hot.select("host", "path", "known", F.lit(True).alias("hot"))), "host", "left")
    # Rows already served get a key that meets nothing and lies anywhere; no host has a blank in it.
    met = met.withColumn("at", F.when(F.col("hot"), F.concat(F.lit(" "), F.xxhash64("html").cast("string"))).otherwise(F.col("host")))
    met = met.join(cold, "at", "left").select("key", "url", "html", F.coalesce("path", "p").alias("path"), F.coalesce("known", "k").alias("known"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, path, known in zip(*(batch.column(c).to_pylist() for c in ("html", "path", "known"))):
                page = Page(source)
                known = frozenset(f"{x + (1 << 63):016x}" for x in known or ())
                texts.append(page.text_of(page.agreed(path, known), known))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    out = met.mapInArrow(again, f"key {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("key", key).withColumnRenamed("url", url)


def winners(rows: DataFrame) -> DataFrame:
    """``host``, ``path`` (most votes), ``known`` (recurring paths), ``all`` (votes)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, lines, sizes, blocks = [], [], [], []
            for source, url in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist()):
                page = Page(source)
                box = page.choice(page.little())
                paths.append(page.containers[box][0])
                sizes.append(page.containers[box][3])
                address = digest(url or "")
                # The vote itself is the block without a path.
                blocks.append([{"way": None, "said": None, "page": None}] + [{"way": w, "said": t, "page": p or address} for w, t, p in page.blocks(box)])
                line = []
                while box > 0:
                    line.append(int(page.containers[box][0] or "0", 16) - (1 << 63))
                    box = page.containers[box][5]
                lines.append(line)
            fields = pa.list_(pa.struct([("way", pa.int64()), ("said", pa.int64()), ("page", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string()), pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(blocks, fields)], names=["host", "path", "line", "size", "blocks"])

    said = rows.select("host", "url", "html").mapInArrow(vote, "host string, path string, line array<long>, size long, blocks array<struct<way: long, said: long, page: long>>")
    said = said.select("host", "path", "line", "size", F.inline("blocks"))
    # One pass over the pages: votes and blocks are told apart by their path.
    is_vote = F.col("way").isNull()
    once = said.groupBy(
        "host", "way", "said", "page", F.when(is_vote, F.col("path")).alias("path"), F.when(is_vote, F.col("line")).alias("line")
    ).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    texts = once.groupBy("host", "way", "said", "path", "line").agg(F.sum(F.when(is_vote, F.col("n")).otherwise(1)).alias("n"), F.sum("size").alias("size"))
    recurs = F.sum(F.when(F.col("n") >= RECURS, F.col("n")).otherwise(0))
    ways = texts.groupBy("host", "way", "path", "line").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), recurs.alias("same"))
    won = F.max_by(F.struct("path", "line"), F.when(is_vote & (F.col("size") > 0), F.struct("n", "size", "path"))).alias("won")
    furniture = F.collect_list(F.when(~is_vote & (F.col("same") > 0) & (2 * F.col("same") >= F.col("n")), F.col("way"))).alias("ways")
    found = ways.groupBy("host").agg(won, furniture, F.sum(F.when(is_vote, F.col("n"))).alias("all"))
    return found.select("host", F.col("won.path").alias("path"), F.array_except("ways", F.coalesce("won.line", F.array().cast("array<long>"))).alias("known"), "all")
