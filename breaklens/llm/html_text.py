"""Main text of web pages: site templates are found by subtrees that recur on a host."""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breaklens.session import ship_package, written

#: A subtree is template if it stands on this many pages of its host.
MIN_PAGES = 4
#: Inside the declared main content also on more than this share of its host's pages.
MAIN_SHARE = 0.5

# Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NOT_TEXT = frozenset("head script style title noscript template iframe object embed svg math canvas audio video "
                     "select option datalist textarea button input label fieldset legend form nav header footer "
                     "aside menu dialog map applet".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
                  "nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead "
                  "tr ul".split())
#: Elements that may be template inside the main content (lone paragraphs and headings are text).
GROUPS = frozenset("address center details dir div dl figure hgroup menu ol section table ul".split())
#: Elements that a start tag of the key closes, up to the nearest element of the second set.
CLOSED_BY = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table", "tbody", "thead", "tfoot"))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "body": (frozenset(("head",)), frozenset(("html",))),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar "
                  "toolbar status".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion sidebar "
                  "cookie cookies consent gdpr newsletter subscribe signup popup modal overlay nav navbar navigation "
                  "menu breadcrumb breadcrumbs footer comments comment disqus share sharing social related "
                  "recommended widget pagination pager notice banner login skip".split())
COMMENTS = frozenset("comments comment disqus".split())
#: Words that give an element away as part of any name, unless one of DENIALS stands beside them.
SURE = frozenset("ad ads advert adverts advertisement advertising adbox sponsor sponsored cookie cookies consent gdpr "
                 "newsletter disqus navbar breadcrumb breadcrumbs".split())
DENIALS = frozenset("has with no without".split())
#: Words that say nothing beside one of NAMES; any other makes the name one of its own.
FILLER = frozenset("list area section box block wrap wrapper container bar item items inner outer row column top bottom "
                   "left right site primary secondary mobile desktop sticky fixed link links button buttons icon icons "
                   "post posts article articles panel group toggle reader user header main".split())
WHOLE_NAMES = frozenset("header site-header page-header masthead top-bar topbar".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?""")
_NAME = re.compile(r"[^a-z0-9]+")


# Where an open element is looked for no further up.
_P_STOPS = frozenset("button td th table".split())
_INLINE_STOPS = frozenset("td th article main body".split())
_RULES = list(dict.fromkeys(CLOSED_BY.values()))
_RULE_OF = {tag: _RULES.index(rule) for tag, rule in CLOSED_BY.items()}
_RULE_TAGS = frozenset().union(*(closed | stop for closed, stop in _RULES))


class _Element:
    """An open or closed element. What would take a walk over its ancestors is handed down from its parent:
    ``block`` (nearest block element), ``in_p`` and ``in_article``, ``inline`` (counts of the open elements
    below the nearest of ``_INLINE_STOPS``) and ``outer`` (for each rule of ``CLOSED_BY``, the outermost
    element that it would close)."""

    __slots__ = ("block", "digest", "dropped", "in_article", "in_p", "inline", "junk", "last", "main", "mains",
                 "name", "named", "near", "outer", "parent", "parts", "seen", "size", "tag")

    def __init__(self, tag: str, parent: _Element | None, junk: bool, name: int = 0) -> None:
        self.tag, self.parent, self.name = tag, parent, name
        self.junk = junk or (parent is not None and parent.junk)
        self.named = self if name else parent.named if parent is not None else None
        self.size = self.mains = 0  # of a named element: characters and outermost main elements inside
        self.dropped = False
        self.main = tag in MAIN or (parent is not None and parent.main)
        self.parts: list[bytes] = []
        self.digest = 0
        self.seen, self.last, self.near = False, -1, None
        if parent is None:
            self.block, self.in_p, self.in_article = self, False, False
            self.inline: dict[str, int] = {}
            self.outer: tuple = (None,) * len(_RULES)
            return
        self.block = self if tag in BLOCK else parent.block
        self.in_p = tag == "p" or (parent.in_p and tag not in _P_STOPS)
        self.in_article = tag == "article" or parent.in_article
        self.inline = {} if tag in _INLINE_STOPS else parent.inline
        self.inline[tag] = self.inline.get(tag, 0) + 1
        self.outer = parent.outer
        if tag in _RULE_TAGS:
            self.outer = tuple(None if tag in stop else known or (self if tag in closed else None)
                               for known, (closed, stop) in zip(parent.outer, _RULES, strict=True))


def _is_junk(tag: str, attributes: str) -> bool:
    if tag in NOT_TEXT:
        return True
    if not attributes or tag in ("html", "body") or tag in MAIN:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name == "role" and value in ROLES:
            return True
    return False


def _by_name(tag: str, attributes: str, in_article: bool) -> int:
    """Do class and id give an element away: 0 no, 1 by a word that layouts use as well, 2 for sure."""
    found = 0
    if not attributes or tag in ("html", "body") or (tag in MAIN and not (tag == "article" and in_article)):
        return found
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name != "class" and (name != "id" or tag in HEADINGS):
            continue
        for token in value.strip("\"'").lower().split():
            parts = {w for w in _NAME.split(token) if w and not w.isdigit()}
            alone = not parts.isdisjoint(NAMES) and parts <= NAMES | FILLER
            comment = alone and not parts.isdisjoint(COMMENTS)
            if tag in MAIN:  # only a comment of its own is junk inside an article
                found = max(found, 2 * comment)
            elif comment or (not parts.isdisjoint(SURE) and parts.isdisjoint(DENIALS)):
                found = 2
            elif alone or token in WHOLE_NAMES:
                found = max(found, 1)
    return found


class PageTree:
    """The elements of one page, built in one pass; bad nesting closes what it must.

    ``blocks``: (text, in main content, dropped by its own markup, enclosing
    block element) in page order. Every block element outside the main content
    and every group inside gets the digest of its subtree: element names and texts,
    in order.
    """

    def __init__(self, page: str) -> None:
        self.root = self.at = _Element("", None, False)
        self.blocks: list[tuple[str, bool, bool, _Element]] = []
        self._mains: list[_Element] = []
        self._text: list[tuple[str, _Element | None]] = []
        self._named: list[_Element] = []
        self._open: dict[str, int] = {}
        self._size = self._outermost = 0
        self._raw: list[tuple[list[tuple[str, _Element | None]] | None, _Element]] = []
        self._parse(page)
        self._flush()
        while self.at is not None:
            self._close_one()
        self._resolve()

    def _resolve(self) -> None:
        """Drops what names give away, but not what holds the declared main content or most of the text."""
        sure = sum(e.size for e in self._named if e.name == 2 and (e.parent.named is None or e.parent.named.name != 2))
        declared = any(e.named is None for e in self._mains)
        for e in self._named:  # outer ones first
            holds = self._outermost and e.mains == self._outermost and 2 * e.size >= self._size
            most = e.name == 1 and (e.main or not declared) and 2 * e.size > max(self._size - sure, e.size)
            above = e.parent.named
            e.dropped = (above is not None and above.dropped) or not (holds or most)
        self.has_main = any(e.named is None or not e.named.dropped for e in self._mains)
        for pieces, e in self._raw:
            if pieces is None:
                above = e.parent.named if e.parent is not None else None
                if not (above is not None and above.dropped) and (e.junk or e.dropped):
                    self.blocks.append(("", False, True, e))
                continue
            text = " ".join("".join(x for x, named in pieces if named is None or not named.dropped).split())
            if text:
                self.blocks.append((text, e.main, False, e))

    def _parse(self, page: str) -> None:
        pos, n = 0, len(page)
        while pos < n:
            lt = page.find("<", pos)
            if lt < 0:
                self._add(page[pos:])
                return
            if lt > pos:
                self._add(page[pos:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                pos = n if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), lt):
                end = page.find(">", lt)
                pos = n if end < 0 else end + 1
                continue
            m = _TAG.match(page, lt) or _LOOSE_TAG.match(page, lt)
            if m is None:
                if page[lt + 1:lt + 2].isalpha() or page.startswith("</", lt):  # a tag that never ends
                    end = page.find("<", lt + 1)
                    pos = n if end < 0 else end
                else:
                    self._add("<")
                    pos = lt + 1
                continue
            pos = m.end()
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, pos)
                self.at.parts.append(page[pos:end.start() if end else n].encode("utf-8", "surrogatepass"))
                pos = end.start() if end else n

    def _add(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.at.parts.append(text.encode("utf-8", "surrogatepass"))
        if not self.at.junk:
            self._text.append((text, self.at.named))
            size = len(text.strip())
            self._size += size
            if self.at.named is not None:  # handed on to the next named one when this one closes
                self.at.named.size += size

    def _flush(self) -> None:
        if self._text:
            self._raw.append((self._text, self.at.block))
            self._text = []

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK or tag in MAIN:
            self._flush()
            if self.at.in_p:
                self._end("p")
        if tag in CLOSED_BY:
            last = self.at.outer[_RULE_OF[tag]]
            while last is not None and self.at is not last.parent:
                self._close_one()
        if tag == "br":
            self._text.append(("\n", None))
        if tag in VOID:
            self.at.parts.append(b"<" + tag.encode() + b">")
            return
        name = _by_name(tag, attributes, tag in MAIN and self.at.in_article) if attributes else 0
        e = _Element(tag, self.at, _is_junk(tag, attributes), name)
        if name:
            self._named.append(e)
        if tag in MAIN and not e.junk:
            self._mains.append(e)
            if not self.at.main:
                self._outermost += 1
                if e.named is not None:
                    e.named.mains += 1
        self._open[tag] = self._open.get(tag, 0) + 1
        self.at = e
        if attributes.endswith("/") and tag in ("svg", "path"):
            self._close_one()

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if tag == "br":
            self._text.append(("\n", None))
        if not (self._open if tag in BLOCK else self.at.inline).get(tag):
            return
        while self.at.tag != tag:
            self._close_one()
        self._close_one()

    def _close_one(self) -> None:
        e = self.at
        if e.tag in BLOCK or e.parent is None:
            self._flush()
        whole = b"\0".join(b" ".join(p.split()) for p in e.parts)
        digest = hashlib.blake2b(e.tag.encode() + b"\1" + whole, digest_size=8).digest()
        if e.parent is not None:
            e.parent.parts.append(digest.hex().encode())
        if e.tag in (GROUPS if e.main else BLOCK) and e.tag not in ("html", "body") and e.tag not in MAIN:
            e.digest = int.from_bytes(digest, "little", signed=True)
            if e.main:
                e.digest = ~e.digest  # not one with the same subtree outside
            elif (e.junk or e.name) and not (e.parent is not None and e.parent.junk) and whole.strip(b"\0"):
                self._raw.append((None, e))
        e.parts = []
        if e.parent is not None:
            self._open[e.tag] -= 1
            e.inline[e.tag] -= 1
            if e.name and e.parent.named is not None:
                e.parent.named.size += e.size
                e.parent.named.mains += e.mains
        self.at = e.parent

    def trees(self) -> dict:
        """A digest of the page's texts, and those of the distinct subtrees that a template may hold."""
        texts = "\0".join(text for text, *_ in self.blocks if text).encode("utf-8", "surrogatepass")
        found: tuple[set[int], set[int]] = set(), set()
        for _, main, _, e in self.blocks:
            while e is not None and e.main == main and not e.seen:
                e.seen = True
                if e.digest:
                    found[main].add(e.digest)
                e = e.parent
        return {"body": int.from_bytes(hashlib.blake2b(texts, digest_size=8).digest(), "little", signed=True),
                "trees": sorted(found[False]), "inner": sorted(found[True])}

    def kept(self) -> list[dict]:
        """Stretches of text that the page's own markup leaves. ``trees`` are the digests of the elements (inside
        the main content of the groups in it) that begin with a stretch, ``last`` the stretches they end with."""
        texts: list[list[str]] = []
        around: list[tuple[_Element, int]] = []
        within: _Element | None = self.root
        for text, main, junk, block in self.blocks:
            if junk or (self.has_main and not main):
                continue
            e, fresh = block, []
            while e is not None and e.main == main and e.last < 0:
                e.last = 0
                fresh.append(e)
                e = e.parent
            near = e.near if e is not None and e.main == main else None
            for e in reversed(fresh):  # outer ones first
                if e.digest:
                    near = e
                    around.append((e, len(texts)))
                e.near = near
            near = block.near
            if texts and near is within:
                texts[-1].append(text)
            else:
                texts.append([text])
                within = near
                if near is not None:
                    near.last = len(texts) - 1
        out = [{"text": " ".join(t), "trees": [], "last": []} for t in texts]
        for e, first in reversed(around):  # inner ones first
            above = e.parent.near if e.parent is not None and e.parent.main == e.main else None
            if above is not None:
                above.last = max(above.last, e.last)
            out[first]["trees"].append(e.digest)
            out[first]["last"].append(e.last)
        return out


def _parsed(pages: DataFrame, html_col: str, cols: dict[str, Column], field: tuple, make) -> DataFrame:
    """``cols`` and what ``make`` takes out of each page's tree (``field``: name, Arrow type, SQL type)."""
    ship_package(pages.sparkSession)
    name, arrow, sql = field

    def run(batches):
        for batch in batches:
            found, size, lo = [], 0, 0
            for i, page in enumerate(batch.column(batch.num_columns - 1)):
                page = page.as_py() or ""
                size += len(page)
                found.append(make(PageTree(page)))
                if size > 4 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [*(c.slice(lo, len(found)) for c in batch.columns[:-1]), pa.array(found, arrow)],
                        names=[*batch.schema.names[:-1], name])
                    found, size, lo = [], 0, i + 1

    given = pages.select(*(c.alias(n) for n, c in cols.items()), F.col(f"`{html_col}`").alias("_html"))
    listed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{listed}, {name} {sql}")


def _marked(inner: bool):
    return lambda d: F.struct(d.alias("tree"), F.lit(inner).alias("inner"))


_TREES = ("found", pa.struct([("body", pa.int64()), ("trees", pa.list_(pa.int64())), ("inner", pa.list_(pa.int64()))]),
          "struct<body:bigint,trees:array<bigint>,inner:array<bigint>>")
_KEPT = ("blocks", pa.list_(pa.struct([("text", pa.string()), ("trees", pa.list_(pa.int64())), ("last", pa.list_(pa.int32()))])),
         "array<struct<text:string,trees:array<bigint>,last:array<int>>>")


def without(blocks: list[dict], gone: list[int]) -> str:
    """The texts of :meth:`PageTree.kept` outside of the subtrees that ``gone`` lists."""
    dropped, end, left = set(gone), -1, []
    for i, b in enumerate(blocks):
        for tree, last in zip(b["trees"], b["last"], strict=True):
            if tree in dropped:
                end = max(end, last)
        if i > end:
            left.append(b["text"])
    return " ".join(left)


def _assembled(left: DataFrame, own: list[str]) -> DataFrame:
    """``own`` columns, text and n_template out of blocks and gone."""
    def run(batches):
        for batch in batches:
            blocks, gone = batch.column("blocks"), batch.column("gone")
            text = pa.array([without(b.as_py(), g.as_py()) for b, g in zip(blocks, gone, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), text, pc.list_value_length(gone).cast(pa.int64())],
                                             names=[*own, "text", "n_template"])

    listed = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in left.select(own).schema.fields)
    return left.select(*own, "blocks", "gone").mapInArrow(run, f"{listed}text string, n_template bigint")


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of ``pages`` but the html, then ``text`` and ``n_template``.

    Each element outside the declared main content (``article``, ``main``) and
    each group (``div``, lists, tables) inside is
    hashed with everything below it. Spark counts on how many pages of its host
    a subtree stands, pages of the same texts once (copies are no template); those on at least ``min_pages`` pages, however large
    the host, are the site's template and are deleted (n_template subtrees).
    Of what is left, the main content counts where a page declares one, else
    everything; menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles, hidden elements and reader comments that their markup
    gives away are dropped on sites of any size. Inside the main content, a
    group must also stand on more than half of the host's pages; paragraphs
    outside of such groups stay, however often their text recurs.

    Pages are parsed twice, once for the counts and once for the text, so that
    only digests are stored and the text moves once.

    Character references are decoded, white space inside a block becomes one
    blank, blocks are joined by one blank in page order. Null and empty pages
    give an empty text; pages without a host share the empty host; repeated
    rows count as one page. Other columns may have any name; one
    called text or n_template is replaced.
    """
    own = {f"c{i}": name for i, name in enumerate(c for c in pages.columns if c not in (html_col, "text", "n_template"))}
    host = F.coalesce(F.lower(F.try_parse_url(F.col(f"`{url_col}`"), F.lit("HOST"))), F.lit(""))
    content = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")  # pages that agree in both share their templates
    key = {"k1": F.xxhash64(F.lit(1), *content), "k2": F.xxhash64(F.lit(2), *content)}
    digests = written(_parsed(pages, html_col, key | {"host": F.xxhash64(host)}, _TREES, PageTree.trees), "trees")
    trees = digests.select("k1", "k2", "host", "found.body", F.explode(F.concat(*(
        F.transform(f"found.{name}", _marked(inner))
        for name, inner in (("trees", False), ("inner", True))))).alias("t")).select("k1", "k2", "host", "body", "t.*")
    sizes = digests.select("host", "found.body").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    template = (trees.select("host", "tree", "inner", "body").distinct().groupBy("host", "tree", "inner").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
                .join(sizes, "host").where(~F.col("inner") | (F.col("n") > F.col("pages") * MAIN_SHARE)).select("host", "tree"))
    gone = trees.join(template, ["host", "tree"]).groupBy("k1", "k2").agg(F.collect_set("tree").alias("gone"))
    texts = _parsed(pages, html_col, {n: F.col(f"`{c}`") for n, c in own.items()} | key, _KEPT, PageTree.kept)
    none = F.array().cast("array<bigint>")
    left = texts.join(gone, ["k1", "k2"], "left").withColumn("gone", F.coalesce("gone", none))
    return _assembled(left, list(own)).select(
        *(F.col(n).alias(c) for n, c in own.items()), "text", "n_template")
