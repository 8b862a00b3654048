"""Main text of web pages by wrappers inferred per host.

A wrapper is a union-free regular expression over a host's tag tokens: elements in order, each once, optional, repeated, or
both, and text slots. It starts as a page's own token stream, with tandem repeats folded into repeated groups, and is
aligned with one page after the other: elements that match are merged, mismatches become optional, and
slots gather what their texts have in common. Where the order of an element's children differs too much for
a sequence (more than LONGEST places), they become one repeated group of optional members, so a wrapper has at most as
many places per element as there are kinds of elements.

A task aligns the pages it reads, one wrapper per host; those wrappers are aligned in salted groups and then per host,
so the pages of a host never meet in one task. Elements are compared by tag and by what class, id and role
say about their purpose, never by their literal names, so numbered ids do not split a wrapper.

From a wrapper follows what of a host's pages is article:

- elements marked as article or main content, if the host has any outside menus and the like;
- otherwise everything but
  - slots whose text is the same on all pages that have them, if these are at least five and more than half of the host's pages;
  - link lists: blocks of several links without a heading, in which links are at least LINK_SHARE of the text on the host.

Equal pages of a host count as one page in its wrapper, however often they are repeated. A page that would lose all its
text to unchanging slots and link lists keeps them.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments inside are left out
(a header keeps its headings), by tag or by the words of class, id and role. A main word that is a whole name wins over those;
an aside word that is only part of a name does not count for article, main or beside a main name, nor where the host's running text
is mostly inside. A page without marks on a host with marks is treated by its own wrapper.

Character references are decoded, white space [\\x20\\x09-\\x0D] inside a block becomes one space, blocks are joined by two
line feeds; <br> is white space.

Defined results: a null or empty page has the text ''. Pages without a host form one group. Repeated rows are
extracted each. Only key, url and html are read. Pages are read whole at any depth, in time linear in their length; below DEEPEST
a wrapper knows only how much text there is and whether some of it is marked, so unchanging texts and link lists are not told there.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmate.llm.common import prepare, read_table, through_table
from shelfmate.llm.url_filters import host_of
from shelfmate.operators.joins import splittable_join

LONGEST = 24
DEEPEST = 150
SAME_PAGES = 5
LINK_SHARE = 0.7
SALTS = 64

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
ASIDE = set(
    "nav header footer aside form script style noscript template button select option textarea input iframe svg menu dialog head "
    "title object audio video canvas map label fieldset".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words in class, id and role that tell what an element is for.
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar sidebar "
    "aside complementary footer contentinfo masthead breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond share sharing social "
    "related recommended widget search toolbar skip hidden".split()
)
MAIN_WORDS = set("main article articlebody post entry story content maincontent postcontent entrycontent articlecontent".split())
#: An open element that a start tag of the given kind ends.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_KEEPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}

_OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/<>]*))")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_PIECES = re.compile(r"[a-z]+")


class Element:
    """An element of a page."""

    __slots__ = ("tag", "label", "children")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.children = tag, label, []


def _label(tag: str, attributes: str) -> str:
    """The tag with a hint from its attributes: ``!main``; ``!aside-<word>`` if a whole name says so, ``!part-<word>`` if
    only a part of a name does. A whole main name wins; on an article or main tag, or beside it, parts say nothing."""
    if not attributes or tag in ("html", "body"):
        return tag
    names = [name for _, a, b, c in _ATTRIBUTE.findall(attributes) for name in (a or b or c).lower().split()]
    whole = {name.replace("-", "").replace("_", "") for name in names}
    if whole & MAIN_WORDS:
        return tag + "!main"
    if whole & ASIDE_WORDS:
        return f"{tag}!aside-{min(whole & ASIDE_WORDS)}"
    if tag in ("article", "main"):
        return tag
    parts = {part for name in names for part in _PIECES.findall(name)}
    if parts & ASIDE_WORDS:
        return f"{tag}!part-{min(parts & ASIDE_WORDS)}"
    if parts & MAIN_WORDS:
        return tag + "!main"
    return tag


class _Ends:
    """Where tags of a page end: at the first ``>`` outside quotes. Starts ascend, and each quote or ``>`` that leads to no end
    is remembered, so all starts together take time linear in the page."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.next, self.dead = -1, set()

    def after(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends before ``at``, or -1."""
        if at > self.last:
            return -1
        if self.next < at:
            self.next = self._special(at)
        here, met = self.next, []
        while 0 <= here <= self.last and here not in self.dead:
            sign = self.page[here]
            if sign == ">":
                return here
            met.append(here)
            close = self.page.find(sign, here + 1)
            here = self._special(close + 1) if close >= 0 else -1
        self.dead.update(met)
        return -1

    def _special(self, at: int) -> int:
        found = _SPECIAL.search(self.page, at)
        return found.start() if found else len(self.page)


def _tokens(page: str):
    """(text before, closing, tag, attributes, end) of every token; the tag is None for comments, declarations and the end."""
    ends, at, end = _Ends(page), 0, len(page)
    seek = 0
    while True:
        match = _OPENING.search(page, seek)
        if not match:
            yield page[at:], False, None, "", end
            return
        if match[2] is None:
            close, width = ("-->", 3) if match[0] == "<!--" else (">", 1)
            stop = page.find(close, match.end())
            stop = end if stop < 0 else stop + width
        else:
            stop = ends.after(match.end()) + 1
            if not stop:
                seek = match.start() + 1
                continue
        jump = yield page[at : match.start()], bool(match[1]), match[2], page[match.end() : stop - 1], stop
        at = seek = stop if jump is None else jump


def parse(page: str) -> Element:
    """The element tree of a page, however badly closed and however deep. Children are elements and texts."""
    root = Element("", "")
    stack = [root]
    places: dict[str, list[int]] = {"p": []}  # by tag, where the stack has it
    paragraphs = places["p"]
    blocks: list[int] = []  # where the stack has blocks other than paragraphs
    end = len(page)

    def last(tags) -> int:
        return max((places[tag][-1] for tag in tags if places.get(tag)), default=0)

    def close(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop().tag].pop()
        while blocks and blocks[-1] >= depth:
            blocks.pop()

    tokens = _tokens(page)
    jump = None
    while True:
        try:
            text, closing, tag, attributes, at = tokens.send(jump)
        except StopIteration:
            return root
        jump = None
        if text:
            stack[-1].children.append(text)
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if paragraphs and tag in BLOCKS and paragraphs[-1] > (blocks[-1] if blocks else 0):
            close(paragraphs[-1])
        if tag in ENDS:
            ended = last(ENDS[tag])
            if ended > last(_KEEPS[tag]):
                close(ended)
        element = Element(tag, _label(tag, attributes))
        stack[-1].children.append(element)
        if tag in RAW:
            raw_end = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            stop = raw_end.start() if raw_end else end
            element.children.append(page[at:stop])
            jump = page.find(">", stop) + 1 if raw_end else end
            jump = jump or end
        elif tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS and tag != "p":
                blocks.append(len(stack))
            stack.append(element)


def is_aside(label: str, in_main: bool) -> bool:
    tag, _, hint = label.partition("!")
    return hint.startswith(("aside", "part")) or tag in ASIDE and not (tag == "header" and in_main)


def is_main(label: str) -> bool:
    tag, _, hint = label.partition("!")
    return tag in ("article", "main") or hint == "main"


# --- wrappers --------------------------------------------------------------------------------


class Place:
    """A place of a wrapper: an element or, with label ``#``, a text slot."""

    __slots__ = ("label", "optional", "repeated", "free", "children", "pages", "chars", "links", "same")

    def __init__(self, label, optional=False, repeated=False, free=False, children=(), pages=1, chars=0, links=0, same=None):
        self.label, self.optional, self.repeated, self.free = label, optional, repeated, free
        self.children, self.pages, self.chars, self.links, self.same = list(children), pages, chars, links, same

    def pack(self) -> list:
        return [self.label, int(self.optional), int(self.repeated), int(self.free), self.pages, self.chars, self.links, self.same,
                [c.pack() for c in self.children]]

    @staticmethod
    def unpack(x: list) -> Place:
        return Place(x[0], bool(x[1]), bool(x[2]), bool(x[3]), [Place.unpack(c) for c in x[8]], x[4], x[5], x[6], x[7])

    def expression(self) -> str:
        """The wrapper as a regular expression over tokens."""
        if self.label == "#":
            inner = "#text"
        else:
            parts = " ".join(c.expression() for c in self.children)
            inner = f"<{self.label}>{f'({parts})+' if self.free else parts}</{self.label}>" if self.label else parts
        mark = "*" if self.optional and self.repeated else "?" if self.optional else "+" if self.repeated else ""
        return f"({inner}){mark}" if mark else inner


def _flat(element: Element) -> list[Place]:
    """What lies below a place at the greatest depth: one text slot, and the first element marked as main text."""
    chars, main, work = 0, None, [element]
    while work:
        at = work.pop()
        for child in reversed(at.children):
            if not isinstance(child, Element):
                chars += len(clean(child))
            elif not is_aside(child.label, True):
                if is_main(child.label):
                    main = child.label
                work.append(child)
    return ([Place("#", chars=chars)] if chars else []) + ([Place(main)] if main else [])


def own_wrapper(element: Element, in_link: bool = False, depth: int = 0) -> Place:
    """A page's own wrapper: its tokens, with repeats folded."""
    if depth >= DEEPEST:
        return Place(element.label, children=_flat(element))
    places = []
    link = in_link or element.tag == "a"
    for child in element.children:
        if isinstance(child, Element):
            places.append(own_wrapper(child, link, depth + 1))
        else:
            text = clean(child)
            if text:
                places.append(Place("#", chars=len(text), links=len(text) if link else 0, same=zlib.crc32(text.encode())))
    return _bounded(Place(element.label, children=_fold(places)))


def _fold(places: list[Place]) -> list[Place]:
    """Tandem repeats of one to three places become repeated places. A repeat of several is kept as
    one run of repeated members, in their first order."""
    out: list[Place] = []
    for place in places:
        out.append(place)
        folded = True
        while folded:
            folded = False
            for width in (1, 2, 3):
                if len(out) >= 2 * width and [p.label for p in out[-width:]] == [p.label for p in out[-2 * width : -width]]:
                    last = out[-width:]
                    del out[-width:]
                    for kept, again in zip(out[-width:], last):
                        _merge(kept, again, same_page=True)
                        kept.repeated = True
                    folded = True
                    break
    return out


def _merge(into: Place, other: Place, same_page: bool = False) -> None:
    into.optional |= other.optional
    into.repeated |= other.repeated
    into.chars += other.chars
    into.links += other.links
    into.pages = max(into.pages, other.pages) if same_page else into.pages + other.pages
    if into.same != other.same:
        into.same = None
    into.children = align(into, other, same_page)
    _bounded(into)


def align(into: Place, other: Place, same_page: bool = False) -> list[Place]:
    """The children of two places as one sequence: a longest common subsequence is merged, the rest is optional."""
    a, b = into.children, other.children
    if into.free or other.free:
        into.free = True
        return _by_label(_by_label(a, True) + _by_label(b, True), same_page)
    n, m = len(a), len(b)
    if [p.label for p in a] == [p.label for p in b]:
        for x, y in zip(a, b):
            _merge(x, y, same_page)
        return a
    common = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            common[i][j] = common[i + 1][j + 1] + 1 if a[i].label == b[j].label else max(common[i + 1][j], common[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i].label == b[j].label:
            _merge(a[i], b[j], same_page)
            out.append(a[i])
            i, j = i + 1, j + 1
        elif j == m or i < n and common[i + 1][j] >= common[i][j + 1]:
            a[i].optional = True
            out.append(a[i])
            i += 1
        else:
            b[j].optional = True
            out.append(b[j])
            j += 1
    return out


def _by_label(places: list[Place], same_page: bool) -> list[Place]:
    kinds: dict[str, Place] = {}
    for place in places:
        if place.label in kinds:
            _merge(kinds[place.label], place, same_page)
        else:
            place.optional = True
            kinds[place.label] = place
    return [kinds[label] for label in sorted(kinds)]


def _bounded(place: Place) -> Place:
    if not place.free and len(place.children) > LONGEST:
        place.free = True
        place.children = _by_label(place.children, same_page=True)
    return place


def overruled(wrapper: Place) -> frozenset[str]:
    """Paths of elements labelled as asides that hold most of the host's running text, so that the label is wrong. Parts of
    names are overruled by more than half of the text outside whole names; whole names only if there is no text outside them."""
    for hints in ({"part"}, {"part", "aside"}):
        mass: dict[str, int] = {}

        def walk(place: Place, path: str) -> int:
            total = 0
            for child in place.children:
                tag, _, hint = child.label.partition("!")
                hint = hint.partition("-")[0]
                if child.label == "#":
                    total += child.chars - child.links
                elif tag not in ASIDE and (hint != "aside" or hint in hints):
                    below = f"{path}/{child.label}"
                    got = walk(child, below)
                    if hint in hints:
                        mass[below] = mass.get(below, 0) + got
                    total += got
            return total

        whole = walk(wrapper, "")
        if whole:
            return frozenset(path for path, chars in mass.items() if 2 * chars > whole)
    return frozenset()


def plan_of(wrapper: Place) -> dict:
    """Where articles are: whether elements are marked, and by path of labels what is no aside after all and what is
    boilerplate on an unmarked host, unchanging texts and link lists."""
    kept = overruled(wrapper)
    if _has_main(wrapper, kept):
        return {"marked": True, "kept": kept, "same": {}, "links": set()}
    same: dict[str, set[int]] = {}
    links: set[str] = set()

    def walk(place: Place, path: str, only: bool) -> tuple[int, int, int, bool]:
        """(characters, those in links, links, whether there is a heading) of what _take would take."""
        chars = linked = anchors = 0
        heading = False
        for child in place.children:
            if child.label == "#":
                if only:
                    continue
                if child.same is not None and not child.repeated and child.pages >= SAME_PAGES and 2 * child.pages > wrapper.pages:
                    same.setdefault(path, set()).add(child.same)
                chars, linked = chars + child.chars, linked + child.links
            elif f"{path}/{child.label}" in kept or not is_aside(child.label, True):
                tag = child.label.partition("!")[0]
                below = f"{path}/{child.label}"
                c, l, n, h = walk(child, below, _only_headings(tag, only))
                n = (n or tag == "a") * (2 if child.repeated else 1) if n < 2 else n
                if tag in BLOCKS and tag not in HEADINGS and tag not in ("html", "body") and not h and n > 1 and l >= LINK_SHARE * c > 0:
                    links.add(below)
                chars, linked, anchors, heading = chars + c, linked + l, anchors + n, heading or h or tag in HEADINGS
        return chars, linked, anchors, heading

    walk(wrapper, "", False)
    return {"marked": False, "kept": kept, "same": same, "links": links}


def _only_headings(tag: str, only: bool) -> bool:
    """Whether of an element only headings count."""
    return (only or tag == "header") and tag not in HEADINGS


def _has_main(place: Place, kept: frozenset[str], path: str = "") -> bool:
    for child in place.children:
        below = f"{path}/{child.label}"
        if child.label != "#" and (below in kept or not is_aside(child.label, False)):
            if is_main(child.label) or _has_main(child, kept, below):
                return True
    return False


# --- extraction -------------------------------------------------------------------------------


def clean(text: str) -> str:
    return _BLANK.sub(" ", entities.unescape(text)).strip(" ")


class _Blocks:
    def __init__(self):
        self.done: list[str] = []
        self.open: list[str] = []

    def text(self, raw: str) -> None:
        self.open.append(raw)

    def end(self) -> None:
        block = clean("".join(self.open))
        self.open = []
        if block:
            self.done.append(block)


def _below(path: str | None, label: str, depth: int) -> str | None:
    """The path of a child at ``depth``; None beyond the depth of wrappers, which no plan mentions."""
    return f"{path}/{label}" if depth <= DEEPEST else None


def _take(element: Element, blocks: _Blocks, plan: dict, path: str | None = "", depth: int = 0) -> None:
    work = [(iter(element.children), path, False, False)]
    while work:
        children, path, only, is_block = work[-1]
        same = plan["same"].get(path, ())
        for child in children:
            if not isinstance(child, Element):
                if not only and not (same and zlib.crc32(clean(child).encode()) in same):
                    blocks.text(child)
                continue
            below = _below(path, child.label, depth + len(work))
            if below not in plan["kept"] and is_aside(child.label, True):
                continue
            block = child.tag in BLOCKS
            if block:
                blocks.end()
            if below in plan["links"]:
                continue
            if child.tag == "br":
                blocks.text("\n")
            work.append((iter(child.children), below, _only_headings(child.tag, only), block))
            break
        else:
            work.pop()
            if is_block:
                blocks.end()


def _marked(element: Element, blocks: _Blocks, plan: dict) -> bool:
    found = False
    work = [(iter(element.children), "")]
    while work:
        children, path = work[-1]
        for child in children:
            if not isinstance(child, Element):
                continue
            below = _below(path, child.label, len(work))
            if below not in plan["kept"] and is_aside(child.label, False):
                continue
            if is_main(child.label):
                _take(child, blocks, plan, below, len(work))
                blocks.end()
                found = True
            else:
                work.append((iter(child.children), below))
                break
        else:
            work.pop()
    return found


def extract(page: Element, plan: dict | None) -> str:
    blocks = _Blocks()
    plan = plan or plan_of(own_wrapper(page))
    if plan["marked"] and not _marked(page, blocks, plan):
        plan = plan_of(own_wrapper(page))
        if plan["marked"]:
            _marked(page, blocks, plan)
    if not plan["marked"]:
        for what in (plan, {**plan, "same": {}, "links": set()}):
            _take(page, blocks, what)
            blocks.end()
            if blocks.done:
                break
    return "\n\n".join(blocks.done)


# --- on Spark ----------------------------------------------------------------------------------


def _rows(wrappers: dict[str, Place]) -> pa.RecordBatch:
    packed = [json.dumps(w.pack(), ensure_ascii=False) for w in wrappers.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(wrappers), pa.string()), pa.array(packed, pa.string())], names=["host", "wrapper"])


def _infer(batches):
    wrappers: dict[str, Place] = {}
    for batch in batches:
        for host, page in zip(batch.column(0), batch.column(1)):
            name, own = host.as_py(), own_wrapper(parse(page.as_py() or ""))
            if name in wrappers:
                _merge(wrappers[name], own)
            else:
                wrappers[name] = own
            if len(wrappers) >= 5000:
                yield _rows(wrappers)
                wrappers = {}
    if wrappers:
        yield _rows(wrappers)


def _combine(rows: pd.DataFrame) -> pd.DataFrame:
    packed = sorted(rows["wrapper"])
    whole = Place.unpack(json.loads(packed[0]))
    for other in packed[1:]:
        _merge(whole, Place.unpack(json.loads(other)))
    return pd.DataFrame({"host": rows["host"].iloc[:1], "wrapper": [json.dumps(whole.pack(), ensure_ascii=False)]})


def host_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper) of every host, from its distinct pages."""
    prepare(pages.sparkSession)
    page = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), F.md5(page.cast("binary")).alias("digest"), page.alias("page"))
    distinct = rows.dropDuplicates(["host", "digest"]).select("host", "page")
    parts = distinct.mapInArrow(_infer, "host string, wrapper string")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    combined = salted.groupBy("host", "salt").applyInPandas(_combine, "host string, wrapper string")
    return combined.groupBy("host").applyInPandas(_combine, "host string, wrapper string")


def _extracted(batches):
    plans: dict[str, dict] = {}
    for batch in batches:
        texts = []
        for page, packed in zip(batch.column(1), batch.column(2)):
            wrapper = packed.as_py()
            if wrapper is not None and wrapper not in plans:
                if len(plans) >= 1000:
                    plans.clear()
                plans[wrapper] = plan_of(Place.unpack(json.loads(wrapper)))
            texts.append(extract(parse(page.as_py() or ""), plans.get(wrapper)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_row", "text"])


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, url, text."""
    prepare(pages.sparkSession)
    wrappers = through_table(host_wrappers(pages, url, html), "host-wrappers")
    rows = pages.select(
        F.struct(F.col(key).alias("key"), F.col(url).alias("url")).alias("_row"),
        F.col(html).alias("_html"),
        F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"),
    )
    joined = splittable_join(rows, wrappers, ["host"], "left").select("_row", "_html", "wrapper")
    schema = T.StructType([joined.schema["_row"], T.StructField("text", T.StringType())])
    return joined.mapInArrow(_extracted, schema).select(F.col("_row.key").alias(key), F.col("_row.url").alias(url), "text")


def query(spark, sf_dir):
    found = main_text(read_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
