"""Main text of web pages by wrappers inferred from pages of the same host."""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from timeloom.llm.url_filters import host_of
from timeloom.plans.scratch import materialise, small_batches

#: Longest unit of tokens that is looked for as a repeated group; nodes of a wrapper beyond which pages that don't fit it
#: are a kind of page beside it; and the most that two token streams may have in pairs to be aligned.
MAX_UNIT, MAX_NODES, MAX_PAIRS = 24, 1500, 2_000_000
#: Wrappers that a task holds before it sends them on.
HELD_HOSTS = 500
#: A text slot that has one and the same text on so many different pages is part of the template, if it is at most
#: FIXED_WORDS long and the host's articles do differ.
FIXED_PAGES = 3
# Elements by their role in HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
NEVER_SHOWN = frozenset("head script style noscript template iframe svg math object audio video canvas title".split())
NEVER = frozenset("head script style noscript template iframe svg math object audio video canvas form button select option textarea label input nav menu footer aside dialog title".split())
CLOSED_BY = {"p": BLOCKS - {"body", "html", "caption", "option"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
FIXED_WORDS = 15
#: Signs of what a slot holds: outside roles count so little, the article's so much more; links are discounted. An element
#: is entered on the way to the article if it holds INNER_SHARE of the weight around (MAIN_SHARE if it is marked as main).
ASIDE_WEIGHT, MAIN_WEIGHT, LINK_WEIGHT, INNER_SHARE, MAIN_SHARE = 0.02, 4.0, 0.05, 0.9, 0.5
CONTAINERS = frozenset("html body div section article main center table tbody tr td dl span font figure details".split())
#: Words in class, id or role that mark an element as other than the article.
ASIDE = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|sidebar|side|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|foot|header|masthead|banner|cookie|cookies|consent|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|comment|comments|commentlist|reply|replies|respond|disqus|discussion|widget|toolbar|pagination|pager|complementary|contentinfo)(?:$|[\s_-])")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
#: The rest of a tag, ``>`` in quotes being part of it; and without regard to quotes, for pages in which one isn't closed.
_REST, _PLAIN_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"), re.compile(r"([^>]*+)>")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Page:
    """Tokens of a page: tags by name with what marks them as an aside, and stretches of text. In time linear in the page,
    whatever is left open: a tag without ``>`` ends the page, and after a quote that nothing closes tags end at the next ``>``."""

    def __init__(self, source: str):
        self.kinds: list[str] = []
        self.texts: list[str] = []
        at, n, rest = 0, len(source), _REST
        while at < n:
            m = _TOKEN.search(source, at)
            end = m.start() if m else n
            if end > at:
                self._add("#", source[at:end])
            if not m:
                break
            at = m.end()
            if not m[2]:
                if m[0].startswith("<![CDATA["):
                    self._add("#", m[0][9:].removesuffix("]]>"))
                continue
            r = rest.match(source, at)
            if not r and rest is _REST:  # looked for up to the end of the page, once
                rest = _PLAIN_REST
                r = rest.match(source, at)
            if not r:
                break  # the page ends within a tag
            at, name, attributes = r.end(), m[2].lower(), r[1]
            if m[1]:
                self._add("/" + name, "")
                continue
            marks = " ".join(filter(None, (next(filter(None, x), "") for x in _NAMES.findall(attributes)))).lower() if "=" in attributes else ""
            self._add(name + (" !" if marks and ASIDE.search(marks) else " @main" if "main" in marks.split() else ""), "")
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(source, at)
                at = close.end() if close else n  # what isn't closed hides the rest, as in browsers
                self._add("/" + name, "")

    def _add(self, kind: str, text: str) -> None:
        if kind == "#":
            if not text.strip():
                if self.texts and self.kinds[-1] == "#":
                    self.texts[-1] += " "
                elif text:
                    self.kinds.append("_")
                    self.texts.append(" ")
                return
            if self.kinds and self.kinds[-1] == "#":
                self.texts[-1] += text
                return
        self.kinds.append(kind)
        self.texts.append(text)


class Elements:
    """The element around each token (of a tag, around the tag), -1 for none, and what the elements around and a tag's own
    element are together: ``never`` shown, an ``aside`` (a menu, header, footer, form, advert or the like; a header within an
    article is its own), in a ``link``, in what is marked as the ``main`` text."""

    def __init__(self, kinds: list[str]):
        n = len(kinds)
        self.parent = [-1] * n
        self.never, self.aside, self.link, self.main = ([False] * (n + 1) for _ in range(4))  # the last is for none
        inside = [False] * (n + 1)
        stack: list[int] = []
        names: list[str] = []
        opened: Counter[str] = Counter()

        def close(at: int) -> None:
            opened.subtract(names[at:])
            del stack[at:], names[at:]

        for i, k in enumerate(kinds):
            closing, name = k[0] == "/", k.lstrip("/").split(" ")[0]
            if closing:
                if opened[name]:
                    close(next(at for at in range(len(names) - 1, -1, -1) if names[at] == name))
            elif k not in "#_":
                while names and name in CLOSED_BY.get(names[-1], ()):
                    close(len(names) - 1)
                if (name == "p" or name in BLOCKS) and opened["p"]:  # an open paragraph ends, with what is open inside it
                    at = next(at for at in range(len(names) - 1, -1, -1) if names[at] in ("p", "table", "td", "button"))
                    if names[at] == "p":
                        close(at)
            p = self.parent[i] = stack[-1] if stack else -1
            tag = not closing and k not in "#_"
            self.never[i] = self.never[p] or tag and name in NEVER_SHOWN
            self.aside[i] = self.aside[p] or tag and (name in NEVER or k.endswith(" !") or name == "header" and not inside[p])
            self.link[i] = self.link[p] or tag and name == "a"
            self.main[i] = self.main[p] or tag and not k.endswith("!") and (name in ("article", "main") or k.endswith("@main"))
            inside[i] = inside[p] or tag and name in ("article", "main")
            if tag and name not in VOID:
                stack.append(i)
                names.append(name)
                opened[name] += 1

    def within(self, elements: set[int]) -> list[bool]:
        """Whether each token is inside one of the elements."""
        out = [False] * (len(self.parent) + 1)
        for i, p in enumerate(self.parent):
            out[i] = i in elements or out[p]
        return out


# A wrapper is a list of nodes: the kind of a tag (str), a text slot {pages, times, words, low, high}, ["?", nodes] for an
# optional and ["+", nodes] for a repeated group. low and high are the smallest and largest hash of the slot's texts.


def shape(node) -> str:
    """What two nodes must share to be the same: everything but what the slots have seen."""
    if isinstance(node, str):
        return node
    return "#" if isinstance(node, dict) else f"{node[0]}({','.join(map(shape, node[1]))})"


def joined(a, b, pages: bool):
    """Two nodes of one shape as one; their slots' pages are counted together or (within a page) once."""
    if isinstance(a, str):
        return a
    if isinstance(a, dict):
        return {"pages": a["pages"] + b["pages"] if pages else max(a["pages"], b["pages"]), "times": a["times"] + b["times"], "words": a["words"] + b["words"], "low": min(a["low"], b["low"]), "high": max(a["high"], b["high"])}
    return [a[0], [joined(x, y, pages) for x, y in zip(a[1], b[1])]]


def slot(text: str) -> dict:
    words = text.split()
    h = zlib.crc32(" ".join(words).encode("utf-8", "surrogatepass"))
    return {"pages": 1, "times": 1, "words": len(words), "low": h, "high": h}


def nodes_of(page: Page) -> list:
    return [slot(t) if k == "#" else k for k, t in zip(page.kinds, page.texts) if k != "_"]


def fold(nodes: list) -> list:
    """Replace runs of stretches of one shape by repeated groups, shortest unit first, until nothing repeats."""
    chars: dict[str, str] = {}

    def char(node) -> str:
        return chars.setdefault(shape(node), chr(0xE000 + len(chars)) if len(chars) < 6000 else chr(0x20000 + len(chars)))

    twice = re.compile(rf"(.{{1,{MAX_UNIT}}}?)\1+", re.S)
    while True:
        line, out, at = "".join(map(char, nodes)), [], 0
        for m in twice.finditer(line):
            (start, end), size = m.span(), len(m[1])
            unit = nodes[start : start + size]
            for i in range(start + size, end, size):
                unit = [joined(x, y, False) for x, y in zip(unit, nodes[i : i + size])]
            again = size == 1 and isinstance(unit[0], list) and unit[0][0] == "+"
            out += nodes[at:start] + (unit if again else [["+", unit]])
            at = end
        new = absorb(out + nodes[at:])
        if len(new) == len(nodes):
            return new
        nodes = new


def absorb(nodes: list) -> list:
    """A stretch beside a repeated group of its shape belongs to the group."""
    out: list = []
    for node in nodes:
        if isinstance(node, list) and node[0] == "+":
            size, want = len(node[1]), list(map(shape, node[1]))
            while len(out) >= size and list(map(shape, out[-size:])) == want:
                node = ["+", [joined(x, y, False) for x, y in zip(out[-size:], node[1])]]
                del out[-size:]
        out.append(node)
        for back in range(1, MAX_UNIT + 1):  # the stretch may also follow the group
            if back < len(out) and isinstance(out[-back - 1], list) and out[-back - 1][0] == "+" and len(out[-back - 1][1]) == back:
                group = out[-back - 1]
                if list(map(shape, group[1])) == list(map(shape, out[-back:])):
                    out[-back - 1 :] = [["+", [joined(x, y, False) for x, y in zip(group[1], out[-back:])]]]
                    break
    return out


def align(wrapper: list, page: list) -> list:
    """The wrapper widened so that it also fits the other, a folded page or wrapper: what only one of both has becomes
    optional, and a stretch that stands once in one and repeatedly in the other becomes repeated."""
    a, b = list(map(shape, wrapper)), list(map(shape, page))
    out: list = []

    def optional(part: list) -> list:
        if not part:
            return []
        return part if len(part) == 1 and isinstance(part[0], list) and part[0][0] == "?" else [["?", part]]

    def group(nodes: list, kinds: str):
        return nodes[0] if len(nodes) == 1 and isinstance(nodes[0], list) and nodes[0][0] in kinds else None

    def same(x: list, y: list) -> bool:
        return list(map(shape, x)) == list(map(shape, y))

    def both(x: list, y: list) -> list:
        return [joined(p, q, True) for p, q in zip(x, y)]

    for op, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        left, right = wrapper[i1:i2], page[j1:j2]
        if op == "equal":
            out += both(left, right)
            continue
        merged = None
        for x, y in ((left, right), (right, left)):
            g, h = group(x, "+?"), group(y, "+")
            if g is None or not y or merged is not None:
                continue
            inner = group(g[1], "+")
            if same(g[1], y):
                merged = [[g[0], both(g[1], y)]]
            elif h is not None and g[0] == "+":
                merged = [["+", align(g[1], h[1])]]
            elif h is not None and same(g[1], h[1]):
                merged = [["?", [["+", both(g[1], h[1])]]]]
            elif inner is not None and same(inner[1], y):
                merged = [["?", [["+", both(inner[1], y)]]]]
        out += optional(left) + optional(right) if merged is None else merged
    return out


def size_of(nodes: list) -> int:
    return sum(1 if not isinstance(x, list) else size_of(x[1]) for x in nodes)


def kinds_of(wrapper: list) -> list[list]:
    """The kinds of page that a host's wrapper tells apart, each an expression of its own; mostly one. Several stand in one node ``["|", kinds]``."""
    if wrapper and isinstance(wrapper[0], list) and wrapper[0][0] == "|":
        return list(wrapper[0][1])
    return [wrapper] if wrapper else []


def widened(wrapper: list, other: list) -> list:
    """The wrapper widened by a folded page or by another wrapper of its host. Kinds of page that are too large together to be
    aligned stay apart, so what either has learned is kept."""
    kinds = kinds_of(wrapper)
    for own in kinds_of(other):
        shapes = list(map(shape, own))
        like = next((i for i, k in enumerate(kinds) if list(map(shape, k)) == shapes), None)
        if like is not None:
            kinds[like] = [joined(x, y, True) for x, y in zip(kinds[like], own)]
            continue
        near = next((i for i, k in enumerate(kinds) if size_of(k) + size_of(own) <= 2 * MAX_NODES and len(k) * len(own) <= MAX_PAIRS), None)
        if near is None:
            kinds.append(own)
        else:
            kinds[near] = fold(align(kinds[near], own))
    return [["|", kinds]] if len(kinds) > 1 else kinds[0] if kinds else []


def infer(sources: list[str]) -> list:
    """A wrapper of pages of one host: the first page folded, then widened by each other page; a page that it fits only adds
    its texts to the slots."""
    learned = Learned()
    for s in sources:
        learned.add(Page(s))
    return learned.nodes


class Learned:
    """A host's wrapper while pages are added; what reads pages by it is made anew only when its nodes change."""

    def __init__(self):
        self.nodes: list = []
        self.readers: list[Wrapper] = []

    def add(self, page: Page) -> None:
        own = nodes_of(page)
        kinds = [x if isinstance(x, str) else "#" for x in own]
        for reader in self.readers:
            at = reader.read(kinds)
            if at is not None:
                held, seen = reader.flat, set()  # the wrapper's own slots
                for x, i in zip(own, at):
                    if isinstance(x, dict):
                        held[i].update(joined(held[i], x, i not in seen))
                        seen.add(i)
                return
        self.nodes = widened(self.nodes, fold(own))
        self.readers = [Wrapper(k) for k in kinds_of(self.nodes)]


def flat(nodes: list) -> Iterator:
    """Tags and slots in order; their places in it are the numbers by which pages are read."""
    for x in nodes:
        if isinstance(x, list):
            yield from flat(x[1])
        else:
            yield x


class Wrapper:
    """A union-free expression over token kinds that reads pages, and what its slots say about the host's article."""

    def __init__(self, nodes: list):
        self.flat = list(flat(nodes))
        self.kinds = ["#" if isinstance(x, dict) else x for x in self.flat]
        self.repeated: set[int] = set()
        self.parts, _ = self._numbered(nodes, 0, False)

    def _numbered(self, nodes: list, n: int, repeated: bool) -> tuple[list, int]:
        out = []
        for x in nodes:
            if isinstance(x, list):
                inner, m = self._numbered(x[1], n, repeated or x[0] == "+")
                out.append((x[0], inner))
                n = m
            else:
                if repeated:
                    self.repeated.add(n)
                out.append((self.kinds[n], n))
                n += 1
        return out, n

    def read(self, kinds: list[str]) -> list[int] | None:
        """The number of each token's node, None if the expression doesn't fit. Groups take what they can and don't give
        it back, so a page is read once."""
        found: list[int] = []
        end = self._read(self.parts, kinds, 0, found)
        return found if end == len(kinds) else None

    def _read(self, parts: list, kinds: list[str], at: int, found: list[int]) -> int:
        n = len(kinds)
        for kind, inner in parts:
            if isinstance(inner, int):
                if at >= n or kinds[at] != kind:
                    return -1
                found.append(inner)
                at += 1
                continue
            times = 0
            while True:
                had = len(found)
                end = self._read(inner, kinds, at, found)
                if end <= at:
                    del found[had:]
                    break
                at, times = end, times + 1
                if kind == "?":
                    break
            if kind == "+" and not times:
                return -1
        return at

    def aligned(self, kinds: list[str]) -> list[int | None]:
        """The number of the node that each token of a page that doesn't fit stands for, by the longest common stretches."""
        out: list[int | None] = [None] * len(kinds)
        if len(kinds) * len(self.kinds) <= MAX_PAIRS:
            for i, j, size in SequenceMatcher(None, self.kinds, kinds, autojunk=False).get_matching_blocks():
                out[j : j + size] = range(i, i + size)
        return out

    def article(self, roles: bool = True) -> tuple[int | None, set[int]]:
        """The number of the element that holds the host's article (None if there is no text at all), and the numbers of the
        slots inside it that don't belong to it.

        Each slot weighs the words it held on all pages, less if it is in a link, nothing if its text is always
        the same, and by the roles of the elements around it. From the root the element that holds most of its surroundings'
        weight is entered, while it is one of a page's containers and no repeated one. -1 is the whole page.
        """
        e = Elements(self.kinds)
        slots = [i for i, k in enumerate(self.kinds) if k == "#" and not e.never[i]]
        words = {i: self.flat[i]["words"] for i in slots}
        pages = max((self.flat[i]["pages"] for i in slots), default=0)
        one_text = {i for i in slots if FIXED_PAGES <= self.flat[i]["pages"] and pages <= 4 * self.flat[i]["pages"] and self.flat[i]["low"] == self.flat[i]["high"]}
        # where pages are copies of one another nothing is known about what is fixed
        if sum(words[i] for i in one_text) * 2 > sum(words.values()):
            one_text = set()
        weight = [0.0] * (len(self.kinds) + 1)
        for i in slots:
            w = float(words[i]) * (LINK_WEIGHT if e.link[i] else 1.0) * (0.0 if i in one_text else 1.0)
            if roles:
                w *= ASIDE_WEIGHT if e.aside[i] else MAIN_WEIGHT if e.main[i] else 1.0
            weight[i] = w + 1e-6 * words[i]
        for i in range(len(self.kinds) - 1, -1, -1):
            weight[e.parent[i]] += weight[i]
        best: dict[int, int] = {}  # the heaviest element in each
        for i, k in enumerate(self.kinds):
            p = e.parent[i]
            if k != "#" and k[0] != "/" and weight[i] > (weight[best[p]] if p in best else 0):
                best[p] = i
        region = -1
        while region in best:
            inner = best[region]
            enough = MAIN_SHARE if roles and e.main[inner] and not e.main[region] else INNER_SHARE
            if weight[inner] < enough * weight[region] or inner in self.repeated or self.kinds[inner].split(" ")[0] not in CONTAINERS:
                break
            region = inner
        inside = e.within({region}) if region >= 0 else [True] * len(self.kinds)
        drop = {i for i in one_text if inside[i] and words[i] <= FIXED_WORDS * self.flat[i]["times"] and not (roles and e.main[i])}
        return (region if slots else None), drop


class Extractor:
    """Reads pages of a host by its wrapper."""

    def __init__(self, nodes: list, roles: bool = True, alone: bool = False):
        self.roles, self.alone = roles, alone
        self.kinds = [(w, *w.article(roles)) for w in map(Wrapper, kinds_of(nodes) or [[]])]
        self.wrapper, self.region, self.drop = self.kinds[0]

    def __call__(self, source: str) -> str:
        """The article's text: the slots in the element that the wrapper found to hold the article, without those that it
        found fixed and (if roles count) those in a part marked as no article.

        A page that the wrapper doesn't fit is aligned with it. A page without such an element is a kind of page of its own,
        read by a wrapper of its own.
        """
        page = Page(source)
        at = [i for i, k in enumerate(page.kinds) if k != "_"]
        kinds = [page.kinds[i] for i in at]
        wrapper, region, drop, found = next(((*k, f) for k in self.kinds if (f := k[0].read(kinds)) is not None), (*self.kinds[0], None))
        if found is None:  # of several kinds of page the one that it has most in common with
            near = [(*k, k[0].aligned(kinds)) for k in self.kinds]
            wrapper, region, drop, found = max(near, key=lambda k: sum(n is not None for n in k[3]))
        number = dict(zip(at, found))
        regions = {i for i, n in number.items() if n == region and region is not None}
        if region != -1 and not regions:
            own = None if self.alone else Extractor(infer([source]), self.roles, True)
            return "" if own is None or own.region is None else own(source)
        e = Elements(page.kinds)
        inside = [True] * len(page.kinds) if region == -1 else e.within(regions)
        blocks, now = [], []

        def close() -> None:
            text = " ".join(html.unescape("".join(now)).split())
            now.clear()
            if text:
                blocks.append(text)

        for i, (k, text) in enumerate(zip(page.kinds, page.texts)):
            if k == "_":
                now.append(text)
            elif k == "#":
                if inside[i] and number[i] not in drop and not e.never[i] and not (self.roles and e.aside[i]):
                    now.append(text)
            else:
                name = k.lstrip("/").split(" ")[0]
                if name in BLOCKS:
                    close()
                elif name == "br":
                    now.append(" ")
        close()
        return "\n\n".join(blocks)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (JSON) for each host of ``pages`` (``url, html``), from all of its pages.

    Tasks learn a wrapper per host from the pages they read and send it on, so pages aren't shuffled and a host with most
    of the pages is learned everywhere. Wrappers of one host are widened by one another in two steps.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Learned] = {}

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(x.nodes) for x in held.values()], pa.string())], ["host", "wrapper"])
            held.clear()
            return out

        for b in batches:
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                if host not in held:
                    held[host] = Learned()
                held[host].add(Page(source))
            if len(held) > HELD_HOSTS:
                yield sent()
        if held:
            yield sent()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        nodes: list = []
        for w in sorted(table.column("wrapper").to_pylist()):
            nodes = widened(nodes, json.loads(w))
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(nodes)], pa.string())})

    p = pages.where("html is not null and html <> ''").select(host_of(F.col("url")).alias("host"), "html")
    parts = p.mapInArrow(read, "host string, wrapper string").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
    some = parts.groupBy("host", "part").applyInArrow(merge, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(merge, "host string, wrapper string")


def extract_main_text(pages: DataFrame, roles: bool = True) -> DataFrame:
    """Add ``text`` and ``n_chars`` to ``pages`` (``url, html``): the main text of each whole page.

    Same-host pages' token streams are aligned into a union-free expression of tags and text slots, in which mismatches
    become optional and runs become repeated groups (``infer_wrappers``). What the slots held on all the host's pages
    tells which element holds the article and which slots in it are fixed text of the template; ``roles`` (element names
    and class words such as nav, footer or ad) is one more sign. Each page is read by the expression of its host
    (``Extractor``). White space within a block, ``br`` included, becomes one space; blocks are joined by a blank line.

    Null or empty html gives an empty text, as does a page without such slots. Null URLs, and URLs without ``://``, make up
    one host named by the empty string. Repeated pages are read alike. Columns named like the results are replaced.
    """
    with small_batches(pages.sparkSession):
        wrappers = materialise(infer_wrappers(pages), "wrappers")
    p = pages.drop("text", "n_chars").withColumn("_host", host_of(F.col("url")))
    joined_ = p.join(wrappers.select(F.col("host").alias("_host"), "wrapper"), "_host", "left")

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made: dict[str, Extractor] = {}
        for sources, wrapped in batches:
            out = []
            for source, w in zip(sources, wrapped):
                if not source:
                    out.append("")
                    continue
                w = w or "[]"
                if w not in made:
                    if len(made) > 2000:
                        made.clear()
                    made[w] = Extractor(json.loads(w), roles)
                out.append(made[w](source))
            yield pd.Series(out, dtype="object")

    return joined_.withColumn("text", extract("html", "wrapper")).withColumn("n_chars", F.char_length("text").cast("long")).drop("_host", "wrapper")


def op10_wrapper_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")
