"""Main text of web pages by wrappers: union-free regular expressions, one for each host, inferred from its pages.

A page is read as a stream of tags and text slots, nested by its elements; inline markup is part of a slot. A wrapper is such
a stream in which nodes may be optional or repeated, and a repeated group may hold several kinds of nodes. Two wrappers are
aligned node by node. A mismatch is resolved by a search across: what stands in one stream only becomes optional; neighbours
that repeat become one repeated node or group; texts that differ become a slot, and texts that are the same on all pages stay
what they are, part of the template.

Inference merges within each task first, so that a host with a third of all pages leaves one wrapper a task, and then in
rounds of about FAN wrappers a group. A wrapper's size follows the markup, not the number of pages: child lists of over WIDEST
kinds become one repeated group, elements nested over DEEPEST levels count as part of their parent.

The main text is decided on the wrapper: parts that are navigation, advertising, forms, comments and so on by their element or
the words of their class, id and role go; an article (else a main part, else the part of a telling name, else the part that
holds most of the slots' text) is the region; outside a named region, texts of the template and lists of links go too. A page
is aligned to its host's wrapper and takes the best region that it has.

Rows: a null html is empty and gives an empty text; pages without a host share one wrapper. Repeated rows each get a row.
Extra columns are ignored; an empty table gives an empty result. Unclosed tags, comments and quotes end as in browsers.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnframe.llm.common import dropped, written
from turnframe.llm.shipping import hand_back

FAN, WIDEST, DEEPEST = 64, 60, 40
#: Hosts whose wrappers a task holds before it hands them on; bytes of wrappers that are broadcast.
HELD, BROADCAST = 2000, 32 << 20
#: Pages that must agree before a text counts as the template's.
AGREE = 3

TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S)
CUT_OFF = re.compile(r"</?[a-zA-Z!][^>]*\Z")
NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
#: Classes that tell of something else than what they stand on.
STATE = re.compile(r"(?:has|with|no|is)[-_]", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

INLINE = frozenset("a b i em strong span u s small big sub sup code kbd samp var cite q abbr acronym dfn mark time data font tt strike del ins bdi bdo ruby html body".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul menu".split())
#: tag: those that it ends, and those beyond which it doesn't look for them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr"}, {"table"})}
#: Elements that can hold a region.
PARTS = frozenset("div section table tbody tr td center main article form fieldset details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements, and words of a class, id or role, that are no main text.
OTHER = frozenset("head nav footer aside form noscript template svg math object canvas audio video select datalist button label legend dialog menu script style".split())
OTHER_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot banner promo promotion sponsor sponsored outbrain taboola
    cookie cookies consent gdpr notice notices notification alert alertdialog announcement popup modal overlay dialog
    newsletter subscribe subscription signup signin login sidebar sidenav complementary aside rail widget widgets
    nav navbar navigation menu menubar topbar toolbar breadcrumb breadcrumbs crumbs masthead footer colophon copyright contentinfo disclaimer
    comment comments commentlist discussion disqus reply replies respond responses feedback share sharing social related recommended
    recommendations search searchform pagination pager paging skip skiplink adsbygoogle adbox adunit adwrap ~unseen""".split()
)
HEADER_WORDS = frozenset(["header"])
REGION_WORDS = frozenset("article articlebody main content post entry story body text".split())


# --- pages as streams -----------------------------------------------------------------------------------------------
# A node is [label, optional, repeated, kids]; a text's label is "#", and in place of kids it has [digest of what it says or
# 0 for a slot, times, characters, characters in links] and, in a page, its words as a fifth.

_labels: dict[tuple[str, str], str] = {}


def label_of(tag: str, attributes: str) -> str:
    """The tag and the words of class, id, role and itemprop, without digits."""
    known = _labels.get((tag, attributes))
    if known is None:
        names = [n for _, *v in NAMES.findall(attributes) for n in "".join(v).split() if not STATE.match(n)]
        words = {w.lower() for n in names for w in WORD.findall(n)}
        if UNSEEN.search(attributes):
            words.add("~unseen")
        if len(_labels) > 50_000:
            _labels.clear()
        known = _labels[tag, attributes] = ".".join([tag, *sorted(words)])
    return known


def parsed(page: str) -> list:
    """The nodes of a page."""
    root: list = []
    stack, kids = [("", root)], root
    said: list[str] = []
    linked, link_at, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(said).split())
        if text:
            kids.append(["#", 0, 0, [zlib.crc32(text.encode("utf-8", "surrogatepass")) or 1, 1, len(text), min(linked, len(text))], text])
        said.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = entities.unescape(raw) if "&" in raw else raw
        said.append(text)
        if link_at:
            linked += len(text.strip())

    def close(upto: int) -> None:
        nonlocal kids, link_at
        flush()
        del stack[upto:]
        kids = stack[-1][1]
        if link_at > len(stack):
            link_at = 0

    def close_open(tags, beyond) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                return close(k)
            if stack[k][0] in beyond:
                return None

    while True:
        m = TAG.search(page, at)
        if not m:
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                link_at = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                say(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        label = label_of(tag, m[3])
        if tag == "body":
            close_open({"head"}, ())
        if tag in INLINE and (tag in ("html", "body") or OTHER_WORDS.isdisjoint(label.split(".")[1:])):
            if tag == "a":
                link_at = len(stack)
            continue
        if tag in ENDS_P:
            close_open({"p"}, {"td", "th", "table", "button", "li", "div"} if tag != "p" else {"td", "th", "table", "button"})
        elif tag in ENDS:
            close_open(*ENDS[tag])
        if len(stack) > DEEPEST:
            continue
        flush()
        node = [label, 0, 0, []]
        kids.append(node)
        kids = node[3]
        stack.append((tag, kids))
    rest = page[at:]
    if cut := CUT_OFF.search(rest):
        rest = rest[: cut.start()]
    if rest:
        say(rest)
    flush()
    return root


# --- wrappers -------------------------------------------------------------------------------------------------------
# A group has the label "*"; its kids are the kinds of nodes that repeat in it.


#: What two nodes are to each other: the same place of two pages, of two repeats in a page, or neighbours, which repeat.
PAGES, REPEATS, NEIGHBOURS = 0, 1, 2


def _both(a: list, b: list, within: int) -> list:
    """One node of two with the same label."""
    optional, repeated = a[1] & b[1] if within == NEIGHBOURS else a[1] | b[1], 1 if within == NEIGHBOURS else a[2] | b[2]
    if a[0] == "#":
        (x, *p), (y, *q) = a[3], b[3]
        says = (zlib.crc32(b"%d %d" % (x, y)) or 1 if x and y else 0) if within else x if x == y else 0
        return ["#", optional, repeated, [says, *[i + j for i, j in zip(p, q)]]]
    if a[0] == "*":
        kids = a[3]
        for k in b[3]:
            kids = _into(kids, k, within)
        return ["*", optional, 1, kids]
    return [a[0], optional, repeated, merged(a[3], b[3], min(within, REPEATS))]


def _into(members: list, node: list, within: int = NEIGHBOURS) -> list:
    """The members of a group with a further node."""
    for k, m in enumerate(members):
        if m[0] == node[0]:
            return [*members[:k], _both(m, node, within), *members[k + 1 :]]
    return [*members, node]


def _neighbours(nodes: list) -> list:
    """Neighbours of one kind, or beside a group that has their kind, as one node."""
    out: list = []
    for n in nodes:
        if out and out[-1][0] == n[0]:
            out[-1] = _both(out[-1], n, NEIGHBOURS)
        elif out and out[-1][0] == "*" and any(m[0] == n[0] for m in out[-1][3]):
            out[-1] = ["*", out[-1][1], 1, _into(out[-1][3], n)]
        elif out and n[0] == "*" and any(m[0] == out[-1][0] for m in n[3]):
            out[-1] = ["*", n[1], 1, _into(n[3], out[-1])]
        else:
            out.append(n)
    return out


def folded(nodes: list) -> list:
    """Repeats among neighbours, of one node or of several in a row, as one repeated node or group."""
    out = _neighbours(nodes)
    while True:
        labels, after = [n[0] for n in out], {}
        square = None
        for i in range(len(labels) - 1, -1, -1):
            j = after.get(labels[i])
            if j and j - i > 1 and labels[i:j] == labels[j : 2 * j - i]:
                square = (i, 2 * j - i)
            after[labels[i]] = i
        if not square and len(out) <= WIDEST:
            return out
        i, j = square or (0, len(out))
        members: list = []
        for n in out[i:j]:
            for k in n[3] if n[0] == "*" else [n]:
                members = _into(members, k)
        out = _neighbours([*out[:i], ["*", 0, 1, members], *out[j:]])


def merged(a: list, b: list, within: int = PAGES) -> list:
    """The wrapper of the streams of two wrappers."""
    places = []
    for nodes in (a, b):
        where: dict = {}
        for k, n in enumerate(nodes):
            where.setdefault(n[0], []).append(k)
        places.append(where)

    def ahead(side: int, label: str, at: int) -> int | None:
        return next((k for k in places[side].get(label, ()) if k > at), None)

    missing = lambda n: n if n[1] else [n[0], 1, *n[2:]]
    out: list = []
    i = j = 0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if x[0] == y[0]:
            out.append(_both(x, y, within))
            i, j = i + 1, j + 1
        elif "*" in (x[0], y[0]):  # a group takes what the other stream has of its kinds
            group, other, k = (x, b, j) if x[0] == "*" else (y, a, i)
            kinds, first = {m[0] for m in group[3]}, k
            while k < len(other) and other[k][0] in kinds:
                group = ["*", group[1], 1, _into(group[3], other[k], PAGES)]
                k += 1
            out.append(group if k > first else missing(group))
            i, j = (i + 1, k) if x[0] == "*" else (k, j + 1)
        else:
            over_b, over_a = ahead(1, x[0], j), ahead(0, y[0], i)
            if over_b is not None and (over_a is None or over_b - j <= over_a - i):
                out += map(missing, b[j:over_b])
                j = over_b
            elif over_a is not None:
                out += map(missing, a[i:over_a])
                i = over_a
            else:
                out += [missing(x), missing(y)]
                i, j = i + 1, j + 1
    out += map(missing, [*a[i:], *b[j:]])
    return folded(out)


def wrapper_of(nodes: list) -> list:
    """A page's own wrapper: its stream with repeats folded, without its words."""
    return folded([n[:4] if n[0] == "#" else [n[0], n[1], n[2], wrapper_of(n[3])] for n in nodes])


# --- what of a wrapper is main text ---------------------------------------------------------------------------------


class Verdict:
    """For the nodes of a wrapper, by id: gone, whether they are a header, and their rank as a region."""

    def __init__(self, wrapper: list):
        self.wrapper = wrapper
        self.gone: set[int] = set()
        self.headers: set[int] = set()
        self.rank: dict[int, int] = {}
        self.plain: set[int] = set()  # ranks of regions that no name tells
        self._amount: dict[int, float] = {}
        total = sum(map(self._weigh, wrapper))
        for n in wrapper:
            self._judge(n, total, False)
        left = sum(map(self._left, wrapper))
        self._regions(left)

    def _weigh(self, n: list) -> float:
        """Characters outside links."""
        w = n[3][2] - n[3][3] if n[0] == "#" else sum(map(self._weigh, n[3]))
        self._amount[id(n)] = w
        return w

    def _holds(self, n: list) -> bool:
        return n[0] not in ("#",) and any(k[0].split(".")[0] in ("article", "main") and OTHER_WORDS.isdisjoint(k[0].split(".")[1:]) or self._holds(k) for k in n[3])

    def _judge(self, n: list, total: float, inside: bool) -> None:
        if n[0] == "#":
            return
        tag, *words = n[0].split(".")
        named = not OTHER_WORDS.isdisjoint(words)
        if tag in OTHER or named and tag not in ("main", "body"):
            always = tag in ("nav", "head", "select", "button", "script", "style")
            if always or not self._holds(n) and (self._amount[id(n)] <= 0.8 * total or inside or tag in ("footer", "aside")):
                self.gone.add(id(n))
                return
        if tag == "header" or not HEADER_WORDS.isdisjoint(words) and tag not in ("article", "main"):
            if not self._holds(n):
                if inside:
                    self.headers.add(id(n))
                elif self._amount[id(n)] <= 0.8 * total or tag == "header":
                    self.gone.add(id(n))
                    return
        for k in n[3]:
            self._judge(k, total, inside or tag in ("article", "main") or tag in PARTS and not REGION_WORDS.isdisjoint(words))

    def _left(self, n: list) -> float:
        """Characters outside links that no rule has taken away."""
        w = 0.0 if id(n) in self.gone else n[3][2] - n[3][3] if n[0] == "#" else sum(map(self._left, n[3]))
        self._amount[id(n)] = w
        return w

    def _all(self, nodes: list, fits) -> Iterator[list]:
        """The outermost nodes that fit."""
        for n in nodes:
            if n[0] == "#" or id(n) in self.gone:
                continue
            if n[0] != "*" and fits(n[0].split(".")):
                yield n
            else:
                yield from self._all(n[3], fits)

    def _regions(self, left: float) -> None:
        amount = lambda n: -self._amount[id(n)]
        ranked = [n for n in sorted(self._all(self.wrapper, lambda x: x[0] == "article" or "articlebody" in x[1:]), key=amount)]
        if ranked and sum(self._amount[id(n)] for n in ranked) < 0.25 * left:
            ranked = []
        ranked += [n for n in sorted(self._all(self.wrapper, lambda x: x[0] == "main" or "main" in x[1:]), key=amount) if self._amount[id(n)] >= 0.25 * left]
        named, at = None, self.wrapper
        while at:  # the innermost part of a telling name that holds most of the text
            deeper = [n for n in self._all(at, lambda x: x[0] in PARTS and not REGION_WORDS.isdisjoint(x[1:])) if self._amount[id(n)] >= 0.6 * left]
            named, at = (deeper[0], deeper[0][3]) if deeper else (named, None)
        if named and id(named) not in map(id, ranked):
            ranked.append(named)
        for k, n in enumerate(ranked):
            self.rank[id(n)] = k
        dense, at = None, self.wrapper
        while at:
            deeper = [n for n in at if n[0].split(".")[0] in PARTS and id(n) not in self.gone and self._amount[id(n)] >= 0.7 * left and self._amount[id(n)]]
            dense, at = (deeper[0], deeper[0][3]) if deeper and not deeper[0][2] else (dense, None)
        if dense and id(dense) not in self.rank and not ranked:
            self.rank[id(dense)] = len(ranked)
            self.plain.add(len(ranked))
        self.plain.add(len(ranked) + 1)
        self.last = len(ranked) + 1

    def text(self, nodes: list) -> str:
        """The main text of a page."""
        blocks: list[tuple[int, str]] = []

        def walk(nodes: list, pattern: list, rank: int, header: bool, heading: bool) -> None:
            i = 0
            for n in nodes:
                found = None
                for k in (*range(i, len(pattern)), *range(i)):
                    w = pattern[k]
                    found = w if w[0] == n[0] else next((m for m in w[3] if m[0] == n[0]), None) if w[0] == "*" else None
                    if found is not None:
                        i = k if w[0] == "*" or w[2] else k + 1
                        break
                if n[0] == "#":
                    says, times, size, linked = found[3] if found is not None else (0, 0, 1, 0)
                    if header and not heading or rank in self.plain and (says and times >= AGREE or 2 * linked > size):
                        continue
                    blocks.append((rank, n[4]))
                    continue
                if found is not None and id(found) in self.gone:
                    continue
                own = min(rank, self.rank.get(id(found), rank)) if found is not None else rank
                walk(n[3], found[3] if found is not None else [], own, header or id(found) in self.headers, heading or n[0].split(".")[0] in HEADINGS)

        walk(nodes, self.wrapper, self.last, False, False)
        best = min((r for r, _ in blocks), default=0)
        return " ".join(t for r, t in blocks if r == best)


# --- Spark ----------------------------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def _dumped(wrapper: list) -> str:
    return json.dumps(wrapper, separators=(",", ":"))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, n) of pages (host, html), n being the host's pages."""
    kind = "host string, wrapper string, n long"

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        give = lambda: pa.RecordBatch.from_pylist([{"host": h, "wrapper": _dumped(w), "n": n} for h, (w, n) in held.items()], pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                own = wrapper_of(parsed(page or ""))
                w, n = held.get(host, (None, 0))
                held[host] = (own if w is None else merged(w, own), n + 1)
            if len(held) > HELD:
                yield give()
                held.clear()
        if held:
            yield give()
        hand_back()

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for w in sorted(part.wrapper):
            w = json.loads(w)
            whole = w if whole is None else merged(whole, w)
        return pd.DataFrame({"host": [part.host.iloc[0]], "wrapper": [_dumped(whole)], "n": [part.n.sum()]})

    found = written(pages.select("host", "html").mapInArrow(infer, kind), "wrappers")
    while True:
        several = written(found.groupBy("host").agg(F.count("*").alias("parts")).where("parts > 1"), "several")
        if several.isEmpty():
            return found
        parts = found.join(several, "host", "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.ceil(F.coalesce("parts", F.lit(1)) / FAN)))
        done = parts.where("parts is null").select("host", "wrapper", "n")
        whole = written(done.unionByName(parts.where("parts is not null").groupBy("host", "part").applyInPandas(joined, kind)), "wrappers")
        dropped(found)
        found = whole


def with_wrappers(pages: DataFrame, wrappers: DataFrame, most: int = BROADCAST) -> DataFrame:
    """pages with the wrapper of their host: those of the hosts with most pages, up to so many bytes, are broadcast; the pages of other hosts are shuffled to theirs."""
    sums = wrappers.agg(*[F.sum(F.when(F.col("n") >= 1 << k, F.octet_length("wrapper").cast("long"))).alias(f"k{k}") for k in range(62)]).first()
    least = next(1 << k for k in range(62) if (sums[k] or 0) <= most)
    large = wrappers.where(F.col("n") >= least).select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper"))
    marked = pages.join(F.broadcast(large), F.col("host") == F.col("_host"), "left")
    if least == 1:
        return marked.drop("_host").withColumnRenamed("_wrapper", "wrapper")
    rest = marked.where("_host is null").drop("_host", "_wrapper").join(wrappers.where(F.col("n") < least).select("host", "wrapper"), "host")
    return marked.where("_host is not null").drop("_host").withColumnRenamed("_wrapper", "wrapper").unionByName(rest)


def main_texts(pages: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    page_id = pages.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Verdict] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist()):
                verdict = known.get(wrapper)
                if verdict is None:
                    if len(known) > HELD:
                        known.clear()
                    verdict = known[wrapper] = Verdict(json.loads(wrapper))
                texts.append(verdict.text(parsed(page or "")))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])
        hand_back()

    return with_wrappers(rows, host_wrappers(rows), broadcast).select("page_id", "url", "html", "wrapper").mapInArrow(extract, f"page_id {page_id}, url string, text string, n_chars long")


def op13_wrappers(pages: DataFrame) -> DataFrame:
    return main_texts(pages)
