"""HTML main text by union-free wrappers inferred for each host.

A page's token stream becomes a tree. Its wrapper is a union-free regular expression:
elements with a quantifier (once, optional ``?``, repeated ``+`` or ``*``) and text
slots. Like siblings next to each other are folded into one repeated group; two
wrappers are aligned along their longest common child sequence, what only one has
becomes optional, and slots that meet keep counts of pages, characters, linked
characters and the least and largest hash of their text. Aligning is repeated over a
host's pages in each partition, then over sets of at most ``FAN`` partial wrappers,
until one is left, so no task holds a host's pages.

The host's wrapper decides. Template: text slots that are equal on all of three or more
pages. Article: an ``article`` or ``main`` element that varies, if the host has one;
else the element that stands once a page (no part of a repeated group, as comments and
teasers are, be there none, one or many on the page at hand) and whose paragraphs, or
repeated groups of text, hold most varying text that is no link; and its parents, as
long as they add only headings. Words of a class, role or id break ties: they tell
adverts, notices and forms, whose text varies too, from the article's own blocks, but an
element that holds the greater part of a host's varying text is kept whatever it is
called. An id that has other words too may be a heading's slug: inside the article its
block goes only if most of its text is linked or all of it is equal on all of three or
more pages, and headings aren't judged by their ids.

A wrapper's size is bounded: below ``DEEP`` levels all is one slot; a list of more than
``WIDE`` children is folded by tag, one repeated group each (and where there are more
tags, all in one); and a wrapper of more than ``MOST_NODES`` elements keeps half of its
levels, again and again until it is in bounds. Pages are read by the same rules.

Edge cases: null or empty html gives an empty text; a null or odd url is the host '';
pages nested to any depth are read without recursion; repeated rows are extracted alike;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radarlake.llm.common import attach, frugal, materialize, workers_can_import

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"
#: Rules go by broadcast up to so many characters in all, by a join beyond.
BROADCAST_CHARS = 4_000_000
#: Partial wrappers that meet at once.
FAN = 64
DEEP = 256
WIDE = 64
MOST_NODES = 4096
MOST_HOSTS = 4096
ALIKE_PAGES = 3

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPLIT = re.compile(r"[\s_\-:/]+|(?<=[a-z])(?=[A-Z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "thead": ("tbody",), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("table ul ol dl div section article main aside nav header footer body html td th select form".split())
DROPPED = frozenset("script style noscript template nav footer aside form button select textarea input iframe svg math canvas object audio video head title dialog menu map noembed noframes".split())
#: Words of a class, id or role by which a block is no main text.
NOISE = frozenset("ad ads adsense adv alert alerts announcement advert advertisement advertisements advertising adverts banner breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo cookie cookies copyright dialog discussion disclaimer disqus feedback footer form gdpr hidden legal links login menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popular popup print promo promoted promotion recommend recommended related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split())
#: Of a header in the article only the headings are kept; elsewhere it is none of the article.
HEADER = frozenset("header masthead".split())
HEADINGS = frozenset("h1 h2 h3".split())
SLUGGED = HEADINGS | frozenset("h4 h5 h6".split())
#: Words of an id that say nothing of its contents.
LAYOUT = frozenset("area bar block body bottom box button buttons column container content div field group holder icon icons inner item items left list main outer page panel post posts right row section site top wrap wrapper".split())
MAIN = frozenset("article articlebody body content entry main post story text".split())


class Node:
    __slots__ = ("key", "tag", "noise", "main", "kids", "named")

    def __init__(self, tag: str, rest: str = ""):
        self.tag, self.kids = tag, []
        #: Whether words alone say that it is no main text.
        self.named = False
        #: 1: no main text; 2: a header; 3: one of these by some words of an id, which may be a heading's slug.
        self.noise, self.main, self.key = 1 if tag in DROPPED else 2 * (tag == "header"), 2 * (tag in ("article", "main")), tag
        if rest and "=" in rest or "hidden" in rest:
            marks, slug, told = [], [], []
            for name, a, b, c in ATTR.findall(rest):
                name, value = name.lower(), a or b or c
                if name in ("hidden", "aria-hidden"):
                    if value.lower() == "true" or (name == "hidden" and value.lower() != "until-found"):
                        self.noise = 1
                    continue
                words = [w.lower().strip("0123456789") for w in SPLIT.split(value)]
                words = [w for w in words if w]
                marks += words
                slug += words if name == "id" else ()
                if name != "id" or not frozenset(words) - NOISE - HEADER - LAYOUT:
                    told += words if name != "id" or tag not in SLUGGED else ()
            found, told = frozenset(marks), frozenset(told)
            hard = self.noise == 1
            if tag not in ("html", "body", "article", "main"):
                weak = tag not in SLUGGED and not told >= frozenset(slug) and frozenset(slug) & (NOISE | HEADER)
                self.noise = 1 if self.noise == 1 or told & NOISE else 2 if self.noise or told & HEADER else 3 if weak else 0
                self.named = self.noise == 1 and not hard
            if found & MAIN and not self.main:
                self.main = 1
            if marks:
                self.key = tag + "." + ".".join(sorted(found))


def parse(page: str) -> Node:
    """A tree from a page, lenient as to tags that are not closed."""
    root = Node("#root")
    stack = [root]
    at, raw = 0, None
    low = None
    while True:
        if raw:
            low = low if low is not None else page.lower()
            close = low.find(f"</{raw}", at)
            close = len(page) if close < 0 else close
            if raw == "textarea" or raw == "title":
                stack[-1].kids.append(html.unescape(page[at:close]))
            stack.pop()
            end = page.find(">", close)
            at, raw = (len(page) if end < 0 else end + 1), None
        m = TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].kids.append(html.unescape(text) if "&" in text else text)
        if not m:
            return root
        at = m.end()
        if m["cdata"]:
            stack[-1].kids.append(m["cdata"])
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE and name in INLINE | {"p", "li"}:
                    break
            continue
        if name not in INLINE and name not in VOID:  # a block ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        if name in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[name]:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE and not (name in ("tr", "tbody", "tfoot", "thead") and stack[k].tag in ("td", "th")):
                    break
        rest = m["rest"] or m["rest2"] or ""
        node = Node(name, rest)
        stack[-1].kids.append(node)
        if name in VOID or rest.endswith("/") and name not in RAW:
            continue
        stack.append(node)
        if name in RAW:
            raw = name


# --- wrappers: [key, quantifier, noise, main, slot, children, by tag]; slot: [pages, characters, linked, least, largest]
# noise is that of a Node, and 4 where words alone say 1; by tag: whether children are keyed by tag (1) or not at all (2)


def _slot(text: str, linked: bool) -> list:
    import xxhash

    h = xxhash.xxh32_intdigest(text)
    return [1, len(text), len(text) if linked else 0, h, h]


def _joint(a: list | None, b: list | None, pages: bool) -> list | None:
    if not a or not b:
        return a or b
    return [a[0] + b[0] if pages else max(a[0], b[0]), a[1] + b[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4])]


def wrapper(tree: Node) -> list:
    """The wrapper of one page's element."""
    top = ["", "1", 0, 0, None, [], 0]
    todo = [(tree, False, top, 0)]
    while todo:
        node, linked, above, depth = todo.pop()
        linked = linked or node.tag == "a"
        text = " ".join(" ".join(k for k in node.kids if isinstance(k, str)).split())
        slot = _slot(text, linked) if text else None
        if depth > DEEP:
            above[4] = _joint(above[4], slot, False)
            x = above
        else:
            x = [node.key, "1", 4 if node.named else node.noise, node.main, slot, [], 0]
            above[5].append(x)
        todo += [(k, linked, x, depth + 1) for k in reversed(node.kids) if not isinstance(k, str) and k.tag not in VOID]
    return _bounded(_united([top[5][0]], False))


def _quantifier(a: str, b: str) -> str:
    many, none = {a, b} & {"+", "*"}, {a, b} & {"?", "*"}
    return "*" if many and none else "+" if many else "?" if none else "1"


def _folded(kids: list) -> list:
    """Groups [key, quantifier, members]: like neighbours are one repeated group."""
    out: list = []
    for k in kids:
        if out and out[-1][0] == k[0]:
            out[-1][2].append(k)
            out[-1][1] = "*" if {out[-1][1], k[1]} & {"?", "*"} and {out[-1][1], k[1]} <= {"?", "*"} else "+"
        else:
            out.append([k[0], k[1], [k]])
    return out


def _meet(a: list, b: list) -> list:
    """Two lists of groups along their longest common sequence of keys; what one lacks is optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [[x[0], _quantifier(x[1], y[1]), x[2] + y[2]] for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0

    def put(key: str, q: str, members: list) -> None:
        """Like neighbours that arise here are one repeated group."""
        if out and out[-1][0] == key:
            out[-1] = [key, "*" if {out[-1][1], q} & {"?", "*"} else "+", out[-1][2] + members]
        else:
            out.append([key, q, members])

    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            put(a[i][0], _quantifier(a[i][1], b[j][1]), a[i][2] + b[j][2])
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            put(a[i][0], _quantifier(a[i][1], "?"), a[i][2])
            i += 1
        else:
            put(b[j][0], _quantifier(b[j][1], "?"), b[j][2])
            j += 1
    return out


def _by_tag(groups: list, level: int) -> list:
    """One repeated group a tag, or one in all."""
    out: dict[str, list] = {}
    for key, q, members in groups:
        at = out.setdefault(key.split(".")[0] if level == 1 else "*", [None, "1", []])
        at[0], at[1] = ("*" if level == 2 else key.split(".")[0]), "*" if at[2] else q
        at[2] += members
    return list(out.values())


def _united(members: list, pages: bool) -> list:
    """The least wrapper that holds all members; pages: they come from different pages."""
    top = ["", "1", 0, 0, None, [], 0]
    todo = [(members[0][0], members[0][1], members, top)]
    while todo:
        key, q, members, above = todo.pop()
        x = list(members[0])
        x[0], x[1], x[6] = key, q, max(m[6] for m in members)
        for m in members[1:]:
            x[2], x[4] = min(x[2], m[2]), _joint(x[4], m[4], pages)
        kids = _folded(members[0][5])
        for m in members[1:]:
            kids = _meet(kids, _folded(m[5]))
        for level in (1, 2):
            if x[6] >= level or len(kids) > WIDE:
                x[6] = max(x[6], level)
                kids = _by_tag(kids, level)
        x[5] = []
        above[5].append(x)
        # children are taken from the end, so they come back in order
        todo += [(k, p, m, x) for k, p, m in reversed(kids)]
    return top[5][0]


def align(a: list, b: list) -> list:
    """The least wrapper that holds both pages' wrappers."""
    return _bounded(_united([a, b], True))


def _flat(w: list) -> list:
    """(depth, element) of a wrapper, parents first."""
    out, todo = [], [(0, w)]
    while todo:
        depth, x = todo.pop()
        out.append((depth, x))
        todo += [(depth + 1, k) for k in reversed(x[5])]
    return out


def _bounded(w: list) -> list:
    deep = DEEP
    while len(flat := _flat(w)) > MOST_NODES and deep > 1:
        deep = min(deep, max(d for d, _ in flat)) // 2
        above: list = []
        for d, x in flat:
            del above[d:]
            if d > deep:
                above[deep][4] = _joint(above[deep][4], x[4], False)
                above.append(x)
            else:
                above.append(x)
        for d, x in flat:
            if d == deep:
                x[5] = []
    return w


def dumps(w: list) -> str:
    return json.dumps([[d, *x[:5], x[6]] for d, x in _flat(w)], separators=(",", ":"))


def loads(raw: str) -> list:
    above: list = []
    for d, *x in json.loads(raw):
        node = [*x[:5], [], x[5]]
        del above[d:]
        if above:
            above[-1][5].append(node)
        above.append(node)
    return above[0]


def expression(w: list) -> str:
    """The wrapper as a union-free regular expression."""
    out, todo = [], [w]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        out.append(f"<{x[0]}>(" + ("#text" if x[4] else ""))
        todo.append(")" + ("" if x[1] == "1" else x[1]))
        for n, k in enumerate(reversed(x[5])):
            todo += [k, " "] if x[4] or n < len(x[5]) - 1 else [k]
    return "".join(out)


def _id(above: int, key: str) -> int:
    """A path's number: a hash of its parent's and the element's key."""
    import xxhash

    return xxhash.xxh64_intdigest(key, above) >> 1


PARAGRAPHS = frozenset("p blockquote pre ul ol dl table h1 h2 h3 h4 h5 h6".split())


def rules(w: list) -> dict:
    """From a host's wrapper: paths of the article, of template text, of kept elements, and of lists by tag."""
    flat = _flat(w)
    n = len(flat)
    parent, path, inside, again = [-1] * n, [0] * n, [False] * n, [False] * n
    above: list[int] = []
    for k, (d, x) in enumerate(flat):
        del above[d:]
        if above:
            parent[k] = above[-1]
        p = parent[k]
        path[k] = _id(path[p] if p >= 0 else 0, x[0])
        inside[k] = x[3] == 2 or (p >= 0 and inside[p])
        again[k] = x[1] in "+*" or (p >= 0 and again[p])
        above.append(k)

    def constant(slot) -> bool:
        return slot[0] >= ALIKE_PAGES and slot[3] == slot[4]

    fixed = [not x[4] or constant(x[4]) for _, x in flat]
    for k in range(n - 1, 0, -1):
        fixed[parent[k]] = fixed[parent[k]] and fixed[k]
    # varying text that is no link, with and without what words alone call noise
    tag = [x[0].split(".")[0] for _, x in flat]
    own = [0 if not x[4] or (constant(x[4]) and tag[k] not in INLINE and not inside[k]) else x[4][1] - x[4][2] for k, (_, x) in enumerate(flat)]
    every = list(own)
    for k in range(n - 1, 0, -1):
        d, x = flat[k]
        if x[2] == 1 or (x[2] == 2 and not inside[k]) or (x[2] == 3 and fixed[k]):
            every[k] = 0
        every[parent[k]] += every[k]
    kept = {k for k in range(1, n) if flat[k][1][2] == 4 and not again[k] and every[k] * 2 > every[0] > 0}
    off = [False] * n
    for k in range(n):
        x = flat[k][1]
        bad = x[2] == 1 or (x[2] == 4 and k not in kept) or (x[2] in (2, 3) and not inside[k] and k not in kept) or (x[2] == 3 and fixed[k])
        off[k] = bad or (parent[k] >= 0 and off[parent[k]])
    total = [0 if off[k] else own[k] for k in range(n)]
    for k in range(n - 1, 0, -1):
        total[parent[k]] += total[k]
    whole = total[0] if n else 0

    template = [fixed[k] and (flat[k][1][2] == 3 or (not inside[k] and tag[k] not in INLINE and tag[k] not in SLUGGED)) for k in range(n)]
    same = {path[k] for k in range(n) if template[k]} - {path[k] for k in range(n) if not template[k]}
    marked = [k for k in range(n) if flat[k][1][3] == 2 and total[k] * 4 >= whole and total[k]]
    roots = marked
    if not roots and whole:
        direct, records, title = [0] * n, [0] * n, [False] * n
        for k in range(1, n):
            p, x = parent[k], flat[k][1]
            if tag[k] in PARAGRAPHS or (x[1] in "+*" and x[4] and not x[5]):
                direct[p] += total[k]
                title[p] = title[p] or (tag[k] in HEADINGS and total[k] > 0)
            elif x[1] in "+*":
                records[p] += total[k]
        # words break ties: a tenth more for an element named as the article
        rank = [(((2 * direct[k] + records[k]) * (3 if title[k] else 2) * (11 if flat[k][1][3] else 10)), -k) if not again[k] and not off[k] else (0, -k) for k in range(n)]
        k = -max(rank)[1]
        if rank[k][0]:
            while parent[k] > 0:  # a parent that adds only headings has the title
                p = parent[k]
                others = [j for j in range(n) if parent[j] == p and j != k and total[j]]
                if not others or total[p] != total[k] + sum(total[j] for j in others) or any(tag[j] not in HEADINGS for j in others):
                    break
                k = p
            roots = [k]
        else:  # text without blocks: the deepest element that has most of it
            k = 0
            while down := [j for j in range(n) if parent[j] == k and total[j] * 2 > total[k]]:
                k = down[0]
            roots = [k]
    return {"roots": sorted(path[k] for k in roots), "same": sorted(same) if whole else [], "kept": sorted(path[k] for k in kept), "tags": {str(path[k]): flat[k][1][6] for k in range(n) if flat[k][1][6]}, "deep": sorted(path[k] for k in range(n) if not flat[k][1][5])}


def main_text(page: str | None, rule: dict | None) -> str:
    """The article's blocks, each in single spaces, joined by one space."""
    if not page:
        return ""
    tree = parse(page)
    for given in (rule, None):
        if given is None:  # the host's article isn't here: the page's own wrapper tells
            given = rules(wrapper(tree))
            if rule:  # what the host's pages share is no article here either
                given = given | {"same": sorted({*given["same"], *rule["same"]})}
        elif not given["roots"]:
            continue
        text = " ".join("".join(_collect(tree, given)).split())
        if text:
            break
    return text


def _letters(node: Node) -> tuple[int, int]:
    """Characters that aren't spaces, and those of them in links."""
    n = linked = 0
    todo = [(node, False)]
    while todo:
        x, link = todo.pop()
        link = link or x.tag == "a"
        for k in x.kids:
            if isinstance(k, str):
                size = len("".join(k.split()))
                n, linked = n + size, linked + size * link
            else:
                todo.append((k, link))
    return n, linked


def _collect(tree: Node, rule: dict) -> list[str]:
    """The texts inside the article, with spaces around blocks."""
    roots, same, kept, tags = (frozenset(rule[k]) if k != "tags" else rule[k] for k in ("roots", "same", "kept", "tags"))
    ends, out = frozenset(rule["deep"]), []
    todo: list = [(tree, 0, 0, False, False, False)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        node, above, by_tag, inside, named, heads = x
        key = node.key if not by_tag else node.tag if by_tag == 1 else "*"
        # below what the wrapper keeps of its levels, all is one slot
        path = above if above in ends else _id(above, key)
        if path not in kept and (node.noise == 1 or (node.noise == 2 and not named) or (node.noise == 3 and not inside)):
            continue
        if path in same:
            continue
        if node.noise == 3:
            n, linked = _letters(node)
            if linked * 2 > n:
                continue
        inside = inside or path in roots
        named = named or (inside and node.main > 0)
        heads = (heads or node.noise == 2) and node.tag not in HEADINGS
        shown = inside and not heads
        gap = node.tag not in INLINE
        if gap:
            out.append(" ")
            todo.append(" ")
        deeper = tags.get(str(path), 0) if tags else 0
        for k in reversed(node.kids):
            if not isinstance(k, str):
                todo.append((k, path, deeper, inside, named, heads))
            elif shown:
                todo.append(k)
    return out


def infer(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(host, wrapper as JSON, n pages): one row a host."""
    workers_can_import(pages.sparkSession)
    src = pages.select(host(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([dumps(w) for w, _ in known.values()], pa.string()), pa.array([n for _, n in known.values()], pa.int64())], names=["host", "wrapper", "n"])

        for b in batches:
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = wrapper(parse(page))
                known[h] = [align(known[h][0], w), known[h][1] + 1] if h in known else [w, 1]
            if len(known) > MOST_HOSTS:
                yield out()
                known.clear()
        yield out()

    def merge(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table.column("wrapper").to_pylist(), table.column("n").to_pylist(), strict=True))
        w = loads(parts[0][0])
        for x, _ in parts[1:]:
            w = align(w, loads(x))
        return pa.table({"host": table.column("host").slice(0, 1), "wrapper": [dumps(w)], "n": [sum(n for _, n in parts)]})

    schema = "host string, wrapper string, n long"
    parts = materialize(src.mapInArrow(frugal(learn), schema))
    while True:
        most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 1
        deal = F.pmod(F.xxhash64("wrapper"), F.lit(-(-most // FAN))) if most > FAN else F.lit(0)
        met = parts.withColumn("deal", deal).groupBy("host", "deal").applyInArrow(merge, schema)
        if most <= FAN:
            return met
        parts = materialize(met)


def host(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), HOST, 1), F.lit("")))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(id, url, text, n_chars)"""
    spark = pages.sparkSession
    workers_can_import(spark)

    def to_rules(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([json.dumps(rules(loads(w))) for w in b.column(1).to_pylist()], pa.string()), b.column(2)], names=["host", "rules", "n"])

    known = materialize(infer(pages, html_col, url_col).mapInArrow(frugal(to_rules), "host string, rules string, n long"))
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(url_col).alias("host"))
    size = known.agg(F.sum(F.length("rules") + F.length("host") + 16)).first()[0] or 0
    both = src.join(F.broadcast(known.drop("n")), "host", "left") if size <= BROADCAST_CHARS else attach(src, known, "host", "n")
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict] = {}
        for b in batches:
            texts = []
            for page, rule in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if rule not in seen:
                    if len(seen) > MOST_HOSTS:
                        seen.clear()
                    seen[rule] = json.loads(rule) if rule else None
                texts.append(main_text(page, seen[rule]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    return both.select("id", "url", "html", "rules").mapInArrow(frugal(run), f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
