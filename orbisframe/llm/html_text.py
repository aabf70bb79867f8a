"""Main text of web pages by scoring the element tree.

A page is cut into tags and text by one pattern and built into a tree; end tags that HTML lets authors leave out are
implied. All steps are linear in the page's length, whatever its tags: places of open elements are kept by name, and once a quote
in a tag never ends, quotes no longer shield a ``>``. Menus, site headers and footers, sidebars, notices, adverts, forms, scripts, styles, hidden elements and reader
comments are set aside by element and by the words in their class, id and role; words alone do not set aside a wrapper, which
holds all ``article`` and ``main`` elements of the page or, where there are none, nine tenths of its text outside links. Each remaining paragraph passes points
(one, one a comma, and one for each 100 characters up to three) to its nearest ``LEVELS`` = 6 ancestors, in full to the parent, half to
the grandparent, and 1 / (2 n) to the n-th. Points are discounted by the share of text inside links. The container
with most points is the article, widened to the ``article`` or ``main`` element around it; siblings with a fifth of its points, or paragraphs
of prose beside it, are kept with it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
_UNQUOTED = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_MARKUP = re.compile(r"<[!?]")
LEVELS = 6
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements by their meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea title svg math object canvas select xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
DROPPED = frozenset("nav aside footer form button dialog menu head search fieldset input".split())
#: Elements whose start ends an open one of the second set, up to one of the third.
_LISTS = frozenset("ul ol menu dir".split())
_CLOSES_P = BLOCK - frozenset("html head body tr tbody thead tfoot caption legend li dd dt".split())
_IMPLIED = {
    "li": (frozenset(["li"]), _LISTS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_P_SCOPE = frozenset("table td th caption button html body article main section div".split())
#: Words in class, id or role that mark what is not the article, and what may be.
_UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|"
    r"site-?header|page-?header|comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|social|share|sharing|related|recommend\w*|widget|pagination|pager|login|signup|search|skip|complementary|contentinfo|dialog|alert|toolbar)(?:$|[\s_-])",
    re.I,
)
_LIKELY = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|story|entry|text|body)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCORED = frozenset("p pre td blockquote li dd h2 h3".split())


class Node:
    __slots__ = ("attrs", "inside", "kids", "parent", "tag", "wraps")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.wraps = False
        self.inside = bool(parent) and (parent.inside or parent.tag in ("article", "main"))

    def marks(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(self.attrs):
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        return found

    def dropped(self) -> bool:
        """Whether the element is set aside."""
        tag = self.tag
        if tag in DROPPED or tag in RAW:
            return tag != "form" or not any(isinstance(k, Node) and k.tag in ("article", "main") for k in self.kids)
        if tag == "header":
            return not self.inside
        if not self.attrs or tag in ("html", "body", "article", "main"):
            return False
        marks = self.marks()
        if "hidden" in marks or marks.get("aria-hidden") == "true" or _HIDDEN.search(marks.get("style", "")):
            return True
        names = " ".join(marks.get(k, "") for k in ("class", "id", "role"))
        return bool(_UNLIKELY.search(names)) and not self.wraps and not any(isinstance(k, Node) and k.tag in ("article", "main") for k in self.kids)


class _Tree:
    """Builds the tree; stack: the open elements, places: where in it those of each name are, in rising order."""

    def __init__(self):
        self.root = Node("html", "", None)
        self.stack, self.places = [self.root], {"html": [0]}

    def text(self, part: str) -> None:
        if part:
            self.stack[-1].kids.append(part)

    def _cut(self, place: int) -> None:
        """End the open elements from place on."""
        for n in self.stack[place:]:
            self.places[n.tag].pop()
        del self.stack[place:]

    def _last(self, names) -> int:
        """The place of the innermost open element of these names; -1 where there is none."""
        return max((p[-1] for p in map(self.places.get, names) if p), default=-1)

    def _implied(self, ends: frozenset, scope: frozenset) -> None:
        """End the outermost open element of ends that lies within the innermost of scope."""
        if not any(map(self.places.get, ends)):
            return
        inner, limit = self._last(ends), self._last(scope)
        if inner > limit:
            firsts = (p[bisect_right(p, limit)] for p in map(self.places.get, ends) if p and p[-1] > limit)
            self._cut(min(firsts))

    def open(self, name: str, attrs: str) -> None:
        if name in _CLOSES_P:
            self._implied(_P, _P_SCOPE)
        if name in _IMPLIED:
            self._implied(*_IMPLIED[name])
        made = Node(name, attrs, self.stack[-1])
        self.stack[-1].kids.append(made)
        if name not in VOID:
            self.places.setdefault(name, []).append(len(self.stack))
            self.stack.append(made)

    def close(self, name: str) -> None:
        place = self.places.get(name)
        if place and place[-1] == len(self.stack) - 1 > 0:
            self.stack.pop()
            place.pop()
        elif place and place[-1] > 0 and not (name in _INLINE and self._last(_WALLS) > place[-1]):
            self._cut(place[-1])


_P = frozenset(["p"])
#: Stray end tags of these don't reach out of those.
_INLINE = frozenset("p b i span a em strong li".split())
_WALLS = frozenset("article main table".split())


def parse(page: str) -> Node:
    """The tree of a page, scripts, styles and comments left out."""
    tree, at, end, token = _Tree(), 0, len(page), _TOKEN
    last = page.rfind(">") + 1  # no tag ends beyond
    while at < last:
        m = token.search(page, at, last)
        if not m:
            break
        tree.text(page[at : m.start()])
        at = m.end()
        if token is _TOKEN:
            name, closing, attrs = m[2] or m[5], m[1] or m[4], m[3] or m[6] or ""
            if m[5] and ('"' in attrs or "'" in attrs):
                token = _UNQUOTED
        else:
            name, closing, attrs = m[2], m[1], m[3] or ""
        if not name:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = end  # it never ends
            continue
        name = name.lower()
        if closing:
            tree.close(name)
        elif name in RAW:
            if not attrs.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                past = page.find(">", stop.end()) if stop else -1
                at = past + 1 if past >= 0 else end
        elif name != "html":
            tree.open(name, attrs)
    if at < end:
        rest = _MARKUP.search(page, max(at, last))
        tree.text(page[at : rest.start() if rest else end])
    return tree.root


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by newlines; empty where there is none."""
    if not page:
        return ""
    root = parse(page)
    _mark_wrappers(root)
    order, skipped = _walk(root)
    chars, links = _lengths(order)
    points: dict[int, float] = {}
    by_id = {id(n): n for n in order}
    for n in order:
        if n.tag in _SCORED or n.tag in ("div", "section", "article", "main", "body") and _own_text(n):
            text = _own_text(n) if n.tag not in _SCORED else _text(n, skipped)
            if len(text) < 2:
                continue
            value = 1 + text.count(",") + min(len(text) / 100, 3)
            up = n if n.tag not in _SCORED else n.parent
            for level in range(1, LEVELS + 1):
                if up is None:
                    break
                points[id(up)] = points.get(id(up), 0) + value / (level if level < 3 else 2 * level)
                up = up.parent
    best, most = None, 0.0
    final = {}
    for key, value in points.items():
        n = by_id[key]
        if n.tag in ("article", "main"):
            value += 25
        elif n.attrs and _LIKELY.search(" ".join(n.marks().get(k, "") for k in ("class", "id"))):
            value += 10
        value *= 1 - links[key] / max(1, chars[key])
        final[key] = value
        if value > most:
            best, most = n, value
    if best is None:
        best = root
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    kept = [best]
    if best.parent is not None and best.tag not in ("article", "main", "body", "html"):
        kept = []
        for k in best.parent.kids:
            if isinstance(k, Node) and id(k) in chars:
                dense = links[id(k)] / max(1, chars[id(k)])
                prose = k.tag == "p" and chars[id(k)] > 80 and dense < 0.25 or k.tag in _HEADINGS and dense < 0.25
                if k is best or final.get(id(k), 0) >= max(10, 0.2 * most) or prose:
                    kept.append(k)
    blocks: list[str] = []
    for n in kept:
        _blocks(n, skipped, blocks)
    return "\n".join(blocks)


def _mark_wrappers(root: Node) -> None:
    """Set wraps on the elements that hold all of the page's articles, or else nearly all of its text."""
    nodes, at = [root], 0
    while at < len(nodes):
        nodes += [k for k in nodes[at].kids if isinstance(k, Node)]
        at += 1
    articles = any(n.tag in ("article", "main") for n in nodes)
    held: dict[int, int] = {}
    for n in reversed(nodes):  # kids before their parents
        if articles:
            own = n.tag in ("article", "main")
        else:
            own = sum(len(k.strip()) for k in n.kids if isinstance(k, str)) if n.tag != "a" else 0
        held[id(n)] = held.get(id(n), 0) + own
        if n.parent is not None:
            held[id(n.parent)] = held.get(id(n.parent), 0) + held[id(n)]
    all_of = held[id(root)]
    for n in nodes:
        n.wraps = 0 < all_of and held[id(n)] >= (all_of if articles else 0.9 * all_of)


def _walk(root: Node) -> tuple[list[Node], set[int]]:
    """Elements in page order without those set aside, and the ids of the latter."""
    order, skipped, stack = [], set(), [root]
    while stack:
        n = stack.pop()
        if n.parent is not None and n.dropped():
            skipped.add(id(n))
            continue
        order.append(n)
        stack += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return order, skipped


def _lengths(order: list[Node]) -> tuple[dict[int, int], dict[int, int]]:
    """Characters of text, and of text in links, below each element."""
    chars, links = {id(n): sum(len(k.strip()) for k in n.kids if isinstance(k, str)) for n in order}, {}
    for n in reversed(order):
        links.setdefault(id(n), 0)
        if n.tag == "a":
            links[id(n)] = chars[id(n)]
        if n.parent is not None:
            chars[id(n.parent)] += chars[id(n)]
            links[id(n.parent)] = links.get(id(n.parent), 0) + links[id(n)]
    return chars, links


def _own_text(n: Node) -> str:
    return " ".join(k.strip() for k in n.kids if isinstance(k, str) and k.strip())


def _text(n: Node, skipped: set[int]) -> str:
    """Inline text below an element, not that of blocks in it."""
    out, stack = [], [n]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif k is n or id(k) not in skipped and k.tag not in BLOCK:
            stack += reversed(k.kids)
    return "".join(out).strip()


def _blocks(n: Node, skipped: set[int], blocks: list[str]) -> None:
    held: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            blocks.append(text)
        held.clear()

    stack: list = [n]
    while stack:
        k = stack.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            held.append(k)
        elif id(k) in skipped:
            continue
        elif k.tag in BLOCK:
            flush()
            stack += [None, *reversed(k.kids)]
        elif k.tag in ("br", "td", "th"):
            held.append(" ")
            stack += reversed(k.kids)
        else:
            stack += reversed(k.kids)
    flush()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages.

    Null and empty pages give an empty text, as do pages without any text outside what is set aside. Pages of any length are read
    whole, in time linear in it. Among containers with equal points the one whose first paragraph comes first is the article. Repeated
    rows and null ids each give a row, an empty table none; other columns are not read.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in small(batches):
            texts = [main_text(p) for p in b.column(2).to_pylist()]
            counts = pa.array([len(t) for t in texts], type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, type=pa.string()), counts], names=["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return narrow.mapInArrow(run, f"page_id {kind}, url {pages.schema[url_col].dataType.simpleString()}, text string, n_chars long")
