"""Main text of HTML pages by tree scoring.

A page is read by one tolerant scan into a tree of elements and a list of text blocks. Every paragraph outside boilerplate is worth points
for its length and commas, discounted by the share of its text in links, and passes them to its ancestors (all to the parent, half to the next, a
third to the one above, ...). The container with the most points, itself discounted by link density, is taken; names and tags that
announce an article raise its points by a factor only. A container in an article stands for the whole article. Of the siblings, containers that reach
a fifth of its points (other articles: half) and good paragraphs and headings are kept with it, and so is every block in them that isn't boilerplate,
in page order.

Boilerplate is named by tags, roles, and whole names in class and id: menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments. A name counts if all its words say so or speak of layout (`site-footer`, `comment-list`, not
`social-science`), and only on boxes and lists; paragraphs, list items and tables go for an advert's or notice's name alone. Lists that
are nearly all links are menus outside the chosen container, or where the whole page is chosen, and content inside.

Defined results: null or empty html gives the empty text; of containers with equal points the first in the page is taken; unclosed and stray tags are
tolerated, a comment or script that is never closed reaches to the end; character references are decoded once; white space (as Python has it) inside a
block becomes one space. Repeated rows are read row by row; an empty table gives an empty result; other columns, whatever their names, are not read.
A tag ends at the first `>` outside its quotes; if one of its quotes is never closed, at the first `>`. All work on a page is linear in its length.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, text_values

# fixed values: element names of the HTML standard by what they do here
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption col colgroup frameset head html legend optgroup option tbody td tfoot th thead tr".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form script style noscript template iframe object embed svg canvas button select textarea input dialog menu head title audio video map noembed noframes xmp".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends if it is open inside the nearest of the containers.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})}
#: Words of class or id that name boilerplate.
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation navigations menu menubar submenu breadcrumb breadcrumbs masthead header topbar footer foot bottombar sidebar sidebars aside rail ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promoted promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe subscription signup paywall share sharing shares social socials related recommended recommendations recirc comment comments commentlist disqus respond replies reply discussion toolbar pagination pager login signin copyright disclaimer skip skiplink hidden toc search outbrain taboola".split()
)
#: Words that speak of place, form or grouping and leave the other words of a name as they are.
LAYOUT_WORDS = frozenset("site page main global primary secondary left right top bottom upper lower side inner outer inline sticky fixed float box block bar list lists area wrap wrapper container section panel pane module region zone slot unit group row col column item items link links button buttons icon icons title body content text entry post posts article articles story stories thread form message messages info the js id user reader readers".split())
#: Names that also tell of a paragraph, list item or table that it doesn't belong to the text.
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsored promo promotion cookie cookies consent newsletter paywall".split())
PROTECTED = frozenset("html body article main".split())
TEXTUAL = frozenset("p pre blockquote li dt dd table caption thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6 figure figcaption b i em strong a span code".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
GOOD_WORDS = frozenset("article body content entry main post story text prose".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl menu table".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSING = {name: re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE) for name in RAW}
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def names_boilerplate(value: str, tag: str = "div") -> bool:
    """Does a class or id name boilerplate? Names such as has-sidebar or no-comments speak of the page, not of the element."""
    telling = ADVERT_WORDS if tag in TEXTUAL else BOILERPLATE_WORDS
    for name in value.split():
        words = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w and not w.isdigit()]
        if words and words[0] not in ("has", "with", "no", "without", "is") and not telling.isdisjoint(words) and all(w in BOILERPLATE_WORDS or w in LAYOUT_WORDS for w in words):
            return True
    return False


class Page:
    """Elements by number (parent, tag, boilerplate) and blocks (element, text, characters in links)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.drop, self.good = [-1], ["#root"], [False], [1.0]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)

    def _read(self, s: str) -> None:
        stack = [0]
        places: dict[str, list[int]] = {}  # of open elements by tag, and of open blocks: where they are in the stack
        blocks_open = [0]
        pieces: list[str] = []
        linked = links_open = 0
        n, at = len(s), 0
        last_quote = {q: s.rfind(q) for q in "\"'"}
        doomed: set[int] = set()  # opening quotes from which no tag ends, as one behind them is never closed

        def tag_end(pos: int) -> int:
            """Behind the `>` that ends a tag: not one in quotes, unless a quote of the tag is never closed; then the next one."""
            begin, opened = pos, []
            while (stop := _STOP.search(s, pos)) is not None:
                q, mark = stop.start(), stop[0]
                if mark == ">":
                    return q + 1
                if q in doomed or q == last_quote[mark]:
                    break
                opened.append(q)
                pos = s.find(mark, q + 1) + 1
            doomed.update(opened)
            q = s.find(">", begin)
            return n if q < 0 else q + 1

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                pieces.clear()
                if text:
                    self.blocks.append((owner(), text, min(linked, len(text))))
                linked = 0

        def owner() -> int:
            return stack[blocks_open[-1]]

        def pop() -> None:
            nonlocal links_open
            name = self.tag[stack.pop()]
            places[name].pop()
            if not places[name]:
                del places[name]
            if name in BLOCK:
                blocks_open.pop()
            if name == "a":
                links_open -= 1

        def end(names: set, containers: set) -> None:
            """Close down to the outermost open element of `names` above the nearest container."""
            wall = max((at[-1] for name, at in places.items() if name in containers and name not in names), default=0)
            above = [at[k] for name in names if (at := places.get(name)) and (k := bisect_right(at, wall)) < len(at)]
            lowest = min(above, default=None)
            if lowest is not None:
                flush()
                while len(stack) > lowest:
                    pop()

        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                text = s[at:lt]
                if not self.drop[stack[-1]]:
                    if "&" in text:
                        text = _html.unescape(text)
                    pieces.append(text)
                    if links_open:
                        linked += len(text.strip())
                at = lt
                if at >= n:
                    break
            if s.startswith("<!--", at):
                stop = s.find("-->", at + 2 if s.startswith("<!-->", at) else at + 4)
                if s.startswith("<!--->", at):
                    stop = at + 3
                at = n if stop < 0 else stop + 3
                continue
            m = _TAG.match(s, at)
            if not m:
                if s[at + 1 : at + 2] in ("!", "?", "/"):
                    stop = s.find(">", at)
                    at = n if stop < 0 else stop + 1
                else:
                    if not self.drop[stack[-1]]:
                        pieces.append("<")
                    at += 1
                continue
            name, closing = m[2].lower(), m[1] == "/"
            stop = tag_end(m.end())
            attributes, at = s[m.end() : stop - 1], stop
            if closing:
                if name in BLOCK:
                    flush()
                depth = places[name][-1] if name in places else 0
                if depth and (name in BLOCK or depth > blocks_open[-1]):
                    while len(stack) > depth:
                        pop()
                continue
            if name == "br" or name == "wbr":
                if name == "br":
                    pieces.append(" ")
                continue
            if name in BLOCK:
                flush()
                if name in CLOSES_P and "p" in places:
                    end({"p"}, BLOCK - {"p"})
                if name in ENDS and any(x in places for x in ENDS[name][0]):
                    end(*ENDS[name])
            elif name == "a" and "a" in places:
                end({"a"}, BLOCK)
            x = self._element(name, attributes, stack[-1])
            if name in VOID or (attributes.endswith("/") and name not in BLOCK):
                continue
            if name in RAW:
                close = _CLOSING[name].search(s, at)
                if not close:
                    break
                stop = s.find(">", close.start())
                at = n if stop < 0 else stop + 1
                continue
            places.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                blocks_open.append(len(stack))
            stack.append(x)
            if name == "a":
                links_open += 1
        flush()

    def _element(self, name: str, attributes: str, parent: int) -> int:
        drop, good = self.drop[parent] or name in BOILERPLATE_TAGS, 1.0
        if attributes and not drop:
            for m in _ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key in ("class", "id"):
                    if name not in PROTECTED and names_boilerplate(value, name):
                        drop = True
                    elif not GOOD_WORDS.isdisjoint(_SPLIT.split(value.lower())):
                        good = 1.5
                elif key == "role":
                    drop = drop or (name not in PROTECTED and value.lower() in BOILERPLATE_ROLES)
                    good = 1.5 if value.lower() in ("main", "article") else good
                elif key == "hidden":
                    drop = True
                elif key == "aria-hidden":
                    drop = drop or value.lower() == "true"
                elif _INVISIBLE.search(value):
                    drop = True
        self.parent.append(parent)
        self.tag.append(name)
        self.drop.append(drop)
        self.good.append(max(good, 1.5 if name in ("article", "main") else 1.0))
        return len(self.tag) - 1


def worth(text: str, linked: int) -> float:
    """Points of a paragraph: one, its commas, and its length, by the share outside links; of very short ones next to nothing."""
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text)) if len(text) >= 25 else 0.25


def good_paragraph(text: str, linked: int) -> bool:
    return linked < 0.25 * len(text) and (len(text) > 80 or text[-1] in ".!?:\u3002\u2026")


def main_blocks(source: str) -> list[str]:
    """Blocks of the main text, in page order."""
    page = Page(source)
    parent, tag, drop = page.parent, page.tag, page.drop
    blocks = [b for b in page.blocks if not drop[b[0]]]
    if not blocks:
        return []
    n = len(tag)
    chars, links, rows = [0] * n, [0] * n, [0] * n
    points = [0.0] * n
    for x, text, linked in blocks:
        chars[x] += len(text)
        links[x] += linked
        rows[x] += 1
        at, share = (parent[x] if tag[x] in PARAGRAPHS else x), 1
        mine = worth(text, linked)
        while at >= 0 and share <= 5:
            points[at] += mine / share
            at, share = parent[at], share + 1
    for x in range(n - 1, 0, -1):
        chars[parent[x]] += chars[x]
        links[parent[x]] += links[x]
        rows[parent[x]] += rows[x]
    value = [points[x] * page.good[x] * (1 - links[x] / chars[x]) if chars[x] and not drop[x] and tag[x] not in TEXTUAL else 0.0 for x in range(n)]
    best = max(range(n), key=lambda x: (value[x], -x))
    # an article, else the main element, stands for what lies in it
    around, at = {"article": None, "main": None}, best
    while at > 0:
        if tag[at] in around:
            around[tag[at]] = at
        at = parent[at]
    whole = next((x for x in around.values() if x is not None), None)
    best = best if whole is None else whole
    roots, loose = {best}, False
    if tag[best] not in ("body", "html", "#root"):
        beside = parent[best]
        peers = max(3.0, (0.5 if tag[best] == "article" else 0.2) * value[best])
        for x in range(1, n):
            if parent[x] == beside and x != best and chars[x] and tag[x] not in TEXTUAL and value[x] >= peers and (tag[best] != "article" or tag[x] == "article"):
                roots.add(x)
        loose = whole is None
    page_wide = tag[best] in ("body", "html", "#root")
    menu = [False] * n
    if page_wide:
        for x in range(1, n):
            menu[x] = menu[parent[x]] or ((tag[x] in LISTS or tag[x] in ("div", "section")) and rows[x] >= 3 and links[x] > 0.7 * chars[x])
    inside = [False] * n
    for x in range(n):
        inside[x] = (x in roots or (x > 0 and inside[parent[x]])) and not menu[x]
    beside = parent[best]

    def kept(x: int, text: str, linked: int) -> bool:
        if inside[x]:
            return True
        # paragraphs and headings beside the container
        return loose and (x == beside or parent[x] == beside and tag[x] in TEXTUAL) and (tag[x] in HEADINGS and linked < 0.25 * len(text) or good_paragraph(text, linked))

    found = [text for x, text, linked in blocks if kept(x, text, linked)]
    return found or [text for _, text, _ in blocks]


def main_text(source: str | None) -> str:
    return "\n".join(main_blocks(source)) if source else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id_col, url_col, text, n_chars. No shuffle; every page is parsed where it is read."""

    def fn(batch):
        texts = [main_text(h) for h in text_values(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind, url = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()
    return map_batches(pages, [id_col, url_col, html_col], fn, f"`{id_col}` {kind}, `{url_col}` {url}, text string, n_chars long")
