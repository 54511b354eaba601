"""Main text of web pages by tree scoring.

Each block of text passes points for its length and commas to its parent, half
to the grandparent and so on with shrinking weight; a container's points are
discounted by its link density.  From the best container the whole article (or
main) element around it is kept; without one, the ancestors below the body as
long as each adds text with few links.  Siblings that read like it are kept
too; list items that are only links are left out unless an article or main
element holds them.  Menus, headers, footers, forms, adverts, notices,
comments and the like are cut out of the tree before scoring; an unwanted class
or id word does not cut out the subtree with the page's article.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import parts
from .common import texts

# Elements by role, and the words of class, id and role names that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
DROPPED = frozenset("head script style textarea title noscript iframe noembed noframes template nav footer aside button select option svg canvas object video audio dialog menu input".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
UNWANTED = frozenset("ad ads adv advert adverts advertisement advertising banner promo promotion promoted sponsor sponsored sponsors nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside widget widgets related recommended recommendations share sharing social subscribe subscription newsletter signup login cookie cookies consent notice notices alert gdpr popup modal overlay comment comments reply replies respond disqus discussion pagination pager toolbar tags skip copyright".split())
#: Of these, the words that say what a part is for, however long it is.
OWN_PURPOSE = frozenset("ad ads adv advert adverts advertisement advertising cookie cookies consent gdpr popup modal overlay comment comments reply replies respond disqus discussion".split())
#: What follows one of these in a class or id word tells of the layout, not of the part itself.
QUALIFIERS = frozenset("with without has no not".split())
#: Words that leave an unwanted word's meaning as it is; any other beside it says that the name is about something else (a share price).
LAYOUT = frozenset("area article articles bar block bottom box btn button buttons col column container content fixed form global group icon icons inner item items left link links list main media news outer page panel post posts primary right row section secondary site slot story stories text title top trail unit wrap wrapper zone".split())
#: After one of these, "header" is the head of the article itself.
OF_ARTICLE = frozenset("article content entry post story".split())
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CONTAINERS = frozenset("article main section div td body blockquote html".split())
#: Siblings of the article that are kept whatever their length, below this share of link text.
TEXTUAL = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 hgroup ul ol dl figure table address details".split())
LINKED = 0.25

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_COMMA = re.compile(r"[,،、，]")
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


class Node:
    __slots__ = ("children", "dropped", "link_chars", "named", "parent", "points", "tag", "text_chars")

    def __init__(self, tag: str, parent, dropped: bool, named: frozenset[str] = frozenset()):
        self.tag, self.parent, self.dropped, self.named = tag, parent, dropped, named
        self.children: list = []
        self.points, self.text_chars, self.link_chars = 0.0, 0, 0


def _unwanted_words(name: str) -> set[str]:
    """The unwanted words of one class or id name; none where other words say that it is about something else."""
    parts = []
    for part in _NAME_PARTS.findall(name):
        if part.lower() in QUALIFIERS:
            break
        if not part.isdigit():
            parts.append(part.lower())
    found = {p for p in parts if p in UNWANTED}
    if found & OWN_PURPOSE:
        return found
    if any(p not in UNWANTED and p not in LAYOUT for p in parts) or found == {"header"} and OF_ARTICLE & set(parts):
        return set()
    return found


def _unwanted(attributes: str) -> tuple[bool, frozenset[str]]:
    """Whether role or visibility drops an element, and the unwanted words of its class and id."""
    named = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            for word in value.split():
                named |= _unwanted_words(word)
        elif name == "role" and value.lower().strip() in UNWANTED_ROLES:
            return True, frozenset()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
            return True, frozenset()
    return False, frozenset(named)


def _drop_named(nodes: list[Node]) -> None:
    """Drop the subtrees with unwanted names, but for those that hold the page's article.

    Such a one holds an article or main element while none stands outside the
    unwanted subtrees, or holds more than half of the page's text outside links
    and its name isn't that of a part with a purpose of its own.  A form is
    such a part too, unless it wraps the page: it stays only while no article stands outside.
    ``nodes`` is in page order.
    """
    plain, holds, linked, apart = {}, {}, {}, {}
    clean = False
    for node in nodes:
        up = node.parent
        linked[id(node)] = node.tag == "a" or up is not None and linked[id(up)]
        apart[id(node)] = bool(node.named) or up is not None and apart[id(up)]
        plain[id(node)] = 0 if node.dropped or linked[id(node)] else sum(len(c.strip()) for c in node.children if isinstance(c, str))
        holds[id(node)] = not node.dropped and node.tag in ("article", "main")
        clean = clean or holds[id(node)] and not apart[id(node)]
    for node in reversed(nodes):
        if node.parent is not None:
            plain[id(node.parent)] += plain[id(node)]
            holds[id(node.parent)] = holds[id(node.parent)] or holds[id(node)]
    whole = plain[id(nodes[0])]
    for node in nodes:
        if node.parent is not None and node.parent.dropped:
            node.dropped = True
        elif node.named and not (holds[id(node)] and not clean or 2 * plain[id(node)] > whole and not node.named & OWN_PURPOSE and not (clean and "form" in node.named)):
            node.dropped = True


class _Scanner:
    """Text, tags and the ends of raw elements of a page, each character looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self._spent = set()  # what no longer occurs in the rest of the page

    def find(self, what: str, at: int) -> int:
        if what in self._spent:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self._spent.add(what)
        return found

    def _tag_end(self, at: int) -> int:
        """Where the tag's > is: quoted values may hold one, but a quote that never closes is none."""
        while m := _QUOTE_OR_END.search(self.page, at):
            if m.group() == ">":
                return m.start()
            closing = self.find(m.group(), m.end())
            at = m.end() if closing < 0 else closing + 1
        return -1

    def pieces(self):
        """("text", text), ("end", tag, "") and ("tag", tag, attributes), in order."""
        page, at, begin = self.page, 0, 0
        while (at := page.find("<", at)) >= 0 and self.find(">", at) >= 0:
            special = page[at + 1 : at + 2]
            m = _TAG.match(page, at + 1)
            if not m and special not in ("!", "?"):
                at += 1
                continue
            if begin < at:
                yield "text", page[begin:at], ""
            if not m:
                if page.startswith("<!--", at):
                    end, size = self.find("-->", at + 4), 3
                elif page.startswith("<![CDATA[", at):
                    end, size = self.find("]]>", at), 3
                    yield "text", html.escape(page[at + 9 : end if end >= 0 else len(page)]), ""
                else:
                    end, size = page.find(">", at), 1
                at = begin = end + size if end >= 0 else len(page)
                continue
            end = self._tag_end(m.end())
            if end < 0:  # only quotes are left open: the tag ends at its first >
                end = page.find(">", m.end())
            at = begin = end + 1
            tag = m.group(2).lower()
            if m.group(1):
                yield "end", tag, ""
                continue
            yield "tag", tag, page[m.end() : end]
            if tag in RAW:
                at = begin = self._raw_end(tag, at)
        if begin < len(page):
            yield "text", page[begin:], ""

    def _raw_end(self, tag: str, at: int) -> int:
        """Behind the end tag of a raw element, or the end of the page."""
        if m := _RAW_ENDS[tag].search(self.page, at):
            end = self.page.find(">", m.end())
            return end + 1 if end >= 0 else len(self.page)
        return len(self.page)


_RAW_ENDS = {tag: re.compile(rf"</{tag}(?![a-z0-9])", re.I) for tag in RAW}


class _Open:
    """The open elements, and where the last one of each tag and the last block are."""

    def __init__(self, root: Node):
        self.nodes, self._at, self._blocks = [root], {root.tag: [0]}, [0]

    def last(self, *tags: str) -> int:
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=-1)

    def last_block(self) -> int:
        return self._blocks[-1]

    def push(self, node: Node) -> None:
        k = len(self.nodes)
        self.nodes.append(node)
        self._at.setdefault(node.tag, []).append(k)
        if node.tag in BLOCKS:
            self._blocks.append(k)

    def close(self, k: int) -> None:
        """Close the element at ``k`` and all in it; the root stays."""
        while len(self.nodes) > max(k, 1):
            node = self.nodes.pop()
            self._at[node.tag].pop()
            if node.tag in BLOCKS:
                self._blocks.pop()


def parse(page: str) -> list[Node]:
    """All elements in page order, the root first; tags that don't match are mended as browsers do."""
    root = Node("html", None, False)
    open_, nodes = _Open(root), [root]
    for kind, tag, attributes in _Scanner(page).pieces():
        if kind == "text":
            open_.nodes[-1].children.append(tag)
            continue
        if kind == "end":
            k = open_.last(tag)
            # An inline end tag closes nothing outside its container.
            if k > 0 and (tag in BLOCKS or k > open_.last("article", "main", "body", "td", "table")):
                open_.close(k)
            continue
        if tag == "html":
            continue
        if tag == "body":
            open_.close(1)
        if tag in BLOCKS and open_.nodes[open_.last_block()].tag == "p":  # a block ends an open paragraph
            open_.close(open_.last_block())
        if tag in _CLOSED_BY and (k := open_.last(*_CLOSED_BY[tag])) > open_.last(*_FENCES[tag]):
            open_.close(k)
        if tag in ("article", "main", "body", "p", "div", "section") and open_.nodes[-1].tag == "head":
            open_.close(len(open_.nodes) - 1)
        parent = open_.nodes[-1]
        drop, named = parent.dropped or tag in DROPPED, frozenset()
        if not drop and tag not in ("html", "body", "article", "main") and attributes:
            drop, named = _unwanted(attributes)
        if tag == "header" and open_.last("article", "main") < 0:  # inside them it is the article's own head
            drop = True
        elif tag == "form":
            named = named | {"form"}
        node = Node(tag, parent, drop, named)
        parent.children.append(node)
        nodes.append(node)
        if tag not in VOID and tag not in RAW and (not attributes.endswith("/") or tag in BLOCKS or tag in ("a", "b", "i", "em", "strong", "span")):
            open_.push(node)
    if any(n.named for n in nodes):
        _drop_named(nodes)
    return nodes


def blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(block element, its text, characters inside links) in page order, dropped parts left out."""
    out, pieces, linked = [], [], 0
    owners = [root]

    def flush():
        nonlocal linked
        joined = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        if joined:
            out.append((owners[-1], joined, min(linked, len(joined))))
        pieces.clear()
        linked = 0

    work = [(root, iter(root.children), 0)]
    while work:
        node, children, links = work[-1]
        child = next(children, None)
        if child is None:
            work.pop()
            if node.tag in BLOCKS:
                flush()
                if len(owners) > 1:
                    owners.pop()
            continue
        if isinstance(child, str):
            pieces.append(child)
            if links:
                linked += len(child.strip())
        elif child.dropped:
            if child.tag in BLOCKS:
                flush()
        elif child.tag == "br":
            pieces.append("\n")
        else:
            if child.tag in BLOCKS:
                flush()
                owners.append(child)
            work.append((child, iter(child.children), links + (child.tag == "a")))
    flush()
    return out


def _density(node: Node) -> float:
    return node.link_chars / node.text_chars if node.text_chars else 0.0


def _article(node: Node) -> Node | None:
    """The outermost article that holds ``node``, or else the innermost main element."""
    found = main = None
    while node is not None:
        if node.tag == "article":
            found = node
        elif node.tag == "main":
            main = main or node
        node = node.parent
    return found or main


def _widened(node: Node) -> Node:
    """The highest element below the body up to which every step adds text with few links."""
    while node.parent is not None and node.parent.tag not in ("body", "html"):
        up = node.parent
        if up.link_chars - node.link_chars > LINKED * (up.text_chars - node.text_chars):
            break
        node = up
    return node


def _score(nodes: list[Node], found: list[tuple[Node, str, int]]) -> None:
    """Text, link characters and points of every element, from the leaves up.

    A block's points go whole to the container that is its own element or the
    nearest above it; a container hands on half of what comes from below it,
    and four fifths of its own block's.
    """
    own: dict[int, float] = {}
    for node, text, linked in found:
        points = (1 + len(_COMMA.findall(text)) + min(len(text) / 100, 8)) * (1 - linked / len(text))
        own[id(node)] = own.get(id(node), 0.0) + points
        node.text_chars += len(text)
        node.link_chars += linked
    for node in reversed(nodes):
        mine = own.get(id(node), 0.0)
        below = node.points
        up = 0.5 * below + 0.8 * mine if node.tag in CONTAINERS else below + mine
        node.points = below + mine
        if node.parent is not None:
            node.parent.points += up
            node.parent.text_chars += node.text_chars
            node.parent.link_chars += node.link_chars


def extract(page: str) -> str:
    """The article's blocks of a page, one a line."""
    nodes = parse(page)
    found = blocks(nodes[0])
    if not found:
        return ""
    _score(nodes, found)
    value = lambda n: (n.points * (1 - _density(n))) * (1.5 if n.tag in ("article", "main") else 1.0)
    best = max((n for n in nodes if n.tag in CONTAINERS and n.points > 0), key=value, default=nodes[0])
    article = _article(best)
    top = article or _widened(best)
    inside = {id(top)}
    if top.parent is not None:  # siblings that read like the article
        least = 0.25 * value(best)
        for other in top.parent.children:
            if not isinstance(other, Node) or other is top or other.dropped or not other.text_chars:
                continue
            few_links = _density(other) < LINKED and (other.tag in TEXTUAL or article is None)
            if few_links or other.tag in CONTAINERS and value(other) >= least:
                inside.add(id(other))
    # The kept element that holds each element, from the top down.
    holder: dict[int, int] = {}
    for node in nodes:
        holder[id(node)] = id(node) if id(node) in inside else holder.get(id(node.parent), 0)
    kept = []
    for node, text, linked in found:
        where = holder[id(node)]
        # Links in a list ahead of all text are a menu, unless an article begins with them.
        if where and (kept or not (linked >= 0.9 * len(text) and node.tag == "li" and where != id(article))):
            kept.append(text)
    return "\n".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null or empty html gives an empty text; repeated rows, null ids and null
    urls stay as they are; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for part in parts(batch, "text"):
                found = [extract(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return texts(pages, "page_id", "url", text="html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
