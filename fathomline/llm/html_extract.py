"""Main-text extraction by tree scoring.

A page is read into a tree. Every paragraph passes points for its length and its commas to its
ancestors, whole to the parent and by halves further up; a container's points are discounted by
its link density. The best container is kept with those siblings that score or read like it, and
what stays of it is cut into blocks.

Rows are independent: one Arrow pass without a shuffle; memory is bounded by one slice of pages.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ddl_plus, sliced, with_columns, without

#: Element names of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
DROPPED = frozenset("script style noscript template iframe object embed svg canvas math head title nav aside footer form button input select option textarea label dialog menu audio video map".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p pre blockquote li dd td".split())
CLOSES_P = BLOCK - frozenset("caption body html legend tbody td tfoot th thead tr summary".split())
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Words in a class, id or role that name page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar side rail widget related recommended recommendations comment comments commentlist disqus respond reply replies menu nav navbar navigation breadcrumb breadcrumbs masthead topbar header footer foot share sharing social toolbar pagination pager skip complementary contentinfo search dialog".split()
)
#: Of these words, those that name readers' comments.
COMMENTS = frozenset(["comment", "comments", "commentlist", "reply", "replies"])
#: Of these words, those that may also name a part of an article when they stand in it.
MILD = frozenset(["header", "notice", "side", "search"])
#: Of these words, those with meanings outside of page furniture: alone, they don't condemn prose.
WEAK = frozenset("alert banner complementary dialog footer foot header menu modal notice notices overlay popup rail recommended related reply replies respond search share sharing side sidebar skip social toolbar widget".split())
#: Last words of compound names that only say that something is a box or a list (``share-buttons``).
SHELL = frozenset("area bar block body box button buttons card cards col column container content form group icon icons inner item items label link links list module outer panel post posts region row section slot space stories text title toggle tools unit wrap wrapper zone".split())
#: Elements that hold running text themselves.
PROSE = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 dd td figcaption".split())
#: Elements that keep a paragraph outside of them open.
BARRIERS = ("td", "th", "table", "div", "li", "article", "section", "body", "button", "caption")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z][\w:-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORD = re.compile(r"[a-z]+")
#: First words of a class that say what an element has or lacks, not what it is.
ABOUT = frozenset(["has", "no", "with", "without", "not", "hide", "show"])
#: Commas of the scripts that have their own.
COMMA = re.compile("[,،、，]")


class Node:
    __slots__ = ("tag", "parent", "children", "names", "plain", "loose", "label", "hidden", "score", "size", "links", "anchors", "fields", "holds", "inside", "after")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        #: Words of the names of furniture in class, id and role, and those of them that are a whole name.
        self.names: frozenset = frozenset()
        self.plain = False
        #: Whether every such name is a weak word before a noun of another kind (``share-price``).
        self.loose = True
        #: The class as it stands.
        self.label = ""
        self.hidden = False
        #: Whether an article or main element is around.
        self.inside = False
        #: Whether a paragraph stands before it in its parent.
        self.after = False
        self.anchors = self.fields = 0
        #: Whether an article or main element is below.
        self.holds = False
        self.score = 0.0
        self.size = self.links = 0
        if attributes and ("=" in attributes or "hidden" in attributes):
            for m in ATTRIBUTE.finditer(attributes):
                name = m[1].lower()
                if name == "class":
                    self.label = (m[2] or "").strip("\"'").lower()
                if name in ("class", "id", "role"):
                    for one in (m[2] or "").strip("\"'").lower().split():
                        words = WORD.findall(one)
                        if words and words[0] not in ABOUT and not FURNITURE.isdisjoint(words):
                            self.names |= FURNITURE.intersection(words)
                            self.plain = self.plain or len(words) == 1
                            self.loose = self.loose and len(words) > 1 and words[-1] not in FURNITURE | SHELL and FURNITURE.intersection(words) <= WEAK
                elif name == "hidden":
                    self.hidden = True


def parse(page: str) -> Node:
    """A tree of the page. Unclosed paragraphs, items and cells end where HTML ends them; stray end tags are skipped.

    The places of open elements are kept by tag, so each tag is read in one step, whatever is open.
    """
    root = Node("#root", None)
    open_nodes, places = [root], defaultdict(list)
    at, end = 0, len(page)

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def close(place: int) -> None:
        while len(open_nodes) > place:
            places[open_nodes.pop().tag].pop()

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            open_nodes[-1].children.append(page[at:])
            break
        if m.start() > at:
            open_nodes[-1].children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                open_nodes[-1].children.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            if last(tag):
                close(last(tag))
            continue
        if places["p"] and tag in CLOSES_P and last("p") > last(*BARRIERS):
            close(last("p"))
        if tag in CLOSED_BY_SAME:
            alike = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            if last(*alike) > last(*CLOSED_BY_SAME[tag]):
                close(last(*alike))
        node = open_nodes[-1]
        made = Node(tag, node, m[3])
        node.children.append(made)
        if tag in RAW:
            ended = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = ended.end() if ended else end
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            places[tag].append(len(open_nodes))
            open_nodes.append(made)
    return root


def _furniture(node: Node, inside: bool, most: float) -> bool:
    """Whether an element is page furniture; within an article, its own header is part of it.

    What holds the article, or more than ``most`` characters in a form or under a name of several words,
    is the page's content whatever it is called. A weak word condemns neither an article's paragraph nor
    what another noun follows (``share-price``), unless it is mostly links or holds a form.
    """
    if node.tag == "form" and not node.hidden and (node.holds or node.size > most):
        return False
    if node.hidden or node.tag in DROPPED:
        return True
    if node.tag in ("body", "html", "article", "main"):
        return bool(inside and node.plain and node.names & COMMENTS)
    if node.tag == "header":
        return not inside
    names = node.names - MILD if inside else node.names
    doubtful = node.loose or (inside and node.tag in PROSE and names <= WEAK)
    if names and doubtful and _density(node) < 0.3 and not node.fields:
        return False
    return bool(names) and not node.holds and (node.plain or node.size <= most)


def _measure(root: Node) -> None:
    """The size of the readable text and of links below each element, its form fields, and whether an article is below."""
    order = [root]
    for node in order:
        order += [c for c in node.children if not isinstance(c, str)]
    for node in reversed(order):
        if node.tag in RAW:
            node.parent.fields += node.tag == "textarea"
            continue
        node.size += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        up = node.parent
        if up is not None:
            up.size += node.size
            up.links += node.size if node.tag == "a" else node.links
            up.fields += node.fields + (node.tag in ("form", "input", "select", "button"))
            up.holds = up.holds or node.holds or node.tag in ("article", "main")


def _prune(root: Node) -> None:
    """Take furniture out of the tree, and measure text, link text and paragraph points below each element."""
    _measure(root)
    most = root.size / 2
    order: list[tuple[Node, bool]] = [(root, False)]
    for node, inside in order:  # grows while it is read: parents before children
        node.inside = inside
        within = inside or node.tag in ("article", "main")
        kept = []
        for c in node.children:
            if isinstance(c, str):
                kept.append(c)
            elif not _furniture(c, within, most):
                kept.append(c)
                order.append((c, within))
        node.children = kept
    for node, _ in reversed(order):
        node.size = node.links = 0
        after = False
        for c in node.children:
            if isinstance(c, str):
                n = len(c.strip())
                node.size += n
            else:
                node.size += c.size
                node.links += c.size if c.tag == "a" else c.links
                node.anchors += 1 if c.tag == "a" else c.anchors
                c.after = after
                after = after or (c.tag == "p" and c.size > 0 and _density(c) < 0.25)
    for node, _ in order:
        if node.tag in PARAGRAPH or (node.tag == "div" and any(isinstance(c, str) and c.strip() for c in node.children)):
            if not node.size:
                continue
            text = "".join(c if isinstance(c, str) else "" for c in node.children)
            points = (1 + len(COMMA.findall(text)) + min(node.size / 100, 3)) * (1 - node.links / node.size)
            share, up = 1.0, node.parent if node.tag != "div" else node
            while up is not None and share > 0.05:
                up.score += points * share
                share, up = share / 2, up.parent


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def _best(root: Node) -> list[Node]:
    """The container with the most points after the link discount, and the siblings that go with it."""
    best, top, stack = None, 0.0, [root]
    body = root
    while stack:
        node = stack.pop()
        if node.tag == "body":
            body = node
        value = node.score * (1 - _density(node))
        if node.tag not in ("p", "#root", "html") and value > top:
            best, top = node, value
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    if best is None:
        return [body]
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:  # the page itself says where the article is; it may have more than one
        alike = lambda c: c is up or (not isinstance(c, str) and c.tag == up.tag and c.score * (1 - _density(c)) >= up.score * (1 - _density(up)) / 2)
        return [c for c in up.parent.children if alike(c)]
    if best.tag in ("body",) or best.parent is None:
        return [best]
    kept = []
    for c in best.parent.children:
        if isinstance(c, str):
            continue
        if c.tag == best.tag and c.label == best.label and c.size and _density(c) < 0.25:  # a section like the best one, however short
            kept.append(c)
            continue
        reads = c.tag in ("p", "h1", "h2", "h3") and _density(c) < 0.25 and c.size > 0
        if c is best or reads or c.score * (1 - _density(c)) >= max(3.0, 0.2 * top):
            kept.append(c)
    return kept


def _menu(node: Node) -> bool:
    """A list or box that is little more than links; what an article or main element holds, or follows a paragraph beside it, is its own."""
    if node.inside or node.tag not in ("ul", "ol", "div", "section") or node.anchors < 2 or not node.size or _density(node) <= 0.6:
        return False
    return node.tag not in ("ul", "ol") or not node.after or node.parent.tag in ("body", "html", "#root")


def _blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif item.tag == "br":
            line.append(" ")
        elif item.links and _menu(item):
            flush()
        else:
            if item.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(item.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page; empty for null, empty and text-less pages."""
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    return "\n".join(_blocks(_best(root)))


def extract_text(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """``pages`` without the html, with the main text in ``into`` and its code points in n_chars.

    Null and empty pages have empty text, an empty table gives an empty one. Whole pages are read, however long. Repeated rows give
    repeated results. Columns named ``into`` or n_chars that ``pages`` already has are replaced.
    """
    kept = without(pages, [into, "n_chars"], [html_col])

    def run(batches):
        for batch, texts in sliced(batches, html_col):
            found = [main_text(t) for t in texts]
            rest = batch.select([n for n in batch.schema.names if n != html_col])
            yield with_columns(rest, **{into: pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64())})

    return kept.mapInArrow(run, ddl_plus(kept.drop(html_col), f"`{into}` string, n_chars long"))
