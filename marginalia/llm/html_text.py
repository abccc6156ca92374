"""Main text of web pages by composite text density.

For every node of the page's tree: characters, characters in links, tags and link tags below it give the link-adjusted characters per tag,

    density = C/T * log_b((C/LC) * (T/LT)),   b = ln(C * LC / (C - LC) + C_body * LC_body / C_body + e)

(C characters, LC link characters, T tags, LT link tags; zero counts as one). A node's density sum is that of its children, texts among them. The least density
on the path from the body to the node of the largest density sum is the threshold: the main content is the subtree of the largest density sum
among the nodes that reach it. Where that subtree is part of an ``article`` or ``main`` element, the innermost such element is the text, so that its heading and short last
lines stay, with the page's other elements of its name that reach the threshold. On other pages the subtree's neighbours belong to the text where they are headings, paragraphs, or boxes with sentences,
and most of their characters are outside links; of what stands farther out, only headings of the first level before it. Out of a ``main`` or a plain box come lists of links (most characters in
two links or more, density below the threshold); inside an ``article`` lists of links are its own and stay.

Elements that are never article text (scripts, menus, headers and footers of the page, hidden elements, and elements whose class, id or role says advert, sidebar, notice,
comment and the like) are left out before counting. Inside an article only a whole name says so, built of such words and words for boxes (newsletter, comment-list, share-buttons); a part of a name (share-price,
related-work, cookie-recipe) says nothing there, nor do names that may be the article's own (header, legal, discussion, widget ...). A name that only states something
(has-sidebar, comments-open) is none of these, and an element left out by its name, or a form, comes back if it holds most of the page's characters outside links. Labels go with their form; a button
in a paragraph outside forms is part of its sentence.

Blocks: text between block-level tags or line breaks, white space as one space, trimmed, empty ones dropped, joined by one line feed.

Time is linear in the page: a tag's end is found in one scan over its quotes, a quote that never closes is passed over (and remembered), and open elements are known by name, so no end tag is looked for.

Cases: null and empty pages, and pages without text, give an empty text. Unclosed and stray tags are repaired by the usual rules
(a block closes an open paragraph, an item an open item). A repeated page is extracted again. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LISTS = frozenset("article div section ul ol dl table center main".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("br body html td th tr tbody thead tfoot option".split())
NEVER = frozenset("head script style noscript template iframe object embed svg canvas audio video select textarea input nav footer aside menu dialog title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Boxes that hold text beside the main text
TEXT = HEADINGS | frozenset("p blockquote pre ul ol dl table figure".split())
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|banner|sponsor(?:ed|s)?|promo(?:tion|s)?|side-?bar|aside|nav(?:bar|igation)?|menu|bread-?crumbs?|header|masthead|footer|cookies?|consent|notices?|gdpr|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|comments?|comment-?list|replies|responses|respond|disqus|discussion|share|sharing|social|related|recommend(?:ed|ations)?|widget|pagination|pager|toolbar|skip-?link|copyright|legal)(?=$|[\s_-])", re.I)
#: Words for boxes: a name of these and of words that say noise is a whole name
BOX = frozenset("area bar block body bottom box btn button buttons card column container content form group icons inner item items left link links list module outer panel post posts right row section slot space stories story strip top unit wrap wrapper zone".split())
#: Words that state what a page has, and are no name of a part: has-sidebar, comments-open
STATE = re.compile(r"(?:^|(?<=\s))(?:(?:has|have|no|not|with|without|is|hide|show)[_-]\S+|\S+[_-](?:open|opened|closed|enabled|disabled|allowed|active|on|off))(?=$|\s)", re.I)
#: An element that is left out by its name comes back if it holds more than this share of the page's characters outside links
NAMED, PARTLY_NAMED = 0.9, 0.5
#: Names of parts of a page that may also be parts of an article: inside one they leave nothing out
OWN = re.compile(r"(?:^|(?<=[\s_-]))(?:header|masthead|banner|widget|overlay|toolbar|legal|copyright|discussion|respond|replies|alert|social|promo(?:tion)?|side-?bar-?body)(?=$|[\s_-])", re.I)
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
#: The head of the article itself
OWN_HEAD = re.compile(r"(?:article|post|entry|content|story)[-_]?(?:header|title|head)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: What an open element of these names is closed by
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
_OPENS = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_IN_TAG = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![^\s=/\"'>])([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_ENDS = frozenset(".!?…:;\"”»。！？")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|all rights\b)", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "skip", "share", "chars", "link_chars", "tags", "link_tags", "density", "total", "titled")

    def __init__(self, tag: str, parent, share: float | None):
        self.tag, self.parent, self.children, self.skip, self.share = tag, parent, [], share is not None, share or 0.0
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.titled = tag == "h1"


def _whole_noise(name: str) -> bool:
    """Whether a name says noise and nothing else."""
    rest, n = NOISE.subn(" ", name)
    return bool(n) and all(w.lower() in BOX for w in re.split(r"[\s_-]+", rest) if w)


def _noisy(tag: str, attributes: str, in_article: bool, in_form: bool, in_sentence: bool) -> float | None:
    """None for an element that stays, else the share of the page's characters above which it comes back (1 for never)."""
    if tag in NEVER or (tag == "header" and not in_article) or (tag == "label" and in_form) or (tag == "button" and (in_form or not in_sentence)):
        return 1.0
    if "hidden" in attributes.lower() and HIDDEN.search(_QUOTED.sub("", attributes)):
        return 1.0
    found = PARTLY_NAMED if tag == "form" else None
    if "=" in attributes and tag not in ("body", "html", "article", "main"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), values[0] or values[1] or values[2]
            if name in ("class", "id"):
                value = STATE.sub(" ", OWN_HEAD.sub(" ", value))
                value = OWN.sub(" ", value) if in_article else value
                if NOISE.search(value):
                    if any(_whole_noise(word) for word in value.split()):
                        found = NAMED
                    elif not in_article:
                        found = max(found or 0.0, PARTLY_NAMED)
            elif name == "role" and value.lower() in ROLES:
                found = NAMED if value.lower() != "form" else PARTLY_NAMED
            if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return 1.0
    return found


def _tag_end(page: str, at: int, failed: set[int]) -> int:
    """The place of the ``>`` that ends a tag's attributes, or -1. A quote after ``=`` runs to the next one of its kind; if one never closes, the tag ends at the first ``>``.
    ``failed``: opening quotes known to lead to one that never closes, so that no stretch is scanned again for them."""
    passed, look = [], at
    while m := _IN_TAG.search(page, look):
        i = m.start()
        if page[i] == ">":
            return i
        before = i - 1
        while before >= at and page[before].isspace():
            before -= 1
        look = i + 1
        if before >= at and page[before] == "=":
            passed.append(i)
            close = -1 if i in failed else page.find(page[i], i + 1)
            if close < 0:
                break
            look = close + 1
    failed.update(passed)
    return page.find(">", at)


class _Tree:
    """A tree under construction: the open elements, and where those of each name and the blocks stand among them."""

    def __init__(self):
        self.root = Node("html", None, None)
        self.open, self.where, self.blocks = [self.root], {}, []

    @property
    def node(self) -> Node:
        return self.open[-1]

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these names; 0 for none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def push(self, node: Node) -> None:
        self.where.setdefault(node.tag, []).append(len(self.open))
        if node.tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(node)

    def close(self, place: int) -> None:
        """Close the element of a place and all within it."""
        while len(self.open) > place:
            node = self.open.pop()
            self.where[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def text(self, text: str) -> None:
        if text:
            self.node.children.append(entities.unescape(text) if "&" in text else text)

    def end(self, tag: str) -> None:
        place = self.last(tag)
        if place and (tag in BLOCK or not self.blocks or self.blocks[-1] < place):
            self.close(place)
        elif tag in ("p", "br"):
            self.node.children.append(Node("br", self.node, None))

    def begin(self, tag: str, attributes: str) -> Node:
        if tag in CLOSES_P and self.blocks and self.open[self.blocks[-1]].tag == "p":  # a block ends an open paragraph and what is open in it
            self.close(self.blocks[-1])
        if tag in _SIBLING:
            place = self.last(*_SIBLING[tag])
            if place > self.last(*_SCOPE.get(tag, {"table"})):
                self.close(place)
        in_form, in_sentence = bool(self.last("form")), bool(self.last("p"))
        child = Node(tag, self.node, _noisy(tag, attributes, bool(self.last("article", "main")), in_form, in_sentence))
        self.node.children.append(child)
        return child


def parse(page: str) -> Node:
    """The page's tree, children being nodes and decoded texts."""
    tree, at, failed, last = _Tree(), 0, set(), page.rfind(">")
    text_from = 0
    while m := _OPENS.search(page, at):
        comment, data, declared, ends, tag = m.groups()
        if tag:
            close = _tag_end(page, m.end(), failed) if m.end() <= last else -1
            if close < 0:  # no tag ends any more
                at = m.end()
                continue
        else:
            mark = "-->" if comment else "]]>" if data else ">"
            close = page.find(mark, m.end())
        tree.text(page[text_from : m.start()])
        if not tag:
            upto = close if close >= 0 else len(page)
            if data:
                tree.text(page[m.end() : upto])
            at = text_from = upto + len(mark) if close >= 0 else len(page)
            continue
        attributes, tag = page[m.end() : close], tag.lower()
        at = text_from = close + 1
        if tag in ("html", "body"):
            continue
        if ends:
            tree.end(tag)
            continue
        child = tree.begin(tag, attributes)
        if tag in RAW:  # its content is not markup
            stop = re.compile(rf"</{tag}(?![\w-])", re.I).search(page, at)
            if child.share < 1:
                child.children.append(entities.unescape(page[at : stop.start() if stop else len(page)]))
            ended = page.find(">", stop.end()) if stop else -1
            at = text_from = ended + 1 if ended >= 0 else len(page)
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            tree.push(child)
    tree.text(page[text_from:])
    return tree.root


def _walk(root: Node) -> list[Node]:
    """Kept nodes, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.skip)
    return out


def _restore(root: Node) -> None:
    """Bring back elements that were left out by their name and hold the page's text; if nothing else has text, all that were left out by a part of a name."""
    nodes, named, stack = [], [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        if node.skip:
            named.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and c.share < 1)
    if not named:
        return
    plain: dict[int, int] = {}
    for node in reversed(nodes):
        own = sum(len(_SPACE.sub(" ", c).strip()) if isinstance(c, str) else plain.get(id(c), 0) for c in node.children)
        plain[id(node)] = own if node.tag != "a" else 0
    total = plain[id(root)]
    for node in named:
        node.skip = plain[id(node)] <= node.share * total
    if total and not any(isinstance(c, str) and c.strip() for node in _walk(root) for c in node.children):
        for node in named:
            node.skip = node.skip and node.share > PARTLY_NAMED


def _density(chars: int, link_chars: int, tags: int, link_tags: int, share: float) -> float:
    """Link-adjusted characters a tag. ``share``: characters in links of all characters of the body."""
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    ratio = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    return chars / max(1, tags) * math.log(max(1.0, ratio)) / math.log(max(base, 1.1))


def _count(nodes: list[Node]) -> None:
    """Characters, tags, densities and density sums of nodes (parents first)."""
    texts: dict[int, list[int]] = {}
    linked = set()
    for node in nodes:
        if node.tag == "a" or id(node.parent) in linked:
            linked.add(id(node))
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                n = len(_SPACE.sub(" ", c).strip())
                node.chars += n
                texts.setdefault(id(node), []).append(n)
            elif not c.skip:
                node.chars += c.chars
                node.link_chars += c.link_chars
                node.tags += c.tags + 1
                node.link_tags += c.link_tags + (c.tag == "a")
                node.titled |= c.titled
        if id(node) in linked:
            node.link_chars = node.chars
    body = nodes[0]
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(nodes):
        node.density = _density(node.chars, node.link_chars, node.tags, node.link_tags, share)
        own = sum(_density(n, n if id(node) in linked else 0, 1, 1, share) for n in texts.get(id(node), ()))
        node.total = own + sum(c.density for c in node.children if isinstance(c, Node) and not c.skip)


def densest(nodes: list[Node]) -> tuple[Node, float]:
    """The subtree of the largest density sum among those that reach the threshold, and the threshold."""
    best = max(nodes, key=lambda n: n.total)
    threshold, look = best.density, best
    while look is not None:
        threshold, look = min(threshold, look.density), look.parent
    return max((n for n in nodes if n.density >= threshold), key=lambda n: n.total, default=nodes[0]), threshold


def _beside(found: Node) -> list[Node]:
    """A box with the neighbours that belong to its text, in the page's order."""

    def holds(n: Node) -> bool:
        return not n.skip and n.chars > 0

    level = found
    while level.parent is not None and level.parent.tag != "html" and sum(1 for c in level.parent.children if isinstance(c, Node) and holds(c)) == 1 and not any(isinstance(c, str) and c.strip() for c in level.parent.children):
        level = level.parent  # a box around a box

    def belongs(n: Node) -> bool:
        if not holds(n) or 2 * n.link_chars > n.chars:
            return False
        words = " ".join(blocks(n))
        return n.tag in TEXT or (words[-1:] in _ENDS or any(m.tag in TEXT for m in _walk(n))) and not _RIGHTS.match(words)

    parts = [n for n in level.parent.children if isinstance(n, Node) and (n is level or belongs(n))] if level.parent is not None else [level]
    while level.parent is not None:
        level = level.parent
        if level.parent is not None:
            before = level.parent.children[: level.parent.children.index(level)]
            parts = [n for n in before if isinstance(n, Node) and n.tag == "h1" and holds(n) and 2 * n.link_chars <= n.chars] + parts
    return parts


def main_nodes(root: Node) -> list[Node]:
    """The nodes that hold the main text, in the page's order."""
    _restore(root)
    nodes = _walk(root)
    _count(nodes)
    found, threshold = densest(nodes)
    top = found
    while top is not None and top.tag not in ("article", "main"):
        top = top.parent
    if top is None:
        while found.parent is not None and found.tag not in ("div", "section", "td", "body"):
            found = found.parent  # a paragraph or an unclosed inline tag is part of a text, not the text
        parts = _beside(found)
    else:
        within = _inner(nodes, top.tag)
        parts = [n for n in nodes if n is top or n.tag == top.tag and id(n) not in within and n.chars and n.density >= threshold]
    for part in parts:
        if part.tag != "article":
            for node in _walk(part)[1:]:
                if node.tag in LISTS and _links(node, threshold):
                    node.skip = True
    return parts


def _inner(nodes: list[Node], tag: str) -> set[int]:
    """Nodes of a name inside others of it (nodes: parents first)."""
    inside: set[int] = set()
    for n in nodes:
        if n.parent is not None and (id(n.parent) in inside or n.parent.tag == tag):
            inside.add(id(n))
    return inside


def _links(node: Node, threshold: float) -> bool:
    """Whether a node is a list of links: two links or more, most of its characters in them, and less dense than the text."""
    return node.link_tags > 1 and 2 * node.link_chars > node.chars and node.density < threshold and not node.titled


def blocks(node: Node) -> list[str]:
    out, part, stack = [], [], [node]

    def end() -> None:
        if part:
            line = _SPACE.sub(" ", "".join(part)).strip()
            if line:
                out.append(line)
            part.clear()

    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            part.append(x)
        elif not x.skip:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(x.children))
    end()
    return out


def extract(page: str) -> str:
    return "\n".join(line for node in main_nodes(parse(page)) for line in blocks(node)) if page else ""


@F.arrow_udf(StringType())
def main_text(page: pa.Array) -> pa.Array:
    return pa.array([extract(x.as_py() or "") for x in page], pa.string())


def annotate(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), main_text(F.coalesce(F.col(html_col).cast("string"), F.lit(""))).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
