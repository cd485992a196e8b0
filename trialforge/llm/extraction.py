"""HTML extraction by composite text density: the subtree with the largest sum of its children's densities."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A tag's beginning and its name; whatever else follows < is text, a comment or a declaration.
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile("[>\"']")
RAW = {t: re.compile(rf"(?i)</{t}\s*>") for t in ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title")}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: What an opening tag closes, and the tags that such closing doesn't reach beyond.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Never part of an article: by tag, by ARIA role, or, outside articles, by a word of class or id.
NOT_CONTENT = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
WORDS = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|newsletter|subscribe|comments?|disqus|respond|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|social|share|sharing|related|recommend\w*|popup|modal|pagination|login|signup)(?:$|[\s_-])")
#: Inside articles only whole names of classes count, and of ids only those that name a thread of reader comments on a
#: plain container: ids of headings and sections are anchors.
THREADS, CONTAINERS = {"comments", "respond", "disqus_thread"}, {"div", "ul", "ol"}
WIDGETS = frozenset(
    "ad ads advert advertisement sponsored sponsor promo banner ad-banner cookie-banner cookie-notice newsletter newsletter-signup subscribe comments comment comment-list comment-form disqus sidebar side-bar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer social social-share share share-buttons sharing related related-posts related-articles recommended recommendations popup modal pagination login signup".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Outside, too; an article's own header holds its headline.
HEADER = re.compile(r"(?i)(?:^|[\s_-])header(?:$|[\s_-])")
ATTRIBUTE = re.compile(r"""(?i)\s(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


class Node:
    __slots__ = ("chars", "children", "density", "link_chars", "link_tags", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []  # children: nodes and texts, in order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NOT_CONTENT or (tag == "header" and not in_article):
        return True
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = value.strip("\"'"), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in ROLES):
            return True
        if name not in ("class", "id") or tag in ("body", "html", "article", "main") or tag in HEADINGS:
            continue
        if in_article:
            names = value.lower().split()
            if not WIDGETS.isdisjoint(names) if name == "class" else tag in CONTAINERS and not THREADS.isdisjoint(names):
                return True
        elif WORDS.search(value) or HEADER.search(value):
            return True
    return False


class Tags:
    """Where the tags of a page end, each character met a bounded number of times: a > inside quotes doesn't end a tag; where
    a quote isn't closed the first > does."""

    def __init__(self, page: str):
        self.page, self.special = page, [m.start() for m in SPECIAL.finditer(page)]
        self.last, self.open = page.rfind(">"), set()  # open: quotes from which on no tag ends

    def end(self, start: int) -> int:
        """Where the tag that begins at start ends, -1 if it doesn't."""
        page, special, i, met = self.page, self.special, bisect_left(self.special, start), []
        if start > self.last:
            return -1
        while i < len(special) and special[i] not in self.open:
            at = special[i]
            if page[at] == ">":
                return at + 1
            met.append(at)
            close = page.find(page[at], at + 1)
            if close < 0:
                break
            i = bisect_left(special, close, i + 1) + 1
        self.open.update(met)
        return page.find(">", start) + 1


class Tree:
    """The tree of what may be content and the path of open tags, by depth and by name."""

    def __init__(self):
        self.root = Node("body", None)
        self.path, self.open, self.blocks = [self.root], {}, [0]

    def push(self, node: Node) -> None:
        self.open.setdefault(node.tag, []).append(len(self.path))
        if node.tag in BLOCK and node.tag != "p":
            self.blocks.append(len(self.path))
        self.path.append(node)

    def cut(self, depth: int) -> None:
        """Closes all that is open from a depth on."""
        while len(self.path) > depth:
            tag = self.path.pop().tag
            self.open[tag].pop()
            if self.blocks[-1] == len(self.path):
                self.blocks.pop()

    def close(self, tag: str) -> None:
        if self.open.get(tag):
            self.cut(self.open[tag][-1])

    def make_room(self, tag: str) -> None:
        """Closes what an opening tag ends: paragraphs before blocks, items before items, cells before cells."""
        if tag in CLOSES:
            inside, stop = CLOSES[tag]
            least = max((self.open[t][-1] for t in stop if self.open.get(t)), default=0)
        else:
            inside, least = ("p",), self.blocks[-1]
        depths = [self.open[t][i] for t in inside if self.open.get(t) and (i := bisect_right(self.open[t], least)) < len(self.open[t])]
        if depths:
            self.cut(min(depths))


def parse(page: str) -> Node:
    """The tree of what may be content; unclosed and stray tags are put right as browsers do in the common cases. The work
    grows with the page's length, however broken it is."""
    tree, tags, position, texts_from = Tree(), Tags(page), 0, 0
    dead: list[str] = []  # open tags inside something unwanted
    inside: Counter = Counter()  # the same by name

    def text(end: int) -> None:
        if end > texts_from and not dead:
            piece = page[texts_from:end]
            tree.path[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    while (at := page.find("<", position)) >= 0:
        if page.startswith(("<!", "<?"), at):
            text(at)
            if page.startswith(("<!-->", "<!--->"), at):  # comments without text
                close = page.find(">", at)
            else:
                close = page.find("-->", at + 4) + 2 if page.startswith("<!--", at) else page.find(">", at)
            # a comment that isn't closed goes on to the page's end
            position = texts_from = close + 1 if close > at + 1 else len(page)
            continue
        name = NAME.match(page, at)
        end = tags.end(at) if name else -1
        if end < 0:  # no tag
            position = at + 1
            continue
        text(at)
        position = texts_from = end
        close, tag, empty = page[at + 1] == "/", name[1].lower(), page[end - 2] == "/"
        if tag in RAW:
            if not close and not empty:
                found = RAW[tag].search(page, end)
                position = texts_from = found.end() if found else len(page)
        elif dead:
            if tag in VOID:
                continue
            if not close:
                if not empty:
                    dead.append(tag)
                    inside[tag] += 1
            elif inside[tag]:
                while (last := dead.pop()) != tag:
                    inside[last] -= 1
                inside[tag] -= 1
        elif tag in ("html", "body"):
            continue
        elif close:
            tree.close(tag)
        else:
            if tag in BLOCK or tag in CLOSES:
                tree.make_room(tag)
            if tag in VOID:
                tree.path[-1].children.append(Node(tag, tree.path[-1]))
            elif unwanted(tag, page[name.end() : end - 1], bool(tree.open.get("article") or tree.open.get("main"))):
                if not empty:
                    dead, inside = [tag], Counter([tag])
            else:
                node = Node(tag, tree.path[-1])
                tree.path[-1].children.append(node)
                if not empty or tag in BLOCK:
                    tree.push(node)
    text(len(page))
    return tree.root


def measure(root: Node) -> list[Node]:
    """Fills in the counts, densities and sums of all nodes; returns them, parents first.

    The density of a node is its characters per tag, adjusted for links: times the logarithm of (characters per link
    character x tags per link tag) to a base that grows with the node's share of link text against the page's."""
    nodes = [root]
    for x in nodes:
        nodes += [c for c in x.children if isinstance(c, Node)]
    for x in reversed(nodes):
        for c in x.children:
            if isinstance(c, Node):
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags + (c.tag == "a")
            else:
                x.chars += len("".join(c.split()))
        if x.tag == "a":
            x.link_chars = x.chars
    page = root.link_chars / max(1, root.chars)
    for x in nodes:
        if x.chars:
            base = math.log(x.chars / max(1, x.chars - x.link_chars) * x.link_chars + page * x.chars + math.e)
            ratio = x.chars / max(1, x.link_chars) * max(1, x.tags) / max(1, x.link_tags)
            x.density = x.chars / max(1, x.tags) * math.log(max(ratio, 1.0) + 1e-9) / math.log(base + 1e-9) if base > 1 else x.chars / max(1, x.tags) * math.log(max(ratio, 1.0))
    for x in nodes:
        x.sum = sum(c.density for c in x.children if isinstance(c, Node))
    return nodes


def main_subtree(root: Node) -> Node:
    """The node of the largest sum of child densities (the first of equal ones, parents before children); of it and its
    ancestors, the highest one below the body whose density is over the threshold.

    The threshold is the least density on the path from the body to that node, or, where that is under half of the node's
    own, their geometric mean: what is taken of a page that links dilute ends where the dilution begins, and one without
    links keeps what stands beside the densest part, like headlines. Where an article element (else main) holds that
    node, the outermost one is taken whole: an article with one long emphasised paragraph isn't that paragraph."""
    path = [max(measure(root), key=lambda x: x.sum)]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    for tag in ("article", "main"):
        if whole := [x for x in path if x.tag == tag and x.chars]:
            return whole[-1]
    least, own = min(x.density for x in path), path[0].density
    threshold = math.sqrt(least * own) if least < own / 2 else least
    chosen = next((x for x in path[::-1] if x.density > threshold and x is not root), path[0])
    return chosen if chosen.chars else root


def render(node: Node) -> str:
    """Blocks in page order: white space inside a block is one space, blocks are joined by one \\n."""
    blocks: list[list[str]] = [[]]
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            blocks[-1].append(x)
        elif x is None:
            blocks.append([])
        elif x.tag == "br":
            blocks[-1].append(" ")
        else:
            edge = [None] if x.tag in BLOCK else []
            todo += edge + x.children[::-1] + edge
    return "\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


def main_text(page: str | None) -> str:
    """The main text of a whole page; a null, empty or text-free page gives an empty text."""
    return render(main_subtree(parse(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text, n_chars), a row for each row."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
