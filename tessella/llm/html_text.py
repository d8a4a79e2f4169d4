"""Main text of web pages by composite text density.

Each page becomes a tree of all its elements but those that show no text (scripts, styles,
form controls, hidden parts).  Every node gets its characters per tag, adjusted by links
(composite density): text inside links counts against it, and so does the text of
parts that the page itself names as furniture, by element (``nav``, ``footer``, ...),
role, or class and id words (``cues``); their density is zero.  Nothing is taken out
for its name alone: a part so named that holds more than half of the page's text, such
as a form around a whole page, keeps its density.

The node whose children's densities have the largest sum is the best one (children
of lists, tables and quotations count for the node around them; the first of equal
ones).  The least density on its path to the body is the threshold.  From the body
down, any other node that reaches the threshold, with at least ``SHARE`` of the best
sum in its subtree, marks the node with the largest sum there.  The content is all
marked nodes in page order, with the headings right before them, and without the
nodes of density zero that are furniture.  Whole subtrees are returned, however short
their paragraphs are.  ``article`` and ``main`` have no special meaning here.

Results for odd input: a null or empty page gives an empty text, and so does one
without text outside the parts above.  Unclosed and stray tags are repaired as
browsers do it for paragraphs, list items and table cells.  Pages are read whole, of
any length and depth.  Repeated rows give a row each; a null url or page_id is carried;
more columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg math".split())
#: Of these, the ones that nest and may close themselves.
FOREIGN = frozenset(("svg", "math"))
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is never shown as text of the page.
OUT = frozenset("head button select option datalist object embed canvas audio video map input".split()) | RAW
#: Elements that name their content as something else than the article.
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
#: Elements that hold one text in parts: their children count for the node around them.
PARTS = frozenset("ul ol dl li dt dd blockquote figure table thead tbody tfoot tr pre details center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Least share of the best sum that another marked node has.
SHARE = 0.2
#: Elements that stand in a paragraph without ending it.
FLOWING = INLINE | RAW | frozenset("button select option object embed canvas audio video map meta link".split())
#: Elements that an opening tag of the kind ends, up to the element named.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"})}
#: Words of class and id attributes that name furniture.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|banners?|sponsor(?:ed|s)?|promos?|promotions?|cookies?|consent|gdpr|notices?|popups?|modals?|overlay|newsletters?|subscribe|subscription|signup|login|comments?|commentlist|disqus|repl(?:y|ies)|respond|discussion|sidebars?|aside|menus?|nav|navbar|navigation|breadcrumbs?|footer|masthead|social|share|sharing|related|recommended|recommendations|widgets?|toolbar|pager|pagination|alert|site-?header|page-?header|topbar|skip-link)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())


class Node:
    __slots__ = ("tag", "up", "parts", "out", "named", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None, out: bool = False, named: bool = False) -> None:
        self.tag, self.up, self.parts, self.out, self.named, self.dropped = tag, up, [], out, named, False

    def nodes(self) -> list[Node]:
        return [x for x in self.parts if not isinstance(x, str) and not x.out]


def _marks(tag: str, attributes: str, above: list[Node], cues: bool) -> tuple[bool, bool]:
    """Whether an element is not shown, and whether the page names it as furniture."""
    if tag in OUT:
        return True, False
    named = tag in FURNITURE or tag == "header" and not any(n.tag in ("article", "main") for n in above)
    if not attributes or tag in ("html", "body"):
        return False, named
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            named = named or cues and tag not in ("article", "main") and bool(BOILERPLATE.search(value))
        elif name == "role":
            named = named or value.lower() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, named
    return False, named


def _raw_end(page: str, at: int, tag: str) -> int:
    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
    return end.end() if end else len(page)


def _foreign_end(page: str, at: int, tag: str, attributes: str) -> int:
    """Where an svg or math element ends that opens before ``at``; if it never does, its opening tag is all of it."""
    depth, end = not attributes.endswith("/"), at
    while depth and (m := TAG.search(page, end)):
        end = m.end()
        if (m[2] or m[5] or "").lower() == tag:
            if m[1] or m[4]:
                depth -= 1
            elif not (m[3] or m[6] or "").endswith("/"):
                depth += 1
    return at if depth else end


def parse(page: str, cues: bool = True) -> Node:
    root = Node("html", None)
    stack, at = [root], 0

    def text(s: str) -> None:
        if s and not stack[-1].out:
            stack[-1].parts.append(html.unescape(s) if "&" in s else s)

    def close(k: int) -> None:
        del stack[k:]

    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ending, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ending:
            k = len(stack) - 1
            while k and stack[k].tag != tag:
                if tag in INLINE and stack[k].tag not in INLINE or tag in ("p", "li") and stack[k].tag in ("table", "ul", "ol", "article", "section", "div") and tag != stack[k].tag:
                    k = 0
                    break
                k -= 1
            if k:
                close(k)
            continue
        if tag == "html":
            continue
        if tag == "body":
            close(1)
        elif tag not in FLOWING:
            if tag in ENDS:
                ends, until = ENDS[tag]
                k = len(stack) - 1
                while k and stack[k].tag not in until and stack[k].tag not in ends:
                    k -= 1
                if k and stack[k].tag in ends:
                    close(k)
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        out, named = _marks(tag, attributes, stack, cues)
        node = Node(tag, stack[-1], stack[-1].out or out, named)
        if not stack[-1].out:
            stack[-1].parts.append(node)
        if tag in RAW:
            at = _foreign_end(page, at, tag, attributes) if tag in FOREIGN else _raw_end(page, at, tag)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
    text(page[at:])
    return root


def _measure(root: Node) -> list[Node]:
    """Counts and densities of every shown node, children before parents."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.nodes()
    order.reverse()
    for node in order:
        node.chars = sum(len(x.strip()) for x in node.parts if isinstance(x, str)) + sum(x.chars for x in node.nodes())
    half = order[-1].chars / 2
    for node in order:
        node.tags = node.link_chars = node.link_tags = 0
        for x in node.nodes():
            node.tags += x.tags + (x.tag == "a" or x.tag not in INLINE)
            node.link_chars += x.chars if x.tag == "a" else x.link_chars
            node.link_tags += x.link_tags + (x.tag == "a")
        if node.named and node.chars <= half:
            node.link_chars, node.link_tags, node.dropped = node.chars, max(node.tags, 1), True
    whole = order[-1]
    ratio = whole.link_chars / max(whole.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + ratio * c + math.e)
        node.density = 0.0 if node.dropped else c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(base + 1e-9) if base > 1.0001 else c / t * math.log(max(c / lc * t / lt, 1.0) + 1)
        node.total = 0.0
        for x in node.nodes():
            if x.tag not in INLINE and not x.dropped:
                node.total += x.total if x.tag in PARTS and x.total else x.density
    return order


def content(root: Node) -> list[Node]:
    """Nodes that hold the content, in page order; none stands in another, and furniture in them is marked as dropped."""
    order = _measure(root)
    holders = [n for n in order if n.tag not in INLINE and (n.tag not in PARTS or n.up is None)]
    best = max(reversed(holders), key=lambda n: n.total)
    path, threshold, node = {best}, best.density, best
    while node.up is not None and node.up.tag != "body" and node.up.up is not None:
        node = node.up
        threshold = min(threshold, node.density)
        path.add(node)
    while node is not None:
        path.add(node)
        node = node.up
    top: dict[Node, Node] = {}
    for n in order:  # children first
        own = [n] if n.tag not in INLINE and n.tag not in PARTS else []
        top[n] = max([*own, *(top[x] for x in n.nodes())], key=lambda x: x.total, default=n)
    marked, todo = {best}, [root]
    while todo:
        n = todo.pop()
        if n is best:
            continue
        if n not in path and n.density >= threshold and n.density and top[n].total >= SHARE * best.total:
            marked.add(top[n])
        else:
            todo += n.nodes()
    held, todo = [], [root]
    while todo:
        n = todo.pop()
        if n in marked:
            held += [*_headings(n), n]
        else:
            todo += reversed(n.nodes())
    return held


def _headings(node: Node) -> list[Node]:
    """Headings that stand right before ``node`` among its parent's nodes."""
    out: list[Node] = []
    for x in reversed(node.up.nodes()[: node.up.nodes().index(node)] if node.up else []):
        if x.tag not in HEADINGS or x.dropped:
            break
        out.insert(0, x)
    return out


def blocks(top: Node) -> list[str]:
    """Texts of the blocks under ``top`` in page order, white space made single spaces."""
    out, run, todo = [], [], [top]

    def flush() -> None:
        if s := " ".join("".join(run).split()):
            out.append(s)
        run.clear()

    while todo:
        x = todo.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            flush()
        elif x.out or x.dropped:
            continue
        elif x.tag in ("br", "img", "wbr"):
            run.append("" if x.tag == "wbr" else " ")
        elif x.tag in INLINE:
            todo += reversed(x.parts)
        else:
            flush()
            todo.append(None)
            todo += reversed(x.parts)
    flush()
    return out


def main_text(page: str | None, cues: bool = True) -> str:
    """The main text; without ``cues`` words of class and id attributes mean nothing."""
    return "\n".join(x for top in content(parse(page, cues)) for x in blocks(top)) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch["html"]]
            yield pa.record_batch([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op3_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
