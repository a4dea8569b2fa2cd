"""HTML extraction by tree scoring.

Each paragraph passes points for its length and commas to its ancestors, fewer the further they are; a container's
points are discounted by its link density. The best container is kept with those siblings that look like parts of
the same article, and what stands in them for menus, forms, adverts and the like is left out.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import absent, prepare, table

# HTML's element kinds, and the words that sites use in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
LEFT_OUT = frozenset("head script style noscript template nav header footer aside button select textarea input iframe object embed applet canvas svg math audio video map dialog menu title frame frameset noframes datalist".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption search".split())
CLOSE_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend".split())
IMPLIED = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th caption", "table"), "thead": ("tbody tr td th caption", "table"), "tfoot": ("tbody thead tr td th", "table"), "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select")}
SCOPE_OF_P = frozenset("button table td th caption object applet marquee html body div article section aside main header footer nav form blockquote li ul ol dl dd dt fieldset figure".split())
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs byline-ads comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination paywall popup popups promo promoted promotion related replies respond share sharing sidebar sidebars skyscraper social sponsor sponsored subscribe subscription toolbar tooltip topbar widget widgets".split()
)
WANTED = frozenset("article body content entry hentry main page post story text blog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form note status tooltip".split())
NEVER_OUT = frozenset("html body article main".split())
TALK = frozenset("comment comments commentlist disqus replies respond".split())

TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[a-z]+")
#: Names that say what stands beside an element or not, rather than what it is.
LAYOUT = re.compile(r"(?<!\S)(?:\S+[-_])?(?:no|has|with|without)[-_]\S+|(?<!\S)\S+[-_](?:free|less)(?!\S)")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("article", "bonus", "chars", "children", "direct", "link_chars", "links", "maybe", "out", "parent", "points", "tag")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, bonus: float = 0.0, maybe: str = ""):
        self.tag, self.parent, self.out, self.bonus, self.maybe = tag, parent, out, bonus, maybe
        self.article = tag == "article" or parent is not None and parent.article
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.links = 0
        self.direct: list[str] = []
        self.points: float | None = None


def _traits(tag: str, attrs: str) -> tuple[bool, float, str]:
    """Whether the element is left out, its points to begin with, and why it is left out if it turns out not to hold the article.

    The reason is "name" (an unwanted name), "mixed" (also a wanted one, as a class of its own) or "form".
    """
    if tag in LEFT_OUT:
        return True, 0.0, ""
    maybe = "form" if tag == "form" else ""
    bonus = {"article": 10.0, "main": 8.0, "div": 2.0, "section": 2.0}.get(tag, 0.0)
    if not attrs or attrs.isspace():
        return False, bonus, maybe
    got = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attrs)}
    out = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(got.get("style", "").lower())) or not ROLES.isdisjoint(got.get("role", "").lower().split())
    own, whole = set(), set()
    for k in ("class", "id"):
        names = LAYOUT.sub(" ", unescape(got.get(k, "")).lower())
        whole.update(names.split())
        own.update(NAME_PART.findall(names))
    if own & UNWANTED:
        maybe = "mixed" if whole & WANTED and not own & TALK else "name"
    if own & WANTED:
        bonus += 6.0
    if tag in NEVER_OUT:
        return False, bonus, ""
    return out, bonus, maybe


def parse(html: str) -> list[Node]:
    """The elements in page order, the root first. Missing and stray end tags are dealt with as browsers do, in the main."""
    root = Node("#root", None)
    nodes, stack, open_tags, at, n = [root], [root], {}, 0, len(html)
    lower = None

    def pop_to(k: int) -> None:
        while len(stack) > k:
            open_tags[stack.pop().tag] -= 1

    def close(tags, scope) -> None:
        """Ends the innermost open element of ``tags``, unless one of ``scope`` stands between."""
        if any(open_tags.get(t) for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    pop_to(k)
                    return
                if stack[k].tag in scope:
                    return

    while at < n:
        k = html.find("<", at)
        if k < 0:
            k = n
        if k > at:
            stack[-1].children.append(html[at:k])
        if k == n:
            break
        m = TOKEN.match(html, k)
        if not m:  # a sign, no tag
            stack[-1].children.append("<")
            at = k + 1
            continue
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
        if m["end"] or m["end2"]:
            if tag == "br":
                stack[-1].children.append(" ")
            elif open_tags.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        pop_to(i)
                        break
            continue
        if tag in CLOSE_P and open_tags.get("p"):
            close(("p",), SCOPE_OF_P - {"p"})
        if tag in IMPLIED:
            close(frozenset(IMPLIED[tag][0].split()), frozenset(IMPLIED[tag][1].split()))
        parent = stack[-1]
        if tag in ("br", "wbr"):
            if tag == "br":
                parent.children.append(" ")
            continue
        out, bonus, maybe = _traits(tag, attrs)
        node = Node(tag, parent, out or parent.out, bonus, maybe)
        parent.children.append(node)
        nodes.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS and tag not in RAW and tag != "a":
            continue
        if tag in RAW:
            if lower is None:
                lower = html.lower()
                if len(lower) != n:  # a letter whose small form is longer
                    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), html)
            k = lower.find(f"</{tag}", at)
            at = n if k < 0 else k
            continue
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    return nodes


def _block_of(node: Node) -> Node:
    while node.tag not in BLOCKS and node.parent:
        node = node.parent
    return node


def _settle(nodes: list[Node]) -> None:
    """Leaves out what names and forms say, but for an element that holds the article.

    That is one with most of the page's text outside of links which is a form, has a wanted name too, or holds the
    page's first heading.
    """
    if not any(n.maybe and not n.out for n in nodes):
        return
    size, heads = dict.fromkeys(map(id, nodes), 0), set()
    for node in reversed(nodes):  # children come before their parents
        if node.out or node.tag == "a":
            continue
        size[id(node)] += sum(len(c.strip()) for c in node.children if type(c) is str)
        if node.tag == "h1":
            heads.add(id(node))
        if node.parent:
            size[id(node.parent)] += size[id(node)]
            if id(node) in heads:
                heads.add(id(node.parent))
    total = size[id(nodes[0])]
    for node in nodes[1:]:
        if node.parent.out:
            node.out = True
        elif node.maybe and not node.out:
            node.out = not (2 * size[id(node)] > total and (node.maybe != "name" or id(node) in heads))


def _score(nodes: list[Node]) -> None:
    for node in nodes:
        if node.out:
            continue
        text = [c for c in node.children if type(c) is str and not c.isspace()]
        if text:
            got = sum(len(c.strip()) for c in text)
            node.chars += got
            _block_of(node).direct += text
    for node in reversed(nodes):  # children come before their parents
        if node.tag == "a" and not node.out:
            node.link_chars, node.links = node.chars, node.links + 1
        if node.parent and not node.out:
            p = node.parent
            p.chars += node.chars
            p.link_chars += node.link_chars
            p.links += node.links
    for node in nodes:
        if node.direct and not node.out:
            text = unescape(" ".join(node.direct))
            size = len(text)
            if size < 25:
                got = 0.1
            else:
                got = 1 + text.count(",") + text.count("、") + text.count("，") + min(size / 100, 3)
            got *= 1 - min(1.0, node.link_chars / max(1, node.chars))
            holder = node if node.tag in ("div", "section", "article", "main", "body", "#root") else node.parent
            level = 0
            while holder is not None and level < 5:
                holder.points = (holder.bonus if holder.points is None else holder.points) + got / (1 if not level else 2 if level == 1 else 3 * level)
                holder, level = holder.parent, level + 1


def _density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def _final(node: Node) -> float:
    return (node.points or 0.0) * (1 - _density(node))


def _kept(nodes: list[Node]) -> list[Node]:
    named = [n for n in nodes if n.points is not None and not n.out]
    if not named:
        return []
    best = max(named, key=_final)  # ties: the first in page order
    top = _final(best)
    # a part of an article's own element isn't the whole
    up = best
    while up.parent is not None:
        up = up.parent
        if up.tag in ("article", "main") and not up.out and _density(up) < 0.5:
            best = up
            if up.tag == "article":
                break
    # parts of equal standing: their holder is the article
    while best.parent is not None and best.tag not in ("article", "main", "body", "html", "#root"):
        like = [c for c in best.parent.children if type(c) is Node and not c.out and c is not best and (c.points or 0) > 0 and _final(c) >= 0.5 * top]
        if len(like) < 2:
            break
        best = best.parent
    if best.parent is None or best.tag in ("article", "main") and not any(type(c) is Node and c.tag == best.tag and not c.out and c is not best for c in best.parent.children):
        return [best]
    least = max(5.0, 0.2 * top)
    keep = []
    for c in best.parent.children:
        if type(c) is str or c.out:
            continue
        if c is best or c.points is not None and _final(c) >= least and _density(c) < 0.5:
            keep.append(c)
        elif c.tag in ("p", "pre", "blockquote") and c.chars:
            text = " ".join(c.direct).strip()
            if c.chars > 80 and _density(c) < 0.25 or c.chars <= 80 and not c.link_chars and re.search(r"[.!?。！？]\s*$", text):
                keep.append(c)
    return keep


def _link_list(node: Node) -> bool:
    """Of a page's own elements, a list that is mostly links; named ones are out already, and an article's are part of it."""
    return not node.article and node.tag in ("ul", "ol", "dl", "table", "div", "section") and node.links >= 3 and _density(node) > 0.66


def blocks(kept: list[Node]) -> list[str]:
    found: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        if inline:
            if line := " ".join(unescape("".join(inline)).split()):
                found.append(line)
            inline.clear()

    for top in kept:
        todo: list[Node | str | None] = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif type(x) is str:
                inline.append(x)
            elif not x.out and not (top.tag in ("body", "html", "#root") and x is not top and _link_list(x)):
                if x.tag in BLOCKS:
                    flush()
                    todo.append(None)
                todo.extend(reversed(x.children))
        flush()
    return found


def extract(html: str | None) -> str:
    """The main text of a page: blocks in page order, one line each; empty for null, empty or textless pages."""
    if not html:
        return ""
    nodes = parse(html)
    _settle(nodes)
    _score(nodes)
    return "\n".join(blocks(_kept(nodes)))


def extract_text(pages: DataFrame, *, html_col: str = "html", as_col: str = "text") -> DataFrame:
    """The frame with one more column, the main text of each whole page; a column of that name raises.

    Null, empty and textless pages give an empty text, an empty table no rows, repeated rows the same text each. Of
    containers with equal points the first in page order counts. A ``header`` is left out, within an article too.
    """
    absent(pages, as_col)
    prepare(pages.sparkSession)

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(x) for x in pages], dtype=object)

    return pages.withColumn(as_col, run(F.col(html_col)))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
