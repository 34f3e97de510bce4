"""Main text of web pages by tree scoring (operator 8).

A page becomes a light tree.  Every paragraph earns points for its length and
its commas and passes them on to its ancestors, fewer the farther they are.
Points of a container count less the more of its text lies in links, and four
fifths are taken from what its class or id calls something else, while an article or
main element makes them five times as many.  The best container is kept, with the article around it if there is one.  Without one, text,
headings and sections beside it stay if they are poor in links, and other
containers if they hold a run of paragraphs that scores well against its own: side columns and
reader comments do not, whatever they are called.

Work is per page (``mapInPandas``) without a shuffle; time and memory follow
the length of the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^>"']++)*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")

RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
          "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search",
          "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Start tags that end an open paragraph.
CLOSE_P = BLOCKS - {"body", "caption", "dd", "dt", "head", "html", "legend", "li", "tbody", "td", "tfoot", "th",
                    "thead", "tr"} | {"li", "dd", "dt"}
#: Start tag: open elements that it ends, up to the elements that shield them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
        "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
        "body": ({"head"}, {"html"})}
SHIELD = {"table", "td", "th", "caption", "button", "object", "html", "template", "article", "aside", "section"}

#: Elements that never hold main text.
JUNK_TAGS = {"nav", "footer", "aside", "form", "head", "noscript", "iframe", "object", "svg", "math", "template",
             "button", "select", "dialog", "menu", "canvas", "audio", "video", "map", "datalist", "input", "label",
             "fieldset", "search", "audio", "picture"}
JUNK_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog",
              "alertdialog", "alert", "toolbar", "form"}
#: Words of class and id that mark what is around an article.
JUNK_WORDS = set("""ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo
    promos promotion banner banners cookie cookies consent gdpr notice notices popup popups modal overlay sidebar
    sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer masthead
    comment comments commentlist disqus respond replies reply reactions share sharing social related recommended
    recommendations newsletter subscribe subscription signup login widget widgets toc skip hidden copyright""".split())
#: Words that keep an element although another word speaks against it.
KEEP_WORDS = {"article", "main", "content", "post", "entry", "story", "body"}
HEADER_WORDS = {"header", "topbar", "masthead"}
TEXT_TAGS = {"p", "pre", "blockquote", "td", "th", "li", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6",
             "figcaption", "caption", "summary"}

#: A part beside the best container stays if less of its text than this is in links.
LINK_POOR = 0.5
#: A container beside the best one stays if its best run of paragraphs has this share of the points.
LEAST_SHARE = 0.2
#: Characters that a comma counts as much as.
A_COMMA = 10
#: What is left of the points of an element that its class or id speaks against; a landmark
#: gets as many times more.
NAMED = 0.2
#: Containers that say nothing of what they hold.
NEUTRAL = {"div", "center", "table", "tbody", "tr", "td", "ul", "ol", "dl", "dir", "details", "address"}


class Node:
    __slots__ = ("tag", "parent", "children", "junk", "named", "in_article", "landmark", "size", "links", "commas",
                 "score", "run", "own", "n_links")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.junk = self.named = self.in_article = self.landmark = False
        self.size = self.links = self.commas = self.own = self.n_links = 0
        self.score = 0.0                                  # points of all paragraphs in it, fewer from afar
        self.run = 0.0                                    # points of the best run of paragraphs side by side in it


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(text)}


def _judge(node: Node, text: str) -> None:
    """Marks a new element as junk by its tag or role, as named by what is around an
    article, or as a landmark of the main text."""
    up, tag = node.parent, node.tag
    node.junk, node.in_article = up.junk, up.in_article or tag in ("article", "main")
    if node.junk:
        return
    if tag in JUNK_TAGS or tag == "header" and not up.in_article:
        node.junk = True
        return
    node.landmark = tag in ("article", "main")
    if "=" not in text and "hidden" not in text:
        return
    a = _attributes(text)
    role = a.get("role", "").lower()
    if role in JUNK_ROLES or "hidden" in a or a.get("aria-hidden") == "true" \
            or re.search(r"(display\s*:\s*none|visibility\s*:\s*hidden)", a.get("style", ""), re.I):
        node.junk = True
        return
    node.landmark |= role in ("main", "article") or a.get("itemprop", "").lower() == "articlebody"
    named = f"{a.get('class', '')} {a.get('id', '')}"
    if tag in ("html", "body", "a", "b", "i", "em", "strong", "span", "p") and "hidden" not in named.lower():
        words = set(re.findall(r"[a-z]+", named.lower()))
        node.named = tag not in ("html", "body") and bool(words & JUNK_WORDS) and not words & KEEP_WORDS
        return
    words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()))
    against = words & JUNK_WORDS or (words & HEADER_WORDS and not up.in_article)
    comment = words & {"comment", "comments", "commentlist", "disqus", "respond", "ad", "ads", "advert", "cookie",
                       "sidebar", "hidden"}
    if against and (comment or not (words & KEEP_WORDS or node.landmark)):
        node.named, node.landmark = True, False


def parse(page: str) -> list[Node]:
    """The elements of a page in page order, the root first."""
    root = Node("#root", None)
    nodes, stack = [root], [root]
    at, n = 0, len(page)
    lower = None
    last_tag = page.rfind(">")                            # no tag ends after it
    open_: Counter[str] = Counter()                       # of the stack, so that nothing is looked for in vain

    def close(to: int) -> None:
        for x in stack[to:]:
            open_[x.tag] -= 1
        del stack[to:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > last_tag:
            lt = n
        if lt > at:
            stack[-1].children.append(page[at:lt])
        if lt == n:
            break
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = n if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            stop = page.find(">", lt)
            at = n if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:                                     # a sign, not a tag
            if page.startswith("</", lt) and (stop := page.find(">", lt)) >= 0:
                at = stop + 1
            else:
                stack[-1].children.append("<")
                at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            for i in () if not open_[tag] else range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break
            continue
        if tag in CLOSE_P and open_["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SHIELD:
                    break
        if tag in ENDS:
            ended, shields = ENDS[tag]
            for i in () if not any(open_[x] for x in ended) else range(len(stack) - 1, 0, -1):
                if stack[i].tag in shields:
                    break
                if stack[i].tag in ended:
                    close(i)
                    if not (tag in ("tr", "tbody")):
                        break
        elif open_["head"] and tag not in ("head", "meta", "link", "title", "style", "script", "base", "noscript"):
            for i in range(len(stack) - 1, 0, -1):        # an open head ends where content begins
                if stack[i].tag == "head":
                    close(i)
                    break
        node = Node(tag, stack[-1])
        _judge(node, m[3])
        node.parent.children.append(node)
        nodes.append(node)
        if tag in RAW:
            node.junk = True
            if lower is None:
                lower = page.lower()
            stop = lower.find(f"</{tag}", at)
            if stop < 0:
                break
            stop = page.find(">", stop)
            at = n if stop < 0 else stop + 1
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCKS):
            stack.append(node)
            open_[tag] += 1
    return nodes


def _plain(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _points(node: Node) -> float:
    """Points of the text that stands in an element itself: its length, more with
    commas, less with links."""
    return node.own * (1 + A_COMMA * node.commas / node.size) * (1 - node.links / node.size)


def _weigh(nodes: list[Node]) -> None:
    """Sizes, links and commas bottom up, then the points of every element."""
    for node in reversed(nodes):
        if node.junk:
            continue
        for c in node.children:
            if isinstance(c, str):
                t = _plain(c)
                node.own += len(t)
                node.size += len(t)
                node.commas += sum(map(t.count, ",،、，;"))
            elif not (c.junk or c.named):
                node.size += c.size
                node.links += c.links
                node.commas += c.commas
                node.n_links += c.n_links
                if c.tag not in BLOCKS:
                    node.own += c.own
        if node.tag == "a":
            node.links, node.n_links = node.size, node.n_links + 1
    for node in nodes:
        if node.junk or not node.size:
            continue
        if node.own and (node.tag in BLOCKS or node.parent is None):
            points = _points(node)
            holder = node.parent if node.tag in TEXT_TAGS else node
            holder.run += points
            up, share, left = holder, 1.0, NAMED if node.named and holder is not node else 1.0
            for level in range(5):
                if up is None:
                    break
                up.score += points * share * left
                left *= NAMED if up.named else 1
                up, share = up.parent, 1 / (2 * (level + 1))
    for node in reversed(nodes):
        if node.parent is not None and not (node.junk or node.named):
            node.parent.run = max(node.parent.run, node.run)


def _is_menu(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "section", "table", "dl", "p") and node.n_links >= 3 \
        and node.links >= 0.8 * node.size


def _blocks(tops: list[Node]) -> list[str]:
    out: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        t = _plain("".join(inline))
        if t:
            out.append(t)
        inline.clear()

    todo: list[Node | str | None] = []
    for top in tops:
        todo = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                inline.append(x)
            elif x.tag in ("br", "wbr", "img"):
                inline.append("" if x.tag == "wbr" else " ")
            elif not x.junk and not (x is not top and _is_menu(x)):
                if x.tag in BLOCKS:
                    flush()
                    todo.append(None)
                todo.extend(reversed(x.children))
        flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page: blocks in page order, one to a line.

    Empty for null, for empty pages and for pages without text outside menus and
    the like.  Character references are decoded once, white space in a block
    becomes one blank.  No block of the kept containers is shortened or left
    out."""
    if not page:
        return ""
    nodes = parse(page)
    _weigh(nodes)
    best, most = None, 0.0
    under: dict[int, float] = {}                          # of landmarks, named elements and what they hold
    for x in nodes:
        left = under.get(id(x.parent), 1.0)
        left *= NAMED if x.named else 1 / NAMED if x.landmark and left <= 1 else 1
        if left != 1:
            under[id(x)] = left
        points = 0.0 if x.junk else x.score * (1 - x.links / max(x.size, 1)) * left
        if points > most:                                 # on equal points the first in page order, the outer one
            best, most = x, points
    if best is None:
        return ""
    above = set()
    up = best
    while up is not None:
        above.add(id(up))
        up = up.parent
    for x in nodes:
        x.junk |= x.named and id(x) not in above
    around = best
    while around is not None and not around.landmark:
        around = around.parent
    if around is not None:
        while around.parent is not None:                 # the outermost article, or main if there is none
            outer = around.parent
            while outer is not None and outer.tag != "article":
                outer = outer.parent
            if outer is None or around.tag != "article":
                break
            around = outer
        if around.tag != "main" or around is best:
            return "\n".join(_blocks([around] if around is not best else _kept(best)))
    top = best                                            # the outermost wrapper without other text
    while top.parent is not None and top is not around and not _others(top):
        top = top.parent
    if top is around or top.tag in ("#root", "html", "body") or top.parent is None:
        return "\n".join(_blocks(_kept(best)))
    return "\n".join(_blocks([y for x in _parts(top.parent)
                              for y in (_kept(best) if x is top else [x] if _stays(x, best.run) else [])]))


def _stays(x: Node, run: float) -> bool:
    """Whether a part beside text of ``run`` points belongs to it."""
    if not x.size:
        return False
    loose = x.links / x.size
    if x.tag in NEUTRAL:
        return x.run * (1 - loose) >= LEAST_SHARE * run
    return loose < LINK_POOR


def _kept(best: Node) -> list[Node]:
    """The parts of the best container.  Where it holds paragraphs itself, containers before the first
    and after the last of them are beside the text and must stand up to it; what
    stands between paragraphs belongs to the text."""
    parts = _parts(best)
    text = [i for i, x in enumerate(parts)
            if x.tag in ("p", "pre", "blockquote", "#run") and x.size and x.links < LINK_POOR * x.size]
    points = sum(_points(parts[i]) for i in text)
    if best.landmark or not text or any(x.run > points for x in parts):
        return [best]
    return [x for i, x in enumerate(parts) if text[0] <= i <= text[-1] or _stays(x, points)]


def _others(node: Node) -> bool:
    """Whether any text stands beside a node in its parent."""
    return any(_plain(x) if isinstance(x, str) else x.size and not x.junk
               for x in node.parent.children if x is not node)


def _parts(node: Node) -> list[Node]:
    """What a container holds but for junk: its blocks, and between them each
    run of direct text and inline elements as one part."""
    out: list[Node] = []
    run = None
    for x in node.children:
        if not isinstance(x, str) and (x.tag in BLOCKS or x.score > 0):
            run = None
            if not x.junk:
                out.append(x)
            continue
        if run is None:
            run = Node("#run", node)
            out.append(run)
        run.children.append(x)
        if isinstance(x, str):
            run.size += len(t := _plain(x))
            run.own = run.size
            run.commas += sum(map(t.count, ",،、，;"))
        elif not x.junk:
            run.size += x.size
            run.own = run.size
            run.links += x.links
            run.commas += x.commas
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, text and n_chars, as :func:`main_text` has it.
    Null ids and urls stay null, repeated rows each give a row, other columns
    are ignored, an empty table gives an empty result."""
    rows = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(url).alias("url"),
                        F.col(html).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["text"] = [main_text(h) for h in pdf.pop("html").tolist()]
            yield pdf

    # n_chars by Spark, which counts code points
    return rows.mapInPandas(run, "page_id string, url string, text string").select(
        F.col("page_id").cast(pages.schema[page_id].dataType), "url", "text",
        F.length("text").cast("long").alias("n_chars"))
