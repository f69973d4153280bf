"""Main-text extraction from HTML by tree scoring.

A page is read into a small tree that closes open paragraphs, items and cells as browsers do.
Elements that are never the article (scripts, menus, asides, ...) are marked, and so are those
whose class, id or role names a menu, header, footer, sidebar, notice, advert or comments.
A name alone does not lose an article: what holds the page's article or main element, or most
of the text, stays, and ``has-sidebar`` or ``no-comments`` name nothing. Every paragraph gives
points for its length and its commas to its parent, half of them to the grandparent, a third
to the next; a container's points are discounted by the share of its text that is links. The
best container is kept, with the headings, paragraphs and good containers beside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"'=]++|=\s*+"[^"]*"|=\s*+'[^']*'|[="'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)(?:>|(?=<)|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
#: Elements whose content is text for machines; it ends at their own end tag only.
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_DROP = frozenset(("nav", "footer", "aside", "button", "select", "option", "input", "svg", "math", "canvas", "object", "dialog", "menu", "head", "audio", "video", "label", *_RAW))
#: Controls that may stand in a sentence, as in "press <button>Save</button>"; and the blocks that hold sentences.
_CONTROLS, _PROSE = frozenset(("label", "button")), frozenset(("p", "li", "dd", "dt", "td", "th", "blockquote", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"))
_BLOCK = frozenset(
    (
        "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
        "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "ul",
    )
)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
#: What an opening tag ends: (these open elements, unless one of those lies between).
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)), "thead": (("tbody", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",)),
}
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ID = re.compile(r"""(?:^|\s)id\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_QUOTED = re.compile(r"""\b(?!style\b)[\w-]+\s*=\s*(?:"[^"]*"|'[^']*')""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/>]|$)|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_UNHEARD = re.compile(r"""aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Parts of class, id and role names of what is not the article.
_UNLIKELY = frozenset(
    (
        "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "sponsors", "promo", "promoted", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert",
        "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "sidebar", "aside", "complementary", "menu", "menubar", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "contentinfo", "header",
        "masthead", "social", "share", "sharing", "related", "recommended", "recommendations", "popup", "modal", "dialog", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "pagination", "pager", "toolbar",
        "widget", "widgets", "tags", "disclaimer",
    )
)
#: Those of reader comments, which no heading makes part of an article.
_READERS = frozenset(("comment", "comments", "commentlist", "disqus", "respond", "reply", "replies"))
#: Parts that leave a name what it is: a ``site-footer`` is a footer.
_PLAIN = frozenset(
    (
        "site", "main", "left", "right", "top", "bottom", "list", "area", "wrap", "wrapper", "container", "box", "block", "section", "inner", "primary", "secondary", "global", "bar", "links", "slot", "unit", "item", "items", "form", "thread", "body",
        "col", "column", "panel", "group", "row", "head", "post", "posts", "entry", "article", "user", "reader",
    )
)
#: Parts that say of the next or the last part whether it is there, not that this is it.
_ABOUT, _STATE = frozenset(("has", "no", "with", "without", "hide", "show", "not", "is", "allow", "allows", "enable", "disable")), frozenset(("open", "opened", "closed", "enabled", "disabled", "on", "off", "less", "none", "hidden", "visible", "active"))
#: A header of one of these belongs to the article.
_OWN = frozenset(("post", "entry", "article", "story", "content", "news", "single"))
_LIKELY = frozenset(("article", "content", "post", "entry", "story", "hentry", "main", "single", "text"))
_BASE = {"article": 25.0, "main": 12.0, "div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "dd": -3.0, "dt": -3.0, "th": -5.0, "h1": -5.0, "h2": -5.0, "h3": -5.0, "address": -3.0}
#: How sure it is that an element is not the article.
CLEAR, DOUBTFUL, FIRM = 0, 1, 2


class Node:
    __slots__ = ("tag", "parent", "depth", "block", "parts", "drop", "doubt", "heading", "topic", "points", "chars", "linked", "core", "title")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, doubt: int = CLEAR, heading: bool = False, topic: str = ""):
        self.tag, self.parent, self.drop, self.doubt, self.heading, self.topic = tag, parent, drop, doubt, heading, topic
        self.depth = parent.depth + 1 if parent else 0
        self.block: Node = self if parent is None or tag in _BLOCK else parent.block
        self.parts: list[Node | str] = []
        self.points = 0.0
        self.chars = self.linked = 0
        self.core = self.title = False

    def children(self) -> list[Node]:
        return [p for p in self.parts if not isinstance(p, str) and not p.drop]

    @property
    def density(self) -> float:
        return self.linked / self.chars if self.chars else 1.0


def _named(name: str) -> tuple[int, bool]:
    """(doubt, whether it is a header's) of one class, id or role."""
    words = [w.lower() for w in _WORD.findall(name)]
    found = [
        w for i, w in enumerate(words)
        if w in _UNLIKELY and not (i and words[i - 1] in _ABOUT) and not (i + 1 < len(words) and words[i + 1] in _STATE) and not (w == "header" and _OWN.intersection(words))
    ]
    if not found:
        return CLEAR, False
    return (FIRM if all(w in _UNLIKELY or w in _PLAIN or w.isdigit() for w in words) else DOUBTFUL), found == ["header"]


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower().replace("_", " "))


def _doubt(tag: str, attributes: str) -> tuple[int, bool, str]:
    """(doubt, whether the names are a header's, the id if it alone is why).

    The id of a heading says what the heading says, and so may that of a section that begins with a heading.
    """
    if tag in ("form", "header", "fieldset"):
        return DOUBTFUL, tag == "header", ""
    if not attributes or tag in ("html", "body", "main"):
        return CLEAR, False, ""
    if (own := _ID.search(attributes)) and tag in _HEADINGS:
        attributes, own = _ID.sub(" ", attributes), None
    names = [n for m in _NAMES.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").split()]
    found = [_named(n) for n in names]
    doubt = max((d for d, _ in found), default=CLEAR)
    if doubt == FIRM and any(d == CLEAR and _LIKELY.intersection(w.lower() for w in _WORD.findall(n)) for (d, _), n in zip(found, names, strict=True)):
        doubt = DOUBTFUL
    if tag == "article" and doubt == DOUBTFUL:
        doubt = CLEAR
    topic = (own[1] or own[2] or own[3] or "") if own and doubt else ""
    if topic and any(d > CLEAR for (d, _), n in zip(found, names, strict=True) if n != topic):
        topic = ""
    return doubt, doubt > CLEAR and all(h for d, h in found if d > CLEAR), topic


def _hidden(attributes: str) -> bool:
    return bool(_UNHEARD.search(attributes) or _HIDDEN.search(_QUOTED.sub(" ", attributes)))


def parse(html: str) -> Node:
    """The page's tree; text is kept as written. Time is proportional to the length, whatever the tags."""
    root = at = Node("html", None)
    open_: dict[str, list[Node]] = {"html": [root]}
    endless: set[str] = set()
    controls: list[Node] = []
    done = 0
    find = _TAG.search

    def close(node: Node) -> Node:
        """Close node and all that is open inside it."""
        one = at
        while one is not node.parent:
            open_[one.tag].pop()
            one = one.parent
        return node.parent

    while m := find(html, done):
        if m.start() > done:
            at.parts.append(html[done : m.start()])
        done = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag != "html" and open_.get(tag):
                at = close(open_[tag][-1])
            continue
        if tag in ("html", "body"):
            continue
        if tag in _BLOCK and at.block.tag == "p":
            at = close(at.block)
        if tag in _ENDS:
            ends, stops = _ENDS[tag]
            stop = max((open_[s][-1].depth for s in stops if open_.get(s)), default=0)
            over = [one for e in ends if open_.get(e) and (one := open_[e][-1]).depth > stop]
            while over:
                at = close(min(over, key=lambda n: n.depth))
                over = [one for e in ends if open_.get(e) and (one := open_[e][-1]).depth > stop]
        attributes = m[3] or m[6] or ""
        drop = at.drop or tag in _DROP or bool(attributes) and _hidden(attributes)
        node = Node(tag, at, drop, *(_doubt(tag, attributes) if not drop else ()))
        at.parts.append(node)
        if tag in _CONTROLS and not at.drop and at.block.tag in _PROSE and not (attributes and _hidden(attributes)):
            controls.append(node)
        if tag in _RAW_END:
            end = None if tag in endless else _RAW_END[tag].search(html, done)
            if end is None:
                if tag in ("title", "noscript", "template"):
                    endless.add(tag)
                    continue
                break
            shut = html.find(">", end.end())
            done = len(html) if shut < 0 else shut + 1
        elif tag not in _VOID and not (attributes.endswith("/") and tag in ("svg", "path", "use")):
            at = node
            open_.setdefault(tag, []).append(node)
    else:
        if done < len(html):
            at.parts.append(html[done:])
    for node in controls:
        if any(isinstance(p, str) and p.strip() for p in (*node.parent.parts, *node.parent.block.parts)):
            todo = [node]
            while todo:
                one = todo.pop()
                one.drop = False
                todo += [p for p in one.parts if not isinstance(p, str) and p.tag not in _DROP]
    return root


def _below(root: Node) -> list[Node]:
    """Every kept node after its descendants."""
    order, todo = [], [root]
    while todo:
        one = todo.pop()
        order.append(one)
        todo += one.children()
    order.reverse()
    return order


def _measure(order: list[Node]) -> None:
    """Characters, those in links, and whether a node holds an article or main element or a first heading."""
    for one in order:
        one.chars = one.linked = 0
    for one in order:
        one.chars += len(" ".join("".join([p for p in one.parts if isinstance(p, str)]).split()))
        if one.tag == "a":
            one.linked = one.chars
        one.core |= one.tag == "main" or one.tag == "article" and one.doubt < FIRM
        one.title |= one.tag == "h1"
        if one.parent is not None:
            one.parent.chars += one.chars
            one.parent.linked += one.linked
            one.parent.core |= one.core and (one.doubt < FIRM or one.tag == "main")
            one.parent.title |= one.title


def _topical(one: Node) -> bool:
    """A part of an article whose id is the words of the heading it begins with, and whose text is no menu or form: a chapter called so."""
    words = _words(one.topic)
    if not words or _READERS.intersection(words) or one.density >= 0.5:
        return False
    at = one
    while (below := [p for p in at.parts if not (isinstance(p, str) and not p.strip())]) and not isinstance(below[0], str):
        at = below[0]
        if at.tag in _HEADINGS:
            said = _words(unescape(" ".join(p if isinstance(p, str) else " ".join(q for q in p.parts if isinstance(q, str)) for p in at.parts)))
            return said == words
    return False


def _judge(root: Node, order: list[Node]) -> None:
    """Drop what is named as something other than the article, unless it is most of what there is.

    Of doubtful elements those stay that hold an article or main element, the header that holds
    the title of a page or article, and those that hold at least half of the text that is
    neither a link nor in firm elements: of the article around them, or, where a page has
    neither an article nor a main element, of the page.
    """
    if not any(one.doubt for one in order):
        return
    plain: dict[int, int] = {}
    for one in order:
        own = len(" ".join("".join([p for p in one.parts if isinstance(p, str)]).split())) if one.tag != "a" else 0
        plain[id(one)] = own + sum(plain[id(p)] for p in one.children() if p.doubt < FIRM) if one.tag != "a" else 0
    todo: list[tuple[Node, Node | None]] = [(root, None if root.core else root)]
    while todo:
        one, around = todo.pop()
        if one.tag in ("article", "main"):
            around = one
        for part in one.children():
            if part.doubt and around is not None and around is not root and _topical(part):
                pass
            elif part.doubt == FIRM:
                part.drop = not (part.core and around is None)
            elif part.doubt:
                head = part.heading and part.title and part.density < 0.5 and (around is not None and around is not root or part.tag != "header")
                most = around is not None and around is not part and plain[id(part)] * 2 >= plain[id(around)] > 0
                part.drop = not (part.core and around is None or head or most and part.tag != "header")
            if not part.drop:
                todo.append((part, around))


def _menu(parent: Node, at: int) -> bool:
    """A list outside any article that is links and nothing else, and not the list of a heading right before it (unless that says it is a menu's)."""
    one = parent.parts[at]
    if one.tag not in ("ul", "ol", "dl") or not one.chars or one.density < 0.95:
        return False
    at -= 1
    while at >= 0 and isinstance(parent.parts[at], str) and not parent.parts[at].strip():
        at -= 1
    before = parent.parts[at] if at >= 0 else ""
    if isinstance(before, str) or before.drop or before.tag not in _HEADINGS:
        return True
    return bool(_UNLIKELY.intersection(w for p in before.parts if isinstance(p, str) for w in _words(p)))


def _blocks(node: Node, out: list[str], run: list[str], inside: bool) -> None:
    """Text of node as blocks; run holds the inline text that is not ended yet."""
    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        one, i = stack.pop()
        if i == 0 and one.tag in _BLOCK:
            _end(out, run)
        for j in range(i, len(one.parts)):
            part = one.parts[j]
            if isinstance(part, str):
                run.append(part)
            elif part.tag == "br":
                run.append(" ")
            elif not part.drop and (inside or not _menu(one, j)):
                stack += [(one, j + 1), (part, 0)]
                break
            elif part.tag in _BLOCK:
                _end(out, run)
        else:
            if one.tag in _BLOCK:
                _end(out, run)


def _end(out: list[str], run: list[str]) -> None:
    if run:
        text = " ".join(unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()


def _score(order: list[Node]) -> None:
    """Give every paragraph's points to its ancestors."""
    for one in order:
        if one.tag not in _BLOCK or one.tag in _HEADINGS or one.tag in ("hr", "header"):
            continue
        own = "".join([p for p in one.parts if isinstance(p, str)])
        text = len(" ".join(own.split()))
        inline = [p for p in one.children() if p.tag not in _BLOCK]
        length = text + sum(p.chars for p in inline)
        if length and (text or one.tag in ("p", "pre", "td", "blockquote")):
            commas = own.count(",") + sum(s.count(",") for p in inline for s in p.parts if isinstance(s, str))
            points = (min(length, 25) / 25 + commas + min(length / 100, 3.0)) * (1 - sum(p.linked for p in inline) / length)
            up = one.parent if one.tag in ("p", "pre", "td", "blockquote", "li", "dd", "dt") else one
            for share in (1.0, 1 / 2, 1 / 3):
                if up is not None:
                    up.points += points * share
                    up = up.parent


def _value(one: Node) -> float:
    if not one.chars or not (one.points or one.tag in ("article", "main")):
        return 0.0
    return (one.points + _BASE.get(one.tag, 0.0)) * (1 - min(one.density, 1.0))


def extract(html: str | None) -> str:
    """The main text of a page: blocks in page order joined by a blank line, empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    _measure(order := _below(root))
    _judge(root, order)
    for one in order:
        one.core = one.title = False
    _measure(order := _below(root))
    _score(order)
    if not root.chars:
        return ""
    best = max((one for one in order if one.chars and (one.points or one.tag in ("article", "main"))), key=_value, default=root)
    most = max(_value(best), 0.0)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    own = next((i for i, one in enumerate(path) if one.tag == "article"), next((i for i, one in enumerate(path) if one.tag == "main"), 0))
    start = path[own]  # a part of an article stands for the article
    kept = {id(start)}
    titled = start.title
    for level, up in enumerate(path[own + 1 :]):
        if start.tag == "main":
            break
        before = True
        for one in up.children():
            if one is path[own + level]:
                before = False
                continue
            dense = one.density
            good = one.tag in _BLOCK and one.points > 0 and _value(one) >= 0.2 * most and dense < 0.5 or one.tag == "article" and dense < 0.5 and one.chars > 0
            if one.tag in _HEADINGS or one.title:
                good |= before and not titled and dense < 0.5 and (level == 0 or one.title)
            elif one.tag == "p":
                good |= dense < 0.25 and (level == 0 and start.tag != "article" or one.chars > 80)
            if good:
                kept.add(id(one))
        titled |= up.title
        if up.tag == "main":
            break
    out: list[str] = []
    run: list[str] = []
    todo = [root]
    while todo:
        one = todo.pop()
        if id(one) in kept:
            _blocks(one, out, run, any(a.tag == "article" for a in path[own:]) or one.tag == "article")
            _end(out, run)
        else:
            todo += reversed(one.children())
    return "\n\n".join(out)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id, url, text and n_chars (code points) of every page.

    Character references are decoded, white space inside a block becomes one space, blocks are
    trimmed and joined by two line feeds; nothing is shortened. Null or empty html, and a page
    without any main text, give the empty string. Null ids and urls and repeated rows are kept
    as they are; an empty table gives no rows; other columns are neither read nor returned.
    """
    tune(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "url")]
    out = rows.mapInArrow(_extracted, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
