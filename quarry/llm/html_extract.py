"""HTML extraction by tree scoring.

A page is read into a tree of containers in one pass over its tags (lenient: unclosed and stray tags are resolved as
browsers mostly do; a quoted attribute that never closes ends with its tag). Subtrees that are never text of an article
(scripts, styles, forms, menus, headers and footers of the page, elements whose class, id or role names an advert, a notice,
a sidebar or comments) are left out. Such a name counts only as a whole, beside words of layout: `ad-free` or
`comments-closed` describe a page. Paragraphs and headings are never left out for their class, but for adverts, and no class
counts if nothing else on the page is text. Comments are also known by their shape: a container behind the text whose items
are alike and each carry an author and a date. Every block of running text passes points to its ancestors: one, one more for each comma, one more for each 100
characters up to three; in full to the parent, half to the grandparent, then 1 / (3 * level) up to LEVELS. A container's
points are discounted by its link density. The best container, widened to the <article> or <main> it lies in, is kept with
its siblings: headings, paragraphs and running text of any length, and containers that hold paragraphs or score a fifth of
it, behind an article also any that has no name; siblings that are mostly links go. The blocks of what is kept, in page order, are the text.

Defined results: null or empty html, and pages without text, give the empty text; plain text without tags is one block;
of equally good containers the first of the page wins; repeated rows give equal texts, a null page_id or url stays null; an
empty table gives no rows; whole pages are read, however long, and nothing is cut short; other columns of the table are not
read, so their names don't matter.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import map_batches, table

#: A comment, a CDATA section, a declaration, or the beginning of a tag up to its name. What is never closed ends with the page.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)", re.S)
#: One attribute. A quoted value closes; if a tag ends and another begins before its quote does, it was never closed.
_ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>=]+)(?:\s*=\s*(\"(?![^\"<>]*>[^\"<]*<[/a-zA-Z!])[^\"]*\"|'(?![^'<>]*>[^'<]*<[/a-zA-Z!])[^']*'|[^\s>]*))?|=)")
_END = re.compile(r"[\s/]*>?")
_SPACE = re.compile(r"\s+")

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that begin a block of text; all others run inside one.
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3
h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul""".split())
#: A start tag of the first kind closes an open element of the second, up to a container that stops the search.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "thead"}, "tbody": {"tbody", "thead"}, "body": {"head"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}
#: Never part of an article.
DROPPED = set("head script style noscript template iframe object embed svg canvas form button input select textarea nav footer aside menu dialog audio video map".split()) | RAW
_BEFORE = r"(?:(?:site|page|main|top|bottom|left|right|global|post|article|entry|story|header|footer|user|reader|primary|secondary|js|the|google)[_-])*"
_AFTER = r"(?:[_-](?:bar|box|links?|list|buttons?|icons?|wrapper|container|area|section|block|panel|widget|media|menu|nav|form|posts?|articles?|stories|content|items?|inner|main|top|bottom|left|right|slot|unit|banner|label|thread|feed|\d+))*"
#: Adverts are left out wherever they stand, comments as containers.
_ADVERT = re.compile(_BEFORE + r"(?:ads?|advert\w*|adsense|adslot|sponsor(?:ed|s)?)" + _AFTER)
_COMMENTS = re.compile(_BEFORE + r"(?:comments?|commentlist|comment-respond|disqus|respond|responses?|repl(?:y|ies)|discussions?|reactions?)" + _AFTER)
#: Names of what carries a comment's author or date.
_AUTHOR = re.compile(r"(?:^|[\s_-])(?:author|byline|user(?:name)?|avatar|nick(?:name)?|poster|commenter|vcard)(?=$|[\s_-])")
_DATE = re.compile(r"(?:^|[\s_-])(?:date|time|timestamp|ago|published|posted)(?=$|[\s_-])")
_FURNITURE = re.compile(r"(?:^|[_-])(?:cookies?|consent|gdpr|popup|modal|newsletter|subscri(?:be|ption)|sidebars?|side-bar|navbar|navigation|breadcrumbs?|pagination|masthead|site-header|page-header|site-footer|page-footer|footer|skip-link)(?=$|[_-])")
#: Words that name furniture if they are the whole name, or stand beside words of layout only.
_ALONE = re.compile(_BEFORE + r"(?:nav|menu|aside|banner|promo|notice|overlay|header|foot|topbar|toolbar|share|sharing|social|related|recommend(?:ed|ations)?|widget|login|signup|pager|hidden)" + _AFTER)
#: A post's own header holds its title.
_TITLE = re.compile(r"(?:post|article|entry|story|content|title)[_-]header")
#: Blocks of text, which keep their place whatever furniture their class names.
_TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dd", "dt", "td", "th", "tr", "figcaption", "caption", "summary"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
#: Where points are given whatever the class says.
LIKELY = {"article", "main", "body", "html"}
#: Ancestors that a block passes points to; further ones would get less than a thirtieth each.
LEVELS = 10
TAG_POINTS = {"article": 10, "main": 8, "section": 2, "div": 1, "td": 1, "blockquote": 1, "pre": 1, "ul": -1, "ol": -1, "li": -1, "dl": -1, "table": -1}


class Node:
    __slots__ = ("tag", "parent", "children", "points", "chars", "linked", "drop", "named", "name", "author", "date")

    def __init__(self, tag, parent, drop=False, named=False, name=""):
        self.tag, self.parent, self.drop = tag, parent, drop  # drop: never text, whatever the page is like
        self.named, self.name = named, name  # named: left out for its class or id
        self.children: list = []  # nodes and, as strings, blocks
        self.points = 0.0
        self.chars = self.linked = 0
        self.author = self.date = False  # whether it or what it holds carries one


def attributes(html: str, at: int) -> tuple[dict, int]:
    """The attributes of the tag whose name ends at `at`, and where the tag ends."""
    out: dict = {}
    if html[at : at + 1] != ">":
        while (m := _ATTRIBUTE.match(html, at)) and m.end() > at:
            at = m.end()
            if m[1]:
                value = m[2] or ""
                quoted = len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]
                out.setdefault(m[1].lower(), unescape(value[1:-1] if quoted else value))
    return out, _END.match(html, at).end()


def dropped(tag: str, a: dict, inside: dict) -> bool:
    """Whether an element is never text for what it is."""
    if tag in DROPPED:
        return True
    if tag == "header":
        return not inside["article"] and not inside["main"]
    if not a or tag in LIKELY:
        return False
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in _ROLES or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I))


def foreign(tag: str, a: dict, inside: dict) -> bool:
    """Whether its class or id names something that isn't text of an article."""
    if not a or tag in LIKELY or tag not in BLOCKS and tag != "span":
        return False
    for name in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
        if name.startswith(("no-", "has-", "with-", "without-")):  # these describe the page
            continue
        if _ADVERT.fullmatch(name):
            return True
        if tag in _TEXT or _TITLE.fullmatch(name):
            continue
        within = inside["article"] or inside["main"]
        if "header" in name and within:
            continue
        if _COMMENTS.fullmatch(name) or _ALONE.fullmatch(name) or not within and _FURNITURE.search(name) or _FURNITURE.fullmatch(name):
            return True
    return False


def parse(html: str) -> Node:
    """The tree of block elements. Inline elements are only followed for links."""
    root = node = Node("html", None)
    parts: list[str] = []
    chars_linked = links = 0  # of the block under way
    inside: dict = defaultdict(int)  # open elements by tag
    hidden_inline: list = []  # open inline elements from the first dropped one on
    hidden: dict = defaultdict(int)  # how many of them by tag

    def flush():
        nonlocal chars_linked
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text and not node.drop:
                node.children.append((text, min(chars_linked, len(text))))
            chars_linked = 0

    def close(to: Node):
        nonlocal node
        while node is not to:
            inside[node.tag] -= 1
            node.parent.author |= node.author
            node.parent.date |= node.date
            node = node.parent

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at and not hidden_inline:
            text = html[at:stop]
            parts.append(text)
            if links:
                chars_linked += len(_SPACE.sub(" ", text).strip())
        if not m:
            break
        at = m.end()
        tag = m[1]
        if not tag:
            continue
        tag, closing = tag.lower(), html[m.start() + 1] == "/"
        a, at = attributes(html, at)
        if not closing and tag in RAW:
            e = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = e.end() if e else end
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag not in BLOCKS:
            if hidden_inline and closing:
                while hidden[tag] and hidden_inline:
                    last = hidden_inline.pop()
                    hidden[last] -= 1
                    if last == tag:
                        break
            elif not closing and tag not in VOID and (hidden_inline or dropped(tag, a, inside) or foreign(tag, a, inside)):
                hidden_inline.append(tag)
                hidden[tag] += 1
            if a or tag == "time":
                marked(node, tag, a)
            continue
        flush()
        hidden_inline.clear()
        hidden.clear()
        links = 0
        if closing:
            to = node if inside[tag] > 0 else None  # a stray closing tag is found without a search
            while to is not None and to.tag != tag:
                if to.tag in ("table", "article", "main") and tag in ("p", "li", "div", "td", "tr"):
                    to = None
                    break
                to = to.parent
            if to is not None and to.parent is not None:
                close(to.parent)
            continue
        if tag == "hr":
            continue
        if tag in ("html", "body"):
            if tag == "body":
                close(root)
            continue
        other = CLOSES.get(tag)
        if other and any(inside[x] > 0 for x in other):
            to = node
            while to is not None and to.tag not in other and to.tag not in STOPS.get(tag, ()):
                to = to.parent
            if to is not None and to.tag in other:
                close(to.parent)
        if node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):  # no block stands in a paragraph or heading
            close(node.parent)
        child = Node(tag, node, node.drop or dropped(tag, a, inside), foreign(tag, a, inside), f"{a.get('class', '')} {a.get('id', '')}".strip())
        node.children.append(child)
        inside[tag] += 1
        node = child
        if a:
            marked(node, tag, a)
    flush()
    close(root)
    return root


def marked(node: Node, tag: str, a: dict) -> None:
    """Note that an element in node names an author or a date."""
    name = f"{a.get('class', '')} {a.get('rel', '')} {a.get('itemprop', '')}".lower()
    node.author = node.author or bool(_AUTHOR.search(name))
    node.date = node.date or tag == "time" or bool(_DATE.search(name))


def settle_names(nodes: list[Node]) -> None:
    """Leave out what is named furniture, and all below it, unless the page has next to no other text."""
    named = {id(n): n.named for n in nodes}
    rest = 0
    for n in nodes:  # parents first
        named[id(n)] = n.named or n.parent is not None and named[id(n.parent)]
        if not n.drop:
            own = sum(len(c[0]) for c in n.children if isinstance(c, tuple))
            n.chars = own
            rest += 0 if named[id(n)] else own
    whole = sum(n.chars for n in nodes)
    keep = rest * 20 < whole
    for n in nodes:
        n.chars = 0
        n.drop = n.drop or not keep and named[id(n)]


def is_comments(n: Node) -> bool:
    """Whether most items of a container, two at least, are alike and carry an author and a date each."""
    items = [c for c in n.children if isinstance(c, Node) and not c.drop and c.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6")]
    alike = [c for c in items if c.author and c.date and (c.tag, c.name.split()[:1]) == (items[0].tag, items[0].name.split()[:1])]
    return len(alike) >= 2 and len(alike) * 2 > len(items)


def without_comments(nodes: list[Node], best: Node) -> None:
    """Leave out containers behind the text of the best one that have the shape of comments and aren't most of the page."""
    above = set()
    up = best
    while up is not None:
        above.add(id(up))
        up = up.parent
    passed = 0  # characters of text before a node in page order
    for n in nodes:
        if n.parent is not None and n.parent.drop:
            n.drop = True
        elif not n.drop and id(n) not in above and n.author and n.date and passed > n.chars / 4 and n.tag not in _TEXT and is_comments(n):
            n.drop = True
        if not n.drop:
            passed += sum(len(c[0]) for c in n.children if isinstance(c, tuple))


def walk(node: Node):
    """All nodes, parents first, without recursion: pages can nest deeper than Python does."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += [c for c in reversed(n.children) if isinstance(c, Node)]


def blocks(node: Node) -> list[str]:
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, tuple):
            out.append(n[0])
        elif not n.drop:
            stack += reversed(n.children)
    return out


def scored(html: str) -> list[Node]:
    """The page's nodes, parents first, with points, characters and linked characters."""
    root = parse(html)
    nodes = list(walk(root))
    settle_names(nodes)
    for n in nodes:
        n.points = TAG_POINTS.get(n.tag, 0) if not n.drop else 0
    for n in nodes:
        if n.drop:
            continue
        for c in n.children:
            if isinstance(c, tuple):
                text, linked = c
                n.chars += len(text)
                n.linked += linked
                points = 1 + text.count(",") + min(len(text) // 100, 3)
                if linked * 2 > len(text):
                    continue
                # A paragraph passes its points on; text right in a container scores it as a parent.
                up, level = (n.parent, 1) if n.tag in _TEXT and n.parent else (n, 1)
                while up is not None and level <= LEVELS:
                    up.points += points / (1 if level == 1 else 2 if level == 2 else 3 * level)
                    up, level = up.parent, level + 1
    for n in reversed(nodes):
        if n.parent is not None and not n.drop:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
    return nodes


def extract(html: str | None) -> str:
    if not html:
        return ""
    nodes = scored(html)
    root = nodes[0]
    density = lambda n: n.linked / n.chars if n.chars else 1.0
    score = lambda n: n.points * (1 - density(n))
    best = max((n for n in nodes if not n.drop and n.chars and n.tag not in _TEXT), key=score, default=None)
    if best is None:
        return ""
    # An article that lies in parts (sections, cells) is as wide as the smallest container of all its strong parts,
    # and what lies in an <article> or <main> is as wide as that.
    while best.parent is not None and best.tag not in ("article", "main") and score(best.parent) >= 0.75 * score(best) and best.parent is not root:
        best = best.parent
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    without_comments(nodes, best)
    if best.parent is None:
        return "\n".join(blocks(best))
    # Beside an <article>, or right in the page's body, a container is as likely furniture of the site as text.
    strict = best.tag in ("article", "main") or best.parent.tag in ("body", "html")

    def running(c, behind: bool) -> bool:
        if isinstance(c, tuple):
            return c[1] * 3 < len(c[0])
        if c.drop or not c.chars or density(c) * 3 >= 1:
            return False
        if c.tag in _TEXT or not strict or behind and not c.name:
            return True
        return score(c) >= max(10, score(best) * 0.2) or (c.tag != "div" or not c.name) and any(isinstance(x, Node) and x.tag in _TEXT and x.chars and not x.drop for x in c.children) or _TITLE.search(c.name.lower()) is not None

    out: list[str] = []
    behind = False
    for c in best.parent.children:
        behind = behind or c is best
        if c is best or running(c, behind):
            out += [c[0]] if isinstance(c, tuple) else blocks(c)
    return "\n".join(out)


def extract_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, url, text, n_chars of every row."""

    def make():
        def f(b):
            text = [extract(x) for x in b[html]]
            return {key: b[key], "url": b["url"], "text": text, "n_chars": list(map(len, text))}

        return f

    return map_batches(pages.select(key, "url", html), make, f"{key} {dict(pages.dtypes)[key]}, url string, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
