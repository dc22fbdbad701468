"""Main text of web pages by tree scoring.

Markup is read into a tree of elements (unclosed and wrongly closed tags included). Subtrees that
are never article text (menus, adverts, forms, comments and the like, by tag, role, class or id)
are set aside. What only a class, an id or a form tells is taken back where no prose would remain
without it (see ``_take_back``). Every paragraph earns points for its length and commas; they go to
the element that holds it in full, and up the tree halved at every level. An element's points are
discounted by its link density. On a page with one article (or main element) that is kept, and no
block outside competes with it. Otherwise the best container is kept (the whole article, where it
lies in one), with those of its siblings that score alike, are of its kind (sections, or elements of
the same class) or head it. Blocks that are mostly links are left out, but not inside an article.

One pass over the markup and two over the tree, without recursion, so cost is linear however long
or deep a page is. A null or empty page gives an empty text, and so does one without text. Pages
without a paragraph give all text that was not set aside. Ties go to the earlier element. Repeated
rows get equal results; existing columns called ``text`` or ``n_chars`` are replaced.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from threadlake.llm.frames import add_columns

# Element names of the HTML standard by how they take part.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
PARAGRAPHS = frozenset("p pre blockquote li dd dt td h1 h2 h3 h4 h5 h6 figcaption".split())
ASIDE = frozenset(
    "script style textarea title iframe noembed noframes xmp noscript template head nav aside "
    "footer button select option input menu dialog svg math canvas object audio video "
    "map datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu".split())
#: Words of class and id values (split at white space, '-' and '_') that name what is set aside.
NAMES = frozenset(
    "nav navbar navigation menu sidebar aside footer ad ads adv advert adverts advertisement "
    "advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices "
    "gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "comment comments commentlist disqus respond reply replies related recommended breadcrumb "
    "breadcrumbs pagination pager widget masthead toolbar tooltip skip".split()
)
HEADER = frozenset(["header"])
#: Those of NAMES that hold long text which is not the article.
TALK = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Values that hold one of NAMES by chance.
PHRASES = frozenset(["ad-hoc"])
HEADINGS = frozenset("h1 h2 h3".split())
LEAST_PROSE = 50  # characters but blanks of a paragraph that is surely no label
#: With one of these, a name says something about the element ("comments-open"), not what it is.
STATES = frozenset("has no with without open closed".split())

_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_MARKS = re.compile(
    r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""",
    re.IGNORECASE,
)
_SPLIT = re.compile(r"[\s_-]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.IGNORECASE) for tag in RAW}
#: Start tags that end an open paragraph, and items that end an open one of their kind.
_ENDS_SAME = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
_SCOPES = frozenset("ul ol dl table body article section main div".split())


class _Element:
    __slots__ = ("tag", "parent", "block", "aside", "named", "kind", "linked", "article", "own", "chars",
                 "commas", "links", "points", "kept")

    def __init__(self, tag: str, parent: _Element | None, aside: bool) -> None:
        self.tag, self.parent = tag, parent
        self.block = parent.block if parent is not None and tag in INLINE else self
        self.aside = aside or (parent is not None and parent.aside)
        self.named = ""
        self.kind = ""  # its class
        self.linked = tag == "a" or (parent is not None and parent.linked)
        self.article = self if tag in ("article", "main") else parent and parent.article
        self.own = self.chars = self.commas = self.links = 0
        self.points, self.kept = 0.0, False


def _set_aside(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in ASIDE or (tag == "header" and not in_article):
        return True
    if len(attributes) < 3:
        return False
    for name, *values in _MARKS.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and _HIDDEN.search(value):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
    return False


def _named(tag: str, attributes: str, in_article: bool) -> str:
    """Whether a class or id, or being a form, speaks against an element: "", "block" or "talk"."""
    named = "block" if tag == "form" else ""
    if len(attributes) < 3 or tag in ("html", "body", "article", "main"):
        return named
    for name, *values in _MARKS.findall(attributes):
        if name.lower() in ("class", "id"):
            value = next((v for v in values if v), "").lower()
            value = " ".join(v for v in value.split() if v not in PHRASES)
            words = set(_SPLIT.split(value))
            if words & TALK:
                parts = (set(_SPLIT.split(v)) for v in value.split())
                if any(v & TALK and not v & STATES for v in parts):
                    return "talk"
            if words & NAMES or (not in_article and words & HEADER):
                named = "block"
    return named


def _class_of(attributes: str) -> str:
    for name, *values in _MARKS.findall(attributes):
        if name.lower() == "class":
            return next((v for v in values if v), "").strip().lower()
    return ""


def _parse(html: str) -> tuple[list[_Element], list[tuple[_Element, str]]]:
    """Elements in page order, and the text pieces with their element; " " parts blocks."""
    root = _Element("html", None, False)
    elements, pieces, stack = [root], [], [root]
    at, size, quoted = 0, len(html), True

    def close(index: int) -> None:
        if any(e.tag not in INLINE for e in stack[index:]):
            pieces.append((stack[index - 1], " "))
        del stack[index:]

    def open_at(tags: tuple[str, ...]) -> int:
        """Where one of the tags is open, not looking beyond the next container."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in _SCOPES:
                return 0
        return 0

    opened: dict[str, int] = {}
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            pieces.append((stack[-1], unescape(html[at:lt])))
        if lt >= size:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        name = _NAME.match(html, lt + 1)
        if name is None:
            if html[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                pieces.append((stack[-1], "<"))
                at = lt + 1
            continue
        tag = name[1].lower()
        match = _ATTRIBUTES.match(html, name.end()) if quoted else None
        if match is None:
            quoted = False  # an open quote: from here on, tags end at the next '>'
            end = html.find(">", name.end())
            end = size if end < 0 else end + 1
        else:
            end = match.end()
        attributes, at = html[name.end() : end - 1], end
        if html[lt + 1] == "/":
            if opened.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        for e in stack[i:]:
                            opened[e.tag] -= 1
                        close(i)
                        break
            elif tag in ("p", "br"):
                pieces.append((stack[-1], " "))
            continue
        if tag not in INLINE:
            index = open_at(_ENDS_SAME[tag]) if tag in _ENDS_SAME else 0
            if not index and opened.get("p"):
                index = open_at(("p",))
            if index and tag != "br":
                for e in stack[index:]:
                    opened[e.tag] -= 1
                close(index)
            pieces.append((stack[-1], " "))
        if tag in VOID or tag in ("html", "body"):
            continue
        parent = stack[-1]
        element = _Element(tag, parent, _set_aside(tag, attributes, parent.article is not None))
        element.named = _named(tag, attributes, parent.article is not None)
        element.kind = _class_of(attributes) if len(attributes) > 2 else ""
        elements.append(element)
        if tag in RAW:
            found = _RAW_END[tag].search(html, at)
            stop = found.start() if found else size
            end = html.find(">", stop) if found else size
            at = size if end < 0 else end + 1
            continue
        if not attributes.endswith("/") or tag not in ("svg", "math"):
            stack.append(element)
            opened[tag] = opened.get(tag, 0) + 1
    return elements, pieces


def _density(element: _Element) -> float:
    return element.links / element.chars if element.chars else 0.0


def _prose(chars: int, commas: int) -> float:
    return commas + min(chars / 100, 3) + (chars >= 25)


def _take_back(elements: list[_Element], pieces: list[tuple[_Element, str]]) -> None:
    """Set elements aside by name, unless their paragraph points tell that they hold the content.

    A named element stays when it has paragraph points and no prose, that is no paragraph of
    ``LEAST_PROSE`` characters, stays without it in its article or main element, or on the page (if
    no article stays there). One that holds an article or main element stays if none does without
    it and it has a quarter of the points that stay. Talk is looked at last. Outer elements come
    first.
    """
    if not any(e.named for e in elements):
        return
    counts: dict[_Element, list[int]] = {}  # per block: characters, those in links, commas
    for element, text in pieces:
        if text != " " and not element.aside:
            count = counts.setdefault(element.block, [0, 0, 0])
            chars = len(text) - text.count(" ")
            count[0] += chars
            count[1] += chars * element.linked
            count[2] += text.count(",")
    # Points under each named element (None: the page) with none nearer, and in its articles; sums
    # with named elements inside, but talk; prose in each article that no name in it holds.
    near: dict[_Element, _Element | None] = {}
    direct: dict[_Element | None, float] = {None: 0.0}
    articles: dict[_Element | None, float] = {None: 0.0}
    prose: dict[_Element | None, float] = {None: 0.0}  # points of long paragraphs alone
    staying_prose: dict[_Element, float] = {}
    for element in elements:
        parent = element.parent
        near[element] = element if element.named else parent and near[parent]
        chars, linked, commas = counts.get(element, (0, 0, 0))
        points = _prose(chars, commas) * (1 - linked / chars) if chars else 0.0
        name, article = near[element], element.article
        direct[name] = direct.get(name, 0.0) + points
        long = points if chars >= LEAST_PROSE else 0.0
        prose[name] = prose.get(name, 0.0) + long
        if article is not None and near[article] is name:
            staying_prose[article] = staying_prose.get(article, 0.0) + long
        if article is not None:
            articles[name] = articles.get(name, 0.0) + points
    gain, holds = dict(direct), dict(articles)
    named = [e for e in elements if e.named]
    for element in reversed(named):
        outer = near[element.parent]
        if outer is not None and element.named != "talk":
            gain[outer] += gain[element]
            holds[outer] = holds.get(outer, 0.0) + holds.get(element, 0.0)
    back: set[_Element | None] = {None}
    page, in_articles, page_prose = direct[None], articles[None], prose[None]
    for kind in ("block", "talk"):
        for element in named:
            article, points = element.article, gain[element]
            if element.named != kind or near[element.parent] not in back or not points:
                continue
            if article is not None:
                much = not staying_prose.get(article)
            elif holds.get(element) and kind != "talk":
                much = not in_articles and (points * 4 >= page or not page_prose)
            else:
                much = not in_articles and not page_prose
            if much:
                back.add(element)
                page += direct[element]
                page_prose += prose[element]
                in_articles += articles.get(element, 0.0)
                if article is not None:
                    staying_prose[article] = staying_prose.get(article, 0.0) + prose[element]
    for element in elements:
        parent = element.parent
        gone = bool(element.named) and element not in back
        element.aside = element.aside or gone or (parent is not None and parent.aside)


def _score(elements: list[_Element], pieces: list[tuple[_Element, str]]) -> None:
    """Points, characters and links of every element, children before parents."""
    for element, text in pieces:
        if text != " " and not element.aside:
            chars = len(text) - text.count(" ")
            block = element.block
            block.own += chars
            block.chars += chars
            block.commas += text.count(",")
            if element.linked:
                block.links += chars
    for element in reversed(elements):  # children before parents
        parent, block = element.parent, element.block
        points = _prose(element.own, element.commas)
        points *= 1 - _density(element)
        if block is not element or not element.own:
            pass
        elif element.tag in PARAGRAPHS and parent is not None:
            parent.points += points
        else:  # text that stands in a container itself
            element.points += points
        if parent is None:
            break
        parent.points += element.points / 2
        if block is element:
            parent.chars += element.chars
            parent.links += element.links


def _best(elements: list[_Element]) -> tuple[_Element | None, float]:
    """The best container and its score; the page's one article or main element, if there is one."""
    for tag in ("article", "main"):
        alone = [e for e in elements if e.tag == tag and e.points > 0 and not e.aside and e.parent.article is None]
        inside = [e for e in elements if e.tag == tag and e.points > 0 and not e.aside]
        for found in (alone, inside):
            if len(found) == 1:
                outer = found[0].parent.article
                if outer is None or 4 * found[0].points >= outer.points:
                    return found[0], found[0].points * (1 - _density(found[0]))
    best, most = None, 0.0
    for element in elements:
        if element.aside or element.block is not element or element.tag in PARAGRAPHS:
            continue
        score = element.points * (1 - _density(element))
        if score > most and element.chars:
            best, most = element, score
    if best is not None and best.article is not None:
        best = best.article
    return best, most


def main_text(html: str | None) -> str:
    if not html:
        return ""
    elements, pieces = _parse(html)
    _take_back(elements, pieces)
    _score(elements, pieces)
    best, most = _best(elements)
    kept = best if best is not None else elements[0]
    kept.kept = True
    whole = best is not None and best.tag in ("article", "main")
    if best is not None and not whole:
        heads = True  # until the best element is passed
        for element in elements:
            heads = heads and element is not best
            if element.parent is best.parent and element is not best and not element.aside:
                score = element.points * (1 - _density(element))
                plain = element.tag in PARAGRAPHS and element.chars > 80
                alike = element.tag == best.tag and element.kind == best.kind and (element.tag == "section" or element.kind)
                element.kept = (
                    (score >= 0.2 * most and score > 1)
                    or (plain and _density(element) < 0.25)
                    or bool(alike and _density(element) < 0.5)
                    or (heads and element.tag in HEADINGS)
                )
    for element in elements[1:]:
        element.kept = element.kept or element.parent.kept
    for element in elements[1:]:
        mostly_links = not whole and element.tag in ("ul", "ol", "div", "section", "table", "dl")
        if mostly_links and _density(element) > 0.5 and element is not kept:
            element.aside = True
        elif element.parent.aside:
            element.aside = True
    out = [
        text if element.kept and not element.aside else " " for element, text in pieces
    ]
    return " ".join("".join(out).split())


def _texts(pages: pa.Array) -> list[pa.Array]:
    texts = [main_text(page) for page in pages.to_pylist()]
    return [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]


def extract(pages: DataFrame, html: str = "html", keep_html: bool = True) -> DataFrame:
    """Add the main text and its length in code points."""
    return add_columns(
        pages, _texts, [html], "text string, n_chars bigint", () if keep_html else (html,)
    )
