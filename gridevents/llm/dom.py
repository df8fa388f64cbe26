"""A forgiving reader of HTML: a tree of elements with text, as browsers would build it roughly."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; none of it is text of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr br img picture".split())
#: Elements that end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
                    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt body".split())
#: Elements that end an open element of the second set, up to one of the third.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
           "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
           "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})}
#: An attribute as the HTML standard reads it: a value without a leading quote ends at white space or ``>``.
_VALUE = r"""\s*+=\s*+(?>"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))?+"""
_ATTRIBUTE = re.compile(rf"([^\s/>=][^\s/>=]*+)(?>{_VALUE})?+")
_PLAIN_VALUE = re.sub(r"\((?=\[)", "(?:", _VALUE)
_TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[\s/]++|[^\s/>][^\s/>=]*+(?>{_PLAIN_VALUE})?+)*+)(?:>|\Z)|[^<]+|<", re.S)
_SLASH_IN_VALUE = re.compile(r"=\s*[^\s\"'>][^\s>]*/$")
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_LAYOUT = frozenset("has with no without is layout".split())
_CONTENT = frozenset("article content post story entry".split())
_HEADINGS = frozenset("header title headline".split())


class Node:
    """An element: ``parts`` are its text runs (strings) and child elements (nodes) in page order."""
    __slots__ = ("tag", "tokens", "parent", "depth", "parts", "hidden")

    def __init__(self, tag: str, tokens: tuple[str, ...], parent: "Node | None", hidden: bool = False):
        self.tag, self.tokens, self.parent, self.hidden = tag, tokens, parent, hidden
        self.depth = parent.depth + 1 if parent else 0
        self.parts: list = []


def _attributes(text: str) -> tuple[tuple[str, ...], bool]:
    """Words of class, id and role, and whether the element is hidden."""
    found, hidden = [], False
    for name, one, two, three in _ATTRIBUTE.findall(text):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "data-role", "aria-label"):
            for word in html.unescape(one or two or three).split():
                parts = [w.lower() for w in _SPLIT.findall(word)]
                if len(parts) > 1 and (parts[0] in _LAYOUT or parts[-1] in _HEADINGS and parts[0] in _CONTENT):
                    parts = parts[:1]  # has-sidebar says that there is one elsewhere, entry-header is part of the entry
                found += parts
        elif name == "style":
            hidden |= "display:none" in (one or two or three).replace(" ", "").lower()
        elif name == "hidden":
            hidden = True
    return tuple(found), hidden


def parse(page: str) -> Node:
    """The root of the page; inline elements are kept as nodes only if they have attributes.

    Unknown end tags are ignored, open elements end where a browser would end them; a comment
    or tag without end takes the rest of the page.
    """
    root = Node("html", (), None)
    open_nodes, names = [root], ["html"]
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m.group(2)
        if name is None:
            text = m.group()
            if text[0] != "<" or text == "<":
                open_nodes[-1].parts.append(text)
            continue
        name = name.lower()
        if m.group(1):
            if name in names[1:] and name not in ("body", "html"):
                while names.pop() != name:
                    open_nodes.pop()
                open_nodes.pop()
            elif name == "br":
                open_nodes[-1].parts.append(" ")
            continue
        if name in ("html", "body", "head") and name in names:
            continue
        if name == "br" or name == "wbr":
            open_nodes[-1].parts.append(" " if name == "br" else "")
            continue
        closed = m.group(3).endswith("/") and not _SLASH_IN_VALUE.search(m.group(3))
        if name in RAW and not closed:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name == "body" and "head" in names:
            _end(open_nodes, names, {"head"}, set())
        if name in _ENDS_P and "p" in names:
            _end(open_nodes, names, {"p"}, {"table", "button", "td", "th", "object"})
        if name[0] == "h" and name[1:].isdigit() and names[-1][0] == "h" and names[-1][1:].isdigit():
            names.pop()
            open_nodes.pop()
        if name in _CLOSES:
            _end(open_nodes, names, *_CLOSES[name])
        tokens, hidden = _attributes(m.group(3)) if len(m.group(3)) > 3 else ((), False)
        node = Node(name, tokens, open_nodes[-1], hidden)
        open_nodes[-1].parts.append(node)
        if name not in VOID and not closed:
            open_nodes.append(node)
            names.append(name)
    return root


def _end(open_nodes: list, names: list, ends: set, limits: set) -> None:
    """Ends the outermost open element of ``ends`` above the last one of ``limits``."""
    low = max((i for i, n in enumerate(names) if n in limits), default=0)
    for i in range(low + (names[low] in limits), len(names)):
        if names[i] in ends:
            del names[i:], open_nodes[i:]
            return
