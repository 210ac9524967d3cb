"""A forgiving, fast HTML reader for content extraction: block elements, nested as browsers nest them, with their text."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without any page text of their own: scripts and styles, what stands in for them, what the head holds, and fields of forms.
DROPPED = frozenset("script style template noscript head title iframe select textarea datalist noembed noframes".split())
_RAW = frozenset("script style textarea title iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul xmp".split())
_ENDS_P = BLOCK - frozenset("tr td th tbody thead tfoot caption body html button legend summary".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
_P_SCOPE = frozenset("table td th caption button".split())
_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))|[!?/][^>]*+(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""(?<![^\s"'<>/=])([^\s"'<>/=]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_NAMES = re.compile(r"[a-z]+")
_ATTR_NAMES = frozenset(("class", "id", "role", "itemprop", "aria-label", "data-testid"))


class Node:
    """An element; inline elements give their text and links to the block around them.

    parts holds what the block contains in page order: texts, "\\n"-less, and child blocks.
    """

    __slots__ = ("tag", "tokens", "parent", "parts", "links", "mark")

    def __init__(self, tag: str, tokens: frozenset[str], parent: Node | None, mark: str = "") -> None:
        self.tag, self.tokens, self.parent, self.mark = tag, tokens, parent, mark
        self.parts: list[Node | str] = []
        self.links = 0  # characters in links, of the block itself


def parse(html: str | None) -> Node:
    """The tree of a page's blocks. Every text parses; what is no markup is text. Nesting does not recurse."""
    html = html or ""
    root = Node("#root", frozenset(), None)
    stack = Open(root)
    block, link, dropped, at = root, 0, 0, 0
    search = _TAG.search
    while True:
        m = search(html, at)
        end = m.start() if m else len(html)
        if end > at and not dropped:
            text = html[at:end]
            if "&" in text:
                text = unescape(text)
            block.parts.append(text)
            if link:
                block.links += len(text)
        if m is None:
            return root
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:  # an end tag
            if tag in VOID:
                if tag == "br":
                    block.parts.append(" ")
                continue
            if not stack.count[tag]:
                continue
            stack.close({tag}, frozenset() if tag in BLOCK or tag in DROPPED else BLOCK)
        else:
            if tag in VOID:
                if tag == "br":
                    block.parts.append(" ")
                elif tag == "hr":
                    block.parts.append(Node("hr", frozenset(), block))
                continue
            if tag in _RAW:
                close = re.compile(f"</{tag}[\\s/>]", re.I).search(html, at)
                at = close.start() if close else len(html)
                if close:
                    at = html.find(">", close.start())
                    at = at + 1 if at >= 0 else len(html)
                block.parts.append(" ") if tag not in ("script", "style") else None
                continue
            if m[3].endswith("/>") and (tag in ("svg", "math") or stack.count["svg"] or stack.count["math"]):
                continue
            if tag in ("html", "body") and stack.count[tag]:
                continue
            if tag in BLOCK and stack.count["head"]:
                stack.close({"head"}, frozenset())
            if tag in _CLOSES:
                stack.close(*_CLOSES[tag])
            if tag in _ENDS_P:
                stack.close({"p"}, _P_SCOPE)
            block = stack.blocks[-1]
            if tag in BLOCK:
                tokens, mark = frozenset(), ""
                if len(m[3]) > 4:
                    own: list[str] = []
                    for a, *v in _ATTR.findall(m[3]):
                        if (a := a.lower()) in _ATTR_NAMES:
                            own += _NAMES.findall("".join(v).lower())
                        elif a == "data-mark":
                            mark = "".join(v)
                    tokens = frozenset(own)
                child = Node(tag, tokens, block, mark)
                block.parts.append(child)
                if tag == "xmp":  # what it holds is text, whatever it looks like
                    close = re.compile(r"</xmp[\s/>]", re.I).search(html, at)
                    end = close.start() if close else len(html)
                    if not stack.dropped:
                        child.parts.append(html[at:end])
                    at = html.find(">", end) + 1 if close else len(html)
                    at = at or len(html)
                    continue
                stack.push(tag, child)
            else:
                stack.push(tag, block)
        block, link, dropped = stack.blocks[-1], stack.count["a"], stack.dropped


class Open:
    """The open elements, the block that each lies in or is, and how many there are of each, so that depth costs nothing."""

    def __init__(self, root: Node) -> None:
        self.tags, self.blocks, self.count, self.dropped = ["#root"], [root], Counter(), 0

    def push(self, tag: str, block: Node) -> None:
        self.tags.append(tag), self.blocks.append(block)
        self.count[tag] += 1
        self.dropped += tag in DROPPED

    def close(self, tags: set[str] | frozenset[str], keep: set[str] | frozenset[str]) -> None:
        """Close the innermost of the tags and all in it, unless one that keeps it open comes first."""
        if not any(self.count[t] for t in tags):
            return
        k = len(self.tags) - 1
        while self.tags[k] not in tags:
            if self.tags[k] in keep:
                return
            k -= 1
        for tag in self.tags[k:]:
            self.count[tag] -= 1
            self.dropped -= tag in DROPPED
        del self.tags[k:], self.blocks[k:]


def squeeze(text: str) -> str:
    """White space to single spaces, trimmed."""
    return " ".join(text.split())
