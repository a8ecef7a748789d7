"""HTML to leaf blocks: runs of text between block-level tags, each with the path of its open elements.

Time and memory grow with the length of the page, whatever its tags: open elements are found by the places
where each tag stands on the stack, and paths are pointers to parents with a bit set that grows by one element.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from functools import lru_cache
from html import unescape

# Elements that don't break a block, that have no content, and whose content isn't page text.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow msup msub mfrac msqrt mroot mover munder msubsup munderover mstyle semantics".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template textarea iframe noframes svg title annotation annotation-xml".split())
#: Of these those that may close themselves.
FOREIGN = set("svg math annotation annotation-xml".split())
#: What an opening tag closes: tag -> (elements closed, elements beyond which nothing is).
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*+)>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TAG = re.compile(r"</?[A-Za-z]")
#: Elements that hold one paragraph or cell: what stands around them is their container.
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 li pre blockquote dt dd td th figcaption".split())
#: Places of the hashed tag-path vector.
PATH = 256


@lru_cache(4096)
def place(word: str) -> int:
    """The bit of a path word."""
    return 1 << zlib.crc32(word.encode()) % PATH


class Node:
    """An open element: its parent, tag and class, id and role words, and the bits of all elements down to it."""

    __slots__ = ("parent", "tag", "words", "bits")

    def __init__(self, parent: Node | None, tag: str, words: tuple[str, ...]):
        self.parent, self.tag, self.words = parent, tag, words
        self.bits = parent.bits if parent else 0
        if tag not in INLINE and tag not in ("html", "body"):
            for w in (tag, *words):
                self.bits |= place(w)


class Block:
    """A run of text with the element it stands in."""

    __slots__ = ("text", "node", "link")

    def __init__(self, text: str, node: Node | None, link: int):
        self.text, self.node, self.link = text, node, link  # link: characters inside links

    def bits(self) -> int:
        """The hashed path, and the innermost block element once more as such."""
        node = self.node
        while node and (node.tag in INLINE or node.tag in ("html", "body")):
            node = node.parent
        return (self.node.bits if self.node else 0) | (place(f"last {node.tag}") if node else 0)

    def container(self) -> Node | None:
        """The block element around the block's paragraph."""
        node = self.node
        while node and node.tag in INLINE:
            node = node.parent
        return node.parent if node and node.tag in PARAGRAPHS else node

    def path(self) -> list[str]:
        """Tags and words of the open block elements, outermost first."""
        out, node = [], self.node
        while node:
            if node.tag not in INLINE and node.tag not in ("html", "body"):
                out[:0] = (node.tag, *node.words)
            node = node.parent
        return out


def _words(attributes: str) -> tuple[str, ...]:
    out = []
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop"):
            out += ["." + w.lower() for w in NAME.findall(unescape(value))]
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or name == "aria-hidden" and value == "true":
            out.append(".hidden")
    return tuple(out)


class _Open:
    """The open elements, and for each tag where it stands among them."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.at: dict[str, list[int]] = defaultdict(list)

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        for key in (tag, "" if tag in INLINE else "block"):
            self.at[key].append(len(self.nodes))
        self.nodes.append(Node(self.nodes[-1] if self.nodes else None, tag, words))

    def cut(self, depth: int) -> None:
        """Closes everything from a depth on."""
        while len(self.nodes) > depth:
            tag = self.nodes.pop().tag
            self.at[tag].pop()
            self.at["" if tag in INLINE else "block"].pop()


class _Ends:
    """Where the content of elements without page text ends."""

    def __init__(self, html: str):
        self.html = html
        self.last: dict[str, int] = {}  # by tag: its last end tag in the page

    def past(self, tag: str, at: int) -> int:
        """Behind the end tag; without one the content reaches to the next tag of any kind."""
        end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)
        if tag not in self.last:
            self.last[tag] = max((m.start() for m in end.finditer(self.html)), default=-1)
        if at <= self.last[tag]:
            return self.html.find(">", end.search(self.html, at).end()) + 1 or len(self.html)
        following = TAG.search(self.html, at)
        return following.start() if following else len(self.html)


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks in page order: references decoded, white space one space, ends trimmed, empty ones left out.

    References are decoded in each run of text between tags, so none comes about across a tag. Only the
    content of scripts, styles and the like is left out; all else is a block for the labeller.
    """
    html = html or ""
    stack = _Open()
    out: list[Block] = []
    parts: list[str] = []
    link, at, end = 0, 0, len(html)
    node: Node | None = None

    def flush() -> None:
        nonlocal link, node
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, node, min(link, len(text))))
        parts.clear()
        link, node = 0, None

    def add(text: str) -> None:
        nonlocal link, node
        if text:
            text = unescape(text)
            if not text.isspace():
                node = node or (stack.nodes[-1] if stack.nodes else None)
            parts.append(text)
            if stack.at.get("a"):
                link += len(text.strip())

    ends = _Ends(html)
    while at < end:
        lt, run = html.find("<", at), at
        while lt >= 0 and not (html[lt + 1 : lt + 2].isalpha() or html[lt + 1 : lt + 2] in ("/", "!", "?")):
            lt = html.find("<", lt + 1)  # a plain less-than sign
        m = TOKEN.match(html, lt) if lt >= 0 else None
        if not m:  # the last run, or a tag that never ends
            add(html[run : lt if lt >= 0 else end])
            break
        add(html[run:lt])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE and tag != "br":
                flush()
            depth = stack.last(tag)
            if depth >= 0 and not (tag in INLINE and stack.last("block") > depth):
                stack.cut(depth)
            continue
        itself = m[3].endswith("/")
        if tag in RAW:
            if not (itself and tag in FOREIGN):
                at = ends.past(tag, at)
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            closed, barrier = CLOSES.get(tag, ((), ()))
            while (depth := stack.last(*closed)) > stack.last(*barrier):
                stack.cut(depth)
            last = stack.last("block")
            if last >= 0 and stack.nodes[last].tag == "p":  # a block ends an open paragraph
                stack.cut(last)
        if tag not in VOID and not (itself and tag in FOREIGN):
            stack.push(tag, _words(m[3]))
    flush()
    return out
