"""Block trees of web pages: block elements as nodes, inline markup flattened into their text."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from itertools import groupby

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot
th thead tr ul""".split())
#: Elements whose content is never text of the page.
MUTE = frozenset("head script style noscript template title iframe object svg canvas audio video math select option datalist button textarea".split())
#: A new one ends an open one of the set, unless a container stands between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "body": {"head"}}
HOLDS = {"ul", "ol", "dl", "table", "menu", "article", "section", "div", "body"}


class Node:
    __slots__ = ("tag", "attrs", "parts", "links", "template")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.parts: list = []  # text and Nodes, in page order
        self.links = 0  # characters of own text inside links
        self.template = ()  # own texts that belong to the site's template

    @property
    def label(self) -> str:
        return f"{self.tag}.{'.'.join(sorted(self.attrs.get('class', '').split()))}"

    def texts(self) -> list[str]:
        """Own text between child blocks, white space as one space, empty ones left out."""
        return [t for p in self.parts if isinstance(p, str) and (t := " ".join(p.split()))]


class _Reader(HTMLParser):
    def __init__(self, mute_inline):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.stack: list[tuple[str, Node | None, bool]] = [("#", self.root, False)]  # tag, its node, whether it is silent
        self.open: Counter[str] = Counter()  # tags on the stack
        self.nodes, self.silent, self.in_link = [self.root], 0, 0
        self.mute_inline = mute_inline
        self.title, self.links, self.lang = [], [], None

    def _pop(self):
        tag, node, silent = self.stack.pop()
        self.open[tag] -= 1
        self.silent -= silent
        self.in_link -= tag == "a"
        if node is not None:
            self.nodes.pop()

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag == "a" and "href" in attrs:
            self.links.append(attrs["href"])
        if tag in VOID:
            if tag in ("br", "wbr", "hr", "img") and not self.silent:
                self._add(" " if tag != "hr" else Node("hr", {}))
            return
        if tag == "html":
            self.lang = attrs.get("lang", self.lang)
            return
        if tag in BLOCK and self.open["p"]:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] == "p":
                    while len(self.stack) > k:
                        self._pop()
                    break
                if self.stack[k][1] is not None:
                    break
        for k in range(len(self.stack) - 1, 0, -1) if tag in ENDS else ():
            open_ = self.stack[k][0]
            if open_ in ENDS[tag]:
                while len(self.stack) > k:
                    self._pop()
                if open_ not in ("td", "th") or tag != "tr":
                    break
            elif open_ in HOLDS:
                break
        node, silent = None, tag in MUTE or (tag not in BLOCK and self.mute_inline(tag, attrs))
        if tag in BLOCK:
            node = Node(tag, attrs)
            self._add(node)
            self.nodes.append(node)
        self.stack.append((tag, node, silent))
        self.open[tag] += 1
        self.silent += silent
        self.in_link += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash means nothing on elements that are not void

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            open_, node, _ = self.stack[k]
            if open_ == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if node is not None and tag not in BLOCK:
                return  # an inline end doesn't close a block

    def parse_comment(self, i, report=1):
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 else end  # one that never ends; the parser only asks where markup may stand

    def handle_data(self, data):
        if self.silent:
            if self.stack[-1][0] == "title":
                self.title.append(data)
            return
        self._add(data)
        if self.in_link:
            self.nodes[-1].links += len(data)

    def _add(self, part):
        self.nodes[-1].parts.append(part)

    def close(self):
        super().close()
        todo = [self.root]
        while todo:  # texts that no block parts are one
            node = todo.pop()
            node.parts = [x for is_text, run in groupby(node.parts, lambda p: isinstance(p, str)) for x in (["".join(run)] if is_text else run)]
            todo += [p for p in node.parts if isinstance(p, Node)]


def parse(html: str, mute_inline=lambda tag, attrs: False) -> _Reader:
    """The page's tree as ``root``, its ``title``, ``links`` and ``lang``."""
    reader = _Reader(mute_inline)
    reader.feed(_CUT_TAG.sub("", html))
    reader.close()
    return reader


def walk(root: Node, skip=lambda node: False):
    """(node, text) of each text in page order, without the nodes that ``skip`` names."""
    todo = [root]
    while todo:
        part = todo.pop()
        if isinstance(part, Node):
            if not skip(part):
                todo.extend((p if isinstance(p, Node) else (part, p)) for p in reversed(part.parts))
        elif text := " ".join(part[1].split()):
            yield part[0], text


def plain_text(html: str) -> str:
    return "\n\n".join(t for _, t in walk(parse(html).root))


#: A tag that the end of the page cuts off.
_CUT_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")
WORDS = re.compile(r"[a-z0-9]+")
