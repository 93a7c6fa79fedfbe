"""Main text of web pages by wrapper induction.

For each host up to ``REFERENCES`` pages with different html are aligned by simple tree matching (the
largest order-preserving match of two trees whose roots agree): nodes that all of them have and
texts that are the same in all of them make the host's template, the other texts are its varying
slots. Each page of the host is then aligned with this wrapper; its template texts go, and what remains of
the content region is the article. Sibling blocks of one kind in a row count as one repeated node.

The content region is the smallest container with most (``REGION_SHARE``) of the page's varying text, with the
headings before it; it doesn't narrow past paragraphs beside it or to one of several sections. Tags are
hints: an article is never narrowed, and where the articles of the region hold half of its text or more, all
top-level ones of them are the article; otherwise the small ones are teasers and go. Elements that say what they are
(nav, aside, form, role "banner", ...) are left out, and so are articles inside an article, which are
reader comments. Class names and ids are hints: one counts if all words of the whole name say so ("cookie-notice", not
"notice-board"), never on a paragraph, heading or list item, and inside the region only as long as the blocks so named
hold less than ``NAMED_SHARE`` of its text. Where
nothing marks the region, blocks that are mostly links go too. A template needs ``SUPPORT`` references and
texts that vary for the larger part, so copies of one page don't become their own template.

The template finds the region and clears its edges: what stands in an article, or between varying texts of
the region, is never removed for being constant - headings that every recipe of a host has belong to the recipe.

The references only align. What is constant is also counted over all pages of a host: texts that a share of its
different pages has at the same place (the labels from the root down) join the template, in hosts of two pages or
more; in hosts with fewer than ``SUPPORT`` pages all of them must have it, and texts inside articles stay.

Defined results: a null or empty html has an empty text; a null url, or one without a host, has
no wrapper; repeated rows get equal results; an empty table gives no rows; pages cut off anywhere are read as
far as they go. Other columns are not looked at and may have any name.
"""

from __future__ import annotations

import json
from collections.abc import Collection
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .dom import WORDS, Node, parse, walk

REFERENCES, SUPPORT, VARYING = 8, 5, 0.5
#: A text that this share of a host's pages has at one place belongs to the template, so that of a second layout too.
TEMPLATE_SHARE = 0.2
#: Nodes deeper than this are not aligned.
DEPTH = 60
#: Paragraphs beside a block with this share of the page's varying text keep the region from narrowing to the block.
LINK_SHARE, REGION_SHARE, BESIDE = 0.5, 0.7, 0.05
CONTAINERS = frozenset("article body center div main section".split())
PROSE = frozenset("p blockquote ul ol dl pre table".split())
HEADINGS = frozenset("h1 h2 h3 hgroup".split())
#: Blocks of text themselves, which names say nothing about.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split())
#: Blocks that only their names mark go while they hold less than this share of the region's text.
NAMED_SHARE = 1 / 3
#: Children that are compared on either side of the diagonal when two long sequences are aligned.
BAND = 64

SIDE_TAGS = frozenset("nav footer aside form menu dialog search".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
SIDE_WORDS = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs footer sidebar sidebars ad ads advert adverts advertisement
advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login
social share sharing related recommended recommendations comment comments commentlist disqus replies reply respond responses
popup modal overlay pagination pager widget widgets toolbar skip""".split())
HEAD_WORDS = frozenset("header masthead topbar banner".split())


#: Words that may stand beside the others in a name.
PLAIN_WORDS = frozenset("""area bar block body bottom box button buttons col column container content form global group inner item items left link links
list main outer page panel post posts primary right secondary section site slot top wrap wrapper""".split())


@lru_cache(4096)
def _named(names: str, words: frozenset) -> bool:
    """Whether one of the names (classes, id) says one of the words and nothing else of its own."""
    return any(found & words and found <= words | PLAIN_WORDS for name in names.split() for found in [set(WORDS.findall(name))])


def _names(attrs: dict[str, str]) -> str:
    return f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _side(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element says that it isn't the article, by its kind or by its name."""
    return _side_kind(tag, attrs) or _side_name(tag, attrs)


def _side_kind(tag: str, attrs: dict[str, str]) -> bool:
    if tag in ("html", "body", "article", "main") and not _hidden(attrs):
        return False
    return tag in SIDE_TAGS or attrs.get("role", "").lower() in SIDE_ROLES or _hidden(attrs)


def _side_name(tag: str, attrs: dict[str, str]) -> bool:
    return tag not in ("html", "body", "article", "main") and tag not in TEXT_TAGS and _named(_names(attrs), SIDE_WORDS)


def _page_head(node: Node) -> bool:
    return node.tag == "header" or node.tag not in ("html", "body", "article", "main") and _named(_names(node.attrs), HEAD_WORDS)


def _inline_side(tag: str, attrs: dict[str, str]) -> bool:
    return tag in SIDE_TAGS or bool(attrs) and (_hidden(attrs) or _named(_names(attrs), SIDE_WORDS))


def read(html: str) -> Node:
    return parse(html, _inline_side).root


# Alignment. A group is [label, member nodes, child groups]: one block, or leaf blocks of one label in a row.

def grouped(node: Node, depth: int = 0) -> list:
    children = []
    for part in node.parts if depth < DEPTH else ():
        if isinstance(part, Node):
            group = grouped(part, depth + 1)
            if children and not group[2] and not children[-1][2] and children[-1][0] == group[0]:
                children[-1][1].append(part)
            else:
                children.append(group)
    return [node.label, [node], children]


def tree_match(a: list, b: list) -> tuple[int, list]:
    """Size of the largest order-preserving match of two group trees, and its pairs of groups.

    Children are compared within ``BAND`` places of the diagonal (or the difference of the lengths, if
    larger by no more), so time and memory grow with the longer sequence, not with the product; up to ``BAND``
    children the match is the largest.
    """
    if a[0] != b[0]:
        return 0, []
    x, y = a[2], b[2]
    if not x or not y:
        return 1, [(a, b)]
    slope = len(y) / len(x)
    known: dict[tuple[int, int], tuple[int, list]] = {}  # matches of children that have children
    steps, above, low = [], [0] * (len(y) + 1), 0
    for i in range(1, len(x) + 1):
        mid = round(i * slope)
        first, last = max(1, mid - BAND), min(len(y), mid + BAND)
        row, step, left = [0] * (last + 1 - first), bytearray(last + 1 - first), 0
        for j in range(first, last + 1):
            up = above[j - low] if j - low < len(above) else above[-1]
            corner = above[j - 1 - low] if 0 <= j - 1 - low < len(above) else above[-1] if j - 1 >= low else 0
            best, way = (up, 1) if up >= left else (left, 2)
            if x[i - 1][0] == y[j - 1][0]:
                size = 1
                if x[i - 1][2] and y[j - 1][2]:
                    size = known.setdefault((i, j), tree_match(x[i - 1], y[j - 1]))[0]
                if corner + size > best:
                    best, way = corner + size, 3
            row[j - first], step[j - first], left = best, way, best
        steps.append((first, step))
        above, low = row, first
    total, i, j, pairs = above[-1], len(x), steps[-1][0] + len(steps[-1][1]) - 1, [(a, b)]
    while i and j:
        first, step = steps[i - 1]
        way = 2 if j - first >= len(step) else step[j - first] if j >= first else 1
        if way == 1:
            i -= 1
        elif way == 2:
            j -= 1
        else:
            pairs += known[i, j][1] if (i, j) in known else [(x[i - 1], y[j - 1])]
            i, j = i - 1, j - 1
    return total + 1, pairs


def _texts(group: list) -> list[str]:
    return [t for n in group[1] if isinstance(n, Node) for t in n.texts()]


def induce(pages: list[str]) -> list | None:
    """The wrapper of pages of one host: [label, constant texts, children], or None without support."""
    if len(pages) < SUPPORT:
        return None
    base = grouped(read(pages[0]))
    stats = {}  # by identity of the base's groups: how many pages have it, texts that all have

    def all_groups():
        todo = [base]
        while todo:
            g = todo.pop()
            yield g
            todo += g[2]

    for g in all_groups():
        stats[id(g)] = [1, set(_texts(g))]
    for html in pages[1:]:
        for mine, other in tree_match(base, grouped(read(html)))[1]:
            stats[id(mine)][0] += 1
            stats[id(mine)][1] &= set(_texts(other))
    total = constant = 0
    for g in all_groups():
        same = stats[id(g)][1] if stats[id(g)][0] == len(pages) else set()
        g[1] = [sorted(same), _texts(g)]
        total += sum(map(len, g[1][1]))
        constant += sum(len(t) for t in g[1][1] if t in same)
    if constant > (1 - VARYING) * total:
        return None  # copies of one page

    def plain(g, depth=0):
        return [g[0], g[1][0], [plain(c, depth + 1) for c in g[2]]]
    return plain(base)


@lru_cache(256)
def _wrapper(text: str):
    return json.loads(text)


def _weigh(root: Node) -> tuple[dict[int, int], list[Node]]:
    """Characters of varying text in each node that may belong to the article, and the top-level articles."""
    order, articles, todo = [], [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node is not root and (_side(node.tag, node.attrs) or (node.tag == "article" if inside else _page_head(node))):
            continue
        order.append(node)
        if node.tag == "article":
            articles.append(node)
        todo += [(p, inside or node.tag == "article") for p in reversed(node.parts) if isinstance(p, Node)]
    weight: dict[int, int] = {}
    for node in reversed(order):
        texts = node.texts()
        own = sum(len(t) for t in texts if t not in node.template) if node.links <= LINK_SHARE * sum(map(len, texts)) else 0
        weight[id(node)] = own + sum(weight.get(id(p), 0) for p in node.parts if isinstance(p, Node))
    return weight, articles


def _region(root: Node, weight: dict[int, int], articles: list[Node]) -> tuple[list[Node], set[int], bool]:
    """The blocks that hold the article, articles in them that don't belong to it, and whether the page marks the blocks."""
    total, region, titles = weight[id(root)], root, []
    if not total:  # nothing varies or all is links
        return (articles, set(), True) if articles else ([root], set(), False)
    while region.tag != "article":
        children = [p for p in region.parts if isinstance(p, Node) and weight.get(id(p))]
        best = max((c for c in children if c.tag in CONTAINERS), key=lambda c: weight[id(c)], default=None)
        if best is None or weight[id(best)] < REGION_SHARE * total:
            break
        if best.tag in ("article", "section") and sum(c.tag == best.tag for c in children) > 1:
            break  # parts of one article, or several of them
        if best.tag != "article" and sum(weight[id(c)] for c in children if c.tag in PROSE) >= BESIDE * total:
            break  # paragraphs beside it belong to the same body
        if best.tag != "article":
            titles += [c for c in children[:children.index(best)] if c.tag in HEADINGS]
        region = best
    if region.tag == "article":
        return [region], set(), True
    marked = region.tag == "main" or region.attrs.get("role") == "main"
    below, todo = set(), [region]
    while todo:
        node = todo.pop()
        below.add(id(node))
        todo += [p for p in node.parts if isinstance(p, Node)]
    held = [a for a in articles if id(a) in below]
    if held and 2 * sum(weight[id(a)] for a in held) >= weight[id(region)]:
        return [a for a in held if weight[id(a)]], set(), True
    teasers = {id(a) for a in held if weight[id(a)] < (1 - REGION_SHARE) * weight[id(region)]}
    return [*titles, region], teasers, marked


def placed_texts(root: Node):
    """(node, text, key, whether inside an article) of each own text; the key stands for the labels down to the node and the text."""
    todo = [(root, b"", False)]
    while todo:
        node, above, inside = todo.pop()
        path, inside = blake2b(above + node.label.encode("utf-8", "replace"), digest_size=8).digest(), inside or node.tag == "article"
        for t in node.texts():
            yield node, t, int.from_bytes(blake2b(path + t.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True), inside
        todo += [(p, path, inside) for p in node.parts if isinstance(p, Node)]


def main_text(html: str | None, wrapper: str | None = None, shared: Collection[int] = ()) -> str:
    """``shared`` are keys of texts that a share of the host's pages has at the same place."""
    if not html:
        return ""
    root = read(html)
    if wrapper:
        for known, group in tree_match(_wrapper(wrapper), grouped(root))[1]:
            for node in group[1] if known[1] else ():
                node.template = known[1]
    if shared:
        for node, t, key, _ in placed_texts(root):
            if key in shared:
                node.template = {*node.template, t}
    weight, articles = _weigh(root)
    regions, teasers, marked = _region(root, weight, articles)
    out = [t for region in regions for t in _region_texts(region, teasers, marked)]
    return "\n\n".join(out)


def _region_texts(region: Node, teasers: set[int], marked: bool) -> list[str]:
    """The texts of a region without what marks itself as something else and, outside articles, the template's at its edges."""
    head = region.tag != "article"

    def other(node: Node) -> bool:  # not the article, whatever its name
        return node is not region and (id(node) in teasers or _side_kind(node.tag, node.attrs) or (
            _page_head(node) if head and node.tag != "article" else node.tag == "article" and not head))

    def named(node: Node) -> bool:
        return node is not region and _side_name(node.tag, node.attrs)

    whole = [*walk(region, other)]
    blocks = [*walk(region, lambda m: other(m) or named(m))]
    size = lambda found: sum(len(t) for _, t in found)
    if size(whole) - size(blocks) >= NAMED_SHARE * size(whole):
        blocks = whole  # so much text isn't a side matter, whatever its name
    if not marked:
        blocks = [(n, t) for n, t in blocks if n.links <= LINK_SHARE * sum(map(len, n.texts()))]
    if head:
        varying = [k for k, (n, t) in enumerate(blocks) if t not in n.template]
        blocks = blocks[varying[0]:varying[-1] + 1] if varying else []
    return [t for _, t in blocks]


def _induce_host(rows: pd.DataFrame) -> pd.DataFrame:
    wrapper = induce(rows.sort_values("cls")["html"].tolist())
    return pd.DataFrame({"host": rows["host"][:1], "wrapper": [wrapper and json.dumps(wrapper, ensure_ascii=False)]})


def host_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, wrapper)`` of each host with enough different pages."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).where("host <> '' AND html <> ''")
    rows = rows.select("host", "html", F.xxhash64(F.lit(1), "html").alias("h")).withColumn("cls", F.pmod("h", F.lit(REFERENCES)))
    refs = rows.groupBy("host", "cls").agg(F.min_by("html", "h").alias("html"))
    return refs.groupBy("host").applyInPandas(_induce_host, "host string, wrapper string").where("wrapper IS NOT NULL")


def _place(batches):
    for b in batches:
        rows = []
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            page = int.from_bytes(blake2b(html.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
            found = {key: (len(t), inside) for _, t, key, inside in placed_texts(read(html))}
            rows += [(host, page, None, 0, False), *((host, page, key, *x) for key, x in found.items())]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["host", "page", "key", "size", "inside"])


def host_templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, shared)``: keys of the texts that ``TEMPLATE_SHARE`` of all different pages of a host have at one place.

    A host with fewer than ``SUPPORT`` pages needs all of them, two at least, and keeps what stands inside articles. As
    in ``induce``, a host whose text is the same for the larger part has no template.
    """
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).where("host <> '' AND html <> ''")
    placed = rows.mapInArrow(_place, "host string, page long, key long, size long, inside boolean").distinct()
    texts = cut(placed.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("inside").alias("inside")), "placed-texts")
    hosts = texts.groupBy("host").agg(F.max(F.when(F.col("key").isNull(), F.col("n"))).alias("n_pages"), F.sum(F.col("n") * F.col("size")).alias("chars"))
    often = texts.where("key IS NOT NULL AND n >= 2").join(hosts, "host").where(
        F.when(F.col("n_pages") >= SUPPORT, (F.col("n") >= SUPPORT) & (F.col("n") >= TEMPLATE_SHARE * F.col("n_pages")))
        .otherwise((F.col("n") == F.col("n_pages")) & ~F.col("inside")))
    return often.groupBy("host").agg(F.collect_list("key").alias("shared"), F.sum(F.col("n") * F.col("size")).alias("same"), F.max("chars").alias("chars")).where(
        F.col("same") <= (1 - VARYING) * F.col("chars")).select("host", "shared")


def host_of(url):
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _extract(names: list[str]):
    def run(batches):
        sets: dict[str, frozenset] = {}
        for b in batches:
            hosts, htmls, wrappers, shared = (b.column(k).to_pylist() for k in range(b.num_columns - 4, b.num_columns))
            text = []
            for host, html, wrapper, keys in zip(hosts, htmls, wrappers, shared, strict=True):
                if keys and host not in sets:
                    if len(sets) >= 256:
                        sets.clear()
                    sets[host] = frozenset(keys)
                text.append(main_text(html, wrapper, sets[host] if keys else ()))
            yield pa.record_batch([*b.columns[:-4], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=names)
    return run


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    known = cut(host_wrappers(pages, url, html).join(host_templates(pages, url, html), "host", "full"), "wrappers").withColumnRenamed("host", "w_host")
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    rows = rows.join(known, rows["host"] == known["w_host"], "left").select("page_id", "url", "host", "html", "wrapper", "shared")
    return rows.mapInArrow(_extract(["page_id", "url", "text", "n_chars"]), f"page_id {kind}, url string, text string, n_chars long")
