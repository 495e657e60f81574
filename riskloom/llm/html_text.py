"""Main text of web pages by composite text density.

Each page is parsed into a tree in its task. Parts that are never article text (scripts, menus, page
headers and footers, sidebars, forms of less than two thirds of the page, hidden elements, and blocks whose
class, id or role as a whole names them as adverts, comments and the like, articles among them) are taken out;
a notice, banner or disclaimer goes only if it is not denser than the threshold. Every node then has its composite density, the characters per
tag of its subtree, adjusted for the share of characters and tags in links:

    C / T * log_b(C * T / (LC * LT)),  b = ln(C / (C - LC) * LC + LC_body / C_body * C + e)

(C characters, T tags, LC and LT those in links, each at least 1). The block whose child blocks' densities
have the largest sum is the core (of equal ones the first). The smallest density on the path from the body to it is the
threshold: every node above the threshold adds the subtree of largest sum within it, and the
text is that of the smallest subtree that holds all these, or of the article, else main, element around
that subtree and the articles beside it that are not mostly links. The density selects; the tags only widen
what it selected, so a page whose text stands in several articles gives all of it.

Work is linear in the page, also for unclosed, nested or broken markup; nothing is cut or sampled.

Defined results: a NULL page is empty and has the text ""; the same page on several rows has the same
text on each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, small_batches

# Element names of HTML by their role here.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
FOREIGN = frozenset("svg math".split())
DROPPED = frozenset("head nav aside footer button select menu dialog datalist".split())
SAME_LEVEL = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
              "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_SCOPE = frozenset("article aside blockquote body dd details div figure footer form header li main nav section table td th button".split())
# Words in class, id or role that name what is no article text.
NAMED = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo "
                  "cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination "
                  "popup promo promoted recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
REPLIES = frozenset("comment comments commentlist disqus replies respond hidden".split())
#: Names that a story's own sections may have: their blocks go only if their density is no higher than the threshold.
DOUBTED = frozenset("banner complementary disclaimer notice notices notification".split())
# Words that a name may be joined with and still be the name of the whole block (comment-list, promo_box).
JOINED = frozenset("area article aside author bar block body bottom box col column container content el feed footer form group header holder inner item items left level link links list main meta "
                   "module outer pane panel post posts right row section site slot strip text thread title top unit widget wrap wrapper".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?][^<>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>]+))?|/\s*(\Z)""")
_NO_DISPLAY = re.compile(r"(?:\A|;)\s*display\s*:\s*none\b", re.I)
_PART = re.compile(r"[^\W_]+")


class Tree:
    """Nodes in page order (parents before children), text pieces with their node."""

    def __init__(self, page: str):
        self.tag, self.parent, self.attrs = ["#root"], [-1], [""]
        self.pieces: list[tuple[int, str]] = []  # (node, text); (node, "\n") marks a block's start or end
        self.open: Counter[str] = Counter()
        unended: set[str] = set()  # of FOREIGN, those without an end tag in the rest of the page
        stack, at, end = [0], 0, len(page)
        while at < end:
            m = _TOKEN.search(page, at)
            upto = m.start() if m else end
            if upto > at:
                text = page[at:upto]
                self.pieces.append((stack[-1], unescape(text) if "&" in text else text))
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag = name.lower()
            if m[1] or m[4]:
                self._close(stack, tag)
                continue
            if tag in CLOSES_P:
                self._close_up_to(stack, {"p"}, P_SCOPE)
            if tag in SAME_LEVEL:
                self._close_up_to(stack, *SAME_LEVEL[tag])
            node = len(self.tag)
            self.tag.append(tag), self.parent.append(stack[-1]), self.attrs.append(m[3] or m[6] or "")
            if tag in BLOCK:
                self.pieces.append((node, "\n"))
            if tag in FOREIGN and (tag in unended or _self_closing(self.attrs[node])):
                continue
            if tag in RAW:
                done = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                if not done and tag in FOREIGN:
                    unended.add(tag)
                    continue
                at = done.end() if done else end
            elif tag not in VOID:
                stack.append(node)
                self.open[tag] += 1

    def _end(self, stack: list[int], k: int) -> None:
        for node in stack[k:]:
            self.open[self.tag[node]] -= 1
        del stack[k:]

    def _close(self, stack: list[int], tag: str) -> None:
        if not self.open[tag]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                if tag in BLOCK:
                    self.pieces.append((self.parent[stack[k]], "\n"))
                self._end(stack, k)
                return
            if tag not in BLOCK and self.tag[stack[k]] in P_SCOPE:
                return  # an inline end tag does not end a block

    def _close_up_to(self, stack: list[int], tags: set[str], scope) -> None:
        """End the nearest open element of ``tags`` that no element of ``scope`` hides."""
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t in tags:
                self._end(stack, k)
                return
            if t in scope:
                return


def _attributes(attrs: str) -> dict[str, str]:
    """The first value of every attribute, "" for one without; nothing inside a value is an attribute."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        if m[1]:
            found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    return found


def _self_closing(attrs: str) -> bool:
    """Whether a slash that is no part of a value ends the tag."""
    return attrs.rstrip().endswith("/") and any(m[3] is not None for m in _ATTRIBUTE.finditer(attrs))


def _named(attrs: str) -> set[str]:
    """The words of NAMED in class, id and role, and ``hidden``.

    A name is a whole word, alone or joined with others that only say what kind of block it is: ``comments-area`` is
    one, ``no-sidebar`` and ``share-price`` are none.
    """
    found: set[str] = set()
    values = _attributes(attrs)
    for key in ("class", "id", "role"):
        for word in values.get(key, "").lower().split():
            parts = {p for p in _PART.findall(word) if not p.isdigit()}
            if parts <= NAMED | JOINED:
                found |= parts & NAMED
    if "hidden" in values or values.get("aria-hidden", "").strip().lower() == "true" or _NO_DISPLAY.search(values.get("style", "")):
        found.add("hidden")
    return found


def _sizes(tree: Tree, gone: list[bool]) -> list[int]:
    """Characters in each subtree, without the text of nodes that are gone."""
    size = [0] * len(gone)
    for k, text in tree.pieces:
        if not gone[k]:
            size[k] += len(text)
    for k in range(len(gone) - 1, 0, -1):
        size[tree.parent[k]] += size[k]
    return size


def main_text(page: str | None) -> str:
    """Blocks of the main text in page order, joined by one space."""
    if not page:
        return ""
    tree = Tree(page)
    tag, parent, n = tree.tag, tree.parent, len(tree.tag)
    holds, inside = [False] * n, [False] * n  # holds an article or main; stands in one
    for k in range(n - 1, 0, -1):
        if holds[k] or tag[k] in ("article", "main"):
            holds[parent[k]] = True
    gone = [False] * n
    for k in range(1, n):
        p, t = parent[k], tag[k]
        inside[k] = inside[p] or t in ("article", "main")
        gone[k] = gone[p] or t in RAW or t in DROPPED or (t == "header" and not inside[p])
    size, doubted = _sizes(tree, gone), []
    for k in range(1, n):
        gone[k] = gone[k] or gone[parent[k]]
        if not gone[k] and tree.attrs[k] and tag[k] not in ("html", "body", "main"):
            # what holds most of the page is no advert, whatever it is called, nor what holds the articles
            names = _named(tree.attrs[k])
            small, story = 3 * size[k] < 2 * size[0], holds[k] or tag[k] == "article"
            if names & REPLIES or names - DOUBTED and (small or holds[0] and not story):
                gone[k] = True
            elif names and (small or holds[0] and not story):
                doubted.append(k)
    size = _sizes(tree, gone)
    for k in range(1, n):  # a form around most of what is left is not one to fill in
        gone[k] = gone[k] or gone[parent[k]] or tag[k] == "form" and not holds[k] and 3 * size[k] < 2 * size[0]
    found = _select(tree, gone, doubted)
    if found is None and doubted:  # some of them are no text: without them
        found = _select(tree, gone, [])
    return found or ""


def _select(tree: Tree, gone: list[bool], doubted: list[int]) -> str | None:
    """The text that the densities select; None if blocks of ``doubted`` are not dense enough, which are then marked as gone."""
    tag, parent, n = tree.tag, tree.parent, len(tree.tag)
    chars, tags, link_chars, link_tags, in_link = [0] * n, [1] * n, [0] * n, [0] * n, [False] * n
    for k in range(1, n):
        in_link[k] = in_link[parent[k]] or tag[k] == "a"
    for k, text in tree.pieces:
        if text != "\n" and not gone[k]:
            c = len(" ".join(text.split()))
            chars[k] += c
            if in_link[k]:
                link_chars[k] += c
    for k in range(n - 1, 0, -1):
        if not gone[k]:
            p = parent[k]
            if tag[k] == "a":
                link_tags[k] += 1
            chars[p] += chars[k]
            tags[p] += tags[k]
            link_chars[p] += link_chars[k]
            link_tags[p] += link_tags[k]
    if not chars[0]:
        return ""
    body = next((k for k in range(1, n) if tag[k] == "body"), 0)
    link_share = link_chars[body] / max(1, chars[body])
    density, total = [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        if chars[k] and not gone[k]:
            c, lc, t = chars[k], max(1, link_chars[k]), tags[k]
            base = log(c / max(1, c - lc) * lc + link_share * c + e)
            density[k] = max(0.0, c / t * log(max(e, c * t / (lc * max(1, link_tags[k])))) / max(1e-9, log(max(base, 1 + 1e-9))))
        if k and not gone[k] and tag[k] in BLOCK:
            total[parent[k]] += density[k]
    # the subtree of largest sum in every node (itself included; without blocks in it a block has its own density);
    # bold words, links and the like are text of the block they stand in, not nodes to select
    best = [(total[k] or density[k] if tag[k] in BLOCK or not k else 0.0, -k) for k in range(n)]
    top = list(best)
    for k in range(n - 1, 0, -1):
        if not gone[k]:
            top[parent[k]] = max(top[parent[k]], top[k])
    core = -top[body][1]
    path = [core]
    while path[-1] not in (body, 0):
        path.append(parent[path[-1]])
    least = min(density[k] for k in path)
    if thin := [k for k in doubted if not gone[k] and density[k] <= least]:
        for k in thin:
            gone[k] = True
        for k in range(1, n):
            gone[k] = gone[k] or gone[parent[k]]
        return None
    wanted = {core}
    for k in range(body, n):
        if not gone[k] and chars[k] and density[k] >= least and (tag[k] in BLOCK or not k):
            wanted.add(-top[k][1])
    root = _smallest_around(wanted, parent)
    around = [root]
    while around[-1] > 0:
        around.append(parent[around[-1]])
    root = next((k for k in around if tag[k] == "article"), next((k for k in around if tag[k] == "main"), root))
    roots = {root}
    if tag[root] == "article":  # further articles beside it, unless most of their text is links
        roots |= {k for k in range(1, n) if tag[k] == "article" and parent[k] == parent[root] and 2 * link_chars[k] < chars[k]}
    within = [False] * n
    within[0] = root == 0
    out: list[str] = []
    for k in range(1, n):
        within[k] = (k in roots or within[parent[k]]) and not gone[k]
    for k, text in tree.pieces:
        if text == "\n":
            out.append(" ")
        elif within[k]:
            out.append(text)
    return " ".join("".join(out).split())


def _smallest_around(nodes: set[int], parent: list[int]) -> int:
    """The deepest node whose subtree holds all of ``nodes`` (a parent has a smaller number than its children)."""
    nodes = set(nodes)
    while len(nodes) > 1:
        last = max(nodes)
        nodes.remove(last)
        nodes.add(parent[last])
    return nodes.pop()


def extract(pages: DataFrame) -> DataFrame:
    """Every column of ``pages`` (with html) and main_text (replacing a column of that name)."""
    small_batches(pages.sparkSession)
    pages = pages.drop("main_text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([main_text(x.as_py()) for x in part.column("html")], pa.string())], [*part.schema.names, "main_text"])

    return pages.mapInArrow(run, pages.select("*", F.lit("").alias("main_text")).schema)


def op8_html_text(spark, sf_dir):
    """Main text of every page."""
    out = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
