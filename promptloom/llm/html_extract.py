"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A linear classifier turns what is known of a block (its elements, their names,
link density, length) into two costs: of calling it boilerplate and of calling it content; they are the capacities from
the source and to the sink. Blocks that follow each other are joined by smoothness edges, the stronger the nearer they
stand in the document's tree, and so are blocks of one element. The minimum cut is the cheapest labelling; blocks on the
source's side are the main text.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.shared import bound_batches, trimmed

# Fixed values of HTML: elements whose inside is never text of the page, elements that end a block, elements without
# an end, and elements that mark what is not the article.
HIDDEN = frozenset("script style noscript template svg title textarea select datalist button iframe object canvas audio video".split())
#: Of these, those whose inside ends at the first end tag, whatever it holds, or else with the page.
RAW = frozenset("script style title textarea iframe".split())
BREAKING = frozenset(
    "html head body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main aside nav header "
    "footer form fieldset legend label blockquote pre figure figcaption address details summary dialog hr center menu search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav footer aside form dialog menu search head".split())
INSIDE = frozenset("article main".split())
#: Elements that belong to the one around them.
INNER = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption center".split())
#: Elements that an unclosed one of the same kind ends at.
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
          "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}

BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "footer sidebar side aside widget related recommended recommendations share sharing social cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login paywall comment comments disqus replies reply respond copyright legal "
    "disclaimer pager pagination toolbar masthead topbar bottombar skip search tags tagcloud trending popular outbrain taboola byline meta".split()
)
#: Words that say what a page has, not what an element is: `has-sidebar`.
STATE = frozenset("has with without no is js".split())
HEAD_NAMES = frozenset("header head top".split())
GOOD_NAMES = frozenset("article content main post entry story text body articlebody maincontent prose".split())

#: Weights of the classifier, in hundredths: what speaks for content (+) or boilerplate (-).
BIAS, IN_ARTICLE, IN_OUTSIDE, BAD, GOOD, PAGE_HEADER, LINKED, WORDY, SHORT, PARAGRAPH, HEADING, ITEM = -60, 300, -1200, -900, 150, -900, -500, 40, -80, 60, 50, 20
#: The weight of links for blocks inside an article.
LINKED_INSIDE = -150
#: Capacities of the edges between neighbours, which grow by NEAR divided by their distance in the tree, and between blocks
#: of one element.
NEXT, NEAR, SAME = 20, 40, 60
#: Share of a page's text that a wrapper holds whose names and tag say nothing.
WRAPPER = 0.6

_TAG = re.compile(r"<!--|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?][^>]*>")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {tag: re.compile(f"<(/?){tag}\\b[^>]*>", re.I) for tag in HIDDEN}


def _named(attributes: str) -> tuple[bool, bool, bool]:
    """Whether the names in class, id and role are those of boilerplate, of a header, of the article. A word of a class
    speaks for itself: with a good word among them, bad ones are taken for details."""
    bad = head = good = False
    for m in _ATTRIBUTE.finditer(attributes):
        worse = better = False
        for word in (m[2] or m[3] or m[4] or "").split():
            names = [x.lower() for x in _NAME.findall(word)]
            if not names or names[0] in STATE:
                continue
            wrong = not BAD_NAMES.isdisjoint(names)
            worse = worse or wrong
            better = better or not wrong and not GOOD_NAMES.isdisjoint(names)
            head = head or not wrong and not HEAD_NAMES.isdisjoint(names)
        bad, good = bad or worse and not better, good or better
    return bad, head, good


class _Tree:
    """A page's elements, each after its parent: what each says of all in it, and its blocks of text."""

    def __init__(self):
        self.tag, self.parent, self.depth, self.said, self.bits, self.wraps = [""], [0], [0], [0], [0], [False]
        self.blocks: list[tuple[str, int, int]] = []  # text, its code points inside links, element

    def add(self, tag: str, attributes: str, parent: int) -> int:
        """bits: 1 article, 2 page header, 4 named like an article; wraps: may be judged wrongly if it holds the page."""
        bad, head, good = _named(attributes) if attributes and tag not in ("html", "body") else (False, False, False)
        bits = 1 if tag in INSIDE else 2 if tag == "header" else 0
        if tag in OUTSIDE:
            said = IN_OUTSIDE
        elif bad:
            said, bits = BAD, bits & 1
        else:
            bits |= 2 * head | 4 * good
            said = max(IN_ARTICLE * (bits & 1), GOOD * good)
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.said.append(said)
        self.bits.append(bits)
        self.wraps.append(bad or tag == "form")
        return len(self.tag) - 1

    def judged(self) -> list[tuple[int, int]]:
        """For each element the evidence of it and all around it, and whether an article is among these."""
        n = len(self.tag)
        plain, holds = [0] * n, [bits & 5 > 0 for bits in self.bits]
        for text, linked, at in self.blocks:
            plain[at] += len(text) - min(linked, len(text))
        for i in range(n - 1, 0, -1):
            plain[self.parent[i]] += plain[i]
            holds[self.parent[i]] = holds[self.parent[i]] or holds[i]
        out = [(0, 0)] * n
        for i in range(1, n):
            above, has = out[self.parent[i]]
            said, bits = self.said[i], self.bits[i]
            if self.wraps[i] and holds[i] and plain[i] >= WRAPPER * plain[0]:
                said = IN_ARTICLE * (bits & 1)
            if bits & 2 and not (has | bits) & 1:
                said = min(said, 0) + PAGE_HEADER
            out[i] = (above + said if said < 0 or not has else above + min(said, 50), has | bits & 1)
        return out

    def distance(self, a: int, b: int) -> int:
        steps = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a = self.parent[a]
            steps += 1
        return steps


def blocks(page: str) -> tuple[_Tree, list[tuple[str, int, int]]]:
    """The page's tree and (text, evidence, element) of each block of text in page order."""
    tree = _Tree()
    stack, opened = [0], {"": 1}
    parts: list[str] = []
    linked = anchors = 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                tree.blocks.append((text, linked, stack[-1]))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if anchors:
                linked += len(text)

    def close() -> None:
        opened[tree.tag[stack.pop()]] -= 1

    at = 0
    while True:
        m = _TAG.search(page, at)
        add(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        if m[0] == "<!--":
            stop = page.find("-->", at)
            at = len(page) if stop < 0 else stop + 3
        elif m[1]:
            tag = m[1].lower()
            if tag in HIDDEN:
                if not m[2].endswith("/"):
                    at = _after(page, tag, at)
                if tag in ("title", "textarea", "select", "iframe"):
                    end()
            elif tag in BREAKING:
                end()
                while len(stack) > 1 and tree.tag[stack[-1]] in CLOSES.get(tag, ()):
                    close()
                if tag not in VOID and not m[2].endswith("/"):
                    stack.append(tree.add(tag, m[2], stack[-1]))
                    opened[tag] = opened.get(tag, 0) + 1
            elif tag == "a":
                anchors = 1
            elif tag in ("br", "img", "input"):
                add(" ")
        elif m[3]:
            tag = m[3].lower()
            if tag in BREAKING:
                end()
                if opened.get(tag):
                    while tree.tag[stack[-1]] != tag:
                        close()
                    close()
            elif tag == "a":
                anchors = 0
    end()
    judged, out = tree.judged(), []
    for text, inside, element in tree.blocks:
        said, article = judged[element]
        tag, n = tree.tag[element], len(text)
        said += BIAS + (LINKED_INSIDE if article else LINKED) * min(inside, n) // n + WORDY * min(10, n // 60) + (SHORT if n < 25 else 0)
        said += PARAGRAPH if tag in ("p", "blockquote", "pre") else HEADING if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else ITEM if tag in ("li", "td") else 0
        around = element
        while around and tree.tag[around] in INNER:
            around = tree.parent[around]
        out.append((text, said, around))
    return tree, out


def _after(page: str, tag: str, at: int) -> int:
    """Where the hidden element ends that begins before `at`. A raw one that isn't closed hides the rest of the page; of
    others only the tag goes."""
    depth = 1
    for m in _ENDS[tag].finditer(page, at):
        if m[1] or tag not in RAW and not m[0].endswith("/>"):
            depth += -1 if m[1] else 1
        if not depth or tag in RAW and m[1]:
            return m.end()
    return len(page) if tag in RAW else at


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut. edges: (a, b, capacity in both directions).

    What flows from the source over one node to the sink is taken off first; the rest by shortest augmenting paths,
    level by level."""
    n = len(source)
    left = [max(0, a - b) for a, b in zip(source, sink)]
    room = [max(0, b - a) for a, b in zip(source, sink)]
    cap: list[int] = []
    to: list[int] = []
    of: list[list[int]] = [[] for _ in range(n)]
    for a, b, c in edges:
        of[a].append(len(to))
        of[b].append(len(to) + 1)
        to += (b, a)
        cap += (c, c)
    while True:
        level = [0 if x > 0 else -1 for x in left]
        queue = deque(i for i in range(n) if left[i] > 0)
        reached = False
        while queue:
            i = queue.popleft()
            reached = reached or room[i] > 0
            for e in of[i]:
                if cap[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        tried = [0] * n
        for s in range(n):
            while left[s] > 0:
                path: list[int] = []
                i = s
                while not room[i]:
                    while tried[i] < len(of[i]) and not (cap[of[i][tried[i]]] > 0 and level[to[of[i][tried[i]]]] == level[i] + 1):
                        tried[i] += 1
                    if tried[i] < len(of[i]):
                        path.append(of[i][tried[i]])
                        i = to[path[-1]]
                    elif path:
                        e = path.pop()
                        i = to[e ^ 1]
                        tried[i] += 1
                    else:
                        i = -1
                        break
                if i < 0:
                    break
                flow = min([left[s], room[i], *(cap[e] for e in path)])
                left[s] -= flow
                room[i] -= flow
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow


def extract(page: str | None) -> str:
    """The main text of a page, a block a line; empty if there is none."""
    tree, found = blocks(page or "")
    edges, last = [], {}
    for i, (_, _, at) in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT + NEAR // (1 + tree.distance(found[i - 1][2], at))))
        if at in last and last[at] < i - 1:
            edges.append((last[at], i, SAME))
        last[at] = i
    side = minimum_cut([max(0, s) for _, s, _ in found], [max(0, -s) for _, s, _ in found], edges)
    return "\n".join(text for (text, _, _), x in zip(found, side) if x)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    A null or empty page, and one without content, has an empty text. Unclosed and unknown markup is read as far as it
    goes; what follows an unclosed comment, script, style, title, textarea or iframe is dropped, as browsers do. Null ids and addresses pass through; repeated rows
    are alike; an empty table gives no rows; extra columns are ignored."""
    frame = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))

    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return frame.mapInArrow(trimmed(run), "page_id long, url string, text string, n_chars long")
