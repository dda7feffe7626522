"""Main text of HTML pages by composite text density.

A page becomes a DOM without the elements that are never article text.  Every
node gets its link-adjusted characters per tag, a node's density sum adds those
of its children, and the subtree with the highest sum is the content.  The
lowest density on the way from there to the body is the threshold: subtrees
beside the way that reach it are content too.  If the content lies in an
``article`` (or else a ``main``), all of that element is.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from linearspark.llm.common import map_batches, parallel, read_table, strings

# Fixed lists: HTML's own element classes, and names that page templates use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("option legend caption td th tr tbody thead tfoot body head html title".split())
CLOSES_ALSO = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
               "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"),
               "body": ("head",)}
LISTS = frozenset("ul ol menu dl table select".split())
NEVER_TEXT = frozenset(
    "head script style noscript template nav footer aside form button input select textarea iframe object embed svg "
    "math canvas audio video map dialog menu title".split())
NOISE_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices "
    "paywall popup promo promotion related replies respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags toolbar widget widgets".split())
# Parts that a noise name may have beside it: "site-footer", "ad-box-2"; any other part makes it another name.
PLAIN_PARTS = frozenset(
    "area bar block body bottom box btn bottombar cloud col column container content fixed float global group header holder "
    "inline inner item items left link links list main page pane panel post posts primary region right row secondary section site "
    "slot sticky strip top topbar unit widget wrap wrapper".split())
NAMED_SHARE = 0.8       # a subtree with this share of the page's text is no noise, whatever its name
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


def _is_noise(tag: str, attributes: str, in_article: bool) -> bool:
    """Elements that hold no article text by what HTML says of them."""
    if tag in NEVER_TEXT or tag == "header" and not in_article:
        return True
    if attributes and tag not in ("html", "body", "article", "main"):
        for name, *values in _NAMES.findall(attributes):
            value, name = "".join(values).lower(), name.lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in NOISE_ROLES:
                return True
    return False


def _noise_name(word: str) -> bool:
    """A class or id that says noise and nothing else: every part is a noise name, a
    plain part or a number ("has-sidebar" and "related-work" are neither)."""
    parts = [p for p in _PARTS.split(word) if p]
    return not NOISE_NAMES.isdisjoint(parts) and all(p in NOISE_NAMES or p in PLAIN_PARTS or p.isdigit() for p in parts)


def _has_noise_name(tag: str, attributes: str) -> bool:
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    return any(name.lower() in ("class", "id") and any(map(_noise_name, "".join(values).lower().split()))
               for name, *values in _NAMES.findall(attributes))


class _Dom:
    """Nodes in document order, as parallel lists; node 0 is the document."""

    def __init__(self, html: str):
        self.tag, self.parent, self.link = ["#document"], [-1], [False]
        self.text: list[tuple[int, int, str]] = []      # node, block number, decoded text
        self.end = [0]                                  # one past a node's last descendant
        self.named: list[int] = []                      # nodes whose class or id is a noise name
        self._read(html)
        self._drop_named()

    def _drop_named(self) -> None:
        """Take the text out of subtrees with a noise name, unless they hold
        ``NAMED_SHARE`` of the page's text or more."""
        if not self.named or not self.text:
            return
        before = [0]
        for _, _, text in self.text:
            before.append(before[-1] + len("".join(text.split())))
        nodes = [node for node, _, _ in self.text]      # not in order of nodes: text follows a closed child
        gone = bytearray(len(self.tag))
        for node in self.named:
            if gone[node]:
                continue
            own = sum(before[i + 1] - before[i] for i, at in enumerate(nodes) if node <= at < self.end[node])
            if own < NAMED_SHARE * before[-1]:
                for i in range(node, self.end[node]):
                    gone[i] = 1
                    self.link[i] = self.link[i] and i == node
        self.text = [t for t in self.text if not gone[t[0]]]

    def _read(self, html: str) -> None:
        stack, opened, block, articles = [0], {}, 0, 0
        skip = 0                                        # depth of the stack below which nothing is text

        def close(depth: int) -> None:
            nonlocal skip, articles
            while len(stack) > depth:
                node = stack.pop()
                self.end[node] = len(self.tag)
                opened[self.tag[node]] -= 1
                articles -= self.tag[node] in ("article", "main")
            if len(stack) < skip:
                skip = 0

        def close_open(names: tuple[str, ...], stop: frozenset) -> None:
            """Close the lowest open element of these names, within its list or table."""
            if any(opened.get(n) for n in names):
                for depth in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[depth]]
                    if tag in names:
                        return close(depth)
                    if tag in stop:
                        return

        at, size = 0, len(html)
        while at < size:
            found = _TAG.search(html, at)
            upto = found.start() if found else size
            if upto > at and not skip:
                self.text.append((stack[-1], block, unescape(html[at:upto])))
            if not found:
                break
            at = max(found.end(), upto + 1)
            slash, tag, attributes = found.group(1), (found.group(2) or "").lower(), found.group(3)
            if not tag:
                continue
            if tag in BLOCK:
                block += 1
            if slash:
                if opened.get(tag):
                    for depth in range(len(stack) - 1, 0, -1):
                        name = self.tag[stack[depth]]
                        if name == tag:
                            close(depth)
                            break
                        if tag not in BLOCK and name in BLOCK:
                            break
                continue
            if tag == "br":
                if not skip:
                    self.text.append((stack[-1], block, " "))
                continue
            if tag in CLOSES_P:
                close_open(("p",), frozenset(("td", "th", "table", "button")))
            if tag in CLOSES_ALSO:
                close_open(CLOSES_ALSO[tag], LISTS - {"table"} if tag in ("li", "dt", "dd") else frozenset(("table",)))
            node = len(self.tag)
            if not skip:
                self.tag.append(tag)
                self.parent.append(stack[-1])
                self.link.append(tag == "a" or self.link[stack[-1]])
                self.end.append(node + 1)
            if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in RAW:
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                if not stop:
                    at = size if tag in ("script", "style") else at
                else:
                    if not skip and not _is_noise(tag, attributes, articles > 0):
                        self.text.append((node, block, unescape(html[at:stop.start()])))
                    at = stop.end()
                continue
            if skip:
                node = len(self.tag)
                self.tag.append(tag)
                self.parent.append(stack[-1])
                self.link.append(False)
                self.end.append(node + 1)
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
            articles += tag in ("article", "main")
            if not skip:
                if _is_noise(tag, attributes, articles > 0):
                    skip = len(stack)
                elif _has_noise_name(tag, attributes):
                    self.named.append(node)
        close(1)
        self.end[0] = len(self.tag)


def _densities(dom: _Dom) -> tuple[list[float], list[float]]:
    """Composite text density of each node, and the sum over its children."""
    n = len(dom.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, _, text in dom.text:
        size = len(" ".join(text.split()))
        chars[node] += size
        if dom.link[node]:
            link_chars[node] += size
    for node in range(n - 1, 0, -1):
        up = dom.parent[node]
        chars[up] += chars[node]
        tags[up] += tags[node] + 1
        link_chars[up] += link_chars[node]
        link_tags[up] += link_tags[node] + dom.link[node]
    body = next((i for i, t in enumerate(dom.tag) if t == "body"), 0)
    body_ratio = link_chars[body] / max(chars[body], 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if chars[i]:
            plain = max(chars[i] - link_chars[i], 1)
            base = log(chars[i] / plain * link_chars[i] + body_ratio * chars[i] + e)
            spread = chars[i] / max(link_chars[i], 1) * (max(tags[i], 1) / max(link_tags[i], 1))
            density[i] = chars[i] / max(tags[i], 1) * max(log(spread), 0.0) / base
        if i:
            total[dom.parent[i]] += density[i]
    return density, total


def main_text(html: str) -> str:
    """The main text: blocks in page order, one line each (empty if none)."""
    dom = _Dom(html)
    if not dom.text:
        return ""
    density, total = _densities(dom)
    best = max(range(len(total)), key=lambda i: (total[i], -i))
    if not total[best]:
        best = next((i for i, t in enumerate(dom.tag) if t == "body"), 0)
    way = [best]
    while way[-1]:
        way.append(dom.parent[way[-1]])
    whole = [i for i in way if dom.tag[i] == "article"][-1:] or [i for i in way if dom.tag[i] == "main"][-1:]
    if whole:
        ranges = [(whole[0], dom.end[whole[0]])]
    else:
        body = next((i for i in way if dom.tag[i] == "body"), way[-1])
        inside = way[:way.index(body) + 1]
        threshold = min(density[i] for i in inside)
        on_way = set(way)
        beside = [i for i in range(1, len(dom.tag)) if dom.parent[i] in on_way and i not in on_way
                  and dom.parent[i] in inside and dom.parent[i] != best and density[i] >= threshold > 0]
        ranges = [(best, dom.end[best]), *((i, dom.end[i]) for i in beside)]
    blocks, last = [], None
    for node, block, text in dom.text:
        if any(a <= node < b for a, b in ranges):
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks)
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    Null, empty and text-free pages have the empty text.  Pages are read whole;
    unclosed and misplaced tags are mended as browsers do.  Repeated rows repeat
    their result; other columns are ignored.
    """
    src = parallel(pages.select("page_id", "url", "html"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in strings(batch, "html")]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: src.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return map_batches(src, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op3_html_extract(spark, sf_dir) -> DataFrame:
    """Contract query: page_id, url, text, n_chars."""
    return extract(read_table(spark, sf_dir, "pages"))
