"""HTML main-text extraction: flat text blocks classified by a decision tree.

A page is read once, left to right, into flat text blocks that end at block-level tags. A block
has its words and link density, those of the blocks before and after it, and what its open
containers say (article or main, navigation, header, footer, aside, form; hints in class, id and
role names). A name says chrome for certain only if all its words are of chrome or of layout
(``ad-banner``, ``share-buttons``); with words of its own (``related-work``, ``menu-design``), on
paragraphs and list items, and as the id of a section in an article it is a doubtful name: not a
verdict but a feature, beside the running words and the link density of what bears it. Ids of headings
say nothing. Names that tell a state (has-sidebar, no-search, comments-enabled) and all names of the
whole page (body, html) say nothing, and a container that is called chrome, or a form, but holds most
of the page's running text and all that looks like an article is a wrapper: its name doesn't count
either. A small CART tree, trained here on a labelled table of blocks (:func:`labelled_blocks`
lays it out from a few dozen marked page parts), decides which blocks belong to the article.

Defined cases: null or empty html gives an empty text; comments, scripts, styles, titles, templates
and the rest after an unclosed comment, script or style are markup; ``<br>`` is white space inside a block; inline tags add no
space; a page cut off anywhere keeps what it has; repeated rows are extracted each; other columns
are ignored; very long pages are read whole in linear time.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import table

MARKUP = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z!?][^>]*>",
    re.S,
)
#: What follows the last '>' of a page that was cut off inside a tag.
CUT_OFF = re.compile(r"<[!?/a-zA-Z].*\Z", re.S)
#: Elements whose content is not text of the page. An unclosed one of the first two ends the page;
#: any other is then read as an unknown tag.
RAW_TAGS = frozenset("script style template noscript iframe svg textarea select object title canvas math video audio".split())
ENDLESS_TAGS = frozenset("script style".split())
NAMES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\bhidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORDS_IN_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("nav header footer aside form menu dialog button search label fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of class, id and role names (fixed values of this operator).
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "masthead footer sidebar aside rail widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login search share sharing social related recommended recommendations pagination pager toolbar skip copyright legal disclaimer paywall "
    "complementary contentinfo dialog form".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond reply replies discussion reactions".split())
HEADER_NAMES = frozenset("header head topbar top".split())
ARTICLE_NAMES = frozenset("article content post entry story main body text maincontent".split())

#: Of those: adverts and notices about the page, which keep their meaning on a paragraph or list item.
ADVERT_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo cookie cookies gdpr newsletter paywall comment comments".split())
#: Words of layout that add nothing to the name they stand in.
LAYOUT_WORDS = frozenset(
    "area bar block body bottom box button buttons card cards col column component container content desktop extra fixed form global group header holder home html icon icons "
    "inner item items label layout left leaderboard level link links list main mobile module nav news outer page panel part post posts article articles story stories primary region right row secondary section "
    "site slot small sticky tag tags text title toggle tool tools top unit up user web wide wrap wrapper zone policy rights".split()
)
#: Elements that are lines of text themselves.
LINE_TAGS = frozenset("p li dt dd td th tr tbody thead table ul ol dl pre blockquote figure figcaption caption summary details".split())

#: Parts of names that make the whole name one of a state, not of a thing: in any place, and last.
STATE_PARTS = frozenset("has have no not is with without".split())
STATE_ENDS = frozenset("enabled disabled open opened closed on off active inactive visible loaded supported allowed".split())
#: Words of running text from which a wrapper is told by its share of the page alone.
WRAPPER_WORDS = 40

FEATURES = (
    "words", "link_density", "words_before", "links_before", "words_after", "links_after", "verdict", "in_article", "in_chrome",
    "in_comments", "heading", "list_item", "page_has_article", "stops", "copyright", "header_in_article", "doubtful", "doubtful_words", "doubtful_links", "place",
)


class Block:
    __slots__ = ("text", "linked", "at", "verdict", "article", "chrome", "comments", "heading", "item", "header", "doubt", "mark")

    def __init__(self, text: str, linked: int, at: int, heading: int, item: int, mark: str | None):
        self.text, self.linked, self.at, self.heading, self.item, self.mark = text, linked, at, heading, item, mark


class Container:
    """An open element: what its tag and names say, and what is found in it."""

    __slots__ = ("parent", "says", "bare", "firm", "form", "article", "doubtful", "by_id", "evidence", "words", "chars", "linked")

    def __init__(self, parent: int, says: int, bare: int, firm: bool, form: bool, article: bool, doubtful: bool, by_id: bool):
        self.parent, self.says, self.bare, self.firm, self.form, self.article, self.doubtful, self.by_id = parent, says, bare, firm, form, article, doubtful, by_id
        self.evidence = self.words = self.chars = self.linked = 0


def _names(attributes: str) -> Iterator[tuple[bool, set[str]]]:
    """(whether it is an id, its words) of the class, id and role names that name a thing."""
    for m in NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [w.lower() for w in WORDS_IN_NAME.findall(name)]
            if parts and (len(parts) == 1 or not (parts[-1] in STATE_ENDS or STATE_PARTS.intersection(parts))):
                yield m[0][:2].lower() == "id", set(parts)


def _says(tag: str, attributes: str) -> tuple[int, int, bool, bool, bool]:
    """What a container's tag and names say: 1 article, -1 chrome, -2 comments, -3 header, 0 nothing;
    what it says if a bad name or being a form does not count; whether it is chrome for certain; whether
    it has a doubtful name; and whether only its id says so."""
    if tag in ("body", "html"):
        return 0, 0, False, False, False
    says = 1 if tag in ARTICLE_TAGS else -3 if tag == "header" else -1 if tag in CHROME_TAGS else 0
    firm = says == -3 or (says == -1 and tag != "form")
    bare = max(says, 0)
    named, doubtful, by_id, header = 0, False, True, False
    if attributes:
        if HIDDEN.search(attributes):
            return -1, -1, True, False, False
        for is_id, words in _names(attributes):
            if is_id and tag in HEADINGS:
                continue
            bad = words & (CHROME_NAMES | COMMENT_NAMES)
            if bad and (words - bad - LAYOUT_WORDS or (tag in LINE_TAGS and not bad & ADVERT_NAMES)):
                doubtful = doubtful or tag not in HEADINGS
            elif bad:
                named, by_id = -2 if bad & COMMENT_NAMES else named or -1, by_id and is_id and len(words) == 1 and not words & ADVERT_NAMES
            elif words & ARTICLE_NAMES and tag not in LINE_TAGS:
                bare = 1
            elif words & HEADER_NAMES and not words - HEADER_NAMES - LAYOUT_WORDS:
                header = True
        if named == -2 or (named and says != 1):
            says = named
        elif not says and header:
            says = -3
        elif not says:
            says = bare
    return says, bare, firm, doubtful, by_id and bool(named) and not firm


def _judge(found: list[Block], containers: list[Container]) -> None:
    """Each block's verdict and places, from what its containers say."""
    for b in found:
        here = containers[b.at]
        here.words += round((b.text.count(" ") + 1) * max(0.0, 1 - b.linked / len(b.text)))
        here.chars, here.linked = here.chars + len(b.text), here.linked + min(b.linked, len(b.text))
    inside = [False] * len(containers)  # in certain chrome, where nothing counts as an article
    for i, c in enumerate(containers):
        inside[i] = c.firm or (i > 0 and inside[c.parent])
        if inside[i]:
            c.evidence = 0
    for c in reversed(containers[1:]):
        containers[c.parent].words += c.words
        containers[c.parent].evidence += c.evidence
        containers[c.parent].chars += c.chars
        containers[c.parent].linked += c.linked
    words, evidence = containers[0].words, containers[0].evidence
    states: list[tuple[int, int, int, int, int, int]] = []
    for i, c in enumerate(containers):
        verdict, article, chrome, comments, header, doubt = states[c.parent] if i else (0, 0, 0, 0, 0, 0)
        says = c.says
        if c.by_id and verdict >= 0:
            doubt, says = i, 0
        elif c.doubtful:
            doubt = i
        if says in (-1, -2) and not c.firm and not inside[i] and 2 * c.words >= words:
            outside = evidence - c.evidence
            if (c.evidence and (not outside or (c.form and c.evidence >= outside))) or (not evidence and says == -1 and c.words >= WRAPPER_WORDS):
                says = c.bare
        if says == 1:
            verdict, article = (1 if verdict >= 0 or c.article and verdict > -2 else verdict), 1
        elif says == -3:
            if article and verdict > 0:
                header = 1
            else:
                verdict, chrome = -1, 1
        elif says:
            verdict, chrome, comments = min(verdict, says) if verdict < 0 else says, 1, comments or int(says == -2)
        states.append((verdict, article, chrome, comments, header, doubt))
    for b in found:
        b.verdict, b.article, b.chrome, b.comments, b.header, doubt = states[b.at]
        c = containers[doubt]
        b.doubt = (1.0, float(min(c.words, 200)), c.linked / max(c.chars, 1)) if doubt else (0.0, 0.0, 0.0)


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page, in order, without empty ones."""
    out: list[Block] = []
    containers = [Container(0, 0, 0, False, False, False, False, False)]
    # open elements: tag, container, heading, list item
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
    parts: list[str] = []
    linked, in_link, mark = 0, 0, None
    at = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, *stack[-1][1:], mark))
            parts.clear()
        linked = 0

    last = page.rfind(">") + 1
    unclosed: set[str] = set()
    while m := MARKUP.search(page, at, last):
        if m.start() > at:
            parts.append(piece := page[at : m.start()])
            if in_link:
                linked += len(piece)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
            continue
        tag = tag.lower()
        if tag in RAW_TAGS and not m[1] and not m[3].endswith("/") and tag not in unclosed:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end:
                parts.append(" ")
                at = end.end()
                continue
            if tag in ENDLESS_TAGS:
                at = len(page)
                break
            unclosed.add(tag)
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = 0 if m[1] else 1
            continue
        if tag not in BLOCK_TAGS:
            continue
        close()
        if tag in VOID_TAGS:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or tag in HEADINGS:
            if stack[-1][0] == tag or stack[-1][0] == "p":  # their end tags may be left out
                stack.pop()
        elif stack[-1][0] == "p":
            stack.pop()
        _, here, heading, item = stack[-1]
        says, bare, firm, doubtful, by_id = _says(tag, m[3])
        if says or bare or doubtful:
            containers.append(Container(here, says, bare, firm, tag == "form", tag in ARTICLE_TAGS, doubtful, by_id and tag == "section"))
            here = len(containers) - 1
        if says == 1 or tag == "h1":
            containers[here].evidence += 1
        if "data-keep" in m[3]:
            mark = "1" if 'data-keep="1"' in m[3] else "0"
        stack.append((tag, here, int(tag in HEADINGS) or heading, int(tag in ("li", "td", "th", "option")) or item))
    if at < len(page):
        parts.append(piece := CUT_OFF.sub("", page[at:]))
        if in_link:
            linked += len(piece)
    close()
    _judge(out, containers)
    return out


def block_features(found: list[Block]) -> np.ndarray:
    """A row of features per block."""
    n = len(found)
    words = np.array([min(b.text.count(" ") + 1, 200) for b in found], float)
    links = np.array([min(1.0, b.linked / max(len(b.text), 1)) for b in found])
    before, after = np.r_[0.0, words[:-1]], np.r_[words[1:], 0.0]
    links_before, links_after = np.r_[0.0, links[:-1]], np.r_[links[1:], 0.0]
    has_article = float(any(b.article and b.verdict > 0 for b in found))
    flags = np.array(
        [(b.verdict, b.article, b.chrome, b.comments, b.heading, b.item, has_article, b.text[-1] in ".!?…:;\"”»", "©" in b.text or "copyright" in b.text[:80].lower(), b.header, *b.doubt) for b in found],
        float,
    ).reshape(n, 13)
    place = np.arange(n) / max(n - 1, 1)
    return np.column_stack([words, links, before, links_before, after, links_after, flags, place])


# --- the labelled table -------------------------------------------------------------------------

#: Parts of pages; the mark says whether the part's blocks belong to the article.
CHROME_PARTS = (
    '<nav data-keep="0"><ul><li><a href="/">{w2}</a></li><li><a href="/b">{w1}</a></li><li><a href="/c">{w1}</a></li></ul></nav>',
    '<div class="menu" data-keep="0"><a href="/">{w1}</a> <a href="/x">{w2}</a> <a href="/y">{w1}</a></div>',
    '<header data-keep="0"><h1><a href="/">{w2}</a></h1><p>{w6}</p></header>',
    '<div id="site-header" data-keep="0"><p>{w4}</p></div>',
    '<div class="ad" data-keep="0">{w12}.</div>',
    '<div class="ad-banner" data-keep="0"><p>{w40}.</p><a href="/buy">{w3}</a></div>',
    '<div class="cookie-notice" data-keep="0"><p>{w25}. {w12}.</p><button>{w2}</button></div>',
    '<form action="/s" data-keep="0"><label>{w2}</label><p>{w9}.</p></form>',
    '<ul data-keep="0"><li><a href="/">{w1}</a></li><li><a href="/q">{w2}</a></li></ul>',
    '<p data-keep="0"><a href="/">{w3}</a> | <a href="/z">{w2}</a> | <a href="/y">{w2}</a></p>',
)
TAIL_PARTS = (
    '<aside data-keep="0"><h3>{w3}</h3><p>{w30}. {w20}.</p></aside>',
    '<div class="sidebar" data-keep="0"><h2>{w2}</h2><ul><li><a href="/1">{w6}</a></li><li><a href="/2">{w7}</a></li></ul><p>{w22}.</p></div>',
    '<section id="comments" data-keep="0"><h2>{w2}</h2><div class="comment"><p>{w30}. {w14}.</p></div><div class="comment"><p>{w8}.</p></div></section>',
    '<div class="related" data-keep="0"><h3>{w2}</h3><a href="/r">{w8}</a></div>',
    '<div class="share" data-keep="0"><a href="/f">{w1}</a> <a href="/t">{w1}</a></div>',
    '<footer data-keep="0">&copy; {w2} &middot; {w8}.</footer>',
    '<footer data-keep="0"><p>{w30}.</p><ul><li><a href="/i">{w1}</a></li></ul></footer>',
    '<div data-keep="0">&copy; {w3}</div>',
    '<div class="newsletter" data-keep="0"><h4>{w4}</h4><p>{w16}.</p><form><label>{w2}</label></form></div>',
)
MAIN_PARTS = (
    "<h1>{w7}</h1><p>{w40}. {w30}.</p><p>{w60}.</p>",
    "<h1>{w5}.</h1><p>{w1}.</p><p>{w2}. {w1}.</p><p>{w50}. {w20}.</p><p>{w3}.</p>",
    "<h2>{w4}</h2><p>{w35}. <a href='/k'>{w3}</a> {w20}.</p><ul><li>{w8}</li><li>{w12}.</li></ul><p>{w25}.</p>",
    "<header><h1>{w6}</h1></header><p>{w80}.</p><blockquote>{w15}.</blockquote><h3>{w3}</h3><p>{w45}.</p>",
    "<h1>{w8}</h1><p><b>{w9}.<br><p>{w33}.</p><table><tr><td>{w2}</td><td>{w3}</td></tr></table><pre>{w20}</pre>",
    "<p>{w18}.</p><p>{w4}?</p><p>{w70}. {w60}.</p>",
)
#: Parts with doubtful names: {c} is a word of chrome, {v} any other word.
DOUBTFUL_MAIN = (
    '<section id="{c}-{v}"><h2 id="{c}-{v}">{w3}</h2><p>{w40}. {w20}.</p></section>',
    '<section id="{v}-{c}"><h2 id="{c}">{w2}</h2><p>{w8}.</p><p>{w25}. <a href="/w">{w2}</a> {w9}.</p></section>',
    '<div class="{c}-{v}"><p>{w30}.</p></div>',
    '<div class="{v}_{c}"><p>{w9}.</p><p>{w14}.</p></div>',
    '<p class="{c}-{v}">{w18}.</p>',
    '<p class="{c}">{w8}.</p>',
    '<ul><li class="{c}">{w6}</li><li class="{v}-{c}">{w3}</li><li>{w7}.</li></ul>',
    '<h3 id="{c}-{v}">{w2}</h3><p>{w15}.</p>',
    '<section id="{c}"><h2>{w2}</h2><p>{w40}. {w12}.</p></section>',
)
DOUBTFUL_CHROME = (
    '<div class="{c}_root__{v}" data-keep="0"><a href="/1">{w2}</a> <a href="/2">{w1}</a></div>',
    '<div class="{v}-{c}-{v}" data-keep="0"><ul><li><a href="/1">{w6}</a></li><li><a href="/2">{w7}</a></li></ul></div>',
    '<p class="{c}" data-keep="0"><a href="/s">{w2}</a></p>',
    '<ul class="{c}-{v}" data-keep="0"><li><a href="/1">{w2}</a></li><li class="{c}"><a href="/2">{w1}</a></li></ul>',
    '<section id="{c}" data-keep="0"><h3>{w2}</h3><p><a href="/r">{w5}</a></p><p><a href="/q">{w6}</a></p></section>',
)
#: Words of chrome that name things outside web pages too.
DOUBTFUL_WORDS = tuple("search share menu related social notice legal banner form copyright widget skip alert login related navigation rail modal dialog disclaimer recommended".split())
SHELLS = (
    '<article data-keep="1">{main}</article>',
    '<main data-keep="1">{main}</main>',
    '<main><article data-keep="1">{main}</article></main>',
    '<div id="content"><div class="post-body" data-keep="1">{main}</div></div>',
    '<form id="pageForm" action="/p"><div id="content" data-keep="1">{main}</div></form>',
    '<div class="layout has-sidebar"><article class="post comments-enabled" data-keep="1">{main}</article></div>',
    '<div data-keep="1">{main}</div>',
)


def labelled_blocks(seed: int = 7, copies: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The training table: features and labels of the blocks of pages put together from the parts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def fill(part: str) -> str:
        part = re.sub(r"\{([cv])\}", lambda m: rng.choice(DOUBTFUL_WORDS if m[1] == "c" else vocabulary), part)
        return re.sub(r"\{w(\d+)\}", lambda m: " ".join(rng.choice(vocabulary) for _ in range(max(1, round(int(m[1]) * rng.uniform(0.6, 1.5))))), part)

    xs, ys = [], []
    for shell in SHELLS:
        for main in MAIN_PARTS:
            for _ in range(copies):
                top, tail = rng.sample(CHROME_PARTS, rng.randint(1, 4)), rng.sample(TAIL_PARTS, rng.randint(1, 4))
                inner = main + "".join(rng.sample(DOUBTFUL_MAIN, rng.randint(1, 3)) if rng.random() < 0.7 else [])
                if shell != SHELLS[-1] and rng.random() >= 0.6:
                    inner += rng.choice(TAIL_PARTS[:5])
                if rng.random() < 0.4:
                    (tail if shell == SHELLS[-1] else top).append(rng.choice(DOUBTFUL_CHROME))
                    inner += rng.choice(DOUBTFUL_CHROME) if shell != SHELLS[-1] else ""
                page = fill("<body>" + "".join(top) + shell.replace("{main}", inner) + "".join(tail) + "</body>")
                found = blocks(page)
                xs.append(block_features(found))
                ys += [b.mark == "1" for b in found]
    return np.concatenate(xs), np.array(ys)


# --- the tree -----------------------------------------------------------------------------------


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2) -> list[tuple[int, float, int, int, float]]:
    """CART with Gini impurity: nodes (feature or -1, threshold, left, right, share of label 1)."""
    nodes: list[tuple[int, float, int, int, float]] = []

    def grow(rows: np.ndarray, level: int) -> int:
        me, share = len(nodes), float(y[rows].mean())
        nodes.append((-1, 0.0, -1, -1, share))
        if level == depth or share in (0.0, 1.0) or len(rows) < 2 * least:
            return me
        best = (1e-9, -1, 0.0)
        impurity = 2 * share * (1 - share) * len(rows)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            value, label = x[order, f], y[order]
            ones, n = np.cumsum(label), np.arange(1, len(order) + 1)
            right_n, right_ones = len(order) - n, ones[-1] - ones
            with np.errstate(divide="ignore", invalid="ignore"):
                gini = 2 * ones * (n - ones) / n + np.where(right_n > 0, 2 * right_ones * (right_n - right_ones) / np.maximum(right_n, 1), 0)
            cut = np.flatnonzero((value[:-1] < value[1:]) & (n[:-1] >= least) & (right_n[:-1] >= least))
            if len(cut):
                i = cut[gini[cut].argmin()]
                if impurity - gini[i] > best[0] + 1e-9:
                    best = (impurity - gini[i], f, float(value[i] + value[i + 1]) / 2)
        _, f, threshold = best
        if f >= 0:
            goes_left = x[rows, f] <= threshold
            left, right = grow(rows[goes_left], level + 1), grow(rows[~goes_left], level + 1)
            nodes[me] = (f, threshold, left, right, share)
        return me

    grow(np.arange(len(y)), 0)
    return nodes


@lru_cache(1)
def default_tree() -> tuple[tuple[int, float, int, int, float], ...]:
    return tuple(fit_tree(*labelled_blocks()))


def classify(tree, x: np.ndarray) -> np.ndarray:
    keep = np.zeros(len(x), bool)
    for i, row in enumerate(x):
        node = tree[0]
        while node[0] >= 0:
            node = tree[node[2] if row[node[0]] <= node[1] else node[3]]
        keep[i] = node[4] >= 0.5
    return keep


def main_text(page: str | None, tree=None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = classify(tree or default_tree(), block_features(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract_text(pages: DataFrame, column: str = "html", into: str = "text", tree=None) -> DataFrame:
    """``page_id, url`` and the main text of each page; map-only. The tree travels with the task."""
    tree = tree or default_tree()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", into])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(column).cast("string").alias(column)).mapInArrow(
        extract, f"page_id long, url string, `{into}` string"
    )


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
