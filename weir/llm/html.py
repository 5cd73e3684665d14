"""Main text of web pages by boosted trees over DOM-node features (operator 7).

A page is parsed into block elements and the runs of text that stand directly in them. Boosted trees give each node
the odds of holding main text, from its own text, its subtree's densities, its tag and attribute tokens and those of
its ancestors, its depth and its siblings. The decoding is hierarchical: a node can only be kept below kept ones and
an element only with something kept in it; of all such choices the likeliest is taken. The trees are fitted, when a
query is planned, on ``TRAINING_PAGES`` pages made by rule (``made_page``), whose nodes' labels are known.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm import boost
from weir.llm.shared import release, slices

TRAINING_PAGES = 700

#: Element kinds and attribute tokens.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("script style template noscript iframe svg canvas audio video select textarea button title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
GOOD = frozenset("article articlebody body content contents entry main post story text page blog news".split())
BAD = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar topbar dropdown skip sitemap toc".split(),
    "frame": "header head masthead footer foot bottom copyright legal logo branding".split(),
    "side": "sidebar side aside widget widgets rail secondary related recommended recommendations popular trending more teaser".split(),
    "advert": "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion outbrain taboola dfp".split(),
    "notice": "cookie cookies consent notice notification alert gdpr privacy popup modal overlay paywall disclaimer warning".split(),
    "form": "form login signin signup register search subscribe subscription newsletter contact".split(),
    "comment": "comment comments reply replies respond discussion disqus feedback reviews".split(),
    "share": "share sharing social follow facebook twitter tags tag meta byline author bio credits".split(),
}
BAD_KIND = {token: k for k, tokens in enumerate(BAD.values()) for token in tokens}
TAG_KINDS = ("p", "h", "li", "list", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "cell", "quote", "pre", "figure", "body", "run")
_KIND = {
    **{f"h{i}": "h" for i in range(1, 7)}, "ul": "list", "ol": "list", "dl": "list", "menu": "list", "dd": "li", "dt": "li", "td": "cell", "th": "cell", "tr": "cell",
    "thead": "table", "tbody": "table", "tfoot": "table", "blockquote": "quote", "figcaption": "figure", "html": "body", "fieldset": "form", "legend": "form", "hgroup": "header",
}
#: Elements that end an open element of the given kinds.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset("ul ol dl menu table body html".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
_TOKEN_ATTRIBUTES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKENS = re.compile(r"[a-z]+")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in SKIPPED}


class Node:
    __slots__ = ("attributes", "children", "links", "parent", "tag", "text")

    def __init__(self, tag: str, parent: int, attributes: str = ""):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list[int] = []
        self.text = ""  # of runs, or of elements that hold nothing but one run
        self.links = 0  # its characters within links


def parse(page: str) -> list[Node]:
    """Nodes in page order, the first one the root."""
    nodes = [Node("body", -1)]
    stack = [0]
    parts: list[str] = []
    linked = 0  # characters of the run within links
    in_link = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                nodes.append(Node("#run", stack[-1]))
                nodes[-1].text, nodes[-1].links = text, min(linked, len(text))
                nodes[stack[-1]].children.append(len(nodes) - 1)
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len(text)

    at = 0
    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in BLOCKS and tag not in ("html", "body"):
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == tag:
                        flush()
                        in_link = False
                        del stack[k:]
                        break
        elif tag == "a":
            in_link = True
        elif tag in SKIPPED:
            if not m[3].endswith("/"):
                end = _ENDS[tag].search(page, at)
                at = end.start() if end else len(page)
        elif tag == "br" or tag == "hr":
            add(" ")
        elif tag in BLOCKS and tag not in ("html", "body"):
            flush()
            in_link = False
            if nodes[stack[-1]].tag == "p":
                stack.pop()
            elif tag in CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    own = nodes[stack[k]].tag
                    if own in CLOSES[tag]:
                        del stack[k:]
                    if own in _SCOPE:
                        break
            nodes.append(Node(tag, stack[-1], m[3]))
            nodes[stack[-1]].children.append(len(nodes) - 1)
            stack.append(len(nodes) - 1)
        elif tag in ("html", "body"):
            nodes[0].attributes += m[3]
    if at < len(page):
        add(page[at:])
    flush()
    return _without_single_runs(nodes)


def _without_single_runs(nodes: list[Node]) -> list[Node]:
    """An element whose only child is a run takes its text."""
    drop = set()
    for node in nodes[1:]:
        if len(node.children) == 1 and nodes[node.children[0]].tag == "#run":
            child = node.children[0]
            node.text, node.links, node.children = nodes[child].text, nodes[child].links, []
            drop.add(child)
    if not drop:
        return nodes
    place, kept = {}, []
    for i, node in enumerate(nodes):
        if i not in drop:
            place[i] = len(kept)
            kept.append(node)
    for node in kept:
        node.parent = place.get(node.parent, -1)
        node.children = [place[c] for c in node.children]
    return kept


@lru_cache(maxsize=20_000)
def attribute_counts(attributes: str) -> tuple[int, ...]:
    """Good tokens, then bad ones by kind, in a start tag's class, id and role."""
    counts = [0] * (1 + len(BAD))
    for m in _TOKEN_ATTRIBUTES.finditer(attributes):
        for token in _TOKENS.findall((m[1] or m[2] or m[3] or "").lower()):
            if token in BAD_KIND:
                counts[1 + BAD_KIND[token]] += 1
            elif token in GOOD:
                counts[0] += 1
    return tuple(counts)


_NO_COUNTS = (0,) * (1 + len(BAD))
_STOPS = re.compile(r"[.!?…。！？]")
N_BAD = len(BAD)
_TAG_NUMBER = {t: i for i, t in enumerate(TAG_KINDS)}


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node."""
    n = len(nodes)
    own, links, stops = [len(x.text) for x in nodes], [x.links for x in nodes], [len(_STOPS.findall(x.text)) if x.text else 0 for x in nodes]
    chars, linked, stopped, leaves, size = own[:], links[:], stops[:], [int(bool(x.text)) for x in nodes], [1] * n
    for i in range(n - 1, 0, -1):
        up = nodes[i].parent
        chars[up] += chars[i]
        linked[up] += linked[i]
        stopped[up] += stopped[i]
        leaves[up] += leaves[i]
        size[up] += size[i]
    tags = [Counter(nodes[c].tag for c in x.children) for x in nodes]
    total = max(1, chars[0])
    depth, good, bad, above, before = [0] * n, [0] * n, [0] * n, [0] * n, 0
    rows = []
    for i, node in enumerate(nodes):
        up = node.parent
        counts = attribute_counts(node.attributes) if node.attributes else _NO_COUNTS
        kind = _TAG_NUMBER.get("run" if node.tag == "#run" else _KIND.get(node.tag, node.tag), 4)
        boiler = kind in _BOILER
        if up >= 0:
            depth[i] = depth[up] + 1
            good[i], bad[i], above[i] = good[up] + counts[0] + (kind in _CONTENT), bad[up] + sum(counts[1:]), above[up] + boiler
            siblings = nodes[up].children
            alike, same = tags[up][node.tag], chars[up] - own[up]
            parent_kind, up_chars, up_links = _TAG_NUMBER.get(_KIND.get(nodes[up].tag, nodes[up].tag), 4), chars[up], linked[up]
        else:
            siblings, alike, same, parent_kind, up_chars, up_links = (), 1, chars[i], -1, chars[i], linked[i]
        length = max(1, chars[i])
        rows.append((
            *(float(kind == k) for k in range(len(TAG_KINDS))),
            own[i], chars[i], chars[i] / total, linked[i] / length, stopped[i] / length, stopped[i], leaves[i], length / max(1, leaves[i]), size[i],
            depth[i], len(siblings), alike, same / max(1, up_chars), chars[i] / max(1, same), up_links / max(1, up_chars), parent_kind, before / total,
            *counts, good[i], bad[i], above[i], bad[i] - sum(counts[1:]),
        ))
        before += own[i]
    return np.array(rows, np.float64)


_BOILER = frozenset(_TAG_NUMBER[t] for t in ("nav", "header", "footer", "aside", "form"))
_CONTENT = frozenset(_TAG_NUMBER[t] for t in ("article", "main"))


def decode(nodes: list[Node], margins: np.ndarray) -> list[int]:
    """The kept nodes with text, in page order, of the likeliest choice without contradictions."""
    yes = -np.logaddexp(0, -margins)  # log p
    no = -np.logaddexp(0, margins)
    n = len(nodes)
    dropped = no.tolist()
    kept = yes.tolist()
    # for elements: the sum over children, and the least loss by keeping one that were better dropped
    gain, loss, some = [0.0] * n, [np.inf] * n, [False] * n
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if node.text and not node.children:
            pass
        elif not some[i] and loss[i] == np.inf:
            kept[i] = -np.inf  # nothing in it can be kept
        else:
            kept[i] += gain[i] - (0.0 if some[i] else loss[i])
        up = node.parent
        if up >= 0:
            dropped[up] += dropped[i]
            gain[up] += max(kept[i], dropped[i])
            if kept[i] > dropped[i]:
                some[up] = True
            elif kept[i] > -np.inf:
                loss[up] = min(loss[up], dropped[i] - kept[i])
    choice = [False] * n
    out = []
    for i, node in enumerate(nodes):
        up = node.parent
        if up < 0:
            choice[i] = kept[i] > dropped[i]
        elif choice[up]:
            choice[i] = kept[i] > dropped[i] or (not some[up] and kept[i] > -np.inf and dropped[i] - kept[i] == loss[up])
        if choice[i] and node.text:
            out.append(i)
    return out


def extract(pages: list[str | None], trees: boost.Trees) -> list[str]:
    parsed = [parse(page or "") for page in pages]
    rows = [features(nodes) for nodes in parsed]
    if not rows:
        return []
    margins = trees.margins(np.concatenate(rows))
    out, at = [], 0
    for nodes in parsed:
        out.append("\n".join(nodes[i].text for i in decode(nodes, margins[at : at + len(nodes)])))
        at += len(nodes)
    return out


# --- training pages -------------------------------------------------------------------------------------------------


def _words(rng: random.Random, low: int, high: int) -> str:
    syllables = "ka lo mi ter un sch é ña ing der qu est ra von par los tion ue ßen ch ou".split()
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    return " ".join(words)


def _sentences(rng: random.Random, low: int, high: int) -> str:
    return " ".join(_words(rng, 1, 18).capitalize() + rng.choice([".", ".", ".", "!", "?"]) for _ in range(rng.randint(low, high)))


#: A marker that made pages carry in text that should be kept.
MARK = "\ue000"


def made_page(rng: random.Random) -> str:
    """A page of random furniture around an article; kept blocks begin with ``MARK``."""
    mark = lambda s: MARK + s
    link = lambda: f'<a href="/{rng.randint(1, 999)}">{_words(rng, 1, 4)}</a>'

    def attribute(tokens: list[str], odds: float = 0.8) -> str:
        if rng.random() > odds:
            return rng.choice(["", f' class="c{rng.randint(1, 99)}"'])
        token = rng.choice(tokens)
        return f' {rng.choice(["class", "id", "class"])}="{rng.choice([token, token, f"{token}-wrap", f"site-{token}", f"x {token} y"])}"'

    def links(tag: str, tokens: list[str]) -> str:
        own = [link() for _ in range(rng.randint(2, 12))]
        body = "<ul>" + "".join(f"<li>{a}</li>" for a in own) + "</ul>" if rng.random() < 0.7 else rng.choice([" | ", " ", " &middot; "]).join(own)
        return f"<{tag}{attribute(tokens, 0.4 if tag in ('nav', 'footer') else 0.9)}>{body}</{tag}>"

    def boiler(kind: str) -> str:
        tokens = BAD[kind]
        if kind == "menu":
            return links(rng.choice(["nav", "nav", "div"]), tokens)
        if kind == "frame":
            tag = rng.choice(["header", "footer", "footer", "div"])
            inner = rng.choice([f"&copy; {_words(rng, 1, 6)}", f"<p>{_sentences(rng, 1, 2)}</p>", f"<h1>{_words(rng, 1, 3)}</h1>", link() + " " + _words(rng, 1, 5), f"&copy; x &middot; {_sentences(rng, 1, 1)}"])
            return f"<{tag}{attribute(tokens, 0.3 if tag != 'div' else 0.95)}>{inner}</{tag}>"
        if kind == "side":
            tag = rng.choice(["aside", "div", "section"])
            inner = f"<h3>{_words(rng, 1, 4)}</h3>" + rng.choice([f"<p>{_sentences(rng, 1, 4)}</p>", links("div", tokens), f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(5))}</ul>"])
            return f"<{tag}{attribute(tokens, 0.4 if tag == 'aside' else 0.97)}>{inner}</{tag}>"
        if kind in ("advert", "notice"):
            tag = rng.choice(["div", "div", "section", "aside", "p"])
            text = _sentences(rng, 1, 4)
            inner = text if tag == "p" or rng.random() < 0.6 else f"<p>{text}</p>" + rng.choice(["", f"<p>{link()}</p>"])
            return f"<{tag}{attribute(tokens, 0.98)}>{inner}</{tag}>"
        if kind == "form":
            inner = f"<p>{_sentences(rng, 1, 2)}</p>" if rng.random() < 0.6 else f"<label>{_words(rng, 1, 5)}</label>"
            form = f"<form{attribute(tokens, 0.5)}>{inner}<input name=q><button>{_words(rng, 1, 2)}</button></form>"
            return form if rng.random() < 0.7 else f"<div{attribute(tokens, 0.95)}><h3>{_words(rng, 1, 4)}</h3>{form}</div>"
        if kind == "comment":
            one = lambda: f"<{(t := rng.choice(['div', 'li', 'article']))}{attribute(['comment', 'reply'], 0.9)}>{rng.choice(['', f'<h4>{_words(rng, 1, 2)}</h4>'])}<p>{_sentences(rng, 1, 5)}</p></{t}>"
            tag = rng.choice(["section", "div", "ol"])
            return f"<{tag}{attribute(['comments', 'comment', 'discussion', 'replies', 'responses comments'], 0.97)}><h3>{_words(rng, 1, 3)}</h3>{''.join(one() for _ in range(rng.randint(1, 6)))}</{tag}>"
        return f"<div{attribute(tokens, 0.97)}>{rng.choice([link() + link(), _words(rng, 1, 6), _words(rng, 1, 3) + ' ' + link()])}</div>"

    def block() -> str:
        r = rng.random()
        if r < 0.66:
            text = mark(_sentences(rng, *rng.choice([(1, 1), (1, 3), (2, 8), (5, 20)])))
            if rng.random() < 0.2:
                text += " " + link() + " " + _sentences(rng, 1, 2)
            return "<p>" + rng.choice(["", "", "", "<b>"]) + text + rng.choice(["</p>", "</p>", "</p>", "", "<br>"])
        if r < 0.76:
            tag = rng.choice(["h2", "h3"])
            return f"<{tag}>{mark(_words(rng, 1, 8))}</{tag}>"
        if r < 0.84:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{mark(_words(rng, 1, 14))}</li>" for _ in range(rng.randint(2, 6))) + f"</{tag}>"
        if r < 0.89:
            return f"<blockquote><p>{mark(_sentences(rng, 1, 3))}</p></blockquote>"
        if r < 0.92:
            return f"<pre>{mark(_words(rng, 3, 20))}</pre>"
        if r < 0.95:
            return f"<figure><img src=x><figcaption>{mark(_words(rng, 2, 10))}</figcaption></figure>"
        if r < 0.97:
            cells = lambda: "".join(f"<td>{mark(_words(rng, 1, 4))}</td>" for _ in range(3))
            return f"<table>{''.join(f'<tr>{cells()}</tr>' for _ in range(rng.randint(1, 4)))}</table>"
        return f"<div>{mark(_sentences(rng, 1, 4))}</div>"

    wrap = rng.choice(["article", "article", "article", "main", "div", "section", "td"])
    article = [f"<h1>{mark(_words(rng, 1, 12))}</h1>"] if rng.random() < 0.9 else []
    if article and wrap in ("article", "main") and rng.random() < 0.3:  # the article's own header holds its headline
        byline = f'<p class="{rng.choice(["byline", "meta", "author"])}">{_words(rng, 1, 6)}</p>' if rng.random() < 0.6 else ""
        article = [f"<header{attribute(['post-header', 'entry-header', 'head'], 0.3)}>{article[0]}{byline}</header>"]
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 15])):
        article.append(block())
        if rng.random() < 0.08:
            article.append(boiler(rng.choice(["advert", "share", "side", "form", "notice"])))
    if rng.random() < 0.15:
        article.append(boiler(rng.choice(["share", "comment"])))
    body = "".join(article)
    if wrap == "td":
        body = f"<table><tr><td>{body}</td></tr></table>"
    elif wrap != "div" or rng.random() < 0.9:
        body = f"<{wrap}{attribute(['content', 'article', 'post', 'entry', 'main', 'story', 'post-content', 'article-body'], 0.3 if wrap in ('article', 'main') else 0.7)}>{body}</{wrap}>"
    if rng.random() < 0.4:
        body = f"<div{attribute(['container', 'wrapper', 'page', 'main', 'layout'], 0.6)}>{body}{boiler('side') if rng.random() < 0.5 else ''}</div>"
    top = [boiler(k) for k in ("notice", "frame", "menu", "form", "advert") if rng.random() < 0.5]
    end = [boiler(k) for k in ("share", "comment", "side", "advert", "form", "menu", "frame", "notice") if rng.random() < 0.35]
    cut = "" if rng.random() < 0.2 else "</body></html>"
    return f"<!DOCTYPE html><html><head><title>{_words(rng, 1, 6)}</title><style>p{{}}</style></head><body>{''.join(top)}{body}{''.join(end)}{cut}"


@lru_cache(maxsize=1)
def fitted(pages: int = TRAINING_PAGES, seed: int = 7) -> boost.Trees:
    """Trees fitted on made pages; the same every time."""
    rng = random.Random(seed)
    rows, labels = [], []
    for _ in range(pages):
        nodes = parse(made_page(rng))
        wanted = [MARK in node.text for node in nodes]
        for node in nodes:
            node.text = node.text.replace(MARK, "")
        for i in range(len(nodes) - 1, 0, -1):
            wanted[nodes[i].parent] |= wanted[i]
        rows.append(features(nodes))
        labels += wanted
    return boost.fit(np.concatenate(rows), np.array(labels, float))


def main_text(df: DataFrame, id_col: str, url_col: str, html_col: str, trees: boost.Trees | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Character references are decoded, white space within a block is one space, blocks are joined by a line end. A null
    or empty page, and one without main text, has an empty text. Ids and urls pass through, null or repeated or not.
    """
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    shipped = df.sparkSession.sparkContext.broadcast(trees or fitted())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "html", 256):
            texts = extract(batch.column("html").to_pylist(), shipped.value)
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64()),
            })

    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars bigint")
