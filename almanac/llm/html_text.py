"""Main text of web pages by a tree-structured graphical model.

A page's block elements form a tree. Each node's own features give it a potential for being content,
each edge a potential for the pair of labels of parent and child, which depends on what kind of
element the child is. Messages pass from the leaves to the root and back (sum-product), which on
a tree gives each node's exact marginal; the blocks of nodes that are more likely content than not
are the text. All potentials are trained together on labelled pages: the slope of the likelihood is what the
labels count less what the messages expect. A `data-content` attribute on a node labels it and what is below it, up to the next label.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.packed import tune

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One step through a tag: to its end, or over an attribute whose value may be in quotes; without regard to quotes in PLAIN.
STEP = re.compile(r"[\s/]*(?:(>)|[^\s/>][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)?)")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not text of the page, or not markup.
RAW = frozenset("script style textarea title noscript template iframe object canvas xmp noembed noframes select".split())
BLOCK = frozenset("html head body article main section div p h1 h2 h3 h4 h5 h6 nav header footer aside form fieldset ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption blockquote pre address details summary hgroup center dialog menu search button".split())
#: What an opening tag closes if it is open, and the elements beyond which it does not look.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
FENCE = frozenset("ul ol dl table body html article section div main aside nav".split())
CLOSE_P = BLOCK - {"html", "head", "body", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "button"}

KINDS = ("article", "main", "section", "div", "p", "heading", "nav", "header", "footer", "aside", "form", "list", "item", "table", "quote", "other")
KIND = {t: i for i, k in enumerate(KINDS) for t in {"heading": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl menu", "item": "li dt dd", "table": "table caption thead tbody tfoot tr td th", "quote": "blockquote pre figure figcaption", "form": "form fieldset button search dialog"}.get(k, k).split()}
#: Words in class, id and role that tell content from its surroundings.
AROUND = frozenset("nav menu navbar navigation sidebar side footer foot header head masthead topbar ad ads adv advert advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent notice gdpr alert popup modal overlay toast comment comments reply replies respond discussion disqus share sharing social follow related recommended recommendation more popular trending subscribe subscription newsletter signup login search breadcrumb breadcrumbs crumbs pagination pager tags widget copyright legal disclaimer form complementary contentinfo toolbar skip".split())
CONTENT = frozenset("article content post entry story main body text prose blog single page maincontent articlebody postcontent entrycontent".split())


class Node:
    __slots__ = ("above", "around", "content", "kind", "label", "links", "size", "tag", "ends")

    def __init__(self, tag: str, above: int, attributes: str):
        self.tag, self.above, self.kind = tag, above, KIND.get(tag, len(KINDS) - 1)
        self.size = self.links = self.ends = 0
        self.around = self.content = False
        self.label = None
        if attributes and "=" in attributes:
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                name = name.lower()
                if name in ("class", "id", "role"):
                    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower())
                    self.around |= not AROUND.isdisjoint(words)
                    self.content |= not CONTENT.isdisjoint(words)
                elif name == "data-content":
                    self.label = (a or b or c) == "1"


def tokens(page: str):
    """(kind, name or text, attributes) of a page in order; kinds are text, raw (not to be decoded), open and close. Every character is passed over a bounded number of times.

    A tag that does not end before the page is text; where quotes leave a tag open to the end of the page, they count as plain characters from there on.
    """
    at, n, last, quotes = 0, len(page), page.rfind(">"), {q: page.rfind(q) for q in "\"'"}
    while at < n:
        start = page.find("<", at)
        if start < 0 or start > last:
            yield "text", page[at:], ""
            return
        if start > at:
            yield "text", page[at:start], ""
        ends = page.startswith("</", start)
        name = NAME.match(page, start + 1 + ends)
        if name is None:
            for mark, close in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">"), ("</", ">")):
                if page.startswith(mark, start):
                    stop = page.find(close, start + len(mark))
                    stop = n if stop < 0 else stop
                    if mark == "<![CDATA[":
                        yield "raw", page[start + len(mark) : stop], ""
                    at = stop + len(close)
                    break
            else:
                yield "text", "<", ""
                at = start + 1
            continue
        place = name.end()
        while place < n:
            step = STEP.match(page, place)
            if step is None or step.end() == place:
                # A quote that nothing closes, or a lone sign: one plain character.
                place += 1
                continue
            place = step.end()
            if step.group(1):
                break
            if place < n and page[place - 1] == "=" and page[place] in quotes and quotes[page[place]] <= place:
                place += 1
        else:
            last_plain = page.find(">", name.end())
            if last_plain < 0:
                yield "text", page[start:], ""
                return
            quotes, place = {}, last_plain + 1
        yield ("close" if ends else "open"), name.group().lower(), page[name.end() : place - 1]
        at = place
        if not ends and name.group().lower() in RAW and not page[name.end() : place - 1].endswith("/"):
            end = re.compile(rf"</{re.escape(name.group())}(?=[\s/>])", re.I).search(page, at)
            stop = page.find(">", end.end()) if end else -1
            at = n if stop < 0 else stop + 1


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order, the root first, and the text blocks (node, text) in page order.

    Character references are decoded in each run of text between tags, so one that a tag cuts is none.
    """
    nodes, blocks, stack = [Node("html", -1, "")], [], [("html", 0)]
    part: list[str] = []
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if part:
            text = SPACES.sub(" ", "".join(part)).strip()
            part.clear()
            if text:
                node = nodes[stack[-1][1]]
                node.size += len(text)
                node.links += min(linked, len(text))
                node.ends += sum(map(text.count, ".!?,;:"))
                blocks.append((stack[-1][1], text))
        linked = 0

    def close(names, fence=frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                flush()
                del stack[i:]
                return
            if stack[i][0] in fence:
                return

    def say(s: str) -> None:
        nonlocal linked
        part.append(s)
        if in_link:
            linked += len(s)

    for kind, name, attributes in tokens(page):
        if kind == "text":
            say(html.unescape(name))
        elif kind == "raw":
            say(name)
        elif kind == "close":
            if name == "a":
                in_link = False
            elif name in BLOCK and deep(stack, name):
                close((name,))
            elif name == "br":
                say(" ")
        elif name in VOID:
            if name in ("br", "hr", "img"):
                say(" ")
        elif name == "a":
            in_link = not attributes.endswith("/")
        elif name in BLOCK:
            if name in ("html", "body", "head") and any(s[0] == name for s in stack[1:4]):
                continue
            flush()
            if name in CLOSES:
                close(CLOSES[name], FENCE)
            if name in CLOSE_P:
                close(("p",), FENCE)
            if name[0] == "h" and name[1:].isdigit() and stack[-1][0][0] == "h" and stack[-1][0][1:].isdigit():
                stack.pop()
            # Far down, elements stand beside each other: the tree keeps a bounded depth.
            if len(stack) > DEEPEST:
                stack.pop()
            nodes.append(Node(name, stack[-1][1], attributes))
            stack.append((name, len(nodes) - 1))
            in_link = False
    flush()
    return nodes, blocks


#: Open elements at once; more than any page is written with.
DEEPEST = 256


def deep(stack: list, name: str) -> bool:
    return any(s[0] == name for s in stack)


#: Kinds of child for the edges: what its tag and names suggest.
EDGES = 5
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption li dd dt".split())


def edge_kind(node: Node) -> int:
    if node.tag in ("nav", "footer", "aside", "form", "fieldset", "search", "dialog", "button") or (node.around and node.tag not in LEAVES):
        return 0
    if node.tag in ("article", "main") or node.content:
        return 1
    if node.tag in LEAVES:
        return 4 if node.around else 3
    return 2


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node: its kind, names, text, links, and whether an ancestor is named either way or the page has such an element at all."""
    n = len(nodes)
    out = np.zeros((n, len(KINDS) + 22))
    below, below_links = [x.size for x in nodes], [x.links for x in nodes]
    for i in range(n - 1, 0, -1):
        a = nodes[i].above
        below[a] += below[i]
        below_links[a] += below_links[i]
    within = [(False, False)] * n
    kinds = [edge_kind(x) for x in nodes]
    for i, x in enumerate(nodes):
        up = within[x.above] if i else (False, False)
        within[i] = (up[0] or kinds[i] == 0, up[1] or kinds[i] == 1)
    named = any(k == 1 and not w[0] for k, w in zip(kinds, within, strict=True))
    # Words outside links and surroundings: what of the page may be prose at all.
    prose = [0 if w[0] else x.size - x.links for x, w in zip(nodes, within, strict=True)]
    for i in range(n - 1, 0, -1):
        prose[nodes[i].above] += prose[i]
    whole = max(1, prose[0])
    for i, x in enumerate(nodes):
        up, kind = within[x.above] if i else (False, False), kinds[i]
        row = out[i]
        row[x.kind] = 1
        k = len(KINDS)
        row[k : k + 22] = (
            1, x.around and kind == 0, x.content, up[0], up[1], up[1] and not up[0], x.size > 0, x.size > 80, x.size > 250, min(1.0, x.links / x.size) if x.size else 0,
            min(1.0, below_links[i] / below[i]) if below[i] else 0, min(1.0, 20 * x.ends / x.size) if x.size else 0, below[i] > 500, below[i] == 0,
            named and not (up[1] or kind == 1), not named and not up[0] and kind != 0, prose[i] > 0.5 * whole, x.around and kind == 4,
            kind == 1 and not up[0], up[1] and not within[i][0], prose[i] > 0.9 * whole, not named and not within[i][0] and prose[i] > 0.25 * whole,
        )
    return out


class Forest:
    """The trees of one page or many, level by level, so that messages of a level are sent at once."""

    def __init__(self, pages: list[list[Node]]):
        above, kind, level, at = [], [], [], 0
        for nodes in pages:
            for i, x in enumerate(nodes):
                above.append(at + x.above if i else -1)
                kind.append(edge_kind(x))
                level.append(level[at + x.above] + 1 if i else 0)
            at += len(nodes)
        self.above, self.kind, level = np.array(above, np.int64), np.array(kind, np.int64), np.array(level, np.int64)
        order = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[order], np.arange(level.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.starts = np.cumsum([0, *map(len, pages)])

    def messages(self, own: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(content) of each node, P(label of parent, label of node) of each node but the roots), from the log-odds of nodes and the log-potentials of edges.

        Sum-product in logarithms: messages go up from the deepest level, then down.
        """
        n = len(own)
        up = np.stack([np.zeros(n), own], axis=1)
        sent, down, both = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2, 2))
        for at in self.levels[:0:-1]:
            m = np.logaddexp.reduce(edges[self.kind[at]] + up[at][:, None, :], axis=2)
            sent[at] = m - m.max(axis=1, keepdims=True)
            np.add.at(up, self.above[at], sent[at])
        for at in self.levels[1:]:
            a = self.above[at]
            rest = up[a] + down[a] - sent[at]
            pair = rest[:, :, None] + edges[self.kind[at]]
            m = np.logaddexp.reduce(pair, axis=1)
            down[at] = m - m.max(axis=1, keepdims=True)
            pair = pair + up[at][:, None, :]
            pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
            both[at] = pair / pair.sum(axis=(1, 2), keepdims=True)
        belief = up + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), both


class Model:
    """Weights of the node potentials, and the log-potentials of edges (kind of child, label of parent, label of child)."""

    def __init__(self, weights: np.ndarray, edges: np.ndarray):
        self.weights, self.edges = weights, edges

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """P(content) of each node of a page."""
        return Forest([nodes]).messages(features(nodes) @ self.weights, self.edges)[0]

    def texts(self, pages: list[str | None]) -> list[str]:
        """The content blocks of each page, one to a line. Null and empty pages, and those without content, give an empty text."""
        parsed = [parse(p or "") for p in pages]
        if not parsed:
            return []
        forest = Forest([nodes for nodes, _ in parsed])
        p = forest.messages(np.concatenate([features(nodes) for nodes, _ in parsed]) @ self.weights, self.edges)[0]
        return ["\n".join(t for i, t in blocks if p[at + i] > 0.5) for at, (_, blocks) in zip(forest.starts, parsed, strict=False)]

    def text(self, page: str | None) -> str:
        return self.texts([page])[0]


def labels(nodes: list[Node]) -> np.ndarray:
    out = [False] * len(nodes)
    for i, x in enumerate(nodes):
        out[i] = x.label if x.label is not None else out[x.above] if i else False
    return np.array(out, float)


def train(pages: list[str], rounds: int = 200) -> Model:
    """Both kinds of potentials by the likelihood of the pages' labels.

    In each round messages pass over all pages, and the weights follow what the labels count less what the marginals expect, with momentum
    and a small pull to zero.
    """
    parsed = [parse(page)[0] for page in pages]
    forest = Forest(parsed)
    x, y = np.concatenate([features(nodes) for nodes in parsed]), np.concatenate([labels(nodes) for nodes in parsed])
    child = np.flatnonzero(forest.above >= 0)
    cell = forest.kind[child] * 4 + 2 * y[forest.above[child]].astype(int) + y[child].astype(int)
    told = np.bincount(cell, minlength=4 * EDGES).reshape(EDGES, 2, 2)
    w, edges = np.zeros(x.shape[1]), np.zeros((EDGES, 2, 2))
    moves = [np.zeros_like(w), np.zeros_like(edges)]
    for step in range(rounds):
        p, both = forest.messages(x @ w, edges)
        expected = np.zeros((EDGES, 2, 2))
        np.add.at(expected, forest.kind[child], both[child])
        rate = 4.0 / (1 + step / 100)
        for k, (value, slope) in enumerate(((w, x.T @ (y - p) / len(y) - 2e-4 * w), (edges, (told - expected) / len(y) - 2e-4 * edges))):
            moves[k] = 0.85 * moves[k] + rate * slope
            value += moves[k]
    return Model(w, edges)


WORDS = "the river people small water house market children garden winter morning road light paper story music window summer letter village teacher forest mountain bread stone evening station doctor island history science language number answer question picture".split()


def unnamed(page: str, r: random.Random) -> str:
    """The page with every class and id replaced by one that says nothing."""
    return re.sub(r'(class|id)="[^"]*"', lambda m: f'{m[1]}="x{r.randrange(99)}"', page)


def labelled_pages(count: int = 480, seed: int = 5) -> list[str]:
    """Pages in the common layouts with labelled content, drawn by rule."""
    r = random.Random(seed)
    words = lambda a, b: " ".join(r.choice(WORDS) for _ in range(r.randint(a, b)))
    sentence = lambda: words(4, 18).capitalize() + r.choice([".", ".", ",", "!", " |"])
    prose = lambda: " ".join(sentence() for _ in range(r.randint(1, 7)))
    links = lambda n: "".join(f'<li><a href="/{w}">{w}</a></li>' for w in (words(1, 2) for _ in range(n)))
    bold = lambda s: f"<b>{s}" if r.random() < 0.2 else s

    def body() -> str:
        out = [f"<h1>{words(3, 9)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 8)):
            out.append(r.choice([lambda: f'<p class="{r.choice(["more", "lead", "x7", "text", "note", "share"])}">{prose()}</p>', lambda: f"<p>{prose()} <math><mi>{words(1, 1)}</mi><mo>=</mo><mn>1</mn></math> {words(2, 5)}.</p>", lambda: f"<p>{bold(prose())}</p>", lambda: f"<p>{bold(prose())}<br>", lambda: f"<p>{prose()} <a href='#'>{words(1, 3)}</a> {words(2, 6)}</p>", lambda: f"<h2>{words(2, 6)}</h2><p>{prose()}</p>", lambda: f"<ul><li>{sentence()}</li><li>{sentence()}</li></ul>", lambda: f"<blockquote>{prose()}</blockquote>", lambda: f"<p>{words(1, 4)}", lambda: f"<div>{prose()}</div>", lambda: f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", lambda: f"<pre>{prose()}</pre>"])())
        return "".join(out)

    extra = {
        "nav": lambda: r.choice([f"<nav><ul>{links(6)}</ul></nav>", f'<div class="menu"><ul>{links(5)}</ul></div>', f'<ul class="breadcrumbs">{links(3)}</ul>', f'<div id="topbar"><a href="/">{words(1, 2)}</a> <a href="/a">{words(1, 2)}</a></div>']),
        "head": lambda: r.choice([f"<header><h1>{words(1, 3)}</h1><p>{words(3, 8)}</p></header>", f'<div id="header"><div class="logo">{words(1, 2)}</div></div>', f'<header class="site-header"><ul>{links(3)}</ul></header>']),
        "ad": lambda: f'<div class="{r.choice(["ad", "ads", "advert", "promo", "sponsored-box", "banner"])}">{r.choice([prose, sentence])()}</div>',
        "side": lambda: r.choice([f"<aside><h3>{words(2, 4)}</h3><ul>{links(5)}</ul></aside>", f'<div class="sidebar"><p>{prose()}</p><ul>{links(4)}</ul></div>', f"<aside><p>{prose()}</p></aside>", f'<div class="related"><h3>{words(1, 3)}</h3><ul>{links(4)}</ul></div>', f'<section class="related-posts"><p>{prose()}</p></section>']),
        "note": lambda: f'<div class="{r.choice(["cookie-notice", "cookie", "notice", "consent", "alert", "gdpr"])}"><p>{prose()}</p><button>{words(1, 2)}</button></div>',
        "form": lambda: r.choice([f'<form action="/s"><label>{words(1, 3)}</label><input name="q"><button>{words(1, 1)}</button></form>', f'<div class="newsletter"><p>{sentence()}</p><form><input><button>{words(1, 2)}</button></form></div>', f"<form><p>{prose()}</p><select><option>{words(1, 1)}</select></form>"]),
        "comments": lambda: r.choice(['<div class="comments">{}</div>', '<section id="comments">{}</section>', '<ol class="commentlist">{}</ol>']).format("".join(r.choice([f'<div class="comment"><p>{prose()}</p></div>', f"<p>{prose()}</p>", f"<article><h4>{words(1, 2)}</h4><p>{prose()}</p></article>", f"<li><p>{prose()}</p></li>"]) for _ in range(r.randint(1, 4)))),
        "foot": lambda: r.choice([f"<footer>&copy; {words(1, 3)} &middot; {r.choice([prose, sentence])()}</footer>", f'<div class="footer"><p>{prose()}</p></div>', f"<footer><p>{prose()}</p><ul>{links(4)}</ul></footer>"]),
        "share": lambda: f'<div class="{r.choice(["share", "social-share", "tags", "author-follow"])}">{links(3)}</div>',
    }
    drop = lambda s: s.replace(">", ' data-content="0">', 1)
    pick = lambda *names: "".join(drop(extra[n]()) for n in names if r.random() < 0.6)
    out = []
    for _ in range(count):
        inner = body()
        if r.random() < 0.35:
            cut = inner.find("<p>", len(inner) // 2)
            inner = inner if cut < 0 else inner[:cut] + pick("ad", "side", "form", "note") + inner[cut:]
        inner += pick("share", "comments") if r.random() < 0.35 else ""
        main = r.choice(['<article data-content="1">{}</article>'] * 4 + ['<main data-content="1">{}</main>', '<main><article data-content="1">{}</article></main>', '<div class="content" data-content="1">{}</div>', '<div id="main"><div class="post-content" data-content="1">{}</div></div>', '<section class="entry" data-content="1">{}</section>', '<div data-content="1">{}</div>', '<div class="row"><div class="story-body" data-content="1">{}</div></div>']).format(inner)
        shape = r.random()
        if shape > 0.88:
            # A short article in a bare page.
            inner = r.choice([lambda: f"<p>{prose()}</p>", lambda: f"<h1>{words(2, 6)}</h1><p>{prose()}</p>", lambda: f"<p>{sentence()}</p>"])()
            main = r.choice(['<article data-content="1">{}</article>', '<main data-content="1">{}</main>', '<div class="content" data-content="1">{}</div>', '<div data-content="1">{}</div>']).format(inner)
            out.append(f"<html><body>{pick(r.choice(['nav', 'head', 'ad', 'note']))}{main}{pick(r.choice(['foot', 'side']))}</body></html>")
            continue
        if shape < 0.06:
            # No element says what is what: text alone, or paragraphs in the body.
            out.append(f'<body data-content="1">{r.choice([prose, sentence, body, lambda: f"<div>{prose()}</div>{prose()}", lambda: f"<p>{prose()}</p>"])()}</body>')
            continue
        if shape < 0.28:
            rest = lambda: "".join(drop(f"<div>{r.choice([lambda: words(1, 2), lambda: f'<a href=#>{words(1, 2)}</a>', lambda: ' '.join(f'<a href=#>{words(1, 2)}</a>' for _ in range(r.randint(3, 7))), lambda: f'<ul>{links(r.randint(3, 8))}</ul>'])()}</div>") for _ in range(r.randint(0, 2)))
            around, inner = rest(), r.choice([body, body, lambda: f"<p>{' '.join(prose() for _ in range(3))}</p>", lambda: "".join(f"<p>{sentence()}</p>" for _ in range(r.randint(3, 9)))])()
            main = r.choice(['<div data-content="1">{}</div>', '<table><tr><td data-content="1">{}</td></tr></table>', f'<table><tr><td data-content="0"><ul>{links(4)}</ul></td><td data-content="1">{{}}</td></tr></table>', f'<table><tr><td data-content="0">{" ".join(f"<a href=#>{words(1, 2)}</a>" for _ in range(4))}</td><td data-content="1">{{}}</td></tr></table>', '<div><div data-content="1">{}</div></div>', '<section data-content="1">{}</section>']).format(inner)
        else:
            around = pick("note", "head", "nav", "ad")
        page = f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title><style>p{{}}</style></head><body>{around}{main}{pick('side', 'ad', 'comments', 'form', 'share', 'foot') if shape >= 0.28 else rest()}</body></html>"
        if shape < 0.28:
            page = unnamed(page, r)
        out.append(page)
    return out


def main_text(model: Model, page: str = "html") -> Column:
    def texts(pages: pd.Series) -> pd.Series:
        return pd.Series(model.texts([p if isinstance(p, str) else None for p in pages]), dtype=object)

    return F.pandas_udf(texts, "string")(page)


def extract(pages: DataFrame, labelled: list[str] | None = None, page: str = "html") -> DataFrame:
    """pages with the columns text and n_chars, of those named before replaced; a row for each row, whatever is in it.

    The model is trained on `labelled` pages, by default 480 drawn by rule, on the driver.
    """
    tune(pages.sparkSession)
    model = train(labelled or labelled_pages())
    return pages.withColumn("text", main_text(model, page)).withColumn("n_chars", F.length("text").cast("long"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
