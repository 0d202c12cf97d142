"""Main text of web pages: a tree-structured graphical model over the nodes of a page.

Every element that holds text and every run of text is a node with two states, content or not. A node's own potential is a
sum of learned weights of its features (names, class words, length, links, ...); a potential of child and parent state connects
it with its parent, one table for each kind of child. Sum-product messages run from the leaves up and back down and give
exact marginals; runs whose content marginal is at least one half are the text. All nodes of one depth, over many
pages, are handled in one numpy step. Weights are trained on labelled pages by the exact gradient of the likelihood: observed
less expected features, the latter from the same messages.

Labelled pages are pages of the corpus whose author marked the article (``article`` or ``main``), as they are and laid out
again: their paragraphs in layouts with other names, with notices, forms, side columns, comments and adverts around
and between them, whose text comes from other parts of the pages.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom

PAGES = 200  # labelled pages the model is trained on, at most
LAYOUTS = 3
STEPS, RATE, SHRINK = 120, 0.1, 1e-4
TOGETHER = 200  # pages in one pass of messages
LONGEST_LABELLED = 60_000  # code points of a page that is trained on


@dataclass
class Forest:
    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]  # nodes of each depth
    node: np.ndarray  # a feature's node …
    feature: np.ndarray  # … and number


def forest(trees: list[dom.Tree]) -> Forest:
    parent, kind, depth, node, feature, base = [], [], [], [], [], 0
    for tree in trees:
        parent += [p + base if p >= 0 else -1 for p in tree.parent]
        kind += tree.kind
        depth += tree.depth
        for k, own in enumerate(tree.features):
            node += [base + k] * len(own)
            feature += own
        base += len(tree.parent)
    deep = np.array(depth)
    order = np.argsort(deep, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(deep))[:-1]) if len(deep) else []
    return Forest(np.array(parent), np.array(kind), levels, np.array(node), np.array(feature))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis)) + most.squeeze(axis)


@dataclass
class Model:
    weight: np.ndarray  # content against not, by feature
    edge: np.ndarray  # (kinds, parent state, child state)

    def messages(self, f: Forest, clamp: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Content marginal of each node, and (nodes, parent state, child state) of each node with its parent.

        ``clamp`` holds the known states, -1 where unknown.
        """
        n = len(f.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(f.node, self.weight[f.feature], n)
        if clamp is not None:
            own[clamp == 0, 1] = -1e9
            own[clamp == 1, 0] = -1e9
        up = np.zeros((n, 2))
        for level in reversed(f.levels[1:]):
            sent = _log_sum(self.edge[f.kind[level]] + own[level][:, None, :], 2)
            up[level] = sent
            for state in range(2):
                own[:, state] += np.bincount(f.parent[level], sent[:, state], n)
        belief = own.copy()
        joint = np.zeros((n, 2, 2))
        for level in f.levels[1:]:
            above = belief[f.parent[level]] - up[level]
            both = self.edge[f.kind[level]] + above[:, :, None]
            belief[level] = own[level] + _log_sum(both, 1)
            both = both + own[level][:, None, :]
            both = np.exp(both - both.max((1, 2), keepdims=True))
            joint[level] = both / both.sum((1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), joint


def fit(trees: list[dom.Tree], known: list[list[int]]) -> Model:
    """Adam on the likelihood of the known states; states of -1 are summed over."""
    f, clamp = forest(trees), np.array([s for states in known for s in states])
    model = Model(np.zeros(dom.FEATURES), np.zeros((dom.KINDS, 2, 2)))
    pairs = np.concatenate(f.levels[1:]) if len(f.levels) > 1 else np.zeros(0, int)
    slots = [np.zeros_like(model.weight), np.zeros_like(model.weight), np.zeros_like(model.edge), np.zeros_like(model.edge)]
    for step in range(1, STEPS + 1):
        free, free_joint = model.messages(f)
        seen, seen_joint = model.messages(f, clamp)
        lean = np.bincount(f.feature, (seen - free)[f.node], dom.FEATURES) / len(trees) - SHRINK * model.weight
        edge = np.zeros_like(model.edge)
        np.add.at(edge, f.kind[pairs], seen_joint[pairs] - free_joint[pairs])
        for value, gradient, m, v in ((model.weight, lean, slots[0], slots[1]), (model.edge, edge / len(trees) - SHRINK * model.edge, slots[2], slots[3])):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient * gradient - v)
            value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


# Names that layouts give to content and to other parts, in no particular page's spelling.
CONTENT_NAMES = (
    "content", "main content", "article", "article body", "post", "post content", "entry", "entry content", "story", "story body", "text", "body copy", "page content",
    "news text", "blog post", "reading", "primary",
)
OTHER_NAMES = {
    "nav": ("nav", "menu", "navigation", "breadcrumbs", "topbar", "navbar", "toc links", "pagination", "pager", "tabs"),
    "header": ("header", "masthead", "site header", "banner", "branding", "top"),
    "footer": ("footer", "site footer", "bottom", "copyright", "legal", "colophon"),
    "aside": ("sidebar", "side", "aside", "widget", "related", "related posts", "recommended", "popular", "trending", "tags", "author bio", "share", "social", "teaser", "more stories", "rail"),
    "notice": ("notice", "cookie", "cookie banner", "consent", "gdpr", "alert", "popup", "modal", "overlay", "message", "paywall", "privacy", "disclaimer", "warning"),
    "ad": ("ad", "ads", "advert", "advertisement", "ad box", "sponsor", "sponsored", "promo", "promotion", "adsense", "banner ad"),
    "form": ("form", "newsletter", "subscribe", "signup", "login", "search", "contact form", "search box"),
    "comments": ("comments", "comment", "comment list", "discussion", "replies", "responses", "reader comments", "disqus", "comment thread", "reviews"),
}
OTHER_TAGS = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"), "notice": ("div", "section", "aside", "dialog", "p"),
              "ad": ("div", "aside", "section", "p"), "form": ("form", "div"), "comments": ("section", "div", "aside", "ol")}
CONTENT_TAGS = ("article", "main", "div", "section", "body-part", "td", "")


def layout(blocks: list[str], spare: list[str], draw: random.Random) -> tuple[list[tuple[str, int]], str]:
    """A page from content ``blocks`` and ``spare`` texts: its runs in order with their states, and its HTML."""
    runs: list[tuple[str, int]] = []

    def leaf(tag: str, text: str, state: int, attributes: str = "") -> str:
        runs.append((text, state))
        safe = text.replace("&", "&amp;").replace("<", "&lt;")
        return f"<{tag}{attributes}>{safe}</{tag}>"

    def named(names: tuple[str, ...]) -> str:
        words = draw.choice(names).split(" ")
        joined = draw.choice((" ", "-", "_", ""))
        value = joined.join(words) if joined else words[0] + "".join(w.title() for w in words[1:])
        return f' {draw.choice(("class", "class", "class", "id"))}="{value}"' if draw.random() < 0.85 else ""

    def some(low: int, high: int) -> str:
        words = draw.choice(spare).split(" ")
        n = draw.randint(low, high)
        at = draw.randrange(max(len(words) - n, 1))
        return " ".join(words[at : at + n])

    def other(role: str) -> str:
        tag = draw.choice(OTHER_TAGS[role])
        attributes = named(OTHER_NAMES[role])
        if not attributes and tag not in ("nav", "header", "footer", "aside", "form"):
            attributes = f' class="{OTHER_NAMES[role][0]}"'
        if tag == "p":
            return leaf("p", some(3, 20), 0, attributes)
        inside = ""
        if role == "nav" or (role == "footer" and draw.random() < 0.5) or (role == "aside" and draw.random() < 0.6):
            items = [f'<a href="/{k}">{some(1, 3)}</a>' for k in range(draw.randint(2, 7))]
            if draw.random() < 0.7:
                runs.extend((_plain(x), 0) for x in items)
                inside = "".join(f"<li>{x}</li>" for x in items)
                inside = inside if tag == "ul" else f"<ul>{inside}</ul>"
            else:
                runs.append((_plain(" | ".join(items)), 0))
                inside = " | ".join(items)
        elif role == "comments":
            if draw.random() < 0.7:
                inside += leaf(draw.choice(("h2", "h3")), some(1, 3), 0)
            one = draw.choice(("div", "li", "article")) if tag != "ol" else "li"
            for _ in range(draw.randint(1, 4)):
                inside += f"<{one}{named(OTHER_NAMES['comments'])}>" + (leaf("div", some(1, 3), 0, ' class="author"') if draw.random() < 0.5 else "")
                inside += leaf("p", some(3, 60), 0) + f"</{one}>"
        elif role == "form":
            inside = leaf("label", some(1, 4), 0) + '<input type="text">'
            inside = f"<div>{inside}</div>" + (leaf("p", some(4, 20), 0) if draw.random() < 0.5 else "")
        else:
            for _ in range(draw.randint(1, 3)):
                inside += leaf(draw.choice(("p", "p", "div", "h3")), some(2, 25), 0)
        return f"<{tag}{attributes}>{inside}</{tag}>"

    def any_of(roles: tuple[str, ...], chance: float) -> str:
        return "".join(other(r) for r in roles if draw.random() < chance)

    out = any_of(("notice", "header", "nav", "ad", "form", "aside"), 0.5)
    tag = draw.choice(CONTENT_TAGS)
    attributes = named(CONTENT_NAMES) if tag in ("div", "section", "td") or draw.random() < 0.4 else ""
    body = ""
    for k, block in enumerate(blocks):
        if k == 0 and draw.random() < 0.7:
            body += leaf(draw.choice(("h1", "h1", "h2")), some(3, 12), 1)
        kind = draw.choice(("p",) * 8 + ("h2", "blockquote", "div", "li", "pre"))
        text = leaf(kind, block, 1)
        body += f"<ul>{text}</ul>" if kind == "li" else text
        if draw.random() < 0.12:
            body += other(draw.choice(("ad", "aside", "notice", "form")))
    if draw.random() < 0.3:
        body += other(draw.choice(("comments", "aside", "form", "footer")))
    if tag:
        body = f"<{tag}{attributes}>{body}</{tag}>" if tag != "td" else f"<table><tr><td{attributes}>{body}</td></tr></table>"
    out += body + any_of(("comments", "aside", "ad", "form", "notice", "footer"), 0.5)
    if draw.random() < 0.4:
        out = f'<div class="{draw.choice(("wrapper", "container", "page", "site", "layout", "row"))}">{out}</div>'
    return runs, f"<html><body>{out}</body></html>"


def _plain(markup: str) -> str:
    return " ".join("".join(part.split(">", 1)[-1] for part in markup.split("<")).split())


def _marked(tree: dom.Tree) -> list[int] | None:
    """States of a page whose author marked the article; None if nobody did. The nodes around it are left unknown."""
    if not any(t in ("article", "main") for t in tree.tag):
        return None
    states, inside = [], []
    for k, (parent, tag) in enumerate(zip(tree.parent, tree.tag)):
        above = inside[parent] if parent >= 0 else False
        out = tag in ("nav", "header", "footer", "aside", "form") and above is not None
        inside.append(None if out or above is None else above or tag in ("article", "main"))
        states.append(-1 if tree.text[k] is None else int(bool(inside[k])))
    return states


def train(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", rows: int = PAGES, seed: int = 5) -> Model:
    """A model from at most ``rows`` marked pages, those of smallest id hash among the pages that have an article mark.

    Pages longer than ``LONGEST_LABELLED`` are not trained on. Without any marked page no run is content.
    """
    marked = pages.select(F.col(id_column).cast("string").alias("id"), F.col(html_column).alias("html")).filter(
        F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.length("html") <= LONGEST_LABELLED)
    )
    ids = marked.select("id").orderBy(F.xxhash64("id"), "id").limit(rows)
    found = sorted(r.html for r in marked.join(F.broadcast(ids), "id", "left_semi").limit(4 * rows).collect())  # repeated ids repeat pages
    trees, known, articles, spare = [], [], [], []
    for page in found:
        tree = dom.tree_of(page)
        states = _marked(tree)
        if states is None or not any(s == 1 for s in states):
            continue
        trees.append(tree)
        known.append(states)
        articles.append([t for t, s in zip(tree.text, states) if s == 1])
        spare += [t for t, s in zip(tree.text, states) if t is not None and (s == 0 or len(t) < 400)]
    draw = random.Random(seed)
    for k, blocks in enumerate(articles):
        if k % 10 == 0:  # a page may be text alone
            trees.append(dom.tree_of(blocks[-1].replace("&", "&amp;").replace("<", "&lt;")))
            known.append([-1, 1])
        for _ in range(LAYOUTS):
            runs, page = layout(blocks[:40], spare, draw)
            tree = dom.tree_of(page)
            state_of = dict(runs)  # a text in both roles keeps the later one; such runs are left unknown
            both = {t for t, s in runs if s == 0} & {t for t, s in runs if s == 1}
            trees.append(tree)
            known.append([-1 if t is None or t in both else state_of.get(t, -1) for t in tree.text])
    if not trees:
        model = Model(np.zeros(dom.FEATURES), np.zeros((dom.KINDS, 2, 2)))
        model.weight[dom.tree_of("").features[0]] = -50.0  # the root is no content, and no state follows from another
        model.edge[:, 0, 1] = model.edge[:, 1, 0] = -50.0
        return model
    return fit(trees, known)


def texts_of(model: Model, pages: list[str | None]) -> list[str]:
    """The main text of each page, its runs joined by a newline."""
    out: list[str] = []
    for k in range(0, len(pages), TOGETHER):
        trees = [dom.tree_of(p) for p in pages[k : k + TOGETHER]]
        content, _ = model.messages(forest(trees))
        at = 0
        for tree in trees:
            out.append("\n".join(t for t, p in zip(tree.text, content[at : at + len(tree.text)]) if t is not None and p >= 0.5))
            at += len(tree.text)
    return out


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``. Null or empty HTML, or none but markup, gives an empty text.

    White space, line breaks by ``br`` and non-breaking spaces included, is one space inside a run. Repeated rows and null ids stay.
    """
    model = train(pages, id_column, html_column)
    source = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(model, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
