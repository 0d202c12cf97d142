"""A page's block tree: elements that hold text, and the runs of text in them, in page order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from zlib import crc32

FEATURES = 1 << 14

# Element names by their role in HTML.
BLOCKS = frozenset(
    "html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset legend address details summary dialog hr center menu hgroup search".split()
)
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg select canvas audio video button".split())
TO_END = frozenset("script style title textarea".split())  # hide the rest of the page where they are not closed
NESTED = frozenset("svg template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in TO_END}
_BOTH = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I) for name in RAW - TO_END}


@dataclass
class Tree:
    """Nodes in page order: parent's place, depth, kind of the edge to the parent, features; text of leaves, else None."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    kind: list[int] = field(default_factory=lambda: [0])
    features: list[list[int]] = field(default_factory=lambda: [[_code("root")]])
    text: list[str | None] = field(default_factory=lambda: [None])
    tag: list[str] = field(default_factory=lambda: ["#root"])


def _code(name: str) -> int:
    return crc32(name.encode()) % FEATURES


_codes: dict[tuple[str, str], list[int]] = {}


def _element_features(tag: str, attributes: str) -> list[int]:
    key = (tag, attributes)
    if key not in _codes:
        if len(_codes) > 20_000:
            _codes.clear()
        tokens = {f"={t.lower()}" for _, value in _NAMED.findall(attributes) for t in _TOKEN.findall(value)}
        _codes[key] = [_code(f"<{tag}"), *sorted(_code(t) for t in tokens)]
    return _codes[key]


def _text_features(text: str, linked: int, tag: str, before: int) -> list[int]:
    words = text.split(" ")
    n = len(words)
    ends = sum(text.count(c) for c in ".!?,;:")
    return [
        _code(f"in {tag}"), _code(f"length {min(n, 200).bit_length()}"), _code(f"links {round(4 * linked / max(len(text), 1))}"),
        _code(f"stops {min(round(8 * ends / n), 6)}"), _code(f"links {linked > 0} length {min(n, 200).bit_length()}"), _code(f"place {min(before, 8).bit_length()}"),
        _code(f"mark {text[-1] in '.!?:;'}"), _code(f"sign {any(c in text for c in '©®|»›')}"),
    ]


def _is_block(name: str) -> bool:
    return name in BLOCKS or "-" in name


def _closed(page: str, name: str) -> dict[int, int]:
    """Start of each element ``name`` that has an end tag of its own, and where it ends."""
    ends: dict[int, int] = {}
    open_at: list[int] = []
    for found in _BOTH[name].finditer(page):
        if found[1]:
            if open_at:
                ends[open_at.pop()] = found.end()
        elif not found[0].endswith("/>"):
            if name not in NESTED:
                open_at.clear()
            open_at.append(found.start())
    return ends


_KINDS = {"#text": 1, "p": 2, "li": 3, "h1": 4, "h2": 4, "h3": 4, "h4": 4, "h5": 4, "h6": 4}
KINDS = 5


def tree_of(page: str | None) -> Tree:
    """The tree of a page; head, scripts, styles, closed controls and comments have no part in it."""
    page = page or ""
    tree = Tree()
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements; inline ones have their block's node
    run: list[str] = []
    linked = 0
    runs: dict[int, int] = {}
    closed: dict[str, dict[int, int]] = {}

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                node = stack[-1][1]
                runs[node] = runs.get(node, 0) + 1
                tree.parent.append(node)
                tree.depth.append(tree.depth[node] + 1)
                tree.kind.append(1)
                tree.features.append(_text_features(text, min(linked, len(text)), tree.tag[node], runs[node]))
                tree.text.append(text)
                tree.tag.append("#text")
        linked = 0

    def close(k: int) -> None:
        """Close open elements down to place ``k`` of the stack."""
        if any(_is_block(name) for name, _ in stack[k:]):
            flush()
        del stack[k:]

    def last(names: tuple[str, ...], until: tuple[str, ...] = ()) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in until:
                return 0
        return 0

    at, in_link = 0, 0
    while True:
        found = _TAG.search(page, at)
        piece = page[at : found.start() if found else len(page)]
        if piece:
            run.append(piece)
            if in_link:
                linked += len(piece)
        if not found:
            break
        at = found.end()
        end, name, attributes = found[1], found[2], found[3]
        if name is None:
            end, name, attributes = found[4], found[5], found[6]
        if name is None:
            continue
        name = name.lower()
        if end:
            if name == "a":
                in_link = 0
            if name == "p" and not last(("p",)):
                flush()
            if k := last((name,)):
                close(k)
            continue
        if name in RAW or name == "head":
            if name in RAW and not attributes.endswith("/"):
                if name in TO_END:
                    stop = _ENDS[name].search(page, at)
                    at = stop.end() if stop else len(page)
                else:
                    if name not in closed:
                        closed[name] = _closed(page, name)
                    at = closed[name].get(found.start(), at)  # without an end tag only the tag is skipped
            run.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name in ("br", "img", "input"):
                run.append(" ")
            continue
        if name == "a":
            in_link = 1
        if _is_block(name):
            if k := last(("p",), ("td", "th", "li", "div", "section", "article", "table")):
                close(k)
            if name in CLOSES and (k := last(CLOSES[name], HOLDS[name])):
                close(k)
            flush()
            above = stack[-1][1]
            node = len(tree.parent)
            tree.parent.append(above)
            tree.depth.append(tree.depth[above] + 1)
            tree.kind.append(_KINDS.get(name, 0))
            tree.features.append(_element_features(name, attributes))
            tree.text.append(None)
            tree.tag.append(name)
            stack.append((name, node))
        elif not attributes.endswith("/"):
            stack.append((name, stack[-1][1]))
    flush()
    return tree
