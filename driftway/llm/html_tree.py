"""Web pages as trees of elements and text blocks, and their features."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
HIDDEN = frozenset("script style textarea title head noscript template svg iframe object select button canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: What a start tag closes: open elements of the first kind, looked for up to one of the second kind.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
_P_STOPS = {"article", "aside", "body", "div", "footer", "form", "header", "main", "nav", "section", "table", "td", "th", "button"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LABEL = re.compile(r"data-content=\"([01])\"")
_WORD = re.compile(r"[a-z]+")
#: Words in class, id and role names that speak against or for main text.
AGAINST = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments contact cookie cookies copyright "
    "disqus footer form header legal login masthead menu modal nav navbar navigation navigations newsletter notice notices "
    "popup promo promoted related reply share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)
FOR = frozenset("article articlebody body content entry main post story text".split())


@dataclass
class Page:
    """Nodes in page order, parents first. A text block is a node without children."""

    parents: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)  # "" for text blocks
    names: list[int] = field(default_factory=list)  # -1 against, 1 for, 0 neither
    labels: list[int] = field(default_factory=list)  # from data-content, -1 where there is none
    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters inside links

    def add(self, parent: int, tag: str, attributes: str = "", text: str = "", linked: int = 0) -> int:
        sign = label = 0
        if attributes:
            words = {w for m in _NAMES.finditer(attributes) for w in _WORD.findall((m.group(1) or m.group(2) or m.group(3) or "").lower())}
            sign = -1 if words & AGAINST else 1 if words & FOR else 0
            marked = _LABEL.search(attributes)
            label = int(marked.group(1)) if marked else -1
        else:
            label = -1
        self.parents.append(parent)
        self.tags.append(tag)
        self.names.append(sign)
        self.labels.append(label)
        self.texts.append(text)
        self.linked.append(linked)
        return len(self.parents) - 1


def parse(source: str | None) -> Page:
    """The page as a tree; broken markup is read as far as it goes, a tag that the end cuts off is dropped."""
    page = Page()
    root = page.add(-1, "html")
    if not source:
        return page
    stack: list[tuple[str, int]] = [("html", root)]  # open elements that are not inline, with their nodes
    parts: list[str] = []
    linked = hidden = links = 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.add(stack[-1][1], "", "", text, linked)
            parts, linked = [], 0

    def close(upto: int):
        nonlocal hidden
        flush()
        while len(stack) > upto:
            tag, _ = stack.pop()
            hidden -= tag in HIDDEN

    def say(piece: str):
        nonlocal linked
        if not hidden and piece:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    at, end = 0, len(source)
    while at < end:
        found = _TOKEN.search(source, at)
        if found is None:
            say(source[at:])
            break
        say(source[at : found.start()])
        at = found.end()
        if found.group(2) is None or not found.group().endswith(">"):
            continue
        tag, attributes = found.group(2).lower(), found.group(3)
        if found.group(1):
            if tag == "a":
                links = 0
            elif tag not in INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
            continue
        if tag in INLINE:
            if tag == "a":
                links = 1
            elif tag == "br" and not hidden:
                parts.append(" ")
            continue
        if tag == "html":
            continue
        flush()
        links = 0
        opened, stops = CLOSES.get(tag, ({"p"}, _P_STOPS))
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in opened:
                close(k)
                break
            if stack[k][0] in stops:
                break
        if tag in VOID:
            continue
        if tag in RAW and not attributes.endswith("/"):
            after = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = after.end() if after else end
            continue
        stack.append((tag, page.add(stack[-1][1], tag, attributes)))
        hidden += tag in HIDDEN
    flush()
    return page


GROUPS = (
    "top", "article", "section", "div", "aside", "list", "item", "paragraph", "heading", "table", "form", "other",
)
_GROUP = {
    "html": 0, "body": 0, "article": 1, "main": 1, "section": 2, "div": 3, "center": 3, "nav": 4, "aside": 4, "footer": 4,
    "header": 4, "menu": 4, "ul": 5, "ol": 5, "dl": 5, "li": 6, "dt": 6, "dd": 6, "p": 7, "blockquote": 7, "pre": 7,
    "h1": 8, "h2": 8, "h3": 8, "h4": 8, "h5": 8, "h6": 8, "table": 9, "tbody": 9, "thead": 9, "tr": 9, "td": 9, "th": 9,
    "form": 10, "fieldset": 10, "legend": 10, "dialog": 10,
}
N_GROUPS = len(GROUPS)
#: Edge kinds: group of the parent, what its names say, and whether the child is a text block.
EDGES = N_GROUPS * 3 * 2
#: Features of elements: group, names, size of text (8), share of links (4). Of text blocks: group of the parent, size
#: (8), share of links (4), sentence end, copyright sign, first letter.
FEATURES = (1 + N_GROUPS + 3 + 8 + 4) + (1 + N_GROUPS + 8 + 4 + 2 + 2 + 2)


def _size(n: int) -> int:
    return min(7, (n // 4).bit_length())


def _share(part: int, whole: int) -> int:
    return 0 if not part else 1 if 10 * part < 3 * whole else 2 if 10 * part < 8 * whole else 3


def features(page: Page) -> tuple[list[list[int]], list[int]]:
    """Active features of each node, and the kind of the edge to its parent."""
    n = len(page.parents)
    sizes, links = [len(t) for t in page.texts], list(page.linked)
    for k in range(n - 1, 0, -1):
        sizes[page.parents[k]] += sizes[k]
        links[page.parents[k]] += links[k]
    out, kinds = [], []
    split = 1 + N_GROUPS + 3 + 8 + 4
    for k in range(n):
        up = page.parents[k]
        group = 0 if up < 0 else _GROUP.get(page.tags[up], 11)
        sign = 0 if up < 0 else page.names[up]
        tag, text = page.tags[k], page.texts[k]
        kinds.append((group * 3 + sign + 1) * 2 + (not tag))
        if tag:
            at = 1 + N_GROUPS
            out.append([0, 1 + _GROUP.get(tag, 11), at + page.names[k] + 1, at + 3 + _size(sizes[k]), at + 11 + _share(links[k], sizes[k])])
        else:
            at = split + 1 + N_GROUPS
            out.append([
                split, split + 1 + group, at + _size(len(text)), at + 8 + _share(links[k], len(text)),
                at + 12 + (text[-1] in ".!?…\"'”»)"), at + 14 + ("©" in text or "(c)" in text), at + 16 + text[0].isupper(),
            ])
    return out, kinds


def text_labels(page: Page) -> list[int] | None:
    """Label of each node (1: main text, or holds some) from data-content or else from landmark elements; None without either."""
    n = len(page.parents)
    marked = any(label >= 0 for label in page.labels)
    if not marked and not {"article", "main"} & set(page.tags):
        return None
    inside, out = [0] * n, [0] * n
    for k in range(1, n):
        inside[k] = inside[page.parents[k]]
        if marked:
            inside[k] = page.labels[k] if page.labels[k] >= 0 else inside[k]
        elif page.tags[k] in ("article", "main"):
            inside[k] = 1
        elif page.names[k] < 0 or _GROUP.get(page.tags[k], 11) in (4, 10):
            inside[k] = 0
        if not page.tags[k]:
            out[k] = inside[k]
    for k in range(n - 1, 0, -1):
        out[page.parents[k]] |= out[k]
    return out
