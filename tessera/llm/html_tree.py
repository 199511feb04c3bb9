"""HTML to block-level trees: a tolerant tokeniser, implied end tags, and the text of blocks.

The content of a raw element ends at ``</name`` before white space, ``/`` or ``>``, or with the page; nothing else in it is markup.  A muted
element (``MUTED``: buttons, labels of form fields, drawings, formulas, players) stands within text and says nothing; it ends at its own end tag,
or where a block around it ends.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

_TAG = re.compile(r"""<(?:!--(.*?)(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[!?/][^>]*+(?:>|\Z)|([A-Za-z/][^>]*+)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = frozenset("script style title textarea noscript iframe noframes noembed".split())
#: The end of an element's raw content.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"[.,;:!?]")

BLOCKS = frozenset("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option select caption iframe object template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
HIDDEN = frozenset("template head object select option".split())
MUTED = frozenset("button label svg math audio video canvas datalist meter progress output".split())
#: start tag -> open elements that it ends, and where the search for them stops
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ENDS_P = BLOCKS - {"html", "body", "option", "select", "iframe", "object", "template", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}
_SCOPE = {"td", "th", "table", "html", "body", "article", "section", "div", "main", "aside", "nav", "form", "li", "blockquote", "header", "footer", "figure"}


@dataclass
class Page:
    """Block elements in page order; node 0 is the document."""

    tags: list[str] = field(default_factory=lambda: ["#document"])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    tokens: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    ends: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    link_chars: list[int] = field(default_factory=lambda: [0])
    marks: list[int] = field(default_factory=lambda: [0])
    links: list[int] = field(default_factory=lambda: [0])
    inner: list[int] = field(default_factory=lambda: [0])  # inline tags
    fields: list[int] = field(default_factory=lambda: [0])  # form controls
    blocks: list[tuple[int, str]] = field(default_factory=list)  # (node, decoded text)

    def text(self, keep) -> str:
        return " ".join(t for n, t in self.blocks if keep[n])


def attribute_tokens(raw: str) -> tuple[str, ...]:
    """Lower-cased words of class, id and role."""
    found: list[str] = []
    for m in _ATTRIBUTE.finditer(raw):
        if m[1].lower() in ("class", "id", "role", "itemprop"):
            found += [x.lower() for x in _SPLIT.split(m[2] or m[3] or m[4] or "") if x]
    return tuple(dict.fromkeys(found))


def parse(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("#document", 0)]
    pieces: list[str] = []
    in_link = hidden = 0
    muted, inner = "", {}  # the muted element, and the tags open within it
    at, last = 0, len(source)

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                node = stack[-1][1]
                page.blocks.append((node, text))
                page.chars[node] += len(text)
                page.marks[node] += len(_SENTENCE.findall(text))

    def close(to: int) -> None:
        """Pops open elements down to a place in the stack."""
        nonlocal hidden
        flush()
        while len(stack) > to:
            name, node = stack.pop()
            page.ends[node] = len(page.tags)
            hidden -= name in HIDDEN

    def said(text: str) -> None:
        if text and not hidden and not muted:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if in_link:
                page.link_chars[stack[-1][1]] += len(text)

    while m := _TAG.search(source, at):
        if m.start() > at:
            said(source[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        name = m[3].lower()
        if muted:
            if m[2]:
                if inner.get(name):
                    inner[name] -= 1
                    if name == muted and not inner[name]:
                        muted = ""
                    continue
                if name not in BLOCKS or not any(x[0] == name for x in stack):
                    continue
                muted = ""  # a block around it ends
            else:
                if name in RAW:
                    end = _RAW_END[name].search(source, at)
                    at = end.start() if end else last
                elif name not in VOID and not m[4].endswith("/"):
                    inner[name] = inner.get(name, 0) + 1
                continue
        if m[2]:
            if name in BLOCKS or name == "head":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        close(k)
                        in_link = 0
                        break
            elif name == "a":
                in_link = 0
            elif name == "br":
                pieces.append(" ")
            continue
        if name == "body" and any(x[0] == "head" for x in stack):
            close(next(k for k, x in enumerate(stack) if x[0] == "head"))
        if name in RAW:
            end = _RAW_END[name].search(source, at)
            at = end.start() if end else last  # the end tag comes next
            continue
        if name not in BLOCKS and name != "head":
            node = stack[-1][1]
            page.inner[node] += 1
            if name == "a":
                in_link = 1
                page.links[node] += 1
            elif name == "br":
                pieces.append(" ")
            elif name in ("input", "button", "label"):
                page.fields[node] += 1
            if name in MUTED and not m[4].endswith("/"):
                muted, inner = name, {name: 1}
            continue
        if name in _ENDS:
            ended, stop = _ENDS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ended:
                    close(k)
                    if name != "tr":
                        break
                elif stack[k][0] in stop:
                    break
        if name in _ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in _SCOPE:
                    break
        flush()
        if name in ("hr",):
            continue
        node = len(page.tags)
        page.tags.append(name)
        page.parents.append(stack[-1][1])
        page.depths.append(len(stack))
        page.tokens.append(attribute_tokens(m[4]) if m[4] and "=" in m[4] else ())
        page.ends.append(node + 1)
        for column in (page.chars, page.link_chars, page.marks, page.links, page.inner, page.fields):
            column.append(0)
        if name in ("select", "option", "form", "fieldset"):
            page.fields[node] += 1
        in_link = 0
        stack.append((name, node))
        hidden += name in HIDDEN
    if at < last:
        said(source[at:])
    close(0)
    return page


def subtree(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums over subtrees of nodes in page order."""
    sums = np.concatenate(([0.0], np.cumsum(values)))
    return sums[ends] - sums[np.arange(len(values))]
