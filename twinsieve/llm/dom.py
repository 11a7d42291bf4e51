"""A forgiving parser from html to a flat tree of block nodes and text leaves.

It reads a page once: whatever is missing (a ``>``, a quote, an end tag) is looked for
to the end of the page once and not again, so its time grows with the page's length.
"""

from __future__ import annotations

import html
import re
from collections import Counter

# Elements of the HTML standard by how they nest.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg annotation annotation-xml iframe object canvas audio video head title textarea select option datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img input "
    # Formulas.
    "math mi mo mn ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("tr", "td", "th", "thead", "tbody"), "tbody": ("tr", "td", "th", "thead", "tbody"),
}
SCOPES = frozenset("ul ol dl table body html div section article main aside nav header footer form blockquote td th".split())
NAME_OR_MARK = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag. A quote counts as one only after a ``=``.
REST = re.compile(r"""(?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+>""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
END = {}


def end_of(tag: str) -> re.Pattern:
    if tag not in END:
        END[tag] = re.compile(rf"</{tag}\b[^>]*>" + (r"|(?=<body\b)" if tag == "head" else ""), re.I)
    return END[tag]


class Tree:
    """Nodes in page order. A leaf is a run of text; ``parent`` of the root is -1."""

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.attrs: list[tuple[str, ...]] = []
        self.text: list[str | None] = []
        self.linked: list[int] = []

    def add(self, tag: str, parent: int, attrs: tuple[str, ...], text: str | None = None, linked: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.attrs.append(attrs)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


def _attributes(raw: str) -> tuple[str, ...]:
    if not raw or "=" not in raw:
        return ()
    return tuple(w.lower() for m in ATTRIBUTE.finditer(raw) for w in WORDS.findall(m[2] or m[3] or m[4] or ""))


def parse(page: str) -> Tree:
    tree = Tree()
    stack = [tree.add("#root", -1, ())]
    run: list[str] = []
    linked, in_link, at, n = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                tree.add("#text", stack[-1], (), text, min(linked, len(text)))
            run.clear()
        linked = 0

    last = page.rfind(">")
    quoted, endless, opened = True, set(), Counter()
    def leave(k: int) -> None:
        opened.subtract(tree.tag[i] for i in stack[k:])
        del stack[k:]

    while at < n:
        m = NAME_OR_MARK.search(page, at) if at < last else None
        cut = m.start() if m else n
        if cut > at:
            piece = page[at:cut]
            run.append(piece)
            if in_link:
                linked += len(piece.strip())
        if m is None:
            break
        if m[2] is None:
            end = page.find("-->", cut + 4) if m[0] == "<!--" else page.find(">", cut)
            at = n if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        tag, closing = m[2].lower(), m[1]
        rest = REST.match(page, m.end()) if quoted else None
        # A tag that quotes keep open to the end of the page ends at its first ">", and so do those after it.
        quoted = rest is not None
        end = rest.end() if rest else page.find(">", m.end()) + 1
        if not end:
            run.append(page[cut:])
            break
        raw, at = page[m.end() : end - 1], end
        if tag in SKIPPED:
            if not closing and not raw.endswith("/"):
                e = None if tag in endless else end_of(tag).search(page, at)
                if e is None:
                    endless.add(tag)
                # Without an end tag only the elements whose content is no text reach to the end of the page.
                at = e.end() if e else n if tag in ("script", "style") else at
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = max(0, in_link + (-1 if closing else 1))
            elif tag == "br":
                run.append("\n")
            continue
        flush()
        in_link = 0
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if tree.tag[stack[k]] == tag:
                    leave(k)
                    break
                if tag == "p" or (tree.tag[stack[k]] in SCOPES and tag not in SCOPES):
                    break
            continue
        if tree.tag[stack[-1]] == "p":
            leave(len(stack) - 1)
        if any(opened[t] for t in CLOSES.get(tag, ())):
            for k in range(len(stack) - 1, 0, -1):
                t = tree.tag[stack[k]]
                if t in CLOSES[tag]:
                    leave(k)
                elif t in SCOPES:
                    break
        opened[tag] += 1
        stack.append(tree.add(tag, stack[-1], _attributes(raw)))
    flush()
    return tree
