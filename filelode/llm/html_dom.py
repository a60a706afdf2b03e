"""A small tolerant reader of HTML: block elements and runs of text, with what the extraction model looks at.

Only blocks are nodes. Inline elements are read through; what stands between two block boundaries is one text run, a leaf.
Scripts, styles, the head and other parts that show no text are left out, as are nodes without text or controls in them.

Time is linear in the page, whatever its markup: attributes are read as HTML's tokeniser reads them (a quote opens a
value only behind ``=``; one that never closes ends at the next ``>``), open elements are counted by name, so that a
stray end tag costs nothing, and blocks deeper than ``DEEPEST`` hang on their ancestor there.
"""

from __future__ import annotations

import html
import re
from collections import Counter

#: A tag, from its name on. Nothing is tried twice: all parts are possessive.
TAG = re.compile(
    r"""(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|["'][^>]*+|[^\s>"'][^\s>]*+)?+)?+)*+)>"""
)
ATTR = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")

#: HTML's elements by what they do here.
HIDDEN = frozenset("script style noscript template svg annotation iframe object canvas head title select textarea audio video".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body div p article section main nav header footer aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary hgroup menu dialog center".split()
)
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
LISTS = frozenset("ul ol dl table menu".split())
#: Open elements at most.
DEEPEST = 512


class Page:
    """Nodes in document order; a parent comes before its children. Node 0 is the root."""

    __slots__ = ("tags", "parents", "tokens", "texts", "links", "controls")

    def __init__(self) -> None:
        self.tags: list[str] = ["#root"]
        self.parents: list[int] = [-1]
        self.tokens: list[tuple[str, ...]] = [()]
        self.texts: list[str] = [""]
        self.links: list[int] = [0]  # characters of a run that stand in links
        self.controls: list[int] = [0]  # form controls directly in a node

    def add(self, tag: str, parent: int, tokens: tuple[str, ...] = (), text: str = "", links: int = 0) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.tokens.append(tokens)
        self.texts.append(text)
        self.links.append(links)
        self.controls.append(0)
        return len(self.tags) - 1


def tokens_of(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = [t.lower() for m in ATTR.finditer(attributes) for t in TOKEN.findall(m[2] or m[3] or m[4] or "")]
    return tuple(dict.fromkeys(found))


class _Open:
    """The open elements, counted by name, and by name since the last list or table began."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("#root", 0)]
        self.counts: Counter[str] = Counter()
        self.inside: list[Counter[str]] = [Counter()]
        self.beyond: Counter[str] = Counter()  # begun below DEEPEST, so not on the stack

    def push(self, name: str, node: int) -> None:
        if len(self.stack) > DEEPEST:
            self.beyond[name] += 1
            return
        self.stack.append((name, node))
        self.counts[name] += 1
        self.inside[-1][name] += 1
        if name in LISTS:
            self.inside.append(Counter())

    def pop(self) -> str:
        name = self.stack.pop()[0]
        if name in LISTS:
            self.inside.pop()
        self.counts[name] -= 1
        self.inside[-1][name] -= 1
        return name

    def pop_to(self, names: frozenset[str]) -> None:
        while self.pop() not in names:
            pass


def _text_bearing(page: Page) -> Page:
    """The page without nodes that have no text and no controls in them."""
    wanted = [bool(t) or c > 0 for t, c in zip(page.texts, page.controls)]
    wanted[0] = True
    for k in range(len(wanted) - 1, 0, -1):
        if wanted[k]:
            wanted[page.parents[k]] = True
    if all(wanted):
        return page
    new, n = [0] * len(wanted), 0
    for k, w in enumerate(wanted):
        new[k] = n
        n += w
    out = Page()
    out.parents = [-1 if p < 0 else new[p] for p, w in zip(page.parents, wanted) if w]
    out.tags, out.tokens, out.texts, out.links, out.controls = (
        [x for x, w in zip(values, wanted) if w] for values in (page.tags, page.tokens, page.texts, page.links, page.controls)
    )
    return out


def read(source: str) -> Page:
    page, opened = Page(), _Open()
    run: list[str] = []
    linked, in_link, at, end = 0, False, 0, len(source)
    never: set[str] = set()  # what the rest of the page is known not to have

    def close_run() -> None:
        nonlocal linked
        if run:
            text = SPACE.sub(" ", html.unescape("".join(run))).strip()
            if text:
                page.add("#text", opened.stack[-1][1], text=text, links=linked)
            run.clear()
        linked = 0

    def say(part: str) -> None:
        nonlocal linked
        run.append(part)
        if in_link:
            linked += len(part)

    def end_of(name: str) -> re.Match | None:
        if name in never:
            return None
        pattern = r"</head\s*>|<body\b" if name == "head" else rf"</{re.escape(name)}\s*>"
        found = re.compile(pattern, re.I).search(source, at)
        if found is None:
            never.add(name)
        return found

    while at < end:
        begin = source.find("<", at)
        if begin < 0:
            say(source[at:])
            break
        if begin > at:
            say(source[at:begin])
        m = TAG.match(source, begin + 1)
        if m is None:
            after = source[begin + 1 : begin + 3]
            if source.startswith("<!--", begin):
                stop = source.find("-->", begin + 4)
                at = end if stop < 0 else stop + 3
            elif after[:1] in ("!", "?", "/"):
                stop = source.find(">", begin + 2)
                at = end if stop < 0 else stop + 1
            elif after[:1].isascii() and after[:1].isalpha():
                break  # a tag that never ends
            else:
                say("<")
                at = begin + 1
            continue
        at = m.end()
        name = m[2].lower()
        if not m[1]:
            if name in HIDDEN:
                if name == "head":  # ends where the body begins, if not before
                    close_run()
                    stop = end_of(name)
                    if stop is not None:
                        at = stop.end() if stop[0][1] == "/" else stop.start()
                elif not m[3].rstrip().endswith("/"):
                    stop = end_of(name)
                    if stop is not None:
                        at = stop.end()
                    elif name in RAW:
                        at = end
                    if name in ("select", "textarea"):
                        page.controls[opened.stack[-1][1]] += 1
            elif name == "br":
                run.append(" ")
            elif name in ("input", "button", "label"):
                page.controls[opened.stack[-1][1]] += 1
            elif name == "a":
                in_link = True
            elif name == "hr":
                close_run()
            elif name in BLOCK:
                close_run()
                in_link = False
                if opened.stack[-1][0] == "p":
                    opened.pop()
                ends = CLOSED_BY.get(name)
                if ends and any(opened.inside[-1][e] for e in ends):
                    opened.pop_to(ends)
                node = page.add(name, opened.stack[-1][1], tokens_of(m[3]))
                if name != "p" or not m[3].endswith("/"):
                    opened.push(name, node)
        elif name == "a":
            in_link = False
        elif name in BLOCK:
            close_run()
            if opened.beyond[name]:
                opened.beyond[name] -= 1
            elif opened.counts[name]:
                opened.pop_to(frozenset([name]))
    close_run()
    return _text_bearing(page)
