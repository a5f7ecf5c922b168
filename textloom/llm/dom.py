"""Pages as trees: a tolerant HTML reader that gives a page's structure with its runs folded, and its blocks of text.

The structure keeps what can hold a part of a page; inline elements belong to
what they stand in. Neighbouring records of one kind (paragraphs, list items,
rows, elements of one class) are one node. A node's label is its element and the
words of its class and id, led by `-` where these name a part that is no
article (menus, adverts, forms and so on), by `+` where they name the article.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is read by no one, up to their end tag.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "xmp")}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RECORDS = frozenset("p li tr td th dt dd h1 h2 h3 h4 h5 h6 blockquote pre option hr figure".split())
NOT_TEXT = frozenset("head nav aside form dialog menu noscript template iframe object svg math canvas audio video select button datalist map".split())
#: What a start tag ends, and what it does not look beyond.
P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
NO_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar side aside widget widgets comment comments commentlist respond disqus replies discussion share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar copyright legal skip hidden".split())
#: Of these words a whole article or body is taken for something else only by some.
STRONG = frozenset("ad ads advert adverts advertisement sponsored promo comment comments commentlist disqus related recommended hidden".split())
YES_WORDS = frozenset("article content main post entry story articlebody".split())
DEEPEST, MOST_KIDS = 24, 64

TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')|["'=])*+)>""")
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")


@lru_cache(maxsize=4096)
def label(tag: str, attrs: str) -> str:
    """The element's name and the words of its class and id, marked by what they tell."""
    words, hidden = [], False
    for name, *value in ATTR.findall(attrs):
        value, name = "".join(value), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name != "aria-hidden":
            words += [w.lower() for w in WORDS.findall(value) if len(w) > 1]
    words = [] if tag in ("html", "body") else sorted(set(words))[:6]
    no = [w for w in words if w in NO_WORDS]
    yes = any(w in YES_WORDS for w in words)
    if tag in ("article", "main"):
        mark = "-" if hidden or any(w in STRONG for w in no) else "+"
    elif hidden or tag in NOT_TEXT or tag == "footer":
        mark = "-"
    elif tag == "header" or no == ["header"]:
        mark = "" if yes else "^"  # the head of a page; within an article it is a part of that
    else:
        mark = "-" if no else "+" if yes and tag in ("div", "section", "td") else ""
    return mark + ".".join([tag, *words])


class Page:
    """labels and parents of the nodes in page order (the first is the root), what they hold, and the blocks (node, text)."""

    def __init__(self, html: str | None):
        self.labels, self.parents, self.links = ["#"], [-1], [0]
        self.blocks: list[tuple[int, str]] = []
        self._read(html or "")

    def shape(self) -> str:
        return "\n".join(f"{p} {x}" for p, x in zip(self.parents[1:], self.labels[1:]))

    def _node(self, parent: int, name: str, depth: int, last: dict[int, int], kids: dict[int, int]) -> int:
        near = last.get(parent)
        if near is not None and self.labels[near] == name and (name in RECORDS or "." in name or kids.get(parent, 0) >= MOST_KIDS):
            return near
        if depth > DEEPEST or kids.get(parent, 0) >= 4 * MOST_KIDS:
            return parent
        self.labels.append(name)
        self.parents.append(parent)
        self.links.append(0)
        last[parent] = len(self.labels) - 1
        kids[parent] = kids.get(parent, 0) + 1
        return last[parent]

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, int]] = []  # element, node, depth of nodes
        opened: dict[str, int] = {}
        last: dict[int, int] = {}
        kids: dict[int, int] = {}
        pieces: list[str] = []
        node, depth, at, end = 0, 0, 0, len(html)

        def flush() -> None:
            if pieces:
                text = "".join(pieces)
                text = " ".join((unescape(text) if "&" in text else text).split())
                if text:
                    self.blocks.append((node, text))
                    if opened.get("a"):
                        self.links[node] += len(text)
                pieces.clear()

        def pop() -> str:
            nonlocal node, depth
            tag = stack.pop()[0]
            opened[tag] -= 1
            node, depth = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
            return tag

        def close(tags: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
            """Pop up to and with the outermost of these that is open within the scope."""
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in scope:
                    break
                if stack[i][0] in tags:
                    flush()
                    while len(stack) > i:
                        pop()
                    if not any(opened.get(t) for t in tags):
                        break

        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                pieces.append(html[at:])
                break
            if lt > at:
                pieces.append(html[at:lt])
            c = html[lt + 1 : lt + 2]
            if c == "!" or c == "?":
                comment = html.startswith("!--", lt + 1)
                to = html.find("-->" if comment else ">", lt + 4 if comment else lt + 2)
                at = end if to < 0 else to + (3 if comment else 1)
                continue
            if not (c == "/" or c.isascii() and c.isalpha()):
                pieces.append("<")
                at = lt + 1
                continue
            m = TAG.match(html, lt)
            if not m:
                if c == "/" and not html[lt + 2 : lt + 3].isalpha():  # no tag: a comment up to the next end
                    to = html.find(">", lt)
                    at = end if to < 0 else to + 1
                    continue
                break  # a tag that never ends
            at = m.end()
            tag, attrs = m[1].lower(), m[2]
            if c == "/":
                if opened.get(tag):
                    if tag in INLINE:
                        if tag == "a":
                            held = sum(map(len, pieces))
                            self.links[node] += held
                        for i in range(len(stack) - 1, -1, -1):
                            if stack[i][0] == tag:
                                if stack[i][1] != node:
                                    flush()
                                while len(stack) > i:
                                    pop()
                                break
                            if stack[i][0] not in INLINE:
                                break
                    else:
                        flush()
                        while pop() != tag:
                            pass
                elif tag == "br":
                    pieces.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    pieces.append(" ")
                continue
            if tag in RAW and not attrs.rstrip().endswith("/"):
                to = RAW[tag].search(html, at)
                close_at = html.find(">", to.end()) if to else -1
                at = end if close_at < 0 else close_at + 1
                continue
            if tag == "body" or tag in P_ENDS and opened.get("head"):
                if opened.get("head"):
                    close(("head",))
                if tag == "body" and opened.get("body"):
                    continue
            if tag in P_ENDS and opened.get("p"):
                close(("p",), ("table", "td", "button"))
            if tag in ENDS and any(opened.get(t) for t in ENDS[tag]):
                close(ENDS[tag], SCOPE[tag])
            inline = tag in INLINE
            name = label(tag, "" if inline and "class" not in attrs and "id" not in attrs and "hidden" not in attrs else attrs)
            if inline and name[0] != "-":
                if tag == "a" and pieces and not opened.get("a"):  # text before a link is none of it
                    self.links[node] -= sum(map(len, pieces))
                stack.append((tag, node, depth))
            else:
                flush()
                node = self._node(node, name, depth, last, kids)
                depth += 1
                stack.append((tag, node, depth))
            opened[tag] = opened.get(tag, 0) + 1
        flush()
