"""HTML extraction by wrapper induction: pages of a host are aligned, and what stays the same is no content.

The trees of a host's pages are folded into one by simple tree matching: nodes
of equal label are matched in order so that most of them are, what a page has
more is added, and every node keeps how many pages have it, how much text and
links it holds, and how many different texts. From these a wrapper says of each
node whether it is template or content: parts that are named as menus, adverts,
forms and so on are template, the varying slots of the article are content, and
on pages that name no article the varying slots in the part with most text are.
A page's blocks then go by the node of the wrapper that they are aligned to.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import TMP, store
from textloom.llm.dom import Page

#: Hashes that tell how many texts a node has (exact up to that), trees of a host that a task holds, and parts of a host that are folded side by side.
SKETCH, HELD, PARTS = 32, 4096, 16
#: A slot of so many pages at least whose texts are this share of them at most is constant.
LEAST_PAGES, CONSTANT = 4, 0.25
CONTAINERS = ("#", "html", "body", "div", "section", "main", "article", "td", "table", "tbody", "tr", "center")


class Node:
    __slots__ = ("label", "kids", "n", "chars", "links", "seen", "article", "plain")

    def __init__(self, label: str, n: int = 0, chars: int = 0, links: int = 0, seen: set[int] | None = None):
        self.label, self.kids, self.n, self.chars, self.links, self.seen = label, [], n, chars, links, seen or set()
        self.article = self.plain = False

    def texts(self) -> float:
        """How many different texts the node has had."""
        if len(self.seen) < SKETCH:
            return len(self.seen)
        return (SKETCH - 1) * 2.0**64 / (sorted(self.seen)[SKETCH - 1] + 1)

    def constant(self) -> bool:
        return self.n >= LEAST_PAGES and self.texts() <= CONSTANT * self.n

    def dump(self) -> list:
        return [self.label, self.n, self.chars, self.links, sorted(self.seen)[:SKETCH], [k.dump() for k in self.kids]]

    @staticmethod
    def load(x: list) -> Node:
        node = Node(x[0], x[1], x[2], x[3], set(x[4]))
        node.kids = [Node.load(k) for k in x[5]]
        return node


def tree(shape: str) -> list[Node]:
    """The nodes of a shape, the root first, as in the page."""
    nodes = [Node("#")]
    for line in shape.split("\n") if shape else []:
        parent, label = line.split(" ", 1)
        node = Node(label)
        nodes[int(parent)].kids.append(node)
        nodes.append(node)
    return nodes


def align(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the size of the greatest matching of two trees, and its pairs."""
    if a.label != b.label:
        return 0, []
    got = [[align(x, y) for y in b.kids] for x in a.kids]
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i in range(1, len(a.kids) + 1):
        for j in range(1, len(b.kids) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + got[i - 1][j - 1][0])
    pairs, i, j = [(a, b)], len(a.kids), len(b.kids)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += got[i][j][1]
    return best[-1][-1] + 1, pairs


def fold(whole: Node, page: Node) -> None:
    """Add a tree to the template of its host."""
    to = {id(a): b for a, b in align(page, whole)[1]}
    todo = [page]
    while todo:
        a = todo.pop()
        b = to[id(a)]
        b.n, b.chars, b.links = b.n + a.n, b.chars + a.chars, b.links + a.links
        b.seen |= a.seen
        if len(b.seen) > 2 * SKETCH:
            b.seen = set(sorted(b.seen)[:SKETCH])
        at = 0
        for kid in a.kids:
            if id(kid) in to:
                at = b.kids.index(to[id(kid)]) + 1
                todo.append(kid)
            else:
                b.kids.insert(at, kid)
                at += 1


def judge(root: Node) -> Node:
    """Set for every node whether its text is content: `article` on pages that name their article, `plain` on others."""

    def in_article(node: Node, state: str) -> str:
        mark = node.label[0]
        named = node.label.lstrip("+").split(".")[0] in ("article", "main")
        if mark == "-":
            return "form" if node.label.split(".")[0] in ("-form", "-nav") else "no"
        if mark == "+" and (state in ("", "in") or state == "form" and named):
            return "in"
        if mark == "^":
            return "in" if state == "in" else "form"
        return state

    todo, inside = [(root, "", [])], []
    while todo:
        node, state, own = todo.pop()
        state = in_article(node, state)
        if node.label[0] == "+" and state == "in" and not own:
            own = []
            inside.append(own)
        node.article = state == "in"
        node.plain = state == ""
        if node.article:
            own.append(node)
        todo += [(k, state, own if state == "in" else []) for k in node.kids]
    for own in inside:  # what never changes in an article whose main slot does
        main = max(own, key=lambda x: x.chars)
        for node in own:
            if node is not main and node.constant() and node.chars * 4 < main.chars and main.texts() > 4 * node.texts() and not main.constant():
                node.article = False

    def mass(node: Node) -> float:
        here = node.plain and not node.constant() and node.links * 2 <= node.chars
        return (node.chars if here else 0) + sum(map(mass, node.kids))

    top = root
    while True:
        kids = [(mass(k), k) for k in top.kids if k.label.lstrip("+").split(".")[0] in CONTAINERS]
        most = max(kids, key=lambda x: x[0], default=(0, None))
        if not most[0] or most[0] < 0.6 * mass(top):
            break
        form = lambda x: {k.label for k in x.kids}
        if any(k is not most[1] and k.label == most[1].label and m and form(k) == form(most[1]) for m, k in kids):
            break  # it is one of a run
        top = most[1]
    chosen, todo = set(), [top]
    while todo:
        node = todo.pop()
        if node.plain and not node.constant() and node.links * 2 <= node.chars:
            chosen.add(id(node))
        todo += node.kids
    todo = [root]
    while todo:
        node = todo.pop()
        node.plain = id(node) in chosen
        todo += node.kids
    return root


def wrapper(root: Node) -> str:
    def dump(node: Node) -> list:
        return [node.label, int(node.article) + 2 * int(node.plain), [dump(k) for k in node.kids]]

    return json.dumps(dump(root), separators=(",", ":"))


def _rules(text: str) -> Node:
    def load(x: list) -> Node:
        node = Node(x[0])
        node.article, node.plain = bool(x[1] & 1), bool(x[1] & 2)
        node.kids = [load(k) for k in x[2]]
        return node

    return load(json.loads(text))


def decide(shape: str, rules: Node) -> tuple[list[bool], list[bool]]:
    """For each node of a page whether it is content, by its article and as a page without one; a node that the wrapper lacks goes with its parent."""
    nodes = tree(shape)
    to = {id(a): b for a, b in align(nodes[0], rules)[1]}
    parents = [0, *[int(line.split(" ", 1)[0]) for line in shape.split("\n")]] if shape else [0]
    article, plain = [], []
    for i, node in enumerate(nodes):
        rule = to.get(id(node))
        up = parents[i]
        no = node.label[0] == "-"
        article.append(rule.article if rule else bool(i) and article[up] and not no)
        plain.append(rule.plain if rule else bool(i) and plain[up] and not no)
    return article, plain


def text_of(page: Page, by: tuple[list[bool], list[bool]]) -> str:
    """The content of a page: of its article, or if that has none, of the page as one that names none."""
    for keep in by:
        found = [text for node, text in page.blocks if keep[node]]
        if found:
            return "\n".join(found)
    return ""


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trees of each host in a task, pages of one shape as one."""
    held: dict[tuple[str, str], list[list]] = {}

    def out() -> pa.RecordBatch:
        rows = []
        for (name, shape), stats in held.items():
            nodes = tree(shape)
            for node, (n, chars, links, seen) in zip(nodes, stats):
                node.n, node.chars, node.links, node.seen = n, chars, links, seen
            rows.append((name, xxhash.xxh64_intdigest(shape) % PARTS, json.dumps(nodes[0].dump(), separators=(",", ":"))))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.string()))], names=["host", "part", "tree"])

    for batch in batches:
        for name, html in zip(batch.column(0), batch.column(1)):
            page = Page(html.as_py())
            own: list[list[str]] = [[] for _ in page.labels]
            for node, text in page.blocks:
                own[node].append(text)
            key = (name.as_py(), page.shape())
            stats = held.setdefault(key, [[0, 0, 0, set()] for _ in page.labels])
            for s, texts, links in zip(stats, own, page.links):
                if texts:
                    whole = "\n".join(texts)
                    s[0], s[1], s[2] = s[0] + 1, s[1] + len(whole), s[2] + max(0, min(links, len(whole)))
                    s[3].add(xxhash.xxh64_intdigest(whole))
                    if len(s[3]) > 2 * SKETCH:
                        s[3] = set(sorted(s[3])[:SKETCH])
            if len(held) >= HELD:
                yield out()
    if held:
        yield out()


def _folded(keys: int, last: bool):
    """Fold neighbouring rows of the same first `keys` columns, one tree at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in groupby(rows(batches), key=lambda r: r[:keys]):
            whole = None
            for r in group:
                one = Node.load(json.loads(r[2]))
                if whole is None:
                    whole = one
                else:
                    fold(whole, one)
            got = wrapper(judge(whole)) if last else json.dumps(whole.dump(), separators=(",", ":"))
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([0 if last else key[1]], pa.int32()), pa.array([got], pa.string())], names=["host", "part", "tree"])

    return run


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, tree): the wrapper of each host. Trees are folded as they stream by, first in parts of a host, so no group is ever held."""
    schema = "host string, part int, tree string"
    trees = pages.select(host(F.col(url)).alias("host"), F.col(html).cast("string").alias("html")).mapInArrow(_trees, schema)
    parts = trees.repartition("host", "part").sortWithinPartitions("host", "part").mapInArrow(_folded(2, False), schema)
    return parts.repartition("host").sortWithinPartitions("host").mapInArrow(_folded(1, True), schema).select("host", "tree")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row of `pages`, one line a block.

    Null or empty pages, and pages without content, have the empty text. Pages with
    a null or odd url are one host. Each row is read by itself, so ids may repeat or
    be null; other columns are not read. A page of any length is read whole. An
    empty table gives no rows.
    """
    rules = store(wrappers(pages, url, html), "wrappers")
    name = f"{TMP}host"
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), host(F.col(url)).alias(name))
    met = rows.join(rules, F.col(name) == F.col("host")).select("page_id", "url", "html", "host", "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        made: dict[tuple[str, str], tuple[list[bool], list[bool]]] = {}
        for batch in batches:
            texts = []
            for html_, host_, tree_ in zip(batch.column(2), batch.column(3), batch.column(4)):
                page, at = Page(html_.as_py()), host_.as_py()
                key = (at, page.shape())
                if key not in made:
                    if len(made) >= HELD:
                        made.clear()
                        known.clear()
                    if at not in known:
                        known[at] = _rules(tree_.as_py())
                    made[key] = decide(key[1], known[at])
                texts.append(text_of(page, made[key]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return met.mapInArrow(run, "page_id long, url string, text string").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
