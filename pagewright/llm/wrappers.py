"""Main text of web pages by wrapper induction.

Pages of one host are aligned with one of them (the page of smallest id) by simple tree matching, the largest
order-preserving map of nodes with equal labels, of these one with most equal texts.  Over all different pages of the host,
a node of that page whose text is nearly always the same, and a text that stands at one path on at least half of the pages,
is template, unless other texts at its path vary (a paragraph that returns among others is text); the others are slots.  The wrapper of a host is its template texts and the path of the deepest node, above or
at ``article`` and ``main``, that holds most of the slots' text outside menus, forms and the like.  A page's text is the
slots at that path, within the main elements that the page names there, less its boilerplate.

Induction moves small trees only (labels, parents, hashes and lengths of texts).  Wrappers are broadcast up to LISTED bytes;
beyond, pages are joined by host.

Defined results: a null or empty page has empty text; a page without url is its own host.  The page's own markup alone
decides on hosts with one different page, where nothing varies, and on pages that would lose more than half of their text
to the template (copies of other pages).  Unclosed and misnested tags are closed as browsers do for paragraphs and list
items; pages that share an id keep their rows; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import pieces
from pagewright.llm.scratch import Scratch

#: Bytes of wrappers up to which they are broadcast.
LISTED = 16 << 20
#: Share of aligned pages that agree on a template node's text, of a host's pages that hold a template text, and of the slots' text that a wrapper's node holds.
SAME, COMMON, HOLDS = 0.8, 0.5, 0.6

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(?:!|\?)[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_KIND = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: HTML elements by role.
_RAW = frozenset("script style noscript template textarea title iframe svg math select".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
_NOT_TEXT = frozenset("nav footer aside header form button fieldset dialog menu head figcaption".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_MAIN = frozenset("article main".split())
#: Words of class, id and role attributes that mark what isn't the article.
_BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comment-list cookie cookies consent disqus disclaimer footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget contentinfo complementary alert".split())


#: Words of a name that say how a page is laid out, last words of names of the article, and words of the article whose heading is its own.
_LAYOUT = frozenset("has is no not with without hide show".split())
_HOLDER = frozenset("article body container content entry free layout less main page post section story text wrap wrapper".split())
_HEADED = frozenset("article chapter content entry post section story".split())
_WHOLE = frozenset("html body article main".split())
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")


@lru_cache(maxsize=10_000)
def _names_boilerplate(name: str) -> bool:
    """Whether a class, id or role of several words, split at hyphens, underscores and case changes, holds a boilerplate word and isn't the article's own."""
    words = [w.lower() for w in _PART.findall(name)]
    if len(words) < 2 or not _LAYOUT.isdisjoint(words) or words[-1] in _HOLDER:
        return False
    own = {"header", "masthead", "banner"} if not _HEADED.isdisjoint(words) else set()
    return any(w in _BOILERPLATE and w not in own for w in words)


class Page:
    """Block elements of a page in page order: label, parent, own text pieces, whether it is boilerplate."""

    def __init__(self, source: str):
        self.label, self.parent, self.texts, self.drop, self.order = ["#"], [-1], [[]], [False], []
        stack, at, n = [(0, "#")], 0, len(source)
        lower = None
        for m in iter(lambda: _TOKEN.search(source, at), None):
            if m.start() > at:
                self._text(stack[-1][0], source[at : m.start()])
            at, name = m.end(), (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if name in _INLINE:
                    continue
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][1] == name), 0)
                if depth:
                    del stack[depth:]
                self._break(stack[-1][0])
                continue
            if name in _RAW and not m[3].endswith("/"):
                if lower is None:
                    lower = source.lower()
                end = lower.find(f"</{name}", at)
                close = lower.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else n
                continue
            if name == "br" or name == "hr":
                self._text(stack[-1][0], " ")
                continue
            said = " ".join(x for k in _KIND.findall(m[3]) for x in k if x) if "=" in m[3] else ""
            kind = said.lower()
            bad = name in _NOT_TEXT or bool(kind and (not _BOILERPLATE.isdisjoint(re.split(r"[\s_]+", kind)) or name not in _WHOLE and any(map(_names_boilerplate, said.split()))))
            if name in _VOID or name in _INLINE and not bad:
                continue
            if name in _CLOSES_P and stack[-1][1] == "p" or name == "li" and stack[-1][1] == "li":
                stack.pop()
            elif name == "li" and stack[-1][1] == "p" and len(stack) > 2 and stack[-2][1] == "li":
                del stack[-2:]
            self._break(stack[-1][0])
            node = len(self.label)
            self.label.append(name + ("." + kind.split()[0] if kind.split() else ""))
            self.parent.append(stack[-1][0])
            self.texts.append([])
            self.drop.append(bad or self.drop[stack[-1][0]])
            stack.append((node, name))
        if at < n:
            self._text(stack[-1][0], source[at:])

    def _text(self, node: int, text: str) -> None:
        if self.order and self.order[-1][0] == node:
            self.order[-1][1].append(text)
        else:
            self.order.append((node, [text]))

    def _break(self, node: int) -> None:
        if self.order:
            self.order.append((-1, []))

    def blocks(self) -> list[tuple[int, str]]:
        """(node, text) of every run of text within one element, in page order; blank ones left out."""
        out = []
        for node, parts in self.order:
            text = " ".join(_html.unescape("".join(parts)).split()) if node >= 0 else ""
            if text:
                out.append((node, text))
        return out

    def paths(self) -> list[str]:
        out = [""]
        for label, parent in zip(self.label[1:], self.parent[1:], strict=True):
            out.append(f"{out[parent]}/{label}")
        return out

    def under(self, roots: set[int]) -> list[bool]:
        inside = [0 in roots]
        for node, parent in enumerate(self.parent[1:], 1):
            inside.append(node in roots or inside[parent])
        return inside

    def own_roots(self) -> set[int]:
        """What the page's markup names as its text: its main elements, or everything."""
        named = {i for i, x in enumerate(self.label) if x.split(".")[0] in _MAIN and not self.drop[i]}
        inside = self.under(named) if named else []
        return named if named and any(inside[n] for n, _ in self.blocks()) else {0}

    def text(self, path: list[int] | None = None, template: frozenset[int] = frozenset()) -> tuple[str, bool]:
        """Slots under the nodes at path, and whether the wrapper decided; else the text under the page's own roots."""
        blocks, own = self.blocks(), self.own_roots()
        inside = self.under(own)
        marked = [(n, t) for n, t in blocks if inside[n] and not self.drop[n]]
        if path is not None:
            paths = self.paths()
            at = self.under(self.at(path))
            narrow = {i for i in own if at[i]}
            at = self.under(narrow) if narrow else at
            held = [(n, t) for n, t in blocks if at[n] and not self.drop[n]]
            keys = self.keys(paths) if template else {}
            got = [t for n, t in held if keys.get(n) not in template]
            if 2 * sum(map(len, got)) >= sum(len(t) for _, t in held) > 0:
                return " ".join(got), True
        return " ".join(t for _, t in marked), False

    def at(self, path: list[int]) -> set[int]:
        """Nodes whose labels from the top down have the hashes of path."""
        depth, on = [0], [True]
        for label, parent in zip(self.label[1:], self.parent[1:], strict=True):
            depth.append(depth[parent] + 1)
            on.append(on[parent] and depth[-1] <= len(path) and zlib.crc32(label.encode()) == path[depth[-1] - 1])
        return {i for i, (d, o) in enumerate(zip(depth, on, strict=True)) if o and d == len(path)}

    def keys(self, paths: list[str]) -> dict[int, int]:
        """Hashes of the path (upper half) and text (lower half) of each node with text."""
        said: dict[int, list[str]] = {}
        for n, t in self.blocks():
            said.setdefault(n, []).append(t)
        return {n: ((zlib.crc32(paths[n].encode()) >> 1) << 32) | zlib.crc32(" ".join(t).encode()) for n, t in said.items()}

    def tree(self) -> np.ndarray:
        """Rows (label, parent, hash of path and text, text length, boilerplate or 2 for a main element) of the nodes."""
        size = [0] * len(self.label)
        for n, t in self.blocks():
            size[n] += len(t)
        keys = self.keys(self.paths())
        rows = [(zlib.crc32(x.encode()), p, keys.get(i, 0), size[i], d or 2 * (x.split(".")[0] in _MAIN)) for i, (x, p, d) in enumerate(zip(self.label, self.parent, self.drop, strict=True))]
        return np.array(rows, "<i8").reshape(-1, 5)


def match(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Simple tree matching of two trees: pairs of nodes of the largest map that keeps labels, parents and order.

    Of equally large maps, one with most equal texts: a matched node counts ONE, and 1 more if the texts agree.
    """
    la, lb, kids_a, kids_b = a[:, 0].tolist(), b[:, 0].tolist(), _children(a), _children(b)
    ta, tb = a[:, 2].tolist(), b[:, 2].tolist()
    one = len(la) + len(lb) + 1

    def prefix(x: list[int], y: list[int]) -> int:
        """Leaves of one label and text at both starts; matching them is always best."""
        k = 0
        while k < min(len(x), len(y)) and la[x[k]] == lb[y[k]] and ta[x[k]] == tb[y[k]] and not kids_a[x[k]] and not kids_b[y[k]]:
            k += 1
        return k

    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def solve(i: int, j: int) -> tuple[int, list[tuple[int, int]]]:
        """(weight, matched children) of the best map of two nodes of one label."""
        x, y = kids_a[i], kids_b[j]
        k = prefix(x, y)
        pairs = list(zip(x[:k], y[:k], strict=True))
        x, y = x[k:], y[k:]
        k = prefix(x[::-1], y[::-1])
        tail = list(zip(x[len(x) - k :], y[len(y) - k :], strict=True))
        x, y = x[: len(x) - k], y[: len(y) - k]
        ends = sum(one + (ta[s] == tb[t] != 0) for s, t in pairs + tail)
        w = np.where(a[x, 0][:, None] == b[y, 0][None, :], one + ((a[x, 2][:, None] == b[y, 2][None, :]) & (a[x, 2] != 0)[:, None]), 0)
        for p, s in enumerate(x):
            for q, t in enumerate(y) if kids_a[s] else ():
                if (s, t) in known:
                    w[p, q] = known[s, t][0]
        best = np.zeros((len(x) + 1, len(y) + 1), np.int64)
        for p in range(len(x)):
            np.maximum.accumulate(np.maximum(best[p, 1:], best[p, :-1] + w[p]), out=best[p + 1, 1:])
        p, q, middle = len(x), len(y), []
        while p and q:
            if best[p, q] == best[p - 1, q]:
                p -= 1
            elif best[p, q] == best[p, q - 1]:
                q -= 1
            else:
                p, q = p - 1, q - 1
                middle.append((x[p], y[q]))
        return one + (ta[i] == tb[j] != 0) + ends + int(best[-1, -1]), pairs + middle[::-1] + tail

    depth_a, depth_b = _depths(a), _depths(b)
    by: dict[tuple[int, int], list[int]] = {}
    for j in range(len(lb)):
        if kids_b[j]:
            by.setdefault((lb[j], depth_b[j]), []).append(j)
    for i in range(len(la) - 1, -1, -1):  # children come after their parents
        for j in by.get((la[i], depth_a[i]), ()) if kids_a[i] else ():
            known[i, j] = solve(i, j)
    out, todo = [], [(0, 0)]
    while todo:
        pair = todo.pop()
        out.append(pair)
        todo += known[pair][1] if pair in known else []
    return sorted(out)


def _children(tree: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(len(tree))]
    for i, p in enumerate(tree[1:, 1].tolist(), 1):
        out[p].append(i)
    return out


def _depths(tree: np.ndarray) -> list[int]:
    out = [0]
    for p in tree[1:, 1].tolist():
        out.append(out[p] + 1)
    return out


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, 5)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 2):
        packed = [Page(t or "").tree().tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["host", "id", "tree"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, node, aligned, same) over the pages of a batch."""
    for batch in batches:
        seen: dict[tuple[str, int], list[int]] = {}
        for host, tree, ref in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            a, b = _unpack(ref), _unpack(tree)
            for i, j in match(a, b):
                x = seen.setdefault((host, i), [0, 0])
                x[0] += 1
                x[1] += int(a[i, 2] == b[j, 2] != 0)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen]), pa.array([n for _, n in seen], pa.int32()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["host", "node", "aligned", "same"])


def constant(aligned: tuple[int, int], pages: int) -> bool:
    """Whether a node of the reference page with (pages aligned, pages of the same text) is template."""
    return aligned[1] >= max(2, SAME * aligned[0], COMMON * pages)


def wrapper_node(tree: np.ndarray, aligned: dict[int, tuple[int, int]], pages: int, common: frozenset[int] = frozenset()) -> int:
    """The deepest node, not under a main element, that holds most of the slots' text; -1 where nothing varies."""
    slots = np.zeros(len(tree))
    for i, (_, _, said, size, drop) in enumerate(tree.tolist()):
        if size and drop != 1 and said not in common and not constant(aligned.get(i, (0, 0)), pages):
            slots[i] = size
    for i in range(len(tree) - 1, 0, -1):
        slots[tree[i, 1]] += slots[i]
    if not slots[0]:
        return -1
    node, kids = 0, _children(tree)
    while True:
        held = [k for k in kids[node] if slots[k] >= HOLDS * slots[0] and kids[k]]
        if not held or tree[node, 4] == 2:
            return node
        node = held[0]


def _labels(tree: np.ndarray, node: int) -> list[int]:
    out = []
    while node > 0:
        out.append(int(tree[node, 0]))
        node = int(tree[node, 1])
    return out[::-1]


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, template): hashed labels down to the wrapper's node, and hashes of the template texts; nothing where nothing varies."""
    for batch in batches:
        out = []
        for host, n, ref, nodes, common in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            tree, aligned, common = _unpack(ref), {x["node"]: (x["aligned"], x["same"]) for x in nodes}, frozenset(common or ())
            node = wrapper_node(tree, aligned, n, common)
            if node >= 0:
                said = {i: int(k) for i, k in enumerate(tree[:, 2]) if k}
                varying = {k >> 32 for i, k in said.items() if not constant(aligned.get(i, (0, 0)), n)}
                own = {k for k in said.values() if k >> 32 not in varying}
                out.append((host, _labels(tree, node), sorted(common | own)))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.int64()))], names=["host", "path", "template"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key): each text of a page once, with its path."""
    for batch in batches:
        host, tree = (c.to_pylist() for c in batch.columns)
        keys = [np.unique(x[:, 2][x[:, 2] != 0]) for x in map(_unpack, tree)]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, k in zip(host, keys, strict=True) for _ in range(len(k))], pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))], names=["host", "key"])


def _host(url, id_):
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    return F.when(found == "", F.concat(F.lit("#"), F.coalesce(id_.cast("string"), F.lit("")))).otherwise(found)


def induce(pages: DataFrame, html: str = "html", url: str = "url", id_: str = "page_id") -> DataFrame:
    """host, path, template: the wrapper of each host with several different pages on which something varies."""
    scratch = Scratch(pages.sparkSession)
    keyed = pages.select(_host(F.col(url), F.col(id_)).alias("host"), F.col(id_).cast("long").alias("id"), F.col(html).alias("html"))
    trees = scratch.cut(keyed.mapInArrow(_trees, "host string, id long, tree binary").groupBy("host", "tree").agg(F.min("id").alias("id")))
    refs = scratch.cut(trees.groupBy("host").agg(F.min(F.struct("id", "tree")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("host", "n", F.col("m.tree").alias("ref")))
    seen = trees.join(refs, "host").select("host", "tree", "ref").mapInArrow(_align, "host string, node int, aligned long, same long")
    seen = seen.groupBy("host", "node").agg(F.sum("aligned").alias("aligned"), F.sum("same").alias("same"))
    nodes = seen.groupBy("host").agg(F.collect_list(F.struct("node", "aligned", "same")).alias("nodes"))  # at most the nodes of one page
    told = trees.select("host", "tree").mapInArrow(_keys, "host string, key long").groupBy("host", "key").count().join(refs.select("host", "n"), "host")
    often = (F.col("count") > 1) & (F.col("count") >= COMMON * F.col("n"))
    told = told.groupBy("host", F.shiftright("key", 32).alias("at")).agg(F.sum("count").alias("all"), F.sum(F.when(often, F.col("count"))).alias("often"), F.collect_list(F.when(often, F.col("key"))).alias("keys"))
    told = told.where(F.col("often") >= SAME * F.col("all")).groupBy("host").agg(F.flatten(F.collect_list("keys")).alias("common"))  # at most the texts of two pages
    found = refs.join(nodes, "host").join(told, "host", "left").select("host", "n", "ref", "nodes", "common")
    out = scratch.cut(found.mapInArrow(_induce, "host string, path array<long>, template array<long>"))
    scratch.drop(trees, refs)
    return out


def _read(pages: DataFrame, html: str, url: str, id_: str) -> DataFrame:
    """id, url, text and wrapped (whether the wrapper decided), one row for each row of pages."""
    wrappers = induce(pages, html, url, id_)
    keyed = pages.select(F.col(id_).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), _host(F.col(url), F.col(id_)).alias("host"))
    listed = wrappers.agg(F.sum(64 + 8 * (F.size("path") + F.size("template")))).first()[0] or 0
    keyed = keyed.join(F.broadcast(wrappers) if listed <= LISTED else wrappers, "host", "left")
    kind = dict(pages.dtypes)[id_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            got = [Page(t or "").text(p, frozenset(k or ())) for t, p, k in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.bool_())], names=["id", "url", "text", "wrapped"])

    return keyed.select("id", "url", "html", "path", "template").mapInArrow(run, f"id {kind}, url string, text string, wrapped boolean")


def extract(pages: DataFrame, html: str = "html", url: str = "url", id_: str = "page_id") -> DataFrame:
    """id_, url and text, one row for each row of pages."""
    return _read(pages, html, url, id_).drop("wrapped").withColumnRenamed("id", id_)


def decided(pages: DataFrame, html: str = "html", url: str = "url", id_: str = "page_id") -> DataFrame:
    """wrapped and pages: how many pages the wrapper of their host decided, and how many their own markup."""
    return _read(pages, html, url, id_).groupBy("wrapped").agg(F.count(F.lit(1)).alias("pages"))
