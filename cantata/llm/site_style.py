"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: elements that are reached by the same presentation (tag, class, role and id
from the root on) are one node. A node's presentation importance is the entropy of the sequences of children that it has over
the pages, its content importance is one less the mean entropy of its features (lines of text, link targets, images)
over the pages; both by the logarithm to the number of pages that have the node. A branch that looks the
same and says the same on every page has importance near zero. The importance of a branch of one page combines
its own with that of its children, the more weighing on the children the fewer presentations the node has.

A page is cut by the roles of its elements first (menus, headers, footers, forms, notices, comments: presentation that
says by itself that it is no article); then the branches whose whole content is of low importance go.

The tree is not gathered anywhere: pages are read twice. The first reading gives counts of (node, presentation or
feature), summed by key with a combine on the map side, as entropies need only sums of n and n log n. Each page
then meets the importance of its own nodes, bounded by itself; the second reading cuts. Texts are shuffled
once, compressed and without what the roles already removed.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantata.llm import html_tree
from cantata.llm.common import python_batches, staged

#: Branches below this importance go.
THRESHOLD = 0.2
#: Share of the children in the importance of a node with one presentation; a further presentation lowers it by the same factor.
GAMMA = 0.9
#: Nodes on fewer pages of a host prove nothing.
LEAST_PAGES = 4
#: A list of at least so many links, with at least this share of its text in them, is a menu.
MENU_LINKS, MENU_SHARE, MENU_SHARE_IN_TRUNK = 3, 0.75, 0.98
PRESENTATION, CONTENT, PAGE = 0, 1, 2
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HREF = re.compile(r"""\s(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
COUNTED = "page bigint, path bigint, kind int, value bigint, n int"
CUT = "key bigint, page_id {id}, url string, blob binary"


def host_of(url: str) -> str:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased; empty without ://."""
    rest = url.partition("://")[2] if "://" in url else ""
    return re.split("[/?#]", rest, maxsplit=1)[0].translate({c: c + 32 for c in range(65, 91)})


def _lines(tree: html_tree.Tree, keep: list[bool]) -> list[tuple[int, str, int]]:
    """(node, text, characters in links) of the runs of a line that lie in one node."""
    out: list[tuple[int, str, int]] = []
    last = None
    for node, line, text, linked in tree.pieces:
        if not keep[node]:
            continue
        if last == (node, line):
            _, t, c = out[-1]
            out[-1] = node, t + text, c + linked * len(text.strip())
        else:
            out.append((node, text, linked * len(text.strip())))
            last = node, line
    return [(n, " ".join(t.split()), c) for n, t, c in out if not t.isspace() and t]


def counts_of_page(text: str, site: str) -> Counter:
    """(path, kind, value) -> n: presentations of the page's nodes (the sequence of their children), features of their content, and one for the page."""
    tree = html_tree.read(text, site)
    outside, _ = html_tree.noise(tree)
    children: list[list[str]] = [[] for _ in tree.parent]
    found: Counter = Counter()
    for i in range(1, len(tree.parent)):
        if not outside[i]:
            children[tree.parent[i]].append(str(tree.path[i]))
    for i in range(len(tree.parent)):
        if not outside[i]:
            if children[i]:
                found[tree.path[i], PRESENTATION, html_tree.code(" ".join(children[i]))] += 1
            found[tree.path[i], PAGE, 0] = 1
    for node, line, _ in _lines(tree, [not x for x in outside]):
        found[tree.path[node], CONTENT, html_tree.code("text " + line)] += 1
    for node, raw in tree.links:
        m = HREF.search(raw)
        if m and not outside[node]:
            found[tree.path[node], CONTENT, html_tree.code("link " + unescape(m[1] or m[2] or m[3] or ""))] += 1
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple[int, int, int, int, int]] = []
        for page, url, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if host_of(url):
                rows += [(page if kind == PAGE else 0, path, kind, value, n) for (path, kind, value), n in counts_of_page(text, host_of(url)).items()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page", "path", "kind", "value", "n"])


def importance(counted: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(path, presentation, content, styles) of the nodes on at least ``least_pages`` pages; nodes without children have no presentation, those without text no content (null)."""
    each = counted.groupBy("path", "kind", "value").agg(F.sum("n").alias("c"), F.sum(F.col("n") * F.log("n")).alias("s"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    node = each.groupBy("path").agg(
        of(PAGE, F.col("c")).alias("m"), of(PRESENTATION, F.col("c")).alias("t"), of(PRESENTATION, F.col("c") * F.log("c")).alias("ts"), of(PRESENTATION, F.lit(1)).alias("styles"),
        of(CONTENT, F.log("c") - F.col("s") / F.col("c")).alias("h"), of(CONTENT, F.lit(1)).alias("features"),
    ).where(F.col("m") >= max(2, least_pages))
    base = F.log("m")
    shown = F.least(F.lit(1.0), (F.log("t") - F.col("ts") / F.col("t")) / base)
    return node.select("path", shown.alias("presentation"), (1 - F.least(F.lit(1.0), F.col("h") / F.col("features") / base)).alias("content"), F.coalesce("styles", F.lit(0)).cast("int").alias("styles"))


def branch_importance(parent: list[int], path: list[int], texts: list[int], known: dict[int, tuple], gamma: float = GAMMA) -> list[float]:
    """Of each node of a page its composite importance. texts: characters of its own text; known: presentation, content, styles by path; unknown nodes are 1."""
    n = len(parent)
    total, members = [0.0] * n, [0] * n
    out = [1.0] * n
    for i in range(n - 1, -1, -1):
        shown, content, styles = known.get(path[i], (None, None, 0))
        own = 1.0 if path[i] not in known or content is None else content
        below, count = total[i], members[i]
        if texts[i] or not count:
            below, count = below + own, count + 1
        out[i] = below / count
        if members[i]:
            share = gamma ** max(1, styles)
            out[i] = (1 - share) * (1.0 if path[i] not in known or shown is None else shown) + share * out[i]
        if i:
            total[parent[i]] += out[i]
            members[parent[i]] += 1
    return out


def _packed(text: str, site: str) -> bytes:
    """What the roles leave of a page: nodes (parent, path, heading, in the trunk) and lines of (node, text, characters in links, links), compressed."""
    tree = html_tree.read(text, site)
    outside, trunk = html_tree.noise(tree)
    number, nodes = {}, []
    for i in range(len(tree.parent)):
        if not outside[i]:
            number[i] = len(nodes)
            nodes.append((number.get(tree.parent[i], -1), tree.path[i], int(tree.tag[i] in HEADINGS) + int(tree.tag[i] == "h1"), int(trunk[i])))
    links = Counter(number[node] for node, raw in tree.links if node in number and raw[1] in "aA")
    pieces = [(number[node], line, t, int(linked)) for node, line, t, linked in tree.pieces if node in number]
    return zlib.compress(json.dumps([nodes, pieces, list(links.items())]).encode("utf-8", "surrogatepass"), 1)


def _menus(parent: list[int], trunk: list[int], chars: list[int], linked: list[int], links: list[int]) -> list[bool]:
    """Nodes whose text is mostly that of their links."""
    n = len(parent)
    chars, linked, links = chars[:], linked[:], links[:]
    for i in range(n - 1, 0, -1):
        for x in (chars, linked, links):
            x[parent[i]] += x[i]
    return [i > 0 and links[i] >= MENU_LINKS and linked[i] >= (MENU_SHARE_IN_TRUNK if trunk[i] else MENU_SHARE) * chars[i] for i in range(n)]


def main_text(nodes: list, pieces: list, links: list, known: dict[int, tuple], threshold: float = THRESHOLD) -> str:
    """The text that is left of a page: without the branches that are wholly of low importance, and without menus.

    What holds most of the page's text, and headings of the trunk, stay, whatever the importance: pages that
    are copies of each other are no boilerplate. If nothing is left, all that the roles leave stays.
    """
    parent, path, heading, trunk = ([x[k] for x in nodes] for k in range(4))
    n = len(nodes)
    chars, linked, count = [0] * n, [0] * n, [0] * n
    for node, _, text, in_link in pieces:
        size = len(text) - text.count(" ")
        chars[node] += size
        linked[node] += size * in_link
    for node, k in links:
        count[node] += k
    by_path: Counter = Counter()
    for i in range(n):
        if trunk[i]:
            by_path[path[i]] += chars[i] - linked[i]
    most = max(by_path.items(), key=lambda x: x[1], default=(None, 0))[0]
    score = branch_importance(parent, path, chars, known)
    low = [score[i] < threshold and not (trunk[i] and (heading[i] or path[i] == most)) for i in range(n)]
    for i in range(n - 1, 0, -1):
        low[parent[i]] = low[parent[i]] and low[i]
    menu = _menus(parent, trunk, chars, linked, count)
    gone = [False] * n
    for i in range(n):
        gone[i] = (i > 0 and gone[parent[i]]) or low[i] or (menu[i] and path[i] != most)
    titled = any(heading[i] == 2 and trunk[i] and chars[i] for i in range(n))
    first = None if titled else next((i for i in range(n) if heading[i] == 2 and chars[i] and not gone[i]), None)

    def joined(keep: list[bool]) -> str:
        lines: list[list[str]] = []
        last = None
        for node, line, text, _ in pieces:
            if keep[node]:
                if line != last:
                    lines.append([])
                    last = line
                lines[-1].append(text)
        return " ".join(" ".join(" ".join("".join(x).split()) for x in lines).split())

    return joined([not gone[i] and (bool(trunk[i]) or i == first) for i in range(n)]) or joined([bool(x) for x in trunk])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blobs = [_packed(text, host_of(url)) for url, text in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(blobs, pa.binary())], names=["key", "page_id", "url", "blob"])


def _texts(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for blob, known in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                nodes, pieces, links = json.loads(zlib.decompress(blob))
                texts.append(main_text(nodes, pieces, links, {x["path"]: (x["presentation"], x["content"], x["styles"]) for x in known or []}, threshold))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    Null pages are empty, and so is their text. A null url, or one without ://, has no host: its page is
    judged by itself. Rows that repeat, also whole ones, are rows of their own, and counted as pages each. A page
    is read as a whole, however long or deep. Ties: none, as each page is judged by sums. An empty table gives no
    rows; other columns are not read.
    """
    python_batches(pages.sparkSession)
    url, text = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    key = F.xxhash64(F.col(id_col), url, text)
    counted = staged(pages.select(key.alias("page"), url.alias("url"), text.alias("html")).mapInArrow(_counted, COUNTED))
    nodes = staged(importance(counted, least_pages))
    own = counted.where(F.col("kind") == PAGE).select("page", "path").distinct().join(nodes, "path")
    known = own.groupBy("page").agg(F.collect_list(F.struct("path", "presentation", "content", "styles")).alias("known"))  # the nodes of one page
    cut = pages.select(key.alias("key"), F.col(id_col).alias("page_id"), url.alias("site"), F.col(url_col).alias("url"), text.alias("html"))
    cut = cut.mapInArrow(_cut, CUT.format(id=pages.schema[id_col].dataType.simpleString()))
    met = cut.join(known, cut["key"] == known["page"], "left").select("page_id", "url", "blob", "known")
    return met.mapInArrow(_texts(threshold), f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars bigint")
