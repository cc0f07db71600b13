"""One page as a tree of block elements: tolerant reading, presentation of nodes, and what roles say of them.

Small helpers of the site style tree (site_style); they keep nothing between pages but bounded caches. All is
iterative and reads a page once, so depth and length cost no more than their size.
"""

from __future__ import annotations

import hashlib
import html
import re

#: Elements that begin and end a line of text of their own. Fixed values.
BLOCKS = set(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: skipped up to their end tag.
RAW = set("script style title textarea iframe noembed noframes xmp".split())
#: A paragraph ends where one of these begins.
ENDS_P = BLOCKS - set("body head html td th tr tbody thead tfoot caption col colgroup option optgroup legend noscript".split())
#: An element ends those of the first set that are open inside one of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
#: End tags do not reach out of these, but for tags of tables.
SCOPE = {"td", "th", "table", "caption", "button", "object", "template"}
TABLE = {"td", "th", "tr", "tbody", "thead", "tfoot", "table", "caption"}

#: Elements, roles and names (parts of class and id) of what is no article. Fixed values.
NOISE_TAGS = set("nav header footer aside form button select datalist dialog menu search noscript template svg canvas object audio video head fieldset label legend optgroup option frameset applet map".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form tablist status log marquee note".split())
NOISE_NAMES = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsbygoogle adslot adbox sponsor sponsored sponsors promo promos promotion promotions cookie cookies consent gdpr ccpa notice notices notification "
    "notifications banner banners alert alerts popup popups modal overlay lightbox interstitial paywall subscribe subscription newsletter signup signin login register nav navbar navigation navigations menu menus submenu "
    "breadcrumb breadcrumbs crumbs pagination pager toolbar topbar sidebar sidebars rail widget widgets aside footer foot colophon copyright masthead share sharing social socials related recommended recommendations "
    "recirculation trending outbrain taboola comment comments commentlist commenters disqus respond reply replies discussion discussions feedback guestbook search searchbox form skip sitemap toc disclaimer donate "
    "donation hidden".split()
)
#: Names that are noise only where the name has no part of an article's.
WEAK_NAMES = {"header", "head", "top", "bottom", "side", "tools", "links", "teaser", "teasers"}
WEAK_TAGS = {"div", "section", "ul", "ol", "table", "td"}
#: Parts of names of what holds an article: they outweigh weak names.
ARTICLE_NAMES = set("article post entry story content body main text page".split())
#: Whole names of elements that hold an article's text.
CONTENT_NAMES = set("article-body articlebody article-content article-text article__body post-body post-content post-text entry-content story-body story-content main-content maincontent page-content content-body body-content text-content content main article post story entry".split())

NONE, TAG, NAME, ARTICLE, MAIN, CONTENT = range(6)

TOKEN = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/(?![a-zA-Z])[^>]*(?:>|\Z)|/?[a-zA-Z](?:[^>=]|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))?)*+(?:>|\Z))""",
    re.S,
)
NAME_OF = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
DIGITS = re.compile(r"[0-9]+")
PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
CACHED = 20_000


def code(text: str) -> int:
    """A signed 64-bit hash that is the same on every machine."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def evidence(tag: str, attributes: dict[str, str]) -> int:
    """What tag, role, class and id say: an article, its main place, its text, no article (by tag or by name), or nothing."""
    role = attributes.get("role", "").lower().strip()
    names = CAMEL.sub("-", f"{attributes.get('class', '')} {attributes.get('id', '')}").lower().split()
    style = attributes.get("style", "").replace(" ", "").lower()
    if tag in ("html", "body"):
        return NONE
    if "hidden" in attributes or "display:none" in style or "visibility:hidden" in style:
        return TAG
    noisy = False
    for name in names:
        parts = PARTS.findall(name)
        if any(p in NOISE_NAMES for p in parts) or (tag in WEAK_TAGS and any(p in WEAK_NAMES for p in parts) and not any(p in ARTICLE_NAMES for p in parts)):
            noisy = True
    if tag in ("article", "main"):
        return NAME if noisy and any(p.startswith(("comment", "repl", "promo", "sponsor", "ad", "related", "recommend")) and p in NOISE_NAMES for n in names for p in PARTS.findall(n)) else ARTICLE if tag == "article" else MAIN
    if role == "article":
        return ARTICLE
    if role == "main" or attributes.get("itemprop", "").lower() == "articlebody":
        return MAIN
    if tag in NOISE_TAGS or role in NOISE_ROLES:
        return TAG
    if noisy:
        return NAME
    return CONTENT if tag in ("div", "section", "td") and any(n in CONTENT_NAMES for n in names) else NONE


class Tree:
    """Nodes in page order (parent, tag, path, evidence), and pieces of text: (node, line, text, whether in a link)."""

    __slots__ = ("parent", "tag", "path", "evidence", "pieces", "links")

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.path: list[int] = []
        self.evidence: list[int] = []
        self.pieces: list[tuple[int, int, str, bool]] = []
        self.links: list[tuple[int, str]] = []


_tags: dict[str, tuple[str, str, int]] = {}
_paths: dict[tuple[int, str], int] = {}


def _start_tag(raw: str) -> tuple[str, str, int]:
    """Name, presentation (tag, class and role; numbers are alike) and evidence of a start tag."""
    found = _tags.get(raw)
    if found is None:
        name = NAME_OF.match(raw)[1].lower()
        attributes: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(raw[1 + len(name) :].rstrip(">")):
            attributes.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        shown = DIGITS.sub("0", " ".join([name, *sorted(set(attributes.get("class", "").split())), attributes.get("role", ""), attributes.get("id", "")]).strip())
        found = name, shown, evidence(name, attributes)
        if len(_tags) >= CACHED:
            _tags.clear()
        if len(raw) < 1000:
            _tags[raw] = found
    return found


def _path(parent: int, shown: str) -> int:
    found = _paths.get((parent, shown))
    if found is None:
        if len(_paths) >= CACHED:
            _paths.clear()
        found = _paths[parent, shown] = code(f"{parent} {shown}")
    return found


def read(text: str, site: str) -> Tree:
    """The tree of a page. Unclosed and stray tags are mended as browsers do, roughly; a tag cut off at the end is dropped."""
    tree = Tree()
    parent, tag, path, said, pieces = tree.parent, tree.tag, tree.path, tree.evidence, tree.pieces
    root = code(f"site {site}")
    parent.append(-1), tag.append("#page"), path.append(root), said.append(NONE)
    stack: list[tuple[str, int]] = []  # name, node (of inline elements: that of the block around)
    paragraphs = [0]  # open ones by scope
    count: dict[str, int] = {}
    links = 0
    node, line, at = 0, 0, 0
    size = len(text)

    def pop_to(depth: int) -> None:
        nonlocal node, links, line
        while len(stack) > depth:
            name, _ = stack.pop()
            count[name] -= 1
            if name in BLOCKS:
                line += 1
            if name in SCOPE:
                paragraphs.pop()
            elif name == "p":
                paragraphs[-1] -= 1
            elif name == "a":
                links -= 1
        node = stack[-1][1] if stack else 0

    def depth_of(names: set[str], stops: set[str]) -> int:
        """Where the innermost open element of ``names`` lies, -1 if ``stops`` come first."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in stops:
                break
        return -1

    while at < size:
        begin = text.find("<", at)
        while begin >= 0 and not (m := TOKEN.match(text, begin)):
            begin = text.find("<", begin + 1)
        if begin < 0:
            m, begin = None, size
        if begin > at:
            piece = text[at:begin]
            pieces.append((node, line, html.unescape(piece) if "&" in piece else piece, links > 0))
        if not m:
            break
        at = m.end()
        raw = m[0]
        if raw[1] in "!?" or raw[-1] != ">" or (raw[1] == "/" and not raw[2].isalpha()):
            continue
        if raw[1] == "/":
            name = raw[2:-1] if raw[2:-1].islower() and raw[2:-1].isalnum() else NAME_OF.match(raw)[1].lower()
            if name in ("br", "p"):
                line += 1
            if stack and stack[-1][0] == name:
                pop_to(len(stack) - 1)
            elif count.get(name):
                depth = depth_of({name}, (SCOPE - TABLE) if name in TABLE else SCOPE if name in BLOCKS else BLOCKS)
                if depth >= 0:
                    pop_to(depth)
            continue
        name, shown, says = _start_tag(raw)
        if name in BLOCKS:
            line += 1
            if count.get("head"):
                pop_to(depth_of({"head"}, set()))
            if paragraphs[-1] and name in ENDS_P:
                pop_to(depth_of({"p"}, SCOPE))
        if name in ENDS and any(count.get(x) for x in ENDS[name][0]):
            depth = depth_of(*ENDS[name])
            if depth >= 0:
                pop_to(depth)
        if name in VOID:
            line += name == "br"
            if name == "img":
                tree.links.append((node, raw))
            continue
        if name in RAW:
            end = RAW_END[name].search(text, at)
            close = end and text.find(">", end.end())
            at = size if not end or close < 0 else close + 1
            continue
        if name == "a":
            tree.links.append((node, raw))
            links += 1
        if name in BLOCKS or says:
            parent.append(node), tag.append(name), path.append(_path(path[node], shown)), said.append(says)
            node = len(parent) - 1
        stack.append((name, node))
        count[name] = count.get(name, 0) + 1
        if name in SCOPE:
            paragraphs.append(0)
        elif name == "p":
            paragraphs[-1] += 1
    return tree


def _outside(tree: Tree, forgiven: list[bool]) -> list[bool]:
    """Of each node: whether it, or what it lies in, is no article by its role.

    An article in an article is a reader's comment; a header in an article or its main place is the article's own.
    """
    n = len(tree.parent)
    outside, in_article, in_text = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        up, says = tree.parent[i], tree.evidence[i]
        own = says in (TAG, NAME) and not forgiven[i] and not (tree.tag[i] == "header" and in_text[up])
        own = own or (says == ARTICLE and in_article[up])
        outside[i] = outside[up] or own
        in_article[i] = in_article[up] or (says == ARTICLE and not outside[i])
        in_text[i] = in_text[up] or (says in (ARTICLE, MAIN, CONTENT) and not outside[i])
    return outside


def _trunk(tree: Tree, outside: list[bool]) -> list[bool] | None:
    """The nodes of the articles that hold text; else of the main places, else of what is named as text; else None."""
    n = len(tree.parent)
    full = {node for node, _, text, _ in tree.pieces if not outside[node] and not text.isspace()}
    for level in (ARTICLE, MAIN, CONTENT):
        inside = [False] * n
        for i in range(1, n):
            inside[i] = inside[tree.parent[i]] or tree.evidence[i] == level
        if any(inside[i] for i in full):
            return inside
    return None


def noise(tree: Tree) -> tuple[list[bool], list[bool]]:
    """Of each node: whether it is no article by its role, and whether it lies in the trunk (the article, else the main place, else all).

    Where every article or main place lies in what looks like none (a form around the page, say), what
    is around them is forgiven.
    """
    n = len(tree.parent)
    outside = _outside(tree, [False] * n)
    trunk = _trunk(tree, outside)
    if trunk is None and any(x in (ARTICLE, MAIN, CONTENT) for x in tree.evidence):
        around = [False] * n
        for i in range(n - 1, 0, -1):
            if around[i] or tree.evidence[i] in (ARTICLE, MAIN, CONTENT):
                around[tree.parent[i]] = True
        outside = _outside(tree, around)
        trunk = _trunk(tree, outside)
    return outside, [True] * n if trunk is None else trunk
