"""Site style trees: entropies against their definition, roles, odd markup, and pages of made-up sites."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from cantata.llm import html_tree, site_style

ARTICLE = "<h1>Title &amp; more</h1><p>One <b>bold</b>word.</p>\n<p>Two\n\t lines<br>and a break</p>"
TEXT = "Title & more One boldword. Two lines and a break"


def _alone(spark, *pages):
    """Texts of pages without a host: roles decide alone."""
    df = spark.createDataFrame([(i, None, h) for i, h in enumerate(pages)], "page_id bigint, url string, html string")
    return [r["text"] for r in site_style.extract(df).orderBy("page_id").collect()]


def test_roles(spark):
    noise = [
        "<nav><ul><li><a href='/x'>Menu</a></ul></nav>", "<header><h2>Site</h2></header>", "<footer>&copy; us</footer>", "<aside>Side</aside>", "<div class='cookie-notice'>We use cookies</div>",
        "<div id=comments><article class=comment><p>First!</p></article></div>", "<form action=/><label>Mail</label><input name=a><button>Go</button></form>", "<div class='ad'>Buy</div>", "<script>var a = '<p>x</p>';</script>",
        "<style>p{}</style>", "<div role=navigation>Here</div>", "<section class='reader-comments'><p>Bad</p></section>", "<noscript>Turn it on</noscript>", "<div hidden>Secret</div>", "<p style='display: none'>Secret</p>", "<!-- <p>old</p> -->",
        "<select><option>A<option>B</select>", "<iframe>frame</iframe>", "<svg><text>pic</text></svg>", "<div class=sidebar><p>Side</p></div>", "<div class=newsletter>Subscribe</div>", "<textarea>typed</textarea>",
    ]
    around = "<!DOCTYPE html><html><head><title>T</title><meta charset=utf-8></head><body>{}<article>{}</article>{}</body></html>"
    inside = "<html><body><main><article>{}{}</article></main></body></html>"
    places = ["<body><main>{}</main>{}</body>", "<body><div class='post-content'>{}</div>{}", "<body><div>{}</div>{}", "{}{}"]
    pages = [around.format(n, ARTICLE, n) for n in noise] + [inside.format(ARTICLE, n) for n in noise if "<header" not in n] + [p.format(ARTICLE, n) for n in noise for p in places]
    for page, text in zip(pages, _alone(spark, *pages), strict=True):
        assert text == TEXT, page


def test_headers_and_titles(spark):
    pages = [f"<article><header><h1>T</h1></header>{'<p>x y</p>' * 3}<footer>by me</footer></article>", "<body><header><a>Site</a></header><h1>T</h1><article><p>x</p></article></body>", "<form><div><article><h1>T</h1><p>x</p></article></div></form>", "<article><p>x</p><article><p>a comment</p></article></article>", "<header>Site</header><main><header><h1>T</h1></header><p class=teaser>x</p><div class=side>y</div></main>"]
    assert _alone(spark, *pages) == ["T x y x y x y", "T x", "T x", "x", "T x"]


def test_odd_markup(spark):
    cases = {
        "": "", "   ": "", "plain text": "plain text", "a < b &lt;c&gt; &amp &am &#233;&#x41; &nosuch;": "a < b <c> & &am éA &nosuch;", "<p>a<p>b<div>c</p>d": "a b c d", "<p>cut <b": "cut", "<p>x<!-- open": "x", "<p>x</p><script>never closed": "x",
        "<p title='a > b'>x</p>": "x", '<p title="<p>y">x</p>': "x", "<p>it's</p it's><p>ok</p>": "it's ok", "<ul><li>1<li>2</ul>": "1 2", "<table><tr><td>a<td>b<tr><td>c</table>": "a b c", "<P CLASS=x>UP</P>": "UP", "<p>a&nbsp;b</p>": "a b",
        "</p></div>x": "x", "<p>a</3>b</p>": "ab", "<p>a<span>b</span>c</p>": "abc", "x<br/>y": "x y", "<![CDATA[z]]>x": "x", "<?php y ?>x": "x", "<p>\x00a</p>": "\x00a", "<b><p>one</b> two</p>": "one two", "é&eacute;\U0001f600&#x1F600;": "éé\U0001f600\U0001f600",
    }
    for (page, want), got in zip(cases.items(), _alone(spark, *cases), strict=True):
        assert got == want, page


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "http://a/x", None), (None, None, "<p>x</p>"), (2, "nohost", "<p>y</p>"), (2, "nohost", "<p>y</p>"), (3, "http://b", "")]
    df = spark.createDataFrame([(*r, 5, "t", "k") for r in rows], "page_id bigint, url string, html string, n_chars int, text string, key string")
    got = sorted(((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in site_style.extract(df).collect()))
    assert got == [(0, "", "x", 1), (1, "http://a/x", "", 0), (2, "nohost", "y", 1), (2, "nohost", "y", 1), (3, "http://b", "", 0)]
    assert site_style.extract(df.limit(0)).collect() == []


def test_very_long_and_very_deep_pages(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 60_000 + "</article>"
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000 + "<i>" * 30_000 + "y"
    quotes = '<p a="' + "<p>" * 100_000
    got = _alone(spark, long, deep, quotes, "<" * 200_000, "<p " * 100_000)
    assert got[0] == " ".join(["word & word"] * 60_000) and got[1] == "x y" and got[2] == "" and len(got[3]) == 200_000


def _site(r, host, n, wrap):
    """Pages of one host without telling names: a repeated strip, an article of its own, a repeated line below."""
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    strip, below = say(6), say(12)
    out = []
    for i in range(n):
        ps = [say(r.randint(8, 30)) for _ in range(r.randint(2, 7))]
        title = say(4)
        body = f"<div class=x1><span>{strip}</span></div>"
        out.append((f"http://{host}/{i}", f"<html><body>{body}{wrap[0]}<h2>{title}</h2>" + "".join(f"<p>{p}</p>" for p in ps) + f"{wrap[1]}<div class=x9><ul><li>{below}</li><li>more</li></ul></div></body></html>", " ".join([title, *ps])))
    return out


@pytest.mark.parametrize("wrap", [("<div class=q>", "</div>"), ("<article>", "</article>"), ("<td>", "</td>")])
def test_repeated_branches_of_a_host_go(spark, wrap):
    r = random.Random(3)
    rows = _site(r, "One.example", 12, wrap) + _site(r, "two.example", 9, wrap)
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id bigint, url string, html string")
    got = {x["page_id"]: x["text"] for x in site_style.extract(df).collect()}
    assert [got[i] for i in range(len(rows))] == [t for _, _, t in rows]


def test_boilerplate_within_an_article_goes_and_copies_stay(spark):
    r = random.Random(8)
    rows = []
    for i in range(12):
        words = " ".join(r.choice("lorem ipsum dolor sit amet elit sed".split()) + str(r.randint(0, 99)) for _ in range(40))
        rows.append((i, f"http://h/{i}", f"<article><h1>T{i}</h1><p>{words}</p><div class=k3><span>Read our guide to everything, today.</span></div></article>", f"T{i} {words}"))
    same = "<article><h1>Same</h1><p>All the pages of this host are copies of one text, each a page.</p></article>"
    copies = [(100 + i, f"http://copies/{i}", same, "Same All the pages of this host are copies of one text, each a page.") for i in range(8)]
    df = spark.createDataFrame([x[:3] for x in rows + copies], "page_id bigint, url string, html string")
    got = {x["page_id"]: x["text"] for x in site_style.extract(df).collect()}
    for i, _, _, want in rows + copies:
        assert got[i] == want


def test_importance_against_its_definition(spark):
    r = random.Random(5)
    pages = [("http://s/" + str(i), "<body>" + "".join(r.choice(["<p>a</p>", f"<p>{i}</p>", "<ul><li>x</li></ul>", "<div><a href=/1>go</a></div>"]) for _ in range(r.randint(1, 5))) + "</body>") for i in range(9)]
    shown, said, seen = defaultdict(Counter), defaultdict(lambda: defaultdict(list)), Counter()
    for _, text in pages:
        for (path, kind, value), n in site_style.counts_of_page(text, "s").items():
            if kind == site_style.PRESENTATION:
                shown[path][value] += n
            elif kind == site_style.CONTENT:
                said[path][value].append(n)
            else:
                seen[path] += 1
    entropy = lambda xs, m: min(1.0, -sum(x / sum(xs) * math.log(x / sum(xs), m) for x in xs))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    counted = df.selectExpr("page_id AS page", "url", "html").mapInArrow(site_style._counted, site_style.COUNTED)
    got = {x["path"]: x for x in site_style.importance(counted, 2).collect()}
    assert set(got) == {p for p, m in seen.items() if m >= 2}
    for path, x in got.items():
        m = seen[path]
        if shown[path]:
            assert x["styles"] == len(shown[path]) and abs(x["presentation"] - entropy(list(shown[path].values()), m)) < 1e-9
        if said[path]:
            own = [-sum(n / sum(ns) * math.log(n / sum(ns), m) for n in ns) for ns in said[path].values()]
            assert abs(x["content"] - (1 - min(1.0, sum(own) / len(own)))) < 1e-9


def test_branch_importance_by_recursion():
    r = random.Random(1)
    for _ in range(50):
        n = r.randint(1, 12)
        parent = [-1] + [r.randrange(i) for i in range(1, n)]
        path, texts = [r.randrange(6) for _ in range(n)], [r.choice([0, 0, 5]) for _ in range(n)]
        known = {p: (r.choice([None, r.random()]), r.choice([None, r.random()]), r.randint(0, 3)) for p in range(4)}

        def value(i):
            below = [value(j) for j in range(n) if parent[j] == i]
            shown, said, styles = known.get(path[i], (1.0, 1.0, 0))
            own = [1.0 if said is None else said] if texts[i] or not below else []
            mean = sum(below + own) / len(below + own)
            share = site_style.GAMMA ** max(1, styles)
            return mean if not below else (1 - share) * (1.0 if shown is None else shown) + share * mean

        got = site_style.branch_importance(parent, path, texts, known)
        assert all(abs(got[i] - value(i)) < 1e-9 for i in range(n))


def test_paths_of_one_presentation_are_one_node():
    tree = html_tree.read("<div class='b a' id=p12><p>x<p>y</div><div class='a b' id=p7><p>z</div>", "h")
    assert len(set(tree.path[1:])) == 2 and html_tree.read("<p>", "g").path[1] != html_tree.read("<p>", "h").path[1]
