"""Operators that SQL cannot express, against plain Python over small random tables; and the pipeline's five stages as a whole."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from cantata.llm import decontaminate, licenses, mixing, pii, quality_crf, simhash, url_templates

# Personal data ---------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and _luhn(digits) if digits else False, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return [(kind, a, z) for a, _, z, kind in sorted(out)]


def _found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: [(x["kind"], x["s"], x["e"]) for x in r["found"] if x["base"]] for r in pii.personal_data(df).collect()}


def test_pii_against_brute_force(spark):
    r = random.Random(11)
    pieces = ["a@b.c", "x.y+z@q-1.de.fr", "@", "a@b", "1.2.3.4", "255.256.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "0" * 14, "7" * 30, "+1 (212) 555-0100", "+12", "++49 30 1234567890 123456", " ", " é ", "ß", "\n", ",", "-", ".", "12", "tel ", "€"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(400)]
    got = _found(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == _base_spans(t), t


def test_pii_in_very_long_texts(spark):
    texts = ["a@b" + ".c" * 100_000, " ".join(f"10.{i % 256}.{i // 256}.1" for i in range(30_000)), ", ".join(["4111111111111111"] * 20_000), "x" * 400_000 + "@y.z", "1" * 300_000]
    got = _found(spark, texts)
    assert got[0] == [("email", 0, len(texts[0]))]
    assert got[1] == _base_spans(texts[1]) and len(got[1]) == 30_000
    assert got[2] == _base_spans(texts[2]) and len(got[2]) == 20_000
    assert got[3] == [("email", 0, 400_004)] and got[4] == []


def test_pii_secrets(spark):
    texts = [f'token = "{"9a" * 20}"', f'TOKEN = "{"9A" * 20}"', f"commit {'9a' * 20}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"]: [x["kind"] for x in r["found"]] for r in pii.personal_data(df).collect()} == {0: ["secret"], 1: ["secret"], 2: []}


# URL templates ---------------------------------------------------------------------------


def _brute_templates(urls, labels, smoothing=2, z=1.96):
    """Share of each url's template by the statement: trees of segments, split by recursion, no compression of chains."""
    paths = []
    for url in urls:
        host, _, path = url.split("://")[1].partition("/")
        paths.append((host, *("*" + (re.search(r"(\.[A-Za-z]+)?$", s)[0]) if re.match(url_templates.WILD, s) else s for s in path.split("/") if s)))
    share = {}

    def split(members, at):
        known = [i for i in members if i in labels]
        heads = {paths[i][at] if len(paths[i]) > at else "" for i in members}
        if not known or heads == {""}:
            bad = sum(labels[i] for i in known)
            share.update(dict.fromkeys(members, (bad + smoothing / 2) / (len(known) + smoothing)))
            return
        pools = {}
        for head in heads:
            own = [i for i in members if (paths[i][at] if len(paths[i]) > at else "") == head]
            mine, others = [labels[i] for i in own if i in labels], [labels[i] for i in known if i not in set(own)]
            if not mine:
                name = "no labels"
            elif others and not head.startswith("*") and head:
                p = sum(labels[i] for i in known) / len(known)
                gap = abs(sum(mine) / len(mine) - sum(others) / len(others))
                name = "*" if gap <= z * (p * (1 - p) * (1 / len(mine) + 1 / len(others))) ** 0.5 else head
            else:
                name = head
            pools.setdefault(name, []).extend(own)
        for pool in pools.values():
            split(pool, at + 1)

    for host in {p[0] for p in paths}:
        split([i for i, p in enumerate(paths) if p[0] == host], 1)
    return [share[i] for i in range(len(urls))]


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_against_brute_force(spark, seed):
    r = random.Random(seed)
    bad_of = {h + s: r.random() for h in "pqr" for s in "abcdef"}
    urls, labels = [], {}
    for i in range(900):
        host, section = r.choice("pqr"), r.choice("abcdef")
        urls.append(f"http://{host}.com/{section}/" + "/".join(r.choice(["x", "y", "1", "7f7f7f7f7f", "n1.html"]) for _ in range(r.randint(0, 3))))
        if r.random() < 0.4:
            labels[i] = r.random() < (1 if bad_of[host + section] > 0.6 else 0.05)
    pages = spark.createDataFrame([(i, u, None, "t") for i, u in enumerate(urls)], "page_id bigint, url string, host string, template string")  # clashing names
    known = spark.createDataFrame([*labels.items(), (5000, True), (None, True)], "page_id bigint, blocked boolean")
    want = _brute_templates(urls, labels)
    got = {x["page_id"]: x["verdict"] for x in url_templates.judge_urls(pages, [], known).collect()}
    assert got == {i: "block" if round(s, 9) > 0.5 else "allow" for i, s in enumerate(want)}
    assert {"block", "allow"} == set(got.values())


def test_similar_branches_merge_and_unlabelled_ones_are_allowed(spark):
    urls = [f"http://a.com/{s}/{i}" for s in ("one", "two", "bad") for i in range(30)] + ["http://b.com/bad/1", "http://a.com/none/1", "http://a.com/none/2"]
    judged = lambda blocked: {r["page_id"]: r for r in url_templates.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), [], spark.createDataFrame([(i, blocked(i)) for i in range(0, 90, 2)], "page_id bigint, blocked boolean")).collect()}
    rows = judged(lambda i: 60 <= i)
    assert rows[61]["template"] == "/bad/*" and rows[61]["verdict"] == "block" and {rows[i]["verdict"] for i in (1, 31, 90, 91, 92)} == {"allow"}
    rows = judged(lambda i: 30 <= i)
    assert (rows[1]["template"], rows[1]["verdict"]) == ("/one/*", "allow") and rows[31]["verdict"] == rows[61]["verdict"] == "block" and rows[91]["verdict"] == "allow"


def test_a_rule_for_a_path_labels_its_branch_only(spark):
    urls = [f"http://blog.x.example.com/de/{i}" for i in range(40)] + [f"http://blog.x.example.com/{s}/{i}" for s in ("en", "fr") for i in range(40)] + ["http://blog.x.example.com/"]
    rows = url_templates.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()
    assert {r["verdict"] for r in rows if r["page_id"] < 40} == {"block"} and {r["verdict"] for r in rows if r["page_id"] >= 40} == {"allow"}


def test_rounds_follow_branchings_not_length(spark):
    long = "http://a.com/" + "x/" * 1000
    urls = [long, long + "y", long + "z/1", long + "z/2", "http://a.com/" + "x/" * 999 + "w"]
    known = spark.createDataFrame([(1, True), (2, False), (3, False), (4, True)], "page_id bigint, blocked boolean")
    began = time.time()
    rows = {r["page_id"]: r["verdict"] for r in url_templates.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), [], known).collect()}
    assert time.time() - began < 30
    # Few labels: the branches x and w do not differ and merge, then y, z and what ends there are told apart.
    assert rows == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "block"}


# Classifier ------------------------------------------------------------------------------


def test_chains_against_enumeration():
    r = np.random.default_rng(4)
    per_doc = np.array([1, 4, 3, 6])
    emission, trans = r.normal(size=per_doc.sum()), r.normal(size=(2, 2))
    scale, good, pairs = quality_crf._chains(emission, per_doc, trans)
    at = 0
    for d, n in enumerate(per_doc):
        total, lines, twos = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(emission[at + i] for i in range(n) if labels[i]) + sum(trans[labels[i - 1], labels[i]] for i in range(1, n)))
            total += w
            lines += w * np.array(labels)
            for i in range(1, n):
                twos[i, labels[i - 1], labels[i]] += w
        assert np.isclose(scale[d], np.log(total)) and np.allclose(good[at : at + n], lines / total)
        assert np.allclose(pairs[at + 1 : at + n], twos[1:] / total)
        at += n


def test_training_with_odd_labels(spark):
    df = spark.createDataFrame([(i, f"some text {i}\nline" * (i % 5)) for i in range(40)] + [(50, "x\n" * 5000)], "doc_id bigint, text string")
    label = lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int")
    for rows in ([], [(i, None) for i in range(40)]):
        w, trans = quality_crf.train(df, label(rows))
        assert not w.any() and not trans.any()
    model = quality_crf.train(df, label([(i, 1) for i in range(40)] + [(None, 0), (3, None)]))
    assert all(x["score"] > 0.5 for x in quality_crf.score(df, model).collect())
    one = quality_crf.train(df, label([(i, i % 2) for i in range(40)] + [(50, 0)]), train_lines=100)  # a long document is passed over
    assert np.isfinite(one[0]).all()


# Licences --------------------------------------------------------------------------------


def test_license_recall_over_planted_edits(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, want = [], set()
    for i in range(300):
        name = r.choice(sorted(licenses.TEMPLATES))
        text = licenses.TEMPLATES[name].split(" ")
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            at = r.randrange(len(text))
            text[at : at + r.choice([0, 1])] = [r.choice(words)]
        doc = [r.choice(words) for _ in range(r.randint(0, 60))] + text + [r.choice(words) for _ in range(r.randint(0, 60))]
        rows.append((i, " ".join(doc)))
        there = shingles(plain(rows[-1][1]))
        want |= {(i, n) for n, t in licenses.TEMPLATES.items() if (s := shingles(plain(t))) and len(s & there) / len(s) >= 0.8}
    got = {(x["doc_id"], x["license"]) for x in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "license").collect()}
    assert got <= want and len(got & want) >= 0.97 * len(want) > 200


# Decontamination -------------------------------------------------------------------------


def _contaminated(texts, items):
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = plain(t)
        for a in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[a : a + 13]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = {}
    for k, t in texts.items():
        w, hit, found = plain(t), set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if (s := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[s]
        out[k] = len(w), len(hit), sorted(map(str, found))
    return out


def test_contamination_against_brute_force(spark):
    r = random.Random(6)
    words = ["the", "a", "of", "Über", "x1", "é", "run", "STOP", "go"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(r.choice([0, 1, 2, 4, 7, 13, 14, 30]))) for i in range(60)] + [(60, None), (61, "the,the")]
    texts = {i: say(r.randint(0, 60)) + " " + (r.choice(items)[1] or "") for i in range(80)} | {90: None, 91: "", 92: "-- ,,"}
    df = spark.createDataFrame([(k, t, "q") for k, t in texts.items()], "doc_id bigint, text string, words string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = _contaminated(texts, items)
    got = {x["doc_id"]: (x["n_words"], x["n_hit"], x["item_ids"]) for x in decontaminate.contamination(df, bench).collect()}
    assert got == want
    left = {x["doc_id"] for x in decontaminate.drop_contaminated(df, bench).collect()}
    assert left == {k for k, (n, hit, _) in want.items() if not (hit and 20 * hit >= n)} and 90 in left
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


# Mixing and the pipeline -----------------------------------------------------------------


def _deal(children, pot):
    """children: name -> (weight, cap); the pot over them, full ones first, rounding to the first of the rest."""
    full = set()
    while True:
        rest = [n for n in children if n not in full]
        free, weight = pot - sum(children[n][1] for n in full), sum(children[n][0] for n in rest)
        more = {n for n in rest if children[n][1] * weight <= free * children[n][0]}
        if not more:
            break
        full |= more
    budget = {n: children[n][1] if n in full else children[n][0] * free // weight for n in children}
    left = min(pot, sum(c for _, c in children.values())) - sum(budget.values())
    for n in sorted(rest)[:left]:
        budget[n] += min(1, children[n][1] - budget[n])
    return budget


def _mixture(docs):
    """docs: (doc_id, text, lang, source) -> {doc_id: epochs}."""
    leaves = {}
    for k, text, lang, source in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        number = re.search(r"[0-9]{1,6}$", source or "")
        domain = {1: "books", 3: "code"}.get(int(number[0]) % 4 if number else 0, "web")
        if n:
            leaves.setdefault((domain, lang, source), []).append((k, n))
    cap = {leaf: 3 * sum(n for _, n in rows) for leaf, rows in leaves.items()}
    pot = sum(cap.values()) // 3 * 600 // 1000
    out = {}
    domains = sorted({d for d, _, _ in cap})
    top = _deal({d: (mixing.WEIGHTS[d], sum(c for x, c in cap.items() if x[0] == d)) for d in domains}, pot)
    for d in domains:
        langs = sorted({x[1] for x in cap if x[0] == d})
        mid = _deal({g: (mixing.LANG_WEIGHTS.get(g, 1), sum(c for x, c in cap.items() if x[:2] == (d, g))) for g in langs}, top[d])
        for g in langs:
            low = _deal({x[2]: (1, c) for x, c in cap.items() if x[:2] == (d, g)}, mid[g])
            for s, budget in low.items():
                whole, part = divmod(budget, cap[d, g, s] // 3)
                run = 0
                for k, n in sorted(leaves[d, g, s], key=lambda x: (hashlib.md5(f"{mixing.SEED}|{whole}|{x[0]}".encode()).hexdigest(), x[0])):
                    run += n
                    if epochs := whole + (run <= part):
                        out[k] = epochs
    return out


def _mark(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[i : i + 3]), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    words = ["".join(r.choice("abcdeghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(200)]
    good = lambda n: ".\n".join(" ".join(r.choice(words) for _ in range(10)) for _ in range(n))
    junk = lambda: " ".join(r.choice(["AB!!", "CD!!", "xx###", "!!!"]) for _ in range(40))
    items = [(i, " ".join(r.choice(words) for _ in range(30))) for i in range(10)]
    rows = []
    for i in range(240):
        kind = i % 8
        text = junk() if kind in (1, 5) else good(r.randint(2, 8))
        if kind == 2 and rows:
            text = r.choice(rows)[1].replace(" ", "  ")
        if kind == 3 and rows:
            text = r.choice(rows)[1].replace("\n", " \n").capitalize()
        if kind == 4:
            text = good(1) + " " + r.choice(items)[1]
        rows.append((i, text, ["en", "de", "fr"][i % 3], f"src{i % 5}", len(text)))
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 not in (1, 5)), 0) for i in range(240) if i % 3], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {x[0]: x for x in rows}, items


def test_pipeline_against_brute_force(spark, folder):
    path, rows, items = folder
    model = quality_crf.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    left = [k for k in rows if quality_crf.quality([rows[k][1]], *model)[0] >= 0.7]
    assert 100 < len(left) < 200
    same = {}
    for k in left:
        same.setdefault(re.sub(r"[\x20\x09-\x0D]", "", rows[k][1]), []).append(k)
    left = sorted(min(ks, key=lambda k: (-len(rows[k][1]), k)) for ks in same.values())
    marks = {k: _mark(rows[k][1]) for k in left}
    group = {k: k for k in left}
    for _ in range(5):
        group = {k: min(group[j] for j in left if (marks[j] ^ marks[k]).bit_count() <= 2) for k in left}
    assert len(set(group.values())) < len(left) < len([x for ks in same.values() for x in ks])
    left = sorted(set(group.values()))
    hit = _contaminated({k: rows[k][1] for k in left}, items)
    clean = [k for k in left if not (hit[k][1] and 20 * hit[k][1] >= hit[k][0])]
    assert len(clean) < len(left)
    want = _mixture([rows[k][:4] for k in clean])
    got = corpus_pipeline.run(spark, path).collect()
    assert {x["doc_id"]: x["epochs"] for x in got} == want and len(got) == len(want) > 20


def test_stages_on_odd_tables(spark, folder):
    path, _, _ = folder
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    extra = names + ", tag string, words string, kept boolean, h bigint, rank string"  # clashing names
    odd = [(None, None, None, None, None), (1, None, "en", "s1", 0), (1, None, "en", "s1", 0), (2, "", None, "s2", 0), (3, "word " * 20000, "en", None, 9), (3, "word " * 20000, "en", None, 9), (4, "tie a b", "de", "s3", 7), (5, "tie a b", "de", "s3", 7)]
    for table in (spark.createDataFrame([], names), spark.createDataFrame(odd, names), spark.createDataFrame([(*x, "t", "w", True, 1, "r") for x in odd], extra)):
        before = table.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, table, path)
            assert left.columns == table.columns and left.count() <= before, name
        mixed = corpus_pipeline.STAGES[-1][1](spark, table, path)
        assert {"doc_id", "epochs"} <= set(mixed.columns) and mixed.count() <= before
        assert len({(r["doc_id"], r["text"]) for r in corpus_pipeline.exact_stage(spark, table, path).collect()}) == (3 if before else 0)
        assert simhash.simhash_groups(table).count() == before
