"""Long texts, hot anchors, zero weights: what the operators must stand, counted rather than guessed."""

from __future__ import annotations

import random
import statistics
import time

import numpy as np
from pyspark.sql import functions as F

from cantata.llm import decontaminate, licenses, mixing, pii, quality_crf, repeats, suffix_array, suffix_automata


def test_a_notice_after_different_texts_is_dealt_over_tasks(spark):
    """At the front edge of a notice all copies go on alike; what precedes them deals their segments over the tasks."""
    r = random.Random(5)
    notice = "".join(r.choice("abcdefghij ") for _ in range(120)).encode()
    rows = []
    for i in range(3000):
        content = "".join(r.choice("klmnopqrst ") for _ in range(30)).encode() + notice[:60]
        rows.append((7, i, content, 30, i, True))  # key, h, content, lead, least, large: the anchor begins the notice
    cut = spark.createDataFrame(rows, repeats._SEGMENT)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [x["count"] for x in repeats.dealt(cut, suffix_array.BYTES).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 3000 and len(sizes) == 4 and max(sizes) < 3 * statistics.median(sizes)


def test_a_notice_after_different_texts_is_removed(spark):
    r = random.Random(6)
    notice = "".join(r.choice("abcdefghij ") for _ in range(120))
    texts = ["".join(r.choice("klmnopqrst ") for _ in range(r.randint(60, 90))) + notice for _ in range(400)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, tag string, runs int")  # clashing names
    got = {x["doc_id"]: (x["n_removed"], x["kept"]) for x in suffix_array.substring_dedup(df, bucket_bytes=20_000).collect()}
    assert got[0] == (0, texts[0].encode())
    for i in range(1, 400):
        longest = 120
        for j in range(i):
            n = 120
            while n < len(texts[i]) and texts[i][-n - 1 :] == texts[j][-n - 1 :]:
                n += 1
            longest = max(longest, n)
        assert got[i] == (longest, texts[i][: len(texts[i]) - longest].encode())


def test_features_in_runs_of_any_length():
    r = random.Random(1)
    pieces = ["a", "B", "Ab", "AB", "AAA", "1", ".", "%%%", " ", "  ", "\n", "\t", "é", "\U0001f600", "word", "word word", "x" * 40, "\r\n", "#"]
    for _ in range(60):
        texts = [None if r.random() < 0.1 else "".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 5))]
        whole = quality_crf.line_features(texts)
        for run in (1, 2, 5, 64):
            assert all(np.array_equal(a, b) for a, b in zip(quality_crf.line_features(texts, run), whole, strict=True))


def test_features_by_hand():
    features, size, per_doc = quality_crf.line_features(["AB ab ab x%\n\nA"])
    own = features[:, 1 : 1 + quality_crf.OWN]
    assert list(size) == [11, 0, 1] and list(per_doc) == [3]
    assert np.isclose(own[0, 2], 2 / 7) and np.isclose(own[0, 8], 1 / 4) and np.isclose(own[0, 9], 1 / 4) and np.isclose(own[0, 10], 1 / 4)
    assert own[1, 11] == 1 and own[2, 12] == 1 and (features[0, 1 + quality_crf.OWN : 1 + 2 * quality_crf.OWN] == 0).all()


def test_document_score_is_the_mean_over_bytes():
    w = np.zeros(quality_crf.N_FEATURES)
    w[0], w[1 + 3 * 0 + 11] = 2.0, -5.0
    texts = ["good line\n\nanother one", "", None, "x"]
    got = quality_crf.quality(texts, w, np.zeros((2, 2)))
    p = lambda e: 1 / (1 + np.exp(-e))
    assert np.isclose(got[0], (10 * p(2) + 1 * p(-3) + 12 * p(2)) / 23) and np.isclose(got[1], p(-3)) and np.isclose(got[2], p(-3)) and np.isclose(got[3], p(2))


def test_zero_weights_have_no_budget(spark):
    df = spark.createDataFrame([(i, "a b c d e", "en", f"src{i % 4}", 1, 2) for i in range(40)] + [(99, None, None, None, 1, 2)], "doc_id bigint, text string, lang string, source string, tokens int, w int")
    rows = mixing.mix(df, weights={"web": 1, "books": 0, "code": 1}).collect()
    assert {r["domain"] for r in rows} == {"web", "code"} and sum(r["n_tokens"] * r["epochs"] for r in rows) > 100
    assert mixing.mix(df, weights={"web": 0, "books": 0, "code": 0}).collect() == []
    assert mixing.mix(df, lang_weights={"en": 0}).collect() == []
    assert mixing.mix(df.limit(0)).collect() == []


def test_licences_of_very_long_and_repeated_texts(spark):
    mit, gpl = licenses.TEMPLATES["MIT-text"], licenses.TEMPLATES["GPL-2.0-text"]
    began = time.time()
    rows = [(1, (mit + " ") * 900, "t"), (2, (gpl + "\n") * 40, "t"), (3, "word " * 200_000, "t"), (3, "word " * 200_000, "t"), (4, None, "t"), (5, "", "t"), (6, mit, "t"), (6, mit, "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, license string")  # clashing name
    got = sorted((r["doc_id"], r["licenses"]) for r in licenses.licenses_of(df).collect())
    assert time.time() - began < 120 and len(got) == 8
    by = {}
    for k, names in got:
        by.setdefault(k, []).append(names.split(","))
    assert "MIT-text" in by[1][0] and "GPL-2.0-text" in by[2][0] and by[3] == [[""], [""]] and by[4] == by[5] == [[""]] and by[6][0] == by[6][1] and "MIT-text" in by[6][0]
    assert licenses.licenses_of(df.limit(0)).collect() == []


def test_long_licences_with_edits_are_found_whole(spark):
    r = random.Random(2)
    rows, want = [], set()
    for i, name in enumerate(["GPL-2.0-text", "GPL-3.0-text", "LGPL-2.1-text", "LGPL-3.0-text", "Apache-2.0-text", "MPL-2.0-text"] * 4):
        words = licenses.TEMPLATES[name].split()
        for _ in range(len(words) // 60):
            words[r.randrange(len(words))] = "edited"
        rows.append((i, " ".join(["before"] * r.randint(0, 50) + words + ["after"] * 20)))
        want.add((i, name))
    got = {(x["doc_id"], x["license"]) for x in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(want - got) <= 0.03 * len(want)
    assert {n for _, n in got} <= set(licenses.TEMPLATES)


def test_very_long_texts_of_substring_dedup(spark):
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    long, part = " ".join(words), " ".join(words[20_000:20_400])
    df = spark.createDataFrame([(2, long, 1), (1, part, 1), (3, long, 1)], "doc_id bigint, text string, n int")
    got = {x["doc_id"]: x["n_removed"] for x in suffix_automata.substring_dedup(df).collect()}
    assert got == {1: 0, 2: 400, 3: 60_000}
    got = {x["doc_id"]: x["n_removed"] for x in suffix_array.substring_dedup(df).collect()}
    assert got[1] == 0 and got[2] >= len(part) and got[3] == len(long)


def test_personal_data_and_contamination_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd now", "x", 3), (1, "mail a@b.cd now", "x", 3)], "doc_id bigint, text string, found string, kind int")
    assert [len(r["found"]) for r in pii.personal_data(df).collect()] == [1, 1]
    items = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20)), "z")], "item_id bigint, text string, doc_id string")
    docs = spark.createDataFrame([(1, "a " * 60_000 + " ".join(f"q{i}" for i in range(20)), "y"), (2, None, "y")], "doc_id bigint, text string, item_id string")
    rows = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.contamination(docs, items).collect()}
    assert rows == {1: (60_020, 20), 2: (0, 0)}
