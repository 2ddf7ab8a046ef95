"""The two networks: gradients, held-out accuracy, and what they do with odd texts."""

import math
import os
import random

import numpy as np
import pytest
from corpus_fixtures import collected
from pyspark.sql import functions as F

from docquarry.llm import common, language, quality


def good(r):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(8, 80)))


def bad(r):
    kind = r.randrange(3)
    if kind == 0:
        return good(r).upper().replace(" ", "!! ")
    return good(r).replace(" ", "### ") if kind == 1 else " | ".join(good(r).split(" "))


def laid_out(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_quality_gradients():
    r = np.random.default_rng(0)
    network = quality.Network(3)
    texts = [r.integers(97, 123, n).astype(np.uint8) for n in (3, 12, 13, 40, 90)]
    y, w = np.array([0, 1, 1, 0, 1], np.float32), np.ones(5, np.float32)
    for name in quality.Network.NAMES:
        setattr(network, name, getattr(network, name).astype(np.float64))

    def loss():
        p = network.scores(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in zip(quality.Network.NAMES, network.gradients(texts, y, w), strict=True):
        x = getattr(network, name)
        for at in [np.unravel_index(i, x.shape) for i in np.argsort(-np.abs(g).ravel())[:3]]:
            kept = x[at]
            x[at] = kept + 1e-3
            up = loss()
            x[at] = kept - 1e-3
            down = loss()
            x[at] = kept
            assert abs((up - down) / 2e-3 - g[at]) < 0.05 * abs(g[at]) + 2e-3, name


def test_quality_scores_do_not_depend_on_the_batch(monkeypatch):
    r = random.Random(0)
    texts = ["", "a", "é" * 30, *[good(r) for _ in range(20)], "x" * 5000, ""]
    network = quality.Network(1)
    whole = network.scores(*laid_out(texts))
    single = [network.scores(*laid_out([t]))[0] for t in texts]
    monkeypatch.setattr(quality, "AT_ONCE", 64)
    parts = network.scores(*laid_out(texts))
    assert np.allclose(whole, single, atol=1e-5) and np.allclose(whole, parts, atol=1e-5)


def test_quality_scores_against_plain_loops():
    """The forward pass, chunk by chunk and filter by filter, in plain Python."""
    r = random.Random(6)
    network = quality.Network(2)
    r2 = np.random.default_rng(3)
    network.hidden_bias, network.out_bias, network.bias = r2.normal(size=quality.HIDDEN).astype(np.float32), np.array([0.3], np.float32), r2.normal(size=quality.FILTERS).astype(np.float32)
    texts = ["", "a", "x" * quality.WIDTH, "x" * (quality.WIDTH + 1), good(r)[:150], "é中" * 20]

    def plain(raw):
        most = [0.0] * quality.FILTERS
        start = 0
        while True:
            codes = [raw[i] if i < len(raw) else 256 for i in range(start, start + quality.WIDTH)]
            x = [float(network.embedding[c][e]) for c in codes for e in range(quality.EMBEDDING)]
            for f in range(quality.FILTERS):
                most[f] = max(most[f], sum(a * float(w) for a, w in zip(x, network.filters[:, f], strict=True)) + float(network.bias[f]))
            if start + quality.WIDTH >= len(raw):
                break
            start += quality.STRIDE
        hidden = [max(0.0, sum(m * float(w) for m, w in zip(most, network.hidden[:, k], strict=True)) + float(network.hidden_bias[k])) for k in range(quality.HIDDEN)]
        return 1 / (1 + math.exp(-sum(h * float(w) for h, w in zip(hidden, network.out, strict=True)) - float(network.out_bias[0])))

    assert np.allclose(network.scores(*laid_out(texts)), [plain(t.encode()) for t in texts], atol=1e-4)


def test_quality_gradients_do_not_depend_on_the_pieces(monkeypatch):
    r = np.random.default_rng(2)
    texts = [r.integers(97, 100, n).astype(np.uint8) for n in (3, 700, 40, 5000)]
    texts.append(np.tile(texts[2], 30))  # the greatest output in many pieces
    network, y, w = quality.Network(3), np.array([0, 1, 0, 1, 1], np.float32), np.ones(5, np.float32)
    whole = network.gradients(texts, y, w)
    monkeypatch.setattr(quality, "AT_ONCE", 64)
    for a, b in zip(whole, network.gradients(texts, y, w), strict=True):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-5)


def test_quality_learns_from_whole_texts(spark):
    """Texts that differ only long after their start."""
    r = random.Random(8)
    long = lambda kind, n: " ".join(kind(r) for _ in range(400))[:n]
    rows = [(i, long(good, 2500) + (long(good, 5000) if i % 2 else long(bad, 5000)), i % 2) for i in range(240)]
    docs = spark.createDataFrame([row[:2] for row in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    held = [x for x in quality.report(docs, labels).collect() if x["held_out"]]
    assert len(held) > 30 and np.mean([x["predicted"] == x["doc_id"] % 2 for x in held]) > 0.9


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(4)
    rows = [(i, good(r) if (ok := r.random() < 0.7) else bad(r), int(ok)) for i in range(500)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "A" * 200_000), (None, "text"), (3, rows[3][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(901, None, 1), (None, 1, 0), (5, rows[5][2], 0)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: q for i, _, q in rows}


def test_quality_held_out_accuracy(judged):
    docs, labels, truth = judged
    got = quality.report(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 60 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    clash = docs.withColumns({n: F.lit(0) for n in ("score", "quality", "labels", "row", "held_out", "_text")})
    assert quality.accepted(clash, labels).columns == clash.columns
    assert {r["doc_id"] for r in quality.accepted(clash, labels).collect()} == {r["doc_id"] for r in got if r["predicted"]}


def test_quality_without_labels(spark, judged):
    docs, labels, _ = judged
    assert {r["score"] for r in quality.report(docs, labels.where("false")).collect()} == {0.5}
    ones = quality.report(docs, labels.where("quality = 1")).collect()
    assert all(r["predicted"] == 1 for r in ones)
    assert quality.report(docs.where("false"), labels).collect() == []


def test_sampled_texts_are_held_in_bounds(spark, monkeypatch):
    """Short texts whole; of longer ones as many characters as the bound says, from every part of the text."""
    monkeypatch.setattr(common, "HELD_CHARS", 64)
    long = "".join(chr(0x4E00 + i) for i in range(1000))
    rows = [(0, None), (1, ""), (2, "short é"), (3, long[:64]), (4, long[:65]), (5, long[:80]), (6, long)]
    got = dict(spark.createDataFrame(rows, "i long, text string").select("i", common.held(F.col("text"), 3).alias("t")).collect())
    assert [got[i] for i in range(4)] == [t for _, t in rows[:4]]
    for i, text in rows[4:]:
        each = 64 // common.STRETCHES
        parts = [got[i][a : a + each] for a in range(0, 64, each)]
        places = [text.index(part) for part in parts]
        assert len(got[i]) == 64
        for k, at in enumerate(places):
            assert len(text) * k // common.STRETCHES <= at and at + each <= len(text) * (k + 1) // common.STRETCHES


LETTERS = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "éèàçnopq"}


def foreign(r, lang):
    return " ".join("".join(r.choice(LETTERS[lang]) for _ in range(r.randrange(2, 7))) for _ in range(r.randrange(4, 50)))


def test_language_gradients():
    r = np.random.default_rng(1)
    network = language.Network(["a", "b", "c"], 2)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    codes, mask, y = r.integers(97, 110, (9, 4)), np.ones((9, 4), np.float32), np.array([0, 1, 2, 1])
    mask[5:, 1], codes[5:, 1] = 0, 256

    def loss():
        forward = network._states(codes, "f", mask)
        backward = network._states(codes[::-1], "b", mask[::-1])
        p = network._probabilities(forward[1:], backward[:0:-1])
        return -(np.log(p[:, np.arange(4), y]) * mask).sum() / mask.sum()

    for name, g in network.gradients(codes, mask, y).items():
        x = network.p[name]
        for at in [np.unravel_index(i, x.shape) for i in np.argsort(-np.abs(g).ravel())[:3]]:
            kept = x[at]
            x[at] = kept + 2e-3
            up = loss()
            x[at] = kept - 2e-3
            down = loss()
            x[at] = kept
            assert abs((up - down) / 4e-3 - g[at]) < 0.05 * abs(g[at]) + 2e-3, name


def test_language_windows_agree():
    """The fast run over windows gives what the run that training uses gives."""
    r = random.Random(2)
    network = language.Network(["a", "b"], 5)
    texts = ["", "a", *[foreign(r, "cc") for _ in range(10)], "z" * 1000]
    got = network.pooled(*laid_out(texts))
    for text, row in zip(texts, got, strict=True):
        raw, total = np.frombuffer(text.encode(), np.uint8), np.zeros(2)
        for at in range(0, len(raw), language.WINDOW):
            codes = raw[at : at + language.WINDOW, None].astype(np.int64)
            forward, backward = network._states(codes, "f", None), network._states(codes[::-1], "b", None)
            total += network._probabilities(forward[1:], backward[:0:-1]).sum(axis=(0, 1))
        assert np.allclose(row, total / max(1, len(raw)), atol=1e-4)


def test_language_held_out_accuracy(spark):
    r = random.Random(6)
    rows = [(i, foreign(r, lang := r.choice(["aa", "aa", "bb", "cc"])), lang) for i in range(400)]
    more = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !? 34", "bb"), (1003, "é", None), (None, "abc", "aa"), (1004, "gh" * 50_000, "bb"), rows[0]]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
    got = language.report(docs).collect()
    assert len(got) == len(rows) + len(more) and all(0 <= x["score"] <= 1 for x in got)
    truth = {i: lang for i, _, lang in rows}
    held = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert len(held) > 100 and np.mean([x["lang_pred"] == truth[x["doc_id"]] for x in held]) > 0.97
    by_id = {x["doc_id"]: x["lang_pred"] for x in got}
    assert by_id[1000] == by_id[1001] == by_id[1002] == "und" and by_id[1003] in LETTERS
    clash = docs.withColumns({n: F.lit(0) for n in ("score", "lang_pred", "row", "own", "has_letter", "turn")})
    assert collected(language.report(clash)) == collected(language.report(docs))


def test_language_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.report(docs).collect()} == {"und"}
    assert language.report(docs.where("false")).collect() == []
    one = spark.createDataFrame([(7, "abc", "aa"), (8, "xyz", "aa")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.report(one).collect()} == {"aa"}


def test_language_learns_from_whole_texts(spark):
    """Texts that all open with the same long heading."""
    r = random.Random(9)
    heading = "# " * 600
    rows = [(i, heading + " ".join(foreign(r, lang) for _ in range(20)), lang) for i in range(200) for lang in [["aa", "bb", "cc"][i % 3]]]
    more = [(1000 + i, foreign(r, lang), lang) for i in range(60) for lang in [["aa", "bb", "cc"][i % 3]]]
    network = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language.labelled(spark.createDataFrame(more, "doc_id long, text string, lang string"), network).collect()
    assert np.mean([x["lang_pred"] == x["row"]["lang"] for x in got]) > 0.9


def test_language_sample_counts_rows_with_text(spark):
    """Rows without text do not thin out the sample of those with it: languages of few rows are learned."""
    rows = spark.range(60).selectExpr("id as doc_id", "repeat('ab cd ', 20) as text", "concat('l', id) as lang")
    empty = spark.range(1000, 60_000).selectExpr("id as doc_id", "cast(null as string) as text", "'l0' as lang")
    with_text = language.fit(rows, sample=60).languages
    assert len(with_text) > 30 and language.fit(rows.union(empty), sample=60).languages == with_text


def test_languages_that_are_rare_are_learned(spark):
    """Most rows of one language, most texts null: each language keeps its part of the sample."""
    r = random.Random(9)
    rows = [(i, foreign(r, "aa"), "aa") for i in range(900)] + [(1000 + i, foreign(r, "bb"), "bb") for i in range(30)] + [(2000 + i, foreign(r, "cc"), "cc") for i in range(200)]
    rows += [(3000 + i, None, "dd") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sample = language._sampled(docs.where("text is not null"), 90).groupBy("lang").count().collect()
    assert {x["lang"]: x["count"] for x in sample} == {"aa": 30, "bb": 30, "cc": 30}
    few = language._sampled(docs.where("text is not null"), 2).collect()
    assert sorted(x["lang"] for x in few) == ["aa", "cc"]
    held = [x for x in language.report(docs).collect() if x["held_out"] and x["doc_id"] < 3000]
    truth = {i: lang for i, _, lang in rows}
    assert np.mean([x["lang_pred"] == truth[x["doc_id"]] for x in held]) > 0.95


@pytest.fixture(scope="module")
def tables(spark):
    """The driver's tables with enough rows for a held-out accuracy."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no driver tables here")
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels")}


def test_quality_on_the_given_documents(tables):
    """Of held-out rows, classes are told apart by score, good ones stay and most bad ones go."""
    labels = tables["labels"].where("quality is not null").select("doc_id", "quality")
    rows = quality.report(tables["documents"], tables["labels"]).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([x for x in rows if x["quality"] == q] for q in (1, 0))
    assert len(good) > 30 and len(bad) > 5
    above = np.mean([a["score"] > b["score"] for a in good for b in bad])
    assert above > 0.95 and np.mean([x["predicted"] for x in good]) > 0.97 and np.mean([x["predicted"] for x in bad]) < 0.4


def test_language_on_the_given_documents(tables):
    langs = tables["documents"].where("lang is not null").select("doc_id", "lang")
    rows = language.report(tables["documents"]).where("held_out").join(langs, "doc_id").collect()
    assert len(rows) > 200 and np.mean([x["lang"] == x["lang_pred"] for x in rows]) > 0.97
