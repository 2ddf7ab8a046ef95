import hashlib
import pickle
import random
import re

import numpy as np

from docquarry.llm import decontaminate

from corpus_fixtures import collected, sentence


def words(text):
    lower = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(documents, benchmark):
    windows = {}
    for item, text in benchmark:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).update(() if item is None else (item,))
    out = []
    for doc, text in documents:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (items := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= items
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def cases():
    r = random.Random(5)
    items = [(i, sentence(r, n)) for i, n in enumerate([40, 13, 14, 12, 3, 1, 25, 25])] + [(8, None), (9, "--"), (10, ""), (None, sentence(r, 20)), (7, sentence(r, 20)), (11, "Été 中文 naïve")]
    documents = [(100, None), (101, ""), (102, "!?"), (103, items[0][1]), (104, items[0][1].upper().replace(" ", ", ")), (105, sentence(r, 300)), (106, "an ÉTÉ 中文 naïve thing"), (107, "an Été 中文 naïve thing")]
    for i in range(40):
        w = words(r.choice(items[:8])[1])
        a = r.randrange(len(w))
        documents.append((200 + i, sentence(r, r.randrange(60)) + " -- " + " ".join(w[a : a + r.randrange(1, 30)]) + ". " + sentence(r, r.randrange(400))))
    documents.append((300, " ".join([items[4][1]] * 5000)))
    documents.append((None, items[11][1]))
    return documents + documents[3:5], items


def frames(spark):
    documents, items = cases()
    return spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), documents, items


def test_against_brute_force(spark):
    d, b, documents, items = frames(spark)
    assert collected(decontaminate.report(d, b)) == brute(documents, items)


def test_blocks_give_the_same(spark):
    d, b, _, _ = frames(spark)
    scanned = decontaminate.scan(d, b).select("row.doc_id", "n_words", "spans", "items")
    blocks = decontaminate.scan(d, b, block_bytes=200).select("row.doc_id", "n_words", "spans", "items")
    assert collected(scanned) == collected(blocks)


def test_hashes_that_collide_are_verified(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "_window_hashes", lambda hashed, length: np.full(max(0, len(hashed) - length + 1), 5, np.uint64))
    documents, items = cases()
    windows = decontaminate.Windows([(i, None if t is None else t.encode()) for i, t in items])
    found = [decontaminate.words((t or "").encode()) for _, t in documents[:20]]
    hits = windows.scan(found)
    for k, (i, n_words, n_hit, n_items, _, _) in enumerate(brute([(k, t) for k, (_, t) in enumerate(documents[:20])], items)):
        hit, own = hits.get(i, (np.zeros(n_words, bool), set()))
        assert (n_words, n_hit, n_items) == (len(found[i]), int(hit.sum()), len(own)), k


def test_windows_are_small():
    """What is sent stays within a few times the benchmark's text."""
    r = random.Random(1)
    items = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(5000)).encode()) for i in range(40)]
    size, sent = sum(len(t) for _, t in items), len(pickle.dumps(decontaminate.Windows(items)))
    assert sent < 6 * size


def test_text_ids(spark):
    passage = sentence(random.Random(3), 14)
    got = decontaminate.report(spark.createDataFrame([(1, passage)], "doc_id long, text string"), spark.createDataFrame([("b/2", passage), ("a/10", passage)], "item_id string, text string")).first()
    assert got["n_items"] == 2 and got["items_sha256"] == hashlib.sha256(b"a/10,b/2").hexdigest()


def test_nothing(spark, documents, nothing, clashing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(nothing, none).collect() == []
    assert {r["n_hit"] for r in decontaminate.report(documents, none).collect()} == {0}
    b = frames(spark)[1]
    assert collected(decontaminate.report(clashing, b)) == collected(decontaminate.report(documents, b))


def test_cleaned(spark, documents):
    r = random.Random(9)
    item = sentence(r, 20)
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    long = sentence(r, 500)
    d = spark.createDataFrame([(1, "Before, " + item + "; after. " + long, "en", "s", 0), (2, item + " x", "en", "s", 0), (3, long, "en", "s", len(long)), (4, None, None, None, None)], documents.schema)
    got = {r["doc_id"]: r for r in decontaminate.cleaned(d, b).collect()}
    assert sorted(got) == [1, 3, 4]
    assert got[1]["text"] == "Before, ; after. " + long and got[1]["n_chars"] == len(got[1]["text"]) and got[3]["text"] == long and got[4]["text"] is None
    assert decontaminate.cleaned(documents, b).columns == documents.columns


def test_benchmark_rows_without_id_hit_words(spark):
    passage = sentence(random.Random(12), 20)
    docs = spark.createDataFrame([(1, passage, len(passage)), (2, "before", 6)], "doc_id long, text string, n_chars int")
    benchmark = spark.createDataFrame([(None, passage)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.report(docs, benchmark).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {1: (20, 0, empty, True), 2: (0, 0, empty, False)}
    assert [r["doc_id"] for r in decontaminate.cleaned(docs, benchmark).collect()] == [2]


def test_copies_of_items_and_repeated_windows_are_looked_up_once():
    items = [(i, b"One two, three four") for i in range(5000)] + [(None, b"one two three four")]
    items += [("long", b"la " * 5000), ("odd", b"la " * 20 + b"end")]
    windows = decontaminate.Windows(items, 3)
    # four words have two windows of three; "odd" adds two that end in "end"
    assert len(windows.hashes) == 2 + 1 + 2
    texts = [decontaminate.words(t) for t in (b"one two three", b"la " * 3000, b"x la la end", b"la la")]
    found = windows.scan(texts)
    assert sorted(found) == [0, 1, 2]
    assert found[0][1] == {str(i) for i in range(5000)} and found[0][0].all()
    assert found[1][1] == {"long", "odd"} and found[1][0].all()
    assert found[2][1] == {"odd"} and found[2][0].tolist() == [False, True, True, True]
