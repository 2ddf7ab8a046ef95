import random

import pytest

from docquarry.llm import near_dups

from corpus_fixtures import collected, sentence


def brute(rows):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if None not in (i, j) and x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return sorted([(i, len(s), None if i is None and s else root(i), True if i is None else root(i) == i) for i, s in sets], key=repr)


def test_against_brute_force(documents, rows):
    assert collected(near_dups.link(documents)) == brute([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("small", [0, 16])
def test_large_groups(spark, monkeypatch, small):
    """Long lists: chains of near copies far from the first one, beside documents that only quote a passage."""
    monkeypatch.setattr(near_dups, "SMALL", small)
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    r = random.Random(small)
    rows, words = [], sentence(r, 120).split(" ")
    for i in range(70):  # every step changes a word, so that far steps aren't alike
        words[r.randrange(120)] = f"step{i}"
        rows.append((1000 - i, " ".join(words)))
    passage = sentence(r, 60)
    rows += [(2000 + i, passage + " " + sentence(r, r.randrange(0, 40))) for i in range(50)]
    r.shuffle(rows)
    got = near_dups.link(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collected(got) == brute(rows)


@pytest.mark.parametrize("small", [0, 4])
def test_templates(spark, monkeypatch, small):
    """Forms with fields, quoted passages that overlap, and copies of them with more and less of their own words."""
    monkeypatch.setattr(near_dups, "SMALL", small)
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    r = random.Random(10 + small)
    rows = []
    form = sentence(r, 90).split(" ")
    for _ in range(60):
        words = list(form)
        for field in r.sample([10, 30, 50, 70], r.randrange(1, 4)):
            words[field] = r.choice(["red", "green", "blue"])
        rows.append(" ".join(words) + " " + sentence(r, r.choice([0, 5, 12, 20, 25, 30])))
    whole = sentence(r, 80).split(" ")
    for _ in range(60):
        start = r.choice([0, 5, 10, 15])
        rows.append(" ".join(whole[start : start + r.choice([50, 60, 65])]) + " " + sentence(r, r.randrange(0, 25)))
    rows = [(i * 7 % 1009 - 300, t) for i, t in enumerate(rows)]
    got = near_dups.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert collected(got) == brute(rows)


@pytest.mark.parametrize("small", [0, 16])
def test_rows_of_one_id_are_one_document(spark, monkeypatch, small):
    """An id with several texts ties together what is similar to any of them."""
    monkeypatch.setattr(near_dups, "SMALL", small)
    r = random.Random(21)
    one, two, three = (sentence(r, 40) for _ in range(3))
    near = lambda text: " ".join(w if i != 20 else f"edit{r.randrange(99)}" for i, w in enumerate(text.split(" ")))
    rows = [(50, one), (50, two), (7, near(one)), (8, near(two)), (9, three), (3, one), (60, near(three)), (60, ""), (70, None), (70, near(two))]
    rows += [(100 + i, near(one)) for i in range(20)] + [(107, near(three)), (107, near(three))]
    got = near_dups.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    texts = {i for i, _, c, _ in brute(rows) if c == 3}
    assert {r["doc_id"] for r in got.where("component_id = 3 and n_shingles > 0").collect()} == {i for i in texts if i is not None}
    assert sorted(x for x in collected(got) if x[1]) == sorted(x for x in brute(rows) if x[1])


def test_repeated_ids_are_settled_by_content(spark):
    """Of rows with one doc_id the least by text stays, however the rows lie."""
    rows = [(1, "b c d e f g", "x"), (1, "a a a a a a", "y"), (1, "b c d e f g", "w"), (2, "b c d e f g", "z"), (3, None, None), (3, None, "q"), (None, "b c d e f g", "n")]
    for parts in (1, 4):
        got = near_dups.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, _perhaps string").repartition(parts)).collect()
        assert sorted(map(tuple, got), key=repr) == sorted([(1, "a a a a a a", "y"), (3, None, "q"), (None, "b c d e f g", "n")], key=repr)


def test_clashing_names_and_nothing(documents, clashing, nothing):
    assert collected(near_dups.link(clashing)) == collected(near_dups.link(documents))
    assert near_dups.link(nothing).collect() == []


def test_deduplicated(documents, nothing, rows):
    kept = {r[0] for r in brute([(r[0], r[1]) for r in rows]) if r[3] and r[0] is not None}
    got = near_dups.deduplicated(documents)
    assert got.columns == documents.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(kept) and ids.count(None) == 2
    assert near_dups.deduplicated(nothing).collect() == []


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(200)] + [(500 + i, 500) for i in range(100)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(150)]
    found = dict(near_dups.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(found[i] == 0 for i in range(1, 201)) and all(found[500 + i] == 500 for i in range(1, 100)) and 0 not in found
    for a, b in links:
        assert found.get(a, a) == found.get(b, b)
