import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from corpus_fixtures import DOCUMENTS, collected, sentence

from docquarry.llm import common, mixing


def deal(given, children):
    """children: name to (cap, weight). Shares by weight, filled up among those that can take more."""
    share, open_, left = {}, dict(children), given
    while open_:
        total = sum(w for _, w in open_.values())
        full = [n for n, (cap, w) in open_.items() if cap * total <= w * left]
        if not full:
            parts = {n: w * left // total for n, (_, w) in open_.items()}
            odd = left - sum(parts.values())
            for i, n in enumerate(sorted(parts)):
                share[n] = parts[n] + (i < odd)
            break
        # those that need least for their weight are filled first
        n = min(full, key=lambda n: (Fraction(*open_[n]), n))
        share[n], _ = open_.pop(n)
        left -= share[n]
    return share


def brute(rows, share, epochs, seed=mixing.SEED):
    docs = []
    for i, text, lang, source, *_ in rows:
        domain = next((d for d, s in mixing.DOMAINS.items() if source in s), "other")
        docs.append((i, domain, lang or "(none)", source or "(none)", len((text or "").split()), "-" if text is None else hashlib.md5(text.encode()).hexdigest()))
    leaves = defaultdict(int)
    for _, d, lang, s, n, _ in docs:
        leaves[d, lang, s] += n
    budget = min(sum(leaves.values()) * share[0] // share[1], epochs * sum(leaves.values()))
    weights = [mixing.DOMAIN_WEIGHTS, mixing.LANGUAGE_WEIGHTS, mixing.SOURCE_WEIGHTS]
    given = {(): budget}
    for depth in range(3):
        below = defaultdict(lambda: defaultdict(int))
        for leaf, n in leaves.items():
            below[leaf[:depth]][leaf[depth]] += n * epochs
        given = {(*parent, name): x for parent, caps in below.items() for name, x in deal(given[parent], {n: (cap, weights[depth].get(n, 1)) for n, cap in caps.items()}).items()}
    out = []
    for leaf, b in given.items():
        if not b:
            continue
        own = [x for x in docs if x[1:4] == leaf]
        last, rest = divmod(b, leaves[leaf])
        out += [(i, *leaf, e, n, b) for i, *_, n, _ in own for e in range(last)]
        place = lambda x: (hashlib.md5(f"{seed}:{last}:{'-' if x[0] is None else x[0]}:{x[5]}".encode()).hexdigest(), x[0] or -1, x[4])  # noqa: E731, B023
        ahead = 0
        for i, *_, n, _ in sorted(own, key=place):
            if ahead < rest:
                out.append((i, *leaf, last, n, b))
            ahead += n
    return sorted(out, key=repr)


@pytest.mark.parametrize(("share", "epochs"), [((3, 5), 1), ((3, 5), 2), ((8, 5), 2), ((9, 1), 3), ((1, 1000), 1)])
def test_against_brute_force(documents, rows, share, epochs):
    got = mixing.mix(documents, share, epochs).select("row.doc_id", "domain", "language", "origin", "epoch", "n_tokens", "budget")
    assert collected(got) == brute(rows, share, epochs)


@pytest.mark.parametrize("share", [(3, 5), (1, 50), (6, 5)])
def test_one_id_on_most_rows(spark, monkeypatch, share):
    """Rows without an id, of one id, and copies of one row, each more than a third of all."""
    monkeypatch.setattr(common, "COPIES", 16)
    r = random.Random(share[0])
    rows = [(r.choice([None, 7]), sentence(r, r.randrange(0, 9)), "en", "src0", i) for i in range(300)]
    rows += [(3, "the same five words again", "en", "src0", i % 3) for i in range(400)]
    documents = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    got = mixing.mix(documents, share, 2).select("row.doc_id", "domain", "language", "origin", "epoch", "n_tokens", "budget")
    assert collected(got) == brute(rows, share, 2)
    again = [sorted(map(tuple, mixing.mix(documents.repartition(n), share, 2).select("row.*", "epoch").collect()), key=repr) for n in (1, 7)]
    assert again[0] == again[1]


def test_shortages_go_to_siblings_first(spark):
    leaves = [("web", "en", "src0", 1000), ("web", "en", "src1", 10), ("web", "de", "src0", 1000), ("books", "en", "src10", 1000)]
    plans = mixing.plan(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), (1, 3), 1)
    budget = {tuple(r)[:3]: r["budget"] for r in plans.collect()}
    # of 1003 tokens, web gets 5/8; en gets 4/6 of that; what src1 lacks stays with src0
    assert sum(budget.values()) == 1003 and budget["web", "en", "src1"] == 10
    assert budget["web", "en", "src0"] + 10 in (417, 418) and sum(v for k, v in budget.items() if k[0] == "web") in (626, 627)


def test_nothing_and_clashing_names(documents, nothing, clashing):
    assert mixing.report(nothing).collect() == []
    assert collected(mixing.report(clashing)) == collected(mixing.report(documents))
    assert mixing.mixed(clashing).columns == clashing.columns
    assert mixing.mixed(nothing).collect() == []
