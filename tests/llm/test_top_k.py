import math
import random

import pytest

from docquarry.llm import top_k

KIND = "vec_id long, embedding array<double>"


def brute(vectors, queries, k):
    def quantised(v):
        return [math.floor(1024 * x) for x in v] if v is not None and all(x is not None and math.isfinite(x) for x in v) else None

    rows = [(i, q) for i, v in vectors if i is not None and (q := quantised(v)) is not None]
    out = []
    for query, q in ((i, q) for i, v in queries if i is not None and (q := quantised(v)) is not None):
        scored = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=True)))), i) for i, v in rows if i != query and len(v) == len(q)]
        out += [(query, rank, i, s) for rank, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(out)


def check(spark, vectors, queries, **options):
    got = top_k.search(spark.createDataFrame(vectors, KIND).repartition(3), spark.createDataFrame(queries, KIND), **options)
    assert sorted(tuple(r) for r in got.collect()) == brute(vectors, queries, options.get("k", 10))


@pytest.mark.parametrize("bins", [4, 1024])
def test_ties_and_odd_vectors(spark, monkeypatch, bins):
    monkeypatch.setattr(top_k, "BINS", bins)
    monkeypatch.setattr(top_k, "FEW", 3)
    monkeypatch.setattr(top_k, "CANDIDATES", 16)
    r = random.Random(bins)
    vectors = [(i, [r.gauss(0, 0.3) for _ in range(4)]) for i in range(200)]
    vectors += [(1000 + r.randrange(5000), [0.5, 0.5, 0.5, 0.5]) for _ in range(120)]  # ties by the score
    vectors += [(300, None), (301, [None, 1.0, 1.0, 1.0]), (302, [math.nan, 1.0, 1.0, 1.0]), (303, [math.inf, 0.0, 0.0, 0.0]), (304, [1.0]), (305, [2.0]), (306, []), (307, []), (None, [9.0] * 4)]
    vectors += vectors[:3]
    queries = [v for v in dict((x[0], x) for x in vectors[:20]).values()] + [vectors[250], *vectors[320:328]]
    check(spark, vectors, queries)
    check(spark, vectors, queries[:6], k=3, query_block=2)


def test_large_components_and_few_candidates(spark):
    vectors = [(1, [1e12, 1e12]), (2, [1e12, -1e12]), (3, [1e-3, 1.0]), (4, [-1e12, -1e12]), (5, [123456789.123, 0.1])]
    check(spark, vectors, vectors)


def test_unfit_copies_of_a_query(spark):
    vectors = [(i, [i / 10, 1.0]) for i in range(5)]
    unfit = [(0, [None, 1.0]), (1, [-math.inf, 0.0]), (2, [math.nan, 0.0]), (3, None)]
    check(spark, vectors + unfit, vectors + unfit)


def test_clashing_names_and_repeated_ids(spark):
    """A query id with a sound and an unfit row, in tables whose other columns have the names of the result."""
    vectors = [(100, [None, 1.0]), (100, [1.0, 1.0]), (1, [0.5, 1.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame(vectors, KIND).selectExpr("*", "'x' as score", "0 as rank", "1 as query_id", "2 as query", "3 as place", "4 as need")
    got = top_k.search(df, df.where("vec_id = 100"))
    assert sorted(tuple(r) for r in got.collect()) == brute(vectors, vectors[:2], 10) and got.count() == 2


def test_nothing(spark):
    none = spark.createDataFrame([], KIND)
    some = spark.createDataFrame([(1, [1.0])], KIND)
    assert top_k.search(none, some).collect() == [] == top_k.search(some, none).collect() == top_k.search(some, some).collect()
