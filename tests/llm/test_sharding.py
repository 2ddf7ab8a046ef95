import zlib
from collections import Counter

import pytest
from corpus_fixtures import collected
from pyspark.sql import functions as F

from docquarry.llm import common, sharding


def jump(key: int, n: int) -> int:
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump(spark):
    keys = [0, 1, 2, -1, 2**63 - 1, -(2**63), 10**12, *range(1000, 3000)]
    for n in (1, 2, 7, 40, 1000):
        some = keys if n <= 40 else keys[:40]
        got = spark.createDataFrame([(k,) for k in some], "k long").select("k", sharding.jump_shards(F.col("k"), n).alias("s")).select("k", "s.*").collect()
        assert all((r["shard"], r["grown"]) == (jump(r["k"], n), jump(r["k"], n + 1)) for r in got)
        assert all(r["grown"] in (r["shard"], n) for r in got)


def test_placed(documents, rows, nothing, clashing):
    got = sharding.placed(documents)
    found = got.collect()
    want = []
    for i, text, *_ in rows:
        raw = (text or "").encode()
        want.append((i, len(raw) + 16, zlib.crc32(raw), "key", jump(i or 0, 40), jump(i or 0, 41)))
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in found), key=repr) == sorted(want, key=repr)
    for shard, n in Counter(r["shard"] for r in found).items():
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(n))
    assert collected(sharding.placed(clashing)) == collected(got)
    assert sharding.placed(nothing).collect() == []


@pytest.mark.parametrize("at_once", [7, 4096])
def test_many_equal_rows(spark, monkeypatch, at_once):
    monkeypatch.setattr(common, "COPIES", at_once)
    rows = spark.range(3000).select(F.lit(5).alias("doc_id"), F.lit("same").alias("text")).union(spark.range(200).select("id", F.lit("x")))
    got = sharding.placed(rows).where(F.col("shard") == jump(5, 40)).select("slot").collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got))) and len(got) >= 3000


def test_sharded(documents, clashing, nothing):
    assert sharding.sharded(documents).columns == [*documents.columns, "shard", "grown_shard"]
    with pytest.raises(ValueError, match="shard"):
        sharding.sharded(clashing)
    assert sharding.sharded(clashing.drop("shard")).where("shard < 0 or shard > 39 or grown_shard > 40").count() == 0
    assert sharding.sharded(nothing).collect() == []
