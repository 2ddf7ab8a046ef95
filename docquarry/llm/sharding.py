"""Sharding by jump consistent hashing, in DataFrame operations only.

A key's shard follows from a pseudo-random sequence that the key seeds: the shard is the last place it jumps to below the
number of shards. With one shard more, a key stays or jumps into the new shard, so only 1/(n+1) of all rows move and no
ring table is needed. Law `key`: doc_id and the number of shards decide.

Slots number the rows of a shard from 0 without gaps, in the order of a hash of each row. Rows are counted by ranges of
that order first; offsets come from the counts, and only the rows of one small range are ever put in order together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered_copies, written

SHARDS = 40
#: Bytes that a row takes besides its text.
OVERHEAD = 16
#: Ranges of the order within a shard, as hexadecimal digits: 16 ** 3.
BUCKET_DIGITS = 3

# fixed value: the multiplier of the linear congruential step of jump consistent hashing, in 16-bit limbs from the low end
_LIMBS = [(2862933555777941757 >> (16 * i)) & 0xFFFF for i in range(4)]


def _jump_step(state: Column, most: int) -> Column:
    """One jump of state (hi, lo: 32-bit halves of the key; at: last place; to: next place) while to < most."""
    hi, lo = state["hi"], state["lo"]
    # the product modulo 2**64, by limbs that never overflow a bigint
    t0 = lo * _LIMBS[0] + 1
    t1 = F.shiftright(t0, 16) + lo * _LIMBS[1]
    t2 = F.shiftright(t1, 16) + lo * _LIMBS[2] + hi * _LIMBS[0]
    t3 = F.shiftright(t2, 16) + lo * _LIMBS[3] + hi * _LIMBS[1]
    low = t1.bitwiseAND(0xFFFF) * 65536 + t0.bitwiseAND(0xFFFF)
    high = t3.bitwiseAND(0xFFFF) * 65536 + t2.bitwiseAND(0xFFFF)
    # key >> 33, plus one
    draw = F.shiftright(high, 1) + 1
    to = F.floor((state["to"] + 1).cast("double") * (F.lit(2147483648.0) / draw.cast("double")))
    return F.struct(high.alias("hi"), low.alias("lo"), state["to"].alias("at"), F.least(to, F.lit(most)).cast("long").alias("to"))


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard of a 64-bit key among `shards`, and among one more. A null key counts as 0.

    Jumps only go up, so `shards` + 1 steps reach the end for every key.
    """
    key = F.coalesce(key.cast("long"), F.lit(0))
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(0xFFFFFFFF).alias("lo"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("small"))

    def step(s, _):
        jumped = _jump_step(s, shards + 1)
        small = F.when(s["to"] < shards, s["to"]).otherwise(s["small"])
        on = F.struct(jumped["hi"].alias("hi"), jumped["lo"].alias("lo"), jumped["at"].alias("at"), jumped["to"].alias("to"), small.alias("small"))
        return F.when(s["to"] > shards, s).otherwise(on)

    end = F.aggregate(F.sequence(F.lit(0), F.lit(shards + 1)), start, step)
    return F.struct(end["small"].cast("int").alias("shard"), end["at"].cast("int").alias("grown"))


def placed(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of documents (doc_id long, text string).

    A null text has no bytes and the checksum of none; rows without a doc_id share the shard of key 0. Equal rows share a
    shard and follow one another in it. Further columns are ignored.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    equal = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    equal = equal.withColumn("_jump", jump_shards(F.col("doc_id"), shards)).select("*", F.col("_jump.shard").alias("shard"), F.col("_jump.grown").alias("grown_shard")).drop("_jump")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    equal = written(equal.withColumn("place", F.md5(F.concat_ws(":", name("doc_id"), name("size"), name("text_crc32")))))
    bucket = F.substring("place", 1, BUCKET_DIGITS)
    counts = equal.groupBy("shard", bucket.alias("bucket")).agg(F.sum("copies").alias("rows"))
    # at most 16 ** BUCKET_DIGITS rows for each shard, whatever the input
    offsets = counts.select("shard", "bucket", (F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("rows")).alias("offset"))
    order = Window.partitionBy("shard", "bucket").orderBy("place", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    slotted = equal.withColumn("bucket", bucket).withColumn("ahead", F.coalesce(F.sum("copies").over(order), F.lit(0))).join(offsets, ["shard", "bucket"])
    out = numbered_copies(slotted, "copies", "copy")
    slot = (F.col("offset") + F.col("ahead") + F.col("copy")).cast("long")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """documents with shard and grown_shard. A null doc_id shares the shard of key 0; repeated rows share one; other columns,
    null or not, go along. A documents column named shard or grown_shard is refused: it would be lost."""
    if taken := {"shard", "grown_shard"} & set(documents.columns):
        raise ValueError(f"documents already have {', '.join(sorted(taken))}")
    jump = jump_shards(F.col("doc_id"), shards)
    return documents.withColumns({"shard": jump["shard"], "grown_shard": jump["grown"]})
