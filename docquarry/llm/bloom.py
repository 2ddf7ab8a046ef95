"""A blocked Bloom filter in DataFrame operations: each key sets BITS bits in one block of 512, so a look-up is one probe of a
broadcast hash table of blocks. It says "surely not" or "perhaps"; what depends on it must come out right for a false "perhaps".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 6
#: Bits of the filter for each key.
BITS_PER_KEY = 16
#: 2 ** 15 blocks of 64 bytes: 2 MB, however many keys there are.
MOST_BLOCKS = 1 << 15


def _places(key: Column, blocks: int) -> tuple[Column, Column, list[tuple[Column, Column]]]:
    """The block of a key, and for each of its bits the word of the block (0 to 7) and the bit as a long."""
    block, more = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), F.xxhash64(F.lit("bits"), key)
    place = lambda x, i: F.shiftrightunsigned(x, 9 * i).bitwiseAND(511)
    word = lambda x, i: F.shiftrightunsigned(place(x, i), 6).cast("int")
    bit = lambda x, i: F.call_function("shiftleft", F.lit(1).cast("long"), place(x, i).bitwiseAND(63).cast("int"))
    return block, more, [(word(F.col("_more"), i), bit(F.col("_more"), i)) for i in range(BITS)]


def marked(rows: DataFrame, key: Column, keys: DataFrame, most_blocks: int = MOST_BLOCKS, out: str = "_perhaps") -> DataFrame:
    """rows with `out`: False where key is surely not among keys (a table of one column), True where it may be. A null key is not.

    A filter has at most most_blocks blocks, so what is broadcast has a fixed bound; more keys than that holds well make for
    more false "perhaps".
    """
    keys = keys.toDF("_key").where("_key is not null")
    blocks, wanted = 1, keys.count() * BITS_PER_KEY // 512
    while blocks < min(wanted, most_blocks):
        blocks *= 2
    block, more, places = _places(F.col("_key"), blocks)
    bits = keys.select(block.alias("_block"), more.alias("_more")).select("_block", F.explode(F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in places])).alias("_x"))
    words = [F.coalesce(F.bit_or(F.when(F.col("_x.word") == w, F.col("_x.bit"))), F.lit(0).cast("long")) for w in range(8)]
    filled = bits.groupBy("_block").agg(F.array(*words).alias("_words"))
    block, more, places = _places(key, blocks)
    has = F.lit(True)
    for word, bit in places:
        has = has & (F.get("_words", word).bitwiseAND(bit) != 0)
    joined = rows.withColumns({"_block": block, "_more": more}).join(F.broadcast(filled), "_block", "left")
    return joined.withColumn(out, key.isNotNull() & F.coalesce(has, F.lit(False))).drop("_block", "_more", "_words")
