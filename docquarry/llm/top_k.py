"""Exact top-k search by distributed histogram selection.

Queries go through in blocks of about QUERY_BLOCK vectors, which are broadcast; candidates stay where they are. A round
scores every candidate against every query of the block and counts the scores in BINS equal ranges of what is still open
for each query. A task sends its counts from the top down to its own kth score, for what lies lower cannot matter; the
sums of all tasks show which range holds the kth score, and the next round opens that range, until it holds few scores or
is one score wide. Ties at that score are then narrowed by vec_id in the same way. A last pass sends what lies within the
bounds of each query, and ranks it by score and vec_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

K = 10
#: Queries that one scan of all candidates scores: what is broadcast is this many vectors.
QUERY_BLOCK = 4096
BINS = 1024
#: Candidates that a task scores at once, and chunks between two looks at a task's own kth scores.
CANDIDATES = 256
LOOK = 8
#: A query whose open range holds so few scores needs no further round.
FEW = 64

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def quantised(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(floor(1024 * x) of all components, first component and length of each row, which rows take part)."""
    import pyarrow as pa

    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64())
    bad = ~np.isfinite(values.to_numpy(zero_copy_only=False))
    bad |= np.asarray(values.is_null())
    so_far = np.concatenate([[0], np.cumsum(bad)])
    fit = np.asarray(column.is_valid()) & (so_far[offsets[1:]] == so_far[offsets[:-1]])
    whole = np.floor(1024 * np.where(bad, 0.0, values.to_numpy(zero_copy_only=False)))
    return whole, offsets[:-1], np.diff(offsets), fit


def _scores(candidates: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products: in double where all sums are exact there, else in Python's integers, held to the range of a long."""
    if np.abs(candidates).max(initial=0) * np.abs(queries).max(initial=0) * max(1, candidates.shape[1]) < 2.0**53:
        return (candidates @ queries.T).astype(np.int64)
    as_int = np.vectorize(int, otypes=[object])
    return np.clip(as_int(candidates) @ as_int(queries).T, _LOW, _HIGH).astype(np.int64)


class Block:
    """Queries (ids, vectors of any lengths), grouped by length: an inner product needs equal ones."""

    def __init__(self, ids: list[int], vectors: list[np.ndarray]):
        self.ids = np.array(ids, np.int64)
        self.groups = {}
        for d in sorted({len(v) for v in vectors}):
            at = np.array([i for i, v in enumerate(vectors) if len(v) == d])
            self.groups[d] = (at, np.array([vectors[i] for i in at], np.float64).reshape(len(at), d))


def _scored(batches, block: Block):
    """(places of queries in the block, candidate ids, scores with a row for each candidate), chunk by chunk."""
    for batch in batches:
        whole, first, length, fit = quantised(batch.column(1))
        fit &= np.asarray(batch.column(0).is_valid())
        ids = batch.column(0).fill_null(0).to_numpy()
        for d, (at, queries) in block.groups.items():
            chosen = np.flatnonzero(fit & (length == d))
            for part in np.array_split(chosen, len(chosen) // CANDIDATES + 1):
                if len(part):
                    yield at, ids[part], _scores(whole[first[part][:, None] + np.arange(d)], queries)


class Bounds:
    """What is known of each query of a block: the open range [low, high] of scores, or of ids once by_id, and the result so far.

    A row is sent if its score is at least `least`, and at score `tied` its id is at most `last`.
    """

    def __init__(self, n: int, k: int, most: int):
        self.bins = BINS
        self.low, self.high = np.full(n, -most, object), np.full(n, most, object)
        self.by_id, self.going = np.zeros(n, bool), np.ones(n, bool)
        self.need = np.full(n, k, np.int64)
        self.least, self.tied, self.last = np.full(n, _LOW, np.int64), np.full(n, _HIGH, np.int64), np.full(n, _HIGH, np.int64)

    def width(self) -> np.ndarray:
        return np.array([max(1, -(-(h - a + 1) // self.bins)) for a, h in zip(self.low, self.high, strict=True)], object)

    def narrow(self, crossing: dict) -> None:
        """crossing: query to (place of the range that holds its kth, rows before it, rows in it)."""
        width = self.width()
        for q in np.flatnonzero(self.going):
            if q not in crossing:  # fewer than k candidates: all are sent
                self.going[q] = False
                continue
            place, before, inside = crossing[q]
            low = self.low[q] + (place if self.by_id[q] else self.bins - 1 - place) * width[q]
            high = min(low + width[q] - 1, self.high[q])
            self.low[q], self.high[q], self.need[q] = low, high, self.need[q] - before
            if self.by_id[q]:
                self.last[q] = high
                self.going[q] = inside > FEW and low < high
            else:
                self.least[q] = low
                self.going[q] = inside > FEW
                if low == high and self.going[q]:
                    self.by_id[q], self.tied[q], self.low[q], self.high[q] = True, low, _LOW, _HIGH


def _histogram(shared):
    def count(batches):
        import pyarrow as pa

        block, bounds = shared.value
        n, by_id = len(block.ids), bounds.by_id
        low, high, width = bounds.low.astype(np.int64), bounds.high.astype(np.int64), bounds.width().astype(np.uint64)
        floor = np.zeros(n, np.int64)  # the bin of a task's own kth score
        counts = np.zeros((n, bounds.bins), np.int64)
        for chunk, (at, ids, scores) in enumerate(_scored(batches, block)):
            value = np.where(by_id[at], ids[:, None], scores) if by_id.any() else scores
            inside = (value >= low[at]) & (value <= high[at]) & bounds.going[at] & (ids[:, None] != block.ids[at])
            if by_id.any():
                inside &= ~by_id[at] | (scores == bounds.tied[at])
            who, which = np.nonzero(inside)
            bins = ((value[who, which].astype(np.uint64) - low[at][which].astype(np.uint64)) // width[at][which]).astype(np.int64)
            can = by_id[at][which] | (bins >= floor[at][which])
            np.add.at(counts, (at[which][can], bins[can]), 1)
            if chunk % LOOK == 0:
                above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
                floor = (above >= bounds.need[:, None]).sum(axis=1) - 1
        for q in np.flatnonzero(counts.any(axis=1)):
            own = counts[q] if by_id[q] else counts[q][::-1]  # of scores the top counts, of ids the bottom
            places = np.flatnonzero(own[: int(np.searchsorted(np.cumsum(own), bounds.need[q])) + 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), q)), pa.array(places), pa.array(own[places])], ["query", "place", "n"])

    return count


def _selected(shared):
    def select(batches):
        import pyarrow as pa

        block, bounds = shared.value
        for at, ids, scores in _scored(batches, block):
            inside = (scores >= bounds.least[at]) & ((scores != bounds.tied[at]) | (ids[:, None] <= bounds.last[at])) & (ids[:, None] != block.ids[at])
            who, which = np.nonzero(inside)
            if len(who):
                yield pa.RecordBatch.from_arrays([pa.array(block.ids[at[which]]), pa.array(ids[who]), pa.array(scores[who, which])], ["query_id", "vec_id", "score"])

    return select


def _bounded(vectors: DataFrame, block: Block, k: int, most: int):
    """The block and its bounds, broadcast: rounds of histograms until no query has a range open."""
    spark = vectors.sparkSession
    bounds = Bounds(len(block.ids), k, most)
    while bounds.going.any():
        shared = spark.sparkContext.broadcast((block, bounds))
        counts = vectors.mapInArrow(_histogram(shared), "query long, place long, n long").groupBy("query", "place").agg(F.sum("n").alias("n"))
        need = spark.createDataFrame([(i, int(x)) for i, x in enumerate(bounds.need)], "query long, need long")  # a row for each query of the block
        upto = F.sum("n").over(Window.partitionBy("query").orderBy("place"))
        crossing = counts.withColumn("upto", upto).join(F.broadcast(need), "query").where("upto >= need and upto - n < need")
        bounds.narrow({r["query"]: (r["place"], r["upto"] - r["n"], r["n"]) for r in crossing.collect()})
    return spark.sparkContext.broadcast((block, bounds))


def _largest(vectors: DataFrame) -> int:
    """A bound on the size of any score, from the largest finite component and the longest vector."""
    sizes = F.transform("embedding", lambda x: F.when(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.abs(x.cast("double"))))
    most, length = vectors.agg(F.max(F.array_max(sizes)), F.max(F.size("embedding"))).first()
    return min(_HIGH, (int(1024 * (most or 0.0)) + 1) ** 2 * max(1, length or 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k candidates of highest score for each query, ties to smaller vec_id.

    vectors and queries have vec_id long and embedding array of numbers. A row whose vec_id is the query's is no candidate
    for it. Null vectors, and those with null or non-finite components, take no part, nor do rows without vec_id. Vectors
    of different lengths have no score. Repeated rows are candidates each; of queries that repeat a vec_id, the least
    vector that takes part counts. Scores beyond a long are held at its ends. Without queries or candidates, the result is
    empty. Further columns of either table, of any names, are ignored.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    # an unfit copy of a query is no least vector
    queries = queries.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    most, path = _largest(vectors), scratch(spark)
    blocks = queries.count() // query_block + 1
    for number in range(blocks):
        table = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).toArrow().combine_chunks()
        ids, vectors_of = [], []
        for batch in table.to_batches():
            whole, first, length, fit = quantised(batch.column(1))
            for i in np.flatnonzero(fit):
                ids.append(batch.column(0)[int(i)].as_py())
                vectors_of.append(whole[first[i] : first[i] + length[i]])
        found = vectors.mapInArrow(_selected(_bounded(vectors, Block(ids, vectors_of), k, most)), "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)
