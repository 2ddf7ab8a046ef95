"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of WIDTH bytes, STRIDE apart, from its first byte to its last. Each byte has a
learned embedding; FILTERS learned filters look at every chunk. Their outputs are max-pooled over the whole text, and a
hidden layer combines the maxima into one probability. Long texts go through in pieces whose maxima are combined, so
memory has a bound and no byte is left out.

Training reads at most SAMPLE labelled rows, chosen by a hash of their ids (all labelled rows, if there are fewer), and draws
stretches from anywhere in them, up to the whole of them (texts of over common.HELD_CHARS characters give it that many, from
end to end); it follows the gradient of the cross-entropy by Adam, from a fixed seed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, held, mapped, pieces, sampled, slices

THRESHOLD = 0.3
#: Labelled rows that training uses at most, and bytes up to which stretches are drawn at least; of a longer text, up to all of it.
SAMPLE = 4000
TRAIN_BYTES = 2048

WIDTH, STRIDE = 24, 8
EMBEDDING, FILTERS, HIDDEN = 6, 48, 16
STEPS, BATCH, RATE = 800, 64, 0.01
#: Weight of label 1 against label 0: most documents are worth keeping, and short ones say little.
KEEP_WEIGHT = 0.7
SHORTEST = 16
SEED = 11
#: Chunks that go through the filters at once.
AT_ONCE = 1 << 14


def chunks(length: int) -> int:
    """How many chunks cover a text of so many bytes: at least one; the last is padded."""
    return max(1, -(-(length - WIDTH) // STRIDE) + 1)


class Network:
    NAMES = ("embedding", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias")

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        scale = lambda *shape: (r.standard_normal(shape) * np.sqrt(2 / shape[0])).astype(np.float32)
        # byte 256 pads the last chunk
        self.embedding = (r.standard_normal((257, EMBEDDING)) * 0.5).astype(np.float32)
        self.filters, self.bias = scale(WIDTH * EMBEDDING, FILTERS), np.zeros(FILTERS, np.float32)
        self.hidden, self.hidden_bias = scale(FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32)
        self.out, self.out_bias = scale(HIDDEN, 1)[:, 0], np.zeros(1, np.float32)

    def look(self, padded: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of chunks, and the outputs of all filters on them."""
        codes = padded[starts[:, None] + np.arange(WIDTH)]
        x = self.embedding[codes].reshape(len(starts), WIDTH * EMBEDDING)
        return x, np.maximum(x @ self.filters + self.bias, 0)

    def combined(self, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layer and probability from the maxima."""
        h = np.maximum(most @ self.hidden + self.hidden_bias, 0)
        z = np.clip(h @ self.out + self.out_bias[0], -30, 30)
        return h, 1 / (1 + np.exp(-z))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of each text in data, cut at offsets."""
        lengths = np.diff(offsets)
        n = np.maximum(1, -(-(lengths - WIDTH) // STRIDE) + 1)
        most = np.zeros((len(n), FILTERS), np.float32)
        # each text is laid out with its own padding, so no chunk reaches into the next text
        room = (n - 1) * STRIDE + WIDTH
        ends = np.cumsum(n)
        first = 0
        while first < len(n):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, "right")))
            for lo in range(0, int(n[first]) if last == first + 1 else 1, AT_ONCE):
                if last == first + 1:  # one text, perhaps a part of a long one
                    some = min(AT_ONCE, int(n[first]) - lo)
                    at = offsets[first] + lo * STRIDE
                    own = data[at : min(offsets[first + 1], at + (some - 1) * STRIDE + WIDTH)]
                    padded = np.full((some - 1) * STRIDE + WIDTH, 256, np.int16)
                    padded[: len(own)] = own
                    _, y = self.look(padded, np.arange(some) * STRIDE)
                    most[first] = np.maximum(most[first], y.max(axis=0))
                else:
                    base = np.cumsum(room[first:last]) - room[first:last]
                    padded = np.full(int(room[first:last].sum()), 256, np.int16)
                    own = lengths[first:last]
                    shift = np.repeat(base - (offsets[first:last] - offsets[first]), own)
                    padded[np.arange(int(own.sum())) + shift] = data[offsets[first] : offsets[last]]
                    count = n[first:last]
                    begin = np.cumsum(count) - count
                    starts = np.repeat(base, count) + STRIDE * (np.arange(int(count.sum())) - np.repeat(begin, count))
                    _, y = self.look(padded, starts)
                    most[first:last] = np.maximum.reduceat(y, begin, axis=0)
            first = last
        return self.combined(most)[1]

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        n = np.array([chunks(len(t)) for t in texts])
        begin = np.cumsum(n) - n
        padded = np.full(int(((n - 1) * STRIDE + WIDTH).sum()), 256, np.int16)
        base = np.cumsum((n - 1) * STRIDE + WIDTH) - ((n - 1) * STRIDE + WIDTH)
        for b, t in zip(base, texts, strict=True):
            padded[b : b + len(t)] = t
        starts = np.repeat(base, n) + STRIDE * (np.arange(int(n.sum())) - np.repeat(begin, n))
        owner = np.repeat(np.arange(len(n)), n)
        parts = [slice(lo, lo + AT_ONCE) for lo in range(0, len(starts), AT_ONCE)]
        # the greatest output so far, and how many chunks have it
        most, count = np.full((len(n), FILTERS), -1, self.filters.dtype), np.zeros((len(n), FILTERS), np.float32)
        for part in parts:
            x, y = self.look(padded, starts[part])
            at = owner[part] - owner[part][0]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            own = owner[part][first]
            top = np.maximum.reduceat(y, first, axis=0)
            ties = np.add.reduceat(y == top[at], first, axis=0, dtype=np.float32)
            count[own] = np.where(top > most[own], ties, count[own] + ties * (top == most[own]))
            most[own] = np.maximum(most[own], top)
        h, p = self.combined(most)
        dz = ((p - labels) * weights / weights.sum()).astype(np.float32)
        dh = dz[:, None] * self.out * (h > 0)
        # the gradient of the maximum is shared by the chunks that have it
        dmost = dh @ self.hidden.T / count
        dembedding, dfilters, dbias = np.zeros((257, EMBEDDING), np.float32), 0, 0
        for part in parts:
            if len(parts) > 1:
                x, y = self.look(padded, starts[part])
            at = owner[part]
            dy = (y == most[at]) * dmost[at] * (y > 0)
            dx = (dy @ self.filters.T).reshape(-1, EMBEDDING)
            codes = padded[starts[part][:, None] + np.arange(WIDTH)].ravel()
            dembedding += np.stack([np.bincount(codes, dx[:, e], 257) for e in range(EMBEDDING)], axis=1).astype(np.float32)
            dfilters, dbias = dfilters + x.T @ dy, dbias + dy.sum(axis=0)
        return [dembedding, dfilters, dbias, most.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(keepdims=True)]


def trained(texts: list[bytes], labels: list[int], steps: int = STEPS, seed: int = SEED) -> Network:
    """A network fitted to texts and labels (0 or 1); batches hold as many of either. Without both labels, it knows nothing and says 0.5 or the only label."""
    network, r = Network(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        network.out[:] = 0
        network.out_bias[:] = 0 if not len(y) else 8 * (2 * y[0] - 1)
        return network
    data = [np.frombuffer(t, np.uint8) for t in texts]
    by_label = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
    weights = np.where(y == 1, KEEP_WEIGHT, 1 - KEEP_WEIGHT).astype(np.float32)
    m = [np.zeros_like(getattr(network, k)) for k in Network.NAMES]
    v = [np.zeros_like(x) for x in m]
    for step in range(1, steps + 1):
        chosen = np.concatenate([r.choice(some, BATCH // 2) for some in by_label])
        # any stretch of a text must do
        batch = []
        for i in chosen:
            length = min(len(data[i]), int(SHORTEST * (max(TRAIN_BYTES, len(data[i])) / SHORTEST) ** r.random()))
            at = int(r.integers(0, max(1, len(data[i]) - length + 1)))
            batch.append(data[i][at : at + length])
        rate = RATE * min(1.0, step / 50) * (1 - 0.95 * step / steps)
        for k, (name, g) in enumerate(zip(Network.NAMES, network.gradients(batch, y[chosen], weights[chosen]), strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            setattr(network, name, (getattr(network, name) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32))
    return network


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network from the labelled documents that are not held out: at most `sample` of them, by a hash of doc_id."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = sampled(known.where(~held_out(F.col("doc_id"))), "doc_id", sample, SEED)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    # of rows that repeat an id, the first by text counts
    rows = rows.groupBy("doc_id", "quality", "turn").agg(F.min("text").alias("text"))
    rows = rows.withColumn("text", held(F.col("text"), SEED))

    def fit_rows(found):
        found.sort(key=lambda row: (row["turn"], row["doc_id"]))
        return trained([row["text"].encode() for row in found], [row["quality"] for row in found])

    return fitted(rows, fit_rows)


def _scorer(shared):
    def score(batches):
        import pyarrow as pa

        network = shared.value
        for whole in batches:
            for batch in pieces(whole):
                data, offsets, _ = slices(batch.column(batch.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(network.scores(data, offsets).astype(np.float64))], [*batch.schema.names[:-1], "score"])

    return score


def scored(documents: DataFrame, network: Network) -> DataFrame:
    """documents as struct `row`, with score (0 to 1). A null text scores as an empty one; other columns take no part."""
    from pyspark.sql import types as T

    rows = documents.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("_text"))
    shared = documents.sparkSession.sparkContext.broadcast(network)
    return mapped(rows, _scorer(shared), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of documents. A null text scores as an empty one; repeated rows have
    a row each; a null doc_id is not held out. Further columns, of any names, are ignored."""
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(narrow, fit(documents, labels))
    return out.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the classifier does not reject, with all their columns, of any names; null texts are judged
    as empty ones, repeated rows alike."""
    return scored(documents, fit(documents, labels)).where(F.col("score") >= THRESHOLD).select("row.*")
