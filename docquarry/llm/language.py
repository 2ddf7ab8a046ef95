"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text is cut into windows of WINDOW bytes. In each, one recurrent layer reads the bytes forwards and one backwards; both
states together label every position with the probability of each language. The probabilities of all positions of a text
are averaged: the most probable language is the prediction, and its average the score.

Training reads at most SAMPLE rows with a language, as many of each language where it has them, chosen by a hash of their
ids, and draws windows from anywhere in them (texts of over common.HELD_CHARS characters give it that many, from end to end).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fitted, held, mapped, pieces, slices

#: Rows that training uses at most.
SAMPLE = 6000

WINDOW = 64
EMBEDDING, STATE = 8, 8
STEPS, BATCH, RATE = 400, 128, 0.02
SEED = 7
#: Windows that go through the network at once.
AT_ONCE = 4096

_PAD = 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place: 1 / (1 + exp(-x))."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """Parameters by name; for each direction d of f and b: W_d (embedding to gates), U_d (state to gates), c_d (bias).

    Gates are laid out as update, reset and candidate; the reset gate scales what the candidate gets from the state.
    """

    def __init__(self, languages: list[str], seed: int = SEED):
        r = np.random.default_rng(seed)
        self.languages = languages
        n = max(1, len(languages))
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": draw(257, EMBEDDING) * 8}
        for d in "fb":
            self.p |= {f"W_{d}": draw(EMBEDDING, 3 * STATE), f"U_{d}": draw(STATE, 3 * STATE), f"c_{d}": np.zeros(3 * STATE, np.float32), f"V_{d}": draw(STATE, n)}
        self.p["v"] = np.zeros(n, np.float32)

    def _states(self, codes: np.ndarray, d: str, mask: np.ndarray | None, keep: bool = False):
        """States after each step, in reading order; codes and mask are (positions, windows), already in that order."""
        table = self.p["E"] @ self.p[f"W_{d}"] + self.p[f"c_{d}"]
        u, s = self.p[f"U_{d}"], STATE
        out = np.zeros((len(codes) + 1, codes.shape[1], s), np.float32)
        kept = []
        for t in range(len(codes)):
            h = out[t]
            x, g = table[codes[t]], h @ u
            x[:, : 2 * s] += g[:, : 2 * s]
            zr = _sigmoid(x[:, : 2 * s])
            n = g[:, 2 * s :]
            if keep:
                candidate = n.copy()
            n *= zr[:, s:]
            n += x[:, 2 * s :]
            np.tanh(n, out=n)
            if keep:
                kept.append((zr.copy(), n.copy(), candidate))
            new = out[t + 1]
            np.subtract(h, n, out=new)
            new *= zr[:, :s]
            new += n
            if mask is not None:
                new *= mask[t][:, None]
        return (out, kept) if keep else out

    def _probabilities(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        z = forward @ self.p["V_f"]
        z += backward @ self.p["V_b"]
        z += self.p["v"]
        z -= z.max(axis=-1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=-1, keepdims=True)
        return z

    def _gates(self, d: str) -> tuple[np.ndarray, np.ndarray]:
        """The table of bytes and the state's matrix for _run: a row for each gate, signed and scaled for exp."""
        scale = np.repeat(np.array([-1, -1, -2], np.float32), STATE)[:, None]
        table = (self.p["E"] @ self.p[f"W_{d}"] + self.p[f"c_{d}"]).T
        return np.ascontiguousarray(table * scale), np.ascontiguousarray(self.p[f"U_{d}"].T * scale)

    def _run(self, codes: np.ndarray, mask: np.ndarray | None, d: str, each) -> None:
        """Reads codes and calls each(t, state) after each step. As _states, but with a row for each gate and state."""
        table, u = self._gates(d)
        s, n = STATE, codes.shape[1]
        h, x, g, q = (np.zeros((k * s, n), np.float32) for k in (1, 3, 3, 1))
        for t in range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1):
            np.take(table, codes[t], axis=1, out=x, mode="clip")
            np.matmul(u, h, out=g)
            zr = x[: 2 * s]
            zr += g[: 2 * s]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(g[2 * s :], zr[s:], out=q)
            q += x[2 * s :]
            np.exp(q, out=q)
            q += 1
            np.divide(2, q, out=q)
            q -= 1  # tanh
            h -= q
            h *= zr[:s]
            h += q
            if mask is not None:
                h *= mask[t]
            each(t, h)

    def windows(self, codes: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """For each window (a column of codes), the sum of the probabilities of its positions."""
        v_f, v_b, v = np.ascontiguousarray(self.p["V_f"].T), np.ascontiguousarray(self.p["V_b"].T), self.p["v"][:, None]
        ahead = np.empty((len(codes), len(v), codes.shape[1]), np.float32)
        total = np.zeros((len(v), codes.shape[1]), np.float32)

        def forward(t, h):
            np.matmul(v_f, h, out=ahead[t])

        def backward(t, h):
            z = v_b @ h
            z += ahead[t]
            z += v
            z -= z.max(axis=0)
            np.exp(z, out=z)
            z /= z.sum(axis=0)
            if mask is not None:
                z *= mask[t]
            np.add(total, z, out=total)

        self._run(codes, mask, "f", forward)
        self._run(codes, mask, "b", backward)
        return total.T.astype(np.float64)

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text in data, cut at offsets, the mean probabilities of its positions; zeros for an empty text."""
        lengths = np.diff(offsets)
        out = np.zeros((len(lengths), max(1, len(self.languages))))
        whole = lengths // WINDOW
        text = np.repeat(np.arange(len(lengths)), whole)
        starts = np.repeat(offsets[:-1], whole) + WINDOW * (np.arange(int(whole.sum())) - np.repeat(np.cumsum(whole) - whole, whole))
        for lo in range(0, len(starts), AT_ONCE):
            some = starts[lo : lo + AT_ONCE]
            np.add.at(out, text[lo : lo + AT_ONCE], self.windows(data[np.arange(WINDOW)[:, None] + some], None))
        rest = np.flatnonzero(lengths % WINDOW)
        for lo in range(0, len(rest), AT_ONCE):
            some = rest[lo : lo + AT_ONCE]
            begin, size = offsets[some] + WINDOW * whole[some], lengths[some] % WINDOW
            at = np.arange(int(size.max()))[:, None]
            mask = at < size
            codes = np.where(mask, data[np.minimum(begin + at, len(data) - 1)], _PAD)
            out[some] += self.windows(codes, mask.astype(np.float32))
        return out / np.maximum(lengths, 1)[:, None]

    def gradients(self, codes: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of all positions, by backpropagation through time. codes: (positions, windows)."""
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        forward, kept_f = self._states(codes, "f", mask, keep=True)
        backward, kept_b = self._states(codes[::-1], "b", mask[::-1], keep=True)
        dz = self._probabilities(forward[1:], backward[:0:-1])
        dz[:, np.arange(len(labels)), labels] -= 1
        dz *= (mask / mask.sum())[:, :, None]
        g["v"] = dz.sum(axis=(0, 1))
        s = STATE
        for d, states, kept, order in (("f", forward, kept_f, 1), ("b", backward, kept_b, -1)):
            dzd, codes_d, mask_d = dz[::order], codes[::order], mask[::order]
            g[f"V_{d}"] = np.tensordot(states[1:], dzd, ((0, 1), (0, 1)))
            into = dzd @ self.p[f"V_{d}"].T
            u, w = self.p[f"U_{d}"], self.p[f"W_{d}"]
            embedded = self.p["E"]
            dh = np.zeros_like(states[0])
            gates = np.zeros((len(codes), len(labels), 3 * s), np.float32)
            for t in range(len(codes) - 1, -1, -1):
                h, (zr, n, candidate) = states[t], kept[t]
                z, r = zr[:, :s], zr[:, s:]
                dh = (dh + into[t]) * mask_d[t][:, None]
                dn = dh * (1 - z) * (1 - n * n)
                dzg = dh * (h - n) * z * (1 - z)
                drg = dn * candidate * r * (1 - r)
                gates[t] = np.concatenate([dzg, drg, dn], axis=1)
                through = np.concatenate([dzg, drg, dn * r], axis=1)
                g[f"U_{d}"] += h.T @ through
                dh = dh * z + through @ u.T
            flat = gates.reshape(-1, 3 * s)
            g[f"c_{d}"] = flat.sum(axis=0)
            g[f"W_{d}"] = embedded[codes_d.ravel()].T @ flat
            back = flat @ w.T
            g["E"] += np.stack([np.bincount(codes_d.ravel(), back[:, e], 257) for e in range(EMBEDDING)], axis=1).astype(np.float32)
        return g


def trained(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = SEED) -> Network:
    """A network fitted to non-empty texts and their languages; each language is drawn as often as any other."""
    languages = sorted(set(labels))
    network, r = Network(languages, seed), np.random.default_rng(seed)
    if len(languages) < 2:
        return network
    data = [np.frombuffer(t, np.uint8) for t in texts]
    known = np.array([languages.index(x) for x in labels])
    of = [np.flatnonzero(known == i) for i in range(len(languages))]
    m = {k: np.zeros_like(v) for k, v in network.p.items()}
    v = {k: np.zeros_like(x) for k, x in network.p.items()}
    for step in range(1, steps + 1):
        y = r.integers(0, len(languages), BATCH)
        codes, mask = np.full((WINDOW, BATCH), _PAD, np.int64), np.zeros((WINDOW, BATCH), np.float32)
        for i, label in enumerate(y):
            own = data[r.choice(of[label])]
            # most windows are whole; some are as short as the ends of texts are
            size = min(len(own), WINDOW if r.random() < 0.8 else int(r.integers(4, WINDOW)))
            at = int(r.integers(0, len(own) - size + 1))
            codes[:size, i], mask[:size, i] = own[at : at + size], 1
        rate = RATE * min(1.0, step / 30) * (1 - 0.95 * step / steps)
        for k, g in network.gradients(codes, mask, y).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            network.p[k] = (network.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return network


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sampled(rows: DataFrame, size: int) -> DataFrame:
    """At most `size` of rows (doc_id, text, lang), the first of each language by a hash of the id (column `turn`): all
    languages have the same part of `size`, and of more than `size` languages the most frequent ones have a row each.

    Rows whose hash is far from the first ones of their language are left out before any are put in order.
    """
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(size).collect()
    part = size // max(1, len(counts))
    # so many are expected below a language's bound that fewer than wanted are out of the question
    enough = 2 * part + 40
    bounds = [(r["lang"], None if r["rows"] <= enough else -(1 << 63) + (1 << 64) * enough // r["rows"]) for r in counts]
    bounds = rows.sparkSession.createDataFrame(bounds, "lang string, bound long")
    near = rows.withColumn("turn", F.xxhash64("doc_id", F.lit(SEED))).join(F.broadcast(bounds), "lang").where("bound is null or turn < bound").drop("bound")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "doc_id", "text"))
    return near.withColumn("place", place).where(F.col("place") <= part).drop("place")


def fit(documents: DataFrame, sample: int = SAMPLE) -> Network:
    """A network from rows that have a language and text and are not held out: at most `sample` of them."""
    rows = documents.where("lang is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    rows = _sampled(rows.where(~held_out(F.col("doc_id"))), sample).withColumn("text", held(F.col("text"), SEED))

    def fit_rows(found):
        found.sort(key=lambda row: (row["turn"], row["doc_id"] is None, row["doc_id"] or 0, row["lang"], row["text"]))
        return trained([row["text"].encode() for row in found], [row["lang"] for row in found])

    return fitted(rows, fit_rows)


def _labeller(shared):
    def label(batches):
        import pyarrow as pa

        network = shared.value
        for whole in batches:
            for batch in pieces(whole):
                data, offsets, _ = slices(batch.column(1))
                p = network.pooled(data, offsets)
                best = p.argmax(axis=1)
                names = [network.languages[i] if network.languages else "und" for i in best.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.clip(p[np.arange(len(p)), best], 0, 1))], ["row", "lang_pred", "score"])

    return label


def labelled(documents: DataFrame, network: Network) -> DataFrame:
    """documents as struct `row`, with lang_pred and score; a null text, or one without a letter, is und with score 0."""
    has_letter = F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False))
    rows = documents.select(F.struct(F.struct("*").alias("own"), has_letter.alias("has_letter")).alias("row"), F.when(has_letter, F.col("text")).otherwise(F.lit("")).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(network)
    out = mapped(rows, _labeller(shared), T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    letter = F.col("row.has_letter")
    return out.select(F.col("row.own").alias("row"), F.when(letter, F.col("lang_pred")).otherwise(F.lit("und")).alias("lang_pred"), F.when(letter, F.col("score")).otherwise(F.lit(0.0)).alias("score"))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of documents. Without any language to learn, all are und, as null texts
    and those without a letter always are; repeated rows have a row each. Further columns, of any names, are ignored."""
    out = labelled(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(documents))
    return out.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
