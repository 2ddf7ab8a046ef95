"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over every window of a text.

Words are what is left of a text between ASCII characters other than digits and letters, with A-Z lower-cased. A window
is WINDOW consecutive words of one benchmark item; a shorter item is one window. A word of a document inside any
occurrence of a window is hit. Windows are looked up by a 64-bit hash first and then verified word by word.

The hash set is a few flat arrays: sorted hashes, where each window stands in the benchmark's words, and its items. The
benchmark is broadcast in blocks of at most BLOCK_BYTES of text, so what is sent has a fixed bound however large the
benchmark is. With several blocks, each but the last leaves a small table of hits only; texts are never written between.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import mapped, pieces, texts, written

WINDOW = 13
#: Benchmark text that one scan looks for; an item is not cut, so one item may be larger.
BLOCK_BYTES = 32 << 20
#: A document with hits is contaminated if at least one word in LEAST_SHARE is hit.
LEAST_SHARE = 20

_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_RUN = re.compile(rb"[^ ]+")
_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
#: Bits of the table that most windows of a document fail at, for each window of the benchmark.
_TABLE_BITS = 8


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def _word_hashes(some: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, some), np.uint64, len(some))


def _window_hashes(hashed: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of so many words."""
    n = len(hashed) - length + 1
    out = np.full(max(0, n), length, np.uint64)
    for i in range(length if n > 0 else 0):
        out += hashed[i : n + i] * _MULTIPLIERS[i % 64] * np.uint64(2 * (i // 64) + 1)
    out ^= out >> np.uint64(32)
    return out


class Windows:
    """The windows of benchmark items (item_id or None, text), ready to be looked up; those of a null item_id name no item.

    However many items have the same words, and however often an item repeats a window, a look-up meets it once."""

    def __init__(self, items, window: int = WINDOW):
        known: dict[bytes, list[str]] = {}  # items of the same words are one: the words, and the ids of the items
        hashes, starts, ends, owners, lengths = [], [], [], [], []
        at = 0
        for item, text in items:
            own = words(text)
            length = min(window, len(own))
            if not length:
                continue
            phrase = b" ".join(own)
            if phrase not in known:
                ends_at = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
                found = _window_hashes(_word_hashes(own), length)
                hashes.append(found)
                starts.append(at + np.concatenate([[0], ends_at[:-1]])[: len(found)])
                ends.append(at + ends_at[length - 1 :] - 1)
                lengths.append(np.full(len(found), length, np.int16 if window < 1 << 15 else np.int32))
                owners.append(np.full(len(found), len(known), np.int32))
                at += int(ends_at[-1])
            ids = known.setdefault(phrase, [])
            if item is not None:
                ids.append(str(item))
        none = np.zeros(0, np.int64)
        self.text = b" ".join(known)
        self.ids, self.of = list(chain.from_iterable(known.values())), np.cumsum([0, *map(len, known.values())])
        hashes = np.concatenate([none.astype(np.uint64), *hashes])
        order = np.argsort(hashes, kind="stable")
        take = lambda parts, kind: np.concatenate([none, *parts])[order].astype(kind)
        place = np.uint32 if at < 1 << 32 else np.uint64
        self.hashes, self.starts, self.ends, self.owners = hashes[order], take(starts, place), take(ends, place), take(owners, np.int32)
        # a window that an item repeats is looked up once
        again = np.flatnonzero((self.hashes[1:] == self.hashes[:-1]) & (self.owners[1:] == self.owners[:-1])) + 1
        again = [k for k in again.tolist() if self._phrase(k) == self._phrase(k - 1)]
        for name in ("hashes", "starts", "ends", "owners"):
            setattr(self, name, np.delete(getattr(self, name), again))
        self.lengths = sorted({int(n[0]) for n in lengths})
        bits = 10
        while 1 << bits < len(self.hashes) * _TABLE_BITS:
            bits += 1
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.hashes >> self.shift] = True

    def scan(self, found: list[list[bytes]]) -> dict[int, tuple[np.ndarray, set[str]]]:
        """For the places of texts (lists of words) with hits: which words are hit, and the items whose windows occur."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes)
        hashed = _word_hashes(list(chain.from_iterable(found)))
        out: dict[int, tuple[np.ndarray, set[int]]] = {}
        for length in self.lengths:
            looked = _window_hashes(hashed, length)
            at = np.flatnonzero(self.table[looked >> self.shift])
            if not len(at):
                continue
            first = np.searchsorted(self.hashes, looked[at])
            sure = self.hashes[np.minimum(first, len(self.hashes) - 1)] == looked[at]
            own = np.searchsorted(ends, at[sure], "right")
            inside = at[sure] + length <= ends[own]  # not reaching into the next text
            for i, k, doc in zip(at[sure][inside].tolist(), first[sure][inside].tolist(), own[inside].tolist(), strict=True):
                begin = i - int(ends[doc] - sizes[doc])
                self._verified(found[doc], begin, length, k, doc, out)
        return {doc: (hit, {i for own in owners for i in self.ids[self.of[own] : self.of[own + 1]]}) for doc, (hit, owners) in out.items()}

    def _phrase(self, k: int) -> bytes:
        return self.text[int(self.starts[k]) : int(self.ends[k])]

    def _verified(self, own: list[bytes], begin: int, length: int, k: int, doc: int, out: dict) -> None:
        """Marks the words from `begin` on, if they are those of a window whose hash stands at k or behind it."""
        phrase, hit, looked = b" ".join(own[begin : begin + length]), False, self.hashes[k]
        while k < len(self.hashes) and self.hashes[k] == looked:
            if self._phrase(k) == phrase:
                hit = True
                if doc not in out:
                    out[doc] = (np.zeros(len(own), bool), set())
                out[doc][1].add(int(self.owners[k]))
            k += 1
        if hit:
            out[doc][0][begin : begin + length] = True


def _runs(hit: np.ndarray) -> list[int]:
    """First and one past the last word of each run of hit words, flat."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()


def cut(text: bytes, spans: list[int]) -> bytes:
    """text without the runs of words in spans, and without what stands between the words of a run."""
    at = [m.span() for m in _RUN.finditer(text.translate(_WORD_BYTES))]
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def _scanner(windows, cutting: bool = False, only_hits: bool = False):
    """Over batches of (row, text, spans, items so far): (row, text, n_words, spans, items)."""

    def scan(batches):
        import pyarrow as pa

        known = windows.value
        for whole in batches:
            for batch in pieces(whole):
                raw = texts(batch.column(1))
                found = [words(t) for t in raw]
                hits = known.scan(found)
                spans, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                for doc in sorted({*hits, *(i for i, s in enumerate(spans) if s)}):
                    hit, own = hits.get(doc) or (np.zeros(len(found[doc]), bool), set())
                    for a, b in zip(spans[doc][::2], spans[doc][1::2], strict=True):
                        hit[a:b] = True
                    spans[doc], items[doc] = _runs(hit), sorted(own.union(items[doc]))
                text = batch.column(1)
                if cutting and any(spans):
                    text = pa.array([t if t is None else cut(t, s) if s else t for t, s in zip(raw, spans, strict=True)], pa.binary()).cast(pa.string())
                if not cutting:
                    text = pa.nulls(len(raw), pa.string())
                out = [batch.column(0), text, pa.array(list(map(len, found)), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays(out, ["_row", "_text", "_n_words", "_spans", "_items"])
                yield out.take(pa.array(sorted(hits), pa.int64())) if only_hits else out

    return scan


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The items (item_id as text, or None; text as bytes) in parts of about block_bytes at most, one part at a time."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(total // block_bytes) + 1
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).select("item_id", F.encode("text", "utf-8").alias("text"))
        yield part == parts - 1, ((row["item_id"], bytes(row["text"])) for row in some.toLocalIterator())


_FOUND = [T.StructField("_spans", T.ArrayType(T.LongType())), T.StructField("_items", T.ArrayType(T.StringType()))]


def _scanned(rows: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, cutting: bool) -> DataFrame:
    """rows (_row, _text) with _n_words, _spans and _items; _text without the hit words if cutting, else null."""
    spark = rows.sparkSession
    none = {f.name: F.expr(f"cast(array() as {f.dataType.simpleString()})") for f in _FOUND}
    kind = lambda row: T.StructType([T.StructField("_row", row), T.StructField("_text", T.StringType()), T.StructField("_n_words", T.LongType()), *_FOUND])
    # what is found in a text follows from the text, whose hash stands for it between blocks
    key = F.struct(F.xxhash64("_text").alias("p"), F.xxhash64(F.lit("q"), "_text").alias("q"))
    earlier = None
    for last, items in _blocks(benchmark, block_bytes):
        windows = spark.sparkContext.broadcast(Windows(items, window))
        if last:
            break
        hits = rows.select(key.alias("_row"), "_text").withColumns(none)
        hits = mapped(hits, _scanner(windows, only_hits=True), kind(T.StructType.fromDDL("p long, q long")))
        hits = written(hits.select("_row", "_spans", "_items").dropDuplicates(["_row"]))
        earlier = hits if earlier is None else earlier.union(hits)
        windows.unpersist()
    if earlier is None:
        given = rows.withColumns(none)
    else:
        runs = F.collect_list("_spans").alias("_runs")
        merged = earlier.groupBy(F.col("_row").alias("_key")).agg(runs, F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))
        # a word is hit if a run of any block has it; runs may overlap, for each is marked on its own
        merged = written(merged.select("_key", F.flatten("_runs").alias("_spans"), "_items"))
        keyed = bloom.marked(rows.withColumn("_key", key), F.struct("_key.*"), merged.select("_key"))
        clean, others = keyed.where("not _perhaps"), keyed.where("_perhaps")
        given = clean.select("_row", "_text").withColumns(none).union(others.join(merged, "_key", "left").select("_row", "_text", *[F.coalesce(n, e).alias(n) for n, e in none.items()]))
    return mapped(given, _scanner(windows, cutting), kind(rows.schema["_row"].dataType))


def scan(documents: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, columns: list[str] | None = None) -> DataFrame:
    """documents (or those of their columns named) as struct `row`, with n_words, spans (first and one past the last word of
    each hit run, flat) and items (their ids as text).

    A null text has no words. Benchmark rows without text or words find nothing; those without item_id hit words as others
    do, but are not among the items. Columns of documents may have any names, for they stay inside `row`. An empty benchmark hits nothing.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in (documents.columns if columns is None else columns)])
    out = _scanned(documents.select(row.alias("_row"), F.col(text).alias("_text")), benchmark, window, block_bytes, False)
    return out.select(F.col("_row").alias("row"), F.col("_n_words").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def _n_hit(spans: Column) -> Column:
    """The sum of (last - first) over runs: odd places count up, even ones down."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (LEAST_SHARE * n_hit >= n_words)


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of documents; nulls as scan() has them."""
    found = scan(documents, benchmark, columns=["doc_id"]).withColumn("n_hit", _n_hit(F.col("spans")))
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), _contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def cleaned(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without the contaminated ones, and without the hit words of the others; n_chars follows the text.

    Null texts and texts without hits stay as they are, repeated rows each, and so do all other columns, of any names.
    """
    others = [c for c in documents.columns if c != "text"]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col("text").alias("_text"))
    found = _scanned(rows, benchmark, WINDOW, BLOCK_BYTES, True)
    found = found.where(~_contaminated(_n_hit(F.col("_spans")), F.col("_n_words")))
    of = {c: F.col(f"_row.`{c}`") for c in others} | {"text": F.col("_text")}
    if "n_chars" in of:
        of["n_chars"] = F.when(F.size("_spans") > 0, F.length("_text").cast(documents.schema["n_chars"].dataType)).otherwise(of["n_chars"])
    return found.select(*[of[c].alias(c) for c in documents.columns])
