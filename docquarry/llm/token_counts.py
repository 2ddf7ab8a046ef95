"""Token counts of byte-level BPE by rank-synchronous merging over ragged numpy arrays.

Texts are cut into pre-tokens by the public byte-level pattern. The distinct pre-tokens that a worker has not met yet are
laid end to end in one array of symbols; each round finds, for every sequence at once, the pair of lowest rank, merges all
its occurrences in that sequence, and looks up only the pairs that changed. When no pair is left anywhere, the symbols
that survive in each sequence are its tokens.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, pieces, texts

# fixed values: the public pre-token pattern of byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same cuts for texts of these characters alone: ASCII and Latin letters, without the separators that pattern engines class differently.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile(rf"[^\x00-\x1b\x20-\x7e{_LETTERS}]")
#: A context of training: documents with more tokens are over it.
LIMIT = 1024
#: Pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: Characters of a text that are cut into pre-tokens at once.
STRETCH = 1 << 20

_NONE = np.iinfo(np.int32).max


def _alphabet() -> dict[str, int]:
    """Character to byte: visible Latin-1 characters stand for their own bytes, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merges of a byte-level BPE file as arrays sorted by pair, with the symbol of each byte."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            content = json.load(f)
        vocabulary, merges = content["model"]["vocab"], content["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.width = 1 + max(vocabulary.values())
        pairs = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        self.bytes = np.zeros(256, np.int32)
        for character, byte in _alphabet().items():
            self.bytes[byte] = vocabulary[character]
        self.special = [x["content"] for x in content["added_tokens"] if x["special"]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.ranks[at], _NONE)

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        """Tokens of each non-empty byte sequence."""
        out = np.array([len(s) for s in sequences], np.int64)
        own = np.arange(len(sequences))
        symbols, lengths = self.bytes[np.frombuffer(b"".join(sequences), np.uint8)], out.copy()
        if not len(symbols):
            return out
        ranks = np.full(len(symbols), _NONE, np.int32)
        ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[np.cumsum(lengths) - 1] = _NONE
        while True:
            lowest = np.minimum.reduceat(ranks, np.cumsum(lengths) - lengths)
            going = lowest < _NONE
            if not going.all():
                out[own[~going]] = lengths[~going]
                stay = np.repeat(going, lengths)
                symbols, ranks, own, lengths, lowest = symbols[stay], ranks[stay], own[going], lengths[going], lowest[going]
            if not len(own):
                return out
            at = np.flatnonzero(ranks == np.repeat(lowest, lengths))
            # of overlapping occurrences (one symbol repeated), every other one from the left
            first = np.concatenate([[True], np.diff(at) != 1])
            start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            symbols[at] = self.merged[ranks[at]]
            ends = np.cumsum(lengths)
            gone = np.bincount(np.searchsorted(ends, at, "right"), minlength=len(lengths))
            # a merged pair ends its sequence if its right symbol did
            last = np.zeros(len(symbols), bool)
            last[ends - 1] = True
            last[at] |= last[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            symbols, ranks, last, lengths = symbols[keep], ranks[keep], last[keep], lengths - gone
            ranks[at] = _NONE
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            changed = np.flatnonzero(changed & ~last)
            ranks[changed] = self.rank(symbols[changed], symbols[changed + 1])


class Counter:
    """Counts the tokens of texts, remembering pre-tokens."""

    def __init__(self, merges: Merges):
        self.merges, self.known = merges, {}
        self.any_script = regex.compile(PATTERN)
        self.cut = regex.compile(r"(?<=\S)\s")

    def stretches(self, text: str):
        """Parts of a long text, cut where white space follows something else: no pre-token spans such a place."""
        start = 0
        while len(text) - start > STRETCH:
            place = self.cut.search(text, start + STRETCH)
            if place is None:
                break
            yield text[start : place.start()]
            start = place.start()
        yield text[start:]

    def find(self, text: str) -> list[str]:
        return (self.any_script if _NOT_PLAIN.search(text) else _PLAIN).findall(text)

    def count(self, batch: list[str]) -> list[int]:
        counts = []
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def settle():
            new = list({t for _, tokens in waiting for t in tokens})
            self.known.update(zip(new, self.merges.counts([t.encode() for t in new]).tolist(), strict=True))
            for i, tokens in waiting:
                counts[i] += sum(map(self.known.__getitem__, tokens))
            waiting.clear()
            if len(self.known) > REMEMBERED:
                self.known.clear()

        for i, text in enumerate(batch):
            counts.append(0)
            parts = [text]
            for special in self.merges.special:
                parts = [p for part in parts for p in part.split(special)]
            counts[i] += len(parts) - 1
            for part in parts:
                for stretch in self.stretches(part):
                    tokens = self.find(stretch)
                    known = list(map(self.known.get, tokens))
                    if None in known:
                        waiting.append((i, [t for t, k in zip(tokens, known, strict=True) if k is None]))
                        known = [k for k in known if k is not None]
                        held += len(stretch)
                    counts[i] += sum(known)
                    if held > 2 * STRETCH:
                        settle()
                        held = 0
        settle()
        return counts


def _counter(shared, limit):
    counters = []

    def count(batches):
        import pyarrow as pa

        if not counters:
            counters.append(Counter(shared.value))
        for whole in batches:
            for batch in pieces(whole):
                raw = [t or b"" for t in texts(batch.column(1))]
                tokens = np.array(counters[0].count([t.decode("utf-8", "replace") for t in raw]), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def count_tokens(documents: DataFrame, file: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of documents (doc_id long, text string).

    A null text counts as empty: no bytes, no tokens. The strings of special tokens count one each, as the library of the
    file takes them by default. The driver reads the file; executors get its arrays (about 1 MB, whatever the input).
    """
    merges = documents.sparkSession.sparkContext.broadcast(Merges(file))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(rows, _counter(merges, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
