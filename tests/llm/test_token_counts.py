import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docquarry.llm import token_counts

from corpus_fixtures import collected

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def merges():
    return token_counts.Merges(FILE)


def texts():
    r = random.Random(2)
    out = ["", "a", " ", "a" * 100_001, "aaab" * 777, "it's 's don't 'll\n's  x\t\t y ", "<|endoftext|>a <|endoftext|><|endoftext|>", "<|endoftext", "é中文😀 ¡x ² ½ Ⅷ ٣ 　a b  ", "!'s !' s '' 'sun", "x" * 3 + " " * 500 + "y", "\x1c\x1d a\x85b\xa0c", "I'M I'm i'VE"]
    out.append("".join(r.choice("abcdefghij") for _ in range(20_000)))
    alphabet = "ab '\n\tst.,!-09éß中😀²\xa0" + chr(0x300)
    return out + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(400)]


def test_against_the_library(library, merges):
    assert token_counts.Counter(merges).count(texts()) == [len(x.ids) for x in library.encode_batch(texts())]


def test_every_character(library, merges):
    some = [f"a{chr(i)}a {chr(i)} 1{chr(i)}{chr(i)}b" for i in range(0x3000) if not 0xD800 <= i < 0xE000]
    assert token_counts.Counter(merges).count(some) == [len(x.ids) for x in library.encode_batch(some)]


def test_long_texts_are_cut_safely(library, merges, monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 16)
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    assert token_counts.Counter(merges).count(texts()) == [len(x.ids) for x in library.encode_batch(texts())]


def test_operator(documents, rows, nothing, clashing, library):
    want = []
    for i, text, *_ in rows:
        n = len(library.encode(text or "").ids)
        want.append((i, len((text or "").encode()), n, n > 1024))
    assert collected(token_counts.count_tokens(documents, FILE)) == sorted(want, key=repr)
    assert collected(token_counts.count_tokens(clashing, FILE)) == sorted(want, key=repr)
    assert token_counts.count_tokens(nothing, FILE).collect() == []
