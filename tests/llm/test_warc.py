import base64
import gzip
import hashlib
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docquarry.llm import bloom, common, warc

PAGES = [(5, "http://a/5", "<p>one</p>"), (3, "http://a/3", "<p>one</p>"), (9, None, "<p>one</p>"), (1, "http://b\r\nX-Evil: 1", "\r\n\r\nWARC/1.1\r\n\r\n"), (2, "u", None), (4, "u", ""), (7, "ü", "é中" * 100), (None, "n", "<p>one</p>"), (None, "n", "alone"), (3, "http://a/3b", "<p>one</p>"), (8, "z", "x" * 3_000_000)]
KIND = "page_id long, url string, html string"


def brute(pages):
    out, seen = [], {}
    for page, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0, p[1] or "~")):
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = digest not in seen
        seen.setdefault(digest, page)
        out.append((page, len(raw), digest, "response" if first else "revisit", None if first else seen[digest]))
    return sorted(out, key=repr)


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, KIND)
    assert sorted((tuple(r) for r in warc.archived(df).collect()), key=repr) == brute(PAGES)
    clash = df.withColumns({n: F.lit(1) for n in ("digest", "bytes", "page", "first", "copy", "record_id")})
    assert sorted((tuple(r) for r in warc.archived(clash).collect()), key=repr) == brute(PAGES)
    assert warc.archived(df.where("false")).collect() == []


def test_archives(spark, tmp_path):
    warc.write(spark.createDataFrame(PAGES, KIND), str(tmp_path / "w"))
    found = [record for f in Path(tmp_path, "w").rglob("*.gz") for record in warc.records(f.read_bytes())]
    assert len(found) == len(PAGES)
    ids = {h["WARC-Record-ID"] for h, _ in found}
    assert len(ids) == len(found) and all(re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", i) for i in ids)
    for headers, block in found:
        assert headers["WARC-Date"] and headers["Content-Type"].startswith("application/http") and "X-Evil" not in headers
        if headers["WARC-Type"] == "revisit":
            assert headers["WARC-Refers-To"] in ids and headers["WARC-Profile"].endswith("identical-payload-digest") and block.endswith(b"\r\n\r\n")
    payloads = {h["WARC-Page-ID"]: b.split(b"\r\n\r\n", 1)[1] for h, b in found if h["WARC-Type"] == "response" and "WARC-Page-ID" in h}
    assert payloads["1"] == PAGES[3][2].encode() and payloads["7"] == PAGES[6][2].encode() and len(payloads["8"]) == 3_000_000


def test_small_payloads_may_stay_responses(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], KIND), str(tmp_path / "w"), least_bytes=3)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_one_payload_on_most_pages(spark, tmp_path, monkeypatch):
    """An empty page on most rows, also without a page_id and copied: spread over files, and every row has its record."""
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    monkeypatch.setattr(common, "COPIES", 32)
    monkeypatch.setattr(warc, "ARCHIVE_REVISITS", 40)
    pages = [(i * 7 % 1000 + 1, f"u{i}", "") for i in range(300)] + [(None, f"n{i % 5}", None) for i in range(200)] + [(5, "same", "x")] * 150 + [(i + 2000, None, f"p{i % 250}") for i in range(400)]
    df = spark.createDataFrame(pages, KIND).repartition(4)
    assert sorted((tuple(r) for r in warc.archived(df).collect()), key=repr) == brute(pages)
    warc.write(df, str(tmp_path / "w"))
    files = [list(warc.records(f.read_bytes())) for f in Path(tmp_path, "w").rglob("*.gz")]
    assert len({h["WARC-Record-ID"] for own in files for h, _ in own}) == len(pages)
    revisits = [sum(h["WARC-Type"] == "revisit" for h, _ in own) for own in files]
    assert max(revisits) <= 40


def test_filter_that_passes_all(spark, monkeypatch):
    """A filter that takes every payload for a repeated one; none gets lost."""
    monkeypatch.setattr(bloom, "marked", lambda rows, key, keys, most_blocks=1, out="_perhaps": rows.withColumn(out, key.isNotNull()))
    pages = [(i, f"u{i % 3}", f"p{i % 70}") for i in range(100)]
    assert sorted((tuple(r) for r in warc.archived(spark.createDataFrame(pages, KIND)).collect()), key=repr) == brute(pages)


def test_broken_archives():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert list(warc.records(gzip.compress(good) + gzip.compress(good * 2))) == [({"Content-Length": "2"}, b"ab")] * 3
    assert list(warc.records(b"")) == []
    for bad in (good[:-1], good[:12], good[:30], b"WAR/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.records(gzip.compress(bad)))
