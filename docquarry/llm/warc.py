"""WARC archives of pages: equal payloads are written once, all later records of them are revisits.

Headers (page_id, url, digest) are written once and shuffled by payload digest to find the response of each payload. Every
other row becomes a revisit record without payload, with a fresh header that refers to the response. Payloads stay where
they lie: a filter of the digests that occur more than once shows which rows are surely responses, and of the rest only
those move that may be the first of their digest. The archives are gzip files of WARC/1.1 records of bounded size,
written by Spark's own writer to the shared folder, so any file system that Spark knows will do. Reading parses records by
their Content-Length and resolves revisits by a join with the responses they refer to. In both joins by digest or record,
frequent keys are joined by broadcast, so the revisits of an empty page are spread over tasks and files.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import dropped, numbered_copies, scratch, spread_join, written

#: Payload bytes, and revisits, that one archive holds, about.
ARCHIVE_BYTES = 32 << 20
ARCHIVE_REVISITS = 100_000
#: Payloads smaller than this are never revisited.
LEAST_BYTES = 0
#: The date of capture, which pages do not carry.
DATE = "2026-01-01T00:00:00Z"

# fixed values: the names that the WARC standard gives
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_NO_ID = (1 << 63) - 1


def base32(hexadecimal: Column) -> Column:
    """A SHA-1 in hexadecimal as bare upper-case base 32: four times 40 bits, each eight characters."""
    out = []
    for part in range(4):
        bits = F.conv(F.substring(hexadecimal, 10 * part + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(_BASE32), (F.shiftright(bits, shift).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for shift in range(35, -1, -5)]
    return F.concat(*out)


def _record_id(digest: Column, page: Column, url: Column, copy: Column) -> Column:
    key = F.md5(F.concat_ws(":", digest, page.cast("string"), F.coalesce(F.md5(F.encode(url, "utf-8")), F.lit("-")), copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line ends inside a value are percent-encoded."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def _record(kind: str, payload: Column | None) -> Column:
    """A record as text, without its last line feed, which the writer adds."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + (F.col("bytes") if payload is not None else F.lit(0))
    head = [
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.lit(kind)),
        _header("WARC-Record-ID", F.col("record_id")),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        _header("WARC-Page-ID", F.col("page_id").cast("string")),
        _header("WARC-Profile", F.lit(_PROFILE if kind == "revisit" else None).cast("string")),
        _header("WARC-Refers-To", F.col("refers_to") if kind == "revisit" else F.lit(None).cast("string")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
    ]
    return F.concat(*head, payload if payload is not None else F.lit(""), F.lit("\r\n\r"))


def _written_records(records: DataFrame, path: str, most: int) -> None:
    records.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", max(1, most)).text(path)


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Writes a record for each row of pages (page_id long, url string, html string) to archives below path.

    A null html is an empty payload; a null url is left out. Of equal payloads, the row with the smallest page_id is the
    response (rows without page_id come last; of rows that repeat a page_id, the first by url), and all others revisit it;
    those of fewer than least_bytes are all responses. Repeated rows have a record each.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    rows = rows.withColumn("page", F.coalesce("page_id", F.lit(_NO_ID)))
    # rows that agree in all of these are told apart by the number of the copy
    name = ["digest", "page", "page_id", "url", "bytes"]
    headers = written(rows.groupBy(*name).agg(F.count("*").alias("copies")))
    order = F.struct("page", F.col("url").isNull().alias("no_url"), "url")
    firsts = headers.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.sum("copies").alias("all"))
    firsts = written(firsts.select("digest", F.col("first.page").alias("first_page"), F.col("first.url").alias("first_url"), (F.col("all") > 1).alias("several")))
    total, n = headers.agg(F.sum(F.col("bytes") * F.col("copies")), F.sum("copies")).first()
    most = ARCHIVE_BYTES * (n or 1) // max(1, total or 0)

    # a row whose digest surely occurs once is a response where it lies, and so is each payload too small to be revisited
    several = firsts.where("several").select("digest")
    again = bloom.marked(rows, F.when(F.col("bytes") >= least_bytes, F.col("digest")), several, out="_again")
    copy = F.when(F.col("bytes") < least_bytes, F.monotonically_increasing_id()).otherwise(0)
    alone = again.where("not _again").select(*name, "html", copy.alias("copy"))
    # of the others, those that surely aren't the first of their digest go no further; html of equal rows is put together first
    passing = bloom.marked(firsts, F.col("digest"), several, out="_again").where("_again")
    key = lambda page, url: F.concat_ws(":", "digest", page, F.coalesce(F.md5(F.encode(url, "utf-8")), F.lit("-")))
    perhaps = bloom.marked(again.where("_again"), key("page", "url"), passing.select(key("first_page", "first_url")), out="_first").where("_first")
    perhaps = perhaps.groupBy(*name).agg(F.first("html").alias("html"))
    is_first = (F.col("page") == F.col("first_page")) & F.col("url").eqNullSafe(F.col("first_url"))
    moved = perhaps.join(firsts, "digest").where(is_first).select(*name, "html", F.lit(0).cast("long").alias("copy"))
    responses = alone.unionByName(moved).withColumn("record_id", _record_id(F.col("digest"), F.col("page"), F.col("url"), F.col("copy")))
    _written_records(responses.select(_record("response", F.col("html")).alias("value")), f"{path}/responses", most)

    later = spread_join(headers.where(F.col("bytes") >= least_bytes), firsts.where("several").drop("several"), "digest", "inner")
    later = numbered_copies(later.withColumn("is_first", is_first), "copies", "copy").where("not is_first or copy > 0")
    later = later.withColumn("record_id", _record_id(F.col("digest"), F.col("page"), F.col("url"), F.col("copy")))
    later = later.withColumn("refers_to", _record_id(F.col("digest"), F.col("first_page"), F.col("first_url"), F.lit(0)))
    _written_records(later.select(_record("revisit", None).alias("value")), f"{path}/revisits", ARCHIVE_REVISITS)
    dropped(headers)
    dropped(firsts)


def _plain(content: bytes):
    """The decompressed bytes of a gzip file, in pieces of at most 1 MB; it may have many members."""
    while content:
        member = zlib.decompressobj(31)
        piece = member.decompress(content, 1 << 20)
        while piece or member.unconsumed_tail:
            yield piece
            piece = member.decompress(member.unconsumed_tail, 1 << 20)
        content = member.unused_data


def records(content: bytes):
    """(headers, block) of each record of an archive."""
    source, held = _plain(content), bytearray()

    def until(length: int) -> bool:
        while len(held) < length:
            piece = next(source, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        end = held.find(b"\r\n\r\n")
        while end < 0:
            if not until(len(held) + 1):
                if held:
                    raise ValueError("an archive ends inside a record header")
                return
            end = held.find(b"\r\n\r\n")
        lines = bytes(held[:end]).decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        length = end + 4 + int(headers["Content-Length"])
        if not until(length + 4) or held[length : length + 4] != b"\r\n\r\n":
            raise ValueError("an archive ends inside a record")
        yield headers, bytes(held[end + 4 : length])
        del held[: length + 4]


def _parsed(batches):
    import pyarrow as pa

    names = ["page_id", "record_id", "kind", "refers", "bytes", "digest"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for headers, block in records(content.as_py()):
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                own = headers["WARC-Type"] == "response"
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if own else None
                if own and headers["WARC-Payload-Digest"] != f"sha1:{digest}":
                    raise ValueError(f"the payload of {headers['WARC-Record-ID']} does not have its digest")
                page = headers.get("WARC-Page-ID")
                rows.append((None if page is None else int(page), headers["WARC-Record-ID"], headers["WARC-Type"], headers.get("WARC-Refers-To"), len(payload) if own else None, digest))
            for start in range(0, len(rows), 10_000):
                columns = list(zip(*rows[start : start + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record below path, revisits resolved."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = written(found.mapInArrow(_parsed, "page_id long, record_id string, kind string, refers string, bytes long, digest string"))
    responses = found.where("kind = 'response'")
    originals = responses.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("full_bytes"), F.col("digest").alias("full_digest"))
    out = ["page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type")]
    resolved = spread_join(found.where("kind = 'revisit'").select("page_id", "kind", "refers"), originals, "refers")
    return responses.select(*out, F.lit(None).cast("long").alias("refers_to")).union(resolved.select("page_id", "full_bytes", "full_digest", "kind", "refers_to"))


def archived(pages: DataFrame) -> DataFrame:
    """The records of pages, written to archives in the shared folder and read back from them: a row for each row of pages,
    null and repeated ones too, as write() has them. Further columns are ignored."""
    path = scratch(pages.sparkSession)
    write(pages, path)
    return read(pages.sparkSession, path)
