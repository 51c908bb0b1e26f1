"""WARC archives: writing captures, reading records, assembling transactions.

A capture is a response, or a revisit of an earlier response with the same
payload, with a request and a metadata record that name it in WARC-Concurrent-To.
Reading parses records one by one by their Content-Length and joins the three by
that identifier into one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._shared import materialise, new_path, prepare

#: Captures and payload bytes in one archive file at most (one larger payload is a
#: file of its own), which bounds what one reading task holds.
CAPTURES_PER_FILE, BYTES_PER_FILE = 500, 64 << 20
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a string's UTF-8 or of binary data."""
    digest = F.sha1(data.cast("binary"))
    letters = []
    for part in range(8):
        bits = F.conv(F.substring(digest, 5 * part + 1, 5), 16, 10).cast("int")
        letters += [
            F.substring(F.lit(_BASE32), F.shiftright(bits, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in range(4)
        ]
    return F.concat(*letters)


def _urn(name: Column) -> Column:
    code = F.md5(name)
    parts = [F.substring(code, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[Column], block: Column) -> Column:
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *headers, length), F.lit(_END), block)


def _line(name: str, value: Column | str) -> Column:
    """A header line; null, and so left out, if the value is."""
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value)


def plan_captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages' page_id, url and html with payload, digest, size, record_id and
    refers_to. Of captures with equal payloads of min_bytes or more the one with
    the largest page_id (null is smallest) is the response that the others refer
    to; refers_to is null for responses. Rows that repeat that page_id and payload
    are responses too."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    # the url of one row of the chosen page names the response's record
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.octet_length("payload"))
    identity = F.struct("page_id", "url")
    # only contents that repeat are joined: mostly few and small rows, so payloads stay
    # where they are; where they are many, both sides are plain shuffles, and a content
    # that very many pages share can be split
    chosen = materialise(
        rows.where(F.col("size") >= min_bytes).groupBy("digest", "size")
        .agg(F.max(identity).alias("chosen"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )

    def record_id(page: Column, url: Column) -> Column:
        return _urn(F.concat_ws("\x1f", F.lit("response"), F.coalesce(page.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), "digest"))

    joined = rows.join(chosen, ["digest", "size"], "left")
    other = F.col("chosen").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chosen.page_id"))
    return joined.select(
        "page_id", "url", "payload", "digest", "size",
        record_id(F.col("page_id"), F.col("url")).alias("record_id"),
        F.when(other, record_id(F.col("chosen.page_id"), F.col("chosen.url"))).alias("refers_to"),
    )


def write_captures(
    captures: DataFrame, path: str, date: str = DATE, captures_per_file: int = CAPTURES_PER_FILE, largest: int | None = None
) -> None:
    """Write the records of plan_captures as gzipped WARC/1.1 files in folders under
    path, one folder for each range of payload sizes that occurs: the larger the
    payloads, the fewer to a file. largest is the largest payload's bytes, if known."""
    tops, top = [], max(1, BYTES_PER_FILE // captures_per_file)
    while top < BYTES_PER_FILE:
        tops.append(top)
        top *= 8
    ranges = [(low, high, max(1, BYTES_PER_FILE // high)) for low, high in zip([-1, *tops], tops)] + [((tops or [-1])[-1], None, 1)]
    if largest is None:
        largest = captures.agg(F.max("size")).first()[0]
    for at, (low, high, most) in enumerate(ranges):
        some = captures.where(F.col("size") > low) if high is None else captures.where((F.col("size") > low) & (F.col("size") <= high))
        if at == 0 or (largest is not None and largest > low):
            _write(some, f"{path}/size{at}", date, captures_per_file if at == 0 else min(captures_per_file, most))


def _write(captures: DataFrame, path: str, date: str, captures_per_file: int) -> None:
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")
    rest = F.regexp_extract(uri, r"^[^:/?#]*://[^/?#]*([^#]*)", 1)
    target = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    host = F.coalesce(F.regexp_extract(uri, r"^[^:/?#]*://([^/?#]*)", 1), F.lit(""))
    own = F.col("record_id")
    common = [_line("WARC-Date", date), _line("WARC-Target-URI", uri)]
    revisits = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"), F.lit(_END),
    )
    main = _record(
        [
            _line("WARC-Type", F.when(revisits, "revisit").otherwise("response")), _line("WARC-Record-ID", own), *common,
            _line("WARC-Refers-To", F.col("refers_to")), F.when(revisits, F.lit(f"WARC-Profile: {_PROFILE}")),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            _line("Content-Type", "application/http;msgtype=response"),
        ],
        F.when(revisits, http).otherwise(F.concat(http, F.col("payload"))),
    )
    request = _record(
        [
            _line("WARC-Type", "request"), _line("WARC-Record-ID", _urn(F.concat_ws("\x1f", F.lit("request"), own))), *common,
            _line("WARC-Concurrent-To", own), _line("Content-Type", "application/http;msgtype=request"),
        ],
        F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(_END)),
    )
    metadata = _record(
        [
            _line("WARC-Type", "metadata"), _line("WARC-Record-ID", _urn(F.concat_ws("\x1f", F.lit("metadata"), own))), *common,
            _line("WARC-Concurrent-To", own), _line("Content-Type", "application/warc-fields"),
        ],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")),
    )
    # the text writer ends every record with CRLF CRLF, as the format wants
    captures.select(F.explode(F.array(main, request, metadata)).alias("record")).write.option("lineSep", _END).option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", str(3 * captures_per_file)).text(path)


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
_RECORDS = (
    "type string, record_id string, concurrent_to string, refers_to string, target_uri string, digest string, "
    "http_headers string, payload_bytes bigint, payload_digest string, payload binary"
)


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of an archive's (unpacked) bytes."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        headers = {k.strip().lower(): v.strip() for k, v in _HEADER.findall(data[data.index(b"\r\n", at) : end])}
        start = end + 4
        at = start + int(headers[b"content-length"])
        if at > len(data):
            raise ValueError("an archive ends inside a record")
        block = data[start:at]
        yield {"headers": headers, "block": block}


def unpack(data: bytes) -> bytes:
    """Plain bytes of an archive file, gzipped as a whole or record by record, or not at all."""
    parts = []
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        parts.append(one.decompress(data) + one.flush())
        data = one.unused_data
    return b"".join(parts) + data if parts else data


def _row(record: dict, with_payload: bool) -> tuple:
    headers, block = record["headers"], record["block"]
    text = lambda name: headers[name].decode("utf-8", "replace") if name in headers else None
    kind, http, payload, size = text(b"warc-type"), None, block, len(block)
    if headers.get(b"content-type", b"").startswith(b"application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http, size = head.decode("utf-8", "replace"), len(payload)
    digest = text(b"warc-payload-digest")
    if kind == "revisit":
        told = re.search(r"(?im)^content-length:\s*(\d+)", http or "")
        size, found = int(told[1]) if told else None, (digest or "").rpartition(":")[2] or None
    else:
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest and digest.startswith("sha1:") and digest[5:] != found:
            raise ValueError(f"{text(b'warc-record-id')}: the payload does not have its digest")
    kept = payload if with_payload or kind == "metadata" else None
    return (
        kind, text(b"warc-record-id"), text(b"warc-concurrent-to"), text(b"warc-refers-to"), text(b"warc-target-uri"),
        digest, http, size, found, kept,
    )


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all archive files under path. A task holds one file,
    which Spark's reader limits to 2 GB; write_captures keeps well below that."""
    prepare(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in _RECORDS.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for record in parse_records(unpack(content.as_py())):
                    rows.append(_row(record, with_payload))
                    held += len(record["block"])
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(parse, _RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, type, target_uri, refers_to,
    payload_bytes, payload_digest, payload, and the structs request and metadata
    of the records concurrent to it (null if there are none; one of several)."""
    side = lambda kind: (
        records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        .groupBy(F.col("concurrent_to").alias("record_id"))
        .agg(F.min(F.struct(F.col("record_id").alias("id"), "http_headers", F.col("payload").cast("string").alias("fields"))).alias(kind))
    )
    captures = records.where(F.col("type").isin("response", "revisit"))
    return captures.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left").select(
        "record_id", "type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload", "request", "metadata"
    )


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as archives, read them back, and return per
    page: page_id, payload_bytes, payload_digest, record_type, refers_to (the
    response's page_id for revisits).

    The archives go to path, by default a new folder in the shared folder. Null
    html is an empty payload, a null url gives records without a target, a null
    page_id is carried along and counts as smallest. Repeated rows each give a
    row, and so do equal payloads of any number; a very long payload has a file of
    its own. An empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    prepare(spark)
    path = path or new_path(spark)
    largest = pages.agg(F.coalesce(F.max(F.octet_length("html")), F.lit(0))).first()[0]
    write_captures(plan_captures(pages, min_bytes), path, largest=largest)
    captures = assemble(materialise(read_records(spark, path, with_payload=False)))
    page = F.regexp_extract(F.col("metadata.fields"), r"(?m)^page-id: (-?\d+)", 1)
    named = materialise(
        captures.select("record_id", "type", "refers_to", "payload_bytes", "payload_digest", F.when(page != "", page.cast("bigint")).alias("page_id"))
    )
    target = named.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("page_id").alias("of_page"))
    return named.join(target, "refers_to", "left").select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("of_page").alias("refers_to")
    )
