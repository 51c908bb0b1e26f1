import base64
import gzip
import hashlib

import pytest
from helpers import collect
from quarry.llm import warc as W
from quarry.llm._shared import new_path

KIND = "page_id long, url string, html string, digest int, size int, payload int, record_id int"
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], KIND)


def expected(rows, least=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, other in rows if (other or "") == (html or "")]
        top = max((j for j in same if j is not None), default=None) if len(data) >= least else i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a.com/x?q=1#f", "<p>same</p>"), (2, "http://b.com", "<p>same</p>"), (3, None, None), (4, "bad url\r\nX: y", ""), (5, "http://c.com/é", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"),
    (6, "http://d.com/", "é漢\r\n\r\n" * 1000), (None, "http://e.com/", "only"), (None, "http://f.com/", "<p>same</p>"), (7, "http://g.com/", "x" * 300_000), (8, "http://a.com/x?q=1#f", "a\nb\rc\r\n"),
]


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, least):
    assert collect(W.round_trip(frame(spark, ROWS), min_bytes=least), *COLUMNS) == expected(ROWS, least)


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(W, "BYTES_PER_FILE", 40_000)
    rows = ROWS + [(100 + i, f"http://p{i}.com/", f"{i} " + "y" * (i * i * 20)) for i in range(60)]
    path = new_path(spark)
    assert collect(W.round_trip(frame(spark, rows).coalesce(1), path), *COLUMNS) == expected(rows)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*part-*").load(path).collect()
    for f in files:
        sizes = [r["headers"] for r in W.parse_records(W.unpack(f.content)) if r["headers"][b"warc-type"] == b"response"]
        plain = [int(h[b"content-length"]) - 100 for h in sizes]
        assert len(plain) <= 1 or sum(plain) <= 40_000
    assert len(files) > 10


def test_repeated_rows_and_empty(spark):
    rows = [ROWS[0], ROWS[0], ROWS[1]]
    assert collect(W.round_trip(frame(spark, rows)), *COLUMNS) == expected(rows)
    assert W.round_trip(frame(spark, []).limit(0)).count() == 0


def test_captures_are_nested(spark):
    path = new_path(spark)
    W.write_captures(W.plan_captures(frame(spark, ROWS[:3])), path)
    got = {r.target_uri: r for r in W.assemble(W.read_records(spark, path)).collect()}
    assert got["http://b.com"].payload.decode() == "<p>same</p>" and got["http://a.com/x?q=1#f"].type == "revisit"
    assert got["http://a.com/x?q=1#f"].refers_to == got["http://b.com"].record_id
    assert got["http://b.com"].metadata.fields == "page-id: 2\r\n" and got["http://b.com"].request.http_headers.startswith("GET / HTTP/1.1\r\nHost: b.com")
    assert got["http://a.com/x?q=1#f"].request.http_headers.startswith("GET /x?q=1 HTTP/1.1")


def test_reader_takes_other_archives():
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    other = b"WARC/1.0\r\nwarc-type:response\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbye\r\n\r\n"
    data = W.unpack(gzip.compress(record) + gzip.compress(other))
    found = [W._row(r, True) for r in W.parse_records(data)]
    assert [f[0] for f in found] == ["warcinfo", "response"] and found[1][-1] == b"bye" and W.unpack(record) == record
    with pytest.raises(ValueError):
        list(W.parse_records(record[:-8]))
