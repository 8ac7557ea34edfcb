import hashlib
import random

import pytest

from rankspark.llm import warc


def _write_read(spark, tmp_path, rows, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    path = f"file://{tmp_path}/warc"
    warc.write_archives(df, path, **kw)
    return path, warc.read_archives(spark, path).collect()


def _expected(rows):
    first = {}
    for k, _, html, _ in rows:
        b = (html or "").encode()
        if k is not None and len(b) >= 100:
            first[b] = min(first.get(b, k), k)
    out = []
    for k, _, html, _ in rows:
        b = (html or "").encode()
        to = first.get(b)
        to = None if to == k else to
        out.append((k, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    rnd = random.Random(1)
    big = "".join(rnd.choice("abcé中 \r\n") for _ in range(30_000))
    tricky = "x" * 90 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nWARC/1.1\r\n0\r\n\r\n"
    rows = [(1, "http://a/ b\r\nc", big, "clash"), (2, None, big, "c"), (3, "u", None, None), (4, "u", "", None),
            (5, "u", "short", None), (6, "u", "short", None), (7, "u", tricky, None), (9, "u", tricky * 200, None),
            (8, "u", tricky * 200, None), (None, "u", tricky, None), (10, "u", "y" * 100, None), (10, "u", "y" * 100, None),
            (11, "u", "z" * 99, None), (12, "u", "z" * 99, None), (None, "u", "w" * 200, None)]
    _, got = _write_read(spark, tmp_path, rows, segment_bytes=1000, chunk_bytes=64, records_per_file=5)
    assert sorted([(r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == _expected(rows)
    stored = {r.payload for r in got if r.record_type == "response"}
    assert {(r[2] or "").encode() for r in rows} == {bytes(p) for p in stored}
    assert all(r.valid for r in got)


def test_segments_follow_the_format(spark, tmp_path):
    path, _ = _write_read(spark, tmp_path, [(1, "u", "q" * 5000, None)], segment_bytes=1000)
    rec = sorted(warc.read_records(spark, path).collect(), key=lambda r: r.segment_number)
    assert [r.record_type for r in rec] == ["response"] + ["continuation"] * (len(rec) - 1) and len(rec) > 4
    assert {r.origin_id for r in rec[1:]} == {rec[0].record_id}
    assert [r.total_length for r in rec[:-1]] == [None] * (len(rec) - 1)
    assert rec[-1].total_length == sum(len(r.block) for r in rec)


def test_broken_archives_raise():
    record = {"record_id": "r", "record_type": "response", "key": 1, "refers_to": None, "uri": None,
              "digest": hashlib.sha256(b"abc").hexdigest()}
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abc", 2)
    parts = [(1, block[:20]), (2, block[20:])]
    assert warc.decode_message(record, parts, len(block), True, True)["payload"] == b"abc"
    for bad, total in ((parts[:1] + [(3, block[20:])], len(block)), (parts, len(block) + 1), (parts[1:], len(block)),
                       ([(1, block[:20]), (2, block[20:-8])], len(block) - 8)):
        with pytest.raises(ValueError):
            warc.decode_message(record, bad, total, True, True)
        assert not warc.decode_message(record, bad, total, True, False)["valid"]
    with pytest.raises(ValueError):
        list(warc.parse_pieces(iter([b"", b"WARC-Type: x\r\nContent-Length: 9\r\n\r\nabc"])))


def test_empty_table(spark, tmp_path):
    assert _write_read(spark, tmp_path, [])[1] == []
