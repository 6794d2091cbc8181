"""Archives: exact round trip and roles against plain Python."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

from moodloom.llm import warc


def expected(rows):
    bodies = [(p, (h or "").encode()) for p, _, h in rows]
    first = {}
    for p, b in bodies:
        first[b] = min(p, first.get(b, p))
    done, out = set(), []
    for p, b in bodies:
        new = p == first[b] and b not in done
        if new:
            done.add(b)
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if new else "revisit", None if new else first[b]))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    big = "<p>ü" * 900_000
    rows = [(5, "http://a", "x"), (3, "http://b", "x"), (4, None, None), (9, "u", ""), (7, "http://c\r\nX: y", big), (8, "z", big), (3, "http://b", "x"),
            (1, "q", "WARC/1.1\r\n\r\n\r\nWARC/1.1"), (2, "r", "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.round_trip(pages, str(tmp_path / "archives")).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_chunks_of_an_oversized_record():
    body = bytes(range(256)) * 100
    digest = hashlib.sha1(body).digest()
    head = warc._head(1, "u", digest.hex(), "response", None, len(body))
    raw = gzip.compress(head + body + b"\r\n\r\n") + gzip.compress(warc._head(2, "u", digest.hex(), "revisit", 1, len(body)) + b"\r\n\r\n")
    rows = list(warc.records(io.BytesIO(raw), 1000))
    assert b"".join(r["chunk"] for r in rows[:-1]) == body and [r["chunk_no"] for r in rows[:-1]] == list(range(26))
    assert [r["last"] for r in rows] == [False] * 25 + [True, True]
    assert rows[-2]["digest_so_far"] == rows[-2]["payload_digest"] and rows[-1]["refers_to"] == 1
    assert rows[3]["digest_so_far"] == warc.sha1_base32(hashlib.sha1(body[:4000]).digest())


def test_small_payloads_are_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages, str(tmp_path / "a"), least=3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages, str(tmp_path / "a")).count() == 0
