import hashlib
import struct
import time

import pytest

from dossier.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first string, frame string"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("archives")


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "a", "b", "c") for i, u, h in rows], SCHEMA)


def test_round_trip(spark, folder):
    long = "<p>ünï 漢字 🙂\r\n\r\nWARC/1.1</p>" * 20_000
    rows = [(k, f"http://e.org/{k % 7}\n{k}", f"<html>{k % 11} " + "x" * (60 if k % 11 < 4 else 200)) for k in range(300)]
    rows += [(1000, None, None), (1001, "u", ""), (1002, "u", long), (999, "u", long), (None, "n", "y" * 300), (None, "n", "y" * 300), (5000, "a", "z" * 150), (5000, "b", "z" * 150)]
    path = str(folder / "whole")
    warc.write_archives(pages(spark, rows), path)
    out = warc.read_archives(spark, path).collect()
    first = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if i is not None and len(raw) >= 100:
            first[raw] = min(first.get(raw, i), i)
    wanted, answered = [], set()
    for i, u, h in rows:
        raw = (h or "").encode()
        again = i is not None and len(raw) >= 100 and (first[raw] < i or (i, raw) in answered)  # of rows that repeat an id and a payload, one is the response
        answered.add((i, raw))
        wanted.append((i, len(raw), hashlib.sha256(raw).hexdigest(), first[raw] if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in out), key=repr) == sorted(wanted, key=repr)
    assert sorted((repr((r.page_id, r.url)) for r in out)) == sorted(repr((i, u or None)) for i, u, _ in rows)
    assert all(r.fault is None and r.record_type == ("revisit" if r.refers_to is not None else "response") for r in out)
    assert all((r.payload is None) == (r.record_type == "revisit") and (r.payload is None or len(r.payload) == r.payload_bytes) for r in out)


def test_empty(spark, folder):
    warc.write_archives(pages(spark, []), str(folder / "none"))
    assert warc.read_archives(spark, str(folder / "none")).collect() == []


def archive(records):
    lead, compressor = warc.frames_of(records)
    return lead + b"".join(compressor.compress(r) for r in records)


def test_dictionary_comes_from_the_leading_frame():
    records = [warc.record_of(k, "u", f"<p>{k} of the same page text</p>".encode() * 20, "0", None) for k in range(64)]
    whole = archive(records)
    magic, size = struct.unpack_from("<II", whole)
    assert magic == warc.DICTIONARY_MAGIC and size > 0
    assert [r for r, _ in warc.records_in(whole)] == records
    assert [f for _, f in warc.records_in(whole[:8] + bytes(size) + whole[8 + size :])][:1] != [None]  # without it nothing can be read


def test_faults_are_reported():
    good = warc.record_of(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse_record(good)["fault"] is None
    assert warc.parse_record(good.replace(b"WARC/1.1", b"WARC/9"))["fault"] == "version"
    assert warc.parse_record(good.replace(b"Content-Length: 7", b"Content-Length: 8"))["fault"] == "length"
    assert warc.parse_record(good.replace(b"payload\r\n", b"paXload\r\n"))["fault"] == "digest"
    assert warc.parse_record(good.replace(b"WARC-Date: ", b"WARC-Dote: "))["fault"] == "header WARC-Date missing"
    assert warc.parse_record(good.replace(b"WARC-Type: ", b"WARC-Type "))["fault"] == "header line"
    assert warc.parse_record(b"")["fault"] == "version"
    whole = archive([good] * 3)
    assert [f for _, f in warc.records_in(whole[:-5])][-1] == "frame cut short"
    assert [f for _, f in warc.records_in(whole + b"xyz")][-1] == "trailing bytes"
    assert [f for _, f in warc.records_in(whole + b"123456789")][-1] == "no frame"


def test_time_is_linear_in_records():
    record = warc.record_of(1, "u", b"some page text " * 40, "0", None)
    compressor = warc.frames_of([record])[1]
    spent = []
    for n in (5_000, 20_000):
        whole = compressor.compress(record) * n
        start = time.perf_counter()
        assert sum(r == record for r, _ in warc.records_in(whole)) == n
        spent.append(time.perf_counter() - start)
    assert spent[1] < 12 * spent[0]  # four times the records; the square would be sixteen


def test_frame_ends():
    import zstandard

    for size in (0, 1, 100, 200_000, 400_000):
        for data in (b"a" * size, bytes(range(256)) * (size // 256), hashlib.sha512(b"x").digest() * (size // 64)):
            for checksum in (False, True):
                frame = zstandard.ZstdCompressor(write_checksum=checksum, write_content_size=not checksum).compress(data)
                assert warc.frame_end(memoryview(b"xx" + frame + b"rest"), 2) == len(frame) + 2
                assert warc.frame_end(memoryview(frame[:-1]), 0) is None


def test_archives_from_elsewhere(spark, folder):
    body = b"<p>hello</p>"
    digest = hashlib.sha256(body).hexdigest()

    def record(kind, block, **more):
        lines = ["WARC/1.0", f"warc-type: {kind}", "WARC-RECORD-ID: <urn:uuid:12-34>", "Warc-Date: 2024-01-01T00:00:00Z", *(f"{k.replace('_', '-')}: {v}" for k, v in more.items()), f"content-length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + body
    records = [
        record("warcinfo", b"software: x\r\n"), record("request", b"GET / HTTP/1.1\r\n\r\n", warc_target_uri="<http://e.org/a%20b>"),
        record("response", http, content_type="application/http; msgtype=response", warc_payload_digest=f"sha256:{digest}", warc_target_uri="http://e.org/"),
        record("response", http, content_type="application/http; msgtype=response", warc_payload_digest="sha1:3EF4GCVYOIZTHDFRE4GVPZ2VZF5HXRJY"),
        record("metadata", b"a: b\r\n"), record("revisit", b"", warc_payload_digest=f"sha256:{digest}"), record("response", http, content_type="application/http", warc_payload_digest="sha256:00"),
    ]
    (folder / "other").mkdir()
    (folder / "other" / "crawl-0001.warc.zst").write_bytes(archive(records))
    rows = warc.read_archives(spark, str(folder / "other")).collect()
    assert [(r.record_type, r.fault) for r in rows] == [("warcinfo", None), ("request", None), ("response", None), ("response", None), ("metadata", None), ("revisit", None), ("response", "digest")]
    assert rows[2].payload == body and rows[2].payload_digest == digest and rows[1].url == "http://e.org/a%20b" and {r.record_id for r in rows} == {"<urn:uuid:12-34>"}
    assert warc.read_archives(spark, str(folder / "other"), "*.txt").collect() == []
