"""Archives: exact round trips, revisits, and damage that the reader must see."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from oracle import connection, same
from sessionloom.llm import common, warc

SCHEMA = "page_id long, url string, html string"


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/archives"


def test_round_trip(spark, folder, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rows = [(i, f"http://h/{i}" if i % 7 else None, "<p>été " + " ".join(str(i * k % 97) for k in range(i % 50)) + "</p>\r\n\r\n") for i in range(400)]
    rows += [(1000, "u\r\nInjected: x", "a\x00b\r\n\r\nWARC/1.1\r\n"), (1001, "", ""), (1002, None, None), (1003, "long", "z" * 300_000), (-5, "neg", "neg")]
    warc.warc_written(spark.createDataFrame(rows, SCHEMA).repartition(3), folder)
    files = spark.read.format("binaryFile").load(folder)
    heads = [bytes(r[0]) for r in files.select(F.substring("content", 1, 4)).collect()]
    assert len(heads) > 5 and warc.DICTIONARY in heads
    got = warc.warc_records(spark, folder).collect()
    assert all(r["fault"] is None for r in got) and len({(r["archive"], r["position"]) for r in got}) == len(rows)
    by_id = {int(r["record_id"].rpartition(":")[2]): r for r in got}
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for i, u, h in rows:
        r, b = by_id[i], (h or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), digest(b))
        if first[h or ""] == i:
            assert (r["record_type"], r["payload"], r["refers_to"]) == ("response", b, None)
        else:
            assert (r["record_type"], r["payload"], r["refers_to"]) == ("revisit", None, f"urn:x-record:{first[h or '']}")
        assert r["target_uri"] == (u.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20") if u is not None else None)


def test_ties_nulls_and_small_payloads(spark, folder):
    rows = [(1, "a", "x"), (1, "a", "x"), (3, "b", "x"), (None, None, "x"), (None, "n", "y"), (None, "n", "y"), (9, "s", "tiny"), (8, "s", "tiny"), (7, "e", "")]
    warc.warc_written(spark.createDataFrame(rows, SCHEMA), folder)
    got = sorted((str(r["record_id"]), r["record_type"], str(r["refers_to"])) for r in warc.warc_records(spark, folder).collect())
    one, none = "urn:x-record:1", "urn:x-null:"
    assert got == sorted([(one, "response", "None"), (one, "revisit", one), ("urn:x-record:3", "revisit", one), (none, "revisit", one), (none, "response", "None"), (none, "revisit", none), ("urn:x-record:8", "response", "None"), ("urn:x-record:9", "revisit", "urn:x-record:8"), ("urn:x-record:7", "response", "None")])
    warc.warc_written(spark.createDataFrame(rows, SCHEMA), folder + "2", min_revisit_bytes=2)
    kinds = {(r["record_id"], r["record_type"]) for r in warc.warc_records(spark, folder + "2").collect()}
    assert ("urn:x-record:3", "response") in kinds and ("urn:x-record:9", "revisit") in kinds


def test_empty_table(spark, folder):
    warc.warc_written(spark.createDataFrame([], SCHEMA), folder)
    assert warc.warc_records(spark, folder).count() == 0


def test_clashing_names(spark, folder):
    df = spark.createDataFrame([(1, "u", "x", 5), (2, "u", "x", 6)], "_key long, _first string, payload string, id int")
    warc.warc_written(df, folder, id_col="_key", uri_col="_first", payload_col="payload")
    assert {(r["record_type"], r["refers_to"]) for r in warc.warc_records(spark, folder).collect()} == {("response", None), ("revisit", "urn:x-record:1")}


def good(payload=b"some payload, some payload", kind="response"):
    sha = hashlib.sha1(payload).hexdigest()
    return warc.record(kind, "urn:x-record:1", "http://h/", payload, sha, "urn:x-record:0" if kind == "revisit" else None, "2024-01-01T00:00:00Z")


def read(data):
    out = []
    for _, got, fault in warc.frames(data):
        if fault is None:
            try:
                warc.parsed(got)
            except ValueError as e:
                fault = str(e)
        out.append(fault)
    return out


def test_damage_is_seen():
    import zstandard

    records = [good(b"payload %d " % i * 20) for i in range(200)]
    whole = warc.archive(records, 3)
    assert whole[:4] == warc.DICTIONARY and read(whole) == [None] * 200
    assert read(whole + warc.EMPTY_FRAME.encode()) == [None] * 200
    plain = zstandard.ZstdCompressor().compress
    assert [got for _, got, _ in warc.frames(whole)] == records
    assert read(b"") == []
    assert read(whole[:-3])[-1] == "frame cut off"
    assert len(read(b"junk" + whole)) == 1 and read(whole + b"ju")[-1].startswith("neither")
    bad = bytearray(whole)
    bad[8 + int.from_bytes(whole[4:8], "little") + 25] ^= 0xFF
    assert any(read(bytes(bad)))
    size = int.from_bytes(whole[4:8], "little")
    assert all(x is not None for x in read(whole[8 + size :]))  # without its dictionary
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(whole[8 : 8 + size])
    assert read(warc.DICTIONARY + len(raw).to_bytes(4, "little") + raw + whole[8 + size :]) == [None] * 200  # a dictionary that isn't compressed
    for change, said in [((b"WARC/1.1", b"HTTP/1.1"), "no WARC header"), ((b"WARC-Date", b"WARC-Data"), "no warc-date"), ((b"sha1:", b"sha1:A"), "payload digest"), ((b"\r\nContent-Type: app", b"\r\n: app"), "a header line without a name"), ((b"some payload, some", b"some payload some"), "content-length isn't the block's"), ((b"utf-8\r\nContent-Length: 2", b"utf-8\r\nContent-Length: 3"), "HTTP content-length isn't the payload's")]:
        assert read(plain(good().replace(*change))) == [said]
    stream = zstandard.ZstdCompressor(write_content_size=False, write_checksum=True).compressobj()
    assert read(stream.compress(good()) + stream.flush() + plain(good(kind="revisit"))) == [None, None]


def test_whole_table(spark, sf):
    got = warc.op12_warc(spark, sf)
    assert got.count() == common.table(spark, sf, "pages").count()
    same(got, connection(sf).sql(warc.OP12_SQL))
