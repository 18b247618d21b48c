import base64
import hashlib
import re
import struct

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import warc


def frames(path):
    """The dictionary and the records of a file, each unpacked by itself."""
    raw = open(path, "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    words, rest, out = raw[8 : 8 + size], raw[8 + size :], []
    kind = zstandard.DICT_TYPE_FULLDICT if words[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words, dict_type=kind)).decompressobj()
        out.append(one.decompress(rest))
        rest = one.unused_data
    return words, out


def write(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS sha", "'x' AS main", "'x' AS revisit", "'x' AS same")
    manifest = warc.write_warc(df, **options)
    return manifest, warc.read_warc(spark, manifest).collect()


def test_records_are_frames_of_their_own(spark):
    rows = [(i, f"http://a/{i}", f"<html><p>page {i % 7}</p>{'body text ' * (i % 50)}{i * 7919}</html>") for i in range(3000)]
    manifest, got = write(spark, rows)
    count = 0
    for r in manifest.collect():
        words, records = frames(r["path"].removeprefix("file://"))
        assert len(records) == r["records"] and len(words) > 1000 and all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in records)
        count += len(records)
    assert count == 3000 == len(got)
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in got} == {i: h for i, _, h in rows}


def test_trained_dictionary_helps():
    records = [warc.record(i, f"http://a/{i}", f"<html>{'lorem ipsum ' * 9}{i * 31}</html>".encode(), None, False) for i in range(2000)]
    words = warc.build_dictionary(records)
    assert words.dict_id() >= 32768
    plain, better = zstandard.ZstdCompressor(), zstandard.ZstdCompressor(dict_data=words)
    assert sum(len(better.compress(r)) for r in records) < 0.7 * sum(len(plain.compress(r)) for r in records)


@pytest.mark.parametrize("payloads", [[b""], [b""] * 63, [b"a" * 100_000], [b"x"] * 2, [bytes(range(256)) * 40] * 5, [b"one", b"two"], [b"\x00" * 5_000_000], [b"same page"] * 1000])
def test_dictionaries_of_few_records_are_in_the_format(payloads):
    records = [warc.record(i, None, p, None, False) for i, p in enumerate(payloads)]
    words = warc.build_dictionary(records)
    assert words.as_bytes()[:4] == b"\x37\xa4\x30\xec" and words.dict_id() >= 32768
    for r in records:
        assert zstandard.ZstdDecompressor(dict_data=words).decompress(zstandard.ZstdCompressor(dict_data=words).compress(r)) == r


def test_record_ids_are_unique(spark):
    rows = [(1, "http://a", "same"), (1, "http://a", "same"), (1, "http://b", "other"), (None, None, "x"), (None, None, "x"), (2, "http://c", "same")]
    manifest, got = write(spark, rows)
    ids = [re.search(rb"WARC-Record-ID: (\S+)", x)[1] for r in manifest.collect() for x in frames(r["path"].removeprefix("file://"))[1]]
    assert len(set(ids)) == len(rows) and b"<urn:x-page:2>" in ids
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got) == [(0, "response", 0)] * 2 + [(1, "response", 0)] + [(1, "revisit", 2)] * 2 + [(2, "response", 0)]


def test_revisits(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (9, "http://c", "same"), (3, "u", None), (4, "u", ""), (5, None, "own é"), (None, "u", "same"), (6, "a b\r\nWARC-Type: x", "line"), (9, "http://c", "same")]
    _, got = write(spark, rows)
    assert len(got) == len(rows)
    by = {(r["page_id"], r["url"]): r for r in got}
    for i, kind, refers in ((1, "revisit", 9), (2, "revisit", 9), (9, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "revisit", 9), (6, "response", None)):
        own = [r for r in got if r["page_id"] == i]
        assert all((r["record_type"], r["refers_to"]) == (kind, refers) for r in own) and own
    want = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        data = want[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert by[6, "a%20b%0D%0AWARC-Type:%20x"]["payload"] == b"line" and (5, None) in by


def test_small_payloads_are_never_revisits(spark):
    _, got = write(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], least_revisit_bytes=3)
    assert {r["page_id"]: r["record_type"] for r in got} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_long_pages_and_several_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 16)
    rows = [(i, "u", chr(97 + i % 26) * (200_000 if i == 3 else 9000) + str(i)) for i in range(60)]
    got = write(spark, rows)[1]
    assert {r["page_id"]: len(r["payload"]) for r in got} == {i: len(h) for i, _, h in rows}


def test_empty_table(spark):
    manifest, got = write(spark, [])
    assert got == [] and manifest.count() == 0


def test_damage_is_found(spark):
    manifest, _ = write(spark, [(1, "u", "payload " * 50)])
    path = manifest.first()["path"].removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[-6] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception):  # noqa: B017
        warc.read_warc(spark, manifest).collect()


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=200), st.one_of(st.none(), st.text(max_size=20)))
def test_record_bytes(payload, url):
    data = warc.record(7, url, payload, None, False)
    head, _, rest = data.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])["Content-Length"])
    assert rest[length:] == b"\r\n\r\n" and rest[:length].endswith(payload)
