"""Dictionary-compressed WARC files (.warc.zst).

A file is a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built from the file's own first records,
then a Zstandard frame with that dictionary for each record, so that any record can be read by itself.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_files, make_dir, new_path, open_in, open_out, pieces, written

# Fixed values of the format.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records, and bytes of them, of which a file's dictionary is built; both are held until then.
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 1000, 4 << 20, 64 << 10
#: Bytes of records after which a task begins another file.
FILE_BYTES = 256 << 20
_UNSAFE = re.compile("[\\x00-\\x20\\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(ident: int | None, place: str = "") -> str:
    return f"<urn:x-page:{'' if ident is None else ident}{':' + place if place else ''}>"


def record(ident: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, place: str = "") -> bytes:
    """The bytes of a response, or of a revisit, whose HTTP head still states the payload's length.

    `place` makes the record's id unique where the page's is not; the page's stands in a field of its own.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(ident, place)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if ident is not None:
        head.append(f"WARC-Page-ID: {ident}")
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary in Zstandard's format, trained on the records, whatever their number and size.

    Few or short records are cut into pieces, and the pieces repeated, until there is enough to train on; the dictionary is
    then smaller.
    """
    ident = int.from_bytes(hashlib.sha1(records[0]).digest()[:3], "big") + 32768
    total = sum(map(len, records))
    for size in (DICT_BYTES, 16 << 10, 4 << 10, 1 << 10):
        for cut, times in ((0, 1), (256, 1), (64, 1), (64, 1 + 8192 // max(1, total)), (16, 1 + 65536 // max(1, total))):
            pieces_of = [r[k : k + cut] for r in records for k in range(0, len(r), cut)] if cut else records
            pieces_of = pieces_of * times
            if len(pieces_of) < 16 or sum(map(len, pieces_of)) < 8 * size:
                continue
            try:
                return zstandard.train_dictionary(size, pieces_of, k=256 if size > 4096 else 64, d=8, dict_id=ident)
            except zstandard.ZstdError:  # too little, or too alike
                continue
    raise ValueError("no dictionary can be trained on these records")


class Writer:
    def __init__(self, uri: str, level: int) -> None:
        self.uri, self.level, self.held, self.size, self.count, self.out = uri, level, [], 0, 0, None

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.count += 1
        if self.out is None:
            self.held.append(data)
            if len(self.held) >= SAMPLE_RECORDS or self.size >= SAMPLE_BYTES:
                self._begin()
        else:
            self.out.write(self.pack.compress(data))

    def _begin(self) -> None:
        words = build_dictionary(self.held)
        words.precompute_compress(level=self.level)
        self.pack = zstandard.ZstdCompressor(level=self.level, dict_data=words)
        self.out = open_out(self.uri)
        raw = words.as_bytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        for data in self.held:
            self.out.write(self.pack.compress(data))
        self.held = []

    def close(self) -> tuple[str, int]:
        if self.out is None:
            self._begin()
        self.out.close()
        return self.uri, self.count


def read_file(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file, one at a time."""
    with open_in(uri) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{uri} does not begin with a dictionary")
        raw = f.read(size)
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT))
        with io.BufferedReader(unpack.stream_reader(f, read_across_frames=True), 1 << 20) as lines:
            while lines.readline():
                head = {}
                while (line := lines.readline()) not in (b"\r\n", b""):
                    name, _, value = line.decode().partition(":")
                    head[name.strip()] = value.strip()
                block = lines.read(int(head["Content-Length"]))
                if lines.read(4) != b"\r\n\r\n":
                    raise ValueError(f"{uri}: a record ends too early")
                yield head, block


def _write(batches: Iterator[pa.RecordBatch], root: str, level: int) -> Iterator[pa.RecordBatch]:
    part, done, out = TaskContext.get().partitionId(), [], None
    for batch in pieces(batches, "html"):
        for ident, url, html, revisit, refers, unique in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "revisit", "refers_to", "unique"))):
            out = out or Writer(f"{root}/{part:08d}-{len(done):04d}-{uuid.uuid4().hex}.warc.zst", level)
            out.add(record(ident, url, (html or "").encode(), refers, revisit, "" if unique else f"{part}-{len(done)}-{out.count}"))
            if out.size >= FILE_BYTES:
                done.append(out.close())
                out = None
    if out:
        done.append(out.close())
    if done:
        yield pa.record_batch([pa.array(x) for x in zip(*done)], ["path", "records"])


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit_bytes: int = 0, level: int = 3) -> DataFrame:
    """Writes a record for each row and returns the files' manifest (path, records).

    Of rows with equal payloads of least_revisit_bytes or more, those with the largest id are responses and the others
    revisits of it; so is a row without id if any other has one. The payload is the html in UTF-8, empty for null. Equal
    payloads meet as their digests alone: groups are counted before the shuffle, and the table of groups of two and more
    is joined, by broadcast where it is small. Each task writes what it reads; a file of a failed or repeated task is not
    in the manifest. A record's id is that of its page, with the record's place where several rows have that id or it is
    null; without url, a record has no target. Other columns are left out. An empty table gives an empty manifest.
    """
    pages = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.withColumn("sha", F.sha1(payload))
    known = pages.where(F.octet_length(payload) >= least_revisit_bytes).select(F.col("sha").alias("same"), "page_id")
    groups = written(known.groupBy("same").agg(F.max("page_id").alias("main"), F.count("*").alias("rows")).where("rows > 1").select("same", "main"), "groups")
    root = new_path(pages.sparkSession, "warc")
    make_dir(root)
    twice = written(pages.groupBy(F.col("page_id").alias("again")).agg(F.count("*").alias("rows")).where("rows > 1 AND again IS NOT NULL").select("again"), "twice")
    if twice.limit(1).count():
        pages = pages.join(twice, F.col("page_id") == F.col("again"), "left").withColumn("unique", F.col("page_id").isNotNull() & F.col("again").isNull())
    else:
        pages = pages.withColumn("unique", F.col("page_id").isNotNull())
    revisit = F.col("main").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("main"))
    rows = pages.join(groups, F.col("sha") == F.col("same"), "left").select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("main")).alias("refers_to"), "unique")
    return written(rows.mapInArrow(partial(_write, root=root, level=level), "path string, records long"), "manifest")


def _ident(uri: str | None) -> int | None:
    text = (uri or "")[len("<urn:x-page:") : -1]
    return int(text) if text else None


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows, held = [], 0
            for head, block in read_file(path):
                http, _, body = block.partition(b"\r\n\r\n")
                length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                stated, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                if kind == "response" and (len(body) != length or digest(body) != stated):
                    raise ValueError(f"{path}: {head['WARC-Record-ID']} is damaged")
                page = head.get("WARC-Page-ID")
                rows.append((int(page) if page else None, head.get("WARC-Target-URI"), length, stated, kind, _ident(head.get("WARC-Refers-To")), body if with_payload and kind == "response" else None))
                held += len(body) * with_payload + 200
                if held > 4 << 20:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)


def read_warc(spark: SparkSession, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each record; digests of responses are computed anew and must agree.

    page_id and url are null where a record has none, payload for a revisit; an empty manifest gives no record.
    """
    files = [(r["path"],) for r in manifest.select("path").collect()]  # a row a file
    return dealt_files(spark, files, "path string").mapInArrow(partial(_read, with_payload=with_payload), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
