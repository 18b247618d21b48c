"""Token ids as compressed bit or byte planes with a chunk index.

A file is MAGIC, then chunks, then an index, then a 16-byte tail (the index's offset as an unsigned little-endian 64-bit
integer, MAGIC). A chunk holds at most BLOCK ids: for each plane, lowest first, a zstandard frame. A bit plane has bit k
of every id, eight ids a byte, first id in the highest bit; a byte plane has byte k of every id. High planes that are all
zero are left out. The index is a zstandard frame of: kind (1 bit, 8 byte planes), the chunks' number and, for each, ids,
offset, planes and each plane's length; then the documents' number, their ids, a byte each that is 0 for a null id, and
their lengths. All integers there are little-endian 64-bit ones.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, dealt_files, make_dir, new_path, open_in, open_out, pieces, written
from .tokens import encoder

MAGIC = b"TSLPLAN1"
#: Ids of a chunk.
BLOCK = 1 << 16
#: Ids after which a task begins another file.
FILE_IDS = 1 << 26


def to_planes(ids: np.ndarray, kind: int, level: int = 1) -> list[bytes]:
    """The zstandard frames of a block's planes."""
    ids = np.ascontiguousarray(ids, "<u4")
    pack = zstandard.ZstdCompressor(level=level).compress
    bits = int(ids.max(initial=0)).bit_length()
    if kind == 8:
        rows = ids.view(np.uint8).reshape(-1, 4)
        return [pack(rows[:, k].tobytes()) for k in range((bits + 7) // 8)]
    return [pack(np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes()) for k in range(bits)]


def from_planes(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    unpack, ids = zstandard.ZstdDecompressor().decompress, np.zeros(n, np.uint32)
    for k, frame in enumerate(planes):
        raw = np.frombuffer(unpack(frame), np.uint8)
        ids |= (raw if kind == 8 else np.unpackbits(raw, count=n)).astype(np.uint32) << np.uint32(k * (8 if kind == 8 else 1))
    return ids


class Writer:
    """Writes one file; add() takes a document's id (or None) and its token ids."""

    def __init__(self, uri: str, kind: int) -> None:
        self.uri, self.kind, self.out = uri, kind, open_out(uri)
        self.out.write(MAGIC)
        self.at, self.held, self.waiting, self.total = len(MAGIC), [], 0, 0
        self.chunks: list[list[int]] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        every = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(every) if last else len(every) // BLOCK * BLOCK
        for a in range(0, end, BLOCK):
            block = every[a : min(a + BLOCK, end)]
            planes = to_planes(block, self.kind)
            self.chunks.append([len(block), self.at, len(planes), *map(len, planes)])
            for frame in planes:
                self.out.write(frame)
                self.at += len(frame)
        self.held, self.waiting = [every[end:]], len(every) - end

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        index = np.array([self.kind, len(self.chunks), *(x for c in self.chunks for x in c), len(self.docs), *(x or 0 for x in self.docs), *(x is not None for x in self.docs), *self.sizes], "<i8")
        self.out.write(zstandard.ZstdCompressor(level=3).compress(index.tobytes()))
        self.out.write(struct.pack("<Q", self.at) + MAGIC)
        self.out.close()
        return self.uri, self.total, len(self.docs)


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc id, token ids) of each document of a file, holding a document and a chunk at a time."""
    with open_in(uri) as f:
        size = f.size()
        f.seek(size - 16)
        tail = f.read(16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} has no index of this format")
        start = struct.unpack("<Q", tail[:8])[0]
        f.seek(start)
        index = np.frombuffer(zstandard.ZstdDecompressor().decompress(f.read(size - 16 - start)), "<i8")
        kind, count, at, chunks = int(index[0]), int(index[1]), 2, []
        for _ in range(count):
            planes = int(index[at + 2])
            chunks.append((int(index[at]), int(index[at + 1]), index[at + 3 : at + 3 + planes].tolist()))
            at += 3 + planes
        n = int(index[at])
        docs, there, sizes = index[at + 1 : at + 1 + n], index[at + 1 + n : at + 1 + 2 * n], index[at + 1 + 2 * n :]
        blocks, held, have = iter(chunks), [], 0
        for k in range(n):
            need = int(sizes[k])
            while have < need:
                ids, offset, lengths = next(blocks)
                f.seek(offset)
                held.append(from_planes([f.read(x) for x in lengths], ids, kind))
                have += ids
            every = np.concatenate(held) if len(held) != 1 else held[0]
            yield int(docs[k]) if there[k] else None, every[:need]
            held, have = [every[need:]], have - need


def _write(batches: Iterator[pa.RecordBatch], root: str, path: str, end_id: int, kind: int) -> Iterator[pa.RecordBatch]:
    part, done, out = TaskContext.get().partitionId(), [], None
    end = np.array([end_id], np.uint32)
    for batch in pieces(batches, "text", 2 * CHUNK_BYTES, "tokens"):
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(path).encode([t or "" for t in batch.column("text").to_pylist()])):
            if out is None:
                out = Writer(f"{root}/{part:08d}-{len(done):04d}-{uuid.uuid4().hex}.planes", kind)
            out.add(doc_id, np.concatenate((ids, end)))
            if out.total >= FILE_IDS:
                done.append(out.close())
                out = None
    if out is not None:
        done.append(out.close())
    if done:
        yield pa.record_batch([pa.array([part] * len(done), pa.int32()), pa.array(range(len(done)), pa.int32()), *(pa.array(x) for x in zip(*done))], ["part", "seq", "path", "ids", "docs"])


def write_ids(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", kind: str = "bit") -> DataFrame:
    """Encodes each text, appends end_id and writes the ids in ascending order of document id; returns the files' manifest.

    Manifest: part, seq (the files' order), path, ids, docs. Each range of ids is written by one task as files of about
    FILE_IDS ids; a file of a task that failed or ran twice is not in the manifest. A null text is empty: its ids are
    end_id alone. Rows without id come first; rows that repeat an id stand in the order of their texts. An empty table
    gives an empty manifest.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    root = new_path(docs.sparkSession, "planes")
    make_dir(root)
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(partial(_write, root=root, path=path, end_id=end_id, kind=8 if kind == "byte" else 1), "part int, seq int, path string, ids long, docs long")
    return written(files, "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            rows: list[tuple] = []
            held = 0
            for doc_id, ids in read_file(path):
                rows.append((doc_id, start, len(ids), ids.tobytes()))
                start += len(ids)
                held += len(ids)
                if held > 1 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "start", "n_tokens", "ids"])


def read_ids(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document of the manifest's files; ids are little-endian unsigned 32-bit integers, start counts all ids before."""
    rows, at = [], 0
    for f in manifest.orderBy("part", "seq").collect():  # a row a file
        rows.append((f["path"], at))
        at += f["ids"]
    return dealt_files(spark, rows, "path string, start long").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
