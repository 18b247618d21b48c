"""Documents packed into fixed windows by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, bounded, pieces, spread
from .tokens import encoder

#: Ids that a task holds before it packs them; bounds its memory, and windows of so many waste next to nothing.
HELD_IDS = 1 << 22
#: Pieces of a batch that a task gives back: at most 2 MB of ids at the usual window.
GIVEN = 256


class Capacities:
    """A segment tree over remaining capacities 0..most; each leaf lists the open windows that have so much room left."""

    def __init__(self, most: int) -> None:
        self.base = 1 << most.bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        at = self.base + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The (room, window) of the tightest open window with room for `need`, taken out; None if there is none."""
        at, count = self.base + need, self.count
        while not count[at]:  # climb to the first subtree to the right that has a window
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.base:
            at *= 2
            at += not count[at]
        room = at - self.base
        window = self.open[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, window


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """(window, offset) of each length of at most `size`, longest first into the tightest open window, and the windows' number."""
    rooms, windows, offsets, used = Capacities(size), [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if n == size or (found := rooms.take(n)) is None:
            found, used = (size, used), used + 1
        room, windows[i] = found
        offsets[i] = size - room
        if room > n:
            rooms.put(room - n, windows[i])
    return windows, offsets, used


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int, remembered: int | None) -> Iterator[pa.RecordBatch]:
    end, first = np.array([end_id], np.uint32), TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    count = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal first, held, count
        windows, offsets, used = best_fit([len(x[3]) for x in held], size)
        for a in range(0, len(held), GIVEN):
            ids, starts, totals, parts = zip(*held[a : a + GIVEN])
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) for x in parts], pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array(totals, pa.int64()), pa.array([first + w for w in windows[a : a + GIVEN]], pa.int64()), pa.array(offsets[a : a + GIVEN], pa.int64())],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
        first, held, count = first + used, [], 0

    for batch in pieces(batches, "text", 2 * CHUNK_BYTES, "tokens"):
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(path, remembered).encode([t or "" for t in batch.column("text").to_pylist()])):
            ids = np.concatenate((ids, end))
            held.extend((doc_id, k, len(ids), ids[k : k + size]) for k in range(0, len(ids), size))
            count += len(ids)
            if count >= HELD_IDS:
                yield from flush()
    if held:
        yield from flush()


def pack(docs: DataFrame, path: str, end_id: int = 1, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", remembered: int | None = None) -> DataFrame:
    """Pieces of the documents' ids, packed: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    A document's ids are those of its text, then end_id. One longer than `size` is cut into full windows and a rest;
    rests and short documents are packed longest first, each into the open window with the least room that holds it.
    A task packs what it reads, HELD_IDS at a time, so nothing is shuffled; sequence ids are unique, with gaps between
    tasks; offsets in a sequence have no gaps. ids are little-endian unsigned 32-bit integers. A null or empty text is
    end_id alone; a null doc_id stays null; rows that repeat a document are packed as often. An empty table gives no piece.
    `remembered`: words whose ids a worker keeps, which bounds its memory (tokens.REMEMBERED if not given).
    """
    bounded(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return spread(docs).mapInArrow(partial(_pack, path=path, end_id=end_id, size=size, remembered=remembered), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
