"""Chroma fingerprints of audio columns, and alignment of recordings by offset histograms and bit errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import spread, written

#: Samples a second that the filters are laid out for, samples of a frame and between frames.
RATE, FRAME, HOP = 4000, 1024, 256
#: Pitches taken into account, in Hz; below, a semitone is narrower than a band of the transform.
LOWEST, HIGHEST = 220.0, 1760.0
#: Sixteen filters, (kind, first pitch class, pitch classes, frames): each gives two bits. Kinds: 0 the sum of the whole,
#: 1 lower less upper half, 2 earlier less later half, 3 the diagonal quarters less the others, 4 the middle third of the
#: frames less the outer ones, 5 the middle third of the pitch classes less the outer ones.
FILTERS = [(k % 6, (5 * k) % 9, 3 + (k % 2) * 3 if (5 * k) % 9 <= 6 else 3, (4, 8, 12, 16)[k % 4] if k % 6 != 4 else 12) for k in range(16)]
#: A filter's mean response falls into one of four ranges by these bounds; for kind 0 they lie around the mean of a frame.
BOUNDS = np.array([-0.06, 0.0, 0.06])
WIDEST = max(f[3] for f in FILTERS)
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def _classes() -> np.ndarray:
    """The pitch class of each band of a frame's transform, or 12 outside the range."""
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    inside = (hz >= LOWEST) & (hz <= HIGHEST)
    pitch = np.full(len(hz), 12)
    pitch[inside] = np.round(12 * np.log2(hz[inside] / 440.0)).astype(int) % 12
    return pitch


_CLASS = np.eye(13)[_classes()][:, :12]
_WINDOW = np.hanning(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Energy of the twelve pitch classes in each frame, each frame of length one, smoothed over five frames."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, np.float64), FRAME)[::HOP]
    energy = np.abs(np.fft.rfft(frames * _WINDOW, axis=1)) ** 2 @ _CLASS
    soft = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
    pad = np.pad(energy, ((2, 2), (0, 0)), "edge")
    energy = sum(w * pad[k : k + len(energy)] for k, w in enumerate(soft))
    size = np.sqrt((energy * energy).sum(1, keepdims=True))
    return energy / np.where(size > 1e-9, size, np.inf)


def items(image: np.ndarray) -> np.ndarray:
    """A packed unsigned 32-bit integer for each place that the widest filter fits."""
    n = len(image) - WIDEST + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return total[t1 : t1 + n, y1] - total[t0 : t0 + n, y1] - total[t1 : t1 + n, y0] + total[t0 : t0 + n, y0]

    out = np.zeros(n, np.uint32)
    for k, (kind, y, h, w) in enumerate(FILTERS):
        whole, mid, half = area(0, w, y, y + h), y + h // 2, w // 2
        if kind == 0:
            value = whole - 0.25 * w * h
        elif kind == 1:
            value = 2 * area(0, w, y, mid) - whole * (2 * (h // 2) / h)
        elif kind == 2:
            value = 2 * area(0, half, y, y + h) - whole
        elif kind == 3:
            value = 2 * (area(0, half, y, mid) + area(half, w, mid, y + h)) - whole
        elif kind == 4:
            value = 3 * area(w // 3, 2 * w // 3, y, y + h) - whole
        else:
            value = 3 * area(0, w, y + h // 3, y + 2 * h // 3) - whole
        out |= _GRAY[np.searchsorted(BOUNDS, np.round(value / (w * h), 9))] << np.uint32(2 * k)
    return out


def pcm16(value: bytes | None) -> np.ndarray:
    """Samples of mono little-endian 16-bit PCM at RATE; a last odd byte is left out."""
    raw = value or b""
    return np.frombuffer(raw[: len(raw) // 2 * 2], "<i2") / 32768.0


def _fingerprint(batches: Iterator[pa.RecordBatch], decode: Callable) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
            found = [items(chroma(decode(x))).astype(np.int64) for x in batch.column("audio").to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            yield pa.record_batch([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))], ["id", "items"])


def fingerprints(recordings: DataFrame, id_col: str, audio_col: str, decode: Callable = pcm16) -> DataFrame:
    """(id, items) of each recording: `decode` gives the samples of a value of the audio column, at RATE a second.

    Audio that is null, empty or too short for the widest filter has no items. Rows that repeat an id are rows of their own.
    """
    rows = recordings.select(F.col(id_col).cast("long").alias("id"), F.col(audio_col).alias("audio"))
    return spread(rows).mapInArrow(partial(_fingerprint, decode=decode), "id long, items array<long>")


#: Items of classes and of queries that are compared at once in a block; bounds a worker's memory.
BLOCK_CLASSES, BLOCK_QUERIES = 1 << 18, 1 << 15
#: Votes, or overlapping items, that are handled at once.
VOTES = 1 << 20


def _lists(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists and its n + 1 offsets."""
    array = table.column(column).combine_chunks()
    sizes = array.value_lengths().to_numpy(zero_copy_only=False)
    return array.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def _firsts(items: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, rows and places from 0 of the items that don't repeat the one before in their row."""
    first = np.ones(len(items), bool)
    first[1:] = items[1:] != items[:-1]
    first[offs[:-1]] = True
    at = np.flatnonzero(first)
    rows = np.searchsorted(offs, at, "right") - 1
    return items[at], rows, at - offs[rows]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _compared(key: tuple, asked: pa.Table, classes: pa.Table, least_overlap: int, most_error: float, schema: pa.Schema) -> pa.Table:
    """The best class of a block for each of its queries: all of them hold the item `key`; pairs that share a smaller frequent item too are left to that one's block."""
    if not asked.num_rows or not classes.num_rows:
        return schema.empty_table()
    classes = classes.sort_by("c")
    y, y_offs = _lists(classes, "y")
    keys, rows, places = _firsts(y, y_offs)
    order = np.argsort(keys, kind="stable")
    keys, rows, places = keys[order], rows[order], places[order]
    x, x_offs = _lists(asked, "x")
    sizes, span, low, out = np.diff(y_offs), len(x) + len(y), len(x), []
    for j, (q, hot) in enumerate(zip(asked.column("q"), asked.column("hot").to_pylist())):
        own = x[x_offs[j] : x_offs[j + 1]]
        mine, _, at = _firsts(own, np.array([0, len(own)]))
        open_ = pc.fill_null(pc.not_equal(classes.column("c"), q), True)
        open_ = np.array(open_.to_numpy())
        for h in hot:
            if h < key[0].as_py():
                open_[rows[np.searchsorted(keys, h) : np.searchsorted(keys, h, "right")]] = False
        begins = np.searchsorted(keys, mine)
        counts = np.searchsorted(keys, mine, "right") - begins
        codes = np.zeros(0, np.int64)
        ends = np.cumsum(counts)
        start = 0
        while start < len(mine):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + VOTES, "right")))
            met = _spans(begins[start:end], counts[start:end])
            code = rows[met] * span + places[met] - np.repeat(at[start:end], counts[start:end]) + low
            codes = np.unique(np.concatenate((codes, code[open_[rows[met]]])))
            start = end
        row, offset = codes // span, codes % span - low
        skip_x, skip_y = np.maximum(0, -offset), np.maximum(0, offset)
        overlap = np.minimum(len(own) - skip_x, sizes[row] - skip_y)
        wide = overlap >= least_overlap
        row, offset, skip_x, skip_y, overlap = row[wide], offset[wide], skip_x[wide], skip_y[wide], overlap[wide]
        found, ends = [], np.cumsum(overlap)
        start = 0
        while start < len(row):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + VOTES, "right")))
            n = overlap[start:end]
            differ = np.bitwise_count((own[_spans(skip_x[start:end], n)] ^ y[_spans((y_offs[row] + skip_y)[start:end], n)]).view(np.uint64))
            error = np.add.reduceat(differ, np.cumsum(n) - n, dtype=np.int64) / (32.0 * n)
            k = int(np.argmin(error))
            found.append((float(error[k]), start + k))
            start = end
        if found and min(found)[0] <= most_error:
            least, k = min(found)
            out.append((q.as_py(), classes.column("c")[int(row[k])].as_py(), int(offset[k]), int(overlap[k]), least))
    return pa.Table.from_pylist([dict(zip(schema.names, r)) for r in out], schema)


def _by_blocks(left: DataFrame, every: DataFrame, hot: DataFrame, classes: DataFrame, compare: Callable, schema: StructType) -> DataFrame:
    """The matches among pairs that share a frequent item: queries and classes of each such item are dealt into blocks by their items' number, and each block of queries meets each block of classes once."""
    some = left.join(hot, "key").groupBy("q").agg(F.collect_set("key").alias("hot"))
    asked = some.join(classes.select(F.col("class_id").alias("q"), F.col("items").alias("x")), "q").withColumn("key", F.explode("hot"))
    held = every.join(hot.join(left.select("key").distinct(), "key", "left_semi"), "key").select("c", "key").distinct().join(classes.select(F.col("class_id").alias("c"), F.col("items").alias("y")), "c")
    of = lambda df, items, most, name: df.groupBy("key").agg(F.ceil(F.sum(F.size(items)) / most).cast("int").alias(name))
    blocks = written(of(asked, "x", BLOCK_QUERIES, "nq").join(of(held, "y", BLOCK_CLASSES, "nc"), "key"), "blocks")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(blocks, "key").select("key", own("q", "nq").alias("qb"), all_of("nc").alias("cb"), "q", "hot", "x")
    held = held.join(blocks, "key").select("key", all_of("nq").alias("qb"), own("c", "nc").alias("cb"), "c", "y")
    return asked.groupBy("key", "qb", "cb").cogroup(held.groupBy("key", "qb", "cb")).applyInArrow(compare, schema)


def align(prints: DataFrame, queries: DataFrame, least_overlap: int = 16, most_error: float = 0.25, frequent: int = 1000) -> DataFrame:
    """A row for each recording: (id, n_items, class_id, is_query, match_id, offset, overlap, bit_error).

    Recordings with equal items form a class, named by its smallest id. A query's match is, if there is one, the smallest
    other id of its class, with offset 0 and error 0; else the class with the least share of differing bits at one of the
    offsets that equal items vote for (ties: the smaller class, then the smaller offset), if at least least_overlap items overlap and
    the error is at most most_error. Of equal items in a row, as in a steady passage or silence, the first votes, so that a
    passage has one vote and not the square of its length. Any two recordings with an item in common are compared, at each
    of their offsets with a vote, so that a silence that both hold outvotes no other item; at eight flipped bits in a hundred most copies have some. Items that stand at more than `frequent` places are not joined:
    pairs that share one are compared in blocks, by all their items, with the same result. That work is the number of
    queries times that of recordings which hold the item, but sends no row for a pair. offset is the match's place less the query's. A recording
    without items has no class and no match; one without id takes no part in matches; rows that repeat an id are rows of
    their own. Other columns are left out. An empty table gives an empty result.
    """
    prints = written(prints.select("id", "items").withColumn("n_items", F.size("items")), "prints")
    some = prints.where("n_items > 0 AND id IS NOT NULL").select("id", "items")
    two = some.distinct().withColumn("place", F.row_number().over(Window.partitionBy("items").orderBy("id"))).where("place <= 2")
    classes = written(two.groupBy("items").agg(F.min("id").alias("class_id"), F.max("id").alias("next_id")), "classes")
    asked = queries.select(F.col("id").alias("asked")).where("asked IS NOT NULL").distinct()
    known = written(prints.join(classes, (prints.items == classes["items"]) & prints.id.isNotNull(), "left").select("id", "n_items", "class_id", "next_id").join(asked, F.col("id") == F.col("asked"), "left").select("id", "n_items", "class_id", "next_id", F.col("asked").isNotNull().alias("is_query")), "known")
    single = known.where("is_query AND class_id = next_id").select(F.col("class_id").alias("single")).distinct()

    def keyed(df: DataFrame, name: str) -> DataFrame:
        firsts = F.expr("filter(transform(sequence(1, size(items)), i -> struct(items[i - 1] AS key, i AS place)), (e, j) -> j = 0 OR items[j - 1] <> e.key)")
        each = df.select(F.col("class_id").alias(name), F.explode(firsts).alias("e"))
        return each.select(name, "e.key", F.col("e.place").alias(f"{name}_place"))

    left = written(keyed(classes.join(single, classes.class_id == F.col("single"), "left_semi"), "q"), "asked")
    every = keyed(classes, "c")
    often = every.join(left.select("key").distinct(), "key", "left_semi").groupBy("key").count()
    hot = written(often.where(F.col("count") > frequent).select("key"), "frequent")
    some_hot = bool(hot.limit(1).count())
    voters = left.join(hot, "key", "left_anti") if some_hot else left
    votes = voters.join(every, "key").where("q <> c").select("q", "c", (F.col("c_place") - F.col("q_place")).alias("offset"))
    pairs = votes.groupBy("q", "c").agg(F.collect_set("offset").alias("offsets"))
    a, b = classes.select(F.col("class_id").alias("q"), F.col("items").alias("x")), classes.select(F.col("class_id").alias("c"), F.col("items").alias("y"))
    both = pairs.join(a, "q").join(b, "c")
    if some_hot:
        mine = left.join(hot, "key").groupBy("q").agg(F.collect_set("key").alias("hot"))
        both = both.join(mine, "q", "left").where(F.col("hot").isNull() | ~F.arrays_overlap("y", "hot"))
    both = both.select("q", "c", "x", "y", F.explode("offsets").alias("offset"))
    skip_x, skip_y = F.greatest(F.lit(0), -F.col("offset")), F.greatest(F.lit(0), F.col("offset"))
    overlap = F.least(F.size("x") - skip_x, F.size("y") - skip_y)
    bits = F.aggregate(F.zip_with(F.slice("x", skip_x + 1, overlap), F.slice("y", skip_y + 1, overlap), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)
    scored = both.where(overlap >= least_overlap).select("q", "c", "offset", overlap.alias("overlap"), (bits / (32.0 * overlap)).alias("bit_error")).where(F.col("bit_error") <= most_error)
    if some_hot:
        compare = partial(_compared, least_overlap=least_overlap, most_error=most_error, schema=to_arrow_schema(scored.schema))
        scored = scored.unionByName(_by_blocks(left, every, hot, classes, compare, scored.schema))
    match = scored.groupBy("q").agg(F.min(F.struct("bit_error", "c", "offset", "overlap")).alias("m"))
    match = written(match.select("q", "m.*"), "match")
    out = known.join(match, (F.col("class_id") == F.col("q")) & F.col("is_query") & (F.col("class_id") == F.col("next_id")), "left")
    copied = F.col("is_query") & (F.col("class_id") != F.col("next_id"))
    other = F.when(F.col("id") == F.col("class_id"), F.col("next_id")).otherwise(F.col("class_id"))
    return out.select("id", "n_items", "class_id", "is_query", F.when(copied, other).otherwise(F.col("c")).alias("match_id"), F.when(copied, 0).otherwise(F.col("offset")).alias("offset"), F.when(copied, F.col("n_items")).otherwise(F.col("overlap")).alias("overlap"), F.when(copied, 0.0).otherwise(F.col("bit_error")).alias("bit_error"))


# -- recordings of a table without audio -----------------------------------------------------------------

#: Samples of a note and pitches of the scale.
NOTE, SCALE = RATE // 10, 24
_TONES = np.sin(2 * np.pi * LOWEST * 2 ** (np.arange(SCALE) / 12)[:, None] * np.arange(NOTE) / RATE)


def rendered(vector: list[float | None] | None) -> np.ndarray:
    """A vector as a tune: a tenth of a second for each component, whose rank in the scale is that of its share of the largest one. Nothing for a vector that is null, zero or has null or non-finite components."""
    if not vector or any(x is None for x in vector):
        return np.zeros(0)
    x = np.array(vector, float)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return np.zeros(0)
    return _TONES[np.clip(((x / top + 1) / 2 * SCALE).astype(int), 0, SCALE - 1)].ravel()
