"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that the numpy kernels handle at once; bounds a worker's memory whatever a batch holds.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(ident: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % n


#: The folder of a session of one machine, which can't set spark.checkpoint.dir once it runs.
_local: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in a session of one machine a fresh local one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        if "root" not in _local:
            _local["root"] = "file://" + tempfile.mkdtemp(prefix="tessella-")
        root = _local["root"]
    return f"{root.rstrip('/')}/tessella"


def smallest(df: DataFrame, ident: str, most: int, rows: int) -> DataFrame:
    """The `most` rows of distinct ids with the smallest hashes, of `rows` in all.

    Where there are many more, rows above a hash that four times as many lie below go first, so that what tasks
    send on does not grow with the table; that fewer than `most` are left then does not happen by chance.
    """
    order = F.xxhash64(ident)
    if rows > 8 * most:
        df = df.where(order < int(-(2**63) + 2**64 * (4 * most / rows)))
    return df.orderBy(order, ident).limit(most)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


_made: list[tuple[SparkSession, str]] = []


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables or files of this package's own work folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _made:
        try:
            drop(spark, path)
        except Exception:  # the session may have ended; the folder is the cluster's to empty
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a table in the shared folder and read again, which cuts its lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    bounded(spark)
    df.write.parquet(path)
    driver_gives_back(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    return out


#: Bytes of a batch that Spark hands to Python at once; by rows alone, thousands of long texts would come together.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, unless it has a bound of its own."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """The frame dealt out evenly where its scan has fewer splits than there are cores, as with few files of one row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts_of(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), most: int = CHUNK_BYTES) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]], StructType]:
    """Rows of (id, kept, text) for a function over Arrow batches; what gives it their pieces, each with the arrays that go on
    as they are (id, kept); and the fields of these.

    kept is a struct of the columns `keep`, if there are any, so their names can't clash with others. A text that is kept
    travels once.
    """
    bounded(docs.sparkSession)
    driver_gives_back(docs.sparkSession)
    kept = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept")] if keep else []
    inside = text_col in keep
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *kept, *([] if inside else [F.col(f"`{text_col}`").cast("string").alias("text")]))
    fields = StructType([f for f in rows.schema if f.name != "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        if inside:
            at = keep.index(text_col)
            batches = (pa.record_batch([*b.columns, pc.struct_field(b.column("kept"), [at]).cast(pa.string())], [*b.schema.names, "text"]) for b in batches)
        for batch in pieces(batches, "text", most):
            yield batch, [batch.column(c) for c in fields.names]

    return spread(rows), cut, fields


#: What a worker process remembers between tasks, by operator, and how to forget it.
caches: dict[str, Callable[[], None]] = {}


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES, cache: str = "") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes in `column` at most, but one row at least.

    A worker forgets what it remembers for other operators than `cache` first, and gives unused memory back to the system
    then and at the end: workers live on between tasks and operators, and share their executor's memory.
    """
    for name, forget in caches.items():
        if name != cache:
            forget()
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    give_back()


def give_back() -> None:
    """Unused memory of Arrow's pool, and of the C library where it can, goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def driver_gives_back(spark: SparkSession) -> None:
    """Unused memory of the driver goes back to the system: that of its Python, as after a fit, and of its JVM's C library.

    The C library keeps freed memory of each of many threads, beside all that the heap may take.
    A JVM without that command (it is one of Linux, and of Java 17.0.9 or 21.0.1 on) keeps it as before.
    """
    give_back()
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        values = array(jvm.java.lang.Object, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        values[2], values[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        # the server's own class is not open to Py4J, its interface is
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        pass


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets; a null is empty."""
    kind = pa.large_binary()
    array = array.cast(pa.large_string()).cast(kind) if pa.types.is_string(array.type) else array.cast(kind)
    if array.null_count:
        array = array.fill_null(b"")
    offs = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    lo, hi = (int(offs[0]), int(offs[-1])) if len(offs) else (0, 0)
    return data[lo:hi], offs - lo


# -- words and shingles --------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = _RNG.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least; only the longest tables asked for are kept."""
    if not _powers or len(_powers[0]) < n:
        size = ((int(n) >> 18) + 1) << 18
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers[:] = np.cumprod(up), np.cumprod(down)
    return _powers[0], _powers[1]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all texts, and the n + 1 offsets of each text's words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    gap = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1] | edge[1:-1]
    last[:-1] &= gap[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, with A-Z lower-cased."""
    return span_hashes(data, starts, ends)[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """The hashes of the bytes from each start to each of several ends, from one pass over the text."""
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in ends]
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=total[1:])
    before, down = total[starts], down[starts]
    return [mix((total[end] - before) * down) for end in ends]


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `size` words; with fewer words, the whole sequence is the one shingle."""
    starts, ends, own = word_spans(data, offs)
    words = word_hashes(data, starts, ends)
    full = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        full += words[k : k + len(full)] * _PLACE[k]
    full = mix(full)
    out = []
    for a, b in zip(own[:-1].tolist(), own[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            out.append(mix(np.sum(words[a:b] * _PLACE[8 : 8 + b - a], dtype=np.uint64, keepdims=True) + _PLACE[b - a + 32]))
        else:
            out.append(words[:0])
    return out


def runs(keys: np.ndarray) -> np.ndarray:
    """The n + 1 bounds of the runs of equal neighbours."""
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by `key`; holds one batch and one group at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(runs(keys)[-2])
        if held and keys[0] != held[-1].column(key)[held[-1].num_rows - 1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


# -- files in the shared folder ------------------------------------------------------------------------


def make_dir(uri: str) -> None:
    from pyarrow import fs

    at, path = fs.FileSystem.from_uri(uri)
    at.create_dir(path, recursive=True)


def open_out(uri: str):
    """A binary stream to a new file at a URI that every executor reaches (file, hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    at, path = fs.FileSystem.from_uri(uri)
    return at.open_output_stream(path, compression=None)


def open_in(uri: str):
    from pyarrow import fs

    at, path = fs.FileSystem.from_uri(uri)
    return at.open_input_file(path)


def dealt_files(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """One row a file, a task for every few files; the rows are a manifest, so their number is that of the files."""
    return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))
