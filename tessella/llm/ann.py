"""Approximate nearest neighbours by cross-polytope hashing, with exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, written

#: Hash tables. Each vector is sent to one bucket of each, so this is the factor of what is shuffled.
TABLES = 16
#: The share of the k nearest that a query should find, and the queries on which the number of probes is fitted to it:
#: those of the smallest hashes, at most so many, are compared with every vector.
RECALL, PILOTS = 0.95, 128
#: Vectors that a task compares at once; buckets share a task's block up to that, larger ones are dealt out. A query gets
#: k + 1 rows from each block that it probes, so blocks are as large as a task's memory likes.
BLOCK = 65536
#: Vectors a bucket has on average at most; a table joins more hashes, and so has more buckets, as their number grows.
BUCKET_ROWS = 2
#: Pairs that are compared in one go.
PAIRS = 50_000


def signs_of(dims: int) -> int:
    """The rotation's size: the next power of two."""
    return 1 << max(0, (dims - 1).bit_length())


def rotations(dims: int, count: int, seed: int) -> np.ndarray:
    """The signs of three diagonal matrices for each of `count` pseudo-rotations over the next power of two."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (count, 3, signs_of(dims)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, size = x.shape
    step = 1
    while step < size:
        x = x.reshape(n, -1, 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(n, size)
        step *= 2
    return x / math.sqrt(size)


def rotate(unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
    x = np.zeros((len(unit), signs.shape[1]))
    x[:, : unit.shape[1]] = unit
    for k in range(3):
        x = hadamard(x * signs[k])
    return x


def axes(rotated: np.ndarray, count: int) -> np.ndarray:
    """The `count` nearest signed axes of each row, nearest first: axis k is +e_k, axis d + k is -e_k."""
    return _axes(rotated, count)[0]


def _axes(rotated: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` nearest signed axes of each row, and the row's coordinates along them."""
    both = np.concatenate((rotated, -rotated), 1)
    count = min(count, both.shape[1])
    best = np.argpartition(-both, count - 1, axis=1)[:, :count]
    order = np.argsort(-np.take_along_axis(both, best, 1), axis=1, kind="stable")
    best = np.take_along_axis(best, order, 1)
    return best, np.take_along_axis(both, best, 1)


def buckets(unit: np.ndarray, signs: np.ndarray, hashes: int, probes: int, ordered: bool = True) -> np.ndarray:
    """Buckets of each row in one table, a row's own first if ordered: `hashes` axes joined; the `probes` combinations of axes of
    the largest sums of coordinates, over all hashes. The i-th and j-th best of two lists can be among them only if i * j <= probes."""
    wide = 2 * signs.shape[2]
    own, sums = _axes(rotate(unit, signs[0]), probes)
    for k in range(1, hashes):
        near, along = _axes(rotate(unit, signs[k]), probes)
        i, j = np.divmod(np.arange(own.shape[1] * near.shape[1]), near.shape[1])
        some = (i + 1) * (j + 1) <= probes
        i, j = i[some], j[some]
        joint = sums[:, i] + along[:, j]
        if ordered or k + 1 < hashes:
            best = np.argsort(-joint, axis=1, kind="stable")[:, :probes]
        else:
            best = np.argpartition(-joint, min(probes, joint.shape[1]) - 1, axis=1)[:, :probes]
        own, sums = np.take_along_axis(own[:, i] + near[:, j] * wide**k, best, 1), np.take_along_axis(joint, best, 1)
    return own


def _matrix(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True, initial=0)  # lengths neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _bytes(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [np.array(x, kind).tobytes() for x in batch.column("vector").to_pylist()]
        yield pa.record_batch([pa.array(vectors, pa.binary()) if n == "vector" else batch.column(n) for n in batch.schema.names], batch.schema.names)


def _place(batches: Iterator[pa.RecordBatch], dims: int, kind: str, signs: np.ndarray, hashes: int, share: int) -> Iterator[pa.RecordBatch]:
    """A row for each table of each vector: its bucket, and the block that holds the bucket."""
    for whole in batches:
        for batch in (whole.slice(k, 2000) for k in range(0, whole.num_rows, 2000)):
            unit = _unit(_matrix(batch.column("vector"), dims, kind))
            for t in range(len(signs)):
                own = buckets(unit, signs[t], hashes, 1)[:, 0]
                yield pa.record_batch([pa.array(np.full(len(own), t)), pa.array(own // share), pa.array(own), batch.column("class"), batch.column("vector")], ["t", "block", "bucket", "class", "vector"])


def _pose(batches: Iterator[pa.RecordBatch], dims: int, kind: str, signs: np.ndarray, hashes: int, share: int, probes: int) -> Iterator[pa.RecordBatch]:
    """A row for each table and block of each query, with the buckets there that it probes."""
    step = max(1, min(500, 200_000 // probes))
    for whole in batches:
        for batch in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
            unit = _unit(_matrix(batch.column("vector"), dims, kind))
            for t in range(len(signs)):
                own = np.sort(buckets(unit, signs[t], hashes, probes, False), axis=1)
                row, flat = np.repeat(np.arange(len(own)), own.shape[1]), own.ravel()
                block = flat // share
                first = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (row[1:] != row[:-1]))))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)), pa.int32()), pa.array(flat))
                taken = batch.take(pa.array(row[first]))
                yield pa.record_batch([pa.array(np.full(len(first), t)), pa.array(block[first]), lists, taken.column("class"), taken.column("vector")], ["t", "block", "buckets", "class", "vector"])


def _nearest(who: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` largest scores of each of `who`; those that agree in 12 digits are ordered by id."""
    order = np.lexsort((ids, -np.round(score, 12), who))
    first = np.flatnonzero(np.concatenate(([True], who[order][1:] != who[order][:-1])))
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[place < most]


def _rerank(queries: pd.DataFrame, rows: pd.DataFrame, most: int, dims: int, kind: str) -> pd.DataFrame:
    """The `most` nearest classes of each query among the rows of a block whose buckets it probes, by exact cosine."""
    none = pd.DataFrame({"query": pd.Series(dtype="int64"), "class": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(queries) or not len(rows):
        return none
    rows = rows.sort_values("bucket", kind="stable")
    a, b = (_unit(np.frombuffer(b"".join(x["vector"]), kind).astype(np.float64).reshape(-1, dims)) for x in (queries, rows))
    who, ids, held = queries["class"].to_numpy(), rows["class"].to_numpy(), rows["bucket"].to_numpy()
    asked = np.concatenate(queries["buckets"].to_list())
    of = np.repeat(np.arange(len(who)), [len(x) for x in queries["buckets"]])
    low = np.searchsorted(held, asked, "left")
    n = np.searchsorted(held, asked, "right") - low
    low, of, n = low[n > 0], of[n > 0], n[n > 0]
    total, out, at = np.cumsum(n), [], 0
    while at < len(n):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS)) + 1
        while end < len(n) and of[end] == of[end - 1]:  # a query's pairs, BLOCK at most, stay together
            end += 1
        size = n[at:end]
        x = np.repeat(of[at:end], size)
        y = np.arange(len(x)) + np.repeat(low[at:end] - (np.cumsum(size) - size), size)
        near = np.einsum("ij,ij->i", a[x], b[y])
        best = _nearest(x, ids[y], near, most)
        out.append((who[x[best]], ids[y[best]], near[best]))
        at = end
    return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("query", "class", "score"), zip(*out))}) if out else none


def _near_pilots(batches: Iterator[pa.RecordBatch], pilots: np.ndarray, own: np.ndarray, k: int, kind: str) -> Iterator[pa.RecordBatch]:
    """The k classes nearest to each pilot among a task's rows, the pilot's own left out."""
    who, ids, score, raw = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
    for whole in batches:
        for batch in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
            x, names = _unit(_matrix(batch.column("vector"), pilots.shape[1], kind)), batch.column("class").to_numpy()
            near = pilots @ x.T
            near[own[:, None] == names[None]] = -2
            some = np.argpartition(-near, min(k, near.shape[1]) - 1, axis=1)[:, :k]
            vectors = np.array(batch.column("vector").to_pylist(), object)
            who = np.concatenate((who, np.repeat(np.arange(len(pilots)), some.shape[1])))
            ids, score, raw = np.concatenate((ids, names[some].ravel())), np.concatenate((score, np.take_along_axis(near, some, 1).ravel())), np.concatenate((raw, vectors[some].ravel()))
            best = _nearest(who, ids, score, k)
            best = best[score[best] > -2]
            who, ids, score, raw = who[best], ids[best], score[best], raw[best]
    if len(who):
        yield pa.record_batch([pa.array(who), pa.array(ids), pa.array(score), pa.array(raw.tolist(), pa.binary())], ["pilot", "class", "score", "vector"])


def probes_for(classes: DataFrame, posed: DataFrame, signs: np.ndarray, hashes: int, dims: int, kind: str, k: int, recall: float) -> int:
    """The fewest probes with which PILOTS queries, compared with every vector, find a share `recall` of their k nearest.

    Each table is a task that finds the place of a neighbour's bucket among a pilot's probes; the probes looked at grow
    until the share is reached, at the latest where every bucket is probed.
    """
    spark = classes.sparkSession
    chosen = posed.orderBy(F.xxhash64("class"), "class").limit(PILOTS).select("class", "vector").collect()
    if not chosen:
        return 1
    pilots = _unit(np.frombuffer(b"".join(r["vector"] for r in chosen), kind).astype(np.float64).reshape(-1, dims))
    own = np.array([r["class"] for r in chosen])
    near = classes.select("class", "vector").mapInArrow(partial(_near_pilots, pilots=pilots, own=own, k=k, kind=kind), "pilot long, class long, score double, vector binary")
    by = Window.partitionBy("pilot").orderBy(F.desc(F.round("score", 12)), "class")
    pairs = near.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).select("pilot", "vector").collect()  # PILOTS * k rows
    if not pairs:
        return 1
    who = np.array([r["pilot"] for r in pairs])
    ends = _unit(np.frombuffer(b"".join(r["vector"] for r in pairs), kind).astype(np.float64).reshape(-1, dims))
    probes, every = 64, (2 * signs.shape[3]) ** hashes

    def ranks(batches: Iterator[pa.RecordBatch], probes: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("id").to_pylist():
                home, place = buckets(ends, signs[t], hashes, 1)[:, 0], np.full(len(who), every)
                for i in range(0, len(who), max(1, 100_000 // probes)):
                    at = slice(i, i + max(1, 100_000 // probes))
                    asked, of = np.unique(who[at], return_inverse=True)
                    hit = buckets(pilots[asked], signs[t], hashes, probes)[of] == home[at, None]
                    place[at] = np.where(hit.any(1), hit.argmax(1), every)
                yield pa.record_batch([pa.array(np.arange(len(who))), pa.array(place)], ["pair", "place"])

    while True:
        probes = min(probes, every)
        found = spark.range(0, len(signs), 1, len(signs)).mapInArrow(partial(ranks, probes=probes), "pair long, place long").groupBy("pair").agg(F.min("place").alias("place")).collect()
        place = np.sort([r["place"] for r in found])
        last = int(place[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)])
        if last < probes or probes >= every:
            return min(every, last + 1)
        probes *= 4


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, hashes: int | None = None, recall: float = RECALL, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query's vector by cosine, ties to the smaller id.

    Equal vectors become one class with its k + 1 smallest ids, which hold all that can be returned of it. Each table
    assigns a class to the nearest signed axis after a fast pseudo-rotation, or to `hashes` of them joined, so many that
    a bucket has BUCKET_ROWS classes on average (or as given). A query probes, in each table, the buckets of the largest
    sums of coordinates over all hashes; how many is fitted to `recall` on pilot queries that are compared with all
    vectors (probes_for), at every size alike. Buckets share blocks of a task, large blocks are dealt out, and a task
    compares each query with the rows of the buckets it probes only, exactly, and keeps k + 1 of them. The frames need
    no other columns than id and vector; others are left out, whatever their names. A query is never its own neighbour,
    but a row that repeats its vector under another id is. Vectors that are null, empty, zero, of a length other than the
    commonest (the smaller of two as common), or with null or non-finite components take no part; rows without id
    neither; a repeated id counts once for each different vector. With no vectors, or no queries, the result is empty.
    """
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" and dict(queries.dtypes)[vector_col] == "array<float>" else "<f8"

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
        fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(F.col("id").isNotNull() & (F.size("vector") > 0) & fine & F.exists("vector", lambda x: x != 0)).withColumn("vector", F.transform("vector", lambda x: x + 0.0))

    base = clean(vectors)
    size = base.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    dims = size["d"]
    packed = lambda df: df.where(F.size("vector") == dims).mapInArrow(partial(_bytes, kind=kind), "id long, vector binary")
    base = packed(base).distinct()
    few = base.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("place") <= k + 1)
    classes = written(few.groupBy("vector").agg(F.min("id").alias("class"), F.array_sort(F.collect_list("id")).alias("ids")), "classes")
    asked = written(packed(clean(queries)).distinct(), "asked")
    posed = written(asked.groupBy("vector").agg(F.min("id").alias("class")), "posed")
    count, wide = classes.count(), 2 * signs_of(dims)
    if hashes is None:
        hashes = 1
        while count > BUCKET_ROWS * wide**hashes and wide ** (hashes + 1) < 2**62:
            hashes += 1
    signs = rotations(dims, tables * hashes, seed).reshape(tables, hashes, 3, -1)
    probes = probes_for(classes, posed, signs, hashes, dims, kind, k, recall)
    share = max(1, BLOCK * wide**hashes // (2 * max(1, count)))
    place = partial(_place, dims=dims, kind=kind, signs=signs, hashes=hashes, share=share)
    pose = partial(_pose, dims=dims, kind=kind, signs=signs, hashes=hashes, share=share, probes=probes)
    right = spread(classes.select("class", "vector")).mapInArrow(place, "t long, block long, bucket long, class long, vector binary")
    large = written(right.groupBy("t", "block").count().where(F.col("count") > BLOCK).select("t", "block", F.ceil(F.col("count") / BLOCK).alias("parts")), "large")
    parts = F.coalesce("parts", F.lit(1))
    at = ["t", "block", "part"]
    right = right.join(large, ["t", "block"], "left").select("t", "block", "bucket", F.pmod(F.xxhash64("class"), parts).alias("part"), "class", "vector")
    left = spread(posed.select("class", "vector")).mapInArrow(pose, "t long, block long, buckets array<long>, class long, vector binary").join(large, ["t", "block"], "left").select("t", "block", "buckets", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "class", "vector")
    found = left.groupBy(at).cogroup(right.groupBy(at)).applyInPandas(partial(_rerank, most=k + 1, dims=dims, kind=kind), "query long, class long, score double")
    best = found.groupBy("query", "class").agg(F.max("score").alias("score"))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "class"))).where(F.col("place") <= k + 1)
    scored = written(best.join(classes.select("class", "ids"), "class").select("query", "ids", "score"), "scored")
    ids = written(asked.join(posed, "vector").select(F.col("id").alias("query_id"), F.col("class").alias("query")), "ids")
    each = ids.join(scored, "query").select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
