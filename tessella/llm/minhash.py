"""Near-duplicate groups by a chosen-path set similarity join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, flat, grouped, mix, pieces, shingle_sets, spread, written
from .components import components

#: Minwise tokens of a set; the standard error of an estimate at 0.85 is 0.032.
TOKENS = 128
#: Rows up to which a node is compared exhaustively; larger nodes branch.
LEAF = 512
#: Trees of the first pass, which joins large groups, and of the first turn of the second, which searches between groups that
#: are still apart; these suffice for nine levels at 0.85, further turns add the trees that a greater depth asks for.
TREES = (3, 12)
#: Levels by which a node that is still too large branches at once, so that deep trees need few rounds over written tables.
LEVELS = 2
#: The chance to find a link at the threshold, at least, that sets the number of trees.
RECALL = 0.999
#: Rows up to which ids are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_MULT = np.random.default_rng(77).integers(1, 1 << 63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1)
_DIGESTS = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _set_keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two independent 64-bit keys of each whole set, which together say which sets are equal."""
    return [pa.array(mix(np.array([int(np.sum(mix(s ^ d), dtype=np.uint64)) ^ len(s) for s in sets], np.uint64)).view(np.int64)) for d in _DIGESTS]


def survival(levels: int, share: float) -> float:
    """The chance that a pair of similarity `share` still meets after so many levels of a tree that branches by 1 / share on average."""
    more, alive = 1 / share - 1, 1.0
    for _ in range(levels):
        apart = 1 - share * alive
        alive = 1 - (1 - more) * apart - more * apart * apart
    return alive


def trees_for(levels: int, share: float, recall: float) -> int:
    """Independent trees of that depth with which a pair at the threshold meets in a leaf with a chance of `recall`."""
    alive = survival(levels, share)
    return 1 if alive >= recall else math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """TOKENS minwise tokens of 32 bits for each set; zeros for an empty set."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), TOKENS), np.uint32)
    some = np.flatnonzero(sizes)
    if len(some):
        every = np.concatenate([sets[i] for i in some])
        at = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
        for k in range(TOKENS):
            out[some, k] = mix(np.minimum.reduceat(every * _MULT[k], at)) >> np.uint64(32)
    return out


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        sets = shingle_sets(*flat(batch.column("text")), size)
        sig = _signatures(sets)
        yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), *_set_keys(sets), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "text_hash", "n", "own", "check", "sig"])


def _whole_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        sets = shingle_sets(*flat(batch.column("text")), size)
        yield pa.record_batch([*_set_keys(sets), pa.array([s.tobytes() for s in sets], pa.binary())], ["own", "check", "whole"])


def _tokens(column: pa.Array) -> np.ndarray:
    return flat(column)[0].view(np.uint32).reshape(-1, TOKENS)


def _branch(batches: Iterator[pa.RecordBatch], roots: list[int] | None, steps: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """The children of each row's node after `steps` levels: a node's hash picks one token, or two as often as makes 1 / threshold on average.

    roots: the trees' seeds, from which each row starts; else it starts from its column node.
    """
    for batch in batches:
        sig, n = _tokens(batch.column("sig")), batch.num_rows
        if not n:
            continue
        row = np.arange(n)
        if roots is None:
            at = batch.column("node").to_numpy().view(np.uint64)
        else:
            at, row = mix(np.repeat(np.array(roots, np.uint64), n)), np.tile(row, len(roots))
        for _ in range(steps):
            pick = mix(at ^ np.uint64(0x5851F42D4C957F2D))
            first = (pick % np.uint64(TOKENS)).astype(np.int64)
            second = (first + 1 + ((pick >> np.uint64(20)) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS
            more = np.flatnonzero((pick >> np.uint64(40)) < np.uint64(int((1 / threshold - 1) * (1 << 24))))
            token = np.concatenate((first, second[more]))
            at, row = np.concatenate((at, at[more])), np.concatenate((row, row[more]))
            at = mix(mix(at + (token.astype(np.uint64) << np.uint64(32))) ^ sig[row, token].astype(np.uint64))
        ids = batch.column("key").to_numpy()[row]
        yield pa.record_batch([pa.array(ids), pa.array(batch.column("label").to_numpy()[row]), pa.array(at.view(np.int64))], ["key", "label", "node"])


def _near(sig: np.ndarray, n: np.ndarray, label: np.ndarray, i: int, least: float, threshold: float) -> np.ndarray:
    """Rows after i of another group whose sizes allow the threshold and whose tokens agree often enough."""
    small, large = np.minimum(n[i + 1 :], n[i]), np.maximum(n[i + 1 :], n[i])
    at = np.flatnonzero((label[i + 1 :] != label[i]) & (small >= threshold * large * (1 - 1e-12))) + i + 1
    return at[(sig[at] == sig[i]).sum(1) >= least] if len(at) else at


def _flag(batches: Iterator[pa.RecordBatch], least: float, threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows of each leaf that have a likely partner there."""
    for part in grouped(batches, "node"):
        part = part.combine_chunks()
        node, n, label = (part.column(c).to_numpy() for c in ("node", "n", "label"))
        sig = _tokens(pa.chunked_array(part.column("sig")).combine_chunks() if part.num_rows else part.column("sig"))
        hit = np.zeros(len(node), bool)
        edges = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]))
        sizes = np.diff(edges)
        two = edges[:-1][sizes == 2]
        if len(two):
            small, large = np.minimum(n[two], n[two + 1]), np.maximum(n[two], n[two + 1])
            ok = (label[two] != label[two + 1]) & (small >= threshold * large * (1 - 1e-12)) & ((sig[two] == sig[two + 1]).sum(1) >= least)
            hit[two[ok]] = hit[two[ok] + 1] = True
        for a, size in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own = slice(a, a + size)
            for i in range(size - 1):
                if len(near := _near(sig[own], n[own], label[own], i, least, threshold)):
                    hit[a + i] = True
                    hit[a + near] = True
        if hit.any():
            yield part.select(["node", "key", "rep", "own", "check", "label", "n", "sig"]).filter(pa.array(hit)).combine_chunks().to_batches()[0]


def _confirm(batches: Iterator[pa.RecordBatch], least: float, threshold: int) -> Iterator[pa.RecordBatch]:
    """Links of each leaf, confirmed on whole sets; a pair whose rows are already joined there is skipped."""
    for part in grouped(batches, "node"):
        part = part.combine_chunks()
        node, n, label, key = (part.column(c).to_numpy() for c in ("node", "n", "label", "key"))
        sig = _tokens(part.column("sig").combine_chunks())
        data, offs = flat(part.column("whole").combine_chunks())
        edges = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]))
        a_out, b_out = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            up = {}
            for x in label[a:b].tolist():
                up.setdefault(x, x)

            def root(x: int) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            sets = [data[offs[k] : offs[k + 1]].view(np.uint64) for k in range(a, b)]
            own = slice(a, b)
            for i in range(b - a - 1):
                for j in _near(sig[own], n[own], label[own], i, least, threshold / 100).tolist():
                    x, y = root(int(label[a + i])), root(int(label[a + j]))
                    if x == y:
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                        up[max(x, y)] = min(x, y)
                        a_out.append(int(label[a + i]))
                        b_out.append(int(label[a + j]))
        if a_out:
            yield pa.record_batch([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])


def _place(front: DataFrame, sized: DataFrame) -> DataFrame:
    """(key, label, node) of the leaves. A node with a row too many becomes several: rows of its main part are dealt out, all others go to each."""
    held = front.join(sized, "node")
    parts = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).when(F.expr("label <> main OR key = lo OR key = hi"), F.expr("sequence(0L, parts - 1)")).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("parts"))))
    dealt = held.select("key", "label", "node", "parts", F.explode(parts).alias("part"))
    return dealt.select("key", "label", F.when(F.col("parts") == 1, F.col("node")).otherwise(F.xxhash64("node", "part")).alias("node"))


def _leaves(rows: DataFrame, seeds: list[int], threshold: float, deal: bool) -> tuple[DataFrame, int]:
    """(key, label, node) of each leaf with rows of two groups at least; and the levels of the deepest.

    deal: nodes above LEAF rows are dealt into leaves that share two rows, which joins large groups of near copies at
    a cost in proportion to their rows. Else such a node branches on until at most LEAF of its rows are outside its
    largest group, and these are then compared with all of that group, which is dealt out.
    """
    spark, schema, leaves, rounds, levels = rows.sparkSession, "key long, label long, node long", [], 1, 1
    front = written(rows.mapInArrow(partial(_branch, roots=seeds, steps=1, threshold=threshold), schema), "front")
    while True:
        by = front.groupBy("node", "label").agg(F.count("*").alias("c"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        by = by.groupBy("node").agg(F.sum("c").alias("rows"), F.max("c").alias("top"), F.count("*").alias("labels"), F.max_by("label", F.struct("c", "label")).alias("main"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("labels > 1")
        if deal:
            by = by.select("node", F.ceil(F.col("rows") / LEAF).cast("long").alias("parts"), F.lit(False).alias("more"), F.lit(None).cast("long").alias("main"), "lo", "hi")
        else:
            none = F.lit(None).cast("long")
            by = by.select("node", F.ceil(F.col("top") / LEAF).cast("long").alias("parts"), (F.col("rows") - F.col("top") > LEAF).alias("more"), "main", none.alias("lo"), none.alias("hi"))
        sized = written(by, "sized")
        leaves.append(written(_place(front, sized.where("NOT more")), "leaves"))
        large = sized.where("more").select("node")
        if not large.limit(1).count():
            break
        held = front.join(large, "node").select("key", "node").join(rows.select("key", "label", "sig"), "key")
        rounds += 1
        steps = LEVELS + rounds // 6
        levels += steps
        front, past = written(held.mapInArrow(partial(_branch, roots=None, steps=steps, threshold=threshold), schema), "front"), front
        drop(spark, past.path, sized.path)
    out = leaves[0]
    for x in leaves[1:]:
        out = out.union(x)
    return out, levels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, threshold: int = 80, recall: float = RECALL, trees: tuple[int, int] = TREES, seed: int = 11) -> DataFrame:
    """Groups of documents that chains of near duplicates join: (doc_id, n_shingles, component_id, kept), a row for each row of `docs`.

    Two texts are linked if 100 * |intersection| >= threshold * |union| of their sets of shingles (lower-cased A-Z, words
    of non-space bytes). Method: equal sets become one class; each of the independent trees branches the classes by
    minwise tokens that the hash of a node selects, until a node has at most LEAF rows, which are compared with each
    other: token agreement within five standard errors of the threshold first, then the whole sets. The first pass joins
    what is alike in large nodes at a cost in proportion to their rows; the second sees only nodes whose classes are
    still in different groups, and takes as many trees as its deepest leaf needs for a pair at the threshold to meet in
    one with a chance of `recall`. Words, shingles and sets are told apart by hashes of 64 bits, sets by two of them; their
    seeds are constants, so texts can be made to collide on purpose, not by chance.

    A null or empty text, or one of spaces only, has no shingles and is linked with nothing. A row without id takes no
    part: its component_id is null and kept is true. Rows that repeat an id are rows of their own; equal texts among
    them are linked, so each is kept if its id is the smallest of its group. Only the two columns named are looked at. An
    empty table gives an empty result.
    """
    docs = spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")))
    spark = docs.sparkSession
    share = threshold / 100
    least = TOKENS * (share - 5 * (share * (1 - share) / TOKENS) ** 0.5)
    sketch = written(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(partial(_sketch, size=shingle_words), "doc_id long, text_hash long, n long, own long, check long, sig binary"), "sketch")
    rows = sketch.where("n > 0 AND doc_id IS NOT NULL").groupBy("own", "check").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    rows = written(rows.withColumn("key", F.monotonically_increasing_id()).withColumn("label", F.col("key")), "classes")
    links, turn, done, needed, past = None, 0, 0, trees[1], [sketch]
    while done < needed:
        seeds = [seed * 1_000_003 + 1009 * turn + k for k in range(trees[0] if turn == 0 else needed - done)]
        leaves, levels = _leaves(rows.select("key", "label", "sig"), seeds, share, deal=turn == 0)
        if turn:
            done, needed = needed, max(needed, trees_for(levels, share, recall))
        held = leaves.select("key", "node").join(rows, "key").repartition("node").sortWithinPartitions("node")
        flagged = written(held.select("node", "key", "rep", "own", "check", "label", "n", "sig").mapInArrow(partial(_flag, least=least, threshold=share), "node long, key long, rep long, own long, check long, label long, n long, sig binary"), "flagged")
        wanted = flagged.select(F.col("rep").alias("doc_id")).distinct()
        texts = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "doc_id", "left_semi").select("text")
        sets = texts.mapInArrow(partial(_whole_sets, size=shingle_words), "own long, check long, whole binary").dropDuplicates(["own", "check"])
        full = flagged.join(sets, ["own", "check"]).select("node", "key", "label", "n", "sig", "whole").repartition("node").sortWithinPartitions("node")
        found = written(full.mapInArrow(partial(_confirm, least=least, threshold=threshold), "a long, b long"), "found")
        links = found if links is None else links.union(found)
        labels = components(links).withColumnRenamed("label", "to")
        if done < needed:
            past.append(rows)
            rows = written(rows.drop("label").join(labels, rows.key == labels.node, "left").select("key", "own", "check", "rep", "n", "sig", F.coalesce("to", "key").alias("label")), "classes")
        turn += 1
    groups = rows.join(labels, rows.key == labels.node).select("key", "rep", "to")
    least_id = written(groups.groupBy("to").agg(F.min("rep").alias("component_id")), "least")
    known = written(groups.join(least_id, "to").select(F.col("key").alias("of"), "component_id"), "known")
    alone = rows.join(known, rows.key == known.of, "left").select("own", "check", F.coalesce("component_id", "rep").alias("group_id"))
    alone = written(alone, "groups").select(F.col("own").alias("a"), F.col("check").alias("b"), "group_id")
    for x in past[1:]:
        drop(spark, x.path)
    out = sketch.drop("sig").join(alone, (sketch.own == alone.a) & (sketch.check == alone.b) & (sketch.n > 0) & sketch.doc_id.isNotNull(), "left")
    group = F.coalesce(F.col("group_id"), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"), "text_hash")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs of which one for each group of near duplicates stays: that with the smallest id.

    Of several rows with that id, the one whose text has the smallest hash stays, once: of rows that repeat id and text,
    any. Rows without shingles or without id all stay. Other columns stay as they are, whatever their names. An empty
    table gives an empty result.
    """
    found = near_duplicates(docs, id_col, text_col, **options).where("n_shingles > 0 AND doc_id IS NOT NULL")
    found = written(found.select("doc_id", "text_hash", "component_id", "kept"), "decided")
    stay = found.where("kept").groupBy("component_id").agg(F.min("text_hash").alias("least"), F.count("*").alias("rows"))
    several = stay.where("rows > 1")
    gone = found.where("NOT kept").select("doc_id", "text_hash")
    gone = gone.union(found.where("kept").join(several.select("component_id", "least"), "component_id").where("text_hash <> least").select("doc_id", "text_hash")).distinct()
    gone = written(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")), "gone")
    twice = written(several.select(F.col("component_id").alias("twice_id")), "twice")
    small = gone.count() <= BROADCAST_ROWS
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("row_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("row_hash"))
    left = whole.join(F.broadcast(gone) if small else gone, (F.col("row_id") == F.col("gone_id")) & (F.col("row_hash") == F.col("gone_hash")), "left_anti")
    n = twice.count()
    if n:
        of = F.broadcast(twice) if n <= BROADCAST_ROWS else twice
        same = F.col("row_id") == F.col("twice_id")
        left = left.join(of, same, "left_anti").union(left.join(of, same, "left_semi").dropDuplicates(["row_id", "row_hash"]))
    return left.select("row.*")
