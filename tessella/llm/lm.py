"""Language-model scores of a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

The vocabulary is open: each token belongs to a unit, which is the end, a word that is frequent enough to have vectors of its
own, or a kind of rarer words by their last letters. The model predicts the next unit from the CONTEXT units before, first its
class and then the unit within the class, so that both sums are short; within its unit a token has its add-one share of the
training tokens, and each kind keeps one share for words never met. So the probabilities of all tokens sum to one:
p(token | context) = p(class | context) * p(unit | class, context) * (count + 1) / (the unit's mass).

Every training token is an example once. Tasks train on their own texts from the same vectors, in ROUNDS; after each, rows of
the vectors are averaged over the tasks by how often each was met there.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, drop, flat, mix, pieces, spread, word_hashes, word_spans, written

#: A word has vectors of its own from so many occurrences, and from this share of all training tokens: so there are at most
#: 1 / LEAST_SHARE such words, however large the table, and more of them the larger it is. Kinds of the other words.
LEAST, LEAST_SHARE, KINDS = 20, 4e-6, 256
#: Frequent words whose counts every worker holds at most (16 bytes each); the others' are joined.
HEAD = 500_000
#: Size of the vectors, units of context, noise classes a step and noise units an example; examples of a step.
SIZE, CONTEXT, NOISE_CLASSES, NOISE, BATCH = 16, 3, 16, 2, 2048
#: Turns of training and averaging, and the learning rate of each.
ROUNDS, RATES = 4, (0.1, 0.08, 0.06, 0.04)
#: Training tokens of a task and turn at least, and for each unit: what a task sends on is then small beside what it reads.
TASK_TOKENS, TOKENS_A_UNIT = 1_000_000, 200
#: Tokens that are scored at once, and rows of vectors that travel as one.
TOKENS, ROWS = 1 << 16, 2048
_END_KEY = np.int64(-1)


def _kinds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The kind of each word by its last two bytes."""
    last = _LOWER[data[ends - 1]].astype(np.uint64)
    before = np.where(ends - starts > 1, _LOWER[data[np.maximum(ends - 2, 0)]], 0).astype(np.uint64)
    return ((mix(last * np.uint64(256) + before + np.uint64(1)) >> np.uint64(40)) % np.uint64(KINDS)).astype(np.int64)


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and kinds of all tokens, ends included; the n + 1 offsets of the texts."""
    data, offs = flat(batch.column("text"))
    starts, ends, own = word_spans(data, offs)
    n = len(offs) - 1
    key, kind = np.full(len(starts) + n, _END_KEY), np.zeros(len(starts) + n, np.int64)
    last = own[1:] + np.arange(n)
    word = np.ones(len(key), bool)
    word[last] = False
    hashed = word_hashes(data, starts, ends).view(np.int64)
    key[word] = np.where(hashed == _END_KEY, np.int64(0), hashed)
    kind[word] = _kinds(data, starts, ends)
    return key, kind, np.concatenate(([0], last + 1))


def _sum(keys: np.ndarray, n: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, first, where = np.unique(keys, return_index=True, return_inverse=True)
    return keys, np.bincount(where, n).astype(np.int64), kinds[first]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out(part: tuple) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x) for x in part], ["key", "c", "kind"])

    for batch in pieces(batches, "text"):
        key, kind, _ = _words(batch)
        held.append(_sum(key, np.ones(len(key), np.int64), kind))
        if sum(len(x[0]) for x in held) > 1_500_000:
            held = [_sum(*map(np.concatenate, zip(*held)))]
            if len(held[0][0]) > 1_000_000:
                yield out(held.pop())
    if held:
        yield out(_sum(*map(np.concatenate, zip(*held))))


@dataclass
class Known:
    """What every worker holds. Head words' keys, sorted, with counts; the keys of words with vectors, sorted, with their
    units, and the kinds' units. Units are numbered by falling frequency; `width` neighbours make a class."""

    keys: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    units: np.ndarray
    kinds: np.ndarray
    share: np.ndarray
    width: int

    def unit(self, key: np.ndarray, kind: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, key), len(self.words) - 1)
        return np.where(self.words[at] == key, self.units[at], self.kinds[kind])

    @property
    def classes(self) -> int:
        return -(-len(self.share) // self.width)


def _contexts(unit: np.ndarray, offs: np.ndarray, start: int) -> np.ndarray:
    """The CONTEXT units before each token, nearest first; `start` beyond its text's beginning."""
    place = np.arange(len(unit)) - np.repeat(offs[:-1], np.diff(offs))
    out = np.full((len(unit), CONTEXT), start)
    for j in range(CONTEXT):
        some = np.flatnonzero(place > j)
        out[some, j] = unit[some - j - 1]
    return out


class Model:
    """Vectors as rows of one array, with a bias, the sum of squared gradients and how often the row was met beside each.

    In order: vectors of the units as context and of a text's beginning, of the units and of the classes as what is
    predicted, and the matrices of the CONTEXT places.
    """

    def __init__(self, known: Known, rows: np.ndarray | None = None, seed: int = 1) -> None:
        self.known, u, c = known, len(known.share), known.classes
        self.parts = np.cumsum([0, u + 1, u, c, CONTEXT * SIZE])
        self.class_share = np.add.reduceat(known.share, np.arange(0, u, known.width))
        #: ln(draws * frequency) of the rows that are predicted, units within their classes.
        inside = known.share / np.repeat(self.class_share, known.width)[:u]
        self.less = np.log(np.concatenate((NOISE * inside, NOISE_CLASSES * self.class_share))).astype(np.float32)
        self.edge = np.cumsum(self.class_share)
        if rows is None:
            rows = np.random.default_rng(seed).normal(0, 0.1, (self.parts[-1], SIZE + 3)).astype(np.float32)
            rows[:, SIZE:] = (0.0, 1e-8, 0.0)
            rows[self.parts[1] : self.parts[2], SIZE] = np.log(inside)
            rows[self.parts[2] : self.parts[3], SIZE] = np.log(self.class_share)
            rows[self.parts[3] :, :SIZE] = np.tile(np.eye(SIZE), (CONTEXT, 1)) * np.repeat(1 / np.arange(1, CONTEXT + 1), SIZE)[:, None]
        self.vectors, self.bias, self.past, self.met = np.ascontiguousarray(rows[:, :SIZE]), rows[:, SIZE].copy(), rows[:, SIZE + 1].copy(), rows[:, SIZE + 2].copy()

    @property
    def rows(self) -> np.ndarray:
        return np.column_stack((self.vectors, self.bias, self.past, self.met))

    def _update(self, at: np.ndarray, source: np.ndarray, rate: float, of: np.ndarray | None = None, weight: np.ndarray | None = None, bias: np.ndarray | None = None) -> None:
        """Adds up the gradients of each row and steps by them, each row by its own history.

        The gradients are the rows of source; else its rows `of`, times weight, which are made in the order of the sums only.
        """
        order = np.argsort(at.astype(np.uint16) if len(self.bias) <= 1 << 16 else at, kind="stable")
        sorted_at = at[order]
        first = np.flatnonzero(np.diff(sorted_at, prepend=-1))
        rows = sorted_at[first]
        grad = source.take(order if of is None else of.take(order), axis=0)
        if weight is not None:
            grad *= weight.take(order)[:, None]
        g = np.add.reduceat(grad.view(np.complex64), first, axis=0).view(np.float32)  # pairs of numbers as one: half the sums
        past = self.past[rows] + np.einsum("ij,ij->i", g, g) / SIZE
        scale = rate / np.sqrt(past)
        self.past[rows] = past
        self.vectors[rows] += g * scale[:, None]
        if bias is not None:
            self.bias[rows] += np.add.reduceat(bias.take(order), first) * np.minimum(scale, 0.05)
        self.met[rows] += np.diff(np.append(first, len(at)))

    def _noise(self, unit: np.ndarray, own: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """NOISE units for each example, drawn from its class by their frequency: the units of other examples of the class in
        this step; its class's most frequent one where there is no other."""
        order = np.argsort(own.astype(np.uint16) if self.known.classes <= 1 << 16 else own, kind="stable")
        size = np.bincount(own, minlength=self.known.classes)
        first = (np.cumsum(size) - size)[own[order]]
        size, place = size[own[order]], np.arange(len(unit))
        ahead = 1 + (rng.random((NOISE, len(unit))) * (size - 1)).astype(np.int64)
        drawn = unit[order][first + (place - first + ahead) % size]
        out = np.empty((len(unit), NOISE), np.int64)
        out[order] = np.where(size > 1, drawn, own[order] * self.known.width).T
        return out

    def step(self, unit: np.ndarray, context: np.ndarray, rate: float, rng: np.random.Generator) -> None:
        """One step: the next units' classes are told from NOISE_CLASSES classes, drawn by their frequency for all examples
        alike, and the units from NOISE others of their class, by s - ln(draws * frequency)."""
        p, n, u = self.parts, len(unit), len(self.known.share)
        r = self.vectors.take(context.ravel(), axis=0).reshape(n, -1)
        c = self.vectors[p[3] :]
        h = r @ c
        noise = u + np.minimum(np.searchsorted(self.edge, rng.random(NOISE_CLASSES) * self.edge[-1]), len(self.edge) - 1)
        own = unit // self.known.width
        q, k = self.vectors[p[1] + noise], self.vectors.take(p[2] + own, axis=0)
        f = h @ q.T
        f += self.bias[p[1] + noise] - self.less[noise]
        f = _sigmoid(f, -1)
        e = _sigmoid(np.einsum("ij,ij->i", h, k) + self.bias.take(p[2] + own) - self.less.take(u + own), 1)
        gh = f @ q
        gh += e[:, None] * k
        at = np.concatenate((unit[:, None], self._noise(unit, own, rng)), 1)
        q = self.vectors.take(p[1] + at.ravel(), axis=0).reshape(n, NOISE + 1, SIZE)
        g = np.matmul(q, h[:, :, None])[:, :, 0]
        g += self.bias.take(p[1] + at) - self.less.take(at)
        g = _sigmoid(g, -1)
        g[:, 0] += 1
        gh += np.matmul(g[:, None], q)[:, 0]
        back = gh @ c.T
        each, g = np.arange(n), g.ravel()
        of = np.concatenate((np.repeat(each, NOISE + 1), each, np.arange(n, n + NOISE_CLASSES)))
        ones = np.ones(NOISE_CLASSES, np.float32)
        self._update(p[1] + np.concatenate((at.ravel(), u + own, noise)), np.concatenate((h, f.T @ h)), rate, of, np.concatenate((g, e, ones)), np.concatenate((g, e, f.sum(0))))
        self._update(context.ravel(), back.reshape(-1, SIZE), rate)
        self._update(np.arange(p[3], p[4]), r.T @ gh, 0.1 * rate)

    def train(self, unit: np.ndarray, context: np.ndarray, rate: float, rng: np.random.Generator) -> None:
        order = rng.permutation(len(unit))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            self.step(unit.take(some), context.take(some, axis=0), rate, rng)

    def logs(self, unit: np.ndarray, context: np.ndarray) -> np.ndarray:
        """ln p(unit | context), normalised over all classes and all units of the class."""
        p, width, u = self.parts, self.known.width, len(self.known.share)
        h = np.empty((len(unit), SIZE + 1), np.float32)
        h[:, SIZE] = 1
        for k in range(0, len(unit), 4096):
            h[k : k + 4096, :SIZE] = self.vectors.take(context[k : k + 4096].ravel(), axis=0).reshape(-1, CONTEXT * SIZE) @ self.vectors[p[3] :]
        full = np.column_stack((self.vectors[p[1] : p[3]], self.bias[p[1] : p[3]]))
        own = unit // width
        out = np.einsum("ij,ij->i", h, full.take(unit, axis=0)) + np.einsum("ij,ij->i", h, full.take(u + own, axis=0))
        classes = full[u:].T.copy()
        for k in range(0, len(unit), 4096):
            out[k : k + 4096] -= _log_sum(h[k : k + 4096] @ classes)
        order = np.argsort(own.astype(np.uint16) if self.known.classes <= 1 << 16 else own, kind="stable")
        h, edge = h.take(order, axis=0), np.concatenate(([0], np.cumsum(np.bincount(own, minlength=self.known.classes))))
        sums = np.empty(len(unit), np.float32)
        for k in np.flatnonzero(np.diff(edge)).tolist():
            units = full[k * width : min((k + 1) * width, u)].T
            for a in range(edge[k], edge[k + 1], 4096):
                b = min(a + 4096, edge[k + 1])
                sums[a:b] = _log_sum(h[a:b] @ units)
        out[order] -= sums
        return out


def _sigmoid(x: np.ndarray, sign: int) -> np.ndarray:
    """1 - sigmoid(x) for sign 1, -sigmoid(x) for sign -1; in place."""
    np.clip(x, -30, 30, out=x)
    np.exp(sign * x, out=x)
    x += 1
    return np.divide(sign, x, out=x)


def _log_sum(s: np.ndarray) -> np.ndarray:
    """ln of the sum of exp of each row; in place. One shift for all rows does unless they lie far apart."""
    top = float(s.max())
    low = None
    if top > 60 or top < -60:
        low = s.max(1)
        s -= low[:, None]
    np.exp(s, out=s)
    total = np.log(s @ np.ones(s.shape[1], s.dtype))
    return total if low is None else total + low


def _averaged(part: pd.DataFrame) -> pd.DataFrame:
    """The rows of one range, averaged over the tasks by how often each was met; those never met as they were."""
    stack = np.stack([np.frombuffer(x, np.float32).reshape(-1, SIZE + 3) for x in part.sort_values("task")["raw"]]).astype(np.float64)
    n = stack[:, :, -1:]
    out = np.where(n.sum(0) > 0, (stack * n).sum(0) / np.maximum(n.sum(0), 1), stack[0])
    out[:, -1] = 0
    return pd.DataFrame({"range": part["range"].iloc[:1], "raw": [out.astype(np.float32).tobytes()]})


def fitted(texts: DataFrame, known: Known, tokens: int) -> Model:
    """The model trained on all texts, a turn's share of them by the hash of the text at a time."""
    spark, model = texts.sparkSession, Model(known)
    least = max(TASK_TOKENS, TOKENS_A_UNIT * len(known.share))
    tasks = max(1, math.ceil(tokens / ROUNDS / least))
    for turn in range(ROUNDS if tokens else 0):
        held = spark.sparkContext.broadcast(pickle.dumps((known, model.rows)))

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, held=held) -> Iterator[pa.RecordBatch]:
            own = Model(*pickle.loads(held.value))
            rng, seen, task = np.random.default_rng(turn + 1), 0, 0
            for batch in pieces(batches, "text"):
                key, kind, offs = _words(batch)
                unit = own.known.unit(key, kind)
                task = task or int(key[0])
                own.train(unit, _contexts(unit, offs, len(own.known.share)), RATES[turn], rng)
                seen += len(unit)
            if seen:
                rows = own.rows
                ranges = range(0, len(rows), ROWS)
                yield pa.record_batch([pa.array([task] * len(ranges)), pa.array(list(ranges)), pa.array([rows[k : k + ROWS].tobytes() for k in ranges], pa.binary())], ["task", "range", "raw"])

        some = texts.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == turn)
        done = some.coalesce(tasks).mapInArrow(run, "task long, range long, raw binary")
        if tasks > 1:
            done = done.groupBy("range").applyInPandas(_averaged, "range long, raw binary")
        rows = model.rows
        for r in done.select("range", "raw").toLocalIterator():  # as many rows as the vectors have ranges
            got = np.frombuffer(r["raw"], np.float32).reshape(-1, SIZE + 3)
            rows[r["range"] : r["range"] + len(got)] = got
        rows[:, -1] = 0
        model = Model(known, rows)
        held.unpersist()
    return model


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score) of each row of docs; other columns are left out, whatever their names.

    Rows for which `learn` is true are learnt from, all of them. Tokens are lower-cased (A-Z) words of non-space bytes,
    then one end. base_score is the sum of log10((c + 1) / (N + V + 1)); score is the model's log10 probability of the
    text and its end. Word counts cover all rows to learn from; the counts of the HEAD most frequent words go to every
    worker, the rest are joined, each word once a row and word, so no frequent word is a hot key. A null or empty text is
    an end alone; a null learn counts as false; rows that repeat an id are scored each by itself; with nothing to learn
    from, N and V are 0.
    """
    spark = docs.sparkSession
    docs = spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learnt"), F.col(f"`{text_col}`").cast("string").alias("text")))
    texts = docs.where("learnt").select("text")
    counts = written(texts.mapInArrow(_count, "key long, c long, kind long").groupBy("key").agg(F.sum("c").alias("c"), F.min("kind").alias("kind")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    grade = F.floor(F.log2("c") * 8)  # some hundred grades; those that together have at most HEAD words make up the head
    grades, least, held = counts.groupBy(grade.alias("g")).count().orderBy(F.desc("g")).collect(), None, 0
    for r in grades:
        held += r["count"]
        if held > HEAD:
            break
        least = r["g"]
    head = counts.where(F.lit(False) if least is None else grade >= least).select("key", "c").toArrow()
    keys, c = (head.column(x).to_numpy() for x in ("key", "c"))
    by_key = np.argsort(keys)
    keys, c = keys[by_key], c[by_key]
    enough = (F.col("c") >= max(LEAST, math.ceil(LEAST_SHARE * n))) | (F.col("key") == int(_END_KEY))
    own = counts.where(enough).select("key", "c").toArrow()  # at most 1 / LEAST_SHARE rows, and the end
    words, often = (own.column(x).to_numpy() for x in ("key", "c"))
    if _END_KEY not in words:
        words, often = np.append(words, _END_KEY), np.append(often, 0)
    mass = np.ones(KINDS)
    rare = np.zeros(KINDS)
    for r in counts.where(~enough).groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # a row a kind
        mass[r["kind"]] += r["c"] + r["v"]
        rare[r["kind"]] = r["c"]
    share = np.concatenate((often, rare)) + 1.0
    order = np.lexsort((np.concatenate((words, np.arange(KINDS))), -share))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by_word = np.argsort(words)
    known = Known(keys, c, words[by_word], rank[: len(words)][by_word], rank[len(words) :], share[order] / share.sum(), math.isqrt(len(order) - 1) + 1)
    model = fitted(texts, known, n)
    unit_mass = np.concatenate((often + 1.0, mass))[order]
    less = np.log10(unit_mass / (n + v + 1.0))
    by_unit = np.concatenate((often, np.zeros(KINDS, np.int64)))[order]
    full = spark.sparkContext.broadcast(pickle.dumps((known, model.rows, less, by_unit)))
    least = np.log10(n + v + 1.0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors, less, counted = pickle.loads(full.value)
        model, logged = Model(own, vectors), np.log10(counted + 1.0)
        for batch in pieces(batches, "text"):
            key, kind, offs = _words(batch)
            unit = own.unit(key, kind)
            context = _contexts(unit, offs, len(own.share))
            logs = np.concatenate([model.logs(unit[k : k + TOKENS], context[k : k + TOKENS]) for k in range(0, len(unit), TOKENS)])
            gain = np.add.reduceat(logs / np.log(10) - less[unit], offs[:-1])
            there, base = counted[unit] > 0, logged[unit]
            few = np.flatnonzero(~there)  # most tokens are words with vectors, whose counts go by unit
            at = np.minimum(np.searchsorted(own.keys, key[few]), max(0, len(own.keys) - 1))
            hit = own.keys[at] == key[few] if len(own.keys) else np.zeros(len(few), bool)
            there[few[hit]] = True
            base[few[hit]] = np.log10(own.counts[at[hit]] + 1.0)
            base = np.add.reduceat(base, offs[:-1])
            some = np.add.reduceat(there.astype(np.int64), offs[:-1])
            rest, ends = key[~there], np.cumsum(np.concatenate(([0], np.add.reduceat((~there).astype(np.int64), offs[:-1]))))
            tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rest))
            yield pa.record_batch([batch.column("doc_id"), batch.column("learnt"), pa.array(np.diff(offs)), pa.array(some), pa.array(base), pa.array(gain), tail], ["doc_id", "learnt", "n_tokens", "n_known", "base", "gain", "tail"])

    part = written(docs.mapInArrow(rows, "doc_id long, learnt boolean, n_tokens long, n_known long, base double, gain double, tail array<long>").withColumn("row", F.monotonically_increasing_id()), "rows")
    rare = counts.select(F.col("key").alias("word"), F.log10(F.col("c") + 1.0).alias("log"))
    tail = part.select("row", F.explode("tail").alias("key"))
    sums = tail.join(rare, tail.key == rare.word).groupBy("row").agg(F.sum("log").alias("more"), F.count("*").alias("found"))
    sums = written(sums.withColumnRenamed("row", "of"), "sums")
    drop(spark, counts.path)
    out = part.drop("tail").join(sums, F.col("row") == F.col("of"), "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(least))
    return out.select("doc_id", "learnt", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))
