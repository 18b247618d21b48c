"""Mixing to target weights: soft domain membership, and document rates fitted by distributed projected-gradient least squares."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import flat, smallest, span_hashes, texts_of, word_spans, written

#: Labelled texts of each domain that the classifier is fitted on at most, those whose ids have the smallest hashes; longer
#: texts than EXAMPLE_BYTES are no examples.
SAMPLE, EXAMPLE_BYTES = 2500, 1 << 18
#: Buckets of hashed words and of hashed five-byte word beginnings, and the style features beside them.
BUCKETS, STYLE = 1 << 15, 8
#: Full passes of the classifier's training, and the weight of its penalty.
PASSES, PENALTY = 40, 1e-4
#: Bytes of example texts whose words are counted at once.
FIT_BYTES = 2 << 20
#: Steps towards targets out of reach, the lengths of gradient tried in each (powers of four), and the relative miss that ends all.
STEPS, LENGTHS, CLOSE = 25, 7, 1e-6
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words' two features, each word's text, the weight of a text's words, style features, and words of each text."""
    starts, ends, own = word_spans(data, offs)
    n = np.diff(own)
    words, begin = span_hashes(data, starts, ends, np.minimum(ends, starts + 5))
    buckets = np.stack(((words >> np.uint64(49)).astype(np.int32), (begin >> np.uint64(49)).astype(np.int32) + BUCKETS), 1)
    text = np.repeat(np.arange(len(n), dtype=np.int32), n)
    each = np.maximum(n, 1)
    size = np.maximum(np.diff(offs), 1)
    count = lambda mask: np.diff(np.searchsorted(np.flatnonzero(mask), offs)) / size
    again = lambda k: np.bincount(text[:-k][(words[k:] == words[:-k]) & (text[k:] == text[:-k])], minlength=len(n)) / each * 3
    style = [np.bincount(text, ends - starts, len(n)) / each / 10, count(_UPPER[data]) * 4, count(_LETTER[data]) * 4, again(1), again(2), again(3), np.log1p(n) / 5, count((data == 33) | (data == 63)) * 10]
    return buckets, text, 1 / np.sqrt(each), np.stack(style, 1), n


@dataclass
class Classifier:
    domains: list[str]
    words: np.ndarray
    style: np.ndarray
    bias: np.ndarray

    def posteriors(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p(domain | text) of each text, and its words."""
        buckets, text, weight, style, n = features(data, offs)
        logits = style @ self.style + self.bias
        if len(text):
            sums = self.words[buckets[:, 0]] + self.words[buckets[:, 1]]
            some = np.flatnonzero(n)
            logits[some] += np.add.reduceat(sums, np.concatenate(([0], np.cumsum(n[some])[:-1])), axis=0) * weight[some, None]
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(1, keepdims=True), n


def fit(examples: list[tuple[str, str]], prior: dict[str, float] | None = None) -> Classifier:
    """A softmax regression of (text, domain) examples, with class shares corrected to `prior`."""
    domains = sorted({d for _, d in examples})
    rows, cols, values, styles = [], [], [], []
    raw = [t.encode() for t, _ in examples]
    at = 0
    while at < len(raw):  # a few MB of text at a time bound the driver's memory
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= FIT_BYTES):
            size, end = size + len(raw[end]), end + 1
        offs = np.concatenate(([0], np.cumsum([len(x) for x in raw[at:end]]))).astype(np.int64)
        buckets, text, weight, style, _ = features(np.frombuffer(b"".join(raw[at:end]), np.uint8), offs)
        pairs, n = np.unique((text[:, None].astype(np.int64) * (2 * BUCKETS) + buckets).ravel(), return_counts=True)
        here = pairs // (2 * BUCKETS)
        rows.append((here + at).astype(np.int32))
        cols.append((pairs % (2 * BUCKETS)).astype(np.int32))
        values.append((n * weight[here]).astype(np.float32))
        styles.append(style)
        at = end
    n = np.zeros(len(raw))
    y = np.array([[d == x for x in domains] for _, d in examples], float)
    share = y.mean(0)
    row, value, style = np.concatenate(rows), np.concatenate(values), np.concatenate(styles)
    used, col = np.unique(np.concatenate(cols), return_inverse=True)
    col = col.astype(np.int32)
    del rows, cols, values, raw
    m = Classifier(domains, np.zeros((len(used), len(domains))), np.zeros((STYLE, len(domains))), np.log(np.maximum(share, 1e-9)))
    sums = [np.full_like(x, 1e-8) for x in (m.words, m.style, m.bias)]
    for _ in range(PASSES if len(domains) > 1 else 0):
        logits = style @ m.style + m.bias
        for k in range(len(domains)):
            logits[:, k] += np.bincount(row, m.words[col, k] * value, len(n))
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        e = (p / p.sum(1, keepdims=True) - y) / len(n)
        grads = np.stack([np.bincount(col, e[row, k] * value, len(used)) for k in range(len(domains))], 1) + PENALTY * m.words, style.T @ e + PENALTY * m.style, e.sum(0)
        for x, g, s in zip((m.words, m.style, m.bias), grads, sums):
            s += g * g
            x -= 0.3 * g / np.sqrt(s)
    words = np.zeros((2 * BUCKETS, len(domains)), np.float32)
    words[used] = m.words
    if prior and len(domains) > 1:
        m.bias += np.log(np.maximum([prior.get(d, 0.0) for d in domains], 1e-9)) - np.log(share)
    return Classifier(domains, words, m.style, m.bias)


def learn(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """The classifier of the labelled table (id, domain): fitted on a bounded sample, with the shares of the whole table.

    A document with several domains counts for the first by name. Labels of documents that are not there, and null ones, count for nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") <= EXAMPLE_BYTES)
    named = labelled.where("domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    there = rows.select("doc_id").distinct().join(named, "doc_id")
    shares = {r["domain"]: r["count"] for r in there.groupBy("domain").count().collect()}
    chosen = None
    for d in sorted(shares):
        part = smallest(there.where(F.col("domain") == d), "doc_id", SAMPLE, shares[d])
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return fit([("", "")])
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long, domain string")  # SAMPLE rows a domain
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    examples = sorted((r["doc_id"], r["text"], r["domain"]) for r in texts.toLocalIterator())
    total = sum(shares.values())
    return fit([(t, d) for _, t, d in examples], {d: n / total for d, n in shares.items()})


def memberships(docs: DataFrame, model: Classifier, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept, n_tokens, p) of each row: words, and posteriors in the order of the model's domains; kept is a struct of `keep`."""
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rows, cut, fields = texts_of(docs, id_col, text_col, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(held.value)
        for batch, others in cut(batches):
            p, n = own.posteriors(*flat(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield pa.record_batch([*others, pa.array(n), lists], [*fields.names, "n_tokens", "p"])

    return rows.mapInArrow(run, StructType([*fields, StructField("n_tokens", LongType()), StructField("p", ArrayType(DoubleType()))]))


def rates(members: DataFrame, domains: list[str], targets: dict[str, float], total: float | None = None) -> DataFrame:
    """The rows of (…, n_tokens, p) with `rate`: how often each should stand in the mix.

    Minimises |sum over rows of rate * n_tokens * p - targets|^2 by projected gradient from rate 1, in the metric of the
    memberships' scatter over the rows that still have a rate, S = sum of n p p': rate = max(0, rate + p . S^-1 (targets -
    sums)). Where that stalls, steps begin anew, each the one that comes nearest of two in that metric and of LENGTHS plain
    gradient steps rate = max(0, rate + t p . (targets - sums)), the shortest of which always comes nearer; one aggregate
    tries them all. An aggregate holds a few numbers for each pair of domains; the rows never leave their partitions, and
    a row's rate is computed from its posteriors and the steps so far. Targets are shares of `total` tokens (all there
    are, if not given); a domain without a target has 0. Targets out of reach are neared for STEPS steps, without a proof
    of the optimum: the frame's `missed` holds what the sums lack of each domain's target, as a share of all tokens.
    Rows without tokens keep the rate that their posteriors give; without any tokens, all rates are 1 and there is no `missed`.
    """
    k = len(domains)
    n = F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def moved(g: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), F.col("rate") + sum(F.col("p")[i] * float(g[i]) for i in range(k)))

    def sums(rate: Column, name: str) -> list[Column]:
        active = F.when(rate > 0, n).otherwise(0.0)
        return [*(F.sum(rate * n * F.col("p")[i]).alias(f"{name}t{i}") for i in range(k)), *(F.sum(active * F.col("p")[i] * F.col("p")[j]).alias(f"{name}s{i}_{j}") for i, j in pairs)]

    def read(row: Row, name: str) -> tuple[np.ndarray, np.ndarray]:
        s = np.zeros((k, k))
        for i, j in pairs:
            s[i, j] = s[j, i] = row[f"{name}s{i}_{j}"]
        return want - np.array([row[f"{name}t{i}"] for i in range(k)]), s

    scaled = lambda s, miss: np.linalg.pinv(s, rcond=1e-9, hermitian=True) @ miss
    start = now = members.withColumn("rate", F.lit(1.0))
    row = now.agg(F.sum(n).alias("all"), *sums(F.col("rate"), "")).first()
    if not row["all"]:
        return now
    weight = np.array([targets.get(d, 0.0) for d in domains])
    want = weight / weight.sum() * (total or row["all"])
    size = lambda miss: float(np.abs(miss).max() / row["all"])
    first = miss, scatter = read(row, "")
    best, stalled = float("inf"), 0
    while size(miss) > CLOSE and stalled < 3:
        stalled = 0 if size(miss) < 0.9 * best else stalled + 1
        best = min(best, size(miss))
        now = now.withColumn("rate", moved(scaled(scatter, miss)))
        miss, scatter = read(now.agg(*sums(F.col("rate"), "")).first(), "")
    if size(miss) > CLOSE:  # out of reach, or steps too long: from the start again, by the best of several
        now, (miss, scatter) = start, first
        longest = np.linalg.eigvalsh(scatter)[-1]
        for _ in range(STEPS):
            steps = [scaled(scatter, miss), scaled(scatter, miss) / 2, *(miss * (4.0**j / longest) for j in range(LENGTHS))]
            tried = now.select("n_tokens", "p", "rate", *(moved(g).alias(f"r{c}") for c, g in enumerate(steps)))
            row_now = tried.agg(*(x for c in range(len(steps)) for x in sums(F.col(f"r{c}"), f"c{c}_"))).first()
            found = [read(row_now, f"c{c}_") for c in range(len(steps))]
            c = min(range(len(steps)), key=lambda c: np.linalg.norm(found[c][0]))
            if np.linalg.norm(found[c][0]) >= np.linalg.norm(miss):
                break
            now, (miss, scatter) = now.withColumn("rate", moved(steps[c])), found[c]
            if size(miss) <= CLOSE:
                break
    now.missed = dict(zip(domains, (miss / row["all"]).tolist()))
    return now


def copies(rate: Column, *ident: Column) -> Column:
    """How many copies stand for a rate: its whole part, and one more for a share of the ids that is its fraction."""
    draw = F.pmod(F.xxhash64(*ident, F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """(id, kept, n_tokens, p, rate, copies) of each row of docs, and the domains in the order of p.

    kept is a struct of the columns in `keep`, so that no name can clash; without `keep`, there is none. Posteriors come from the text alone; tokens are words. A null or empty text has no tokens and the posteriors of the
    shares of the labelled table; a null id draws like any other; rows that repeat an id are rows of their own. With no
    labels, there is one domain, and rates are the same for all; an empty table gives an empty result.
    """
    model = learn(docs, labelled, id_col, text_col)
    members = written(memberships(docs, model, id_col, text_col, keep), "members")
    fitted = rates(members, model.domains, targets if set(targets) & set(model.domains) else {d: 1.0 for d in model.domains})
    return fitted.withColumn("copies", copies(F.col("rate"), F.col("id"))), model.domains
