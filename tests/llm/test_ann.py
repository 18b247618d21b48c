import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann


def brute(rows, asked, k):
    """The k nearest by cosine in double precision, ties to the smaller id."""
    fine = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in fine:
        if q in asked:
            near = sorted(((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 12), i) for i, y in fine if i != q))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_hadamard_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(ann.hadamard(ann.hadamard(x)), x) and np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_nearest_signed_axes():
    x = np.array([[0.1, -0.9, 0.3, 0.0], [0.5, 0.4, -0.6, 0.0]])
    assert ann.axes(x, 3).tolist() == [[5, 2, 0], [6, 0, 1]]


def test_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    rows = [(i, [float(np.float32(v)) for v in centres[i % 40] + 0.6 * rng.normal(size=24)]) for i in range(1500)]
    df = table(spark, rows)
    got = found(ann.neighbours(df, df.where(F.col("vec_id") % 50 == 0)))
    want = brute(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    hits = [(i in dict(got[q]), i, q, s) for q, near in want.items() for i, s in near]
    assert np.mean([h[0] for h in hits]) >= 0.9
    assert all(abs(dict(got[q])[i] - s) < 1e-9 for ok, i, q, s in hits if ok)


def test_hot_vectors_and_blocks(spark, monkeypatch):
    """Copies, many more than the answers, in blocks that are dealt out; ties go to smaller ids."""
    monkeypatch.setattr(ann, "BLOCK", 8)
    rng = np.random.default_rng(4)
    hot = [1.0, 2.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0]
    rows = [(i, hot if i % 3 == 0 else [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    df = table(spark, rows)
    got = found(ann.neighbours(df, df.where("vec_id % 50 = 0")))
    want = brute(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    assert [i for i, _ in got[0]] == [3, 6, 9, 12, 15] and [i for i, _ in got[150]] == [0, 3, 6, 9, 12]
    assert np.mean([i in dict(got[q]) for q, near in want.items() for i, _ in near]) >= 0.9


@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_recall_of_the_default_parameters(spark, hashes):
    """The query's own settings with one, two and three hashes; neighbours at a cosine near 0.55, as among millions of random vectors."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(500, 64))
    rows = [(i, [float(np.float32(v)) for v in (centres[i // 6] if i % 6 == 0 else centres[i // 6] + 1.5 * rng.normal(size=64))]) for i in range(3000)]
    df = table(spark, rows)
    got = found(ann.neighbours(df, df.where("vec_id % 30 = 0"), hashes=hashes))
    want = brute(rows, {i for i, _ in rows if i % 30 == 0}, 5)
    assert 0.5 < np.mean([s for near in want.values() for _, s in near]) < 0.6
    assert np.mean([i in dict(got.get(q, [])) for q, near in want.items() for i, _ in near]) >= 0.9


@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_probes_are_the_combinations_of_largest_sums(hashes):
    signs = ann.rotations(4, hashes, 1)
    unit = np.random.default_rng(2).normal(size=(6, 4))
    for row, own in zip(unit, ann.buckets(unit, signs, hashes, 20)):
        sums = [np.concatenate((x, -x)) for x in (ann.rotate(row[None], s)[0] for s in signs)]
        every = {sum(a * 8**k for k, a in enumerate(c)): sum(s[a] for s, a in zip(sums, c)) for c in itertools.product(range(8), repeat=hashes)}
        want = sorted(every.values(), reverse=True)[: len(own)]
        assert len(set(own.tolist())) == min(20, 8**hashes) and np.allclose([every[b] for b in own.tolist()], want)
        assert np.allclose(sorted((every[b] for b in ann.buckets(row[None], signs, hashes, 20, ordered=False)[0].tolist()), reverse=True), want)


def test_double_vectors(spark):
    """Components that differ beyond single precision make different vectors."""
    rows = [(i, [1.0, 0.1 + i * 1e-10]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.neighbours(df, df.where("vec_id = 0")))
    assert sorted(i for i, _ in got[0]) == [1, 2, 3, 4, 5]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 1.0]), (7, [2.0, 0.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (0, [1.0, 0.0]), (9, [-0.0, -1.0]), (10, [0.0, -1.0])]
    rows.append((11, [None, 1.0]))
    df = table(spark, rows).selectExpr("*", "'x' AS class", "'x' AS rank", "'x' AS score", "0 AS t")
    got = found(ann.neighbours(df, df.where("vec_id IN (0, 1, 2, 8, 9)"), recall=1.0))
    assert set(got) == {0, 9} and [i for i, _ in got[0]] == [7, 6, 9, 10] and [i for i, _ in got[9]][0] == 10


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0])]])
def test_nothing_to_find(spark, rows):
    df = table(spark, rows)
    assert ann.neighbours(df, df).count() == 0
