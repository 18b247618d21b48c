import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import minhash
from tessella.llm.common import flat, shingle_sets, span_hashes, word_spans
from tessella.llm.components import components

import pyarrow as pa


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows):
    sets, up = [(i, shingles(t)) for i, t in rows], {}
    order = list(range(len(sets)))
    root = order[:]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in order:
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and None not in (sets[a][0], sets[b][0]) and 100 * len(x & y) >= 85 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    for a in order:
        up.setdefault(find(a), []).append(sets[a][0])
    return [(sets[a][0], len(sets[a][1]), None if sets[a][0] is None else (min(up[find(a)]) if sets[a][1] else sets[a][0])) for a in order]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ É\t\n\x0b x\x1c ", max_size=40)), min_size=1, max_size=6))
def test_sets_are_those_of_the_words(texts):
    data, offs = flat(pa.array(texts, pa.string()))
    assert [len(s) for s in shingle_sets(data, offs, 5)] == [len(shingles(t)) for t in texts]
    assert np.diff(word_spans(data, offs)[2]).tolist() == [len(words(t)) for t in texts]


def test_hashes_ignore_case_of_ascii_only():
    data, offs = flat(pa.array(["Word wORD wörd WÖRD"]))
    h = span_hashes(data, *word_spans(data, offs)[:2])[0]
    assert h[0] == h[1] and h[2] != h[3]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, ident = [], 0
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 160))]
        for _ in range(rng.choice((1, 1, 2, 6))):
            copy = base[:]
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                copy += passage
            rows.append((ident, " ".join(copy)))
            ident += 1
    rng.shuffle(rows)
    return rows


def check(spark, rows, **options):
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=85, **options).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(brute(rows), key=str)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_groups_are_those_of_all_pairs(spark, corpus):
    check(spark, corpus)


def test_large_nodes_branch_and_are_dealt(spark, corpus, monkeypatch):
    """With tiny leaves, every path of the recursion runs; nothing is lost."""
    monkeypatch.setattr(minhash, "LEAF", 4)
    check(spark, corpus)


def test_one_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LEAF", 16)
    base = [f"a{i}" for i in range(120)]
    rows = [(i, " ".join(base[: 100 + i % 3] + [f"x{i}"])) for i in range(150)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0}


def test_trees_follow_from_depth_and_recall():
    """Survival by simulation of the branching, and the trees that it asks for."""
    rng = random.Random(1)

    def meets(levels, share):
        alive = 1
        for _ in range(levels):
            alive = sum((rng.random() < share) + (rng.random() < 1 / share - 1 and rng.random() < share) for _ in range(alive))
        return alive > 0

    for levels in (1, 4, 12):
        assert abs(np.mean([meets(levels, 0.85) for _ in range(6000)]) - minhash.survival(levels, 0.85)) < 0.03
    for levels in (0, 1, 4, 8, 20):
        n = minhash.trees_for(levels, 0.85, 0.999)
        assert (1 - minhash.survival(levels, 0.85)) ** n <= 0.001 + 1e-12 and (n == 1 or (1 - minhash.survival(levels, 0.85)) ** (n - 1) > 0.001)


def test_links_at_the_threshold_in_deep_trees(spark, monkeypatch):
    """Texts alike, but below the threshold, drive the trees deep; pairs just above it are found there."""
    monkeypatch.setattr(minhash, "LEAF", 12)
    deepest, old = [], minhash._leaves
    monkeypatch.setattr(minhash, "_leaves", lambda *a, **k: (lambda x: deepest.append((x[1], len(a[1]))) or x)(old(*a, **k)))
    template = [f"t{i}" for i in range(84)]  # 80 shingles of about 100
    rows = [(i, " ".join(template + [f"o{i}x{k}" for k in range(20)])) for i in range(160)]
    rows += [(1000 + 2 * j + b, " ".join(template + [f"p{j}x{k}" for k in range(38)] + [f"q{j}{b}x{k}" for k in range(9)])) for j in range(30) for b in (0, 1)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=85).collect()}
    a, b = shingles(rows[160][1]), shingles(rows[161][1])
    assert 0.85 <= len(a & b) / len(a | b) < 0.875
    assert sum(got[1001 + 2 * j] == 1000 + 2 * j for j in range(30)) >= 29 and all(got[i] == i for i in range(160))
    assert max(levels for levels, _ in deepest) >= 8 and sum(n for _, n in deepest[1:]) > minhash.TREES[1]


def test_few_rounds_and_turns_for_deep_trees(spark, monkeypatch):
    """Each round and turn is a fixed number of jobs: levels are branched two at a time, and trees of nine levels need no further turn."""
    monkeypatch.setattr(minhash, "LEAF", 90)
    depths, names, old, write = [], [], minhash._leaves, minhash.written
    monkeypatch.setattr(minhash, "_leaves", lambda *a, **k: (lambda x: depths.append(x[1]) or x)(old(*a, **k)))
    monkeypatch.setattr(minhash, "written", lambda df, name: names.append(name) or write(df, name))
    template = [f"t{i}" for i in range(84)]
    rows = [(i, " ".join(template + [f"o{i}x{k}" for k in range(20)])) for i in range(160)]
    rows += [(1000 + 2 * j + b, " ".join(template + [f"p{j}x{k}" for k in range(38)] + [f"q{j}{b}x{k}" for k in range(9)])) for j in range(30) for b in (0, 1)]
    check(spark, rows)
    assert len(depths) == 2 and 5 <= depths[1] <= 9
    assert names.count("front") - 1 <= 1 + depths[1] // 2


def test_sets_of_one_first_key_stay_apart(spark, corpus, monkeypatch):
    """Classes are told apart by both keys: where the first is the same for all, nothing is joined wrongly."""
    keys = minhash._set_keys
    monkeypatch.setattr(minhash, "_set_keys", lambda sets: [pa.array(np.zeros(len(sets), np.int64)), keys(sets)[1]])
    check(spark, corpus[:60])


def test_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = minhash.near_duplicates(odd, threshold=85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(brute(rows), key=str)


def test_empty_table(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.distinct_documents(empty).count() == 0


def test_one_of_each_group_stays(spark, odd):
    left = minhash.distinct_documents(odd)
    assert left.columns == odd.columns
    clash = odd.selectExpr("*", "1 AS gone_id", "2 AS twice_id", "3 AS row_id", "4 AS gone_hash")
    assert minhash.distinct_documents(clash).count() == left.count()
    got = [(r["doc_id"], r["text"]) for r in left.select("doc_id", "text").collect()]
    ids = [i for i, _ in got]
    assert sorted(i for i in ids if i is not None and i <= 3) == [1] and 8 not in ids and {4, 5, 6, 7, 9, 13, 14} <= set(ids) and None in ids
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "A b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert minhash.distinct_documents(twice).count() == 1


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
