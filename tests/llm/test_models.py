"""Toxicity, language, language-model and mixing operators."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import langid, lm, mixing, toxicity
from tessella.llm.common import fold

import pyarrow as pa


@pytest.fixture(scope="module")
def examples():
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in ("ban", "cor", "del", "fin", "gom", "hul") for b in ("an", "er", "is", "ot", "um", "ax", "eb")]
    out = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(10, 80))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(("vileword", "crudething", "meanspeak")) + rng.choice(("", "s", "est"))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_nearest_are_exact(examples):
    """Block-max search over all words returns what a comparison with every example does, ties included."""
    examples = [*examples, *((1000 + i, t, y) for i, t, y in examples[:40])]
    m = toxicity.fit(examples)
    assert len(m.toxic) == len(examples) > toxicity.BLOCK * toxicity.ROUNDS[0]
    words = sorted({w for _, t, _ in examples for w in toxicity.features(t)})
    assert set(words) == set(m.ids)

    def vector(text):
        x = np.array([toxicity.features(text)[w] for w in words], float)
        x = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * m.weight[[m.ids[w] for w in words]]
        return x / (np.sqrt((x * x).sum()) or 1)

    text = {i: t for i, t, _ in examples}
    dense = np.array([vector(text[int(i)]) for i in m.example])
    assert [dict((i, y) for i, _, y in examples)[int(i)] for i in m.example] == m.toxic.tolist()
    for query in [*(t for _, t, _ in examples[:120]), "banan corer delis", "vileword", "nothing known", "banan " * 3000]:
        terms, w = m.vector(toxicity.features(query))
        every = dense @ vector(query)
        order = np.lexsort((np.arange(len(every)), -np.round(every, 12)))[: toxicity.NEIGHBOURS]
        order = order[every[order] > 1e-9]
        who, score = m.nearest(terms, w) if len(terms) else (np.zeros(0, int), np.zeros(0))
        assert who.tolist() == order.tolist()
        assert np.allclose(score, every[order])


def test_weights_rise_with_rarity_and_gain():
    """idf * sqrt(TELLING + gain), the gain of two by two tables; no word weighs nothing."""
    df, pro = np.array([1, 50, 50, 100, 1]), np.array([1, 50, 25, 50, 0])
    w = toxicity._weights(df, pro, 50, 50)
    assert w.min() > 0 and w[1] == w.max() and w[2] == min(w) or w[3] == min(w)
    gain = 50 * math.log(1 / 0.5) * 2
    assert math.isclose(w[1], (math.log(101 / 51) + 1) * math.sqrt(1e-3 + gain))
    assert toxicity._weights(df, pro, 100, 0).min() > 0


def test_a_copy_of_the_only_example_of_its_words(examples):
    """A text that stands once among the toxic examples, in words that no other has, makes its copy toxic."""
    alone = "qumrin solvak tirpel wendas yoblik zarnuf quelph drisko"
    m = toxicity.fit([*examples, (5000, alone, 1)])
    score, who, near = m.score(alone)
    assert score >= 0.5 and m.example[who[0]] == 5000 and near[0] > 0.999


def test_toxicity_on_held_out_texts(examples):
    m = toxicity.fit(examples[:300])
    scores = [m.score(t)[0] for _, t, _ in examples[300:]]
    assert all((s >= 0.5) == bool(y) for s, (_, _, y) in zip(scores, examples[300:]))
    assert m.score("")[0] < 0.5 and m.score("something else")[0] < 0.5


def test_copies_count_once_in_weights(examples):
    copied = [(1000 + i, "rareword " + examples[1][1], 1) for i in range(60)]
    one, many = (toxicity.fit([*examples, *copied[:n]]) for n in (1, 60))
    assert math.isclose(one.weight[one.ids["rareword"]], many.weight[many.ids["rareword"]])
    assert len(many.toxic) == len(examples) + 60


@pytest.mark.parametrize("labels", [[], [(1, "a b c", 0)], [(1, "a b c", 1)], [(1, "", 0), (2, "", 1)]])
def test_toxicity_with_few_examples(labels):
    m = toxicity.fit(labels)
    assert 0 <= m.score("a b c")[0] <= 1 and 0 <= m.score("")[0] <= 1


def test_toxicity_table(spark, odd, empty, examples):
    m = toxicity.fit(examples)
    got = toxicity.score(odd, m, keep=tuple(odd.columns))
    assert got.select("kept.*").columns == odd.columns and sorted(map(str, got.select("kept.*").collect())) == sorted(map(str, odd.collect()))
    assert got.count() == odd.count() and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.score(empty, m).count() == 0
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (99, 1), (9, None)], "doc_id long, toxic int")
    assert toxicity.sample(odd, labels) == [(1, odd.where("doc_id = 1").first()["text"], 0)]
    assert toxicity.sample(empty, labels) == [] and toxicity.sample(odd, labels.limit(0)) == []
    more = spark.createDataFrame([(1, 0, 5), (3, 1, 5), (11, 1, 5), (None, 1, 5)], "doc_id long, toxic int, text int")
    assert {i for i, _, _ in toxicity.sample(odd, more)} == {1, 3, 11}
    assert len(toxicity.sample(odd, more, all_bytes=200)) == 2 and len(toxicity.sample(odd, more, most={1: 1, 0: 1})) == 2


# -- language --------------------------------------------------------------------------------------------


def naive_grams(text):
    padded = " " + re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0].isalpha() else " ", text.lower(), flags=re.S) + " "
    padded = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in padded))
    out = Counter()
    for k in range(len(padded)):
        for n in (1, 2, 3):
            g = padded[k : k + n]
            if len(g) == n and g.strip() and " " not in g[1:-1] and not (n == 1 and g == " "):
                out[g] += 1
    return out


def decoded(codes, alphabet):
    words = langid.spelled(codes, alphabet)
    return Counter("".join(chr((int(w) >> (21 * i)) & 0x1FFFFF) for i in range(3) if (int(w) >> (21 * i)) & 0x1FFFFF) for w in words)


@pytest.mark.parametrize("text", ["a", "Hello, World", "  ab  ", "x1y2", "日本 語", "", "123", "éÉ ß", "a\x00b", "I’m"])
def test_grams_are_those_of_padded_words(text):
    points, offs = langid.padded([text, "other", text])
    codes, alphabet = langid._inside(points, offs)
    for d, t in enumerate((text, "other", text)):
        own = codes[offs[d] : offs[d + 1]].ravel()
        assert decoded(own[own >= 0], alphabet) == naive_grams(t)


def naive_distance(text, profile, size):
    top = [g for g, _ in sorted(naive_grams(text).items(), key=lambda x: (-x[1], sum(ord(c) << (21 * i) for i, c in enumerate(x[0]))))][:size]
    rank = {g: i for i, g in enumerate(profile)}
    return sum(abs(i - rank[g]) if g in rank else size for i, g in enumerate(top)) / (size * len(top)) if top else float("nan")


def test_distances_are_out_of_place(spark):
    texts = ["the cat sat on the mat and the dog ran to the man", "le chat est sur la table et le chien dort dans la maison", "der hund ist im haus und die katze auf dem tisch"]
    docs = spark.createDataFrame([(i, t * 3, lang) for i, (t, lang) in enumerate(zip(texts, ("en", "fr", "de")))] + [(9, None, "en"), (8, "no language", None)], "doc_id long, text string, lang string")
    known = langid.profiles(docs, size=40)
    want = {lang: [g for g, _ in sorted(naive_grams(t * 3).items(), key=lambda x: (-x[1], sum(ord(c) << (21 * i) for i, c in enumerate(x[0]))))][:40] for t, lang in zip(texts, ("en", "fr", "de"))}
    spell = lambda code: "".join(chr((int(code) >> (21 * i)) & 0x1FFFFF) for i in range(3) if (int(code) >> (21 * i)) & 0x1FFFFF)
    assert {k: [spell(c) for c in v] for k, v in known.items()} == want
    langs = sorted(known)
    asked = ["the man and the cat", "", "la maison et le chat", "x"]
    got = langid.distances(*langid.padded(asked), [known[k] for k in langs], size=40)
    for t, row in zip(asked, got):
        assert np.allclose(row, [naive_distance(t, want[k], 40) for k in langs], equal_nan=True)


def test_language_table(spark, odd, empty):
    known = langid.profiles(odd)
    got = {r["id"]: r for r in langid.identify(odd, known, keep=tuple(odd.columns)).collect()}
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == got[10]["lang_pred"] == "und" and got[4]["score"] == 0
    assert got[11]["lang_pred"] == "fr" and got[12]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(empty, known).count() == 0 and langid.profiles(empty) == {}
    assert {r["lang_pred"] for r in langid.identify(odd, {}, id_col="doc_id").collect()} == {"und"}


def test_language_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = fold(F.col("doc_id"), 3) == 1
    got = langid.identify(docs.where(out), langid.profiles(docs.where(~out)), keep=("lang",)).select((F.col("kept.lang") == F.col("lang_pred")).cast("double").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got > 0.97


# -- language model --------------------------------------------------------------------------------------


def test_scores_of_counts(spark, odd):
    got = lm.score(odd, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))).collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    counts = Counter(x for i, t in rows if i is not None and i % 2 == 0 for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((i if i is not None else -1, len(tokens(t)), sum(x in counts for x in tokens(t)), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}


def test_rare_words_are_joined(spark, odd, monkeypatch):
    whole = sorted((r["doc_id"] or -1, r["n_known"], round(r["base_score"], 6), round(r["score"], 4)) for r in lm.score(odd, F.lit(True)).collect())
    monkeypatch.setattr(lm, "HEAD", 3)
    few = sorted((r["doc_id"] or -1, r["n_known"], round(r["base_score"], 6)) for r in lm.score(odd, F.lit(True)).collect())
    assert few == [x[:3] for x in whole]


@pytest.fixture
def seen(monkeypatch):
    """The models that lm.score fits, and words with vectors from two occurrences on."""
    monkeypatch.setattr(lm, "LEAST", 2)
    models, old = [], lm.fitted
    monkeypatch.setattr(lm, "fitted", lambda *a: models.append(old(*a)) or models[-1])
    return models


def naive_logs(model, history):
    """ln p of every unit after a history, written out: two softmaxes over dot products."""
    rows, (r0, q0, c0, m0, end) = model.rows.astype(float), model.parts
    size, units = lm.SIZE, len(model.known.share)
    h = np.zeros(size)
    for j in range(lm.CONTEXT):
        u = history[-1 - j] if j < len(history) else units
        for x in range(size):
            h += rows[r0 + u, x] * rows[m0 + j * size + x, :size]
    classes = [rows[c0 + k, :size] @ h + rows[c0 + k, size] for k in range(model.known.classes)]
    out = []
    for u in range(units):
        k = u // model.known.width
        own = [rows[q0 + x, :size] @ h + rows[q0 + x, size] for x in range(k * model.known.width, min(units, (k + 1) * model.known.width))]
        out.append(classes[k] - math.log(sum(math.exp(x) for x in classes)) + rows[q0 + u, :size] @ h + rows[q0 + u, size] - math.log(sum(math.exp(x) for x in own)))
    return np.array(out)


def test_scores_are_the_model_s(spark, seen):
    """Probabilities of all units add up to one after any history, those of a unit's tokens to its own; scores are their logs."""
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdef" for b in ("ta", "ke", "mi")]
    docs = [(i, " ".join(rng.choice(words[: 6 + 4 * (i % 3)]) for _ in range(rng.randint(0, 12)))) for i in range(40)] + [(40, "new WORDS ata"), (41, None), (42, "once")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(df, F.col("doc_id") < 40).collect()}
    m = seen[0]
    counts = Counter(w for i, t in docs[:40] for w in [*(t or "").split(), None])
    raw = lambda w: np.frombuffer(w.encode(), np.uint8)
    key = lambda w: int(lm.word_hashes(raw(w), np.array([0]), np.array([len(w)])).view(np.int64)[0]) if w else -1
    kind = lambda w: int(lm._kinds(raw(w), np.array([0]), np.array([len(w)]))[0]) if w else 0
    unit = lambda w: int(m.known.unit(np.array([key(w)]), np.array([kind(w)]))[0])
    mass = Counter()
    for w, c in counts.items():
        mass[unit(w)] += c + 1
    own = {unit(w) for w, c in counts.items() if c >= 2 or w is None}
    for u in set(m.known.kinds.tolist()):
        mass[u] += 1
    assert not own & set(m.known.kinds.tolist()) and len(own) == len(m.known.words)
    for i in (0, 1, 2, 5, 40, 41, 42):
        history, want = [], 0.0
        for w in [*re.findall(r"\S+", (docs[i][1] or "").lower()), None]:
            logs = naive_logs(m, history)
            assert abs(np.exp(logs).sum() - 1) < 1e-6
            want += (logs[unit(w)] + math.log((counts[w] + 1) / mass[unit(w)])) / math.log(10)
            history.append(unit(w))
        assert abs(got[i]["score"] - want) < 1e-3
    assert all(abs(sum((c + 1) / mass[u] for w, c in counts.items() if unit(w) == u) + (u in m.known.kinds) / mass[u] - 1) < 1e-9 for u in mass)


@pytest.mark.parametrize("weighted", [True, False])
def test_gradients_of_a_row_add_up(weighted):
    """Gradients are made from rows and weights in the order of their sums; the sums are those of a loop."""
    rng = np.random.default_rng(3)
    known = lm.Known(*(np.zeros(0, np.int64),) * 5, np.full(40, 1 / 40), 7)
    model, past = lm.Model(known), lm.Model(known)
    at = rng.integers(0, 50, 300)
    of = rng.integers(0, 90, 300) if weighted else np.arange(300)
    source, weight, bias = (rng.normal(size=x).astype(np.float32) for x in ((90 if weighted else 300, lm.SIZE), 300, 300))
    model._update(at, source, 0.1, of, weight, bias) if weighted else model._update(at, source, 0.1)
    for row in range(len(past.bias)):
        some = at == row
        g = (source[of[some]].astype(float) * (weight[some, None] if weighted else 1)).sum(0)
        total = past.past[row] + (g**2).sum() / lm.SIZE
        assert np.allclose(model.vectors[row], past.vectors[row] + 0.1 * g / total**0.5, atol=1e-5) and np.isclose(model.past[row], total, rtol=1e-4)
        assert np.isclose(model.bias[row], past.bias[row] + (bias[some].sum() * min(0.1 / total**0.5, 0.05) if weighted else 0), atol=1e-4) and model.met[row] == some.sum()


def test_training_in_several_tasks(spark, small, monkeypatch):
    """Tasks that are averaged learn, too."""
    docs = spark.read.parquet(f"{small.removesuffix('0.001')}0.01/documents.parquet").repartition(4)
    monkeypatch.setattr(lm, "TASK_TOKENS", 30_000)
    monkeypatch.setattr(lm, "TOKENS_A_UNIT", 1)
    got = lm.score(docs, F.lit(True)).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.05


def test_model_beats_counts(spark, small):
    """On held-out texts of a table of 1,000, by more than 0.15 in log10 a token."""
    docs = spark.read.parquet(f"{small.removesuffix('0.001')}0.01/documents.parquet")
    held = fold(F.col("doc_id"), 7) == 2
    got = lm.score(docs, ~held).where("NOT learnt").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.15


def test_language_model_of_nothing(spark, odd, empty):
    assert lm.score(empty, F.lit(True)).count() == 0
    got = lm.score(odd, F.lit(None).cast("boolean")).collect()
    assert len(got) == odd.count() and {r["train_tokens"] for r in got} == {0} and all(r["n_known"] == 0 for r in got)


# -- mixing ----------------------------------------------------------------------------------------------


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet((0.4, 0.4, 0.4), 500)
    rows = [(i, int(n), [float(x) for x in q]) for i, (n, q) in enumerate(zip(rng.integers(0, 300, 500), p))]
    members = spark.createDataFrame(rows, "id long, n_tokens long, p array<double>")
    got = mixing.rates(members, ["a", "b", "c"], {"a": 0.7, "b": 0.25, "c": 0.05}).collect()
    total = sum(r["n_tokens"] for r in got)
    sums = np.sum([np.array(r["p"]) * r["rate"] * r["n_tokens"] for r in got], axis=0) / total
    assert np.allclose(sums, (0.7, 0.25, 0.05), atol=1e-4) and all(r["rate"] >= 0 for r in got)


def test_rates_of_targets_out_of_reach(spark):
    members = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 10, [0.5, 0.5])], "id long, n_tokens long, p array<double>")
    got = mixing.rates(members, ["a", "b"], {"b": 1.0}).collect()
    assert all(r["rate"] >= 0 and math.isfinite(r["rate"]) for r in got)
    none = mixing.rates(members.withColumn("n_tokens", F.lit(0)), ["a", "b"], {"b": 1.0}).collect()
    assert {r["rate"] for r in none} == {1.0}


def _nonnegative(a, b):
    """Brute-force nonnegative least squares of a x = b, for few rows of a: the nearest of all mixes of independent columns."""
    from itertools import combinations

    best = np.zeros(len(b))
    for k in range(1, len(b) + 1):
        for some in combinations(range(a.shape[1]), k):
            x = np.linalg.lstsq(a[:, some], b, rcond=None)[0]
            if (x >= 0).all() and np.linalg.norm(a[:, some] @ x - b) < np.linalg.norm(best - b):
                best = a[:, some] @ x
    return best


@pytest.mark.parametrize("targets", [(0.3, 0.4, 0.3), (0.9, 0.05, 0.05), (1.0, 0.0, 0.0), (0.0, 0.5, 0.5), (0.5, 0.5, 0.0)])
def test_rates_are_least_squares(spark, targets):
    """The mix comes within 0.01 of the distance of brute-force nonnegative least squares, and meets targets in reach; `missed` says what it lacks."""
    rng = np.random.default_rng(5)
    p, n = rng.dirichlet((2.0, 2.0, 2.0), 30), rng.integers(1, 300, 30)
    members = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(30)], "id long, n_tokens long, p array<double>")
    fitted = mixing.rates(members, ["a", "b", "c"], dict(zip("abc", targets)))
    got = fitted.collect()
    assert all(r["rate"] >= 0 for r in got)
    want = np.array(targets)
    a = (p * n[:, None] / n.sum()).T
    mine = a @ [r["rate"] for r in sorted(got, key=lambda r: r["id"])]
    assert np.allclose([fitted.missed[d] for d in "abc"], want - mine, atol=1e-9)
    far = np.linalg.norm(_nonnegative(a, want) - want)
    assert np.linalg.norm(mine - want) <= far + (0.01 if far > 1e-6 else 1e-5)


def test_posteriors_on_held_out_texts():
    rng = random.Random(3)
    make = lambda words: " ".join(rng.choice(words) for _ in range(40))
    a, b = ["red", "green", "blue", "and"], ["one", "two", "three", "and"]
    rows = [(make(a), "colour") for _ in range(60)] + [(make(b), "number") for _ in range(60)]
    m = mixing.fit(rows)
    texts = [make(a), make(b), "", make(a + b)]
    raw = [t.encode() for t in texts]
    p, n = m.posteriors(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
    assert m.domains == ["colour", "number"] and p[0, 0] > 0.9 and p[1, 1] > 0.9 and np.allclose(p.sum(1), 1) and n.tolist() == [40, 40, 0, 40]


def test_copies(spark):
    df = spark.range(20_000).select("id", mixing.copies(F.lit(1.3), F.col("id")).alias("c"), mixing.copies(F.lit(0.0), F.col("id")).alias("z"))
    r = df.agg(F.min("c"), F.max("c"), F.avg("c"), F.max("z")).first()
    assert (r[0], r[1], r[3]) == (1, 2, 0) and abs(r[2] - 1.3) < 0.02


def test_mixing_table(spark, odd, empty):
    labels = spark.createDataFrame([(1, "a"), (11, "b"), (12, "b"), (7, None), (1, "b"), (99, "c")], "doc_id long, domain string")
    got, domains = mixing.mix(odd, labels, {"a": 0.5, "b": 0.5}, keep=tuple(odd.columns))
    assert got.select("kept.*").columns == odd.columns
    rows = got.collect()
    assert domains == ["a", "b"] and len(rows) == odd.count() and all(r["rate"] >= 0 and abs(sum(r["p"]) - 1) < 1e-5 for r in rows)
    got, domains = mixing.mix(empty, labels, {"a": 1.0})
    assert got.count() == 0
    got, domains = mixing.mix(odd.select("doc_id", "text"), labels.limit(0), {"a": 1.0})
    assert {round(r["rate"], 6) for r in got.collect()} == {1.0}
