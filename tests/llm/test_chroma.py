import numpy as np
from pyspark.sql import functions as F

from tessella.llm import chroma


def tune(seed, notes=60):
    rng = np.random.default_rng(seed)
    return chroma.rendered(list(rng.normal(size=notes)))


def pcm(samples):
    return (np.clip(samples, -1, 1) * 20000).astype("<i2").tobytes()


def naive_items(image):
    """Each filter summed cell by cell."""
    n = len(image) - chroma.WIDEST + 1
    out = []
    for t in range(max(0, n)):
        packed = 0
        for k, (kind, y, h, w) in enumerate(chroma.FILTERS):
            cells = [(dt, dy, image[t + dt, y + dy]) for dt in range(w) for dy in range(h)]
            total = lambda keep: sum(v for dt, dy, v in cells if keep(dt, dy))  # noqa: B023, E731
            whole = total(lambda dt, dy: True)
            if kind == 0:
                value = whole - 0.25 * w * h
            elif kind == 1:
                value = 2 * total(lambda dt, dy: dy < h // 2) - whole * (2 * (h // 2) / h)
            elif kind == 2:
                value = 2 * total(lambda dt, dy: dt < w // 2) - whole
            elif kind == 3:
                value = 2 * total(lambda dt, dy: (dt < w // 2) == (dy < h // 2)) - whole
            elif kind == 4:
                value = 3 * total(lambda dt, dy: w // 3 <= dt < 2 * w // 3) - whole
            else:
                value = 3 * total(lambda dt, dy: h // 3 <= dy < 2 * h // 3) - whole
            packed |= int(chroma._GRAY[np.searchsorted(chroma.BOUNDS, round(value / (w * h), 9))]) << (2 * k)
        out.append(packed)
    return out


def test_filters_by_integral_image():
    image = np.random.default_rng(0).random((24, 12))
    assert chroma.items(image).tolist() == naive_items(image)
    assert len(chroma.items(image[:15])) == 0


def test_pitch_classes():
    t = np.arange(4000) / chroma.RATE
    for hz, pitch in ((440.0, 0), (880.0, 0), (523.25, 3), (659.26, 7)):
        assert (chroma.chroma(np.sin(2 * np.pi * hz * t)).argmax(1) == pitch).all()
    assert not chroma.chroma(np.zeros(5000)).any() and chroma.chroma(np.zeros(10)).shape == (0, 12)


def test_alignment(spark):
    rng = np.random.default_rng(7)
    base = tune(1)
    rows = [(i, pcm(0.5 * tune(i))) for i in range(30)]
    rows += [(100, pcm(0.5 * base[256 * 12 :] + 0.02 * rng.normal(size=len(base) - 256 * 12))), (101, rows[5][1]), (102, rows[5][1]), (103, None), (104, b""), (105, b"\x01"), (None, rows[5][1]), (106, pcm(np.zeros(40_000)))]
    df = spark.createDataFrame(rows, "rec long, audio binary").selectExpr("*", "'x' AS id", "'x' AS items", "'x' AS class_id")
    prints = chroma.fingerprints(df, "rec", "audio")
    got = {r["id"]: r for r in chroma.align(prints, spark.createDataFrame([(1,), (2,), (5,), (100,), (102,), (103,), (999,)], "id long")).collect()}
    assert len(got) == len(rows)
    assert (got[100]["match_id"], got[100]["offset"]) == (1, 12) and got[100]["bit_error"] < 0.15
    assert (got[1]["match_id"], got[1]["offset"]) == (100, -12) and got[1]["overlap"] == got[100]["overlap"]
    assert (got[5]["match_id"], got[5]["bit_error"]) == (101, 0) and got[102]["match_id"] == 5 and got[102]["class_id"] == 5
    assert got[2]["match_id"] is None and not got[101]["is_query"] and got[101]["match_id"] is None
    assert got[103]["n_items"] == got[104]["n_items"] == 0 and got[103]["class_id"] is None and got[None]["class_id"] is None


def test_offsets_and_errors_are_those_of_all_pairs(spark):
    """A match has the error that the two fingerprints have at its offset, and no recording that shares items has less."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(12):
        base = 0.5 * tune(i % 4)
        rows.append((i, pcm(base[256 * int(rng.integers(0, 9)) :] + 0.01 * rng.normal(size=1)[0])))
    prints = chroma.fingerprints(spark.createDataFrame(rows, "id long, audio binary"), "id", "audio")
    held = {r["id"]: r["items"] for r in prints.collect()}
    for r in chroma.align(prints, prints.select("id")).collect():
        if r["match_id"] is not None:
            a, b, o = held[r["id"]], held[r["match_id"]], r["offset"]
            both = list(zip(a[max(0, -o) :], b[max(0, o) :]))
            assert r["overlap"] == len(both) and abs(r["bit_error"] - sum((x ^ y).bit_count() for x, y in both) / (32 * len(both))) < 1e-12
            assert r["match_id"] % 4 == r["id"] % 4


def test_no_recordings(spark):
    none = spark.createDataFrame([], "id long, audio binary")
    prints = chroma.fingerprints(none, "id", "audio")
    assert chroma.align(prints, prints.select("id")).count() == 0


def test_rendered_vectors():
    assert len(chroma.rendered([1.0, -1.0, 0.5])) == 3 * chroma.NOTE
    assert all(len(chroma.rendered(v)) == 0 for v in (None, [], [0.0], [None, 1.0], [float("nan")], [float("inf")]))
    assert len(chroma.rendered([float(np.float32(1e38)), 0.0])) == 2 * chroma.NOTE


def test_votes_use_every_copy_of_an_item(spark):
    constant = pcm(0.5 * np.tile(chroma.rendered([1.0]), 40))
    df = spark.createDataFrame([(1, constant), (2, constant + pcm(0.5 * tune(3, 10)))], "id long, audio binary")
    prints = chroma.fingerprints(df, "id", "audio").withColumn("n", F.lit(1))
    got = {r["id"]: r["match_id"] for r in chroma.align(prints, prints.select("id")).collect()}
    assert got == {1: 2, 2: 1}


def test_noisy_copies_are_found(spark):
    """Copies of which eight bits in a hundred are flipped, shifted by some places, and recordings that only share a silence."""
    rng = np.random.default_rng(8)
    rows, silence = [], np.full(30, 7, np.int64)
    for i in range(30):
        own = rng.integers(0, 1 << 32, 120)
        noisy = own[i % 9 :] ^ (rng.random((120 - i % 9, 32)) < 0.08) @ (1 << np.arange(32, dtype=np.int64))
        rows += [(2 * i, np.concatenate((silence, own)).tolist()), (2 * i + 1, np.concatenate((silence, noisy)).tolist())]
    prints = spark.createDataFrame(rows, "id long, items array<long>")
    got = {r["id"]: r for r in chroma.align(prints, prints.where("id % 2 = 0").select("id")).collect()}
    found = [got[2 * i]["match_id"] == 2 * i + 1 and got[2 * i]["offset"] == -(i % 9) and 0.03 < got[2 * i]["bit_error"] < 0.25 for i in range(30)]
    assert sum(found) >= 28 and all(got[2 * i]["match_id"] in (None, 2 * i + 1) for i in range(30))


def best_of_all(held, queries, least_overlap=16, most_error=0.25):
    """(match, offset, overlap, error) of each query, by all pairs with an item in common; no two recordings are equal."""
    firsts = {k: [(x, i) for i, x in enumerate(v) if not i or v[i - 1] != x] for k, v in held.items()}
    out = {}
    for q in queries:
        found = []
        for c in held:
            for o in {j - i for x, i in firsts[q] for y, j in firsts[c] if x == y} if c != q else ():
                both = list(zip(held[q][max(0, -o) :], held[c][max(0, o) :]))
                error = sum((x ^ y).bit_count() for x, y in both) / (32 * len(both))
                if len(both) >= least_overlap and error <= most_error:
                    found.append((error, c, o, len(both)))
        out[q] = min(found)[1:] + (min(found)[0],) if found else None
    return out


def test_recordings_that_share_only_their_commonest_item_are_compared(spark):
    rows = [(1, [7] * 40 + [1, 2]), (2, [7] * 40 + [4, 8]), (3, [9] * 30), (4, [9] * 31)]
    prints = spark.createDataFrame(rows, "id long, items array<long>")
    for frequent in (1000, 0):
        got = {r["id"]: (r["match_id"], r["offset"], r["overlap"]) for r in chroma.align(prints, prints.select("id"), frequent=frequent).collect()}
        assert got == {1: (2, 0, 42), 2: (1, 0, 42), 3: (4, 0, 30), 4: (3, 0, 30)}


def test_a_shared_silence_outvotes_no_other_item(spark):
    rng = np.random.default_rng(2)
    own = rng.integers(0, 1 << 32, 80)
    noisy = own[9:] ^ 1
    noisy[30] ^= 1
    rows = [(1, [7] * 3 + own.tolist() + [7] * 3 + [5]), (2, [7] * 3 + noisy.tolist() + [7] * 12 + [5])]
    prints = spark.createDataFrame(rows, "id long, items array<long>")
    for frequent in (1000, 0):
        got = {r["id"]: (r["match_id"], r["offset"]) for r in chroma.align(prints, prints.select("id"), frequent=frequent).collect()}
        assert got == {1: (2, -9), 2: (1, 9)}


def test_frequent_items_lose_no_match(spark, monkeypatch):
    """Joined or compared in blocks, many small ones as well, the matches are those of all pairs that share an item."""
    rng = np.random.default_rng(5)
    few = rng.integers(0, 1 << 32, 6)
    held = {}
    for i in range(40):
        parts = [np.repeat(few[rng.integers(0, 6, 3)], rng.integers(1, 15, 3)), rng.integers(0, 1 << 32, rng.integers(0, 6)), np.repeat(few[:1], rng.integers(0, 12))]
        held[i] = np.concatenate([parts[k] for k in rng.permutation(3)]).tolist()
    prints = spark.createDataFrame(list(held.items()), "id long, items array<long>")
    asked = [i for i in held if i % 2 == 0]
    expected = best_of_all(held, asked)
    assert sum(m is not None for m in expected.values()) > 5
    for frequent, most, votes in ((1000, 1 << 18, 1 << 20), (12, 1 << 18, 1 << 20), (0, 200, 3)):
        monkeypatch.setattr(chroma, "BLOCK_CLASSES", most)
        monkeypatch.setattr(chroma, "BLOCK_QUERIES", most // 2)
        monkeypatch.setattr(chroma, "VOTES", votes)
        rows = chroma.align(prints, prints.where("id % 2 = 0").select("id"), frequent=frequent).where("is_query").collect()
        got = {r["id"]: (r["match_id"], r["offset"], r["overlap"], r["bit_error"]) if r["match_id"] is not None else None for r in rows}
        assert got == expected, frequent
