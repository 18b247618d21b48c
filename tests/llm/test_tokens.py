import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import bitplane, packing, tokens

PATH = tokens.vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F, exclude_categories=("Cs",)), st.sampled_from("–—‘’“”…€'’ \n\r\t  0123'sreve_½ªº")), max_size=80))
def test_ids_are_the_library_s(encoder, library, text):
    assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(text=st.text(max_size=60))
def test_ids_of_any_text(encoder, library, text):
    assert encoder.encode([text, "a b"])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    e = tokens.Encoder(PATH)
    text = " ".join(f"word{i} {'z' * i}" for i in range(80))
    for _ in range(2):
        assert e.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(e.known) <= 20


def test_strings_of_added_tokens(encoder):
    """As the library, loaded anew and left as it is, encodes them."""
    plain = Tokenizer.from_file(PATH)
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert added
    for t in added:
        for text in (t, f"a {t} b", f"{t}{t}", f" {t.upper()}x", t[:-1], f"word {t}word\n"):
            assert encoder.encode([text, "a b"])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert encoder.encode(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]


@settings(max_examples=100, deadline=None)
@given(parts=st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["<|endoftext|>", "<|", "|>", "endoftext", " "])), max_size=8))
def test_ids_of_texts_with_added_tokens(encoder, library, parts):
    text = "".join(parts)
    assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", [1, 8])
@pytest.mark.parametrize("ids", [[], [0], [0] * 9, [1, 50256, 2**32 - 1, 7, 0, 3, 9, 8, 4], list(range(1000))])
def test_planes_round_trip(kind, ids):
    block = np.array(ids, np.uint32)
    assert bitplane.from_planes(bitplane.to_planes(block, kind), len(block), kind).tolist() == ids


@pytest.mark.parametrize("kind", [1, 8])
def test_file_round_trip(tmp_path, monkeypatch, kind):
    monkeypatch.setattr(bitplane, "BLOCK", 64)
    rng = np.random.default_rng(0)
    docs = [(None, rng.integers(0, 50257, 3)), (5, rng.integers(0, 9, 500)), (5, np.zeros(0, int)), (9, rng.integers(0, 50257, 64)), (-3, [1])]
    w = bitplane.Writer(f"file://{tmp_path}/a.planes", kind)
    for i, ids in docs:
        w.add(i, np.array(ids, np.uint32))
    uri, total, count = w.close()
    assert (total, count) == (568, 5)
    assert [(i, x.tolist()) for i, x in bitplane.read_file(uri)] == [(i, list(map(int, ids))) for i, ids in docs]
    (tmp_path / "b").write_bytes(b"x" * 40)
    with pytest.raises(ValueError):
        list(bitplane.read_file(f"file://{tmp_path}/b"))


def test_ids_table(spark, odd, library, monkeypatch):
    manifest = bitplane.write_ids(odd, PATH, end_id=2)
    got = bitplane.read_ids(spark, manifest).orderBy("start").collect()
    want = sorted(((r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    e, at = tokens.Encoder(PATH), 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = np.append(e.encode([t])[0], 2).astype("<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_empty_tables(spark, empty):
    assert bitplane.read_ids(spark, bitplane.write_ids(empty, PATH)).count() == 0
    assert packing.pack(empty, PATH).count() == 0


# -- packing ---------------------------------------------------------------------------------------------


def naive(lengths, size):
    """Best fit decreasing by looking at every open window."""
    room, out = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(r, w) for w, r in enumerate(room) if r >= lengths[i]]
        if fits:
            w = min(fits, key=lambda x: x[0])[1]
        else:
            w = len(room)
            room.append(size)
        room[w] -= lengths[i]
        out[i] = w
    return len(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit(lengths):
    windows, offsets, used = packing.best_fit(lengths, 32)
    assert used == naive(lengths, 32) == len(set(windows))
    rows = defaultdict(list)
    for n, w, o in zip(lengths, windows, offsets):
        rows[w].append((o, n))
    for x in rows.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 32


def test_padding_is_little(spark, small, monkeypatch):
    """A task's windows are whole but for one: what best fit leaves open on some hundred documents is below two in a hundred."""
    monkeypatch.setattr(packing, "spread", lambda df: df)
    docs = spark.read.parquet(f"{small}/documents.parquet").coalesce(1)
    used = defaultdict(int)
    for r in packing.pack(docs, PATH, end_id=1, size=2048).select("sequence_id", "length").collect():
        used[r["sequence_id"]] += r["length"]
    total = sum(used.values())
    assert len(used) <= -(-total // 2048) + 1 and 1 - total / (2048 * len(used)) < 0.02


def test_packed_table(spark, odd):
    got = packing.pack(odd, PATH, end_id=1, size=64).collect()
    e = tokens.Encoder(PATH)
    want = defaultdict(int)
    for r in odd.select("doc_id", "text").collect():
        want[r["doc_id"]] += len(e.encode([r["text"] or ""])[0]) + 1
    sums, rows = defaultdict(int), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 64
        sums[r["doc_id"]] += r["length"]
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sums == want
    for x in rows.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 64


def test_work_folder_without_a_setting():
    """A session of one machine keeps one local folder; any other needs the setting."""
    from types import SimpleNamespace

    import pytest

    from tessella.llm.common import work_dir

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master=master))
    assert work_dir(session("local[2]")) == work_dir(session("local[2]")) and work_dir(session("local[2]")).startswith("file:///")
    with pytest.raises(ValueError):
        work_dir(session("spark://a:7077"))
