"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import pieces, spread, texts_of

#: Most frequent n-grams of a language's and of a document's profile.
PROFILE = 300
#: Distance differences are divided by this before they become shares of confidence.
SHARP = 0.02
UNKNOWN = "und"
#: Bytes of text whose n-grams are held at once, at about a hundred bytes for each.
CHUNK = 1 << 20
_POINTS = 0x110000
_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _table:
        _table.append(np.fromiter((chr(i).isalpha() for i in range(_POINTS)), bool, _POINTS))
    return _table[0]


def padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, with one space for each run of other characters than letters, one before and one after; n + 1 offsets."""
    joined = "\x00".join(t.lower().replace("\x00", " ") for t in texts) + "\x00"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    end = points == 0
    letter = _letters()[points]
    code = np.where(letter, points, 32)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # the first of a run of spaces, so a text that ends in a letter has its space there
    ends = np.flatnonzero(end)
    before = np.concatenate(([0], ends[:-1] + 1))
    sizes = np.add.reduceat(keep.astype(np.int64), before) if len(before) else np.zeros(0, np.int64)
    kept = code[keep]
    offs = np.concatenate(([0], np.cumsum(sizes)))
    lead = np.zeros(len(texts), bool)
    some = sizes > 0
    lead[some] = kept[offs[:-1][some]] != 32  # a text that begins with a letter gets a space first
    out = np.insert(kept, offs[:-1][lead], 32)
    return out, offs + np.concatenate(([0], np.cumsum(lead)))


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each n-gram of one to three characters, by the position it begins at, or -1; and the alphabet of the codes.

    A space stands only at an n-gram's ends, and never alone. Codes are base len(alphabet) numbers, first character lowest.
    """
    seen = np.zeros(_POINTS, bool)
    seen[points] = True
    seen[32] = False
    alphabet = np.concatenate(([32], np.flatnonzero(seen)))
    index = np.zeros(_POINTS, np.int64)
    index[alphabet] = np.arange(len(alphabet))
    x, k = index[points], len(alphabet)
    one = np.where(x > 0, x, -1)
    y, z = np.append(x[1:], 0), np.append(x[2:], [0, 0])[: len(x)]
    last = np.arange(len(x))
    two = np.where(((x > 0) | (y > 0)) & (last < len(x) - 1), x + k * y + k, -1)
    three = np.where((y > 0) & (last < len(x) - 2), x + k * y + k * k * z + k + k * k, -1)
    return np.stack((one, two, three), 1), alphabet


def spelled(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Codes that do not depend on the alphabet: 21 bits a character, first character lowest, zero where there is none."""
    k = len(alphabet)
    size = 1 + (codes >= k).astype(np.int64) + (codes >= k + k * k)
    rest = codes - np.where(size > 1, k, 0) - np.where(size > 2, k * k, 0)
    out = np.zeros(len(codes), np.int64)
    for place in range(3):
        here = size > place
        out[here] |= alphabet[rest[here] % k].astype(np.int64) << (21 * place)
        rest = rest // k
    return out


def _inside(points: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The codes of padded(), with those that reach into the next text left out."""
    codes, alphabet = grams(points)
    for size in (2, 3):
        for back in range(1, size):
            at = offs[1:] - back
            codes[at[(at >= 0) & (at < len(points))], size - 1] = -1
    return codes, alphabet


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (codes, counts) in total.items():
            yield pa.record_batch([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])
        total.clear()

    for batch in pieces(batches, "text", CHUNK):
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = np.array([t or "" for t in batch.column("text").to_pylist()], object)
        for lang in sorted(set(langs)):
            points, offs = padded(texts[langs == lang].tolist())
            codes, alphabet = _inside(points, offs)
            codes = codes[codes >= 0]
            k = len(alphabet)
            if not len(codes):
                continue
            if k**3 + k * k + k <= 1 << 22:
                n = np.bincount(codes)
                codes = np.flatnonzero(n)
                n = n[codes]
            else:
                codes, n = np.unique(codes, return_counts=True)
            codes = spelled(codes, alphabet)
            if lang in total:
                codes, n = np.concatenate((total[lang][0], codes)), np.concatenate((total[lang][1], n))
                codes, where = np.unique(codes, return_inverse=True)
                n = np.bincount(where, n).astype(np.int64)
            held += len(codes) - (len(total[lang][0]) if lang in total else 0)
            total[lang] = codes, n
        if held > 1_000_000:
            yield from flush()
            held = 0
    yield from flush()


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams, first the most frequent (ties by code), counted over all rows with a language.

    Rows whose language or text is null count for nothing; a language whose texts have no letter has no profile; repeated
    rows count as often; other columns are not looked at. An empty table gives no profile.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = spread(rows).mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= size)
    out: dict[str, list[int]] = {}
    for r in first.orderBy("lang", "place").toLocalIterator():  # `size` rows a language
        out.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(x, np.int64) for lang, x in out.items()}


def distances(points: np.ndarray, offs: np.ndarray, known: list[np.ndarray], size: int = PROFILE) -> np.ndarray:
    """The out-of-place distance, as a share of the largest possible, of each text to each profile; nan for a text without letters."""
    codes, alphabet = _inside(points, offs)
    k = len(alphabet)
    total = k + k * k + k**3
    ranks = []
    every = None
    if total <= 1 << 22:
        every = spelled(np.arange(total), alphabet)
    for profile in known:
        order = np.argsort(profile)
        if every is not None:
            at = np.minimum(np.searchsorted(profile[order], every), max(0, len(profile) - 1))
            ranks.append(np.where(profile[order][at] == every, order[at], -1))
        else:
            ranks.append((profile[order], order))
    out = np.full((len(offs) - 1, len(known)), np.nan)
    codes = codes.astype(np.int32 if total < 1 << 31 else np.int64)
    for d in range(len(offs) - 1):
        own = codes[offs[d] : offs[d + 1]].ravel()
        own = np.sort(own[own >= 0])
        if not len(own):
            continue
        at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        n = np.diff(np.append(at, len(own)))
        own = own[at]
        if len(own) > size:  # what is as frequent as the last that may stay takes part in the tie
            least = np.partition(n, len(n) - size)[len(n) - size]
            some = n >= least
            own, n = own[some], n[some]
        word = every[own] if every is not None else spelled(own.astype(np.int64), alphabet)
        order = np.lexsort((word, -n))[:size]
        own, word, place = own[order], word[order], np.arange(len(order))
        for j, rank in enumerate(ranks):
            if every is not None:
                r = rank[own]
            else:
                x = np.minimum(np.searchsorted(rank[0], word), len(rank[0]) - 1)
                r = np.where(rank[0][x] == word, rank[1][x], -1)
            out[d, j] = np.where(r < 0, size, np.abs(place - r)).sum() / (size * len(place))
    return out


def identify(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept, lang_pred, score, distance) of each row: the language of the nearest profile, ties to the first by name.

    kept is a struct of the columns in `keep`, so that no name can clash; without `keep`, there is none. score is the share
    of exp(-distance / SHARP) among the languages, so 1 means that no other is near; distance is the out-of-place distance
    as a share of the largest possible. A text that is null, empty or without letters is `und` with score and distance 0,
    and so is every text if no language was learnt. Whole texts count, however long; rows that repeat an id are rows of
    their own; an empty table gives an empty result.
    """
    langs = sorted(known)
    held = [known[x] for x in langs]
    rows, cut, fields = texts_of(docs, id_col, text_col, keep, CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, others in cut(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, scores, far = [], [], []
            far_all = distances(*padded(texts), held) if held else np.full((len(texts), 1), np.nan)
            for row in far_all:
                if np.isnan(row[0]):
                    names.append(UNKNOWN), scores.append(0.0), far.append(0.0)
                    continue
                best = int(np.argmin(row))
                names.append(langs[best])
                scores.append(float(1 / np.exp((row[best] - row) / SHARP).sum()))
                far.append(float(row[best]))
            yield pa.record_batch([*others, pa.array(names), pa.array(scores, pa.float64()), pa.array(far, pa.float64())], [*fields.names, "lang_pred", "score", "distance"])

    return rows.mapInArrow(run, StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("distance", DoubleType())]))
