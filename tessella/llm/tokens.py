"""Token ids of a public vocabulary, by the tokenizers library, with a bounded memory of words already encoded."""

from __future__ import annotations

import importlib
import os
import re
from itertools import chain

import numpy as np

from .common import caches

#: Words that a worker remembers unless told otherwise, at some 250 bytes each; beyond that, new words are encoded each time they come.
REMEMBERED = 500_000
#: Bytes of a longer word are not worth remembering.
LONGEST = 64

#: Characters for which the pattern below splits a text just as the vocabulary's own pattern does: printable ASCII, tab and line
#: ends, letters of Latin-1 and Latin Extended-A, and common punctuation. A text with any other is encoded whole by the library.
_OTHER = re.compile("[^\\t\\n\\r\\x20-\\x7E¡§«°»¿-ÖØ-öø-ſ–—‘-„…€]")
_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def vocabulary_path(name: str) -> str:
    """The path of a vocabulary file of the installed public_tokenizers package."""
    return importlib.import_module("public_tokenizers").path(name)


class Encoder:
    """encode(texts) -> an array of unsigned 32-bit ids for each text, those of the library with add_special_tokens=False.

    The library finds the strings of added tokens inside texts, so a text with any of them is encoded whole by the library.
    """

    def __init__(self, path: str, remembered: int | None = None) -> None:
        self.remembered = remembered or REMEMBERED
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(sorted(added, key=len, reverse=True)) or r"(?!)", re.IGNORECASE)
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words not met before, each as it would be inside a text."""
        plain, rest = [], []
        for w in words:
            (plain if w[0] == " " and w[1:].isalpha() else rest).append(w)
        new = dict(zip(rest, self._library(rest))) if rest else {}
        for at in range(0, len(plain), 2000):  # words that begin with a space stay apart when joined
            some = plain[at : at + 2000]
            ids = np.frombuffer(self._library(["".join(some)])[0], np.uint32)
            ends = np.cumsum([len(w.encode()) for w in some])
            cut = np.searchsorted(np.cumsum(self._sizes()[ids]), ends, "left") + 1
            for w, a, b in zip(some, [0, *cut[:-1].tolist()], cut.tolist()):
                new[w] = ids[a:b].tobytes()
        return new

    def _sizes(self) -> np.ndarray:
        """Bytes of each id: a byte-level vocabulary writes each byte as one character."""
        if not hasattr(self, "sizes"):
            vocab = self.whole.get_vocab()
            self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
            for text, i in vocab.items():
                self.sizes[i] = len(text)
        return self.sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        odd = [i for i, t in enumerate(texts) if _OTHER.search(t) or self.added.search(t)]
        for i in odd:
            out[i] = np.frombuffer(self._library([texts[i]])[0], np.uint32)
        even = [i for i in range(len(texts)) if out[i] is None]
        split = [_WORDS.findall(texts[i]) for i in even]
        new = set(chain.from_iterable(split)).difference(self.known)
        known, past = self.known, []
        if new:
            learnt = self._learn(new)
            room = self.remembered - len(known)
            past = [w for w in learnt if len(w) > LONGEST] if len(learnt) <= room else list(learnt)[max(0, room) :]
            known.update(learnt)
        get = known.__getitem__
        for i, words in zip(even, split):
            out[i] = np.frombuffer(b"".join(map(get, words)), np.uint32)
        for w in past:
            del known[w]
        return out


_encoders: dict[str, Encoder] = {}
caches["tokens"] = _encoders.clear


def encoder(path: str, remembered: int | None = None) -> Encoder:
    """One encoder a worker process and path, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, remembered)
    return _encoders[path]
