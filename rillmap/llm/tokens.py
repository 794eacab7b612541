"""Token ids of whole texts through the ``tokenizers`` library, for use inside tasks.

A byte-level BPE vocabulary cuts a text before every single space that stands between two other characters, so the ids of a text are the ids
of its space-led words one after another. Words repeat; each task encodes a distinct word once and looks it up from then on. The table of
known words is emptied when it exceeds ``MOST_WORDS`` entries or ``MOST_IDS`` ids, so its memory is bounded.
"""
from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np

MOST_WORDS, MOST_IDS = 2_000_000, 16_000_000
CLOSING = ".,;:!?"
END_ID = 2
LED = "\n"
_RUN = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?= \S)")


class WordEncoder:
    """Encodes texts with one tokenizer file; ``encode`` gives the ids of all texts in a row and where each text ends."""

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        self.most_words = most_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.marks = {c: self.tokenizer.encode(c, add_special_tokens=False).ids[0] for c in CLOSING}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.empty(0, np.uint32)
        self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int32)

    def _learn(self, keys: list[str]) -> None:
        """A word of letters and one closing mark has the ids of its letters and the id of the mark, so only the letters are encoded."""
        closed = [w for w in keys if w[-1:] in self.marks and w[:-1].isalpha()]
        own = set(keys).difference(closed)
        own.update({w[:-1] for w in closed}.difference(self.known))
        self._add(list(own))
        if closed:
            stem = np.fromiter((self.known[w[:-1]] for w in closed), np.int64, len(closed))
            mark = np.fromiter((self.marks[w[-1]] for w in closed), np.uint32, len(closed))
            size = self.size[stem].astype(np.int64) + 1
            upto = np.cumsum(size)
            place = np.repeat(self.start[stem] - upto + size, size) + np.arange(upto[-1])
            place[upto - 1] = 0
            flat = self.pool[place]
            flat[upto - 1] = mark
            self._append(closed, flat, size)

    def _add(self, keys: list[str]) -> None:
        words = [w[1:] if w[:1] == LED else " " + w for w in keys]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self._append(keys, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size)

    def _append(self, words: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        base = len(self.start)
        self.start = np.concatenate([self.start, (len(self.pool) + np.cumsum(size) - size).astype(np.int32)])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.pool = np.concatenate([self.pool, flat])
        self.known.update(zip(words, range(base, base + len(words))))

    @staticmethod
    def _keys(text: str) -> list[str]:
        """The words of a text without the space before them; a first word, which has none, is marked by ``LED`` instead."""
        if _RUN.search(text):
            first, *rest = _CUT.split(text)
            rest = [w[1:] for w in rest]
        else:
            first, *rest = text.split(" ")
            if not rest or rest[-1]:
                return [LED + first, *rest]
            rest[-1] = LED + " "
        return [LED + first, *rest]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most_words or len(self.pool) > MOST_IDS:
            self._forget()
        keys: list[str] = []
        ends = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                keys += self._keys(text)
            ends[i] = len(keys)
        code = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(code < 0).tolist()
        if new:
            missing = [keys[i] for i in new]
            self._learn(list(set(missing)))
            code[new] = np.fromiter(map(self.known.__getitem__, missing), np.int64, len(missing))
        size = self.size[code]
        upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        place = np.repeat(self.start[code] - upto[:-1], size) + np.arange(upto[-1])
        return self.pool[place], upto[ends]


@lru_cache(maxsize=2)
def encoder(path: str, most_words: int = MOST_WORDS) -> WordEncoder:
    """The encoder of this worker process for a vocabulary file."""
    return WordEncoder(path, most_words)


def pieces(texts: list[str], most: int = 1 << 20):
    """Consecutive groups of texts of about ``most`` characters, so that work arrays stay small; a longer text is a group of its own."""
    at, total = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > at and total + size > most:
            yield at, texts[at:i]
            at, total = i, 0
        total += size
    if at < len(texts):
        yield at, texts[at:]


def encode_documents(path: str, texts: list[str | None], end_id: int | None = END_ID, most_words: int = MOST_WORDS):
    """The ids of each text as uint32 array, ``end_id`` appended; a null text has no other ids."""
    known = encoder(path, most_words)
    for _, group in pieces(texts):
        ids, ends = known.encode([t or "" for t in group])
        begin = 0
        for end in ends.tolist():
            own = ids[begin:end]
            yield own if end_id is None else np.append(own, np.uint32(end_id))
            begin = end


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
