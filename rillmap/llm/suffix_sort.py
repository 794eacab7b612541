"""Groups of equal windows of a text by blockwise suffix sorting with a difference cover.

Positions whose remainder by ``PERIOD`` lies in ``COVER`` are the sample; any two positions have a common step of less than ``PERIOD`` to sample positions. The
sample is ranked once, by its first ``PERIOD`` bytes and then by doubling, to a depth of at least a window. Suffixes are then sorted one block of
leading bytes at a time: by their first ``PERIOD`` bytes, and where these tie, by the sample ranks at the common step. Positions of one remainder are sorted
against those of another by one search, so a tie of any size needs no comparison of texts. Equal windows end up next to each other, and the common
prefix of neighbours tells where a group ends.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PERIOD, COVER = 13, (0, 1, 3, 9)                            # every remainder is a difference of two members
BLOCK = 1 << 18                                             # suffixes sorted at a time
_IN = np.isin(np.arange(PERIOD), COVER)
STEP = [[next(s for s in range(PERIOD) if _IN[(a + s) % PERIOD] and _IN[(b + s) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)]


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of rows by the given keys, the last one counting most."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) + 1
    return rank


def _prefix(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``PERIOD`` bytes at each position as two numbers; ``text`` is padded."""
    high = np.zeros(len(at), np.uint64)
    for k in range(8):
        high = high << np.uint64(8) | text[at + k].astype(np.uint64)
    low = np.zeros(len(at), np.uint64)
    for k in range(8, PERIOD):
        low = low << np.uint64(8) | text[at + k].astype(np.uint64)
    return high, low


class Sample:
    """Ranks of the cover's positions to a depth of at least ``window`` bytes; 0 past the end and elsewhere."""

    def __init__(self, text: np.ndarray, window: int):
        n = len(text)
        self.text = np.concatenate([text, np.zeros(window + 2 * PERIOD, np.uint8)])
        at = np.sort(np.concatenate([np.arange(c, n, PERIOD) for c in COVER]))
        self.rank, depth = np.zeros(n + 4 * max(window, PERIOD) + PERIOD, np.int32), PERIOD
        self.rank[at] = _dense(*_prefix(self.text, at)[::-1])
        while depth < window:
            self.rank[at] = _dense(self.rank[at + depth], self.rank[at])
            depth *= 2


def _resolve(group: np.ndarray, at: np.ndarray, sample: Sample) -> np.ndarray:
    """The order of positions by (group, suffix), where the positions of one group share their first ``PERIOD`` bytes."""
    top = int(sample.rank.max()) + 2
    remainder = at % PERIOD
    rows = [np.flatnonzero(remainder == r) for r in range(PERIOD)]
    begins = [np.concatenate([[0], np.cumsum(np.bincount(group[r], minlength=int(group.max()) + 1))]) for r in rows]     # of each group among a remainder
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def keys(r: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(group, sample rank at the step) of a remainder's positions as sorted numbers, and the positions in that order."""
        if (r, step) not in held:
            key = group[rows[r]] * top + sample.rank[at[rows[r]] + step]
            order = np.argsort(key)
            held[r, step] = key[order], rows[r][order]
        return held[r, step]

    below = np.zeros(len(at), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            if len(rows[a]) and len(rows[b]):
                own, where = keys(a, STEP[a][b])
                below[where] += np.searchsorted(keys(b, STEP[a][b])[0], own) - begins[b][group[where]]
    return np.lexsort((at, below, group))


def equal_windows(text: np.ndarray, at: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For block after block of suffixes: indices into ``at`` and where each group of equal windows begins among them; lone windows are left out."""
    if not len(at):
        return
    sample = Sample(text, window)
    lead = (sample.text[at].astype(np.uint16) << np.uint16(8)) + sample.text[at + 1]
    upto = np.cumsum(np.bincount(lead, minlength=1 << 16))
    begin = 0
    while begin < 1 << 16:
        done = int(upto[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + BLOCK, "right")))
        own = np.flatnonzero((lead >= begin) & (lead < end))
        begin = end
        if not len(own):
            continue
        high, low = _prefix(sample.text, at[own])
        group = _dense(low, high)
        tied = np.bincount(group)[group] > 1
        own, group = own[tied], group[tied]
        if not len(own):
            continue
        order = _resolve(group, at[own], sample)
        own = own[order]
        place = at[own]
        opens = np.ones(len(own), bool)
        alike = np.ones(len(own) - 1, bool)
        for k in range(window):
            alike &= sample.text[place[1:] + k] == sample.text[place[:-1] + k]
        opens[1:] = ~alike
        first = np.flatnonzero(opens)
        yield own, first
