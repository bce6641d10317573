"""Sampled suffixes of byte texts, and induction of the order of all others from them.

Of each window of LENGTH bytes the gram (GRAM bytes) with the smallest hash is its *anchor*;
which one depends on the window's bytes alone. Anchors play the part of the sampled suffixes
of induced sorting: a window is its anchor's suffix with a few bytes before it. An anchor and
the windows it answers for make up a *context*: the bytes those windows cover.
"""

from __future__ import annotations

import numpy as np

LENGTH = 50
GRAM = 16
REACH = LENGTH - GRAM  # an anchor lies at most so far behind its window's start
WIDTH = LENGTH + REACH  # bytes of a context, at most
ROW = WIDTH + 2  # and two bytes: anchor's place + 1, number of windows
SEGMENT = 1 << 18  # window starts worked on at once
_PLACE = np.uint64((1 << 20) - 1)

_draw = np.random.default_rng(50)
_BYTES = _draw.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = [np.uint64(int(x) * 2 + 1) for x in _draw.integers(2**61, 2**62, 5)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place."""
    h, width = _BYTES[data], 1
    while width < GRAM:
        h = h[:-width] * _STEPS[width.bit_length() - 1] + h[width:]
        h ^= h >> np.uint64(31)
        width *= 2
    h *= _STEPS[4]
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, ends: np.ndarray):
    """For each segment of a buffer of texts: ``anchor, first, last, hash`` of its anchors.

    ``ends`` are the texts' ends; windows never cross them. ``first`` to ``last`` are the starts
    of the windows an anchor answers for.
    """
    for s in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
        part = data[s : s + SEGMENT + LENGTH - 1]
        starts = len(part) - LENGTH + 1
        h = gram_hashes(part)
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        width, windows = 1, REACH + 1
        while 2 * width <= windows:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < windows:
            low = np.minimum(low[: starts], low[windows - width : windows - width + starts])
        at = (low[:starts] & _PLACE).astype(np.int64)
        # Only windows that end inside the text they begin in.
        first_end, last_end = np.searchsorted(ends, (s, s + starts), side="right")
        valid = np.ones(starts, bool)
        for end in ends[first_end : last_end + 1].tolist():
            valid[max(0, end - LENGTH + 1 - s) : max(0, end - s)] = False
        p = np.flatnonzero(valid)
        if not len(p):
            continue
        at = at[p]
        head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(head[1:], len(p)) - 1
        yield s + at[head], s + p[head], s + p[last], h[at[head]]


def contexts(data: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Contexts as fixed-width byte strings that are equal if and only if the contexts are."""
    rows = np.zeros((len(anchor), ROW), np.uint8)
    length = last - first + LENGTH
    place = np.arange(WIDTH)
    index = first[:, None] + place
    inside = place < length[:, None]
    rows[:, :WIDTH][inside] = data[index[inside]]
    rows[:, WIDTH] = anchor - first + 1
    rows[:, WIDTH + 1] = last - first + 1
    return rows.view(f"S{ROW}").ravel()


class Minima:
    """Least values of ranges, from minima over powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            now = self.levels[-1]
            self.levels.append(np.minimum(now[:-width], now[width:]))
            width *= 2

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Least of values[begin:end] for each pair; ranges are not empty."""
        level = np.frexp((end - begin).astype(float))[1] - 1
        out = np.empty(len(begin), self.levels[0].dtype)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.levels[k][begin[own]], self.levels[k][end[own] - (1 << int(k))])
        return out


def least_owner(rows: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each context and window: the least owner among contexts that hold the same window.

    ``rows`` are contexts, ``owner`` a number for each. Column j of the result is the window that
    begins j bytes before the anchor; -1 where the context has none. The anchors' suffixes are
    sorted first, with the lengths of the prefixes that neighbours have in common. Then the order
    of the suffixes one byte further left is induced from it, as (byte, rank of the suffix
    behind it), and their common prefixes are one byte longer than the least between them.
    """
    n = len(rows)
    table = np.frombuffer(rows.tobytes(), np.uint8).reshape(n, ROW)
    before = table[:, WIDTH].astype(np.int64) - 1
    nearest = before - table[:, WIDTH + 1] + 1
    out = np.full((n, REACH + 1), -1, np.int32)
    if not n:
        return out
    right = np.zeros((n, 56), np.uint8)  # the anchors' suffixes; contexts are filled up with zeros
    for k in range(LENGTH):
        place = before + k
        inside = np.flatnonzero(place < WIDTH)
        right[inside, k] = table[inside, place[inside]]
    words = right.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    common = np.zeros(n, np.uint8)
    del words
    equal = np.ones(n - 1, bool)
    for k in range(LENGTH):
        column = right[order, k]
        equal &= column[1:] == column[:-1]
        common[1:] += equal
    del right
    for j in range(REACH + 1):
        live = (nearest[order] <= j) & (before[order] >= j)
        own = order[live]
        if len(own):
            group = np.cumsum(common < LENGTH)[live]
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            least = np.minimum.reduceat(owner[own], heads)
            out[own, j] = np.repeat(least, np.diff(np.append(heads, len(own))))
        place = np.flatnonzero(before[order] > j)
        if not len(place):
            break
        moved = order[place]
        letter = table[moved, before[moved] - 1 - j]
        by = np.argsort(letter, kind="stable")
        place, letter = place[by], letter[by]
        same = np.flatnonzero(letter[1:] == letter[:-1])
        minima = Minima(common)
        order = moved[by]
        common = np.zeros(len(order), np.uint8)
        common[same + 1] = np.minimum(minima.of(place[same] + 1, place[same + 1] + 1), 200) + 1
    return out
