"""Simple-8b: a 64-bit word has a selector in its upper 4 bits and as many numbers of one width as fit in the other 60."""

from __future__ import annotations

import numpy as np

# Numbers in a word, and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: A lone number of this value means that the next word is the number itself.
ESCAPE = (1 << 60) - 1


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, and which of them are numbers of 60 bits or more that follow an escape."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    big = v >= np.uint64(ESCAPE)
    bits = np.frexp((v >> np.uint64(30)).astype(np.float64))[1].astype(np.int8)  # exact below 2**53
    bits[bits > 0] += 30
    bits = np.maximum(bits, np.frexp((v & np.uint64(2**30 - 1)).astype(np.float64))[1].astype(np.int8))
    bits[big] = 61
    here = np.arange(n, dtype=np.int64 if n > 2**31 - 1 else np.int32)
    sel = np.full(n, 15, np.int64)
    for s in range(14, -1, -1):  # ever more numbers in a word; the last that fits stays
        wide = bits > WIDTHS[s]
        if wide.all():
            break  # no number is that narrow
        stop = np.minimum.accumulate(np.where(wide, here, here.dtype.type(n))[::-1])[::-1] if wide.any() else n
        sel[stop - here >= COUNTS[s]] = s
    step = (here + COUNTS[sel]).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = step[i]
    at = np.array(starts)
    chosen, escaped = sel[at], big[at]
    words = np.zeros(len(at), np.uint64)
    for s in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == s)
        word = np.full(len(mine), np.uint64(s) << np.uint64(60))
        if WIDTHS[s]:
            for k in range(COUNTS[s]):
                x = v[at[mine] + k]
                word |= (np.where(escaped[mine], np.uint64(ESCAPE), x) if s == 15 else x) << np.uint64(k * WIDTHS[s])
        words[mine] = word
    marks = np.flatnonzero(escaped)
    words = np.insert(words, marks + 1, v[at[marks]])
    return words, marks + 1 + np.arange(len(marks))


def decode(words: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The numbers, all words of a selector at once."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    n = COUNTS[sel]
    n[raw] = 1
    n[raw - 1] = 0  # the escape itself is no number
    sel[raw] = sel[raw - 1] = -1
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(sel == s)
        mask = (np.uint64(1) << np.uint64(WIDTHS[s])) - np.uint64(1)
        for k in range(COUNTS[s] if len(mine) else 0):
            out[at[mine] + k] = (words[mine] >> np.uint64(k * WIDTHS[s])) & mask
    out[at[raw]] = words[raw]
    return out
