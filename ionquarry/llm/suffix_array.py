"""Suffix arrays by induced sorting in numpy, and capped permuted common prefixes."""

from __future__ import annotations

import math

import numpy as np


_ZERO = np.zeros(1, np.int64)


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Suffix array from sorted leftmost-smaller suffixes: two linear scans, bucket by bucket.

    A bucket holds the suffixes with one first symbol. What a bucket induces into itself comes in waves, one for each
    repetition of the symbol; each wave is one vectorised step.
    """
    n, symbols = len(text), len(bounds) - 1
    out = np.full(n, -1, np.int64)
    tails = np.bincount(text[lms], minlength=symbols)
    order = np.cumsum(tails)
    for c in np.flatnonzero(tails):
        out[bounds[c + 1] - tails[c] : bounds[c + 1]] = lms[order[c] - tails[c] : order[c]]

    def place(found: np.ndarray, where: np.ndarray, step: int) -> None:
        """Puts the suffixes, in their order, at the free ends of their buckets."""
        first = text[found]
        turn = first.argsort(kind="stable")
        first = first[turn]
        start = np.concatenate((_ZERO, np.flatnonzero(first[1:] != first[:-1]) + 1))
        count = np.concatenate((start[1:], [len(first)])) - start
        free = where[first[start]]
        out[np.repeat(free - step * start, count) + step * np.arange(len(first))] = found[turn]
        where[first[start]] = free + step * count

    heads = bounds[:-1].copy()
    for c in range(symbols):
        at = bounds[c]
        while at < heads[c]:
            wave = out[at : heads[c]]
            at = heads[c]
            left = wave[wave > 0] - 1
            left = left[~small[left]]
            if len(left):
                place(left, heads, 1)
        left = lms[order[c] - tails[c] : order[c]]
        left = left[left > 0] - 1
        left = left[~small[left]]
        if len(left):
            place(left, heads, 1)
    ends = bounds[1:] - 1
    for c in range(symbols - 1, -1, -1):
        at = bounds[c + 1] - 1
        while at > ends[c]:
            wave = out[ends[c] + 1 : at + 1][::-1]
            at = ends[c]
            left = wave[wave > 0] - 1
            left = left[small[left]]
            if len(left):
                place(left, ends, -1)
        large = out[bounds[c] : heads[c]][::-1]
        left = large[large > 0] - 1
        left = left[small[left]]
        if len(left):
            place(left, ends, -1)
    return out


#: Names up to so many are symbols themselves; more are written with two digits.
FEW = 64
#: Reduced texts of so many names end the recursion.
SHORT = 1 << 17


def _by_rank(names: np.ndarray) -> np.ndarray:
    """The suffixes of a short text of many symbols in order, by doubling ranks of those not yet told apart."""
    n, rank, step = len(names), names.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        fresh = np.r_[True, sorted_rank[1:] != sorted_rank[:-1]]
        group = np.flatnonzero(fresh)
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(group, np.diff(np.r_[group, n]))
        tied = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))
        if not len(tied):
            return order
        own = order[tied]
        ahead = np.where(own + step < n, rank[np.minimum(own + step, n - 1)] + 1, 0)
        turn = np.lexsort((ahead, rank[own]))
        order[tied] = own[turn]
        key = rank.copy()
        # within a tie, the rank grows by the place of the next symbol's rank
        own, ahead = own[turn], ahead[turn]
        base = rank[own]
        new = np.r_[True, (base[1:] != base[:-1]) | (ahead[1:] != ahead[:-1])]
        key[own] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        rank, step = key, 2 * step


def _by_names(names: np.ndarray) -> np.ndarray:
    """The suffixes of the reduced text in order. Names grow from 1 on; the last one, the sentinel's, is smallest and stands once.

    Where names repeat, the reduced text is sorted by the same algorithm again, down to short texts. Many names are written with two digits each,
    which keeps the alphabet small enough for a scan by buckets; suffixes that start at a name's first digit have the
    order of the names' suffixes.
    """
    count = int(names.max()) + 1
    if count > len(names):
        out = np.empty(len(names), np.int64)
        out[names - 1] = np.arange(len(names))
        return out
    if len(names) <= SHORT:
        return _by_rank(names)
    width, base = (1, count) if count <= FEW else (2, math.isqrt(count - 1) + 1)
    digits = np.empty(len(names) * width + 1, np.int64)
    rest = names.copy()
    for k in range(width - 1, -1, -1):
        digits[k:-1:width] = rest % base + 1
        rest //= base
    digits[-1] = 0
    order = suffix_array(digits)
    return order[(order % width == 0) & (order < len(digits) - 1)] // width


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order. The text's symbols are small integers; its last one is 0 and stands nowhere else.

    Suffixes are classified as smaller or larger than their successor; the leftmost-smaller substrings are sorted by
    inducing and named; the text of their names is sorted recursively; the sorted leftmost-smaller suffixes then induce all
    others in linear time.
    """
    n = len(text)
    text = text.astype(np.uint16)  # narrow symbols are sorted by radix
    if n == 1:
        return np.zeros(1, np.int64)
    rises = np.zeros(n, bool)
    change = np.flatnonzero(text[1:] != text[:-1])
    nearest = change[np.minimum(np.searchsorted(change, np.arange(n - 1)), len(change) - 1)]
    rises[:-1] = text[nearest] < text[nearest + 1]
    rises[-1] = True
    lms = np.flatnonzero(rises[1:] & ~rises[:-1]) + 1
    bounds = np.r_[0, np.cumsum(np.bincount(text))]
    start = lms[np.argsort(text[lms], kind="stable")]
    if len(lms) > 1:
        rough = _induce(text, rises, start, bounds)
        place = np.full(n, -1, np.int64)
        place[lms] = np.arange(len(lms))
        rough = rough[place[rough] >= 0]
        end = np.r_[lms[1:], n - 1]
        size = (end - lms + 1)[place[rough]]
        a, b = rough[:-1], rough[1:]
        same = size[1:] == size[:-1]
        live, k = np.flatnonzero(same), 0
        while len(live):
            same[live] = text[a[live] + k] == text[b[live] + k]
            k += 1
            live = live[same[live] & (size[1:][live] > k)]
        # the last substring is the sentinel alone
        names = np.empty(len(lms), np.int64)
        names[place[rough]] = np.cumsum(np.r_[1, ~same])
        start = lms[_by_names(names)]
    return _induce(text, rises, start, bounds)


def capped_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position, the length of the common prefix with the suffix before it in order, up to ``most``.

    Permuted by text position, the lengths fall by one from a position to the next whenever the predecessors are
    neighbours as well and equal symbols stand before both; only elsewhere, symbols are compared.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    fresh = np.r_[True, (before[1:] != before[:-1] + 1) | (text[:-1] != text[before[1:] - 1])] | (before < 0)
    # runs are cut every ``most`` positions, since a length is only known up to ``most``
    run = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    at = np.flatnonzero(fresh | ((np.arange(n) - run) % most == 0))
    length = np.zeros(len(at), np.int64)
    live = np.flatnonzero(before[at] >= 0)
    wide = np.lib.stride_tricks.sliding_window_view(np.r_[text.astype(np.uint16), np.zeros(4, np.uint16)], 4)
    while len(live):
        x, y = at[live] + length[live], before[at[live]] + length[live]
        ok = (x < n) & (y < n)
        live, x, y = live[ok], x[ok], y[ok]
        eq = wide[x] == wide[y]
        whole = eq.all(1)
        length[live] += np.where(whole, 4, eq.argmin(1))
        live = live[whole & (length[live] < 2 * most)]
    first = np.searchsorted(at, np.arange(n), "right") - 1
    out = length[first] - (np.arange(n) - at[first])
    return np.clip(out, 0, most)
