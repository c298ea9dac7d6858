"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Sorting goes bucket by bucket: all suffixes that a bucket induces are found, grouped by
their first symbol and appended to their buckets at once, so a pass over the text costs
a few array operations for each symbol of the alphabet, and linear work in all.
"""

from __future__ import annotations

import numpy as np


def types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it (S); the end counts as smallest."""
    n = len(text)
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    rising = np.zeros(n, bool)
    rising[:-1] = text[:-1] < text[1:]
    at = np.where(differs, np.arange(n), n)
    return rising[np.minimum.accumulate(at[::-1])[::-1]]


def append(order: np.ndarray, at: np.ndarray, text: np.ndarray, found: np.ndarray, step: int) -> None:
    """Put the suffixes ``found``, in their order, next in the buckets of their first symbols."""
    symbol = text[found]
    by = np.argsort(symbol, kind="stable")
    symbol, found = symbol[by], found[by]
    count = np.bincount(symbol, minlength=len(at))
    nth = np.arange(len(found)) - np.repeat(np.cumsum(count) - count, count)
    order[at[symbol] + step * nth] = found
    at += step * count


def induce(text: np.ndarray, small: np.ndarray, leftmost: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in the order that the given order of the leftmost smaller suffixes induces."""
    n = len(text)
    count = np.bincount(text, minlength=size)
    ends = np.cumsum(count)
    starts = ends - count
    order = np.full(n, -1, np.int64)
    last = ends - 1
    append(order, last, text, leftmost[::-1], -1)  # at the ends of their buckets
    seeds = last + 1

    head = starts.copy()
    append(order, head, text, np.array([n - 1]), 1)  # before the empty suffix
    for c in np.flatnonzero(count):
        done = starts[c]
        while done < head[c]:  # a bucket grows while it is read, by runs of its symbol
            batch, done = order[done:head[c]] - 1, head[c]
            batch = batch[batch >= 0]
            append(order, head, text, batch[~small[batch]], 1)
        batch = order[seeds[c]:ends[c]] - 1
        append(order, head, text, batch[~small[batch]], 1)

    tail = ends - 1
    for c in np.flatnonzero(count)[::-1]:
        done = ends[c] - 1
        while done > tail[c]:
            batch, done = order[tail[c] + 1:done + 1][::-1] - 1, tail[c]
            batch = batch[batch >= 0]
            append(order, tail, text, batch[small[batch]], -1)
        batch = order[starts[c]:head[c]][::-1] - 1
        batch = batch[batch >= 0]
        append(order, tail, text, batch[small[batch]], -1)
    return order


def ranked(names: np.ndarray) -> np.ndarray:
    """Suffixes of the string of names in order: names of pairs, then of pairs of pairs, and so on."""
    n, width = len(names), 1
    rank = names.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[:n - width] = rank[width:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(fresh) - 1
        width *= 2
        if fresh.all() or width >= n:
            return order


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Starts of all suffixes of ``text``, symbols below ``size``, in order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = types(text)
    first = np.zeros(n, bool)
    first[1:] = small[1:] & ~small[:-1]
    leftmost = np.flatnonzero(first)
    if len(leftmost) > 1:
        order = induce(text, small, leftmost, size)
        order = order[first[order]]  # leftmost smaller substrings, sorted
        end = np.append(leftmost[1:] + 1, n)
        nth = np.zeros(n, np.int64)
        nth[leftmost] = np.arange(len(leftmost))
        at = nth[order]
        same = np.zeros(len(order), bool)
        same[1:] = equal_spans(text, order[1:], order[:-1], (end - leftmost)[at[1:]], (end - leftmost)[at[:-1]])
        same[at == len(leftmost) - 1] = False  # the last one ends with the text
        same[1:][at[:-1] == len(leftmost) - 1] = False
        names = np.zeros(len(leftmost), np.int64)
        names[at] = np.cumsum(~same) - 1
        leftmost = leftmost[ranked(names) if same.any() else at]
    return induce(text, small, leftmost, size)


def equal_spans(text: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the spans at a and b are equal, symbol by symbol over all spans at once."""
    equal = size_a == size_b
    open_ = np.flatnonzero(equal)
    k = 0
    while len(open_):
        differ = text[a[open_] + k] != text[b[open_] + k]
        equal[open_[differ]] = False
        k += 1
        open_ = open_[~differ]
        open_ = open_[size_a[open_] > k]
    return equal


def common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, before) in text order: each suffix's neighbour before it in the array, and what they share.

    Only prefixes that cannot be extended to the left by the same symbol are compared;
    each other one is its left neighbour's less one.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    fresh = np.ones(n, bool)
    both = np.flatnonzero((before[1:] > 0)) + 1
    fresh[both] = text[both - 1] != text[before[both] - 1]
    at = np.flatnonzero(fresh)
    shared = np.zeros(n, np.int64)
    open_ = at[before[at] >= 0]
    padded = np.concatenate([text, np.zeros(8, text.dtype)])
    while len(open_):
        a, b = open_ + shared[open_], before[open_] + shared[open_]
        most = n - np.maximum(a, b)
        step = np.zeros(len(open_), np.int64)
        alive = np.ones(len(open_), bool)
        for k in range(8):
            alive &= (padded[a + k] == padded[b + k]) & (k < most)
            step += alive
        shared[open_] += step
        open_ = open_[alive]
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return shared[last] - (np.arange(n) - last), before
