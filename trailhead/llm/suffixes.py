"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Suffixes are classed as smaller (S) or larger (L) than the next one; an S suffix behind an L one is leftmost-smaller
(LMS). Substrings between LMS places are sorted by inducing, get names, and the string of names is sorted recursively;
the order of the LMS suffixes then induces that of all suffixes, in time linear in the text. Inducing goes through the
buckets of the first symbol; what one bucket adds to the others is written at once, in the order in which a scan of
single entries would add it. The string of names has an alphabet as large as itself; there, recursion is by names of
pairs of names, of twice the length each time.
"""

from __future__ import annotations

import numpy as np


def smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one is not."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    at = np.where(step != 0, np.arange(n, dtype=np.int32), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return step[following] > 0


class Buckets:
    """Places of the suffixes that begin with each symbol."""

    def __init__(self, t: np.ndarray, s: np.ndarray, sigma: int):
        self.t, self.s, self.sigma = t, s, sigma
        counts = np.bincount(t, minlength=sigma)
        self.end = np.cumsum(counts)
        self.start = self.end - counts
        self.used = np.flatnonzero(counts).tolist()

    def _dealt(self, entries: np.ndarray, want: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Predecessors of the wanted class by symbol: they, their symbols, ranks in the symbol, counts."""
        p = entries[entries > 0] - 1
        p = p[self.s[p] == want]
        c = self.t[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        counts = np.bincount(c, minlength=self.sigma)
        rank = np.arange(len(p)) - (np.cumsum(counts) - counts)[c]
        return p, c, rank, counts

    def induce(self, seeds: np.ndarray) -> np.ndarray:
        """All suffixes, induced from LMS places that are in order within each symbol."""
        n = len(self.t)
        sa = np.zeros(n, np.int32)
        c = self.t[seeds]
        order = np.argsort(c, kind="stable")
        seeds, c = seeds[order], c[order]
        n_seeds = np.bincount(c, minlength=self.sigma)
        first_seed = np.cumsum(n_seeds) - n_seeds
        head = self.start.copy()

        def larger(entries):
            if len(entries):
                p, c, rank, counts = self._dealt(entries, False)
                sa[head[c] + rank] = p
                np.add(head, counts, out=head)

        last = self.t[n - 1]
        sa[head[last]] = n - 1
        head[last] += 1
        for b in self.used:
            done = self.start[b]
            while done < head[b]:
                done, upto = head[b], slice(done, head[b])
                larger(sa[upto])
            larger(seeds[first_seed[b] : first_seed[b] + n_seeds[b]])
        tail = self.end.copy()

        def lesser(entries):
            if len(entries):
                p, c, rank, counts = self._dealt(entries, True)
                sa[tail[c] - 1 - rank] = p
                np.subtract(tail, counts, out=tail)

        for b in reversed(self.used):
            done = self.end[b]
            while tail[b] < done:
                done, upto = tail[b], slice(tail[b], done)
                lesser(sa[upto][::-1])
            lesser(sa[self.start[b] : head[b]][::-1])
        return sa


def names_of(t: np.ndarray, places: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings, in order of place, and their number; ordered: the places sorted by substring."""
    size = np.zeros(len(t), np.int32)
    size[places[:-1]] = np.diff(places) + 1
    size[places[-1]] = len(t) - places[-1]
    a, b = ordered[:-1], ordered[1:]
    same = size[a] == size[b]
    # the last one has no end among LMS places, so it equals none
    same &= (a != places[-1]) & (b != places[-1])
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        equal = t[a[left] + k] == t[b[left] + k]
        same[left[~equal]] = False
        k += 1
        left = left[equal & (size[a[left]] > k)]
    number = np.concatenate([[0], np.cumsum(~same)])
    named = np.zeros(len(t), np.int32)
    named[ordered] = number
    return named[places], int(number[-1]) + 1


def sort_names(names: np.ndarray, n_names: int, step: int = 1) -> np.ndarray:
    """Order of the suffixes of a string of names, each of which stands for `step` symbols, by recursion on pairs."""
    n = len(names)
    if n_names == n:
        order = np.zeros(n, np.int64)
        order[names] = np.arange(n)
        return order
    after = np.zeros(n, np.int64)
    if step < n:
        after[:-step] = names[step:].astype(np.int64) + 1
    pair = names.astype(np.int64) * (n + 2) + after
    order = np.argsort(pair, kind="stable")
    sorted_pairs = pair[order]
    number = np.concatenate([[0], np.cumsum(sorted_pairs[1:] != sorted_pairs[:-1])])
    new = np.zeros(n, np.int64)
    new[order] = number
    return sort_names(new, int(number[-1]) + 1, 2 * step)


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Starts of the suffixes of t (symbols under sigma) in order; a suffix that ends first is the smaller."""
    n = len(t)
    if n < 2:
        return np.zeros(n, np.int32)
    s = smaller(t)
    places = np.flatnonzero(s[1:] & ~s[:-1]).astype(np.int32) + 1
    buckets = Buckets(t, s, sigma)
    if len(places) > 1:
        sa = buckets.induce(places)
        is_lms = np.zeros(n, bool)
        is_lms[places] = True
        ordered = sa[is_lms[sa]]
        names, n_names = names_of(t, places, ordered)
        if n_names < len(places):
            ordered = places[sort_names(names, n_names)]
        places = ordered
    return buckets.induce(places)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, most: int, counted: np.ndarray) -> np.ndarray:
    """For each place of the text, the length that its suffix shares with the one before it in order, up to most.

    Only places that count, with a predecessor that counts, are compared (0 for others); counted places have at least
    `most` bytes before the end of the text.
    """
    before = np.full(len(text), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.flatnonzero(counted & (before >= 0))
    at = at[counted[before[at]]]
    other = before[at]
    shared = np.zeros(len(text), np.int32)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(text),), "<u8", padded, strides=(1,))
    for k in range(0, most, 8):
        differ = words[at + k] ^ words[other + k]
        stop = differ != 0
        low = differ[stop] & (~differ[stop] + np.uint64(1))
        shared[at[stop]] = np.minimum(most, k + (np.bitwise_count(low - np.uint64(1)) >> 3))
        at, other = at[~stop], other[~stop]
    shared[at] = most
    return shared
