"""Runs of words: stretches that repeat with a period, found by divide and conquer with Z-functions (Main-Lorentz).

The words of a text are interned as numbers. A run is a stretch of consecutive words whose words q apart are identical,
of at least max(least, 2 q) words, that no neighbouring word extends with the same q; q is its smallest period. The
text is halved again and again; each half that is left holds the runs that lie within it, and at each midpoint those
that cross it are found: for every period, Z-functions of the right part and of the reversed left part, each followed
by what it is compared with, say how far words q apart go on being identical on both sides of the midpoint. Where both
together are at least q words, there is a run. A repetition that goes on beyond its segment is left to the segment
above, whose midpoint it crosses too; equal intervals keep the smallest period.

A run repeats its first least / 2 words q words later. Segments that hold no two equal word groups of that length can't
hold a run and aren't looked at; which groups are equal is told by hashes, and two groups that only have the same
hash cost time, nothing else. So does a text without repetitions: it is interned and hashed, and done.

Each text is worked on by itself, in O(n log n), with some 100 bytes of memory a word where it repeats itself.

Defined results: a null text has no words; words are parted by space, tab, line feed, vertical tab, form feed and
carriage return only; repeated rows are each worked on; null ids stay; an empty table gives no rows; extra columns stay,
but those of the names of the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LEAST = 12
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def z_values(s: list[int], upto: int) -> list[int]:
    """How many items from each place on, up to a place, equal those from the beginning; the first value is the length."""
    n, z = len(s), [0] * upto
    z[0] = n
    left = right = 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if k:
            left, right = i, i + k
    return z


def _crossing(w: list[int], low: int, mid: int, high: int, least: int, found: dict[tuple[int, int], int]) -> None:
    """Add the runs within w[low:high] that cross mid: (start, end) to period."""
    u, v = w[low:mid], w[mid:high]
    a, b = len(u), len(v)
    u_back = u[::-1]
    # what of the left part, read backwards, comes again before each place; what of the right part comes again from each
    back = z_values([*u_back, -1, *v[::-1], *u_back], a + 1 + b)
    ahead = z_values([*v, -1, *u, *v], b + 1 + a)
    back[0], ahead[0] = a, b
    # the word q behind: the midpoint's last word and that one, the midpoint's first and that one
    right = [(mid - y, mid + q + x, q) for q, x, y in zip(range(1, b + 1), [*ahead[1:b], 0], back[: a : -1]) if x + y >= q]
    left = [(mid - q - y, mid + x, q) for q, x, y in zip(range(1, a + 1), ahead[: b : -1], [*back[1:a], 0]) if x + y >= q]
    n = len(w)
    for start, end, q in right + left:
        if end - start < least:
            continue
        if start == low and low and w[low - 1] == w[low - 1 + q] or end == high and high < n and w[high] == w[high - q]:
            continue
        if q < found.get((start, end), n):
            found[start, end] = q


def _again(w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of so many words that come again: where each begins, and where its next copy ends."""
    count = len(w) - size + 1
    if count < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h, factor = np.zeros(count, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for k in range(size):
        h = (h + w[k : k + count].astype(np.uint64) + np.uint64(1)) * factor
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    return order[:-1][same], order[1:][same] + size


def runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if len(words) < max(least, 2):
        return []
    number = {x: i for i, x in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return []
    w = list(map(number.__getitem__, words))
    starts, ends = _again(np.array(w, np.int64), max(1, (least + 1) // 2))
    found: dict[tuple[int, int], int] = {}
    segments = [(0, len(w), starts, ends)]
    while segments:
        low, high, starts, ends = segments.pop()
        if high - low < max(least, 2) or not len(starts):
            continue
        mid = (low + high) // 2
        _crossing(w, low, mid, high, least, found)
        inside = ends <= mid
        segments.append((low, mid, starts[inside], ends[inside]))
        inside = starts >= mid
        segments.append((mid, high, starts[inside], ends[inside]))
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words, one space between, without those that a run holds after its first period."""
    if not found:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return b" ".join([x for x, k in zip(words, keep.tolist()) if k])


def find(docs: DataFrame, text: str = "text", least: int = LEAST, out: str = "runs", collapsed: str = "collapsed", keep: list[str] | None = None) -> DataFrame:
    """Add every text's runs (start, length, period; words numbered from 0) and its words without the repetitions."""
    if least < 2:
        raise ValueError("a run has two words at least")

    def make():
        def fn(column: pa.Array):
            offsets, flat, texts = [0], [], []
            for raw in column.cast(pa.binary()).to_pylist():
                # bytes are split at exactly the six white space characters
                words = (raw or b"").split()
                found = runs(words, least)
                flat += found
                offsets.append(len(flat))
                texts.append(collapse(words, found))
            fields = np.array(flat, np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(fields[:, i]) for i in range(3)], ["start", "length", "period"])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items), pa.array(texts, pa.binary()).view(pa.string())

        return fn

    fields = [T.StructField(out, T.ArrayType(RUN)), T.StructField(collapsed, T.StringType())]
    return common.with_columns(docs, [text], fields, make, keep, owner="periodic")


def digests(out: str = "runs", collapsed: str = "collapsed") -> list[Column]:
    """n_runs, the longest run (start, length, period, exponent_milli; null without), and hashes of runs and text."""
    found = F.col(out)
    # of the longest, the first; of those, the one of the smallest period
    first = F.array_min(F.transform(found, lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform(found, lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))))
    listed = F.when(F.size(found) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    length = -first["shorter"]
    return [
        F.size(found).cast("long").alias("n_runs"), first["start"].alias("start"), length.alias("length"), first["period"].alias("period"),
        F.floor(F.lit(1000) * length / first["period"]).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col(collapsed), 256).alias("collapsed_sha256"),
    ]
