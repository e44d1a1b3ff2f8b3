"""Leaves of a query looked up in the positional index, and its tree evaluated by merging lists, segment by segment.

What a leaf asks for is first turned into words of the snapshot: a term into the words of its normal forms, a word of a
morphological phrase into the words that share a lemma with it, a phrase into the words that its pieces can be parts of (its
first piece ends a word, its last begins one, those between are whole). Then the blocks of these words alone are
read, brought together by segment, and merged: phrases by adjacent places, AND and OR by the chunks that the sides
have, NOT by those that they haven't. A phrase's words only say where it can stand; the text has the last word.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import languages as L
from ..functions import text as X
from ..sources import postings as P
from . import language as Q

#: A phrase's piece that more words of the snapshot hold than these isn't looked up: texts are scanned for it.
MOST_WORDS = 5000

#: Fixed value: the letter whose lower case depends on what stands beside it.
SIGMA = "Σ"


@dataclass(frozen=True)
class Seek:
    """Words that may stand at each of consecutive places; for a term one place, and which of its words are expansions."""

    places: tuple[frozenset[str], ...]
    expansions: frozenset[str] = frozenset()
    sure: bool = True

    @property
    def tokens(self) -> frozenset[str]:
        return frozenset().union(*self.places)


def term(index: P.Index, words: dict[str, bool], adapter: L.Adapter) -> Seek:
    found = index.of_forms(list(words), adapter)
    return Seek((frozenset(found),), frozenset(t for t, form in found.items() if words[form]))


def morph_phrase(index: P.Index, words: Sequence[str], adapter: L.Adapter) -> Seek:
    return Seek(tuple(frozenset(index.of_lemmas(adapter.lemma_words(w), adapter)) for w in words))


def pieces(phrase: str) -> list[tuple[str, bool, bool]]:
    """The words of a phrase in lower case, each with whether it may go on to the left and to the right."""
    found = list(regex.finditer(X.WORD, phrase))
    return [(m[0].lower(), m.start() == 0, m.end() == len(phrase)) for m in found]


def phrase(index: P.Index, text: str) -> Seek | None:
    """Where a text that stands anywhere, also within words, can be; None if only a scan can tell."""
    cut = pieces(text)
    if not cut or SIGMA in text:
        return None
    open_ones = [(w, left, right) for w, left, right in cut if left or right]
    held: dict[tuple, list[str]] = {}
    if open_ones:
        token, words = F.col("token"), index.words()
        ask = {x: token.contains(x[0]) if x[1] and x[2] else token.endswith(x[0]) if x[1] else token.startswith(x[0]) for x in open_ones}
        for x, fits in ask.items():
            some = words.where(fits).select("token").limit(MOST_WORDS + 1).collect()
            if len(some) > MOST_WORDS:
                return None
            held[x] = [r["token"] for r in some]
    # a piece that is all of the phrase is in a word for certain, whatever its case in the text was
    return Seek(tuple(frozenset(held.get(x, [x[0]])) for x in cut), sure=False)


def narrow(index: P.Index, chunks: DataFrame, needles: Sequence[str]) -> DataFrame:
    """The chunks that can hold one of some strings, in whatever case; all of them if only a scan can tell.

    What looks for these strings in the texts finds the same in them as in all chunks.
    """
    seeks = []
    for x in dict.fromkeys(needles):
        s = phrase(index, x)
        if s is None:
            return chunks
        seeks.append(s)
    if not seeks:
        return chunks.limit(0)
    ids = evaluate(index, seeks, None, []).select("chunk_id")
    return chunks.join(ids, chunks["chunk_id"].cast("string") == ids["chunk_id"], "left_semi")


def _tree(node: Q.Node, number: dict[int, int]):
    if isinstance(node, Q.Term | Q.Phrase):
        return number[id(node)]
    if isinstance(node, Q.Not):
        return ("not", _tree(node.child, number))
    return ("and" if isinstance(node, Q.And) else "or", *(_tree(c, number) for c in node.children))


def _may(tree, upper: list[np.ndarray], lower: list[np.ndarray]) -> np.ndarray:
    """Chunks that the tree may match, given those that each leaf may match and those that it matches for certain."""
    if isinstance(tree, int):
        return upper[tree]
    if tree[0] == "not":
        return ~_may(tree[1], lower, upper)
    sides = [_may(x, upper, lower) for x in tree[1:]]
    return np.logical_and.reduce(sides) if tree[0] == "and" else np.logical_or.reduce(sides)


class Lists:
    """The blocks of one segment, decoded: of each word its chunks, counts and places."""

    def __init__(self, table: pa.Table):
        self.words: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for token, n, cf, data in zip(*(table.column(c).to_pylist() for c in ("token", "n", "cf", "lists"))):
            docs, tf, _, places = P.decode(n, cf, data)
            self.words[token] = docs, tf, places

    def occurrences(self, tokens: frozenset[str]) -> np.ndarray:
        """All places of some words: chunk << 32 | place, in order."""
        found = [np.repeat(d, tf) << 32 | places for d, tf, places in (self.words[t] for t in tokens if t in self.words)]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def adjacent(self, places: Sequence[frozenset[str]]) -> np.ndarray:
        """Where consecutive words begin that fit."""
        out = None
        for i, tokens in enumerate(places):
            here = self.occurrences(tokens)
            here = here[(here & 0xFFFFFFFF) >= i] - i
            out = here if out is None else np.intersect1d(out, here, assume_unique=True)
            if not len(out):
                break
        return out


def _fields(many: int) -> list[T.StructField]:
    out = []
    for i in range(many):
        out += [T.StructField(f"c{i}", T.IntegerType()), T.StructField(f"f{i}", T.IntegerType()), T.StructField(f"v{i}", T.BooleanType())]
    return out


def evaluate(index: P.Index, seeks: Sequence[Seek], root: Q.Node | None, nodes: Sequence[Q.Node]) -> DataFrame:
    """Chunks that the tree may match, or with root None that any leaf may: chunk_id, and of each leaf i c (occurrences), f (first place) and v (whether an expansion stands there)."""
    tokens = frozenset().union(*(s.tokens for s in seeks))
    tree = _tree(root, {id(n): i for i, n in enumerate(nodes)}) if root is not None else ("or", *range(len(seeks)))
    hits = T.StructType([T.StructField("segment", T.LongType()), T.StructField("ordinal", T.IntegerType()), *_fields(len(seeks))])
    blocks = index.blocks(sorted(tokens)).select("segment", "token", "n", "cf", "lists")
    found = blocks.groupBy("segment").applyInArrow(_evaluator(list(seeks), tree, hits.names), hits)
    return index.chunk_ids(found)


def _evaluator(seeks: list[Seek], tree, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        lists = Lists(table)
        docs = np.unique(np.concatenate([d for d, *_ in lists.words.values()]))
        n, columns, upper, lower = len(docs), [], [], []
        for s in seeks:
            starts = lists.adjacent(s.places)
            own, at, count = np.unique(starts >> 32, return_index=True, return_counts=True)
            rows = np.searchsorted(docs, own)
            c, f, via = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.zeros(n, bool)
            c[rows], f[rows] = count, starts[at] & 0xFFFFFFFF
            if s.expansions:
                via[rows] = np.isin(starts[at], lists.occurrences(s.expansions))
            columns += [pa.array(c), pa.array(f, mask=f < 0), pa.array(via)]
            upper.append(c > 0)
            lower.append(c > 0 if s.sure else np.zeros(n, bool))
        keep = np.flatnonzero(_may(tree, upper, lower))
        head = [pa.array(np.full(len(keep), table.column("segment")[0].as_py())), pa.array(docs[keep].astype(np.int32))]
        return pa.table([*head, *(x.take(pa.array(keep)) for x in columns)], names=names)

    return run
