"""Byte-level BPE, encoded exactly by dynamic programming over prefixes.

For every prefix of a piece of text exactly one token can be the last one of the prefix's encoding. The tokens that
are suffixes of a prefix come from an automaton over the vocabulary; a token t is the last one if the token before
it, which is the last one of the shorter prefix, may stand next to t, that is, if merging would never cross the
boundary between the two. Back-pointers then give the ids. No merge loop runs over the text.

Ids must be in order of their merges (each token's id is above those of its two parts), as in any vocabulary that
was written in the order of training.

Defined results: null text counts as empty and gives no ids; a text may be of any length (long pieces aren't kept in
the caches); repeated rows give repeated results; an input column named like an output column is replaced.
"""

from __future__ import annotations

import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The pre-tokenising pattern of byte-level BPE; \s stands for Unicode white space.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Bytes of each cache's younger half, entries' overheads included; the older half holds as many at most.
CACHED_CHUNK_BYTES, CACHED_PIECE_BYTES = 64 << 20, 8 << 20
ENTRY_BYTES = 200
CACHED_PAIRS = 300_000
LONGEST_CACHED = 64


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 up."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    """The tables that encoding and decoding need, read from a tokenizer file (JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.left = list(range(size))  # a token that isn't merged from others is its own part
        self.right = list(range(size))
        self.merged: dict[int, int] = {}
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, t = ids[a], ids[b], ids[a + b]
            if t <= max(x, y):
                raise ValueError("ids aren't in the order of the merges")
            self.left[t], self.right[t] = x, y
            self.merged[x << 32 | y] = t
        self.automaton = ahocorasick.Automaton()
        self.whole = {self.token_bytes[i].decode("latin-1"): i for i in ids.values()}
        for token, i in self.whole.items():
            self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, stay as they are when their bytes are encoded together.

        As merging goes on, the tokens at the boundary are those of a's right edge and b's left edge, each until the
        merge that takes it up. A pair x, y of these would be merged, across the boundary, if its merge comes before
        x is taken up from its left, and no later than y from its right (of equal merges the leftmost goes first).
        """
        merged, left, right, end = self.merged, self.left, self.right, len(self.left)
        x_until, x = end, a
        while True:
            y_until, y = end, b
            while True:
                t = merged.get(x << 32 | y)
                if t is not None and t < x_until and t <= y_until:
                    return False
                if left[y] == y:
                    break
                y_until, y = y, left[y]
            if right[x] == x:
                return True
            x_until, x = x, right[x]


class Cache:
    """A map bounded in bytes: when the young half is full it becomes the old one, and what is used again returns to the young."""

    def __init__(self, most: int):
        self.most, self.young, self.old, self.room = most, {}, {}, most

    def put(self, key: str, value: bytes) -> None:
        size = ENTRY_BYTES + len(key) + len(value)
        if size > self.room:
            self.young, self.old, self.room = {}, self.young, self.most
        self.room -= size
        self.young[key] = value

    def again(self, key: str) -> bytes | None:
        """The value of a key that isn't in the young half."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value


class Encoder:
    """Encodes and decodes texts; keeps bounded caches of chunks, pieces and pairs."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()
        self.split = regex.compile(PIECES).findall
        self.lone_space = regex.compile(rf" (?=[{SPACE}]|$)").search
        self.inner_space = regex.compile(rf" (?=[^{SPACE}])")
        self.cut = regex.compile("|".join(map(regex.escape, self.v.special))) if self.v.special else None

    def forget(self) -> None:
        """Empty the caches."""
        self.chunks, self.pieces = Cache(CACHED_CHUNK_BYTES), Cache(CACHED_PIECE_BYTES)
        self.pairs: dict[int, bool] = {}

    def piece(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        s = text if text.isascii() else text.encode().decode("latin-1")
        whole = self.v.whole.get(s)
        if whole is not None:
            # the longest match of its last prefix, with nothing before it
            return [whole]
        # by the prefix's last place: its last token, and the last place before that token
        last, before, pairs = [-1] * len(s), [-1] * len(s), self.pairs
        for end, (size, t) in self.v.automaton.iter(s):
            if last[end] >= 0:
                continue
            start = end - size
            if start >= 0:
                p = last[start]
                if p < 0:
                    continue
                ok = pairs.get(k := p << 32 | t)
                if ok is None:
                    if len(pairs) >= CACHED_PAIRS:
                        pairs.clear()
                    ok = pairs[k] = self.v.compatible(p, t)
                if not ok:
                    continue
                before[end] = start
            last[end] = t
        ids, at = [], len(s) - 1
        while at >= 0:
            ids.append(last[at])
            at = before[at]
        ids.reverse()
        return ids

    def chunk(self, text: str) -> bytes:
        """Ids, as int32 bytes, of a run of text that begins and ends where pre-tokens do."""
        found = self.split(text)
        if len(found) == 1:
            # kept with the chunks
            return array("i", self.piece(text)).tobytes()
        out = []
        for p in found:
            got = self.pieces.young.get(p) or self.pieces.again(p)
            if got is None:
                got = array("i", self.piece(p)).tobytes()
                if len(p) <= LONGEST_CACHED:
                    self.pieces.put(p, got)
            out.append(got)
        return b"".join(out)

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. A pre-token begins at every space before a non-space."""
        if self.lone_space(text):
            parts = self.inner_space.split(text)
        else:
            parts = text.split(" ")
        first, chunks = self.chunk(parts[0]) if parts[0] else b"", self.chunks
        del parts[0]
        out = list(map(chunks.young.get, parts))
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    part = parts[i]
                    # another miss of the same text may have put it
                    got = chunks.young.get(part) or chunks.again(part)
                    if got is None:
                        got = self.chunk(" " + part)
                        if len(part) <= LONGEST_CACHED:
                            chunks.put(part, got)
                    out[i] = got
        return first + b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as an int32 array; the strings of special tokens become these tokens."""
        if not self.cut or not self.cut.search(text):
            return np.frombuffer(self.plain(text), np.int32)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.plain(text[at : m.start()]) if m.start() > at else b"", np.int32(self.v.special[m[0]]).tobytes()]
            at = m.end()
        if at < len(text):
            out.append(self.plain(text[at:]))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.v.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def _owner(path: str) -> str:
    return f"bpe {path}"


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file. It serves many tasks, and goes, with its caches, when the worker turns to other work."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    e = _ENCODERS[path]

    def release():
        _ENCODERS.pop(path, None)
        e.forget()

    common.hold(_owner(path), release)
    return e


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep=None) -> DataFrame:
    """Add the token ids of a text column, and in decoded, if named, the text that those ids decode to.

    path is the tokenizer file's place on every executor. keep: the columns that stay, all if None.
    """
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))

    def make():
        e = encoder(path)

        def fn(column: pa.Array):
            got = [e.encode(x) for x in common.strings(column)]
            return [_lists(got), *([pa.array([e.decode(x) for x in got], pa.string())] if decoded else [])]

        return fn

    return common.with_columns(df, [text], fields, make, keep, _owner(path))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text", keep=None) -> DataFrame:
    """Add the text that a column of ids decodes to; null ids give an empty text."""

    def make():
        e = encoder(path)

        def fn(column: pa.Array):
            return [pa.array([e.decode(np.array(x or [], np.int32)) for x in column.to_pylist()], pa.string())]

        return fn

    return common.with_columns(df, [ids], [T.StructField(text, T.StringType())], make, keep, _owner(path))


def digests(ids: str = "ids", decoded: str = "decoded") -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of the operator's columns."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]
