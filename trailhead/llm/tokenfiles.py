"""Token ids as ORC files: every text's ids, in order of its id, to be read in stripes and found by metadata.

Texts are dealt by ranges of (id, hash of the text, row) over the partitions and sorted within them; each partition is
one file, written as its texts are encoded. A row holds the document's id, where its ids begin in the file, how many
there are, and the ids: ORC writes whole numbers as run lengths and deltas, keeps least and greatest values of every
few rows (the row index), and Bloom filters of the document ids. A small table beside the files, the manifest, has one
row a file with the number of all ids before it; with it every row knows its place in the whole sequence, so that
stripes can be read in any order, by any number of tasks. read() with ids reads the row groups that may hold them.

Texts are encoded by the tokenizers library, in parts that its byte-level pre-tokenizer keeps apart, so that a text's ids
are those of its parts one after another; parts come again and again, and a bounded cache keeps theirs. A plain text's
parts are the pre-tokenizer's pieces, told from the kinds of neighbouring bytes for all texts of a portion at once; Arrow
finds the different ones, so that each is looked up once a portion, and puts the ids together. Another text's parts
begin at single spaces between two characters that aren't white space. A text with a special token is one part. Where a
vocabulary file has another pre-tokenizer, or one that could look over such a boundary, whole texts go to the library.

Defined results: a null text counts as empty and has the end id alone; rows without an id come first; rows of one id
are in order of the text's hash, then as stored; equal rows are each written; an empty table gives files without
rows; extra columns aren't written, whatever their names.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Rows between two entries of the row index, and bytes of a stripe.
STRIDE_ROWS = 1000
STRIPE_BYTES = 32 << 20
#: Bytes of parts and ids that a worker keeps at most.
CACHED_BYTES = 240 << 20
ENTRY_BYTES = 170
#: Bytes of texts that are encoded at once.
PORTION_BYTES = 4 << 20

#: A single space between two characters that aren't white space in any reading of the word.
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s\s|^\s|\s$")

#: Letters that all tables of characters call letters: basic, Latin and Cyrillic ones. Of plain texts, which have these, and
#: ASCII without most control characters, the pre-tokenizer's own pieces can be told.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u0400-\u0481\u048a-\u052f"
_NOT_PLAIN = rf"[^\t\n\r\x20-\x7e{_LETTER}]"

#: Kinds of bytes in plain texts; from _SPACE on white space. Bytes from 128 on are parts of letters.
_WORD, _DIGIT, _OTHER, _SPACE, _BREAK = range(5)
_KINDS = np.full(256, _WORD, np.uint8)
_KINDS[:128] = [_BREAK if c in "\t\n\r" else _SPACE if c == " " else _DIGIT if c.isdigit() else _WORD if c.isalpha() else _OTHER for c in map(chr, range(128))]


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies have for each byte: its own if it is printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = "".join(letter for _, letter in sorted(_byte_letters().items()))


def splittable(vocabulary: dict) -> bool:
    """Whether texts may be encoded in parts that begin with a space."""
    pre = vocabulary.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    added = vocabulary.get("added_tokens") or []
    alone = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or re.search(r"\s", t["content"]) for t in added)
    return bool(plain and alone and (vocabulary.get("model") or {}).get("type") == "BPE" and not vocabulary.get("normalizer") and not vocabulary.get("post_processor"))


def units(text: str) -> list[str]:
    """The text in parts, each but the first beginning with a space."""
    cut = text.split(" ") if not _ODD.search(text) else _BOUNDARY.split(text)
    return [cut[0], *[" " + x for x in cut[1:]]]


def pieces(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer's pieces begin in the bytes of plain texts, which begin at starts."""
    size = len(raw)
    kind, first = np.full(size + 2, _BREAK, np.uint8), np.zeros(size + 2, bool)
    kind[:size] = _KINDS[raw]
    first[starts] = first[size:] = True
    white = kind >= _SPACE
    before, here = kind[: size - 1], kind[1:size]
    # a space goes with the word behind it; of white space before a word all but the last character is one piece
    word_next = ~(white | first)[2 : size + 1]
    begins = first[:size].copy()
    begins[1:] |= np.where(white[1:size], ~white[: size - 1] | word_next, (before != here) & (before != _SPACE))
    # 's 't 'm 'd 're 've 'll, where a piece begins with the apostrophe
    marks = np.flatnonzero((raw == ord("'")) & begins)
    if len(marks):
        padded = np.concatenate([raw, np.zeros(2, np.uint8)])
        a, b = padded[marks + 1], padded[marks + 2]
        short = np.isin(a, list(b"stmd"))
        long = ~first[marks + 2] & (np.isin(a, list(b"rv")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        own = ~first[marks + 1] & (short | long)
        ends = (marks + np.where(short, 2, 3))[own]
        begins[marks[own] + 1] = False
        begins[ends[ends < size]] = True
    return np.flatnonzero(begins)


class Known(dict):
    """Ids of parts, found out when first asked for; bounded in bytes.

    When the young half is full it becomes the old one, from which what comes again goes back.
    """

    def __init__(self, encode: Callable[[str | bytes], bytes]):
        self.encode = encode
        self.renew()

    def renew(self, old: dict[str | bytes, bytes] | None = None) -> None:
        self.old, self.room = old or {}, CACHED_BYTES // 4
        self.clear()

    def __missing__(self, part: str | bytes) -> bytes:
        if self.room < 0:
            self.renew(self.copy())
        ids = self.old.get(part)
        if ids is None:
            ids = self.encode(part)
        self.room -= ENTRY_BYTES + len(part) + len(ids)
        self[part] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        self.library = Tokenizer.from_str(json.dumps(vocabulary))
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.split = splittable(vocabulary)
        self.special = [t["content"] for t in vocabulary.get("added_tokens") or []]
        self.odd = "|".join([_NOT_PLAIN, *map(re.escape, self.special)])
        self.pieces, self.units = Known(self._piece), Known(self._text)

    def forget(self) -> None:
        for known in (self.pieces, self.units):
            known.renew()

    def _text(self, text: str) -> bytes:
        """Ids of a text, by the library's whole pipeline."""
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _piece(self, piece: bytes) -> bytes:
        """Ids of one piece of the pre-tokenizer, by the library's model alone."""
        found = self.model.tokenize(codecs.charmap_decode(piece, "strict", _BYTE_LETTERS)[0])
        return found[0].id.to_bytes(4, "little") if len(found) == 1 else struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _odd(self, text: str) -> bytes:
        """Ids of a text that isn't plain."""
        if not self.split or any(t in text for t in self.special):
            return self._text(text)
        return b"".join(map(self.units.__getitem__, units(text)))

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of texts, one text after another with the end behind each, and how many each has."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd) if self.split else pa.array(np.ones(len(texts), bool))
        plain = pc.if_else(odd, "", texts).cast(pa.large_binary())
        _, offsets, data = plain.buffers()
        at = np.frombuffer(offsets, np.int64)[plain.offset : plain.offset + len(plain) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        begins = pieces(raw, at[:-1]) if len(raw) else np.empty(0, np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(raw))), pa.py_buffer(raw)]).dictionary_encode()
        values = [*map(self.pieces.__getitem__, found.dictionary.to_numpy(zero_copy_only=False).tolist()), end]
        # behind a plain text's pieces comes the end, in place of another's the whole
        last = np.full(len(texts), len(values) - 1)
        others = np.flatnonzero(odd)
        last[others] = len(values) + np.arange(len(others))
        values += [self._odd(x) + end for x in texts.filter(odd).to_pylist()]
        ends = np.searchsorted(begins, at[1:])
        out = pa.array(values, pa.large_binary()).take(pa.array(np.insert(found.indices.to_numpy(), ends, last)))
        _, offsets, data = out.buffers()
        places = np.frombuffer(offsets, np.int64)[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]
        return np.frombuffer(data or b"", "<i4"), np.diff(places) // 4

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file; its cache goes when other work begins."""
    if path not in _ENCODERS:
        # the library's threads would take cores of other tasks
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    common.hold("tokenfiles", _ENCODERS[path].forget)
    return _ENCODERS[path]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every text, and the end id behind them, under path: data/ (ORC) and manifest/."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "h", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("file", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        common.begin("tokenfiles")
        e, file, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in common.portions(batch, PORTION_BYTES):
                ids, n = e.encode_all(some.column(1), end)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                files = pa.array(np.full(len(n), file, np.int32))
                yield pa.RecordBatch.from_arrays([files, some.column(0), pa.array(start + ends - n), pa.array(n), lists], names=schema.names)
                start += int(n.sum())

    out = dealt.mapInArrow(run, schema).write.option("orc.create.index", "true").option("orc.row.index.stride", STRIDE_ROWS).option("orc.stripe.size", STRIPE_BYTES)
    out.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(f"{path}/data")
    # the counts of each file, from its narrow columns; one row a file
    spark = docs.sparkSession
    totals = spark.read.schema(schema).orc(f"{path}/data").groupBy("file").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("n_documents")).collect()
    before, manifest = 0, []
    for r in sorted(totals):
        manifest.append((r["file"], before, r["n"], r["n_documents"]))
        before += r["n"]
    spark.createDataFrame(manifest, "file int, before long, n_tokens long, n_documents long").coalesce(1).write.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, doc_ids: Sequence | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids; with doc_ids those documents alone.

    A file is read by as many tasks as it has splits of stripes. What doc_ids rule out by least and greatest values or by
    Bloom filters isn't read.
    """
    rows = spark.read.orc(f"{path}/data")
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(list(doc_ids)))
    # one row a file
    manifest = spark.read.parquet(f"{path}/manifest").select("file", "before")
    return rows.join(F.broadcast(manifest), "file").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """Of read()'s rows: doc_id, start, n_tokens and ids_crc32, the ids counted as they are read."""
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))])

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<i4")).view(np.uint8)
            at = lists.offsets.to_numpy().astype(np.int64)
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(sums, pa.int64())], names=schema.names)

    return rows.select("doc_id", "start", "ids").mapInArrow(run, schema)
