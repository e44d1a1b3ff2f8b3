"""Removal of repeated substrings: every byte that a `length`-byte string covers which also starts earlier.

Earlier means in a row of a smaller id (rows of one id are ordered as they are stored), or in the same row at a smaller
start. Matches never cross rows and are judged on the input. A window is a string of `length` bytes; all windows are
judged, exactly, in these steps:

1. Each window picks an anchor: of its 32-byte strings the one with the least hash, the leftmost of equals. Equal
   windows pick equal anchors in equal places. Strings that are frequent in a sample come last in that order, so that
   no anchor stands for very many different windows; this moves work about and changes no result.
2. Windows in a row that pick the same anchor form a piece. Pieces go, as hashes, to ranges of anchor hashes. A piece
   that equals an earlier one (all bytes, same anchor) has all of its windows removed; one piece of each kind stays.
   Equal pieces of one batch are settled before they are sent; those of frequent strings over a whole task, so that a
   passage that very many rows share sends a few pieces a task and not one a row. Ranges go by the bytes of the table
   and keep their size at any scale.
3. If the pieces that stay have an anchor in common with others that differ, their bytes go to shards by anchor hash
   (an anchor of very many kinds is dealt out by the hash of each window instead). Each shard gets a suffix array by
   induced sorting and permuted common prefixes up to `length`; suffixes that share that much stand side by side, all
   but the first place of each such group are removed.
4. The removed ranges are joined with the rows, merged and cut out.

Rows are numbered by one scan and written with their numbers; every later scan reads those.

Defined results: null text is empty; texts under `length` bytes stay whole; texts of any length are read whole; rows
whose id is null come after all others; repeated rows are rows of one id; an empty table gives no rows; other columns
are ignored. Pieces are equal if the 64-bit hashes of their anchors and 96 bits of hashes of their bytes
and the anchor's place are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, suffixes

GRAM = 32
CHUNK = 1 << 21
SAMPLE_ROWS = 20_000
SHARD_BYTES = 1 << 20
RANGE_BYTES = 4 << 20
MOST_KINDS = 20_000
NULL_ID = (1 << 63) - 1

_RNG = np.random.default_rng(8)
SYMBOL = _RNG.integers(0, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)

#: Frequent pieces that a task remembers.
REMEMBERED = 100_000

#: A piece: anchor hash, 96 bits of content hash, id and number of its row, first window's start, number of windows.
PIECE = np.dtype([("key", "<u8"), ("kind", "<u8"), ("more", "<u4"), ("id", "<i8"), ("row", "<i8"), ("start", "<i4"), ("n", "<i4")])
HASHES = ("key", "kind", "more")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    h, base, k = SYMBOL[text], BASE, 1
    while k < GRAM:
        h = h[:-k] * base + h[k:]
        base, k = np.uint64(int(base) ** 2 % (1 << 64)), 2 * k
    return mixed(h)


def least_ahead(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` entries in a row."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


class Pieces:
    """Cuts rows into pieces."""

    def __init__(self, length: int, frequent: np.ndarray):
        self.length = length
        self.frequent = np.zeros(1 << 22, bool)
        self.frequent[(frequent >> np.uint64(42)).astype(np.int64)] = True
        self.any = bool(len(frequent))
        self.seen: dict[tuple, tuple] = {}

    def cut(self, text: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, rows: np.ndarray, offset: int) -> np.ndarray:
        """Pieces of rows that lie side by side in text, in their order; offset is that of text in a lone row."""
        n = len(text)
        n_windows = n - self.length + 1
        if n_windows < 1:
            return np.zeros(0, PIECE)
        grams = gram_hashes(text)
        order = grams >> np.uint64(33) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64)
        if self.any:
            order |= self.frequent[(grams >> np.uint64(42)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
        anchor = (least_ahead(order, self.length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # windows that lie in one row; the row of each
        owner = np.repeat(np.arange(len(firsts)), sizes)[:n_windows]
        at = np.arange(n_windows)
        valid = at + self.length <= (firsts + sizes)[owner]
        begins = valid.copy()
        begins[1:] &= (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
        start = np.flatnonzero(begins)
        if not len(start):
            return np.zeros(0, PIECE)
        total = np.concatenate([[0], np.cumsum(valid)])
        count = np.diff(np.append(total[start], total[-1]))
        raw, digest = memoryview(text), xxhash.xxh3_128_digest
        ends = start + count - 1 + self.length
        content = np.frombuffer(b"".join(digest(raw[x:y]) for x, y in zip(start.tolist(), ends.tolist())), "<u8").reshape(-1, 2)
        out = np.zeros(len(start), PIECE)
        a, o = anchor[start], owner[start]
        out["key"], out["kind"] = grams[a], content[:, 0]
        out["more"] = (content[:, 1] ^ mixed((a - start).astype(np.uint64) + np.uint64(1))) >> np.uint64(32)
        out["id"], out["row"], out["start"], out["n"] = ids[o], rows[o], start - firsts[o] + offset, count
        return out

    def settled(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first piece of each kind, the others); of frequent kinds also those that an earlier call has sent an earlier one of."""
        first, again = settle(p)
        hot = np.flatnonzero(self.frequent[(first["key"] >> np.uint64(42)).astype(np.int64)])
        if not len(hot):
            return first, again
        late = np.zeros(len(first), bool)
        for i, *values in zip(hot.tolist(), *(first[c][hot].tolist() for c in (*HASHES, "id", "row", "start"))):
            kind, place = tuple(values[:3]), tuple(values[3:])
            before = self.seen.get(kind)
            if before is not None and before < place:
                late[i] = True
                continue
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[kind] = place
        return first[~late], np.concatenate([again, first[late]])

    def of_rows(self, texts: list[bytes], ids: np.ndarray, rows: np.ndarray):
        """Arrays of pieces, of about CHUNK bytes of rows each; longer rows are read in overlapping parts."""
        held: list[int] = []
        size = 0

        def together():
            parts = np.array([len(texts[i]) for i in held])
            return self.cut(np.frombuffer(b"".join(texts[i] for i in held), np.uint8), np.cumsum(parts) - parts, parts, ids[held], rows[held], 0)

        for i, text in enumerate(texts):
            if len(text) < self.length:
                continue
            if size + len(text) > CHUNK and held:
                yield together()
                held, size = [], 0
            if len(text) > CHUNK:
                whole = np.frombuffer(text, np.uint8)
                for at in range(0, len(text) - self.length + 1, CHUNK):
                    part = whole[at : at + CHUNK + self.length - 1]
                    yield self.cut(part, np.zeros(1, np.int64), np.array([len(part)]), ids[i : i + 1], rows[i : i + 1], at)
                continue
            held.append(i)
            size += len(text)
        if held:
            yield together()


def places(p: np.ndarray, *before: np.ndarray) -> np.ndarray:
    """Order by the given arrays (the first counts most), then place."""
    return np.lexsort((p["start"], p["row"], p["id"], *before[::-1]))


def settle(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first piece of each kind, the others)."""
    p = p[places(p, *(p[c] for c in HASHES))]
    first = np.ones(len(p), bool)
    first[1:] = False
    for c in HASHES:
        first[1:] |= p[c][1:] != p[c][:-1]
    return p[first], p[~first]


def ranges_by_row(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Rows, and for each its ranges (int32 pairs), overlapping ones merged."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(row):
        return [], []
    new_row = np.concatenate([[True], row[1:] != row[:-1]])
    # ends so far within the row: a running maximum over ends lifted by the row's number
    lift = (np.cumsum(new_row) - 1) << 32
    top = np.maximum.accumulate(end + lift) - lift
    opens = new_row.copy()
    opens[1:] |= start[1:] > top[:-1]
    at = np.flatnonzero(opens)
    pairs = np.stack([start[at], top[np.append(at[1:], len(row)) - 1]], 1).astype("<i4")
    rows_of = row[at]
    cuts = np.flatnonzero(np.concatenate([[True], rows_of[1:] != rows_of[:-1]]))
    return rows_of[cuts].tolist(), [x.tobytes() for x in np.split(pairs, cuts[1:])]


REMOVED, SHARED, DEALT = 0, 1, 2
FLAGS = T.StructType([T.StructField("row", T.LongType()), T.StructField("what", T.IntegerType()), T.StructField("blob", T.BinaryType()), T.StructField("bytes", T.LongType())])
PARTS = T.StructType([T.StructField("range", T.LongType()), T.StructField("what", T.IntegerType()), T.StructField("blob", T.BinaryType())])


def _batch(names, *columns):
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id")
    return docs.select(F.monotonically_increasing_id().alias("row"), own, F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))


def frequent_grams(docs: DataFrame, n_rows: int, least: int = 5) -> np.ndarray:
    """Hashes of strings of GRAM bytes that stand out in chunks of a bounded sample of the rows."""
    share = min(1.0, SAMPLE_ROWS / max(1, n_rows))
    some = docs.where(F.pmod(F.xxhash64(F.lit("grams"), "row"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text")

    def run(batches):
        held, size = [], 0

        def count():
            h, n = np.unique(gram_hashes(np.frombuffer(b"\0".join(held).ljust(GRAM, b"\0"), np.uint8)), return_counts=True)
            keep = n >= least
            return _batch(["gram", "n"], pa.array(h[keep].view(np.int64)), pa.array(n[keep]))

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for at in range(0, len(t or b""), CHUNK):
                    held.append(t[at : at + CHUNK])
                    size += len(held[-1])
                    if size >= CHUNK:
                        yield count()
                        held, size = [], 0
        if held:
            yield count()

    found = some.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.col("n").desc(), "gram").limit(50_000).select("gram").collect()
    return np.array([r["gram"] for r in rows], np.int64).view(np.uint64)


def _cut_into_pieces(length: int, frequent: np.ndarray, n_ranges: int):
    # the low bits, as an anchor's high bits are small by choice
    low_bits = np.uint64(n_ranges - 1)

    def run(batches):
        pieces = Pieces(length, frequent)
        for batch in batches:
            ids, rows = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            order = np.lexsort((rows, ids))
            for p in pieces.of_rows([texts[i] for i in order], ids[order], rows[order]):
                if not len(p):
                    continue
                first, again = pieces.settled(p)
                r = (first["key"] & low_bits).astype(np.int64)
                by_range = np.argsort(r, kind="stable")
                first, r = first[by_range], r[by_range]
                cuts = np.flatnonzero(np.diff(r)) + 1
                blobs = [_packed(x) for x in np.split(first, cuts)]
                yield _batch(["range", "what", "blob"], pa.array(r[np.append(0, cuts)]), pa.array([SHARED] * len(blobs), pa.int32()), pa.array(blobs, pa.binary()))
                if len(again):
                    owners, merged = ranges_by_row(again["row"], again["start"], again["start"] + again["n"] - 1 + length)
                    both = [np.int64(o).tobytes() + m for o, m in zip(owners, merged)]
                    some = [o % n_ranges for o in owners]
                    yield _batch(["range", "what", "blob"], pa.array(some, pa.int64()), pa.array([REMOVED] * len(both), pa.int32()), pa.array(both, pa.binary()))

    return run


def _packed(p: np.ndarray) -> bytes:
    """Pieces as columns; the hashes as they are, the rest compressed."""
    order = places(p)
    p = p[order]
    rest = b"".join(np.diff(p[c], prepend=p[c][:1] * 0).tobytes() for c in ("id", "row", "start", "n"))
    head = b"".join(p[c].tobytes() for c in HASHES)
    return np.int64(len(p)).tobytes() + head + zstandard.ZstdCompressor(level=1).compress(rest)


def _unpacked(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    p = np.zeros(n, PIECE)
    at = 8
    for c in HASHES:
        p[c] = np.frombuffer(blob, PIECE[c], n, at)
        at += n * PIECE[c].itemsize
    rest, at = zstandard.ZstdDecompressor().decompress(blob[at:]), 0
    for c in ("id", "row", "start", "n"):
        size = n * PIECE[c].itemsize
        p[c] = np.cumsum(np.frombuffer(rest[at : at + size], PIECE[c]), dtype=PIECE[c])
        at += size
    return p


def _judge(length: int):
    """Over ranges that come in order: what is removed, and which pieces need a closer look."""

    def judged(blobs):
        first, again = settle(np.concatenate(blobs))
        key = first["key"]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        kinds = np.diff(np.append(starts, len(key)))
        owners, merged = ranges_by_row(again["row"], again["start"], again["start"] + again["n"] - 1 + length)
        if owners:
            yield _batch(FLAGS.names, pa.array(owners, pa.int64()), pa.array([REMOVED] * len(owners), pa.int32()), pa.array(merged, pa.binary()), pa.array([0] * len(owners), pa.int64()))
        of = np.repeat(kinds, kinds)
        for what, some in ((SHARED, (of > 1) & (of <= MOST_KINDS)), (DEALT, of > MOST_KINDS)):
            p = first[some]
            p = p[np.lexsort((p["start"], p["row"]))]
            if len(p):
                cuts = np.flatnonzero(np.diff(p["row"])) + 1
                parts = np.split(p, cuts)
                blobs = [x["key"].tobytes() + x["start"].tobytes() + x["n"].tobytes() for x in parts]
                size = [int((x["n"] + length - 1).sum()) if what == SHARED else int(x["n"].sum()) * length for x in parts]
                yield _batch(FLAGS.names, pa.array([int(x["row"][0]) for x in parts], pa.int64()), pa.array([what] * len(parts), pa.int32()), pa.array(blobs, pa.binary()), pa.array(size, pa.int64()))

    def run(batches):
        now, held = None, []
        for batch in batches:
            for r, what, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if what == REMOVED:
                    yield _batch(FLAGS.names, pa.array([int(np.frombuffer(blob, np.int64, 1)[0])], pa.int64()), pa.array([REMOVED], pa.int32()), pa.array([blob[8:]], pa.binary()), pa.array([0], pa.int64()))
                    continue
                if r != now and held:
                    yield from judged(held)
                    held = []
                now = r
                held.append(_unpacked(blob))
        if held:
            yield from judged(held)

    return run


#: A piece with its bytes: shard, then fields, then the text.
HEAD = np.dtype([("id", "<i8"), ("row", "<i8"), ("start", "<i4"), ("n", "<i4")])


def _contents(length: int, n_shards: int):
    """Rows (row, id, text, asked: their flagged pieces) to pieces with bytes: shard, heads, bytes."""

    def run(batches):
        for batch in batches:
            found: dict[int, tuple[list, list]] = {}
            for row, own, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
                for a in asked:
                    blob, n = a["blob"], len(a["blob"]) // 16
                    keys = np.frombuffer(blob, np.uint64, n)
                    starts, counts = np.frombuffer(blob, np.int32, 2 * n, 8 * n).reshape(2, n)
                    if a["what"] == DEALT:
                        # one piece for each window, dealt by its bytes
                        starts = np.concatenate([np.arange(s, s + c) for s, c in zip(starts.tolist(), counts.tolist())])
                        counts = np.ones(len(starts), np.int64)
                        keys = np.array([hash_of(text[s : s + length]) for s in starts.tolist()], np.uint64)
                    for k, s, c in zip((keys % np.uint64(n_shards)).tolist(), starts.tolist(), counts.tolist()):
                        heads, parts = found.setdefault(k, ([], []))
                        heads.append((own, row, s, c))
                        parts.append(text[s : s + c - 1 + length])
            if found:
                yield _batch(
                    ["shard", "heads", "bytes"],
                    pa.array(list(found), pa.int64()),
                    pa.array([np.array(h, HEAD).tobytes() for h, _ in found.values()], pa.binary()),
                    pa.array([b"".join(p) for _, p in found.values()], pa.binary()),
                )

    return run


def hash_of(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def repeated_windows(heads: np.ndarray, texts: list[bytes], length: int) -> tuple[list[int], list[bytes]]:
    """Ranges to remove, by row, among pieces: windows that equal one of an earlier place."""
    order = np.lexsort((heads["start"], heads["row"], heads["id"]))
    heads, texts = heads[order], [texts[i] for i in order]
    sizes = np.array([len(t) + 1 for t in texts])
    firsts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    ends = firsts + sizes - 1
    symbols = raw.astype(np.int16) + 1
    symbols[ends] = 0
    n = len(raw)
    # a piece's windows start at its first n places
    step = np.zeros(n + 1, np.int32)
    step[firsts] += 1
    step[firsts + heads["n"]] -= 1
    counted = np.cumsum(step[:n]) > 0
    sa = suffixes.suffix_array(symbols, 257)
    shared = suffixes.permuted_prefixes(raw, sa, length, counted)
    opens = shared[sa] < length
    opens[0] = True
    at = np.flatnonzero(opens)
    group = np.cumsum(opens) - 1
    first = np.minimum.reduceat(sa, at)[group]
    gone = np.sort(sa[sa != first])
    owner = np.searchsorted(firsts, gone, "right") - 1
    start = heads["start"][owner] + gone - firsts[owner]
    return ranges_by_row(heads["row"][owner], start, start + length)


def _look_closer(length: int):
    def run(batches):
        now, held = None, []

        def looked():
            heads = np.concatenate([h for h, _ in held])
            texts = []
            for h, data in held:
                at = 0
                for size in (h["n"] - 1 + length).tolist():
                    texts.append(data[at : at + size])
                    at += size
            owners, merged = repeated_windows(heads, texts, length)
            if owners:
                yield _batch(["row", "blob"], pa.array(owners, pa.int64()), pa.array(merged, pa.binary()))

        for batch in batches:
            for shard, heads, data in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now and held:
                    yield from looked()
                    held = []
                now = shard
                held.append((np.frombuffer(heads, HEAD), data))
        if held:
            yield from looked()

    return run


def _remove():
    def fn(texts: pa.Array, blobs: pa.Array):
        sizes, spans, kept = [], [], []
        for text, some in zip(texts.to_pylist(), blobs.to_pylist()):
            text = text or b""
            sizes.append(len(text))
            pairs = np.frombuffer(b"".join(some or []), np.int32).reshape(-1, 2)
            _, merged = ranges_by_row(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
            pairs = np.frombuffer(merged[0], np.int32).reshape(-1, 2).tolist() if merged else []
            spans.append([{"start": a, "end": b} for a, b in pairs])
            if pairs:
                edges = [0, *(x for pair in pairs for x in pair), len(text)]
                text = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            kept.append(text)
        return [pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())]

    return fn


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (maximal removed ranges of bytes) and kept (the bytes that stay)."""
    if length < 2 * GRAM:
        raise ValueError(f"strings under {2 * GRAM} bytes aren't supported")
    numbered = common.materialize(_numbered(docs, doc_id, text), "numbered")
    stats = numbered.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    frequent = frequent_grams(numbered, stats["n"])
    n_ranges = 1 << max(4, ((stats["bytes"] or 0) // RANGE_BYTES).bit_length())
    parts = numbered.select("row", "id", "text").mapInArrow(_cut_into_pieces(length, frequent, n_ranges), PARTS)
    dealt = parts.repartition("range").sortWithinPartitions("range")
    flags = common.materialize(dealt.mapInArrow(_judge(length), FLAGS), "repeats")
    asked = flags.where(F.col("what") != REMOVED)
    n_shards = max(1, (asked.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES)
    asked = asked.groupBy("row").agg(F.collect_list(F.struct("what", "blob")).alias("asked"))
    close = numbered.select("row", "id", "text").join(asked.hint("shuffle_hash"), "row").select("row", "id", "text", "asked")
    close = close.mapInArrow(_contents(length, n_shards), "shard long, heads binary, bytes binary").repartition("shard").sortWithinPartitions("shard")
    found = common.materialize(close.mapInArrow(_look_closer(length), "row long, blob binary"), "repeats-closer")
    removed = flags.where(F.col("what") == REMOVED).select("row", "blob").unionByName(found)
    removed = removed.groupBy("row").agg(F.collect_list("blob").alias("blobs"))
    both = numbered.select("row", "doc_id", "text").join(removed.hint("shuffle_hash"), "row", "left")
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("spans", SPANS), T.StructField("kept", T.BinaryType())]
    return common.with_columns(both, ["text", "blobs"], fields, _remove, ["doc_id"])


def digests() -> list:
    """n_bytes, n_removed, n_spans and kept_sha256 of remove_repeats()' columns."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return [F.col("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]
