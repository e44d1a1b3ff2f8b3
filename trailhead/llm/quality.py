"""Quality classifier by compression.

Two zstandard dictionaries are built, one from text labelled good and one from text labelled bad. A text is cut into
blocks and each is compressed with either dictionary; over the whole text, (bad - good) / (bad + good) of the
compressed sizes says which dictionary knows it better. A logistic curve, fitted on labelled texts that the
dictionaries haven't seen, turns the difference into the probability of a good label.

Training reads a bounded sample: at most per_class rows of each label, those of the least hash of their id, and of
each a window of at most window characters at a hashed place. These are parameters; scoring reads whole texts.

Defined results: a null or empty text has difference 0 and gets the curve's value there; texts of any length are
scored in full; ids with labels of both kinds are left out of training; without labels of both kinds all scores are
the share of good labels (0.5 without labels); repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


@dataclass(frozen=True)
class Settings:
    per_class: int = 2000
    window: int = 8000
    dictionary_bytes: int = 64 * 1024
    level: int = 3
    block_bytes: int = 1024


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    settings: Settings

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for d in (self.good, self.bad):
            z = zstandard.ZstdCompressionDict(d)
            z.precompute_compress(level=self.settings.level)
            made.append(zstandard.ZstdCompressor(dict_data=z, write_checksum=False, write_content_size=False, write_dict_id=False))
        return made


def difference(text: bytes, compressors: list[zstandard.ZstdCompressor], block: int) -> float:
    """Normalised difference of the compressed sizes, above 0 where the good dictionary fits better."""
    if not text:
        return 0.0
    good = bad = 0
    for at in range(0, len(text), block):
        part = text[at : at + block]
        good += len(compressors[0].compress(part))
        bad += len(compressors[1].compress(part))
    return (bad - good) / (bad + good)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or where there is too little text to train one, the text itself."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples)[-size:]).ljust(8, b"\0")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton's method on standardised x."""
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    a = np.stack([(x - mean) / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w = w + step
        if abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def sample(docs: DataFrame, labels: DataFrame, label: str, settings: Settings) -> list[tuple[int, bytes]]:
    """(label, text) of the training rows, in order of their hash. Rows of the held-out fold are never among them."""
    marked = labels.where(~common.held_out(F.col("doc_id")) & F.col(label).isin(0, 1))
    one = marked.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("most")).where("y = most")
    one = one.withColumn("h", F.xxhash64(F.lit(label), "doc_id"))
    picked = [one.where(F.col("y") == y).orderBy("h", "doc_id").limit(settings.per_class) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1]).select("doc_id", "y", "h")
    room = F.greatest(F.length("text") - settings.window, F.lit(0)) + 1
    window = F.substring(F.col("text"), (F.pmod("h", room) + 1).cast("int"), F.lit(settings.window))
    # ids holds at most twice per_class rows
    got = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").select("y", "h", "doc_id", window.alias("text"))
    rows = got.orderBy("h", "doc_id", "text").limit(2 * settings.per_class).collect()
    return [(r["y"], r["text"].encode()) for r in rows]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings()) -> Model:
    """Dictionaries from one half of the sample, the curve from the other."""
    rows = sample(docs, labels, label, settings)
    ys = [y for y, _ in rows]
    share = sum(ys) / len(ys) if ys else 0.5
    if min(ys.count(0), ys.count(1)) < 2:
        return Model(b"\0" * 8, b"\0" * 8, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), settings)
    halves: dict[int, list[list[bytes]]] = {y: [[], []] for y in (0, 1)}
    for y, text in rows:
        both = halves[y]
        both[len(both[0]) > len(both[1])].append(text)
    good, bad = (_dictionary(halves[y][0], settings.dictionary_bytes) for y in (1, 0))
    model = Model(good, bad, 0.0, 0.0, settings)
    z = model.compressors()
    x = np.array([difference(t, z, settings.block_bytes) for y in (0, 1) for t in halves[y][1]])
    y = np.array([float(y) for y in (0, 1) for _ in halves[y][1]])
    # the sample is balanced where both labels abound; the curve gets the share of labels in the corpus back
    counts = {r["y"]: r["n"] for r in labels.where(~common.held_out(F.col("doc_id")) & F.col(label).isin(0, 1)).groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).collect()}
    slope, intercept = logistic(x, y)
    shift = np.log(counts[1] / counts[0]) - np.log(y.mean() / (1 - y.mean()))
    return Model(good, bad, slope, intercept + float(shift), settings)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep=None) -> DataFrame:
    """Add each text's score, 0 to 1, higher where a good label is likelier."""

    def make():
        z = model.compressors()

        def fn(column: pa.Array):
            x = np.array([difference(t.encode(), z, model.settings.block_bytes) for t in common.strings(column)])
            return [pa.array(1 / (1 + np.exp(-np.clip(model.slope * x + model.intercept, -700, 700))))]

        return fn

    return common.with_columns(docs, [text], [T.StructField(out, T.DoubleType())], make, keep)


def predicted(column: Column, least: float = 0.3) -> Column:
    return F.when(column >= least, 1).otherwise(0).alias("predicted")
