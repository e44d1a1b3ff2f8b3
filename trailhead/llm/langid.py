"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three code points of the lower-cased text, each text followed by two spaces, are hashed into
buckets. A feature is the share of the text's n-grams that fall into a bucket, times the bucket's inverse document
frequency. Weights are trained by follow-the-regularised-leader (proximal, one learning rate per weight) with an
elastic-net penalty: the absolute part keeps them sparse, the squared part small. A temperature fitted on rows kept
back from training calibrates the probabilities.

Document frequencies are counted over all labelled whole texts that aren't held out, each task's in one array. The fit
reads a bounded sample: about per_language rows of each language, by a threshold on the hash of the id, and of each a
window of at most window characters at a hashed place. These are parameters; prediction reads whole texts.

Defined results: a null text or one without a letter is `und` with score 0; texts of any length are read in full;
with no labelled rows everything is `und`; ties go to the language that sorts first; repeated rows give repeated
rows; an empty table gives no rows; a column named like an output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
ORDERS = 3
STRIDE = 1 << 20

#: Odd multipliers of the bucket hash.
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@dataclass(frozen=True)
class Settings:
    per_language: int = 1000
    window: int = 3000
    bits: int = 16
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3
    scale: float = 30.0
    kept_back: int = 5


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray = field(repr=False)  # languages x (buckets of each order), idf and scale included
    bias: np.ndarray
    temperature: float
    settings: Settings


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets(points: np.ndarray, bits: int) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that begins at each point but the last two."""
    n, shift = len(points) - ORDERS + 1, np.uint32(32 - bits)
    h, found = np.zeros(n, np.uint32), []
    for k in range(ORDERS):
        h = (h ^ points[k : k + n]) * MULTIPLIERS[k]
        h ^= h >> np.uint32(15)
        found.append((h * MULTIPLIERS[2] >> shift).astype(np.intp))
    return found


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets over all orders, and the share of the n-grams in each."""
    got = buckets(np.concatenate([code_points(text), np.full(ORDERS - 1, 0x20, np.uint32)]), bits)
    where, n = np.unique(np.concatenate([b + (k << bits) for k, b in enumerate(got)]), return_counts=True)
    return where, n / max(1, n.sum())


def labelled(docs: DataFrame, lang: str) -> DataFrame:
    """Rows to learn from: with a language and a text, and not of the held-out fold."""
    return docs.where(~common.held_out(F.col("doc_id")) & F.col(lang).isNotNull() & F.col("text").isNotNull())


def document_frequencies(rows: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts: counted in each task, added up by bucket."""
    size = ORDERS << bits

    def run(batches):
        df, n, seen = np.zeros(size, np.int64), 0, np.zeros(size, bool)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                points = np.concatenate([code_points(text), np.full(ORDERS - 1, 0x20, np.uint32)])
                for at in range(0, len(points) - ORDERS + 1, STRIDE):
                    for k, b in enumerate(buckets(points[at : at + STRIDE + ORDERS - 1], bits)):
                        seen[b + (k << bits)] = True
                where = np.flatnonzero(seen)
                df[where] += 1
                seen[where] = False
                n += 1
        if n:
            where = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(where, size)), pa.array(np.append(df[where], n))], names=["bucket", "n"])

    found = common.map_texts(rows.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1, np.int64)
    df[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return df[:size], int(df[size])


def sample(docs: DataFrame, lang: str, settings: Settings) -> list[tuple[str, str]]:
    """(language, text) of the training rows in a fixed order; never of the held-out fold."""
    rows = labelled(docs, lang)
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang)).count().collect()}
    if not counts:
        return []
    top = 1 << 31
    limits = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(top, int(top * settings.per_language / n) + 1))))
    h = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(top))
    room = F.greatest(F.length("text") - settings.window, F.lit(0)) + 1
    window = F.substring(F.col("text"), (F.pmod(h, room) + 1).cast("int"), F.lit(settings.window))
    got = rows.where(h <= limits[F.col(lang)]).select(F.col(lang).alias("lang"), h.alias("h"), "doc_id", window.alias("text"))
    bound = 2 * settings.per_language * len(counts)
    return [(r["lang"], r["text"]) for r in got.orderBy("h", "doc_id", "text").limit(bound).collect()]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[str, str]], settings: Settings, df: np.ndarray | None = None, n_texts: int = 0) -> Model:
    """Train on (language, text) rows, with document frequencies of n_texts texts (of the rows themselves, if None)."""
    s = settings
    languages = sorted({k for k, _ in rows})
    size, n_lang = ORDERS << s.bits, len(languages)
    x = [features(t, s.bits) for _, t in rows]
    y = [languages.index(k) for k, _ in rows]
    if df is None:
        df, n_texts = np.zeros(size), len(rows)
        for where, _ in x:
            df[where] += 1
    idf = np.log((1 + n_texts) / (1 + df)) + 1
    back = [i for i in range(len(rows)) if i % s.kept_back == s.kept_back - 1] if len(rows) >= 10 * s.kept_back else []
    kept = set(back)
    fore = [i for i in range(len(rows)) if i not in kept]
    # the last column is the bias
    z, n = np.zeros((n_lang, size + 1)), np.zeros((n_lang, size + 1))

    def weights(at):
        zz, nn = z[:, at], n[:, at]
        l1 = np.where(at == size, 0.0, s.l1)
        return np.where(abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((s.beta + np.sqrt(nn)) / s.alpha + s.l2))

    def vector(i):
        where, share = x[i]
        return np.append(where, size), np.append(share * idf[where] * s.scale, 1.0)

    order = np.random.default_rng(0)
    for _ in range(s.epochs):
        for i in order.permutation(fore):
            at, v = vector(i)
            w = weights(at)
            g = softmax(w @ v)
            g[y[i]] -= 1
            g = g[:, None] * v
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / s.alpha
            z[:, at] += g - sigma * w
            n[:, at] += g * g
    w = weights(np.arange(size + 1))
    logits = np.array([w[:, at] @ v for at, v in map(vector, back)]).reshape(len(back), n_lang)
    temperature = 1.0
    if back:
        # smoothed targets: rows without an error don't mean certainty
        rest = 1 / (len(back) + 2)
        target = np.eye(n_lang)[[y[i] for i in back]] * (1 - rest) + rest / n_lang
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-(target * np.log(softmax(logits / t) + 1e-300)).sum(1).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Model(languages, np.ascontiguousarray((w[:, :size] * idf * s.scale).astype(np.float32)), w[:, size].copy(), temperature, s)


def train(docs: DataFrame, lang: str = "lang", settings: Settings = Settings()) -> Model | None:
    """A model from the labelled rows of docs (doc_id, text and the label column); None without any."""
    rows = sample(docs, lang, settings)
    return fit(rows, settings, *document_frequencies(labelled(docs, lang), settings.bits)) if rows else None


class Scorer:
    """Scores many texts at once."""

    def __init__(self, model: Model):
        self.m = model
        b = model.settings.bits
        self.tables = [[np.ascontiguousarray(w[k << b : (k + 1) << b]) for k in range(ORDERS)] for w in model.weights]

    def sums(self, texts: list[str]) -> np.ndarray:
        """Sum of the weights of each text's n-grams, for each language."""
        pad = "  "
        points = code_points(pad.join(texts) + pad) if texts else np.empty(0, np.uint32)
        # lower-casing may change a text's length, so the lengths are taken after it
        sizes = np.array([len(t.lower()) + len(pad) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        total = np.zeros((len(self.m.languages), len(texts)))
        for at in range(0, len(points) - ORDERS + 1, STRIDE):
            stop = min(at + STRIDE, len(points) - ORDERS + 1)
            idx = buckets(points[at : stop + ORDERS - 1], self.m.settings.bits)
            lo, hi = (np.clip(e, at, stop) - at for e in (ends - sizes, ends - len(pad)))
            for total_of, tables in zip(total, self.tables):
                value = tables[0][idx[0]]
                for k in range(1, ORDERS):
                    value = value + tables[k][idx[k]]
                c = np.zeros(len(value) + 1)
                np.cumsum(value, dtype=np.float64, out=c[1:])
                total_of += c[np.maximum(lo, hi)] - c[lo]
        return (total / np.maximum(1, ORDERS * (sizes - len(pad)))).T

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [bool(t) and LETTER.search(t) is not None for t in texts]
        score, lang = np.zeros(len(texts)), [UNKNOWN] * len(texts)
        part: list[int] = []
        held = 0
        for i, t in enumerate(texts):
            if known[i]:
                part.append(i)
                held += len(t)
            if part and (held >= STRIDE or i == len(texts) - 1):
                p = softmax((self.sums([texts[j] for j in part]) + self.m.bias) / self.m.temperature)
                best = p.argmax(1)
                score[part] = p[np.arange(len(part)), best]
                for j, b in zip(part, best):
                    lang[j] = self.m.languages[b]
                part, held = [], 0
        return lang, score


def predict(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang_pred", score: str = "score", keep=None) -> DataFrame:
    """Add the predicted language and its probability."""

    def make():
        scorer = Scorer(model) if model else None

        def fn(column: pa.Array):
            texts = column.to_pylist()
            names, p = scorer(texts) if scorer else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            return [pa.array(names, pa.string()), pa.array(p)]

        return fn

    return common.with_columns(docs, [text], [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())], make, keep)
