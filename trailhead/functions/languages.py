"""Language adapters: how words are normalised, analysed and expanded, by base language tag."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import russian

#: The small English maps.
ENGLISH_LEMMAS = {"runners": "run", "running": "run", "ran": "run", "бегуны": "бежать"}
EXPAND_LEMMA = {"running": "run"}
EXPAND_FORMS = {"run": ["runners"]}

MOST_LEMMAS = 5
LEAST_CONFIDENCE = 0.4


def english_lemma(word: str) -> str:
    w = word.strip().lower()
    if w in ENGLISH_LEMMAS:
        return ENGLISH_LEMMAS[w]
    return w[:-1] if w.endswith("s") and len(w.encode()) > 3 and not w.endswith("ss") else w


def english_lemma_column(word: Column) -> Column:
    w = F.lower(F.trim(word))
    plural = w.endswith("s") & (F.octet_length(w) > 3) & ~w.endswith("ss")
    out = F.when(plural, F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    for form, lemma in ENGLISH_LEMMAS.items():
        out = F.when(w == form, lemma).otherwise(out)
    return out


def mapped_expansion(word: str) -> list[str]:
    w = word.strip()
    lemma = [EXPAND_LEMMA[w]] if EXPAND_LEMMA.get(w, w) != w else []
    return lemma + EXPAND_FORMS.get(w, [])


def _russian_lemma_words(word: str) -> list[str]:
    likely = (a.lemma for a in russian.analyze(word) if a.confidence >= LEAST_CONFIDENCE)
    return list(dict.fromkeys([russian.fold(word), *likely]))[:MOST_LEMMAS]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _russian_lemmas(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, list[str]] = {}
    for s in parts:
        out = []
        for w in s:
            if w not in known:
                if len(known) > 200_000:
                    known.clear()
                known[w] = _russian_lemma_words(w or "")
            out.append(known[w])
        yield pd.Series(out)


@dataclass(frozen=True)
class Adapter:
    """norm and lemmas work on columns (a word to its form, a word to its lemma set); the rest on the driver."""

    tag: str
    norm: Callable[[Column], Column]
    norm_word: Callable[[str], str]
    lemmas: Callable[[Column], Column]
    lemma_words: Callable[[str], list[str]]
    expand: Callable[[str], list[str]]


def _lower(word: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFC", word).lower()


NONE = Adapter("", F.lower, _lower, lambda c: F.array(F.lower(c)), lambda w: [_lower(w)], lambda w: [])
SIMPLE = Adapter("simple", F.lower, _lower, lambda c: F.array(F.lower(c)), lambda w: [_lower(w)], mapped_expansion)
ENGLISH = Adapter(
    "en",
    F.lower,
    _lower,
    lambda c: F.array_distinct(F.array(F.lower(c), english_lemma_column(c))),
    lambda w: list(dict.fromkeys([_lower(w), english_lemma(w)])),
    mapped_expansion,
)
RUSSIAN = Adapter(
    "ru",
    lambda c: F.replace(F.lower(c), F.lit("ё"), F.lit("е")),
    russian.fold,
    _russian_lemmas,
    _russian_lemma_words,
    lambda w: [f.form for f in russian.expand(w)],
)

REGISTRY = {"en": ENGLISH, "ru": RUSSIAN}


def adapter(language: str | None) -> Adapter:
    """The adapter of a language tag by its base; words of other languages are only lower-cased."""
    base = (language or "").lower().replace("_", "-").split("-")[0]
    return REGISTRY.get(base, NONE)


