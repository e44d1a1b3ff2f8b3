"""Rule-based Russian morphology: analyses, lemma sets and generated forms of single words."""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

#: Paradigms as name, part of speech, lemma's ending, prior, least stem; then the endings of the forms.
PARADIGMS = [
    ("noun-a", "noun", "а", 0.55, 3, "а ы и е у ой ою - ам ами ах"),
    ("noun-ya", "noun", "я", 0.5, 3, "я и е ю ей ею ям ями ях"),
    ("noun-m", "noun", "", 0.5, 3, "- а у ом е ы и ов ей ам ами ах"),
    ("noun-msoft", "noun", "ь", 0.45, 3, "ь я ю ем е и ей ям ями ях"),
    ("noun-j", "noun", "й", 0.45, 3, "й я ю ем е и ев ям ями ях"),
    ("noun-o", "noun", "о", 0.5, 3, "о а у ом е ам ами ах"),
    ("noun-e", "noun", "е", 0.4, 3, "е я ю ем и ям ями ях"),
    ("noun-f3", "noun", "ь", 0.4, 3, "ь и ью ей ям ями ях"),
    ("adj-hard", "adjective", "ый", 0.55, 3, "ый ого ому ым ом ая ой ую ое ые ых ыми"),
    ("adj-soft", "adjective", "ий", 0.5, 3, "ий его ему им ем яя ей юю ее ие их ими"),
    ("adj-vel", "adjective", "ий", 0.5, 3, "ий ого ому им ом ая ой ую ое ие их ими"),
    ("adj-oj", "adjective", "ой", 0.45, 3, "ой ого ому им ом ая ую ое ие их ими"),
    ("verb-at", "verb", "ать", 0.5, 2, "ать аю аешь ает аем аете ают ал ала ало али ай айте"),
    ("verb-yat", "verb", "ять", 0.45, 2, "ять яю яешь яет яем яете яют ял яла яло яли яй яйте"),
    ("verb-et", "verb", "еть", 0.45, 2, "еть ею еешь еет еем еете еют ел ела ело ели"),
    ("verb-it", "verb", "ить", 0.5, 2, "ить ю ишь ит им ите ят ил ила ило или и"),
    ("verb-ovat", "verb", "овать", 0.5, 2, "овать ую уешь ует уем уете уют овал овала овало овали уй уйте"),
    ("verb-evat", "verb", "евать", 0.45, 2, "евать ую уешь ует уем уете уют евал евала евало евали уй уйте"),
]

#: Irregular words and their forms.
IRREGULAR = {
    "бежать": ("verb", "бегу бежишь бежит бежим бежите бегут бежал бежала бежало бежали беги бегите"),
    "идти": ("verb", "иду идешь идет идем идете идут шел шла шло шли иди идите"),
    "человек": ("noun", "люди человека человеку человеком человеке людей людям людьми людях"),
    "ребенок": ("noun", "дети ребенка ребенку ребенком ребенке детей детям детьми детях"),
    "год": ("noun", "года году годом годе годы лет годам годами годах"),
}

MOST_FORMS = 32
LEAST_CONFIDENCE = 0.4
MOST_LEMMAS = 4
EXPANDED_LEMMAS = 2
VELARS_AND_HUSHERS = set("гкхжшчщ")
VOWELS = set("аеиоуыэюя")
ENDS_NO_STEM = VOWELS | set("ьй")
AFTER_VELARS = {"ы": "и", "я": "а", "ю": "у"}

_ENDINGS = {name: ["" if e == "-" else e for e in endings.split()] for name, *_, endings in PARADIGMS}
_LEMMA_OF = {form: lemma for lemma, (_, forms) in IRREGULAR.items() for form in forms.split()}


class Analysis(NamedTuple):
    lemma: str
    pos: str
    paradigm: str
    stem: str
    reflexive: bool
    confidence: float


class Form(NamedTuple):
    form: str
    kind: str
    confidence: float


def fold(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower().replace("ё", "е")


def cyrillic(word: str) -> bool:
    """Whether a word is Cyrillic letters and hyphens only."""
    return bool(word) and all(c == "-" or "\u0400" <= c <= "\u04ff" for c in word)


def reflexive_form(word: str) -> str:
    return word + ("сь" if word[-1] in VOWELS else "ся") if word else word


def analyze(word: str) -> list[Analysis]:
    """All readings of a word, the most confident first, the word itself among them."""
    w = fold(word.strip())
    if not cyrillic(w):
        return []
    reflexive = len(w) > 4 and w[-2:] in ("ся", "сь")
    base = w[:-2] if reflexive else w
    found: dict[tuple[str, str], Analysis] = {}
    for lemma in filter(None, (_LEMMA_OF.get(w), w if w in IRREGULAR else None)):
        found[lemma, "exception"] = Analysis(lemma, IRREGULAR[lemma][0], "exception", lemma, False, 0.95)
    for name, pos, ending, prior, least, _ in PARADIGMS:
        if reflexive and pos != "verb":
            continue
        for e in _ENDINGS[name]:
            stem = base[: len(base) - len(e)]
            if not base.endswith(e) or len(stem) < least + (not e):
                continue
            if not e and stem[-1] in ENDS_NO_STEM:
                continue
            lemma = reflexive_form(stem + ending) if reflexive else stem + ending
            sure = prior + 0.04 * len(e) if e else prior + 0.1 if not ending else prior - 0.2
            found.setdefault((lemma, name), Analysis(lemma, pos, name, stem, reflexive, min(sure, 0.9)))
    found[w, "surface"] = Analysis(w, "unknown", "surface", w, False, 0.3)
    return sorted(found.values(), key=lambda a: (-a.confidence, a.lemma, a.paradigm))


def lemma_set(word: str, most: int = MOST_LEMMAS) -> list[str]:
    """The folded word, then its likely lemmas."""
    w = fold(word.strip())
    if not w:
        return []
    lemmas = [a.lemma for a in analyze(word) if a.confidence >= LEAST_CONFIDENCE]
    return list(dict.fromkeys([w, *lemmas]))[:most]


def spelled(stem: str, ending: str) -> str:
    """Stem and ending, with the vowel that may follow a velar or husher."""
    if ending and stem and stem[-1] in VELARS_AND_HUSHERS:
        ending = AFTER_VELARS.get(ending[0], ending[0]) + ending[1:]
    return stem + ending


def expand(word: str, most: int = MOST_FORMS) -> list[Form]:
    """Lemmas and forms that a query for the word should also match; the word itself isn't among them."""
    most = most if most > 0 else MOST_FORMS
    original = word.strip()
    w = fold(original)
    if not cyrillic(w):
        return []
    out: dict[str, Form] = {}

    def offer(form: str, kind: str, sure: float, again: bool = False) -> None:
        if form and (form != w or again) and form not in out and len(out) < most:
            out[form] = Form(form, kind, sure)

    if "ё" in unicodedata.normalize("NFC", original).lower():
        offer(w, "accent", 0.85, again=True)
    lemma = w if w in IRREGULAR else _LEMMA_OF.get(w)
    if lemma:
        if lemma != w:
            offer(lemma, "lemma", 0.9)
        for f in IRREGULAR[lemma][1].split():
            offer(f, "wordform", 0.9 if lemma == w else 0.85)
        return list(out.values())
    likely = [a for a in analyze(original) if a.confidence >= LEAST_CONFIDENCE and a.paradigm != "surface"]
    first_of = {a.lemma: a for a in reversed(likely)}
    for a in [first_of[k] for k in dict.fromkeys(a.lemma for a in likely)][:EXPANDED_LEMMAS]:
        if a.lemma != w:
            offer(a.lemma, "lemma", a.confidence)
        for e in _ENDINGS.get(a.paradigm, []):
            form = spelled(a.stem, e)
            offer(reflexive_form(form) if a.reflexive else form, "wordform", a.confidence - 0.05)
    return list(out.values())
