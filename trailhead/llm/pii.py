"""PII surrogates on DataFrame functions alone.

Entities are found by one pattern; each is replaced by a surrogate that a key determines: the same entity gets the
same surrogate everywhere, in any task, and different entities of a kind get different ones, because each kind's map
is a permutation of the strings of one format. Letters, digits, case, script, vowels and punctuation keep their places.

- Strings (e-mail names and host labels, surnames, digits of numbers): a network over the two halves of the characters
  that can be shifted. Each character moves within its alphabet by an amount drawn from a keyed hash of the other half,
  in lower case, so that spellings in another case stay spellings of one surrogate. Two rounds, a middle round in
  which every character of one half moves, and the two rounds undone: a conjugate of a permutation without fixed
  points, which has none itself, so no entity is its own surrogate and nothing has to be drawn again.
- Telephone and social security numbers: the network over the digits, which then go back to their places; another
  layout of a number gives the same digits. A country code, or the leading zero of a national form, stays.
- Card numbers: digits between the first and the last by the network; the last follows the checksum. Other runs of
  digits, without a valid checksum, aren't entities.
- IPv4 addresses: the network over the two 16-bit halves; IPv6: over the hexadecimal digits. IBANs: the account part,
  with new check digits.
- Dates of birth: the year within its block of twenty (leap years to leap years), the month among those of its length,
  the day among the first twelve or the next sixteen, each by a keyed amount; layout and validity stay.
- Names, by form and surrounding words: after a title; a listed given name before a surname, in capitals, too; two capitalised
  words of which the second has a surname's ending; after words that introduce a name. Initials, particles,
  apostrophes, hyphens and all Latin, Cyrillic and Greek letters are read. Listed given names get others of their
  gender and script, by a keyed cycle through the list; other words go through the network, again if that gives a
  listed name, which keeps the two apart.
- Later (and earlier) mentions of a found name's parts in the same text are replaced by the same parts, in either case.

Collision checks: surrogates are distinct by construction; collisions() holds this against a corpus and lists the
surrogates that equal another entity of it, which no map can exclude that doesn't know the corpus.

Defined results: null text stays null; an empty text stays empty; texts of any length are read whole; text without
entities isn't changed; repeated rows give repeated rows; an empty table gives no rows; the text column is replaced
and a column named like an output is replaced, all others stay.
"""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Given names by gender and script.
NAMES = {
    "male": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven "
    "Andrew Peter Hans Jürgen Klaus Wolfgang Pierre Jean Luc Michel Carlos Juan José Luis Miguel Pedro",
    "female": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Emily Anna Laura "
    "Julia Emma Ursula Monika Petra Sabine Marie Sophie Claire Isabelle María Carmen Lucía Elena Sofía Pilar",
    "male_cyrillic": "Иван Пётр Алексей Дмитрий Сергей Николай Михаил Андрей Павел Юрий",
    "female_cyrillic": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия",
}
#: What stands before and within names, endings of surnames, words that introduce a name or a birth date.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sra", "Господин", "Госпожа"]
PARTICLES = ["de", "la", "las", "los", "del", "van", "von", "der", "den", "zu", "di", "da", "dos", "du", "des", "le", "al", "bin", "ter", "el"]
ENDINGS = ["son", "sen", "sson", "berg", "mann", "stein", "ski", "ska", "sky", "wicz", "ov", "ova", "ev", "eva", "enko", "ić", "ová", "opoulos", "idis"]
INTRODUCED = ["name is", "Name:", "named", "signed", "Signed", "Dear", "contact", "Contact", "Author:", "regards,", "Regards,", "sincerely,", "Sincerely,", "heiße", "Name ist", "appelle", "llamo", "зовут"]
BORN = ["born", "born on", "Born", "Born on", "birth", "birth:", "Birth:", "DOB", "DOB:", "dob", "birthday", "birthday:", "geboren am", "Geburtsdatum:", "né le", "née le", "naissance :", "naissance:", "nacido el", "nacida el", "nacimiento:"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]

VOWELS = set("aeiouyαεηιουωаеёиоуыэюяіїє")


def _alphabets() -> list[str]:
    """Alphabets within which characters move: digits, then letters by script block, vowel or not, and case.

    Lower and upper case lie side by side in the same order; letters without a partner in the other case stay as they are.
    """
    out = ["0123456789"]
    for first, last in ((0x61, 0x7A), (0xDF, 0xFF), (0x100, 0x17F), (0x180, 0x24F), (0x370, 0x3FF), (0x430, 0x44F), (0x450, 0x45F), (0x460, 0x52F)):
        kinds: dict[bool, str] = {True: "", False: ""}
        for c in map(chr, range(first, last + 1)):
            if unicodedata.category(c) == "Ll" and len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c:
                kinds[unicodedata.normalize("NFD", c)[0] in VOWELS] += c
        for letters in kinds.values():
            if len(letters) > 1:
                out += [letters, letters.upper()]
    return out


ALPHABETS = _alphabets()
LETTERS = "".join(ALPHABETS)
#: By place in LETTERS, from one: where the letter's alphabet begins, its size, and the letter's place in lower case.
FIRSTS = [1 + sum(map(len, ALPHABETS[:i])) for i, a in enumerate(ALPHABETS) for _ in a]
SIZES = [len(a) for a in ALPHABETS for _ in a]
LOWER = [LETTERS.index(c.lower()) + 1 for c in LETTERS]
HEX = "0123456789abcdef"

_UPPER = "\\p{Lu}"
_WORD = rf"{_UPPER}(?:['’]{_UPPER})?\p{{L}}++(?:['’-]\p{{L}}++)*+"
_INNER = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}+"
_INITIALS = rf"(?:{_UPPER}\. ?){{0,3}}+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LISTED = [n for names in NAMES.values() for n in names.split()]
_GIVEN = "|".join([*_LISTED, *(n.upper() for n in _LISTED)])
_TITLE = "|".join([*TITLES, *(t.upper() for t in TITLES)])
_DATE = rf"(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}} (?:{'|'.join(MONTHS)}) \d{{4}}|(?:{'|'.join(MONTHS)}) \d{{1,2}}, \d{{4}})"
_HEX = "[0-9A-Fa-f]{1,4}"


def _after(words: list[str]) -> str:
    return "(?:" + "|".join(rf"(?<=\b{w.replace(' ', chr(92) + 'x20')} )" for w in words) + ")"


#: Kind to pattern; where two match at one place the first counts. An entity's own text decides its kind.
PATTERNS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){1,10}+",
    "ipv4": rf"(?<![\w.]){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?![\w])(?!\.\d)",
    "ipv6": rf"(?<![\w:.])(?=[0-9A-Fa-f]{{1,4}}:[0-9A-Fa-f:]*[\d])(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\w:])(?!\.\d)",
    "iban": r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){3,7}+(?: [A-Z0-9]{1,3})?+)(?![\p{L}\p{N}])",
    "born": rf"(?=\d{{1,4}}[./ -]|\p{{Lu}}\p{{Ll}}+ \d){_after(BORN)}{_DATE}(?!\d)",
    "card": r"(?<![\w])(?<!\d[.-])(?:\d{13,19}+|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}+|\d{4}([ -])\d{6}\2\d{5})(?![\w])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,8}(?:[ .-]\d{2,5}){0,3}|\+\d{1,3}(?:[ .-]\d{1,8}){1,5}|\+\d{8,15}+|\(\d{3}\) ?\d{3}[ .-]\d{4}"
    r"|\(0\d{1,4}\) ?\d{3,8}(?:[ -]\d{2,5}){0,2}|0\d{1,4}[ /-]\d{3,8}(?:[ -]\d{2,5}){0,2}|\d{3}([.-])\d{3}\3\d{4})(?![\w])(?!\.\d)",
    "name": rf"(?:(?:{_TITLE})\.? {_INITIALS}{_INNER}{_WORD}(?: {_INITIALS}{_INNER}{_WORD}){{0,2}}+"
    # two words at least, and only then which ones; a first word of more than 61 characters is none, as this is looked for anew
    # behind every apostrophe of a long run
    rf"|(?=\p{{L}}[\p{{L}}'’-]{{0,60}}+ (?:{'|'.join(PARTICLES)}|\p{{Lu}}))(?:(?:{_GIVEN})(?:-{_UPPER}\p{{L}}++)? {_INITIALS}{_INNER}{_WORD}"
    rf"|{_UPPER}\p{{Ll}}++ {_INITIALS}{_UPPER}\p{{L}}*(?:{'|'.join(ENDINGS)})(?<! {_UPPER}\p{{L}}{{0,3}})"
    rf"|{_after(INTRODUCED)}{_WORD} {_INITIALS}{_INNER}{_WORD}))(?![\p{{L}}\p{{N}}])",
}
#: No entity begins within a word or number; its first character decides which patterns are tried.
ENTITY = (
    r"(?<![\p{L}\p{N}])(?:%(email)s|(?=[\d+(])(?:%(ipv4)s|%(ipv6)s|%(born)s|%(card)s|%(ssn)s|%(phone)s)"
    r"|(?=[a-f])(?:%(ipv6)s)|(?=\p{Lu})(?:%(ipv6)s|%(iban)s|%(born)s|%(name)s))"
) % {k: f"(?:{p})" for k, p in PATTERNS.items()}


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value computed once."""
    return F.transform(F.array(value), fn)[0]


def one_of(column: Column, values: list[str]) -> Column:
    return column.isin(values)


def listed(values: list) -> Column:
    """A constant array, made of one literal."""
    return F.split(F.lit("\x1f".join(map(str, values))), "\x1f").cast("array<int>" if isinstance(values[0], int) else "array<string>")


def keyed(key: str, *parts: Column | str) -> Column:
    """Hexadecimal digits of a keyed hash."""
    given = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *given, F.lit(key)), 256)


def amount(size: Column | int, *parts: Column, least: int = 0) -> Column:
    """A number from least to size - 1 that a keyed hash decides."""
    return (F.pmod(F.xxhash64(*parts), size - least) + least).cast("int")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _at(values: list[int], place: Column) -> Column:
    return F.element_at(listed(values), place)


def _moved(half: Column, digest: Column, sign: Column | int, least: int) -> Column:
    """Each place of LETTERS moved within its alphabet by an amount from the digest, forth or back."""

    def one(x: Column, i: Column) -> Column:
        first, size = _at(FIRSTS, x), _at(SIZES, x)
        return (first + F.pmod(x - first + sign * amount(size, digest, i, least=least), size)).cast("int")

    return F.transform(half, one)


def permuted(places: Column, key: str, kind: str) -> Column:
    """A keyed permutation, without fixed points, of the arrays of places of LETTERS that have the same alphabets."""
    n = F.size(places)
    half = F.ceil(n / 2).cast("int")
    start = F.struct(F.slice(places, 1, half).alias("a"), F.slice(places, half + 1, n - half).alias("b"))

    def digest(number: str, other: Column) -> Column:
        folded = F.array_join(F.transform(other, lambda x: _at(LOWER, x).cast("string")), ",")
        return keyed(key, kind, number, n, folded)

    def outer(state: Column, sign: int) -> Column:
        return F.struct(_moved(state["a"], digest("1", state["b"]), sign, 0).alias("a"), state["b"].alias("b"))

    def inner(state: Column, sign: int) -> Column:
        return F.struct(state["a"].alias("a"), _moved(state["b"], digest("2", state["a"]), sign, 0).alias("b"))

    def middle(state: Column) -> Column:
        return F.struct(_moved(state["a"], digest("3", state["b"]), 1, 1).alias("a"), state["b"].alias("b"))

    def step(state: Column, r: Column) -> Column:
        return F.when(r == 1, outer(state, 1)).when(r == 2, inner(state, 1)).when(r == 3, middle(state)).when(r == 4, inner(state, -1)).otherwise(outer(state, -1))

    return F.aggregate(listed([1, 2, 3, 4, 5]), start, step, lambda s: F.concat(s["a"], s["b"]))


def feistel(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings that have the same alphabets in the same places; none that has a letter or digit stays."""

    def put(chars: Column) -> Column:
        places = F.transform(chars, lambda c: F.position(c, F.lit(LETTERS)).cast("int"))
        which = F.filter(F.transform(places, lambda p, i: F.when(p > 0, i)), lambda i: i.isNotNull())
        new = permuted(F.filter(places, lambda p: p > 0), key, kind)
        state = F.struct(chars.alias("chars"), which.alias("which"), new.alias("new"))
        letters = listed(list(LETTERS))

        def written(s: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                return let(F.array_position(s["which"], i), lambda at: F.when(at > 0, F.element_at(letters, F.get(s["new"], at.cast("int") - 1))).otherwise(c))

            return F.array_join(F.transform(s["chars"], one), "")

        return let(state, written)

    return let(characters(text), put)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def laid_out(layout: Column, digits: Column) -> Column:
    """The digits put, in order, where the layout has digits."""

    def one(c: Column, i: Column) -> Column:
        nth = F.length(digits_of(F.substring(layout, F.lit(1), i + 1)))
        return F.when(c.rlike("[0-9]"), F.substring(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(characters(layout), one), "")


def luhn(payload: Column) -> Column:
    """The check digit of a payload of digits."""
    n = F.length(payload)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(payload, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return (10 - F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10) % 10


def valid_card(text: Column) -> Column:
    d = digits_of(text)
    return luhn(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, F.length(d), F.lit(1)).cast("int")


def _email(s: Column, key: str) -> Column:
    local, host = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
    labels = F.split(host, r"\.")
    inner = F.transform(labels, lambda x, i: F.when(i == F.size(labels) - 1, x).otherwise(feistel(x, key, "host")))
    return F.concat(feistel(local, key, "email"), F.lit("@"), F.array_join(inner, "."))


def _numbers(s: Column, key: str, kind: str) -> Column:
    return let(feistel(digits_of(s), key, kind), lambda d: laid_out(s, d))


def _phone(s: Column, key: str) -> Column:
    stays = F.regexp_extract(s, r"^(?:\+\d{1,3}(?=[ .(-])|\(?0)", 0)
    return F.concat(stays, _numbers(F.substring(s, F.length(stays) + 1, F.length(s)), key, "phone"))


def _card(s: Column, key: str) -> Column:
    d = digits_of(s)
    payload = F.concat(F.substring(d, 1, 1), feistel(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
    return let(let(payload, lambda p: F.concat(p, luhn(p).cast("string"))), lambda new: laid_out(s, new))


def _ipv4(s: Column, key: str) -> Column:
    o = F.transform(F.split(s, r"\."), lambda x: x.cast("long"))
    start = F.struct((o[0] * 256 + o[1]).alias("a"), (o[2] * 256 + o[3]).alias("b"))

    def moved(x: Column, number: str, other: Column, sign: int, least: int = 0) -> Column:
        return F.pmod(x + sign * amount(65536, keyed(key, "ipv4", number, other), least=least), 65536).cast("long")

    def step(s: Column, r: Column) -> Column:
        outer = lambda sign: F.struct(moved(s["a"], "1", s["b"], sign).alias("a"), s["b"].alias("b"))
        inner = lambda sign: F.struct(s["a"].alias("a"), moved(s["b"], "2", s["a"], sign).alias("b"))
        middle = F.struct(moved(s["a"], "3", s["b"], 1, 1).alias("a"), s["b"].alias("b"))
        return F.when(r == 1, outer(1)).when(r == 2, inner(1)).when(r == 3, middle).when(r == 4, inner(-1)).otherwise(outer(-1))

    def written(state: Column) -> Column:
        return F.concat_ws(".", *(x.cast("long").cast("string") for half in ("a", "b") for x in (F.floor(state[half] / 256), state[half] % 256)))

    return F.aggregate(listed([1, 2, 3, 4, 5]), start, step, written)


def _ipv6(s: Column, key: str) -> Column:
    """Hexadecimal digits through a network of their own, put back in place, in the case that the address is in."""

    def put(hexes: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            nth = F.length(F.regexp_replace(F.substring(s, F.lit(1), i + 1), "[^0-9A-Fa-f]", ""))
            return F.when(c == ":", c).otherwise(F.substring(hexes, nth, F.lit(1)))

        low = F.array_join(F.transform(characters(s), one), "")
        return F.when(s.rlike("[A-F]"), F.upper(low)).otherwise(low)

    return let(_hex_moved(F.regexp_replace(F.lower(s), "[^0-9a-f]", ""), key), put)


def _hex_moved(hexes: Column, key: str) -> Column:
    """Two halves of hexadecimal digits, moved as the network's halves are."""
    chars = characters(hexes)
    n = F.size(chars)
    half = F.ceil(n / 2).cast("int")
    place = lambda c: F.position(c, F.lit(HEX)).cast("int") - 1
    start = F.struct(F.transform(F.slice(chars, 1, half), place).alias("a"), F.transform(F.slice(chars, half + 1, n - half), place).alias("b"))

    def moved(x: Column, number: str, other: Column, sign: int, least: int = 0) -> Column:
        digest = keyed(key, "ipv6", number, n, F.array_join(other.cast("array<string>"), ","))
        return F.transform(x, lambda c, i: F.pmod(c + sign * amount(16, digest, i, least=least), 16).cast("int"))

    def step(s: Column, r: Column) -> Column:
        outer = lambda sign: F.struct(moved(s["a"], "1", s["b"], sign).alias("a"), s["b"].alias("b"))
        inner = lambda sign: F.struct(s["a"].alias("a"), moved(s["b"], "2", s["a"], sign).alias("b"))
        middle = F.struct(moved(s["a"], "3", s["b"], 1, 1).alias("a"), s["b"].alias("b"))
        return F.when(r == 1, outer(1)).when(r == 2, inner(1)).when(r == 3, middle).when(r == 4, inner(-1)).otherwise(outer(-1))

    digit = lambda x: F.element_at(listed(list(HEX)), x + 1)
    return F.aggregate(listed([1, 2, 3, 4, 5]), start, step, lambda s: F.array_join(F.transform(F.concat(s["a"], s["b"]), digit), ""))


def _iban(s: Column, key: str) -> Column:
    plain = F.replace(s, F.lit(" "), F.lit(""))
    country, account = F.substring(plain, 1, 2), feistel(F.substring(plain, F.lit(5), F.length(plain)), key, "iban")

    def fold(rest: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        value = F.when(digit, c.cast("long")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(digit, 10).otherwise(100) + value) % 97

    def checked(a: Column) -> Column:
        check = 98 - F.aggregate(characters(F.concat(a, country, F.lit("00"))), F.lit(0).cast("long"), fold)
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), a)

    def spaced(new: Column) -> Column:
        return F.when(s.contains(" "), F.rtrim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new)

    return let(let(account, checked), spaced)


def _born(s: Column, key: str) -> Column:
    """A date, part by part; each part moves by an amount that the others decide, so that the whole is a permutation."""
    part = lambda pattern, group: F.regexp_extract(s, pattern, group)
    month_name = part(rf"({'|'.join(MONTHS)})", 1)
    named, iso = month_name != "", s.rlike(r"^\d{4}-")
    first, second = part(r"^(\d+)[./](\d+)", 1).cast("int"), part(r"^(\d+)[./](\d+)", 2).cast("int")
    # a date with slashes names the month first, unless that can't be one
    month_first = s.contains("/") & (first <= 12)
    year = F.when(iso, part(r"^(\d{4})", 1)).otherwise(part(r"(\d{4})$", 1)).cast("int")
    month = F.when(named, F.array_position(listed(MONTHS), month_name)).when(iso, part(r"-(\d\d)-", 1)).when(month_first, first).otherwise(second).cast("int")
    day = F.when(named, part(r"(\d{1,2})(?: |,)", 1)).when(iso, part(r"-(\d\d)$", 1)).when(month_first, second).otherwise(first).cast("int")

    def moved(d: Column) -> Column:
        quad = F.floor(d["y"] / 4)
        block = F.floor(quad / 5) * 5
        new_quad = block + F.pmod(quad - block + amount(5, keyed(key, "year", d["y"] % 4, block, d["m"], d["d"]), least=1), 5)
        year = let((new_quad * 4 + d["y"] % 4).cast("int"), lambda y: F.struct(y.alias("y"), d["m"].alias("m"), d["d"].alias("d")))
        return let(let(year, month_moved), day_moved)

    def month_moved(d: Column) -> Column:
        out = d["m"]
        for group in ([1, 3, 5, 7, 8, 10, 12], [4, 6, 9, 11]):
            at = F.array_position(listed(group), d["m"])
            new = F.element_at(listed(group), (F.pmod(at - 1 + amount(len(group), keyed(key, "month", d["y"], d["d"])), len(group)) + 1).cast("int"))
            out = F.when(at > 0, new).otherwise(out)
        return F.struct(d["y"].alias("y"), out.cast("int").alias("m"), d["d"].alias("d"))

    def day_moved(d: Column) -> Column:
        low, size = F.when(d["d"] <= 12, 1).otherwise(13), F.when(d["d"] <= 12, 12).otherwise(16)
        new = low + F.pmod(d["d"] - low + amount(size, keyed(key, "day", d["y"], d["m"])), size)
        return F.struct(d["y"].alias("y"), d["m"].alias("m"), F.when(d["d"] <= 28, new).otherwise(d["d"]).cast("int").alias("d"))

    def written(d: Column) -> Column:
        text = {k: d[k].cast("string") for k in "ymd"}
        name = F.element_at(listed(MONTHS), d["m"])
        # a part of two digits keeps two
        two = lambda x, old: F.when(F.length(old) > 1, F.lpad(x, 2, "0")).otherwise(x)
        a, b = part(r"^(\d+)[./]", 1), part(r"^\d+[./](\d+)", 1)
        sep = F.when(s.contains("/"), "/").otherwise(".")
        return (
            F.when(iso, F.concat_ws("-", F.lpad(text["y"], 4, "0"), F.lpad(text["m"], 2, "0"), F.lpad(text["d"], 2, "0")))
            .when(named & s.contains(","), F.concat(name, F.lit(" "), text["d"], F.lit(", "), text["y"]))
            .when(named, F.concat_ws(" ", text["d"], name, text["y"]))
            .when(month_first, F.concat(two(text["m"], a), sep, two(text["d"], b), sep, text["y"]))
            .otherwise(F.concat(two(text["d"], a), sep, two(text["m"], b), sep, text["y"]))
        )

    whole = F.struct(year.alias("y"), month.alias("m"), day.alias("d"))
    return let(let(whole, moved), written)


def given_names(key: str) -> dict[str, str]:
    """Each listed name's surrogate: the next one of its list in an order that the key decides; in capitals, too."""
    out = {}
    for group, names in NAMES.items():
        order = sorted(names.split(), key=lambda n: hmac.new(key.encode(), f"{group}\x1f{n}".encode(), hashlib.sha256).digest())
        out |= dict(zip(order, [*order[1:], order[0]]))
    return out | {k.upper(): v.upper() for k, v in out.items()}


_GAP = r"(?<=[ '’.-])|(?=[ '’.-])"


def _name(s: Column, key: str) -> Column:
    """Part by part: titles and particles stay, listed names go round their list, others through the network."""
    given = given_names(key)
    known, new = listed(list(given)), listed(list(given.values()))
    stays = [*TITLES, *(t.upper() for t in TITLES), *PARTICLES, " ", "'", "’", ".", "-", ""]

    def other(w: Column) -> Column:
        # a name that the network takes to a listed one goes on, so that no two names meet
        again = lambda y: F.when(F.array_contains(known, y), feistel(y, key, "name")).otherwise(y)
        return let(feistel(w, key, "name"), again)

    def word(w: Column) -> Column:
        return let(F.array_position(known, w), lambda at: F.when(one_of(w, stays), w).when(at > 0, F.element_at(new, at.cast("int"))).otherwise(other(w)))

    return F.array_join(F.transform(F.split(s, _GAP), word), "")


def kind_of(s: Column) -> Column:
    """The kind of an entity's text; null for what only looks like one."""
    n = F.length(digits_of(s))
    return (
        F.when(s.contains("@"), "email")
        .when(s.rlike(rf"^{_DATE}$"), "born")
        .when(s.contains(":"), "ipv6")
        .when(s.rlike(r"^\p{Lu}") & ~s.rlike(r"^[A-Z]{2}\d"), "name")
        .when(s.rlike(r"^[A-Z]{2}\d"), "iban")
        .when(s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ipv4")
        .when(s.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(s.rlike(r"^(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})$"), F.when(valid_card(s), "card"))
        .when((n >= 7) & (n <= 15), "phone")
    )


def surrogate(s: Column, kind: Column, key: str) -> Column:
    """The surrogate of an entity; of null kind: itself."""
    return (
        F.when(kind == "email", _email(s, key))
        .when(kind == "name", _name(s, key))
        .when(kind == "iban", _iban(s, key))
        .when(kind == "ipv4", _ipv4(s, key))
        .when(kind == "ipv6", _ipv6(s, key))
        .when(kind == "born", _born(s, key))
        .when(kind == "ssn", _numbers(s, key, "ssn"))
        .when(kind == "card", _card(s, key))
        .when(kind == "phone", _phone(s, key))
        .otherwise(s)
    )


def entities(text: Column, key: str) -> Column:
    """Array of struct<entity, kind, surrogate> of a text, in order of place; empty for null."""
    found = F.when(text.rlike(ENTITY), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def one(s: Column) -> Column:
        return let(kind_of(s), lambda k: F.struct(s.alias("entity"), k.alias("kind"), surrogate(s, k, key).alias("surrogate")))

    return F.transform(found, one)


def _mentions(found: Column) -> Column:
    """Parts of a text's names and their surrogates: struct<old, new> of arrays, with other cases of the same part."""
    names = F.filter(found, lambda e: e["kind"] == "name")
    stays = [*TITLES, *(t.upper() for t in TITLES), *PARTICLES]
    parts = lambda field: F.flatten(F.transform(names, lambda e: F.split(e[field], _GAP)))
    pairs = F.arrays_zip(parts("entity").alias("old"), parts("surrogate").alias("new"))
    pairs = F.array_distinct(F.filter(pairs, lambda p: (F.length(p["old"]) > 2) & ~one_of(p["old"], stays)))
    both = lambda field: F.concat(F.transform(pairs, lambda p: p[field]), F.transform(pairs, lambda p: F.upper(p[field])), F.transform(pairs, lambda p: F.initcap(p[field])))
    return F.struct(both("old").alias("old"), both("new").alias("new"))


def _renamed(piece: Column, names: Column) -> Column:
    """A stretch of text with the parts of names replaced."""

    def word(w: Column) -> Column:
        return let(F.array_position(names["old"], w), lambda at: F.when(at > 0, F.element_at(names["new"], at.cast("int"))).otherwise(w))

    return F.array_join(F.transform(F.split(piece, r"(?<=\p{L})(?!\p{L})|(?<!\p{L})(?=\p{L})"), word), "")


def pseudonymize(docs: DataFrame, key: str, text: str = "text", out: str = "entities") -> DataFrame:
    """Replace the entities of the text column; out holds what was replaced (struct<entity, kind, surrogate>).

    Further mentions of a name's parts are replaced, too, and aren't in out.
    """
    found = docs.withColumn(out, entities(F.col(text), key))
    between = F.split(F.col(text), ENTITY, -1)
    with_names = F.exists(out, lambda e: e["kind"] == "name")
    renamed = let(_mentions(F.col(out)), lambda names: F.transform(between, lambda piece: _renamed(piece, names)))
    pieces = F.when(with_names, renamed).otherwise(between)
    new = F.concat(F.transform(out, lambda e: e["surrogate"]), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(pieces, new, lambda a, b: F.concat(a, b)), "")
    return found.withColumn(text, F.when(F.size(out) > 0, joined).otherwise(F.col(text))).withColumn(out, F.filter(out, lambda e: e["kind"].isNotNull()))


def normal(entity: Column, kind: Column) -> Column:
    """What makes two spellings one entity: digits of numbers, else the text in lower case."""
    return F.when(kind.isin("phone", "ssn", "card"), digits_of(entity)).otherwise(F.lower(entity))


def collisions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Surrogates that two entities of the corpus share, or that are real entities: kind, surrogate, n_entities, real."""
    each = docs.select(F.explode(entities(F.col(text), key)).alias("e")).select("e.*").where("kind is not null")
    pairs = each.select("kind", normal(F.col("entity"), F.col("kind")).alias("entity"), normal(F.col("surrogate"), F.col("kind")).alias("surrogate")).distinct()
    shared = pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n_entities"))
    real = pairs.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real")).distinct()
    return shared.join(real, ["kind", "surrogate"], "left").select("kind", "surrogate", "n_entities", F.coalesce("real", F.lit(False)).alias("real")).where("n_entities > 1 or real")
