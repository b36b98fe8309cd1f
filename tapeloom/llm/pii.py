"""PII surrogates: detected entities get keyed, type-consistent replacements.

A surrogate is a keyed permutation of the entity's symbols within their own classes (digits, vowels and consonants of
a script, octets of equal width, ...), so it keeps format, script, case and the gender that a name's ending shows, and
two entities of one shape can't get one surrogate. What a permutation can't rule out, that a surrogate equals another
real entity of the corpus, is checked by joins over all distinct entities; those few get another permutation.
Equal entities get equal surrogates wherever and in whatever formatting they stand.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import drop_table, partitions, texts, write_table

ROUNDS, TRIES, WIDER, SEND_BYTES = 6, 8, 4, 32 << 20

# Spellings of honorifics, by the gender they tell (f, m, or x for none).
HONORIFICS = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Señor": "m", "Sr": "m", "Don": "m", "Monsieur": "m", "Sir": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Sra": "f", "Señorita": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Mlle": "f", "Lady": "f",
    "Dr": "x", "Prof": "x", "Professor": "x", "Doktor": "x", "Doctor": "x",
    "Господин": "m", "Госпожа": "f", "г-н": "m", "г-жа": "f",
}
# Letters by script, vowels first; other letters change within the part of Unicode that they come from.
ALPHABETS = [("aeiou", "bcdfghjklmnpqrstvwxyz"), ("аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь"), ("αεηιουω", "βγδζθκλμνξπρστφχψ")]

_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
_ALNUM = _DIGITS + _UPPER
_SIGNS = "!#$%&()*+-./:<=>?@[]^_`{|}~"
_PARTS = [range(1, 10), range(10, 13), range(13, 29), range(29, 31), range(31, 32), range(32, 1900), range(1900, 2000), range(2000, 2100), range(2100, 10000), range(1)]
_OCTETS = [list(range(10)), list(range(10, 100)), list(range(100, 256))]
_NAME = r"[^\W\d_a-zßà-öø-ÿа-яё][^\W\d_]+(?:[-'’][^\W\d_]+)?"
_FORMS = [
    ("token", re.compile(r"(?<=://)(?P<v>[^\s:/?#@]{1,256})(?=:[^\s/?#@]+@)")),
    ("secret", re.compile(r"(?<=://)[^\s:/?#@]{1,256}:(?P<v>[^\s/?#@]+)(?=@)")),
    ("token", re.compile(r"(?<![\w.-])eyJ[\w-]{4,}\.[\w-]{4,}(?:\.[\w-]*)?(?![\w-])")),
    ("token", re.compile(r"(?<![\w-])(?:gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|[sprk]k_(?:live|test)_|sk-|AIza|npm_|hf_|SG\.)[\w.-]{12,}[\w-]")),
    ("email", re.compile(r"(?<![\w.+%-])[^\W_](?:[\w.%+-]*[\w+%-])?@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")),
    ("aws", re.compile(r"(?<![A-Za-z0-9])A(?:KI|SI)A[0-9A-Z]{16}(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}([\"']?)([^\s\"',;]{6,})(?=\1)")),
    ("secret", re.compile(r"(?i)(?<!\w)(?:password|passwd|passphrase|pass ?code|passwort|kennwort|mot de passe|contraseña|пароль)(?: (?:is|was|ist|lautet|war|est|es|era)(?: now| jetzt)?:?| ?:) {1,2}[\"'“„«]?(?P<v>(?=[^\s\"'”“»,;]*[0-9])[^\s\"'”“»,;]{4,}[^\s\"'”“»,;.!?)])")),
    ("iban", re.compile(r"(?i)(?<![a-z0-9])[a-z]{2}[0-9]{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?(?![a-z0-9])")),
    ("mac", re.compile(r"(?i)(?<![\w:-])[0-9a-f]{2}([:-])(?:[0-9a-f]{2}\1){4}[0-9a-f]{2}(?![\w:-])")),
    ("ipv6", re.compile(r"(?i)(?<![\w:.])(?=[0-9a-f:]*[0-9])(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?![\w:.]*[\w:])")),
    ("ip", re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])")),
    ("card", re.compile(r"(?<![\w.,-])[0-9]{4}(?:([ -]?)[0-9]{4}(?:\1[0-9]{4}\1[0-9]{1,7}|[0-9]{0,3}\1[0-9]{5}))(?![\w])")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("birth", re.compile(r"(?i)(?<!\w)(?:born(?: on)?|date of birth|d\.?o\.?b\.?|geboren(?: am)?|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento)[: ]{1,3}(?P<v>[0-9]{1,4}([./-])[0-9]{1,2}\2[0-9]{1,4})(?![\w/-]|\.\w)")),
    # a day and a year around a month's name, which may have "de" or a comma beside it
    ("birth", re.compile(r"(?i)(?<!\w)(?:born(?: on)?|date of birth|d\.?o\.?b\.?|geboren(?: am)?|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento)[: ]{1,3}(?P<v>(?:[0-9]{1,2}(?:\.|st|nd|rd|th|er)? (?:de |of )?[^\W\d_]{3,10}\.?,?(?: del?)? |[^\W\d_]{3,10}\.? [0-9]{1,2}(?:st|nd|rd|th)?,? )(?:19|20)[0-9]{2})(?!\w)")),
    ("passport", re.compile(r"(?i)(?<!\w)(?:passport|reisepass|passeport|pasaporte)[ -]?(?:no|nr|number|nummer|num|n°)?\.?[:# ]{1,3}(?P<v>(?=[A-Z]*[0-9])[A-Z0-9]{6,9})(?!\w)")),
    ("phone", re.compile(r"(?<![\w.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![\w]|[.,][0-9])")),
    # after a plus or a leading 0: groups of any length, or none
    ("phone", re.compile(r"(?<![\w.+-])(?:\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,14}(?:[ .-][0-9]{2,9}){0,4}|\(?0[1-9][0-9]{1,4}\)?[ /-][0-9]{3,9}(?:[ -][0-9]{2,5}){0,3})(?![\w]|[.,/-][0-9])")),
    ("address", re.compile(r"(?<![\w.,-])(?P<v>[1-9][0-9]{0,4}[A-Za-z]?(?: [A-Z][a-z]+){1,3})(?= (?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Court|Square|Terrace)(?!\w))")),
    ("address", re.compile(r"(?<!\w)(?P<v>[A-ZÄÖÜ][a-zäöüß]{2,})(?=(?:straße|strasse|str\.|gasse|allee) [1-9][0-9]{0,3}(?![0-9]))")),
    ("address", re.compile(r"(?<![\w.])[1-9][0-9]{0,3}(?: bis| ter)?,? (?:rue|boulevard|impasse|quai) (?:(?:de|du|des|la|le|les) |[dl]['’])*(?P<v>[^\W\d_a-zà-ÿ][^\W\d_]+(?:[ -][^\W\d_a-zà-ÿ][^\W\d_]+){0,2})")),
    ("address", re.compile(r"(?<!\w)(?:[Cc]alle|[Aa]venida|[Pp]laza) (?:(?:de|del|la|las|los|el) )*(?P<v>[^\W\d_a-zà-ÿ][^\W\d_]+(?: [^\W\d_a-zà-ÿ][^\W\d_]+){0,2})(?=,? [1-9][0-9]{0,3}(?![0-9]))")),
]
_TITLE = re.compile(rf"(?<!\w)({'|'.join(sorted(map(re.escape, HONORIFICS), key=len, reverse=True))})\.?[ \t]+({_NAME}(?:[ \t]+{_NAME}){{0,2}})")
_INTRO = re.compile(rf"(?<!\w)(?:[Mm]y name is|[Nn]ame:|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|[Mm]i nombre es)[ \t]+({_NAME}(?:[ \t]+{_NAME}){{0,2}})")
_DATE = re.compile(r"(?:19|20)[0-9]{2}([-. ])(?:0[1-9]|1[0-2])\1(?:[0-2][0-9]|3[01])(?![0-9])")
_MAYBE = re.compile(r"[0-9@]")
_WORD, _PART = re.compile(r"\w+(?:[-'’]\w+)*"), re.compile(r"\w+")
_MARKED = re.compile(r"gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|[sprk]k_(?:live|test)_|sk-|AIza|npm_|hf_|SG\.|eyJ")
_SECRET_WORDS = ("passw", "pwd", "secret", "token", "key")


def _luhn(digits: str) -> int:
    """Check digit for ``digits``."""
    total = sum(d if i % 2 else d // 5 + d * 2 % 10 for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def canonical(kind: str, raw: str) -> str:
    """The form under which mentions of one entity are one: without separators; letters that may vary in one case."""
    if kind in ("card", "ssn", "phone"):
        return ("+" if raw.startswith("+") else "") + re.sub("[^0-9]", "", raw)
    if kind == "iban":
        return raw.replace(" ", "").upper()
    if kind == "mac":
        return re.sub("[:-]", "", raw).lower()
    low = raw.lower()
    return low if (kind in ("email", "surname", "ipv6") or kind.startswith("given")) and len(low) == len(raw) else raw


def _valid(kind: str, raw: str) -> bool:
    """What a form alone can't tell: check digits, octets, and numbers that are dates or too short."""
    if kind == "ip":
        return all(int(x) <= 255 for x in raw.split("."))
    if kind == "ipv6":
        try:
            return len(raw) > 4 and ipaddress.IPv6Address(raw).version == 6
        except ValueError:
            return False
    if kind == "iban":
        short = raw.replace(" ", "").upper()
        return 15 <= len(short) <= 34 and _iban_rest(short) == 1
    if kind == "phone":
        digits = sum(c.isdigit() for c in raw)
        return 7 <= digits <= 15 and not _DATE.match(raw) and (raw[0] in "+(" or digits >= 9)
    return True


def _trimmed(kind: str, start: int, raw: str) -> tuple[int, str]:
    """A bank number may be followed by a word that looks like its last group; the longest valid beginning counts."""
    short = raw
    while kind == "iban" and not _valid(kind, short):
        short, sep, _ = short.rpartition(" ")
        if not sep:
            return start, raw
    return start, short


class _Spans:
    """Spans without overlaps, in order; those of an earlier form win."""

    def __init__(self) -> None:
        self.held: list[tuple[int, int, str, str]] = []
        self.starts: list[int] = []

    def add(self, found: Iterable[tuple[int, int, str, str]]) -> None:
        """``found`` has no overlaps of its own and comes in order."""
        new = []
        for span in found:
            i = bisect_left(self.starts, span[1])
            if not i or self.held[i - 1][1] <= span[0]:
                new.append(span)
        if new:
            self.held = sorted(self.held + new)  # two sorted runs
            self.starts = [a for a, _, _, _ in self.held]


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of the entities, in order and without overlaps; earlier kinds win.

    Names are found after an honorific or words such as "my name is", birth dates, passports and streets by the words
    around them; once a name is found, its words count as the same person's throughout the text. The work grows with
    the text's length and its number of entities, not with their product.
    """
    spans = _Spans()
    free = _MAYBE.search(text) is not None
    if not free:
        low = text.lower()
        free = any(w in low for w in _SECRET_WORDS)
    if free:
        for kind, form in _FORMS:
            group = 2 if kind == "secret" and form.groups > 1 else "v" if "v" in form.groupindex else 0
            places = (_trimmed(kind, m.start(group), m[group]) for m in form.finditer(text))
            spans.add((a, a + len(raw), kind, canonical(kind, raw)) for a, raw in places if _valid(kind, raw))
    people: dict[str, str] = {}
    named = [(HONORIFICS[m[1]], m[2]) for m in _TITLE.finditer(text)] + [("x", m[1]) for m in _INTRO.finditer(text)]
    for gender, name in named:
        names = re.split(r"[ \t]+", name)
        for i, n in enumerate(names):
            people.setdefault(n, "surname" if i == len(names) - 1 else f"given-{gender}")
    if people:
        spans.add(_mentions(text, people))
    return spans.held


def _mentions(text: str, people: dict[str, str]) -> Iterable[tuple[int, int, str, str]]:
    """Where the names stand: whole words, or the parts of hyphenated ones."""
    for m in _WORD.finditer(text):
        for w in [m] if m[0] in people else _PART.finditer(text, *m.span()):
            if w[0] in people:
                yield *w.span(), people[w[0]], canonical("given", w[0])


def _permute(symbols: list[int], radix: list[int], key: bytes) -> list[int]:
    """A keyed bijection of symbol vectors whose entries stay below their radices: an alternating Feistel network."""
    if len(symbols) < 2:
        return [(s + int.from_bytes(hashlib.blake2b(b"", key=key).digest()[:8], "big")) % r for s, r in zip(symbols, radix, strict=True)]
    half, out = len(symbols) // 2, list(symbols)
    for r in range(ROUNDS):
        mine, other = (range(half), range(half, len(out))) if r % 2 else (range(half, len(out)), range(half))
        seed = b"%d:" % r + b",".join(b"%d" % out[i] for i in other)
        stream = b""
        while len(stream) < 4 * len(mine):
            stream += hashlib.blake2b(seed + b"/%d" % len(stream), key=key).digest()
        for n, i in enumerate(mine):
            out[i] = (out[i] + int.from_bytes(stream[4 * n : 4 * n + 4], "big")) % radix[i]
    return out


@lru_cache(1 << 14)
def _like(c: str) -> str | None:
    """Characters like ``c``: signs of ASCII, or the letters, digits or symbols of its case near it in Unicode."""
    if c in _SIGNS:
        return _SIGNS
    sort = unicodedata.category(c)
    if sort[0] not in "LNSP":
        return None
    for width in (256, 4096, 65536):
        first = ord(c) // width * width
        near = "".join(x for x in map(chr, range(first, min(first + width, 0x110000))) if unicodedata.category(x) == sort and x not in "\"',;\\")
        if len(near) >= 10:
            break
    return near if c in near else None


@lru_cache(1 << 14)
def _base(c: str) -> str:
    """The letter that carries an accent, if it is one of ``ALPHABETS``; else the character itself."""
    if any(c in a for pair in ALPHABETS for a in pair):
        return c
    plain = unicodedata.normalize("NFD", c)[0]
    return plain if any(plain in a for pair in ALPHABETS for a in pair) else c


def _classes(kind: str, value: str) -> list[str | None]:
    """For each character of a canonical value the alphabet that it may change within; None: it stays."""
    if kind == "phone":  # the country code stays; so does whether the number begins with 0
        fixed = len(value) - 10 if value.startswith("+") and len(value) > 11 else 2 if value.startswith("+") else 0
        return [None if i < fixed or not c.isdigit() else ("0" if c == "0" else _DIGITS[1:]) if i == fixed else _DIGITS for i, c in enumerate(value)]
    if kind == "card":
        return [None, *[_DIGITS] * (len(value) - 2), None]
    if kind == "ssn":
        return [_DIGITS] * len(value)
    if kind == "aws":
        return [None] * 4 + [_ALNUM] * (len(value) - 4)
    if kind == "iban":
        return [None] * 4 + [_DIGITS if c.isdigit() else _UPPER for c in value[4:]]
    if kind == "secret":
        hexed = re.fullmatch("[0-9a-f]+", value) is not None
        return [_HEX if hexed else next((a for a in (_DIGITS, _LOWER, _UPPER) if c in a), None) or _like(c) for c in value]
    if kind == "token":  # what its beginning says about its kind stays
        mark = _MARKED.match(value)
        own = [None if mark and i < mark.end() else next((a for a in (_DIGITS, _LOWER, _UPPER) if c in a), None) for i, c in enumerate(value)]
        return own if any(own) else _classes("secret", value)
    if kind in ("mac", "ipv6"):  # no group of an address gets a leading zero
        return [None if c == ":" else _HEX[1:] if kind == "ipv6" and c != "0" and (not i or value[i - 1] == ":") else _HEX for i, c in enumerate(value)]
    if kind == "passport":
        return [_DIGITS if c.isdigit() else _UPPER if c in _UPPER else _LOWER for c in value]
    if kind == "email":
        top = value.rfind(".")
        return [None if i >= top else next((a for a in (_DIGITS, _LOWER) if c in a), None) or (_like(c) if c.isalpha() else None) for i, c in enumerate(value)]
    out: list[str | None] = []
    for i, c in enumerate(value):  # names and streets: vowels stay vowels of their script
        if c in _DIGITS:
            out.append(_DIGITS[1:] if c != "0" else _DIGITS)
        elif kind == "address" and (low := _base(c.lower())) != _base(c) and any(low in a for pair in ALPHABETS for a in pair):
            out.append(next(a for pair in ALPHABETS for a in pair if low in a).upper())
        else:
            plain = _base(c)
            out.append(next((a for pair in ALPHABETS for a in pair if plain in a), None) or (None if c in " -'’" else _like(c)))
    if kind.startswith("given") and len(out) > 2 and any(_base(value[-1]) in a for pair in ALPHABETS for a in pair):
        out[-1] = None  # the ending tells the gender
    return out


def _wider(kind: str, value: str, more: int) -> str:
    """The value with ``more`` symbols of its kind, for shapes that have no surrogate left to give."""
    last = value[-1:].lower()
    vowel = next((pair[0][0] for pair in ALPHABETS if _base(last) in pair[0] + pair[1]), last)
    fill = {"secret": "0", "email": "a", "aws": "A"}.get(kind) or ("0" if last.isdigit() else vowel)
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        return f"{local}{fill * more}@{domain}"
    return value[:-1] + fill * more + value[-1:]


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of a canonical value under a key; ``attempt`` chooses another permutation.

    From ``TRIES`` on the value is made longer first, by one symbol more after every ``WIDER`` attempts (an IP address
    may leave its octets' widths, then becomes one of version 6), so that no shape ever runs out of surrogates.
    """
    more = (attempt - TRIES) // WIDER + 1 if attempt >= TRIES else 0
    if kind in ("ip", "birth"):
        digits = re.findall("[0-9]+", value)
        if kind == "ip" and more > 1:
            wide = hashlib.blake2b(f"{value}/{attempt}".encode(), key=key, digest_size=15).hexdigest()
            return "fd" + ":".join([wide[:2], *(wide[i : i + 4] for i in range(2, 30, 4))])
        number = [int(x) for x in digits]
        sets = [range(256)] if kind == "ip" and more else _OCTETS if kind == "ip" else _PARTS
        own = [next(o for o in sets if x in o) for x in number]
        if kind == "birth" and more:  # any year of the same length, later any day
            own = [range(10 ** (len(d) - 1), 10 ** len(d)) if len(d) > 2 or more > 1 and x > 0 else o for d, o, x in zip(digits, own, number, strict=True)]
            own = [o if x in o else range(0, 10 ** len(d)) for d, o, x in zip(digits, own, number, strict=True)]
        k = hashlib.blake2b(f"{kind}/{attempt}/{[(o[0], o[-1]) for o in own]}/{re.sub('[0-9]+', '0', value)}".encode(), key=key).digest()
        moved = _permute([o.index(x) for o, x in zip(own, number, strict=True)], [len(o) for o in own], k)
        new = iter(str(o[i]).zfill(len(d) if d[0] == "0" else 0) for o, i, d in zip(own, moved, digits, strict=True))
        text = re.sub("[0-9]+", lambda m: next(new), value)
        return text + "9" * (more - 2) if kind == "birth" and more > 2 else text
    if more:
        value = _wider(kind, value, more)
    if kind == "email" and "@" in value:  # mentions of one domain keep a domain in common
        local, domain = value.rsplit("@", 1)
        return _shuffle("email", local + ".", key, attempt)[:-1] + "@" + _domain(domain, key)
    return _shuffle(kind, value, key, attempt)


@lru_cache(1 << 14)
def _domain(domain: str, key: bytes) -> str:
    return _shuffle("email", domain, key, 0)


def _shuffle(kind: str, value: str, key: bytes, attempt: int) -> str:
    classes = _classes(kind, value)
    names = kind == "surname" or kind == "address" or kind.startswith("given")
    chars = [_base(c) if names and (a is None or c not in a) else c for c, a in zip(value, classes, strict=True)]
    chars = [c.upper() if a is not None and c not in a and c.upper() in a else c for c, a in zip(chars, classes, strict=True)]
    at = [i for i, a in enumerate(classes) if a is not None and chars[i] in a]
    moves = set(at)
    shape = "".join("|" + (classes[i] or "") if i in moves else "=" + c for i, c in enumerate(chars))
    k = hashlib.blake2b(f"{kind}/{attempt}/{shape}".encode(), key=key).digest()
    moved = _permute([classes[i].index(chars[i]) for i in at], [len(classes[i]) for i in at], k)
    out = list(value)
    for i, s in zip(at, moved, strict=True):
        marks = unicodedata.normalize("NFD", value[i])[1:] if chars[i] != value[i] else ""
        out[i] = unicodedata.normalize("NFC", classes[i][s] + marks)
        if len(out[i]) > 1:
            out[i] = classes[i][s]
    text = "".join(out)
    if kind == "card":
        body = text[:-1]
        text = body + (str(_luhn(body)) if _luhn(value[:-1]) == int(value[-1]) else value[-1])
    if kind == "iban":
        rest = 98 - _iban_rest(text[:2] + "00" + text[4:])
        text = f"{text[:2]}{rest:02d}{text[4:]}"
    return text


def render(raw: str, kind: str, new: str) -> str:
    """Write a canonical surrogate with the separators and the case of the mention that it replaces."""
    old = canonical(kind, raw)
    if len(new) != len(old):
        return new
    cased = kind in ("email", "surname", "mac", "ipv6") or kind.startswith("given")
    out, i = [], 0
    for c in raw:
        if i < len(old) and c.lower() == old[i].lower():
            out.append(new[i].upper() if c.isupper() and cased else new[i].lower() if c.islower() and kind == "iban" else new[i])
            i += 1
        else:
            out.append(c)
    return "".join(out)


def replace(text: str, key: bytes, other: dict[tuple[str, str], int]) -> tuple[str, int]:
    spans = detect(text)
    if not spans:
        return text, 0
    out, at, made = [], 0, {}
    for a, b, kind, value in spans:
        if (kind, value) not in made:
            made[kind, value] = surrogate(kind, value, key, other.get((kind, value), 0))
        out += [text[at:a], render(text[a:b], kind, made[kind, value])]
        at = b
    return "".join([*out, text[at:]]), len(spans)


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per mention: id, start and end (code points), kind, canonical value. Null texts have none."""

    def run(batches):
        for batch, raw in texts(batches, "_text"):
            rows = [(i, *span) for i, t in zip(batch.column(0).to_pylist(), raw, strict=True) for span in detect(t.decode())]
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[id_col, "start", "end", "kind", "value"])

    return docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias("_text")).mapInArrow(run, f"{id_col} long, start long, end long, kind string, value string")


def assign(distinct: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt, surrogate) for distinct entities, with no surrogate that another has or that is real.

    Rounds of joins over the entities: whoever's surrogate is a real value of its kind (its own included), or that of
    a smaller value too, tries the next permutation; after ``TRIES`` of them longer ones, so that the rounds end.
    """

    def run(batches):
        for batch in batches:
            kind, value, attempt = (batch.column(i).to_pylist() for i in range(3))
            new = [surrogate(k, v, key, n) for k, v, n in zip(kind, value, attempt, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(new, pa.string())], names=["kind", "value", "attempt", "surrogate"])

    now = write_table(distinct.select("kind", "value", F.lit(0).alias("attempt")).mapInArrow(run, "kind string, value string, attempt int, surrogate string"), "surrogates")
    while True:
        real = now.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real")).distinct()
        first = now.groupBy("kind", "surrogate").agg(F.min("value").alias("first"), F.count("*").alias("n"))
        judged = now.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        judged = judged.withColumn("bad", F.coalesce("real", F.lit(False)) | (F.col("first") != F.col("value")))
        if judged.filter("bad").isEmpty():
            break
        after = write_table(judged.select("kind", "value", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt")).mapInArrow(run, "kind string, value string, attempt int, surrogate string"), "surrogates")
        drop_table(now)
        now = after
    return now


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", send_bytes: int = SEND_BYTES) -> DataFrame:
    """All columns of ``docs``, the text's entities replaced, plus ``n_entities`` (0 for a null text, which stays null).

    Columns of ``docs`` that are named ``n_entities``, ``_row`` or ``_moved`` are replaced or left out.

    Texts are read twice: once for the distinct entities, whose surrogates are checked against each other, and once
    to replace them. Only entities with another than the first permutation travel to the second pass: by broadcast
    while they take at most ``send_bytes``, beyond that joined to the documents that mention them. Equal mentions in
    any row, repeated rows included, get equal surrogates. An empty table gives an empty one.
    """
    secret = hashlib.blake2b(key.encode()).digest()[:32]
    docs = docs.drop("n_entities", "_row", "_moved")
    plain = docs.withColumn(text_col, docs[text_col].cast("string"))
    mapping = assign(entities(docs, id_col, text_col).select("kind", "value").distinct(), secret)
    moved = mapping.filter("attempt > 0")
    size = moved.agg(F.coalesce(F.sum(F.length("value") + 64), F.lit(0))).head()[0]
    names = plain.columns
    at = names.index(text_col)

    def rewrite(batch, raw, others):
        new = [replace(t.decode(), secret, o) for t, o in zip(raw, others, strict=True)]
        missing = batch.column(at).is_null().to_pylist()
        cols = [pa.array([None if m else t for (t, _), m in zip(new, missing, strict=True)], pa.string()) if i == at else batch.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([*cols, pa.array([n for _, n in new], pa.int64())], names=[*names, "n_entities"])

    schema = plain.select("*", F.lit(0).cast("long").alias("n_entities")).schema
    if size <= send_bytes:
        sent = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["value"]): r["attempt"] for r in moved.select("kind", "value", "attempt").collect()})
        drop_table(mapping)

        def run(batches):
            for batch, raw in texts(batches, text_col):
                yield rewrite(batch, raw, [sent.value] * len(raw))

        return plain.mapInArrow(run, schema)

    tagged = write_table(plain.withColumn("_row", F.monotonically_increasing_id()), "rows")
    own = entities(tagged, "_row", text_col).select("_row", "kind", "value").distinct().join(moved.select("kind", "value", "attempt").hint("merge"), ["kind", "value"])
    own = own.groupBy("_row").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("_moved"))

    def joined(batches):
        for batch, raw in texts(batches, text_col):
            moves = batch.column(batch.schema.get_field_index("_moved")).to_pylist()
            yield rewrite(batch, raw, [{(m["kind"], m["value"]): m["attempt"] for m in ms or []} for ms in moves])

    return tagged.join(own, "_row", "left").select(*names, "_moved").repartition(partitions(docs.sparkSession)).mapInArrow(joined, schema)
