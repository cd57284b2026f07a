"""Personal data replaced by keyed surrogates of the same type and format.

Numbers, addresses and tokens go through a keyed permutation of all strings of
their own format (a Feistel network over the mixed-radix number that their
letters and digits spell, walked on until the result is of the same class:
valid check digit, public address and so on), which leaves no string as it was.
A permutation can't let two entities meet, whatever the corpus, and equal
entities stay equal, so these types need no table.

Names are found after titles, in the letters of any script that has capitals, and in
Han; then every word of a name found is an entity of its own, a family name or a given
name with the gender of its title, and each mention of such a word in the document is
replaced, with a title or without, in capitals too. A mention needs more evidence, a title or another word of a name beside
it, after a German article, and for names of months and days; for a word that the document also has in
small letters it is enough that the mention doesn't begin a sentence. So full and
family names, and other titles, agree throughout the corpus. Their surrogates are drawn
by a keyed hash from the syllables of their script, a fixed number of them, so a name's
surrogate follows from the name alone; the distinct names of the
corpus are gathered by Spark, names that meet (or meet a real one) draw again,
and only these exceptions are sent to the tasks.

IPv6 addresses keep their spelling's shape, their first group (two after 2001) and their case; two spellings of one address are two entities.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from math import prod
from operator import or_

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

#: Where a session holds its secret key (hexadecimal digits), and the key of the registered query over synthetic tables where it holds none.
KEY_SETTING, FIXTURE_KEY = "spark.tessera.surrogates.key", b"for synthetic tables only"
#: Syllables of a family name (a given name has one less, and the end of its gender), and how many names may draw more than once.
#: Of n names of one script some n * n / 10^11 meet at first (Latin), so ten million make a thousand exceptions.
WIDTH, MAX_EXCEPTIONS = 4, 100_000
ROUNDS = 8
TYPES = ("email", "phone", "card", "ip", "ssn", "iban", "token", "name")

# ---------------------------------------------------------------- detection

_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+")
_IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")
_H = "[0-9A-Fa-f]{1,4}"
_IP6 = re.compile(rf"(?<![\w:.])(?:{_H}(?::{_H}){{7}}|(?:{_H}(?::{_H}){{0,6}})?::(?:{_H}(?::{_H}){{0,6}})?)(?![\w:]|\.\d)")
_SSN = re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])")
_CARD = re.compile(r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w\-]|\.\d)")
_PHONE = re.compile(r"(?<![\w.\-])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{2,4}(?:[ .\-]\d{2,4})?(?![\w\-]|\.\d)|(?<![\w.\-])\+\d{8,15}(?!\w)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_TOKEN = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])")
_QUICK_DIGIT, _QUICK_HEX = re.compile(r"\d[\d .\-()]{6}"), re.compile(r"[0-9a-fA-F]{32}")
#: Titles by gender; a name is the capitalised words after one.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Madame", "Mme", "Mademoiselle", "Frau", "Señora", "Sra", "Señorita", "Госпожа", "Κυρία"), "m": ("Mr", "Monsieur", "Herr", "Herrn", "Señor", "Sr", "Господин", "Κύριος"), "x": ("Dr", "Prof")}
_TITLE_GENDER = {t: g for g, names in TITLES.items() for t in names}
#: A word with a capital at its beginning and a small letter somewhere, one in capitals, and either.
_MIXED, _CAPITALS = r"\p{Lu}(?=[\p{L}\p{M}]*\p{Ll})[\p{L}\p{M}]++", r"\p{Lu}[\p{Lu}\p{M}]++(?![\p{L}\p{M}])"
_CAPITAL = rf"(?:{_MIXED}|{_CAPITALS})"
#: What a name's word may begin with; it stays.
_HEAD = r"(?:(?:Mc|Mac|Fitz)(?=\p{Lu})|[ODLdl]['’])?"
#: Words that join a family name; they stay.
PARTICLES = ("van", "von", "de", "del", "della", "der", "den", "des", "di", "da", "dos", "du", "la", "le", "ten", "ter", "zu", "zum", "zur", "al", "el", "bin", "ibn", "af", "av")
_JOIN = rf"(?:(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))}) )*"
_TITLE = "|".join(sorted(_TITLE_GENDER, key=len, reverse=True))
_LONG = lambda part: rf"{_JOIN}{_HEAD}{part}(?:-{_HEAD}{part})*(?: {_JOIN}{_HEAD}{part}(?:-{_HEAD}{part})*){{0,4}}"
_NAME = regex.compile(rf"(?<!\w)({_TITLE})(\.? )({_LONG(_MIXED)}|{_LONG(_CAPITALS)}|\p{{Han}}{{2,4}})")
_WORD = regex.compile(rf"(?<![\w\p{{M}}])({_HEAD})({_CAPITAL})")
_HAN = regex.compile(r"\p{Han}{2,4}")
_SMALL = regex.compile(r"(?<![\w\p{M}])\p{Ll}[\p{L}\p{M}]+")
#: German articles and what they are joined to, after which a capital is no sign of a name; months and days that are also names or near them.
ARTICLES = frozenset("der die das dem den des ein eine einen einem einer eines zum zur beim vom im am".split())
CALENDAR = frozenset("january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag".split())
_BEFORE = regex.compile(r"(?:(\w+) )?$")
_SENTENCE = regex.compile(r"(?:^|[.!?…:\n])[\s\p{Pi}\p{Pf}\"'(]*$")
#: What a text with a name has.
_QUICK_NAMES = tuple(f"{t}{end}" for t in _TITLE_GENDER for end in (" ", ". "))


def folded(word: str) -> str:
    """A word of a name as its entity has it: composed, in small letters."""
    return unicodedata.normalize("NFC", word).lower()


def _titled(text: str) -> tuple[dict[str, str], set[int]]:
    """The entities of the words of all names that stand after a title (see ``persons``), and where these words begin."""
    family: set[str] = set()
    given: dict[str, set[str]] = {}
    places: set[int] = set()
    if any(t in text for t in _QUICK_NAMES):
        for m in _NAME.finditer(text):
            if _HAN.fullmatch(m[3]):
                family.add(m[3])
                continue
            last = m.end(3) - len(m[3].rsplit(" ", 1)[-1])
            for w in _WORD.finditer(text, m.start(3), m.end(3)):
                places.add(w.start(2))
                if w.start() >= last:
                    family.add(folded(w[2]))
                else:
                    given.setdefault(folded(w[2]), set()).add(_TITLE_GENDER[m[1]])
    out = {w: f"f|{w}" for w in family}
    for w, genders in given.items():
        known = genders - {"x"}
        out.setdefault(w, f"g|{min(known) if len(known) == 1 else 'x'}|{w}")
    return out, places


def persons(text: str) -> dict[str, str]:
    """The entities of the words of all names that stand after a title: ``f|müller``, or ``g|m|john`` for a given name.

    The last word of a name (and what a hyphen joins to it) is a family name, those before are given
    names. A word that is both counts as a family name. A given name has the gender that a
    title gives it anywhere in the text, ``x`` if none or several do. A name in Han is one family name.
    """
    return _titled(text)[0]


def _mentions(text: str, known: dict[str, str], places: set[int]) -> list[tuple[int, int]]:
    """Where the words of names stand: those after titles, and others as far as they have the evidence that the module's text asks for."""
    words = [(m.start(2), m.end(2), folded(m[2])) for m in _WORD.finditer(text)]
    small = {folded(m[0]) for m in _SMALL.finditer(text)} & set(known)
    sure, doubtful = [], []
    for a, b, w in words:
        if w not in known:
            continue
        ahead = text[max(0, a - 40) : a]
        if a in places:
            sure.append((a, b))
        elif w in CALENDAR or (m := _BEFORE.search(ahead)) and m[1] and m[1].lower() in ARTICLES or w in small and _SENTENCE.search(ahead):
            doubtful.append((a, b))
        else:
            sure.append((a, b))
    begins, ends = {a for a, _ in sure}, {b for _, b in sure}
    # Beside a word of a name, but for a space or hyphen.
    sure += [(a, b) for a, b in doubtful if (text[a - 1 : a] in (" ", "-") and a - 1 in ends) or (text[b : b + 1] in (" ", "-") and b + 1 in begins)]
    for w in known:
        if _HAN.fullmatch(w):
            sure += [(m.start(), m.end()) for m in re.finditer(re.escape(w), text)]
    return sure


def _luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


def _is_ip6(text: str) -> bool:
    """An address with a digit and two groups at least: what programs write between names is none."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return any(c in DIGITS for c in text) and sum(map(bool, text.split(":"))) > 1


def found_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, entity) of the entities of a text, without overlaps; a name's spans are its words, without title, particles and heads like Mc.

    Where kinds compete for the same characters, the earlier of email, token, address,
    social security number, account, card, phone and name wins.
    """
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    if _QUICK_DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(int(x) < 256 for x in m[0].split("."))]
        found += [(m.start(), m.end(), "ssn") for m in _SSN.finditer(text)]
        found += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text)]
        found += [(m.start(), m.end(), "card") for m in _CARD.finditer(text)]
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text)]
    if _QUICK_HEX.search(text):
        found += [(m.start(), m.end(), "token") for m in _TOKEN.finditer(text)]
    if "::" in text or text.count(":") > 6:
        found += [(m.start(), m.end(), "ip") for m in _IP6.finditer(text) if _is_ip6(m[0])]
    known, places = _titled(text)
    if known:
        found += [(a, b, "name") for a, b in _mentions(text, known, places)]
    if len(found) > 1:
        order = {"email": 0, "token": 1, "ip": 2, "ssn": 3, "iban": 4, "card": 5, "phone": 6, "name": 7}
        found.sort(key=lambda x: (order[x[2]], x[0]))
        used, free = bytearray(len(text)), []
        for a, b, kind in found:
            if not any(used[a:b]):
                used[a:b] = b"\1" * (b - a)
                free.append((a, b, kind))
        found = sorted(free)
    return [(a, b, kind, known[folded(text[a:b])] if kind == "name" else text[a:b]) for a, b, kind in found]


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a text."""
    return [x[:3] for x in found_entities(text)]


# ---------------------------------------------------------------- permutations

DIGITS, LOWER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"


def _round(key: bytes, tweak: bytes, i: int, value: int, modulus: int) -> int:
    size = (modulus.bit_length() + 7) // 8 + 8
    data = hmac.digest(key, b"%d|%s|%d|%d" % (i, tweak, modulus, value), "sha256")
    while len(data) < size:
        data += hmac.digest(key, data, "sha256")
    return int.from_bytes(data[:size], "big") % modulus


def _halves(radices: list[int]) -> tuple[int, int]:
    half = len(radices) // 2
    return prod(radices[:half]), prod(radices[half:])


def permute(key: bytes, tweak: bytes, value: int, radices: list[int], back: bool = False) -> int:
    """A keyed permutation of the mixed-radix numbers below the product of ``radices``, or its inverse: an alternating Feistel network over two halves."""
    left, right = _halves(radices)
    a, b = divmod(value, right)
    for i in reversed(range(0, ROUNDS, 2)) if back else range(0, ROUNDS, 2):
        if back:
            b = (b - _round(key, tweak, i + 1, a, right)) % right
            a = (a - _round(key, tweak, i, b, left)) % left
        else:
            a = (a + _round(key, tweak, i, b, left)) % left
            b = (b + _round(key, tweak, i + 1, a, right)) % right
    return a * right + b


def displace(key: bytes, tweak: bytes, value: int, radices: list[int]) -> int:
    """A keyed permutation that leaves nothing in its place, if there are two numbers at least: one cycle through all, in the order of ``permute``."""
    size = prod(radices)
    return permute(key, tweak, (permute(key, tweak, value, radices) + 1) % size, radices, back=True)


def _alphabets(text: str, hexadecimal: bool = False) -> list[str]:
    """The alphabet of each character that is replaced; the others belong to the format."""
    return [HEX if hexadecimal else DIGITS if c in DIGITS else LOWER for c in text if c in DIGITS or c in LOWER]


def spell(key: bytes, kind: str, text: str, accept: Callable[[str], bool] = lambda _: True, hexadecimal: bool = False, alphabets: list[str] | None = None) -> str:
    """The permuted text: digits stay digits, lower-case letters letters, all else stays. Walks on until ``accept``.

    ``accept`` must hold for the text itself; then the walk is a permutation of
    the accepted texts, and only a text that is the only one of its class stays.
    """
    sets = alphabets or _alphabets(text, hexadecimal)
    if not sets:
        return text
    form = "".join(c if not (c in DIGITS or c in LOWER) else ("h" if hexadecimal else "d" if c in DIGITS else "l") for c in text)
    tweak = f"{kind}|{form}|{[len(s) for s in sets] if alphabets else ''}".encode()
    radices = [len(s) for s in sets]
    value = 0
    for c, s in zip((c for c in text if c in DIGITS or c in LOWER), sets):
        value = value * len(s) + s.index(c)
    while True:
        value = displace(key, tweak, value, radices)
        rest, letters = value, []
        for s in reversed(sets):
            rest, x = divmod(rest, len(s))
            letters.append(s[x])
        out = iter(reversed(letters))
        result = "".join(next(out) if c in DIGITS or c in LOWER else c for c in text)
        if accept(result):
            return result


def _digits_of(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def _refill(form: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in form)


#: Nets whose addresses stay within them: first address and number of host bits.
NETS = [("10.0.0.0", 24), ("127.0.0.0", 24), ("172.16.0.0", 20), ("192.168.0.0", 16), ("169.254.0.0", 16), ("224.0.0.0", 28), ("240.0.0.0", 28)]
_NETS = [(int(ipaddress.IPv4Address(a)), n) for a, n in NETS]


def _net(address: int) -> int | None:
    return next((i for i, (a, n) in enumerate(_NETS) if address >> n == a >> n), None)


def _ip(key: bytes, text: str) -> str:
    address = 0
    for part in text.split("."):
        address = address * 256 + int(part)
    net = _net(address)
    if net is not None:
        first, bits = _NETS[net]
        result = first + displace(key, b"net%d" % net, address - first, [2] * bits)
    else:
        result = address
        while True:
            result = displace(key, b"public", result, [256] * 4)
            if _net(result) is None:
                break
    return ".".join(str(result >> s & 255) for s in (24, 16, 8, 0))


def _ip6(key: bytes, text: str) -> str:
    """Shape, first group (two after 2001), leading zeros and case stay; the other digits are permuted."""
    low = text.lower()
    kept = re.match(r"2001:+[0-9a-f]*|[0-9a-f]*", low).end()
    if not any(c in HEX for c in low[kept:]):
        kept = 0
    zeros = lambda x: [len(g) > 1 and g[0] == "0" for g in x.split(":")]
    head, rest = low[:kept], low[kept:]
    done = head + spell(key, f"ip6|{head}", rest, lambda x: zeros(head + x) == zeros(low), hexadecimal=True)
    return done if text == low else done.upper()


def _card(key: bytes, digits: str) -> str:
    valid = _luhn(digits)
    return digits[0] + spell(key, f"card{digits[0]}{valid}", digits[1:], lambda x: _luhn(digits[0] + x) == valid)


#: Country calling codes of one and two digits; all others have three.
CALLING_CODES = ("1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(key: bytes, text: str) -> str:
    """The country code and the North American exchange 555 stay; so does whether area and exchange codes are valid there."""
    m = re.match(r"\+(\d{1,3})(?=[ .\-(])", text)
    size = m.end() if m else 0
    if not m and text.startswith("+"):  # written without spaces
        size = 1 + next((n for n in (1, 2) if text[1 : 1 + n] in CALLING_CODES), 3)
    code, rest = text[:size], text[size:]
    digits = _digits_of(rest)
    if len(digits) == 10:
        fictional = digits[3:6] == "555"
        good = digits[0] in "23456789"
        own = digits[:3] + digits[6:] if fictional else digits
        new = spell(key, f"phone{code}{fictional}", own, lambda x: (x[0] in "23456789") == good and (fictional or (x[3:6] != "555" and (x[3] in "23456789") == (own[3] in "23456789"))))
        new = new[:3] + "555" + new[3:] if fictional else new
    else:
        new = spell(key, f"phone{code}", digits)
    return code + _refill(rest, new)


def _email(key: bytes, text: str) -> str:
    """Addresses that differ in case alone are one; each capital stays one."""
    local, _, domain = text.lower().rpartition("@")
    head, dot, top = domain.rpartition(".")
    done = spell(key, f"email|{top}", f"{local}@{head}") + dot + top
    return "".join(c.upper() if old.isupper() else c for c, old in zip(done, text))


def _iban(key: bytes, text: str) -> str:
    """Country and layout stay; check digits are made right (or, for a wrong number, are permuted with the rest)."""
    flat = text.replace(" ", "").lower()
    number = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4]))
    if number(flat) % 97 == 1:
        body = spell(key, f"iban{flat[:2]}", flat[4:])
        flat = f"{flat[:2]}{98 - number(f'{flat[:2]}00{body}') % 97:02d}{body}"
    else:
        flat = flat[:2] + spell(key, f"wrong iban{flat[:2]}", flat[2:], lambda x: number(flat[:2] + x) % 97 != 1)
    it = iter(flat.upper())
    return "".join(c if c == " " else next(it) for c in text)


# ---------------------------------------------------------------- names

#: Beginnings, vowels and ends of a name's syllables by script; and the ends of given names by script and gender.
SOUNDS = {
    "latin": ("b d f g h k l m n p r s t v w z".split(), "a e i o u".split(), ["", "l", "n", "r", "s", "m"]),
    "cyrillic": ("б в г д ж з к л м н п р с т".split(), "а е и о у".split(), ["", "л", "н", "р", "с", "м"]),
    "greek": ("β γ δ θ κ λ μ ν π ρ σ τ φ χ".split(), "α ε ι ο υ".split(), ["", "λ", "ν", "ρ", "σ", "μ"]),
}
#: First and number of the characters that names in Han are drawn from.
HAN = (0x4E00, 20_000)
GIVEN_ENDS = {
    ("latin", "f"): "a ia ina elle".split(), ("latin", "m"): "us or ert ik".split(), ("latin", "x"): "y is en o".split(),
    ("cyrillic", "f"): "а ия ина".split(), ("cyrillic", "m"): "ор ислав ий".split(), ("cyrillic", "x"): "я ы".split(),
    ("greek", "f"): "α ία ίνα".split(), ("greek", "m"): "ος ης ας".split(), ("greek", "x"): "ι ω".split(),
}


def script(text: str) -> str:
    for c in text:
        if "а" <= c.lower() <= "я" or c.lower() == "ё":
            return "cyrillic"
        if "ά" <= c.lower() <= "ώ":
            return "greek"
        if _HAN.match(c * 2):
            return "han"
    return "latin"


def name_surrogate(key: bytes, entity: str, draw: int = 0, width: int = WIDTH) -> str:
    """The surrogate of a word of a name, in lower case: ``width`` syllables of its script, for a given name one less and the end of its gender; as many characters of Han."""
    role, *gender, name = entity.split("|")
    kind = script(name)
    seed = int.from_bytes(hmac.digest(key, f"name|{draw}|{width}|{entity}".encode(), "sha512"), "big")

    def pick(n: int) -> int:
        nonlocal seed
        seed, at = divmod(seed, n)
        return at

    if kind == "han":
        return "".join(chr(HAN[0] + pick(HAN[1])) for _ in name)
    spelt = "".join(part[pick(len(part))] for _ in range(max(1, width - (role == "g"))) for part in SOUNDS[kind])
    if role == "g":
        ends = GIVEN_ENDS[kind, gender[0]]
        spelt += ends[pick(len(ends))]
    return spelt


# ---------------------------------------------------------------- replacement


class Replacer:
    """Surrogates under one key; ``draws`` has the names that drew more than once."""

    def __init__(self, key: bytes, draws: dict[str, int] | None = None, width: int = WIDTH) -> None:
        self.key, self.draws, self.width = key, draws or {}, width
        self.surrogate = lru_cache(50_000)(self._surrogate)

    def _surrogate(self, kind: str, text: str) -> str:
        key = self.key
        if kind == "email":
            return _email(key, text)
        if kind == "card":
            return _refill(text, _card(key, _digits_of(text)))
        if kind == "ip":
            return _ip6(key, text) if ":" in text else _ip(key, text)
        if kind == "ssn":
            return spell(key, "ssn", text)
        if kind == "phone":
            return _phone(key, text)
        if kind == "iban":
            return _iban(key, text)
        if kind == "token":
            low = spell(key, "token", text.lower(), hexadecimal=True)
            return low if text == text.lower() else low.upper()
        return name_surrogate(key, text, self.draws.get(text, 0), self.width).capitalize()

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with surrogates, and the spans (start, end, type) that were replaced in the old text."""
        spans, parts, at = found_entities(text), [], 0
        for a, b, kind, entity in spans:
            new = self.surrogate(kind, entity)
            parts += [text[at:a], new.upper() if kind == "name" and text[a:b].isupper() else new]
            at = b
        return ("".join([*parts, text[at:]]) if spans else text), [x[:3] for x in spans]


def names(df: DataFrame, text: str = "text") -> DataFrame:
    """(entity): the distinct words of names of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {e for t in common.strings(batch.column(0)) for e in persons(t).values()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["entity"])

    titled = reduce(or_, (F.contains(F.col("t"), F.lit(q)) for q in _QUICK_NAMES))
    return df.select(F.col(text).cast("string").alias("t")).where(titled).mapInArrow(run, "entity string").distinct()


def settle_names(entities: DataFrame, key: bytes, width: int = WIDTH, max_exceptions: int = MAX_EXCEPTIONS) -> dict[str, int]:
    """Draws of the names that may not keep their first surrogate of ``width`` syllables.

    A surrogate belongs to the least entity that draws it; the others draw
    again until no two meet and none is itself a name of the corpus. All other names keep the
    surrogate that follows from the key alone, however many more there are. More
    exceptions than the bound raise RuntimeError: then a greater width is asked for.
    """
    spark = entities.sparkSession
    entities = common.cut(entities)
    draws: dict[str, int] = {}
    if entities.isEmpty():
        return draws
    for _ in range(40):
        shared = spark.sparkContext.broadcast(draws)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                e = batch.column(0).to_pylist()
                s = [name_surrogate(key, x, shared.value.get(x, 0), width) for x in e]
                yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(s)], names=["entity", "s"])

        drawn = entities.mapInArrow(run, "entity string, s string")
        owner = drawn.groupBy("s").agg(F.min("entity").alias("owner"), F.count("*").alias("n")).where("n > 1")
        real = entities.select(F.substring_index("entity", "|", -1).alias("s")).distinct()
        again = drawn.join(owner, "s").where("entity != owner").select("entity").union(drawn.join(real, "s", "left_semi").select("entity")).distinct()
        met = [r.entity for r in again.limit(max_exceptions + 1).collect()]
        if not met:
            return draws
        for x in met:
            draws[x] = draws.get(x, 0) + 1
        if len(draws) > max_exceptions:
            raise RuntimeError(f"over {max_exceptions} names meet at {width} syllables: raise the width")
    raise RuntimeError("the names didn't settle")


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names; that of the synthetic tables if it names none. Who knows the key can undo the permutations."""
    own = spark.conf.get(KEY_SETTING, None)
    return bytes.fromhex(own) if own else FIXTURE_KEY


def surrogates(df: DataFrame, text: str = "text", *, key: bytes) -> DataFrame:
    """All columns with the text's entities replaced, and ``entities``: an array of (start, end, type) in code points of the old text.

    A null text stays null and has no entity. A column of the name ``entities`` is replaced.
    """
    if not key:
        raise ValueError("surrogates need a key")
    shared = df.sparkSession.sparkContext.broadcast((key, settle_names(names(df, text), key)))
    kept = [c for c in df.columns if c != "entities"]
    at = kept.index(text)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replacer = Replacer(*shared.value)
        for batch in batches:
            done = [(None, []) if t is None else replacer.replace(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([[{"start": a, "end": b, "type": k} for a, b, k in s] for _, s in done], span)], names=[*kept, "entities"])

    head = "".join(f"`{c}` {'string' if c == text else df.schema[c].dataType.simpleString()}, " for c in kept)
    return df.select(*(F.col(c).cast("string").alias(c) if c == text else F.col(c) for c in kept)).mapInArrow(run, head + "entities array<struct<start:int,end:int,type:string>>")


def _count(kind: str) -> Column:
    return F.size(F.filter("entities", lambda e: e["type"] == kind)).cast("long")


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for their personal data."""
    done = surrogates(common.table(spark, sf_dir, "documents").select("doc_id", "text"), key=session_key(spark))
    counts = [_count(k).alias(f"n_{k}") for k in TYPES]
    return done.select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"), F.size("entities").cast("long").alias("n_entities"), *counts)
