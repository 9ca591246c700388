"""Format-preserving pseudonyms: keyed permutations of numbers and dates within their own format.

A balanced Feistel network with blake2b as its round function permutes all numbers of a range. Ranges that are no square and
formats with rules (months, check digits, area codes) are met by cycle walking: the permutation is applied again until the value
is valid, which keeps it a permutation of the valid values. Numbers are permuted in a normal form (a telephone number without its
country's prefix, a document number without blanks) and written back in the form they had, so that equal values stay equal however
they are written, and different ones stay different.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache
from math import isqrt

ROUNDS = 8


@lru_cache(maxsize=256)
def _subkey(key: bytes, tweak: str) -> bytes:
    return hashlib.blake2b(tweak.encode(), key=key[:64], digest_size=32).digest()


def permute(value: int, size: int, key: bytes, tweak: str = "", valid: Callable[[int], bool] | None = None) -> int:
    """A keyed permutation of 0 ... size - 1, or of the valid values in that range; a value that is not valid stays."""
    if size < 2 or valid is not None and not valid(value):
        return value
    key = _subkey(key, tweak)
    side = isqrt(size - 1) + 1
    blake, number = hashlib.blake2b, int.from_bytes
    while True:
        a, b = divmod(value, side)
        for n in range(ROUNDS):
            a, b = b, (a + number(blake(b"%d|%d" % (n, b), key=key, digest_size=8).digest(), "big")) % side
        value = a * side + b
        if value < size and (valid is None or valid(value)):
            return value


def _places(text: str, wanted: Callable[[str], bool]) -> list[int]:
    return [i for i, c in enumerate(text) if c.isascii() and wanted(c)]


def _written(text: str, places: list[int], fresh: str) -> str:
    """The text with the characters at some places replaced."""
    out = list(text)
    for i, c in zip(places, fresh):
        out[i] = c
    return "".join(out)


def _number(value: str, base: int) -> int:
    first, out = ord("0" if base == 10 else "A"), 0
    for c in value:
        out = out * base + ord(c) - first
    return out


def _digits(value: int, width: int, base: int) -> str:
    first, out = ord("0" if base == 10 else "A"), []
    for _ in range(width):
        value, d = divmod(value, base)
        out.append(chr(first + d))
    return "".join(reversed(out))


def permute_digits(text: str, key: bytes, tweak: str, keep: int = 0) -> str:
    """Digits and capital letters after the first `keep` of them permuted each within its kind; everything else stays.

    The permutation depends on the digits and letters alone, not on blanks or hyphens between them.
    """
    places = _places(text, lambda c: c.isdigit() or c.isupper())[keep:]
    out = text
    for base, kind in ((10, [i for i in places if text[i].isdigit()]), (26, [i for i in places if not text[i].isdigit()])):
        if kind:
            value = _number("".join(text[i] for i in kind), base)
            out = _written(out, kind, _digits(permute(value, base ** len(kind), key, f"{tweak}{len(kind)}|{base}"), len(kind), base))
    return out


# Telephone numbers.

#: Digits of the national number that stay, by country: the kind of line or the area.
_AREA = {"33": 1, "44": 2, "49": 2, "1": 3}


def national(text: str) -> tuple[str, int]:
    """(country, number of digits of the national number, which come last) of a telephone number; country '' if unknown."""
    digits = "".join(c for c in text if c.isdigit())
    head = text.lstrip("( ")
    if head[:1] == "+" or head[:2] == "00":
        bare = digits if head[:1] == "+" else digits[2:]
        for country in _AREA:
            if bare.startswith(country):
                rest = bare[len(country) :]
                if "(0)" in text:
                    rest = rest[1:]
                return country, len(rest)
        return "", max(0, len(bare) - 3)
    if digits[:1] == "0":
        if len(digits) == 11 and digits[1] == "7":
            return "44", 10
        if len(digits) == 10 and "/" not in text:
            return "33", 9
        return "49", len(digits) - 1
    return ("1", 10) if len(digits) == 10 else ("", max(0, len(digits) - 3))


def permute_phone(text: str, key: bytes) -> str:
    """Another number of the same country, area and length, written the same way."""
    country, n = national(text)
    places = _places(text, str.isdigit)
    if n <= 0 or n > len(places):
        return permute_digits(text, key, "phone", keep=2)
    own = places[-n:]
    number = "".join(text[i] for i in own)
    keep = min(_AREA.get(country, 0), n - 1)
    rest = number[keep:]
    size = 10 ** len(rest)
    valid = (lambda v: v // 10**6 >= 2) if country == "1" and len(rest) == 7 else None  # exchanges begin with 2 to 9
    fresh = permute(int(rest), size, key, f"phone{country}|{number[:keep]}|{n}", valid)
    return _written(text, own, number[:keep] + f"{fresh:0{len(rest)}d}")


# Identity numbers.


def nir_key(body: str) -> int:
    """The check number of the first 13 characters of a French social insurance number."""
    return 97 - int(body.replace("2A", "19").replace("2B", "18")) % 97


def nir_valid(text: str) -> bool:
    bare = re.sub(r"[^0-9AB]", "", text)
    return bool(re.fullmatch(r"[1-478]\d{4}(?:\d\d|2[AB])\d{8}", bare)) and nir_key(bare[:13]) == int(bare[13:])


def permute_nir(text: str, key: bytes) -> str:
    """Another valid number: sex and department stay, year, month and serial are permuted, the check number is computed."""
    bare = re.sub(r"[^0-9AB]", "", text)
    month = int(bare[3:5])
    if 1 <= month <= 12:
        born = permute(int(bare[1:3]) * 12 + month - 1, 1200, key, "nir-born")
        year, month = divmod(born, 12)
        middle = f"{year:02d}{month + 1:02d}"
    else:
        middle = bare[1:5]
    serial = permute(int(bare[7:13]), 10**6, key, "nir-serial")
    body = bare[0] + middle + bare[5:7] + f"{serial:06d}"
    return _written(text, _places(text, lambda c: c.isdigit() or c in "AB"), body + f"{nir_key(body):02d}")


#: The check letter of a Spanish number is this letter of its remainder by 23.
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def dni_letter(digits: str) -> str:
    return _DNI[int(digits) % 23]


def svnr_check(bare: str) -> int:
    """The check digit of the first 11 characters of a German social insurance number."""
    digits = bare[:8] + f"{ord(bare[8]) - 64:02d}" + bare[9:11]
    return sum(sum(divmod(int(d) * w, 10)) for d, w in zip(digits, (2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1))) % 10


_LEAP = dt.date(2000, 1, 1)


def _permute_birth(day: str, month: str, year: str, key: bytes, tweak: str) -> tuple[str, str, str]:
    """A date of two-digit year permuted among all dates of a century; a day that does not exist stays."""
    try:
        born = (dt.date(2000 + int(year), int(month), int(day)) - _LEAP).days
    except ValueError:
        return day, month, year
    moved = _LEAP + dt.timedelta(permute(born, 36_525, key, tweak))
    return f"{moved:%d}", f"{moved:%m}", f"{moved:%y}"


def permute_id(text: str, key: bytes) -> str:
    """An identity number permuted among the numbers of its kind: check digits and letters that are right stay right."""
    if nir_valid(text):
        return permute_nir(text, key)
    places = _places(text, lambda c: c.isdigit() or c.isupper())
    bare = "".join(text[i] for i in places)
    if re.fullmatch(r"\d{8}[A-Z]\d{3}", bare):  # area, day of birth, letter, serial and check digit
        day, month, year = _permute_birth(bare[2:4], bare[4:6], bare[6:8], key, "svnr-born")
        letter = _digits(permute(ord(bare[8]) - 65, 26, key, "svnr-letter"), 1, 26)
        right = svnr_check(bare) == int(bare[11])
        serial = f"{permute(int(bare[9:11] if right else bare[9:12]), 100 if right else 1000, key, 'svnr-serial'):0{2 if right else 3}d}"
        fresh = bare[:2] + day + month + year + letter + serial
        return _written(text, places, fresh + str(svnr_check(fresh)) if right else fresh)
    spanish = re.fullmatch(r"([XYZ]?)(\d{7,8})([A-Z])", bare)
    if spanish and len(bare) == 9:
        lead = "XYZ".find(spanish[1]) if spanish[1] else ""
        if dni_letter(f"{lead}{spanish[2]}") == spanish[3]:
            n = len(spanish[2])
            fresh = f"{permute(int(spanish[2]), 10**n, key, f'dni{n}'):0{n}d}"
            return _written(text, places, spanish[1] + fresh + dni_letter(f"{lead}{fresh}"))
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", bare):  # prefix and suffix follow rules and stay
        return _written(text, places, f"{bare[:2]}{permute(int(bare[2:8]), 10**6, key, 'nino'):06d}{bare[8]}")
    return permute_digits(text, key, "id" + re.sub("[A-Z]", "L", re.sub(r"\d", "D", bare)))


# Dates.

# Names of months, in the order of the year.
MONTHS = {
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
_BY_NAME: dict[str, list[tuple[str, int]]] = {}
for _lang, _names in MONTHS.items():
    for _n, _name in enumerate(_names):
        _BY_NAME.setdefault(_name.lower(), []).append((_lang, _n))
DATE = re.compile(
    r"(?<![\d/.\-])(?:(?P<d>\d\d)(?P<s>[/.\-])(?P<m>\d\d)(?P=s)(?P<y>\d{4})|(?P<iy>\d{4})-(?P<im>\d\d)-(?P<id>\d\d))(?![\d/\-])(?!\.\d)"
    r"|(?<!\d)(?P<nd>\d{1,2})(?P<o>er|\.)?(?P<a> (?:de )?)(?P<nm>%s)(?P<b> (?:de )?)(?P<ny>\d{4})(?!\d)" % "|".join(sorted(_BY_NAME, key=len, reverse=True)),
    re.I,
)
FIRST, LAST = dt.date(1900, 1, 1), dt.date(2099, 12, 31)


def permute_day(day: dt.date, key: bytes) -> dt.date:
    """A day permuted among all days from FIRST to LAST; days outside stay."""
    if not FIRST <= day <= LAST:
        return day
    return FIRST + dt.timedelta(permute((day - FIRST).days, (LAST - FIRST).days + 1, key, "date"))


def _moved(m: re.Match, key: bytes) -> str:
    try:
        if m["nm"]:
            names = _BY_NAME[m["nm"].lower()]
            day = permute_day(dt.date(int(m["ny"]), names[0][1] + 1, int(m["nd"])), key)
            name = MONTHS[names[0][0]][day.month - 1]
            name = name if m["nm"][0].islower() else name.capitalize()
            ordinal = m["o"] or ""
            if ordinal.lower() == "er" and day.day > 1:
                ordinal = ""
            return f"{day.day}{ordinal}{m['a']}{name}{m['b']}{day.year}"
        if m["iy"]:
            return permute_day(dt.date(int(m["iy"]), int(m["im"]), int(m["id"])), key).isoformat()
        day = permute_day(dt.date(int(m["y"]), int(m["m"]), int(m["d"])), key)
        return f"{day:%d}{m['s']}{day:%m}{m['s']}{day:%Y}"
    except ValueError:  # no such day
        return m.group()


def permute_date(text: str, key: bytes) -> str:
    """A date (dd/mm/yyyy with any separator, yyyy-mm-dd, or with a month's name) permuted; anything else stays."""
    m = DATE.fullmatch(text)
    return _moved(m, key) if m else text


def permute_dates(text: str, key: bytes) -> str:
    """A text with all its dates permuted, each written the way it was."""
    return DATE.sub(lambda m: _moved(m, key), text)


def label(value: str, key: bytes) -> str:
    """A short keyed name for a value without a format, the same for equal values."""
    return hashlib.blake2b(value.encode(), key=key[:64], digest_size=4).hexdigest()
