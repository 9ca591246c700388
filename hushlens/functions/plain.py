"""The text functions on plain Python strings, for the lexicon on the driver and as the definition the Column versions are tested against."""

from __future__ import annotations

import re
import unicodedata

# Characters united before anything else.
APOSTROPHES = "’`´ʼ"
DASHES = "–—‐‑"
# Word endings, tried in this order.
SUFFIXES = (
    "issements", "issement", "atrices", "atrice", "ations", "ation", "utions", "ution", "ances", "ance", "ences", "ence", "ements", "ement", "ateurs",
    "ateur", "euses", "euse", "eaux", "eau", "iques", "ique", "istes", "iste", "ismes", "isme", "ables", "able", "ment", "ments", "tion", "tions",
    "ites", "ite", "ante", "ants", "ant", "tes", "te", "ses", "se", "ees", "ee", "es", "s", "e",
)
ROOT_LENGTH = 6

_UNITE = str.maketrans({**dict.fromkeys(APOSTROPHES, "'"), **dict.fromkeys(DASHES, "-")})
_OTHER = re.compile(r"[^a-z0-9\s'-]+")


def fold(text: str) -> str:
    """Compatibility form without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def normalize(text: str | None) -> str:
    """Lower case, no accents, only a-z, 0-9, blank, apostrophe and hyphen, single blanks."""
    return " ".join(_OTHER.sub(" ", fold((text or "").translate(_UNITE).lower())).split())


def tokens(norm: str) -> list[str]:
    return re.findall(r"[a-z0-9']+", norm)


def root(token: str) -> str:
    """The word without the first fitting ending that leaves at least 4 letters, at most 6 letters long."""
    word = token.strip("'")
    if len(word) <= 4:
        return word
    for suffix in SUFFIXES:
        if len(word) - len(suffix) > 3 and word.endswith(suffix):
            return word.removesuffix(suffix)[:ROOT_LENGTH]
    return word[:ROOT_LENGTH]


def sentences(text: str) -> list[str]:
    """Non-blank pieces between blanks that follow . ! ? ; or a line break."""
    return [s for s in (p.strip() for p in re.split(r"(?<=[.!?\n;])\s+", text)) if s]


def spans(text: str) -> list[tuple[int, int]]:
    """Where the sentences stand in the text."""
    out, at = [], 0
    for s in sentences(text):
        start = text.index(s, at)
        at = start + len(s)
        out.append((start, at))
    return out
