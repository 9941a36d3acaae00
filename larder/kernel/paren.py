"""What a parenthesis holds."""

from __future__ import annotations

import re

from larder.kernel import vocab
from larder.kernel.grammar import Abort, closing, measures
from larder.kernel.measures import GLYPH_CLASS
from larder.kernel.normalize import CROSS_REF, NOTE_REF, without_minus

_LETTERS = re.compile(r"[^\W\d_]+")
_NUMBERED = re.compile(rf"[0-9{GLYPH_CLASS}][\s/-]*\Z")
_NUMERIC = re.compile(f"[0-9{GLYPH_CLASS}]")
_ROUGHLY = re.compile(r"(?:about|approximately|roughly|around|from) ", re.I)


def is_descriptive(inner: str) -> bool:
    """A temperature or a distance; "in" and "m" count as one only beside a number."""
    if "°" in inner:
        return True
    return any(vocab.is_distance(m[0]) and (m[0].lower() not in ("in", "m") or bool(_NUMBERED.search(inner[: m.start()]))) for m in _LETTERS.finditer(inner))


def is_short_rest(rest: str) -> bool:
    rest = rest.strip()
    return not rest or rest.isalpha()


def is_amount(inner: str, addons: frozenset[str]) -> bool:
    text = inner.strip()
    if m := _ROUGHLY.match(text):
        text = text[m.end() :].lstrip()
    try:
        got = measures(text, addons)
    except Abort:
        return False
    return bool(got and got[1]) and is_short_rest(got[0])


def is_alias(inner: str) -> bool:
    return bool(inner.strip()) and not _NUMERIC.search(inner)


def classify(inner: str, addons: frozenset[str] | None = vocab.ADDON_UNITS) -> str:
    wrapped = f"({inner})"
    for kind, pattern in (("cross_reference", CROSS_REF), ("note_reference", NOTE_REF)):
        if (m := pattern.search(wrapped)) and m[0].strip() == wrapped:
            return kind
    if without_minus(wrapped) != wrapped:
        return "minus_equivalence"
    if inner.strip().lower() == "optional":
        return "optional"
    if is_descriptive(inner):
        return "descriptive"
    if addons is not None and is_amount(inner, addons):
        return "amount"
    return "alias" if is_alias(inner) else "other"


def spans(s: str) -> list[tuple[int, int, str]]:
    """(start, end, inside) of each top-level pair, left to right."""
    out, at = [], 0
    while (open_ := s.find("(", at)) >= 0 and (end := closing(s, open_)) is not None:
        out.append((open_, end + 1, s[open_ + 1 : end]))
        at = end + 1
    return out
