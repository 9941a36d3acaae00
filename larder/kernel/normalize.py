"""Ordered rewrites of a raw line. The order is part of the result."""

from __future__ import annotations

import re

from larder.kernel import vocab
from larder.kernel.measures import GLYPH_CLASS

_SEE, _GAP, _INSIDE = r"(?:see\s+)?", r"[\s,;]*", r"[^)]*"
_PAGE = _SEE + r"(?:page\s+\d+|this page)"
_PAGES = rf"\(\s*{_PAGE}(?:{_GAP}(?:and|or|to)?{_GAP}{_PAGE})*+"
CROSS_REF = re.compile(rf"\s*{_PAGES}\s*\)", re.I)
_CROSS_OPTIONAL = re.compile(rf"{_PAGES}[\s,;]+optional\s*\)", re.I)
NOTE_REF = re.compile(rf"\s*\(\s*{_SEE}notes?\s*\)", re.I)
_MINUS = re.compile(r"\bminus\b")
_MARKS = r"①-⒛⓪⓵-⓿❶-➓"
_BULLET = re.compile(r"\A\s*[*·•∙–—-]\s+")
_FOOTNOTES = re.compile(f"[{_MARKS}]")
_TRAILING = re.compile(r"(?:(?<!\s)\s+|(?<![*†‡\s]))[*†‡]++\s*\Z")
_AMOUNT = r"\d¼-¾⅐-⅞"
_BATCH = re.compile(rf"\A(\s*[{_AMOUNT}][{_AMOUNT}\s./-]*\s+)batch(?:es)?\s+of\s+", re.I)
_THE = re.compile(rf"\Athe\s+(?=[0-9{GLYPH_CLASS}])", re.I)
_TOTAL = re.compile(rf"\((?P<size>[{GLYPH_CLASS}0-9]{_INSIDE}?)(?:\s+in)?\s+total\)", re.I)
_NUMERIC = re.compile(f"[0-9{GLYPH_CLASS}]")
_COUNT = re.compile(rf"[0-9./{GLYPH_CLASS}]+")
_OPTIONAL, _LAST_OPTIONAL = re.compile(r"\s*\(optional\)", re.I), re.compile(r",?\s+optional\s*\Z", re.I)
_SHAPES = frozenset(("deep", "long", "tall", "thick", "wide"))


def without_minus(s: str) -> str:
    """The text without each group that says minus, and without the space before it; groups end at the first ")"."""
    out = []
    *closed, tail = s.split(")")
    for part in closed:
        i = part.find("(")
        out.append(part[:i].rstrip() if i >= 0 and _MINUS.search(part, i) else part + ")")
    return "".join(out) + tail


def _minus(s: str) -> str:
    t = without_minus(s) if "minus" in s else s
    return t if t != s and _NUMERIC.search(t) else s


def _dimension(s: str) -> str:
    w = s.split()
    if len(w) < 3 or not (w[0].lower() in vocab.SPELLED_COUNTS or _COUNT.fullmatch(w[0])):
        return s
    d = w[1].lstrip("(").rstrip(")")
    if "-" not in d or not _NUMERIC.match(d) or d.rpartition("-")[2].lower() not in _SHAPES:
        return s
    return f"{w[0]} {' '.join(w[2:])}, {d}"


def _piece_dimension(s: str) -> str:
    w = s.split()
    if len(w) < 3 or "-" not in w[0] or not _NUMERIC.match(w[0]) or not vocab.is_distance(w[0].rpartition("-")[2]):
        return s
    if w[1].lower() not in vocab.CONTAINERS or w[2][0] != "(" or not _NUMERIC.match(w[2], 1):
        return s
    return f"1 {w[1]} {' '.join(w[2:])}, {w[0]}"


REWRITES = [
    ("strip_nbsp", lambda s: s.replace("\xa0", " ")),
    ("strip_leading_bullet", lambda s: _BULLET.sub("", s)),
    ("strip_footnote_markers", lambda s: _FOOTNOTES.sub("", s)),
    ("strip_trailing_footnote_markers", lambda s: _TRAILING.sub("", s)),
    ("split_crossref_optional", lambda s: _CROSS_OPTIONAL.sub("(optional)", s) if "(" in s else s),
    ("strip_cross_reference", lambda s: CROSS_REF.sub("", s) if "(" in s else s),
    ("strip_note_reference", lambda s: NOTE_REF.sub("", s) if "(" in s else s),
    ("rewrite_batch_of_to_recipe", lambda s: _BATCH.sub(r"\1recipe ", s)),
    ("strip_leading_determiner", lambda s: _THE.sub("", s)),
    ("strip_minus_equivalence", lambda s: _minus(s) if "(" in s else s),
    ("strip_total_in_measure_paren", lambda s: _TOTAL.sub(r"(\g<size>)", s) if "(" in s else s),
    ("lift_leading_dimension", _dimension),
    ("lift_leading_piece_dimension", _piece_dimension),
]


class Step(str):
    """The name of a pass that left a mark, with what it took and made."""

    before: str
    after: str

    @classmethod
    def of(cls, name: str, before: str, after: str) -> Step:
        made = cls(name)
        made.before, made.after = before, after
        return made


def collapse(s: str) -> str:
    return " ".join(s.split())


def normalize(s: str, log: list[str] | None = None) -> str:
    for name, run in REWRITES:
        t = run(s)
        if t != s:
            if log is not None:
                log.append(Step.of(name, s, t))
            s = t
    return collapse(s) if "  " in s or s[:1] == " " or s[-1:] == " " else s


def strip_optional(s: str) -> tuple[str, bool]:
    if s.strip().lower() == "(optional)":
        return s, False
    t = _LAST_OPTIONAL.sub("", _OPTIONAL.sub("", s))
    return t, t != s
