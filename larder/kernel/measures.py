"""Exact quantities: units, kinds, rationals, and the algebra of measures.

A measure is a tuple (unit, value, upper): the unit's canonical text, and one or two Fractions with value <= upper.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction
from functools import lru_cache

Measure = tuple[str, Fraction, Fraction | None]

GLYPHS = {x[0]: tuple(map(int, x[1:].split("/"))) for x in "½1/2 ⅓1/3 ⅔2/3 ¼1/4 ¾3/4 ⅕1/5 ⅖2/5 ⅗3/5 ⅘4/5 ⅙1/6 ⅚5/6 ⅐1/7 ⅛1/8 ⅜3/8 ⅝5/8 ⅞7/8 ⅑1/9 ⅒1/10".split()}
GLYPH_CLASS = "".join(GLYPHS)

_SPELLINGS = {
    "g": "g gram", "kg": "kg kilogram", "l": "l liter", "ml": "ml milliliter", "tsp": "tsp teaspoon", "tbsp": "tbsp tablespoon", "cup": "cup c",
    "quart": "quart q", "gallon": "gallon gal", "oz": "oz ounce", "lb": "lb pound", "cent": "cent", "$": "$ dollar", "kcal": "kcal calorie cal",
    "second": "second sec s", "minute": "minute min", "hour": "hour hr", "day": "day", "fahrenheit": "fahrenheit f ° °f degrees",
    "celsius": "celsius celcius °c", '"': '" inch', "whole": "whole each",
}
ALIASES = {alias: unit for unit, names in _SPELLINGS.items() for alias in names.split()} | {"fl oz": "fl oz", "fluid oz": "fl oz"}
BUILT_IN = frozenset(ALIASES.values())
KINDS = {u: k for k, us in {"weight": "g kg oz lb", "volume": "ml l tsp tbsp cup quart gallon", "money": "cent $", "time": "second minute hour day", "temperature": "fahrenheit celsius", "calories": "kcal", "length": '"'}.items() for u in us.split()} | {"fl oz": "volume", "whole": "other:whole"}
BASES = {"weight": "g", "volume": "ml", "money": "cent", "calories": "kcal", "time": "second", "temperature": "fahrenheit", "length": '"'}
TSP_ML = 4.92892
TO_BASE = {"kg": ("g", 1000.0), "oz": ("g", 28.3495), "lb": ("g", 28.3495 * 16.0), "l": ("ml", 1000.0), "tbsp": ("tsp", 3.0), "fl oz": ("tsp", 6.0), "cup": ("tsp", 48.0), "quart": ("tsp", 192.0), "gallon": ("tsp", 768.0), "$": ("cent", 100.0), "minute": ("second", 60.0), "hour": ("second", 3600.0), "day": ("second", 86400.0)}
# Steps of friendlier units for a base unit: up to which value (exclusive), the unit, the divisor.
FRIENDLY = {"tsp": [(3.0, "tsp", 1.0), (12.0, "tbsp", 3.0), (192.0, "cup", 48.0), (math.inf, "quart", 192.0)], "second": [(60.0, "second", 1.0), (3600.0, "minute", 60.0), (86400.0, "hour", 3600.0), (math.inf, "day", 86400.0)], "cent": [(math.inf, "$", 100.0)]}
NUTRIENTS = frozenset("calcium carb cholesterol fat fiber folate iron magnesium potassium protein saturated_fat selenium sodium vitamin_a vitamin_b12 vitamin_b6 vitamin_c vitamin_d vitamin_e vitamin_k zinc".split())
_NUTRIENT_PREFIX = frozenset("g iu kcal mcg mg ug µg".split())
_INT_MAX = (1 << 63) - 1


@lru_cache(1 << 14)
def singular(text: str) -> str:
    s = text.lower() if any("A" <= c <= "Z" for c in text) else text
    if s.endswith("es") and s[:-2].endswith(("ch", "sh", "ss", "x", "z")):
        return s[:-2]
    return s.removesuffix("s")


@lru_cache(1 << 14)
def unit_of(text: str) -> str:
    """The canonical unit of a spelling; an unknown one as it stands."""
    return ALIASES.get(singular(text), text)


def shown(unit: str) -> str:
    """A unit's text: canonical, or the singular of an unknown one."""
    return unit if unit in BUILT_IN else singular(unit)


@lru_cache(1 << 14)
def normal_unit(unit: str) -> str:
    if unit in BUILT_IN:
        return unit
    return ALIASES.get(singular(unit)) or singular(unit)


def is_known(text: str, addons: frozenset[str]) -> bool:
    return singular(text) in ALIASES or text.lower() in addons


def is_nutrient(text: str) -> bool:
    parts = text.split()
    return len(parts) == 2 and parts[0].lower() in _NUTRIENT_PREFIX and singular(parts[1].lower()) in NUTRIENTS


def kind_of(unit: str) -> str:
    return KINDS.get(unit) or (f"nutrient:{unit}" if is_nutrient(unit) else f"other:{unit}")


def parse_kind(text: str) -> str:
    low = text.lower()
    return low if low in BASES or low.startswith(("nutrient:", "other:")) else f"other:{text}"


def base_unit(kind: str) -> str:
    return BASES.get(kind) or kind.partition(":")[2]


def is_scalable(kind: str) -> bool:
    return kind in ("weight", "volume") or kind.startswith("other:")


@lru_cache(1 << 14)
def rational(value: float) -> Fraction:
    """The continued fraction of a double, stopped where it gives the double back."""
    if math.isnan(value):
        return Fraction(0)
    if abs(value) > _INT_MAX:
        return Fraction(_INT_MAX if value > 0 else -_INT_MAX - 1)
    v = q = abs(value)
    n0, d0, n1, d1 = 0, 1, 1, 0
    for _ in range(30):
        a = int(q)
        f = q - a
        n, d = a * n1 + n0, a * d1 + d0
        if n > _INT_MAX or d > _INT_MAX:
            break
        n0, d0, n1, d1 = n1, d1, n, d
        if abs(n1 / d1 - v) < 1e-19 or f < 1 / _INT_MAX:
            break
        q = 1 / f
    out = Fraction(n1, d1) if d1 else Fraction(0)
    return -out if value < 0 else out


def measure(unit: str, value: float, upper: float | None = None) -> Measure:
    unit = unit_of(singular(unit))
    if upper is not None and upper < value:
        value, upper = upper, value
    return unit, rational(value), None if upper is None else rational(upper)


def normalize(m: Measure) -> Measure:
    unit, value, upper = m
    if unit not in BUILT_IN:
        return singular(unit), value, upper
    if unit not in TO_BASE:
        return m
    base, factor = TO_BASE[unit]
    return base, rational(float(value) * factor), None if upper is None else rational(float(upper) * factor)


def denormalize(m: Measure) -> Measure:
    unit, value, upper = m
    for below, friendly, factor in FRIENDLY.get(unit, ()):
        if float(value) < below:
            return friendly, rational(float(value) / factor), None if upper is None else rational(float(upper) / factor)
    return m


def add(a: Measure, b: Measure) -> Measure | None:
    """The sum; a itself when b is of some other countable kind; None when the kinds don't agree."""
    if kind_of(a[0]) != kind_of(b[0]):
        return a if kind_of(b[0]).startswith("other:") else None
    (unit, low, high), (_, low2, high2) = normalize(a), normalize(b)
    upper = None if high is None and high2 is None else (low if high is None else high) + (low2 if high2 is None else high2)
    return unit, low + low2, upper


def scale(m: Measure, factor: float) -> Measure:
    if not math.isfinite(factor) or factor == 1.0 or not is_scalable(kind_of(m[0])):
        return m
    f = rational(factor)
    low, high = m[1] * f, None if m[2] is None else m[2] * f
    return (m[0], high, low) if high is not None and high < low else (m[0], low, high)


def two_decimals(v: float) -> str:
    return f"{v:.2f}".rstrip("0").rstrip(".")


def glyph_for(part: float, within: float = 1e-6) -> str | None:
    return next((g for g, (n, d) in GLYPHS.items() if abs(part - n / d) < within), None)


def format_quantity(v: float) -> str:
    whole = math.trunc(abs(v))
    glyph = glyph_for(abs(v) - whole)
    return f"{'-' if v < 0 else ''}{whole or ''}{glyph}" if glyph else two_decimals(v)


def format_quantity_ascii(v: float) -> str:
    if v == 0:
        return "0"
    r = rational(v)
    if r.denominator <= 64 and abs(float(r) - v) < 1e-6:
        whole, rest = divmod(abs(r.numerator), r.denominator)
        sign = "-" if v < 0 else ""
        if r.denominator == 1:
            return f"{sign}{whole}"
        return f"{sign}{whole} {rest}/{r.denominator}" if whole else f"{sign}{rest}/{r.denominator}"
    return f"{v:.4f}".rstrip("0").rstrip(".")


def fraction_text(r: Fraction | None) -> str | None:
    """Exact text of a value that no short decimal states and whose denominator a cook would use."""
    if r is None or r.denominator == 1 or r.denominator > 128:
        return None
    d = r.denominator
    for p in (2, 5):
        while d % p == 0:
            d //= p
    if d == 1:
        return None
    whole, rest = divmod(abs(r.numerator), r.denominator)
    return f"{'-' if r < 0 else ''}{whole} {rest}/{r.denominator}" if whole else f"{r.numerator}/{r.denominator}"


def parse_fraction(text: str) -> Fraction:
    """"2/3", "1 2/3" or "4"; ValueError for anything else."""
    m = re.fullmatch(r"\s*(?:([+-]?\d+)\s+)?([+-]?\d+)(?:/([+-]?\d+))?\s*", text)
    if not m or (m[1] and not m[3]) or (m[3] and int(m[3]) == 0):
        raise ValueError(f"no exact amount: {text!r}")
    part = Fraction(int(m[2]), int(m[3] or 1))
    whole = int(m[1] or 0)
    return whole - part if whole < 0 else whole + part


def unit_label(m: Measure) -> str:
    base = singular(shown(m[0]))
    many = m[0] in ("cup", "second", "minute", "hour", "day") and (m[1] > 1 or (m[2] or 0) > 1)
    return base + "s" if many else base


def display(m: Measure) -> str:
    m = denormalize(m)
    value, upper = float(m[1]), float(m[2]) if m[2] else 0.0
    write = (lambda v: f"${two_decimals(v)}") if m[0] == "$" else format_quantity
    body = write(value) if not upper else write(upper) if value == 0 else f"{write(value)} - {write(upper)}"
    return body if m[0] in ("$", "whole") else f"{body} {unit_label(m)}"
