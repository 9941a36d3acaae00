"""The measurement grammar: ordered attempts over one string, each giving where it ends and what it found, or None.

`Abort` stands for input on which the line as a whole gives up: a number whose exponent has no digits, or lists that are nested
more than `DEPTH` deep.
"""

from __future__ import annotations

import re

from larder.kernel import vocab
from larder.kernel.measures import GLYPHS, GLYPH_CLASS, Measure, add, is_known, measure, normal_unit, unit_of

_FLOAT = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)")
_EXPONENT = re.compile(r"[eE](?:[+-]?[0-9]+)?")
_AND = re.compile(r"[ \t]+and[ \t]+", re.I)
_S0, _S1 = re.compile(r"[ \t]*"), re.compile(r"[ \t]+")
_WORD_NUMBER = re.compile(rf"(?:({'|'.join(vocab.NUMBER_WORDS)})(?=\s|\Z)|an? )", re.I)
_THOUSANDS = re.compile(r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?")
_RANGE = re.compile(r"[ \t]*[-–][ \t]*|[-–][ \t]+(?:to|through)[ \t]+|[ \t]+(?:to|through|or)[ \t]+")
_RANGE_FORMS = [re.compile(x) for x in (r"[ \t]*[-–][ \t]*", r"[-–][ \t]+(?:to|through)[ \t]+", r"[ \t]+(?:to|through|or)[ \t]+")]
_AT_MOST = re.compile(r"(?:up to|at most)[ \t]*")
_UNIT_TEXT = re.compile(r'[A-Za-z°"]*')
_FLUID = re.compile(r"fluid ounces|fluid ounce|fluid oz|fl\. oz\.|fl oz", re.I)
_SPOON = re.compile(r"([tT])(?=[\s.]|\Z)")
_SHAPES = "generous|scant|heaping|heaped|rounded|brimming"
LEAD = re.compile(rf"(?:an? )?(?:less than|about|approximately|approx|roughly|around|{_SHAPES}|healthy|good)[ \t]+", re.I)
_SHAPE = re.compile(rf"(?:{_SHAPES})[ \t]+", re.I)
_END = re.compile(r"\. |\.| of")
_DASH = re.compile(r"[—–] ?")
_ARTICLE = re.compile(r"an? ", re.I)
_TIMES = re.compile(r"[ \t]+x[ \t]+")
_PLUS = re.compile(r"[ \t]+(?:plus|\+)[ \t]+")
_TO = re.compile(r"[ \t]+(?:to|through|–|-)[ \t]+")
_SEPARATOR = re.compile(r"; | / | /|/ | \| | × |× |/|, | ")
_HYPHENED = re.compile(r"-([^\W\d_]+)")
_STEP = re.compile(r"\s*(?=[A-Z])([^\W\d_]+)")
_STARTS = re.compile(rf"[0-9{GLYPH_CLASS}]")


_PLUS_SIGN, _TO_SIGN, _RANGE_SIGN = re.compile(r"plus|\+"), re.compile(r"to|through|[–-]"), re.compile(r"to|through|or|[–-]")
DEPTH = 200


_PAREN, _WORD = re.compile(r"[()]"), re.compile(r"\S*")


class Abort(Exception):
    pass


class TooDeep(Abort):
    pass


def closing(s: str, at: int = 0) -> int | None:
    """Where the group that the first "(" from `at` opens is closed."""
    start = s.find("(", at)
    depth = 0
    for m in _PAREN.finditer(s, start) if start >= 0 else ():
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            return m.start()
    return None


class Grammar:
    """Attempts over one string; numbers and single measures are remembered by place, as many attempts begin with them."""

    __slots__ = ("s", "addons", "prose", "depth", "_numbers", "_singles", "_signs")

    def __init__(self, s: str, addons: frozenset[str] = vocab.ADDON_UNITS, prose: bool = False, depth: int = 0):
        self.s, self.addons, self.prose, self.depth = s, addons, prose, depth
        self._signs: tuple[bool, bool, bool] | None = None
        self._numbers: dict[int, tuple[int, float] | None] = {}
        self._singles: dict[int, tuple[int, Measure] | None] = {}

    # numbers

    def double(self, i: int) -> tuple[int, float] | None:
        m = _FLOAT.match(self.s, i)
        if not m:
            return None
        end = m.end()
        e = _EXPONENT.match(self.s, end)
        if e:
            if len(e[0]) == 1:
                raise Abort
            end = e.end()
        v = float(self.s[i:end])
        return (end, v) if abs(v) != float("inf") else None

    def fraction(self, i: int) -> tuple[int, float] | None:
        s = self.s
        lead = self.double(i)
        at, whole = lead or (i, 0.0)
        gap = (_AND.match(s, at) or _S0.match(s, at)).end() if lead else at
        if gap < len(s) and (g := GLYPHS.get(s[gap])):
            return gap + 1, whole + g[0] / g[1]
        if not lead:
            return None
        wide = _AND.match(s, at) or _S1.match(s, at)
        if not wide:
            return self._slashed(lead, 0.0)
        top = self.double(wide.end())
        return self._slashed(top, whole) if top else None

    def _slashed(self, top: tuple[int, float], whole: float) -> tuple[int, float] | None:
        if self.s[top[0] : top[0] + 1] != "/":
            return None
        below = self.double(top[0] + 1)
        return (below[0], whole + top[1] / below[1]) if below and below[1] != 0 else None

    def number(self, i: int) -> tuple[int, float] | None:
        if i not in self._numbers:
            self._numbers[i] = self._number(i)
        return self._numbers[i]

    def _number(self, i: int) -> tuple[int, float] | None:
        s = self.s
        if got := self.fraction(i):
            return got
        if not self.prose and (m := _WORD_NUMBER.match(s, i)):
            return m.end(), vocab.NUMBER_WORDS[m[1].lower()] if m[1] else 1.0
        if m := _THOUSANDS.match(s, i):
            return m.end(), float(m[0].replace(",", ""))
        got = self.double(i)
        if got and self.prose and s[got[0] - 1] == ".":
            return got[0] - 1, got[1]
        return got

    def range_end(self, i: int) -> tuple[int, float] | None:
        if not _RANGE.match(self.s, i):
            return None
        for form in _RANGE_FORMS:
            if (m := form.match(self.s, i)) and (n := self.number(m.end())):
                return n
        return None

    def value(self, i: int) -> tuple[int, float, float | None] | None:
        if (m := _AT_MOST.match(self.s, i)) and (n := self.number(m.end())):
            return n[0], 0.0, n[1]
        n = self.number(i)
        if not n:
            return None
        upper = self.range_end(n[0])
        return (upper[0], n[1], upper[1]) if upper else (*n, None)

    # units

    def unit(self, i: int) -> tuple[int, str] | None:
        s = self.s
        c = s[i : i + 1]
        if c in "fF" and (m := _FLUID.match(s, i)):
            return m.end(), "fl oz"
        if c in "tT" and (m := _SPOON.match(s, i)):
            return m.end(), "tsp" if m[1] == "t" else "tbsp"
        m = _UNIT_TEXT.match(s, i)
        return (m.end(), m[0]) if m[0] and is_known(m[0], self.addons) else None

    def _size_word(self, i: int) -> int | None:
        """Past a size word and its space, where a unit follows that takes one."""
        m = _UNIT_TEXT.match(self.s, i)
        if m[0].lower() not in vocab.SIZE_WORDS or not (gap := _S1.match(self.s, m.end())):
            return None
        return gap.end() if _UNIT_TEXT.match(self.s, gap.end())[0].lower() in vocab.SIZED_UNITS else None

    def _hyphened(self, i: int) -> tuple[int, str] | None:
        m = _HYPHENED.match(self.s, i)
        return (m.end(), m[1].lower()) if m and (vocab.is_distance(m[1]) or is_known(m[1], self.addons)) else None

    def _past_paren(self, i: int) -> tuple[int, str] | None:
        s = self.s
        while i < len(s) and s[i].isspace():
            i += 1
        if s[i : i + 1] != "(" or (end := closing(s, i)) is None:
            return None
        end += 1
        while end < len(s) and s[end].isspace():
            end += 1
        got = self.unit(end)
        if not got:
            return None
        end = got[0]
        end += 1 if s.startswith(".", end) else 3 if s.startswith(" of", end) else 0
        return end, got[1].lower()

    # measures

    def single(self, i: int) -> tuple[int, Measure] | None:
        if i not in self._singles:
            self._singles[i] = self._single(i)
        return self._singles[i]

    def _single(self, i: int) -> tuple[int, Measure] | None:
        s, times = self.s, None
        if m := LEAD.match(s, i):
            i = m.end()
        n = self.number(i)
        if n and (m := _TIMES.match(s, n[0])):
            times, i = n[1], m.end()
        got = self.value(i)
        if not got:
            return None
        at, low, high = got
        if times is not None:
            low, high = low * times, None if high is None else high * times
        at = _S0.match(s, at).end()
        for optional in (_DASH, _ARTICLE):
            if m := optional.match(s, at):
                at = m.end()
        if m := _SHAPE.match(s, at):
            at = m.end()
        elif (past := self._size_word(at)) is not None:
            at = past
        unit = self.unit(at)
        if unit:
            at = unit[0]
        end = _END.match(s, at)
        if end:
            at = end.end()
        if unit:
            return at, measure(unit[1].lower(), low, high)
        if not (found := self._past_paren(at)):
            if self.prose and not end and (m := _STEP.match(s, at)) and len(m[1].encode()) >= 2:
                return None
            found = self._hyphened(at)
        at, name = found or (at, "whole")
        return at, measure(name, low, high)

    def plus(self, i: int) -> tuple[int, list[Measure]] | None:
        a = self.single(i)
        if not a or not (m := _PLUS.match(self.s, a[0])) or not (b := self.single(m.end())):
            return None
        both = add(a[1], b[1])
        return b[0], [a[1], b[1]] if both is None else [both]

    def cross_range(self, i: int) -> tuple[int, list[Measure]] | None:
        s = self.s
        if not (n := self.number(i)) or not (u := self.unit(_S0.match(s, n[0]).end())) or not (m := _TO.match(s, u[0])):
            return None
        if not (n2 := self.number(m.end())) or not (gap := _S1.match(s, n2[0])) or not (u2 := self.unit(gap.end())):
            return None
        end = _END.match(s, u2[0])
        at = end.end() if end else u2[0]
        if same_unit(u[1], u2[1]):
            return at, [measure(u[1].lower(), n[1], n2[1])]
        return at, [measure(u[1].lower(), n[1]), measure(u2[1].lower(), n2[1])]

    def unit_range(self, i: int) -> tuple[int, list[Measure]] | None:
        s = self.s
        if m := LEAD.match(s, i):
            i = m.end()
        if not (v := self.value(i)):
            return None
        at = _S0.match(s, v[0]).end()
        u = self.unit(at)
        if not (high := self.range_end(u[0] if u else at)):
            return None
        at = high[0]
        u2 = self.unit(at)
        if u2:
            at = u2[0]
        if end := _END.match(s, at):
            at = end.end()
        if u2 and (not u or not same_unit(u[1], u2[1])):
            return at, []  # the units disagree: read past, and nothing measured
        return at, [measure(u[1].lower() if u else "whole", v[1], high[1])]

    def counted_size(self, i: int) -> tuple[str, list[Measure]] | None:
        """A count, a size and a container; gives what is left as a string, as the container may be the last word of all."""
        s = self.s
        try:
            got = self.value(i)
        except Abort:
            return None
        if not got:
            return None
        at = _S0.match(s, got[0]).end()
        c = s[at : at + 1]
        if c == "(":
            if (end := closing(s, at)) is None:
                return None
            inner, after = s[at + 1 : end], s[end + 1 :].lstrip()
        elif c == "-" or (c and _STARTS.match(c)):
            inner = _WORD.match(s, at)[0]
            if "-" not in inner:
                return None
            after = s[at + len(inner) :].lstrip()
        else:
            return None
        first, _, rest = _cut(after)
        if first.lower() in vocab.CONTAINERS:
            container, rest = first.lower(), rest.removeprefix("of ")
        else:
            last = re.search(r"\S*\Z", after)[0]
            container, rest = (last.lower(), after[: len(after) - len(last)].rstrip()) if last.lower() in vocab.CONTAINERS else ("whole", after)
        try:
            sizes = measures(inner.replace("-", " "), self.addons, self.prose, self.depth + 1)
        except TooDeep:
            raise
        except Abort:
            return None
        if not sizes or sizes[0].strip() or not sizes[1]:
            return None
        return rest, [measure(container, got[1], got[2]), *sizes[1]]

    def enclosed(self, i: int, pair: str) -> tuple[str, list[Measure]] | None:
        if self.s[i : i + 1] != pair[0]:
            return None
        self.depth += 1
        try:
            got = self.read(i + 1)
        finally:
            self.depth -= 1
        if not got:
            return None
        rest, found = got[0].s[got[1] :], got[2]
        if rest[:1] == pair[1]:
            return rest[1:], found
        if (gap := _S1.match(rest)) and (end := rest.find(pair[1], gap.end())) >= 0 and not re.search("[0-9]", rest[gap.end() : end]):
            return rest[end + 1 :], found
        return None

    def unit_only(self, i: int) -> tuple[int, list[Measure]] | None:
        if self.prose:
            return None
        s = self.s
        if m := LEAD.match(s, i):
            i = m.end()
        elif (past := self._size_word(i)) is not None:
            i = past
        m = _UNIT_TEXT.match(s, _S0.match(s, i).end())
        if not m[0] or m[0].lower() not in self.addons:
            return None
        at = end.end() if (end := _END.match(s, m.end())) else m.end()
        gap = _S1.match(s, at)
        return (gap.end(), [measure(m[0].lower(), 1.0)]) if gap else None

    def _look(self) -> tuple[bool, bool, bool]:
        self._signs = tuple(bool(p.search(self.s)) for p in (_PLUS_SIGN, _TO_SIGN, _RANGE_SIGN))
        return self._signs

    def item(self, i: int) -> tuple[int | str, list[Measure]] | None:
        one = self.single(i)
        plus, to, ranged = self._signs or self._look()  # what those forms can't do without
        got = (plus and self.plus(i)) or (to and self.cross_range(i)) or (ranged and self.unit_range(i)) or self.counted_size(i) or self.enclosed(i, "()")
        if got:
            return got
        return (one[0], [one[1]]) if one else self.unit_only(i)

    def read(self, i: int) -> tuple[Grammar, int, list[Measure]] | None:
        """All measures of one list, and where what is left begins: in this grammar, unless a container at the end was read first."""
        if self.depth > DEPTH:
            raise TooDeep
        g, at, out = self, i, []
        got = g.item(at)
        if not got:
            return None
        while True:
            end, found = got
            out += found
            g, at = (g, end) if isinstance(end, int) else (Grammar(end, g.addons, g.prose, g.depth), 0)
            m = _SEPARATOR.match(g.s, at)
            got = g.item(m.end()) if m else None
            if not got:
                return g, at, out


def _cut(s: str) -> tuple[str, str, str]:
    """The first word, and what follows it without leading space."""
    m = re.match(r"\S*", s)
    return m[0], " ", s[m.end() :].lstrip()


def same_unit(a: str, b: str) -> bool:
    return normal_unit(unit_of(a)) == normal_unit(unit_of(b))


def measures(s: str, addons: frozenset[str] = vocab.ADDON_UNITS, prose: bool = False, depth: int = 0) -> tuple[str, list[Measure]] | None:
    got = Grammar(s, addons, prose, depth).read(0)
    return (got[0].s[got[1] :], got[2]) if got else None


def parse_amount(s: str, addons: frozenset[str] = vocab.ADDON_UNITS) -> list[Measure] | None:
    """The measures at the start of a text; what follows them is let go. None where there is none."""
    try:
        got = measures(s, addons)
    except Abort:
        return None
    return got[1] if got else None


def parse_amount_string(text: str) -> Measure:
    """"4 lb", "$5", "120g"; ValueError says what is wrong."""
    text = text.strip()
    if not text:
        raise ValueError("empty amount")
    g = Grammar(text.removeprefix("$").strip() if text[0] == "$" else text)
    try:
        m = _THOUSANDS.match(g.s)
        n = g.fraction(0) or ((m.end(), float(m[0].replace(",", ""))) if m else g.double(0))
    except Abort:
        n = None
    if not n:
        raise ValueError(f"no number in {text!r}")
    if text[0] == "$":
        return measure("dollar", n[1])
    unit = _UNIT_TEXT.match(g.s[n[0] :].strip())[0]
    if not unit:
        raise ValueError(f"no unit in {text!r}")
    return measure(unit, n[1])


def parse_mapping(text: str) -> tuple[Measure, Measure, str | None]:
    """"4 lb = $5", "$5/4lb", either with " @ source"; ValueError says what is wrong."""
    text, source = text.strip(), None
    head, at, tail = text.rpartition(" @ ")
    if at and tail.strip():
        text, source = head.strip(), tail.strip()
    left, eq, right = text.partition("=")
    if eq:
        return parse_amount_string(left), parse_amount_string(right), source
    if text.startswith("$") and "/" in text:
        price, _, amount = text.partition("/")
        return parse_amount_string(amount), parse_amount_string(price), source
    raise ValueError("a mapping reads '4 lb = $5' or '$5/4lb'")
