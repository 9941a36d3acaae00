"""One ingredient line to its parts: name, amounts, modifier, optional, usage and notes on how sure the reading is."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from larder.kernel import paren, vocab
from larder.kernel.grammar import Abort, Grammar, closing, measures
from larder.kernel.measures import GLYPH_CLASS, Measure, display, measure
from larder.kernel.normalize import REWRITES, Step, collapse, normalize, strip_optional

_NAME = re.compile(r"(?:[^\W_]|[\s\-—'’./\\])*")
_SPLIT = re.compile(r"[(),;]")
_NUMERIC = re.compile(f"[0-9{GLYPH_CLASS}]")
_A_NUMBER = re.compile(rf"[0-9{GLYPH_CLASS}]|an? |(?:{'|'.join(vocab.NUMBER_WORDS)})(?=\s|\Z)", re.I)
_EDGES = re.compile(r"\A[\W_]+|[\W_]+\Z")
_MINUS = re.compile(r"[mM]inus ")
_OR, _AND_OR, _FOR = (re.compile(rf"\s+{w}\s+", re.I) for w in ("or", "and/or", "for"))
_OR_AMOUNT = re.compile(rf"\s+or\s+(?:\d|[{GLYPH_CLASS}]|an?\s)", re.I)
_FROM, _NEARLY = r"(?:from\s+)?", "|".join(("about", "around", "approximately", "roughly"))
_ABOUT_PAREN = re.compile(rf"\({_FROM}(?:{_NEARLY})\s+(?P<size>[^)]+)\)")
_LAST_PAREN = re.compile(r"\((?P<size>[^)]+)\)\s*\Z")
_LONGEST_FIRST = sorted(vocab.ADJECTIVES, key=lambda a: (-len(a), a))
_ANY_ADJECTIVE = re.compile("|".join(map(re.escape, _LONGEST_FIRST)))
RAW, PREP, ALTERNATIVE = "raw", "prep", "alternative"


@dataclass
class Draft:
    """A line while it is taken apart; the modifier is a list of (kind, text)."""

    name: str
    amounts: list[Measure] = field(default_factory=list)
    parts: list[tuple[str, str]] = field(default_factory=list)

    def push(self, kind: str, text: str) -> None:
        if text.strip():
            self.parts.append((kind, text))

    def modifier(self) -> str | None:
        out = ""
        for _, text in self.parts:
            text = text.strip().lstrip(",").strip()
            if text:
                out += (" " if text[0] == "(" else ", ") * bool(out) + text
        return out or None

    def text(self) -> str:
        mod = self.modifier()
        return f"{self.name}, {mod}" if mod else self.name

    def state(self):
        return self.name, list(self.amounts), list(self.parts)


def norm(word: str) -> str:
    return _EDGES.sub("", word).lower()


def is_prep(word: str) -> bool:
    w = norm(word)
    if w.endswith(("ed", "ly", "less")) or w in vocab.INTENSIFIERS:
        return True
    _, dash, tail = w.rpartition("-")
    return bool(dash) and tail in ("in", "on", "out", "off", "free", "style")


def _joins(word: str) -> bool:
    return norm(word) == "and" or word == "&"


def _gerund(word: str) -> bool:
    return len(word.encode()) >= 5 and word.endswith("ing") and word.isalpha()


def _aligned(s: str) -> str | None:
    """Lower case where that keeps every place, else None."""
    low = s.lower()
    return low if len(low) == len(s) and (low.isascii() or len(low.encode()) == len(s.encode())) else None


# clauses


def is_prep_chain(text: str) -> bool:
    w = text.split()
    return bool(w) and not _joins(w[0]) and not _joins(w[-1]) and all(is_prep(x) or _joins(x) for x in w)


def _minus_rest(text: str, addons: frozenset[str]):
    m = _MINUS.match(text)
    if not m:
        return None
    try:
        got = measures(text[m.end() :], addons)
    except Abort:
        return None
    return (text[m.end() :], *got) if got and got[1] else None


def classify(text: str, addons: frozenset[str] = vocab.ADDON_UNITS) -> str:
    w = text.split()
    first = w[0] if w else ""
    if is_prep_chain(text):
        return "prep_chain"
    if text.strip().lower() in vocab.ADJECTIVES:
        return "known_prep_phrase"
    if _minus_rest(text.lstrip(), addons):
        return "minus_measure"
    if first.lower() == "for" and len(w) > 1 and (_gerund(w[1]) or w[1].lower() == "the"):
        return "purpose"
    if first.lower() in ("or", "and/or"):
        return "alternative"
    return "prose" if norm(first) in vocab.STOPWORDS else "head_candidate"


def clauses(s: str) -> list[tuple[int, int, str]]:
    """(start, end, separator before) of the parts between ", " and "; " outside parentheses."""
    out, depth, start, before = [], 0, 0, ""
    for m in _SPLIT.finditer(s):
        c, i = m[0], m.start()
        if c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif depth == 0 and s[i + 1 : i + 2] == " ":
            out.append((start, i, before))
            start, before = i + 2, s[i : i + 2]
    return [*out, (start, len(s), before)]


def explain_clauses(s: str, addons: frozenset[str] = vocab.ADDON_UNITS) -> list[dict]:
    out = []
    for a, b, sep in clauses(s):
        inside, stripped, at = paren.spans(s[a:b]), "", a
        for x, y, _ in inside:
            stripped, at = stripped + s[at : a + x], a + y
        stripped = collapse(stripped + s[at:b])
        out.append({"start": a, "end": b, "sep": sep, "kind": classify(stripped, addons), "parens": [paren.classify(t, addons) for _, _, t in inside], "stripped": stripped})
    return out


def _tail_parts(s: str, start: int) -> list[str]:
    """The tail cut at the ", " at which joining the parts again gives the same text."""
    out: list[list[int]] = []
    for a, b, sep in clauses(s):
        if b <= start:
            continue
        if not out:
            out.append([start, b])
        elif sep == ", " and a < b and not s[a].isspace() and s[a] not in "(," and not s[a - 3 : a - 2].isspace():
            out.append([a, b])
        else:
            out[-1][1] = b
    return [s[a:b] for a, b in out if s[a:b].strip()]


def draft(s: str, addons: frozenset[str]) -> tuple[Draft, str, int, tuple[int, int] | None]:
    """The line as the grammar and its clauses give it, before repairs: with what the amounts left, the name's end, and a hoisted span."""
    amounts: list[Measure] = []
    rest = s
    if got := measures(rest, addons):
        rest, amounts = got[0], list(got[1])
    rest = rest.lstrip(" \t")
    if got := Grammar(rest, addons).enclosed(0, "[]"):
        rest = got[0]
        amounts += got[1]
    rest = rest.lstrip(" \t")
    end = at = _NAME.match(rest).end()
    hoisted = None
    if rest[at : at + 1] == "(" and (got := Grammar(rest, addons).enclosed(at, "()")):
        hoisted = (at, len(rest) - len(got[0]))
        amounts += got[1]
        at = hoisted[1]
    if rest.startswith(", ", at):
        at += 2
    name, tail = rest[:end].strip(), rest[at:]
    whole = tail.lstrip().startswith("(") or (bool(name) and is_prep_chain(name))
    parts = ([tail] if tail.strip() else []) if whole else _tail_parts(rest, at)
    return Draft(name, amounts, [(RAW, p) for p in parts]), rest, end, hoisted


# repairs of the assembly


def _leading_prep_phrase(d: Draft, addons) -> None:
    name = d.name.strip()
    if name.lower() in vocab.ADJECTIVES and (mod := d.modifier()) is not None:
        d.name, d.parts = mod, [(PREP, name)]


def _leading_minus(d: Draft, addons) -> None:
    got = _minus_rest(d.name, addons)
    if got and got[1].strip():
        text, rest, _ = got
        d.name = rest.strip()
        d.parts.insert(0, (RAW, f"minus {text[: len(text) - len(rest)].strip()}"))


def _head_noun(d: Draft, addons) -> None:
    if not d.name.strip() or not all(map(is_prep, d.name.split())) or not d.parts or d.parts[0][0] != RAW:
        return
    text = d.parts[0][1]
    head = next((m.start() for m in re.finditer(r"\S+", text) if not is_prep(m[0]) and not _joins(m[0])), None)
    if head is None:
        return
    rest = text[head:]
    if norm(rest.split()[0]) in vocab.STOPWORDS:
        return
    end = min((p for x in vocab.CLAUSE_ENDS if (p := rest.find(x)) >= 0), default=len(rest))
    noun = rest[:end].strip()
    if not noun:
        return
    before = text[:head].strip().rstrip(",").strip()
    prep = d.name.strip() + (f", {before}" if before else "")
    after = re.sub(r"\A[,\s]+", "", rest[end:]).strip()
    d.name, d.parts = noun, [(PREP, prep), *([(RAW, after)] if after else []), *d.parts[1:]]


def _alias(d: Draft, addons) -> None:
    if not d.parts or d.parts[0][0] != RAW:
        return
    text = d.parts[0][1].lstrip()
    if text[:1] != "(" or (end := closing(text)) is None:
        return
    inner, after = text[1:end].strip(), text[end + 1 :].lstrip()
    if not paren.is_alias(inner) or not after[:1].isalpha():
        return
    stop = after.find(" (")
    stop = stop if stop >= 0 else after.find(", ")
    stop = stop if stop >= 0 else len(after)
    head = after[:stop].strip()
    if not any(map(str.isalpha, head)):
        return
    d.name = collapse(f"{d.name} ({inner}) {head}")
    rest = re.sub(r"\A[,\s]+", "", after[stop:]).strip()
    d.parts[:1] = [(RAW, rest)] if rest else []


def _list_head(d: Draft, addons) -> None:
    words = d.name.split()
    mod = d.modifier() if len(words) == 1 and words[0].lower() not in vocab.LIST_HEADS else None
    if not mod or "," not in mod or " or " not in mod.lower():
        return
    head = _EDGES.sub("", mod.split()[-1])
    if head.lower() in vocab.LIST_HEADS:
        d.name, d.parts = f"{words[0]} {head}", [(ALTERNATIVE, f"or {mod}")]


def _second_amounts(d: Draft, addons) -> None:
    mod = d.modifier()
    m = mod and (_ABOUT_PAREN.search(mod) or _LAST_PAREN.search(mod))
    if not m:
        return
    try:
        got = measures(m[1].strip(), addons)
    except Abort:
        return
    if not got or not got[1] or not paren.is_short_rest(got[0]) or any(u == '"' or vocab.is_distance(u) for u, _, _ in got[1]):
        return
    d.amounts += got[1]
    rest = collapse(mod[: m.start()] + mod[m.end() :])
    d.parts = [(RAW, rest)] if rest else []


REPAIRS = [
    ("fix_leading_prep_phrase", _leading_prep_phrase),
    ("fix_leading_minus_clause", _leading_minus),
    ("recover_head_noun_from_modifier", _head_noun),
    ("recover_parenthetical_alias_from_modifier", _alias),
    ("recover_shared_head_from_alternatives", _list_head),
    ("extract_secondary_amounts_from_modifier", _second_amounts),
]

# refinements of the name


def _postfix_unit(d: Draft) -> None:
    at = next((i for i, m in enumerate(d.amounts) if m[0] == "whole"), None)
    if at is None and d.amounts:
        return
    low = d.name.lower()
    for food, unit in vocab.POSTFIX_UNITS:
        tail = f"{food} {unit}"
        if low == tail or low.endswith(" " + tail):
            count = 1.0 if at is None else float(d.amounts[at][1])
            before = d.name[: len(d.name) - len(tail)].strip()
            if at is None:
                d.amounts.append(measure(unit, count))
            else:
                d.amounts[at] = measure(unit, count)
            d.name = food
            if before:
                d.parts.insert(0, (PREP, before))
            return


def _size_unit(d: Draft) -> None:
    at = next((i for i, m in enumerate(d.amounts) if m[0] == "whole"), None)
    if at is None:
        return
    name = d.name.strip()
    low = name.lower()
    size = next((w for w in vocab.SIZE_UNITS if low.startswith(w) and low[len(w) : len(w) + 1].isspace()), None)
    rest = name[len(size) :].strip() if size else ""
    if not rest or rest.split()[0].lower() in vocab.SIZE_WORDS | {"or", "and"}:
        return
    _, low_value, high_value = d.amounts[at]
    d.amounts[at] = measure(size.replace("-", " "), float(low_value), None if high_value is None else float(high_value))
    d.name = rest


def _leading_or(d: Draft) -> None:
    w = d.name.split()
    low = [x.lower() for x in w]
    if len(w) < 4 or low[1] != "or" or not low[0].isalpha() or not (low[0].endswith("ed") or low[0] in vocab.ADJECTIVES):
        return
    n = 4 if len(w) >= 5 and f"{low[2]} {low[3]}" in vocab.ADJECTIVES else 3 if low[2] in vocab.ADJECTIVES else 0
    if n and n < len(w):
        d.name = " ".join(w[n:])
        d.push(PREP, " ".join(w[:n]))


def _trailing_clause(d: Draft) -> None:
    words = list(re.finditer(r"\S+", d.name))
    for m, after in zip(words[1:], words[2:]):
        w = m[0].lower()
        if after[0].lower() in ("with", "into") and (w.endswith("ed") or w in vocab.ADJECTIVES):
            clause, name = d.name[m.start() :].strip(), d.name[: m.start()].strip()
            if name:
                d.name = name
                d.push(PREP, clause)
            return


def _without(s: str, a: int, b: int) -> str:
    return " ".join(x for x in (s[:a].strip(), s[b:].strip()) if x)


def _adjectives(d: Draft) -> None:
    low = _aligned(d.name)
    if low is None or not _ANY_ADJECTIVE.search(low):
        return
    found = sorted((a for a in vocab.ADJECTIVES if a in low), key=lambda a: (-len(a), low.find(a)))
    name, leading = d.name, 0
    for adjective in found:
        a = low.find(adjective)
        if a < 0:
            continue
        b = a + len(adjective)
        if 0 <= low.find(" or ") < a or (0 <= low.find(" and ") < a and b < len(low)) or (adjective == "fresh" and low.startswith(" or ", b)):
            continue
        if not (a == 0 or name[a - 1].isspace()) or not (b == len(name) or name[b].isspace()):
            continue
        cut, prep = a, adjective
        before = low[:a].split()
        if before and before[-1] in vocab.ADVERBS:
            start = low[:a].rfind(before[-1])
            if start == 0 or name[start - 1].isspace():
                cut, prep = start, f"{before[-1]} {adjective}"
        if name[:cut].strip():
            d.push(PREP, prep)
        else:
            d.parts.insert(leading, (PREP, prep))
            leading += 1
        name, low = _without(name, cut, b), _without(low, cut, b)
    d.name = name


def _purpose(d: Draft) -> None:
    m = _FOR.search(d.name)
    word = next(iter(d.name[m.end() :].split()), "") if m else ""
    if _gerund(word) or word.lower() == "the":
        clause, d.name = d.name[m.start() :].strip(), d.name[: m.start()].strip()
        d.push(PREP, clause)


def _modified_head(w: list[str]) -> bool:
    return len(w) >= 2 and w[0].lower() not in vocab.ADJECTIVES and not any(x.lower() in vocab.STOPWORDS for x in w)


def split_or(name: str) -> tuple[str, str | None]:
    """The first choice with the head that both share, and the other as "or ..."."""
    m = _OR.search(name)
    left, right = (name[: m.start()].strip(), name[m.end() :].strip()) if m else ("", "")
    if not left or not right:
        return name, None
    lw, rw, low = left.split(), right.split(), right.lower()
    if " and " in low or " or " in low or (len(lw) == 1 and left.lower() in vocab.SIZE_WORDS and rw[0].lower() in vocab.SIZE_WORDS):
        return name, None
    if any(x.endswith(("'s", "’s")) for x in lw) and "a" <= rw[-1][0] <= "z":
        return name, None
    first = left
    if _modified_head(rw):
        if len(lw) == 1 and (left.lower() in vocab.PREMODIFIERS or left.lower() in vocab.ADJECTIVES):
            first = f"{left} {' '.join(rw[1:])}"
        elif rw[-1].lower() in vocab.INLINE_HEADS:
            first = f"{left} {rw[-1]}"
    return first, f"or {right}"


def _alternatives(d: Draft) -> None:
    if m := _OR_AMOUNT.search(d.name):
        other, d.name = d.name[m.start() :].strip(), d.name[: m.start()].strip()
        d.push(ALTERNATIVE, other)
    d.name, other = split_or(d.name)
    if other:
        d.push(ALTERNATIVE, other)
    if m := _AND_OR.search(d.name):
        left, right = d.name[: m.start()].strip(), d.name[m.end() :].strip()
        if left and right:
            d.name = left
            at = next((i for i, (kind, _) in enumerate(d.parts) if kind == RAW), len(d.parts))
            d.parts.insert(at, (ALTERNATIVE, f"and/or {right}"))


REFINES = [
    ("extract_postfix_produce_unit", _postfix_unit),
    ("extract_size_unit_from_name", _size_unit),
    ("extract_leading_prep_alternative", _leading_or),
    ("extract_trailing_prep_clause", _trailing_clause),
    ("extract_adjectives_from_name", _adjectives),
    ("extract_purpose_gerund", _purpose),
    ("extract_alternatives_from_name", _alternatives),
]

# whole lines


@dataclass
class Line:
    name: str
    amounts: list[Measure]
    modifier: str | None = None
    optional: bool = False
    usage: str = "normal"
    confidence: str = "medium"
    fell_back: bool = False
    unparsed_digit: bool = False

    def reasons(self) -> list[str]:
        return ["fell_back"] * self.fell_back + ["unparsed_digit"] * self.unparsed_digit

    def text(self) -> str:
        amounts = " / ".join(map(display, self.amounts)) or "n/a"
        return f"{amounts} {self.name}" + (f", {self.modifier}" if self.modifier else "") + " (optional)" * self.optional


def _unwrapped(mod: str | None) -> str | None:
    t = (mod or "").strip()
    if t[:1] == "(" and t[-1:] == ")" and len(t) > 1 and not set("()") & set(t[1:-1]):
        return t[1:-1].strip() or None
    return mod


def _aside(s: str) -> tuple[str, str] | None:
    """The line without a temperature or distance that stands in parentheses between two words, and that."""
    a = s.find("(")
    b = s.find(")", a) if a >= 0 else -1
    if b < 0:
        return None
    before, inner, after = s[:a].rstrip(), s[a + 1 : b].strip(), s[b + 1 :].lstrip()
    if not before[-1:].isalpha() or not after[:1].isalpha() or not paren.is_descriptive(inner):
        return None
    return f"{before} {after}", inner


class LineParser:
    def __init__(self, extra_units: tuple[str, ...] = ()):
        """`extra_units` are further countable units, singular and plural each."""
        self.addons = vocab.ADDON_UNITS | {u.lower() for u in extra_units}

    def _steps(self, steps, d: Draft, log: list[str] | None, *args) -> None:
        for name, run in steps:
            if log is None:
                run(d, *args)
                continue
            before, text = d.state(), d.text()
            run(d, *args)
            if d.state() != before:
                log.append(Step.of(name, text, d.text()))

    def core(self, s: str, log: list[str] | None = None) -> Line | None:
        aside = _aside(s)
        try:
            d = draft(aside[0] if aside else s, self.addons)[0]
        except Abort:
            return None
        self._steps(REPAIRS, d, log, self.addons)
        self._steps(REFINES, d, log)
        if aside:
            d.push(RAW, aside[1])
        return Line(d.name, d.amounts, _unwrapped(d.modifier()))

    def _optional_wrapped(self, s: str, log) -> Line | None:
        t = s.strip()
        if t[:1] != "(" or t[-1:] != ")" or len(t) < 2:
            return None
        got = self.core(t[1:-1], log)
        if not got or not (got.name or got.amounts):
            return None
        got.optional = True
        return got

    def _trailing_amount(self, s: str, log) -> Line | None:
        for sep in (" — ", " – ", " -- "):
            name, at, amount = s.rpartition(sep)
            if not at:
                continue
            try:
                got = measures(amount, self.addons)
            except Abort:
                continue
            if got and not got[0].strip() and any(u not in ("fahrenheit", "celsius") for u, _, _ in got[1]):
                return Line(name.strip(), got[1])
        return None

    def _x_of(self, s: str, log) -> Line | None:
        t = s.strip()
        low = _aligned(t)
        ends = [p + len(sep) for sep in (" of ", " from ") if low and (p := low.find(sep)) >= 0 and _A_NUMBER.match(t, p + len(sep))]
        if not ends:
            return None
        phrase = t[: min(ends)].strip()
        if not phrase or len(phrase.split()) > 5:
            return None
        got = self.core(t[min(ends) :].lstrip(), log)
        if not got or not got.amounts or not got.name.strip():
            return None
        got.modifier = f"{phrase.lower()}, {got.modifier}" if (got.modifier or "").strip() else phrase.lower()
        return got

    RECOGNIZERS = [("optional_wrapped", _optional_wrapped), ("trailing_amount", _trailing_amount), ("x_of_construction", _x_of)]

    def recognize(self, s: str, log: list[str] | None = None) -> Line | None:
        for name, run in self.RECOGNIZERS:
            inner = None if log is None else []
            if got := run(self, s, inner):
                if log is not None:
                    log += [Step.of(name, s, got.name), *inner]
                return got
        return None

    def parse(self, raw: str, log: list[str] | None = None) -> Line:
        line = normalize(raw, log)
        text, optional = strip_optional(line)
        got = self.recognize(text, log)
        if not got:
            got = self.core(text, log)
            if not got or (not got.name.strip() and (got.modifier or "").strip()):
                got = Line(text.strip(), [], fell_back=True)
        got.optional |= optional
        got.usage = usage(got.name, got.modifier, line)
        got.unparsed_digit = not got.amounts and any("0" <= c <= "9" for c in raw)
        got.confidence = "high" if got.amounts else "low" if got.unparsed_digit else "medium"
        return got

    def stages(self, raw: str) -> list[tuple[str, str, str, str | None]]:
        """(stage, name, before, after) of each pass that left its mark, of the recognizers up to the one that read the line (after is
        null for those that didn't), and of the grammar (null where it gave the line up)."""
        log: list[Step] = []
        line = normalize(raw, log)
        out = [("normalize", str(x), x.before, x.after) for x in log]
        text, optional = strip_optional(line)
        if optional:
            out.append(("normalize", "strip_optional_note", line, text))
        got, log = None, []
        for name, run in self.RECOGNIZERS:
            got = run(self, text, log := [])
            out.append(("recognize", name, text, got.name if got else None))
            if got:
                break
        if not got:
            got = self.core(text, log := [])
            out.append(("grammar", "parse_ingredient", text, got.name if got else None))
        of = dict((name, stage) for stage, name in stage_names())
        return out + [(of[x], str(x), x.before, x.after) for x in log if of[x] in ("segment", "refine")]

    def report(self, raw: str) -> str:
        """The stages as text."""
        steps = self.stages(raw)
        out = [f'{"input:":<11}"{raw}"']

        def block(stage: str, none: str | None, write) -> None:
            rows = [write(*s[1:]) for s in steps if s[0] == stage]
            for k, text in enumerate(rows or ([none] if none else [])):
                out.append(f"{'' if k else stage + ':':<11}{text}")

        block("normalize", "(no rewrites fired)", lambda n, a, b: f'{n}  "{a}" → "{b}"')
        tried = [f"{n} ✗" if b is None else f"{n} ✓ → {b}" for stage, n, _, b in steps if stage == "recognize"]
        core = any(s[0] == "grammar" for s in steps)
        out.append(f'{"recognize:":<11}{"  ".join(tried)}{"  → core parse" if core else ""}')
        block("grammar", "(skipped: a recognizer read the line)", lambda n, a, b: "(no parse: fell back)" if b is None else f'name="{b}"')
        block("segment", None, lambda n, a, b: f'{n}  "{a}" → {b}')
        block("refine", "(no passes changed it)", lambda n, a, b: f'{n}  "{a}" → {b}')
        out.append(f'{"result:":<11}name="{self.parse(raw).name}"')
        return "\n".join(out) + "\n"

    def decompose(self, raw: str) -> tuple[str, list[tuple[str, int, int, str]]]:
        """The cleaned line and which of its characters became amounts, name and modifier; no spans for a recognized form."""
        text, _ = strip_optional(normalize(raw))
        if self.recognize(text):
            return text, []
        try:
            _, rest, end, hoisted = draft(text, self.addons)
        except Abort:
            return text, []
        if not text.endswith(rest):
            return text, []  # the grammar took its container from the end of the line
        base = len(text) - len(rest)
        found = [("amount", 0, base), ("name", base, base + end)]
        tail = base + end
        if hoisted:
            found.append(("amount", base + hoisted[0], base + hoisted[1]))
            tail = base + hoisted[1]
        if text.startswith(", ", tail):
            tail += 2
        found.append(("modifier", tail, len(text)))
        out = []
        for kind, a, b in found:
            piece = text[a:b]
            a, b = a + len(piece) - len(piece.lstrip()), b - (len(piece) - len(piece.rstrip()))
            if a < b:
                out.append((kind, a, b, text[a:b]))
        return text, out


def stage_names() -> list[tuple[str, str]]:
    """(stage, pass) of every pass that may leave its mark on a line."""
    tables = (("normalize", REWRITES), ("recognize", LineParser.RECOGNIZERS), ("segment", REPAIRS), ("refine", REFINES))
    return [(stage, name) for stage, table in tables for name, _ in table]


# usage


def _phrase_at(text: str, phrase: str) -> int:
    at = text.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        if not (at and text[at - 1].isalnum()) and not (end < len(text) and text[end].isalnum()):
            return at
        at = text.find(phrase, at + 1)
    return -1


def _surplus(text: str, at: int) -> bool:
    recent = re.findall(r"[^\W_]+", text[:at])[-4:]
    return bool(recent) and (recent[-1] in ("more", "extra") or "plus" in recent)


def usage(name: str, modifier: str | None = None, line: str | None = None, section: str | None = None) -> str:
    texts = [t.lower() for t in (modifier, line, name) if t is not None]
    texts = [t for t in texts if "for " in t or "to taste" in t]  # what every phrase begins with
    for kind, phrases in vocab.USAGE_RULES if texts else ():
        for t in texts:
            for p in phrases:
                at = _phrase_at(t, p)
                if at >= 0 and not (p.startswith("for ") and _surplus(t, at)):
                    return kind
    if section and any(_phrase_at(section.lower(), w) >= 0 for w in vocab.MARINADE_SECTIONS):
        return "marinade"
    return "normal"
