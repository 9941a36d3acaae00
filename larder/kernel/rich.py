"""Instruction prose to chunks: measures, names of the recipe's ingredients, and the text between."""

from __future__ import annotations

import re

from larder.kernel import vocab
from larder.kernel.grammar import DEPTH, LEAD, Abort, Grammar, TooDeep
from larder.kernel.measures import GLYPH_CLASS, Measure

_ALLOWED = re.compile(r"(?:[^\W_]+|[\s\-—'’.\\,();#/:!]+)*+")
_PLAIN = re.compile(r"[^\W\d_]+")
_CONTINUES = (" the ", " to ", " together", " well", " until ", " for ")
# A measure in prose begins with one of these; anywhere else the grammar needn't be asked.
_BEGINS = re.compile(
    rf"[0-9({GLYPH_CLASS}]|\.[0-9]|[+-](?:[0-9]|\.[0-9])|(?:an? )?(?:about|approx|approximately|around|brimming|generous|good|heaped|heaping|healthy|less than|rounded|roughly|scant)[ \t]|up to|at most", re.I
)
_MARK = re.compile(r"\. \Z| of\Z|\.\Z|\s+\Z")
# A number whose exponent has no digits, on which the grammar gives up.
_MALFORMED = re.compile(r"(?<![0-9.])(?<![0-9.][eE])(?<![0-9.][eE][+-])[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?=[eE](?![+-]?[0-9]))")
Chunk = tuple[str, str | None, list[Measure] | None]  # kind ("measure", "text", "ing"), text, measures


def _raw(s: str, addons: frozenset[str]) -> list[Chunk]:
    """Measures and text, up to the first character that prose may not hold."""
    out: list[Chunk] = []

    def text(t: str) -> None:
        if out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + t, None)
        elif t:
            out.append(("text", t, None))

    g, at = Grammar(s, addons, prose=True), 0
    while at < len(g.s):
        begin = _BEGINS.search(g.s, at)
        stop = begin.start() if begin else len(g.s)
        end = _ALLOWED.match(g.s, at, stop).end()
        text(g.s[at:end])
        if end < stop or not begin:
            break
        at = stop
        got = g.read(at)
        if got:
            left, end, found = got
            # a container at the end of the line may have been read before what precedes it
            used = g.s[at:end] if left is g else g.s[at : len(g.s) - len(left.s) + end] if g.s.endswith(left.s[end:]) and len(left.s) - end < len(g.s) - at else g.s[at:]
            lead = LEAD.match(g.s, at)
            if lead:
                text(lead[0])
            out.append(("measure", None, found))
            if m := _MARK.search(used):
                text(m[0])
            g, at = left, end
        elif _ALLOWED.match(g.s, at, at + 1).end() == at:
            break
        else:
            text(g.s[at])
            at += 1
    return out


def every_measure(s: str, addons: frozenset[str] = vocab.ADDON_UNITS) -> list[Measure]:
    """The measures of a whole document: characters that prose may not hold, malformed numbers and what opens more than DEPTH
    parentheses are passed over, not ends."""
    out: list[Measure] = []
    for piece in _MALFORMED.split(s):
        g, at = Grammar(piece, addons, prose=True), 0
        while m := _BEGINS.search(g.s, at):
            try:
                got = g.read(m.start())
            except TooDeep:  # on past what is open by then
                at = m.start()
                for _ in range(DEPTH):
                    at = max(at, g.s.find("(", at)) + 1
                continue
            except Abort:
                got = None
            if got:
                out += got[2]
                g, at = got[0], got[1]
            else:
                at = m.start() + 1
    return out


def _ends(s: str, end: int) -> int | None:
    """Where a name that ends here ends as a word, with a plural's ending."""
    for more in ("es", "s", ""):
        if s.startswith(more, end) and not s[end + len(more) : end + len(more) + 1].isalnum():
            return end + len(more)
    return None


def _find(s: str, name: str) -> tuple[int, int] | None:
    at = s.find(name)
    while at >= 0:
        if not (at and s[at - 1].isalnum()) and (end := _ends(s, at + len(name))) is not None:
            return at, end
        at = s.find(name, at + len(name))
    head = s[: len(name)]
    if head.isascii() and head.lower() == name.lower() and not s.startswith(_CONTINUES, len(name)) and (end := _ends(s, len(name))) is not None:
        return 0, end
    return None


def names_of(names: list[str]) -> list[str]:
    """Each name and every phrase that ends it."""
    out: dict[str, None] = {}
    for n in names:
        w = n.split()
        out.update(dict.fromkeys(" ".join(w[i:]) for i in range(len(w))))
    return list(out)


def parse(s: str, names: list[str], addons: frozenset[str] = vocab.ADDON_UNITS) -> list[Chunk] | None:
    """The chunks; None where a number is malformed or parentheses are more than DEPTH deep. The earliest name is taken first, of several there the longest."""
    try:
        chunks = _raw(s, addons)
    except Abort:
        return None
    phrases, out = names_of(names), []
    for chunk in chunks:
        if chunk[0] != "text":
            out.append(chunk)
            continue
        rest = chunk[1]
        while rest:
            hits = [(*hit, p) for p in phrases if (hit := _find(rest, p))]
            if not hits:
                out.append(("text", rest, None))
                break
            a, b, _ = min(hits, key=lambda h: (h[0], -len(h[2].encode())))
            if a:
                out.append(("text", rest[:a], None))
            out.append(("ing", rest[a:b], None))
            rest = rest[b:]
    return out
