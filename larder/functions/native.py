"""Column expressions that run in the JVM: text rewrites, units and quantities, durations and titles. No Python runs for them.

Most compile into generated code. Those that use let() or an array's elements one by one are interpreted by Spark; normalize_lines() gives
the rewrites of a table's lines as bound columns, which are compiled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.kernel import measures as M
from larder.kernel import vocab

Col = Column | str


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _const_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _one_of(c: Column, words) -> Column:
    return c.isin(*sorted(words))


# lines

_GLYPHS = M.GLYPH_CLASS
_SEE, _GAP, _INSIDE = r"(?:see\s+)?", r"[\s,;]*", r"[^)]*"
_PAGE = _SEE + r"(?:page\s+\d+|this page)"
_PAGES = rf"\(\s*{_PAGE}(?:{_GAP}(?:and|or|to)?{_GAP}{_PAGE})*+"
_AMOUNT = r"\d¼-¾⅐-⅞"
_PATTERNS = [
    (r"(?U)^\s*[*·•∙–—-]\s+", ""),
    ("[①-⒛⓪⓵-⓿❶-➓]", ""),
    (r"(?U)(?:(?<!\s)\s+|(?<![*†‡\s]))[*†‡]++\s*$", ""),
    (rf"(?iU){_PAGES}[\s,;]+optional\s*\)", "(optional)"),
    (rf"(?iU)\s*{_PAGES}\s*\)", ""),
    (rf"(?iU)\s*\(\s*{_SEE}notes?\s*\)", ""),
    (rf"(?iU)^(\s*[{_AMOUNT}][{_AMOUNT}\s./-]*\s+)batch(?:es)?\s+of\s+", "$1recipe "),
    (rf"(?iU)^the\s+(?=[0-9{_GLYPHS}])", ""),
]


def collapse_whitespace(c: Col) -> Column:
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def _replaced(s: Column, patterns) -> Column:
    for pattern, to in patterns:
        s = F.regexp_replace(s, pattern, to)
    return s


def _words(s: Column) -> Column:
    """The words of a line that may open with a dimension, else null."""
    return F.when(s.contains("-"), F.split(collapse_whitespace(s), " "))


def _rest(w: Column, start: int) -> Column:
    return F.array_join(F.slice(w, start, F.greatest(F.size(w), F.lit(1))), " ")


def _dimension(s: Column, w: Column) -> Column:
    first, d = F.get(w, F.lit(0)), F.regexp_replace(F.get(w, F.lit(1)), r"^\(+|\)+$", "")
    counts = _one_of(F.lower(first), vocab.SPELLED_COUNTS) | first.rlike(f"^[0-9./{_GLYPHS}]+$")
    shape = d.rlike(rf"(?i)^[0-9{_GLYPHS}].*-(?:deep|long|tall|thick|wide)$")
    return F.when((F.size(w) >= 3) & counts & shape, F.concat(first, F.lit(" "), _rest(w, 3), F.lit(", "), d)).otherwise(s)


def _piece(s: Column, w: Column) -> Column:
    first, second, third = (F.get(w, F.lit(k)) for k in range(3))
    places = "|".join(sorted(vocab.DISTANCES, key=len, reverse=True))
    hit = first.rlike(rf"(?i)^[0-9{_GLYPHS}].*-(?:{places})(?:e?s)?$") & _one_of(F.lower(second), vocab.CONTAINERS) & third.rlike(rf"^\([0-9{_GLYPHS}]")
    return F.when((F.size(w) >= 3) & hit, F.concat(F.lit("1 "), second, F.lit(" "), _rest(w, 3), F.lit(", "), first)).otherwise(s)


def _when_paren(s: Column, run) -> Column:
    return F.when(s.contains("("), run(s)).otherwise(s)


def _minus(s: Column, cut: Column) -> Column:
    return F.when(cut.isNotNull() & cut.rlike(f"[0-9{_GLYPHS}]"), cut).otherwise(s)


def _cut_minus(s: Column) -> Column:
    return F.when(s.contains("minus"), F.regexp_replace(s, r"(?U)\s*\((?=[^)]*+\))[^)]*?\bminus\b[^)]*+\)", ""))


def _total(s: Column) -> Column:
    return F.regexp_replace(s, rf"(?iU)\((?<size>[{_GLYPHS}0-9]{_INSIDE}?)(?:\s+in)?\s+total\)", "(${size})")


def _tidy(s: Column) -> Column:
    return F.when(s.contains("  ") | s.startswith(" ") | s.endswith(" "), collapse_whitespace(s)).otherwise(s)


#: The ordered rewrites: (what is bound, from what, how). A step names what was bound before, by "s" for the line so far.
_BULLETS = lambda s: _replaced(F.replace(s, F.lit("\u00a0"), F.lit(" ")), _PATTERNS[:3])
_STEPS = [
    ("s", ("s",), _BULLETS),
    ("s", ("s",), lambda s: _when_paren(s, lambda x: _replaced(x, _PATTERNS[3:6]))),
    ("s", ("s",), lambda s: _replaced(s, _PATTERNS[6:])),
    ("x", ("s",), _cut_minus),
    ("s", ("s", "x"), _minus),
    ("s", ("s",), lambda s: _when_paren(s, _total)),
    ("x", ("s",), _words),
    ("s", ("s", "x"), _dimension),
    ("x", ("s",), _words),
    ("s", ("s", "x"), _piece),
    ("s", ("s",), _tidy),
]


def normalize_lines(df: DataFrame, line: str, out: str) -> DataFrame:
    """The table with `out`: the ordered rewrites of a line, the same text as the kernel's first stage.

    Each step is a column bound once, so no expression is repeated and all of them compile; a pattern that few lines can hold
    stands behind a plain test.
    """
    bound = {"s": f"__{out}_s", "x": f"__{out}_x"}
    df = df.withColumn(bound["s"], F.col(line).cast("string"))
    for name, using, step in _STEPS:
        df = df.withColumn(bound[name], step(*(F.col(bound[u]) for u in using)))
    return df.withColumn(out, F.col(bound["s"])).drop(*bound.values())


def _with(s: Column, step, after) -> Column:
    return let(s, lambda v: let(step(v), lambda x: after(v, x)))


def normalize_line(c: Col) -> Column:
    """The rewrites as one expression, for where a table's columns can't be bound; normalize_lines() is faster."""
    s = col(c).cast("string")
    at = 0
    while at < len(_STEPS):
        name, using, step = _STEPS[at]
        if name == "x":
            s = _with(s, step, _STEPS[at + 1][2])
            at += 2
        else:
            s = let(s, step)
            at += 1
    return s


def strip_optional_note(c: Col) -> Column:
    """struct<text, optional>: the line without "(optional)" or a last ", optional"."""
    s = col(c)
    t = F.regexp_replace(F.regexp_replace(s, r"(?iU)\s*\(optional\)", ""), r"(?iU),?\s+optional\s*$", "")
    t = F.when(F.lower(F.trim(s)) == "(optional)", s).otherwise(t)
    return F.struct(t.alias("text"), (t != s).alias("optional"))


# units and measures: struct<unit, value, upper_value>


def singular(c: Col) -> Column:
    return F.regexp_replace(F.lower(col(c)), "^(.*(?:ch|sh|ss|x|z))es$|^(.*)s$", "$1$2")


def canonical_unit(c: Col) -> Column:
    """The unit of a spelling; an unknown one in the singular."""
    one = singular(c)
    return F.coalesce(F.element_at(_const_map(M.ALIASES), one), one)


def unit_kind(unit: Col) -> Column:
    u = col(unit)
    nutrient = u.rlike(rf"(?i)^\s*(?:g|mg|ug|µg|mcg|kcal|iu)\s+(?:{'|'.join(sorted(M.NUTRIENTS))})s?\s*$")
    return F.coalesce(F.element_at(_const_map(M.KINDS), u), F.when(nutrient, F.concat(F.lit("nutrient:"), u)).otherwise(F.concat(F.lit("other:"), u)))


def base_unit(kind: Col) -> Column:
    return F.coalesce(F.element_at(_const_map(M.BASES), col(kind)), F.substring_index(col(kind), ":", -1))


def is_scalable(kind: Col) -> Column:
    return col(kind).isin("weight", "volume") | col(kind).startswith("other:")


def make_measure(unit: Col, value: Col, upper: Col | None = None) -> Column:
    v, u = col(value).cast("double"), (F.lit(None) if upper is None else col(upper)).cast("double")
    return F.struct(canonical_unit(unit).alias("unit"), F.least(v, u).alias("value"), F.when(u.isNotNull(), F.greatest(v, u)).alias("upper_value"))


def _times(m: Column, unit: Column, factor: Column) -> Column:
    return F.struct(unit.alias("unit"), (m["value"] * factor).alias("value"), (m["upper_value"] * factor).alias("upper_value"))


def normalize_measure(m: Col) -> Column:
    m = col(m)
    base = F.coalesce(F.element_at(_const_map({u: b for u, (b, _) in M.TO_BASE.items()}), m["unit"]), m["unit"])
    factor = F.coalesce(F.element_at(_const_map({u: f for u, (_, f) in M.TO_BASE.items()}), m["unit"]), F.lit(1.0))
    return _times(m, base, factor)


def denormalize_measure(m: Col) -> Column:
    """The friendly unit of a base unit, chosen by the lower value."""
    m = col(m)
    unit, divisor = m["unit"], F.lit(1.0)
    for base, steps in M.FRIENDLY.items():
        for below, friendly, by in reversed(steps):
            here = (m["unit"] == base) & (F.lit(True) if below == float("inf") else m["value"] < below)
            unit, divisor = F.when(here, friendly).otherwise(unit), F.when(here, by).otherwise(divisor)
    return F.struct(unit.alias("unit"), (m["value"] / divisor).alias("value"), (m["upper_value"] / divisor).alias("upper_value"))


def scale_measure(m: Col, factor: Col | float) -> Column:
    m = col(m)
    f = F.lit(float(factor)) if isinstance(factor, (int, float)) else col(factor).cast("double")
    ok = is_scalable(unit_kind(m["unit"])) & f.isNotNull() & ~F.isnan(f) & (F.abs(f) != float("inf"))
    s = _times(m, m["unit"], f)
    turned = F.struct(s["unit"].alias("unit"), F.least(s["value"], s["upper_value"]).alias("value"), F.when(s["upper_value"].isNotNull(), F.greatest(s["value"], s["upper_value"])).alias("upper_value"))
    return F.when(ok, turned).otherwise(F.struct(m["unit"].alias("unit"), m["value"].alias("value"), m["upper_value"].alias("upper_value")))


def scale_amounts(amounts: Col, factor: Col | float) -> Column:
    return F.transform(col(amounts), lambda m: scale_measure(m, factor))


def two_decimals(v: Col) -> Column:
    return F.regexp_replace(F.format_string("%.2f", col(v).cast("double")), r"\.?0+$", "")


def format_quantity(v: Col) -> Column:
    """1.5 as 1½, 0.1875 as 0.19: a glyph where one fits, else at most two decimals."""
    return let(col(v).cast("double"), _quantity)


def _quantity(x: Column) -> Column:
    whole = F.floor(F.abs(x))
    marks = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(n / d).alias("v")) for g, (n, d) in M.GLYPHS.items()])
    glyph = F.get(F.filter(marks, lambda k: F.abs(F.abs(x) - whole - k["v"]) < 1e-6), F.lit(0))["g"]
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.when(whole == 0, "").otherwise(whole.cast("string")), glyph)
    plain = F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(two_decimals(x))
    return F.coalesce(text, plain)


def unit_label(m: Col) -> Column:
    m = col(m)
    many = m["unit"].isin("cup", "second", "minute", "hour", "day") & ((m["value"] > 1) | (F.coalesce(m["upper_value"], F.lit(0.0)) > 1))
    return F.concat(m["unit"], F.when(many, "s").otherwise(""))


def display_measure(m: Col) -> Column:
    return let(denormalize_measure(m), _displayed)


def _displayed(d: Column) -> Column:
    upper = F.coalesce(d["upper_value"], F.lit(0.0))

    def body(write):
        return F.when(upper == 0, write(d["value"])).when(d["value"] == 0, write(upper)).otherwise(F.concat(write(d["value"]), F.lit(" - "), write(upper)))

    money = body(lambda v: F.concat(F.lit("$"), F.when(v == F.floor(v), v.cast("decimal(38,0)").cast("string")).otherwise(two_decimals(v))))
    plain = body(format_quantity)
    return F.when(d["unit"] == "$", money).when(d["unit"] == "whole", plain).otherwise(F.concat(plain, F.lit(" "), unit_label(d)))


def display_ingredient(p: Col) -> Column:
    """An INGREDIENT as one line of text."""
    p = col(p)
    amounts = F.when(F.size(p["amounts"]) == 0, "n/a").otherwise(F.array_join(F.transform(p["amounts"], display_measure), " / "))
    return F.concat(amounts, F.lit(" "), p["name"], F.coalesce(F.concat(F.lit(", "), p["modifier"]), F.lit("")), F.when(p["optional"], " (optional)").otherwise(""))


def review_reasons(p: Col) -> Column:
    n = col(p)["parse_notes"]
    return F.filter(F.array(F.when(n["fell_back"], "fell_back"), F.when(n["unparsed_digit"], "unparsed_digit")), lambda x: x.isNotNull())


def confidence_rank(p: Col) -> Column:
    c = col(p)["parse_notes"]["confidence"]
    return F.when(c == "low", 0).when(c == "medium", 1).when(c == "high", 2)


def round_sig(x: Col, digits: int = 6) -> Column:
    v = col(x).cast("double")
    p = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, v).otherwise(F.signum(v) * F.floor(F.abs(v * p) + 0.5) / p)


def truncate_number(x: Col, decimals: int = 3) -> Column:
    v = col(x).cast("double") * 10**decimals
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)) / 10**decimals


def truncate_text(c: Col, most: int) -> Column:
    s = col(c)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most), F.lit("...")))


# durations


def iso_minutes(c: Col) -> Column:
    """Whole minutes of an ISO 8601 duration of days, hours, minutes and seconds; null when zero or malformed."""
    s = F.trim(col(c))
    form = r"^P(?=.)(?:(\d+)D)?(?:T(?:\d+[HMS])*+)?$"
    days = F.try_to_number(F.nullif(F.regexp_extract(s, form, 1), F.lit("")), F.lit("9999999999")).cast("bigint")
    time = F.split(s, "T")[F.size(F.split(s, "T")) - 1]
    clock = F.when(s.contains("T"), time).otherwise("")

    def total(letter: str, by: int) -> Column:
        found = F.regexp_extract_all(clock, F.lit(rf"(\d+){letter}"), F.lit(1))
        return F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * by)

    some = days.isNotNull() | (F.length(clock) > 0)
    minutes = F.coalesce(days, F.lit(0)) * 1440 + total("H", 60) + total("M", 1)
    return F.when(s.rlike(form) & some & (minutes > 0) & (minutes < 2**32), minutes.cast("bigint"))


def humanize_minutes(c: Col) -> Column:
    m = col(c)
    part = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s")))
    return F.concat_ws(" ", part(F.floor(m / 60), "hour"), part(m % 60, "minute"))


def prose_minutes(c: Col) -> Column:
    """Minutes of "about 1 hr. 20 min"; null for anything that isn't hours and minutes throughout."""
    s = F.lower(F.trim(col(c)))
    s = F.regexp_replace(s, r"^(?:about |approximately |approx\. |approx |around |roughly |~) *", "")
    unit = r"(?:hours?|hrs?|h|minutes?|mins?|m)"
    ok = s.rlike(rf"^(?: *\d+ *{unit}(?![a-z])\.?)++ *$")

    def total(units: str, by: int) -> Column:
        found = F.regexp_extract_all(s, F.lit(rf"(\d+) *(?:{units})(?![a-z])"), F.lit(1))
        return F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a + F.try_to_number(x, F.lit("9999999999")).cast("bigint") * by)

    minutes = total("hours?|hrs?|h", 60) + total("minutes?|mins?|m", 1)
    return F.when(ok & (minutes > 0) & (minutes < 2**32), minutes)


# titles, hosts, headings


def normalize_title(c: Col) -> Column:
    squashed = F.trim(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(squashed, "^(?:the|an|a) ", "")


def contains_title(line: Col, title: Col) -> Column:
    """Whether a normalized line holds a normalized title as whole words."""
    pad = lambda c: F.concat(F.lit(" "), col(c), F.lit(" "))
    return (F.length(col(title)) > 0) & F.contains(pad(line), pad(title))


def has_reference_marker(line: Col) -> Column:
    return col(line).rlike("recipe|page|opposite")


def looks_like_title(c: Col) -> Column:
    t = F.trim(col(c))
    return (F.octet_length(t).between(1, 60)) & ~t.rlike(rf"^[0-9{_GLYPHS}•·*\-–—]") & ~t.endswith(".")


def is_notes_heading(c: Col) -> Column:
    return F.lower(F.trim(col(c))).isin("note", "notes", "tip", "tips")


def is_host(url: Col, domain: str) -> Column:
    """Whether a URL's host is the domain or one below it."""
    host = F.lower(F.try_parse_url(col(url), F.lit("HOST")))
    return F.coalesce((host == domain.lower()) | host.endswith("." + domain.lower()), F.lit(False))


def cache_key(version: Col, model: Col, text: Col, hint: Col) -> Column:
    """The content address of one extraction: a digest of the four parts with NUL between."""
    return F.sha2(F.concat_ws("\u0000", *(F.coalesce(col(c).cast("string"), F.lit("")) for c in (version, model, text, hint))), 256)


def unparsed_digits(c: Col) -> Column:
    """Runs of ASCII digits in a line."""
    return F.regexp_extract_all(col(c), F.lit("([0-9]+)"), F.lit(1))


def digit_spans(c: Col) -> Column:
    """array<struct<start, end, text>>: the runs of digits and fraction signs of a line, offsets counting characters from 0."""
    s = col(c)
    run = f"[0-9{_GLYPHS}]+"
    found = F.regexp_extract_all(s, F.lit(f"({run})"), F.lit(1))
    gaps = F.split(s, run)
    kind = "struct<at:int,out:array<struct<start:int,end:int,text:string>>>"
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out")).cast(kind)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["text"])
        one = F.struct(start.alias("start"), end.alias("end"), pair["text"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")).cast(kind)

    pairs = F.transform(found, lambda t, i: F.struct(F.get(gaps, i).alias("gap"), t.alias("text")))
    return F.aggregate(pairs, none, step)["out"]


def diagnostics(line: Col, p: Col) -> Column:
    """array<struct<start, end, text, label>>: what a person should look at in a line whose reading found a digit but no amount."""
    label = F.lit("digit without an amount")
    spans = F.transform(digit_spans(line), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), label.alias("label")))
    return F.when(col(p)["parse_notes"]["unparsed_digit"], spans).otherwise(F.array().cast("array<struct<start:int,end:int,text:string,label:string>>"))


def ingredient_key(p: Col) -> Column:
    """An INGREDIENT without its notes, for comparing and ordering: by name, amounts, modifier, optional and usage."""
    p = col(p)
    amounts = F.transform(p["amounts"], lambda m: F.struct(m["unit"].alias("unit"), m["value"].alias("value"), m["upper_value"].alias("upper_value")))
    return F.when(p.isNotNull(), F.struct(p["name"].alias("name"), amounts.alias("amounts"), p["modifier"].alias("modifier"), p["optional"].alias("optional"), p["usage"].alias("usage")))


def section_usage(usage: Col, section: Col) -> Column:
    """The role of an ingredient, which the title of its section decides where the line says nothing."""
    words = "|".join(sorted(map(re.escape, vocab.MARINADE_SECTIONS)))
    said = F.lower(col(section)).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])")
    return F.when((col(usage) == "normal") & F.coalesce(said, F.lit(False)), "marinade").otherwise(col(usage))


def format_quantity_ascii(v: Col) -> Column:
    """1.5 as 1 1/2: a fraction of at most 64 parts where one is that near, else at most four decimals."""
    x = col(v).cast("double")
    whole = F.floor(F.abs(x))
    part = F.abs(x) - whole
    tries = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda d: F.struct(d.alias("d"), F.round(part * d).cast("int").alias("n")))
    found = F.get(F.filter(tries, lambda t: F.abs(t["n"] / t["d"] - part) < 1e-9), F.lit(0))
    plain = F.regexp_replace(F.format_string("%.4f", x), r"\.?0+$", "")

    def shown(f: Column) -> Column:
        up = f["n"] == f["d"]
        sign = F.when(x < 0, "-").otherwise("")
        head = F.when(whole == 0, "").otherwise(F.concat(whole.cast("string"), F.lit(" ")))
        text = F.when(up | (f["n"] == 0), F.concat(sign, (whole + F.when(up, 1).otherwise(0)).cast("string"))).otherwise(F.concat(sign, head, f["n"].cast("string"), F.lit("/"), f["d"].cast("string")))
        return F.when(f.isNotNull(), text).otherwise(plain)

    return F.when(x == 0, "0").otherwise(let(found, shown))
