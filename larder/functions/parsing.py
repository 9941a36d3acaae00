"""Text to structure: the line grammar as Column functions.

Each is an Arrow function: a column goes to the worker in batches, and only that column. A batch is read by its distinct texts,
and results are kept beyond it, so equal lines in a batch or task are parsed once. Null in gives null out. Any text gives a result: a
line that the grammar gives up on, such as one nested more than 200 deep, is its own name, and its notes say that it fell back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from larder import types as T
from larder.kernel import grammar, rich, vocab
from larder.kernel.line import LineParser, explain_clauses
from larder.kernel.measures import Measure

_MEASURE = pa.struct([("unit", pa.string()), ("value", pa.float64()), ("upper_value", pa.float64()), *((c, pa.int64()) for c in ("num", "den", "upper_num", "upper_den"))])
_MEASURES = pa.list_(_MEASURE)
_INGREDIENT = pa.struct([("name", pa.string()), ("amounts", _MEASURES), ("modifier", pa.string()), ("optional", pa.bool_()), ("usage", pa.string()), ("parse_notes", pa.struct([("confidence", pa.string()), ("fell_back", pa.bool_()), ("unparsed_digit", pa.bool_())]))])
_CHUNKS = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("measures", _MEASURES)]))
_SPANS = pa.struct([("source", pa.string()), ("spans", pa.list_(pa.struct([("field", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])))])
_CLAUSES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("sep", pa.string()), ("kind", pa.string()), ("parens", pa.list_(pa.string())), ("stripped", pa.string())]))
_MAPPING = pa.struct([("a", _MEASURE), ("b", _MEASURE), ("source", pa.string()), ("error", pa.string())])
_MAX = (1 << 63) - 1
KEPT = 1 << 16  # results a worker keeps


def measure_row(m: Measure) -> dict:
    from larder.kernel.measures import shown

    unit, low, high = m
    exact = lambda r: (r.numerator, r.denominator) if r is not None and abs(r.numerator) <= _MAX and r.denominator <= _MAX else (None, None)
    return {"unit": shown(unit), "value": float(low), "upper_value": None if high is None else float(high), **dict(zip(("num", "den", "upper_num", "upper_den"), exact(low) + exact(high)))}


@cache
def _parser(extra: tuple[str, ...]) -> LineParser:
    return LineParser(extra)


@lru_cache(KEPT)
def _ingredient(line: str, extra: tuple[str, ...]) -> dict:
    r = _parser(extra).parse(line)
    return {"name": r.name, "amounts": [measure_row(m) for m in r.amounts], "modifier": r.modifier, "optional": r.optional, "usage": r.usage, "parse_notes": {"confidence": r.confidence, "fell_back": r.fell_back, "unparsed_digit": r.unparsed_digit}}


@lru_cache(KEPT)
def _amounts(text: str, extra: tuple[str, ...]) -> list | None:
    got = grammar.parse_amount(text, _parser(extra).addons)
    return None if got is None else [measure_row(m) for m in got]


@lru_cache(KEPT)
def _decomposed(line: str) -> dict:
    source, spans = _parser(()).decompose(line)
    return {"source": source, "spans": [dict(zip(("field", "start", "end", "text"), s)) for s in spans]}


@lru_cache(KEPT)
def _passes(line: str) -> list[str]:
    log: list[str] = []
    _parser(()).parse(line, log)
    return log


@lru_cache(KEPT)
def _mapping(text: str) -> dict:
    try:
        a, b, source = grammar.parse_mapping(text)
        return {"a": measure_row(a), "b": measure_row(b), "source": source, "error": None}
    except ValueError as e:
        return {"a": None, "b": None, "source": None, "error": str(e)}


def by_distinct(texts: pa.Array, kernel: Callable, kind: pa.DataType) -> pa.Array:
    """kernel(text) of each text, asked once for each distinct one."""
    coded = texts.dictionary_encode()
    return pa.array([kernel(t) for t in coded.dictionary.to_pylist()], kind).take(coded.indices)


def by_equal(rows: list, kernel: Callable, kind: pa.DataType) -> pa.Array:
    """The same for rows that Arrow can't encode, such as tuples; they must hash."""
    at: dict = {}
    indices = [at.setdefault(r, len(at)) for r in rows]
    return pa.array([kernel(r) for r in at], kind).take(pa.array(indices, pa.int32()))


def arrow_function(kernel: Callable, kind: pa.DataType, sql: str | DataType):
    """A Column function of one text column that gives kernel(text)."""

    def run(texts: pa.Array) -> pa.Array:
        return by_distinct(texts, kernel, kind)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, sql)


def parse_line(line: Column | str, extra_units: tuple[str, ...] = ()) -> Column:
    """INGREDIENT of a line. `extra_units` are countable units beyond the built-in ones, singular and plural each."""
    return arrow_function(lambda t: _ingredient(t, tuple(extra_units)), _INGREDIENT, T.INGREDIENT)(_text(line))


def parse_amount(text: Column | str, extra_units: tuple[str, ...] = ()) -> Column:
    """MEASURES at the start of a text; null where there is none."""
    return arrow_function(lambda t: _amounts(t, tuple(extra_units)), _MEASURES, T.MEASURES)(_text(text))


def decompose(line: Column | str) -> Column:
    """SPANS: the cleaned line and which characters of it became which field."""
    return arrow_function(_decomposed, _SPANS, T.SPANS)(_text(line))


def passes(line: Column | str) -> Column:
    """The names of the passes that left a mark on the line, in order."""
    return arrow_function(_passes, pa.list_(pa.string()), "array<string>")(_text(line))


@lru_cache(KEPT)
def _trace_text(line: str) -> str:
    return _parser(()).report(line)


def trace_text(line: Column | str) -> Column:
    """The stages of a line's parse as text, one line for the input, each rewrite, recognizer, decision and refinement, and the result."""
    return arrow_function(_trace_text, pa.string(), "string")(_text(line))


def trace_stages(line: Column | str) -> Column:
    """array<struct<stage, name, before, after>>: what each pass made of the line, in order, under normalize, recognize, grammar, segment
    and refine."""
    kind = "struct<stage:string,name:string,before:string,after:string>"
    shape = pa.list_(pa.struct([(k, pa.string()) for k in ("stage", "name", "before", "after")]))
    return arrow_function(lambda t: [dict(zip(("stage", "name", "before", "after"), r)) for r in _parser(()).stages(t)], shape, f"array<{kind}>")(_text(line))


def trace_spans(line: Column | str) -> Column:
    """array<struct<span_id, parent_id, stage, name>>: the line's parse as span 0, and under it each pass that left a mark, in order."""
    from larder.kernel.line import stage_names

    stage = F.create_map(*[F.lit(x) for s, p in stage_names() for x in (p, s)])
    kind = "struct<span_id:int,parent_id:int,stage:string,name:string>"
    root = F.struct(F.lit(0), F.lit(None).cast("int"), F.lit("line"), F.lit("parse_line")).cast(kind)
    steps = F.transform(passes(line), lambda p, i: F.struct(i + 1, F.lit(0), F.element_at(stage, p), p).cast(kind))
    return F.concat(F.array(root), steps)


def trace_json(line: Column | str) -> Column:
    """The spans of a line as JSON of the form that span viewers read: traces, their spans, and references from child to parent."""
    trace = F.substring(F.sha2(_text(line), 256), 1, 32)
    name = lambda n: F.lpad(F.hex(n), 16, "0")

    def span(s: Column) -> Column:
        up = F.struct(F.lit("CHILD_OF").alias("refType"), trace.alias("traceID"), name(s["parent_id"]).alias("spanID"))
        refs = F.when(s["parent_id"].isNotNull(), F.array(up)).otherwise(F.array().cast("array<struct<refType:string,traceID:string,spanID:string>>"))
        return F.struct(trace.alias("traceID"), name(s["span_id"]).alias("spanID"), s["name"].alias("operationName"), refs.alias("references"))

    return F.to_json(F.struct(F.array(F.struct(trace.alias("traceID"), F.transform(trace_spans(line), span).alias("spans"))).alias("data")))


def clauses(text: Column | str) -> Column:
    """CLAUSES of what follows a line's amounts."""
    return arrow_function(explain_clauses, _CLAUSES, T.CLAUSES)(_text(text))


def parse_mapping(text: Column | str) -> Column:
    """MAPPING of "4 lb = $5" or "$5/4lb @ shop"; `error` says what is wrong with any other text."""
    return arrow_function(_mapping, _MAPPING, T.MAPPING)(_text(text))


@lru_cache(KEPT)
def _chunks(text: str, names: tuple[str, ...], extra: tuple[str, ...] = ()) -> list | None:
    got = rich.parse(text, list(names), _parser(extra).addons)
    return None if got is None else [{"kind": k, "text": s, "measures": None if ms is None else [measure_row(m) for m in ms]} for k, s, ms in got]


@lru_cache(KEPT)
def _amount_string(text: str) -> dict:
    try:
        return {"measure": measure_row(grammar.parse_amount_string(text)), "error": None}
    except ValueError as e:
        return {"measure": None, "error": str(e)}


def parse_amount_string(text: Column | str) -> Column:
    """struct<measure, error> of a text that is one amount: "4 lb", "$5", "120g"; `error` says what is wrong with any other."""
    return arrow_function(_amount_string, pa.struct([("measure", _MEASURE), ("error", pa.string())]), f"struct<measure:{T.MEASURE},error:string>")(_text(text))


def rich_text(text: Column | str, names: Column, extra_units: tuple[str, ...] = ()) -> Column:
    """CHUNKS of instruction prose, `names` being an array of the recipe's ingredient names."""
    extra = tuple(extra_units)

    def run(texts: pa.Array, names: pa.Array) -> pa.Array:
        rows = [(t, tuple(x for x in n or () if x)) for t, n in zip(texts.to_pylist(), names.to_pylist())]
        return by_equal(rows, lambda r: None if r[0] is None else _chunks(*r, extra), _CHUNKS)

    return F.arrow_udf(run, T.CHUNKS)(_text(text), names)


def classify_usage(name: Column | str, modifier: Column | str, line: Column | str, section: Column | str) -> Column:
    """The role of an ingredient by its name, modifier, raw line and its section's title; any of them may be null."""
    from larder.kernel.line import usage

    def run(names: pa.Array, modifiers: pa.Array, lines: pa.Array, sections: pa.Array) -> pa.Array:
        return pa.array([usage(n or "", m, t, s) for n, m, t, s in zip(*(c.to_pylist() for c in (names, modifiers, lines, sections)))], pa.string())

    return F.arrow_udf(run, "string")(_text(name), _text(modifier), _text(line), _text(section))


def every_measure(text: Column | str) -> Column:
    """MEASURES of a whole document's prose."""
    return arrow_function(lambda t: [measure_row(m) for m in rich.every_measure(t)], _MEASURES, T.MEASURES)(_text(text))


def is_valid_unit(unit: Column | str, extra_units: tuple[str, ...] = ()) -> Column:
    """Whether a text names a unit: a built-in one in any spelling, singular or plural, or a countable one."""
    from larder.functions import native as N
    from larder.kernel.measures import ALIASES

    known = vocab.ADDON_UNITS | {u.lower() for u in extra_units}
    return N.singular(_text(unit)).isin(*sorted(ALIASES)) | F.lower(_text(unit)).isin(*sorted(known))


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


_M = "struct<unit:string,value:double,upper_value:double>"
_CALC = pa.struct([("unit", pa.string()), ("value", pa.float64()), ("upper_value", pa.float64())])


def _over_measures(f: Callable, kind: pa.DataType, sql: str | DataType, *more: str):
    """An SQL function of a measure and further columns; null where a needed one is."""

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([None if any(v is None for v in row) or row[0]["value"] is None or row[0]["unit"] is None else f(*row) for row in zip(*(c.to_pylist() for c in columns))], kind)

    names = ("m", *more)
    env: dict = {"run": run, "pa": pa}
    exec(f"def call({', '.join(f'{n}: pa.Array' for n in names)}) -> pa.Array:\n    return run({', '.join(names)})", env)
    return F.arrow_udf(env["call"], sql)


def register(spark: SparkSession, extra_units: tuple[str, ...] = ()) -> None:
    """The functions under their SQL names. `extra_units` are countable units beyond the built-in ones, singular and plural each.

    Of measures: format_amount, format_amount_value, amount_kind, scale_amount, conv_amount_to_kind, conv_amount_to_unit,
    conv_amount_to_nutrients; of mappings: parse_unit_mapping, graph_unit_mappings; of texts: parse_ingredient, decompose_ingredient,
    parse_amount, parse_rich_text, is_valid_unit, scrape, ingredient_passes, ingredient_trace. A measure is any struct with unit,
    value and upper_value, a mapping any struct with a and b. What can't be converted is null.
    """
    from larder.kernel import convert as C
    from larder.kernel import measures as M
    from larder.operators.recipes import scraped

    extra = tuple(extra_units)
    one = {
        "parse_ingredient": (lambda t: _ingredient(t, extra), _INGREDIENT, T.INGREDIENT),
        "parse_amount": (lambda t: _amounts(t, extra), _MEASURES, T.MEASURES),
        "decompose_ingredient": (_decomposed, _SPANS, T.SPANS),
        "ingredient_passes": (_passes, pa.list_(pa.string()), "array<string>"),
        "ingredient_trace": (_trace_text, pa.string(), "string"),
        "parse_unit_mapping": (_mapping, _MAPPING, T.MAPPING),
        "is_valid_unit": (lambda t: M.is_known(t, _parser(extra).addons), pa.bool_(), "boolean"),
    }
    for name, (kernel, kind, sql) in one.items():
        spark.udf.register(name, arrow_function(kernel, kind, sql))
    of = lambda d: M.measure(d["unit"], d["value"], d.get("upper_value"))
    plain = lambda m: None if m is None else {"unit": M.shown(m[0]), "value": float(m[1]), "upper_value": None if m[2] is None else float(m[2])}

    def whole(x) -> bool:
        return x is not None and all(x.get(k) and x[k]["unit"] is not None and x[k]["value"] is not None for k in ("a", "b"))

    def graph(mappings):
        return C.make_graph([(of(x["a"]), of(x["b"])) for x in mappings if whole(x)])

    def to(kind: str, d: dict, mappings) -> dict | None:
        got = C.convert(of(d), kind, graph(mappings))
        return plain(got[0] if got else None)

    spark.udf.register("format_amount", _over_measures(lambda d: M.display(of(d)), pa.string(), "string"))
    spark.udf.register("format_amount_value", _over_measures(lambda d: int(d["value"] * 1000) / 1000, pa.float64(), "double"))
    spark.udf.register("amount_kind", _over_measures(lambda d: M.kind_of(of(d)[0]), pa.string(), "string"))
    spark.udf.register("scale_amount", _over_measures(lambda d, by: plain(M.scale(of(d), float(by))), _CALC, _M, "factor"))
    spark.udf.register("conv_amount_to_kind", _over_measures(lambda d, kind, g: to(M.parse_kind(kind), d, g), _CALC, _M, "kind", "mappings"))
    spark.udf.register("conv_amount_to_unit", _over_measures(lambda d, unit, g: to(C.target_kind(unit), d, g), _CALC, _M, "unit", "mappings"))
    spark.udf.register("conv_amount_to_nutrients", _over_measures(lambda d, names, g: [(n, to(f"nutrient:{n}", d, g)) for n in dict.fromkeys(names) if n is not None], pa.map_(pa.string(), _CALC), f"map<string,{_M}>", "names", "mappings"))

    def dots(mappings: pa.Array) -> pa.Array:
        return pa.array([None if g is None else C.dot(graph(g)) for g in mappings.to_pylist()], pa.string())

    spark.udf.register("graph_unit_mappings", F.arrow_udf(dots, "string"))

    def chunked(text: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _chunks(t, tuple(x for x in n or () if x), extra) for t, n in zip(text.to_pylist(), names.to_pylist())], _CHUNKS)

    spark.udf.register("parse_rich_text", F.arrow_udf(chunked, T.CHUNKS))
    spark.udf.register("scrape", scraped.function())
