"""Labelled lines: scoring, coverage of passes, and rankings of what is missed."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions import native as N
from larder.functions import parsing as P
from larder.functions.arrow import arrow
from larder.kernel.line import stage_names
from larder.kernel.measures import fraction_text, parse_fraction, rational, shown, unit_of

FIELDS = tuple("name amounts modifier optional usage".split())
LABELS = f"struct<input:string,name:string,amounts:{P.T.MEASURES},modifier:string,optional:boolean,usage:string,xfail:string>"
_LABELS = pa.struct([("input", pa.string()), ("name", pa.string()), ("amounts", P._MEASURES), ("modifier", pa.string()), ("optional", pa.bool_()), ("usage", pa.string()), ("xfail", pa.string())])


def _labels(text: str) -> tuple[dict | None, str | None]:
    def value(v):
        if isinstance(v, str):
            return parse_fraction(v)
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise ValueError(f"no amount: {v!r}")
        return rational(float(v))

    try:
        d = json.loads(text)
        amounts = [P.measure_row((unit_of(a["unit"]), value(a["value"]), None if a.get("upper_value") is None else value(a["upper_value"]))) for a in d.get("amounts") or []]
        return {"input": d["input"], "name": d.get("name", ""), "amounts": amounts, "modifier": d.get("modifier"), "optional": d.get("optional", False), "usage": d.get("usage", "normal"), "xfail": d.get("xfail")}, None
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return None, f"{type(e).__name__}: {e}"


@arrow(f"struct<labels:{LABELS},problem:string>")
def read_labels(text: pa.Array) -> pa.Array:
    read = lambda t: dict(zip(("labels", "problem"), _labels(t) if t is not None else (None, None)))
    return P.by_equal(text.to_pylist(), read, pa.struct([("labels", _LABELS), ("problem", pa.string())]))


def fill_sections(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(…, section): the last header "// --- Name ---" at or before each line, in the order of `pos` within the keys."""
    header = F.nullif(F.regexp_extract("text", r"^\s*//\s*-{3,}\s*(.+?)\s*-{3,}\s*$", 1), F.lit(""))
    w = Window.partitionBy(*(keys or [])).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(header, ignorenulls=True).over(w))


def parse_corpus(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, pos, section, labels, problem) of JSON lines (keys, pos, text); comments and blank lines are passed over, and a bad line is a
    row with a problem, never lost. Without keys the lines are one file, and its sections are filled in one task."""
    rows = fill_sections(lines, keys).where(~F.col("text").rlike(r"^\s*(//.*)?$"))
    return rows.withColumn("__r", read_labels("text")).select(*(keys or []), "pos", "section", "__r.labels", "__r.problem")


def strict(corpus: DataFrame) -> DataFrame:
    """The rows, or ValueError with all problems when there is any; what makes none is on the driver only as its problems."""
    bad = corpus.where("problem is not null").orderBy("pos").select("pos", "problem").toLocalIterator()
    said = "; ".join(f"line {r['pos']}: {r['problem']}" for r in bad)
    if said:
        raise ValueError(said)
    return corpus


def sections(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`run`: number of each stretch of neighbouring rows with one section, in the order of `pos` within the keys."""
    w = Window.partitionBy(*keys).orderBy("pos")
    new = ~F.col("section").eqNullSafe(F.lag("section").over(w)) | (F.row_number().over(w) == 1)
    return rows.withColumn("__new", new.cast("int")).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def score(corpus: DataFrame) -> DataFrame:
    """The rows of (labels) with `parsed`, `differs` (fields that don't agree) and `status`: exact, promote, xfail or regression."""
    rows = corpus.withColumn("parsed", P.parse_line("labels.input"))
    exact = lambda a: F.transform(a, lambda m: F.struct(*(m[k] for k in ("unit", "num", "den", "upper_num", "upper_den"))))
    same = {k: F.col(f"parsed.{k}").eqNullSafe(F.col(f"labels.{k}")) for k in FIELDS if k != "amounts"}
    same["amounts"] = exact(F.col("parsed.amounts")).eqNullSafe(exact(F.col("labels.amounts")))
    rows = rows.withColumn("differs", F.filter(F.array(*(F.when(~same[k], k) for k in FIELDS)), lambda x: x.isNotNull()))
    right, excused = F.size("differs") == 0, F.col("labels.xfail").isNotNull()
    return rows.withColumn("status", F.when(right & excused, "promote").when(right, "exact").when(excused, "xfail").otherwise("regression"))


def tally(scored: DataFrame) -> DataFrame:
    """One row: counts by status, rows matched, and rows in which each field agrees."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    fields = [F.count_if(~F.array_contains("differs", k)).alias(f"{k}_matched") for k in FIELDS]
    return scored.agg(F.count("*").alias("total"), *map(count, ("exact", "promote", "xfail", "regression")), F.count_if(F.col("status").isin("exact", "promote")).alias("matched"), *fields)


def stages(spark: SparkSession) -> DataFrame:
    """(stage, pass, ord): every pass there is."""
    return spark.createDataFrame([(s, p, i) for i, (s, p) in enumerate(stage_names())], "stage string, pass string, ord int")


def pass_coverage(lines: DataFrame, line: str = "line") -> DataFrame:
    """(stage, pass, n_lines, share): on how many lines each pass left a mark; passes that never did have 0."""
    spark = lines.sparkSession
    fired = lines.select(F.explode(F.array_distinct(P.passes(line))).alias("pass")).groupBy("pass").agg(F.count("*").alias("n"))
    total = lines.agg(F.count("*").alias("total"))
    made = stages(spark).join(fired, "pass", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return made.select("stage", "pass", n.alias("n_lines"), F.when(F.col("total") > 0, n / F.col("total")).otherwise(0.0).alias("share"))


def unfired(lines: DataFrame, line: str = "line") -> DataFrame:
    """(stage, pass) of passes that left no mark on any line."""
    fired = lines.select(F.explode(F.array_distinct(P.passes(line))).alias("pass")).distinct()
    return stages(lines.sparkSession).join(fired, "pass", "left_anti").select("stage", "pass")


def ranked_misses(lines: DataFrame, line: str = "line", top: int | None = 50) -> DataFrame:
    """(line, n): lines with a digit but no amount, by how often they occur, then by text; the `top` of them, or all with None.

    Lines are counted before they are parsed, so a line is parsed once however often it occurs.
    """
    counted = lines.where(F.col(line).rlike("[0-9]")).groupBy(F.col(line).alias("line")).agg(F.count("*").alias("n"))
    missed = counted.withColumn("__p", P.parse_line("line")).where("__p.parse_notes.unparsed_digit").select("line", "n")
    ranked = missed.orderBy(F.desc("n"), "line")
    return ranked if top is None else ranked.limit(top)


def order_parsed(rows: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Rows with `line` and `parsed` sorted by input, name, amounts, modifier or confidence (low, medium, high)."""
    key = {"input": F.col("line"), "name": F.col("parsed.name"), "amounts": F.array_join(F.transform("parsed.amounts", N.display_measure), ", "), "modifier": F.coalesce("parsed.modifier", F.lit("")), "confidence": N.confidence_rank("parsed")}[by]
    return rows.orderBy(key.desc() if descending else key.asc(), "line")


def _corpus_row(line: str) -> tuple[str | None, str | None]:
    r = P._parser(()).parse(line)
    if r.reasons() or not r.name.strip():
        return None, (r.reasons() or ["empty_name"])[0]

    def number(v):
        return fraction_text(v) or (int(v) if v.denominator == 1 else float(v))

    d: dict = {"input": line, "name": r.name}
    if r.amounts:
        d["amounts"] = [{"unit": shown(u), "value": number(v)} | ({} if w is None else {"upper_value": number(w)}) for u, v, w in r.amounts]
    d |= {"modifier": r.modifier} if r.modifier else {}
    d |= {"optional": True} if r.optional else {}
    d |= {"usage": r.usage} if r.usage != "normal" else {}
    return json.dumps(d, ensure_ascii=False), None


@arrow("struct<json:string,refused:string>")
def corpus_row(line: pa.Array) -> pa.Array:
    """A line as a labelled row of JSON, or why it makes none: fell_back, unparsed_digit or empty_name."""
    read = lambda t: dict(zip(("json", "refused"), _corpus_row(t) if t is not None else (None, None)))
    return P.by_equal(line.to_pylist(), read, pa.struct([("json", pa.string()), ("refused", pa.string())]))


FILTERS = {"all": None, "regressions": "regression", "promotes": "promote", "xfails": "xfail"}


def by_status(scored: DataFrame, which: str = "all") -> DataFrame:
    """The scored rows that a filter (a key of FILTERS) lets through, in the order of `pos`."""
    status = FILTERS[which]
    return (scored if status is None else scored.where(F.col("status") == status)).orderBy("pos")


def same_ingredient(a: Column, b: Column) -> Column:
    """Whether two INGREDIENTs are equal; how sure the reading is doesn't count, and null equals null."""
    return N.ingredient_key(a).eqNullSafe(N.ingredient_key(b))


def amount_table(rows: DataFrame, parsed: str = "parsed") -> DataFrame:
    """(line, unit, value, upper_value, shown): a row for each amount of each line, for show()."""
    m = rows.select("line", F.explode(f"{parsed}.amounts").alias("m"))
    return m.select("line", "m.unit", "m.value", "m.upper_value", N.display_measure("m").alias("shown"))


def html_rows(scored: DataFrame, *keep: str) -> DataFrame:
    """(section, pos, keep, html): a table row for each scored row, parsed beside labelled, to be written in any number of files."""
    cell = lambda c: F.concat(F.lit("<td>"), _escaped(F.coalesce(c, F.lit(""))), F.lit("</td>"))
    amounts = lambda c: F.array_join(F.transform(c, N.display_measure), ", ")
    cells = [F.col("labels.input"), F.col("parsed.name"), amounts("parsed.amounts"), F.col("parsed.modifier"), F.col("labels.name"), amounts("labels.amounts"), F.col("labels.modifier"), F.col("status")]
    return scored.select("section", "pos", *keep, F.concat(F.lit("<tr>"), *map(cell, cells), F.lit("</tr>")).alias("html"))


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_table(scored: DataFrame) -> str:
    """A page with all scored rows by section, for people to read; rows come one partition at a time. For many rows write html_rows()."""
    from html import escape

    out, last = ["<table>"], object()
    for r in html_rows(scored).orderBy("pos").toLocalIterator():
        if r["section"] != last:
            out.append(f'<tr><th colspan="8">{escape(r["section"] or "")}</th></tr>')
            last = r["section"]
        out.append(r["html"])
    return "\n".join([*out, "</table>"])
