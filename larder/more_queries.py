"""Further registered queries: an operator each, over lines, pages, books and payloads that are made from the tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions import native as N
from larder.functions import parsing as P
from larder.operators import books, conversion, corpus, extraction, measures, recipes
from larder.plans import kitchen
from larder.queries import amount, base, counted, once, part_rows, query, table, text
from larder.runtime import materialize, scratch_path, ship
from larder.sources import readers, writers

_OUT = {
    "food": lambda: F.col("p.name"), "modifier": lambda: F.col("p.modifier"), "optional": lambda: F.col("p.optional"), "usage": lambda: F.col("p.usage"), "n_amounts": lambda: F.size("p.amounts").cast("bigint"),
    "confidence": lambda: F.col("p.parse_notes.confidence"), **{f: (lambda k=0, f=f: amount(k, f)) for f in ("unit", "value", "upper_value", "num", "den")}, **{f"{f}2": (lambda f=f: amount(1, f)) for f in ("unit", "value")},
}


def _made(template: str) -> Column:
    """A line of a template such as "{n} cups {name}"."""
    return text(*(f"@{x[1:-1]}" if re.fullmatch(r"\{\w+\}", x) else x for x in re.split(r"(\{\w+\})", template) if x))


def _rows(spark: SparkSession, sf_dir: str, template: str, *more: str) -> DataFrame:
    """The distinct values that a template names, with `__n`."""
    return once(spark, sf_dir, *dict.fromkeys([*re.findall(r"\{(\w+)\}", template), *more]))


def _sql(columns: dict[str, str]) -> str:
    return "{BASE} SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + ", count(*) AS n_rows FROM t GROUP BY ALL"


def line(name: str, template: str, units: tuple[str, ...] = (), **out: str) -> None:
    """A query that parses a line made by the template; `out` says in SQL what each part must be."""

    @query(name, _sql(out))
    def _(spark, sf_dir):
        rows = _rows(spark, sf_dir, template).withColumn("p", P.parse_line(_made(template), units))
        return counted(rows, *(_OUT[c]().alias(c) for c in out))


def rewrite(name: str, template: str, clean: str, **out: str) -> None:
    """The same for a rewrite: the native rewrites of the line, and its parse."""

    @query(name, _sql({"line": clean} | out))
    def _(spark, sf_dir):
        rows = N.normalize_lines(_rows(spark, sf_dir, template).withColumn("raw", _made(template)), "raw", "line").withColumn("p", P.parse_line("raw"))
        return counted(rows, F.col("line"), *(_OUT[c]().alias(c) for c in out))


_N, _D = "CAST(n AS DOUBLE)", "'{}'".format

rewrite("rewrite_nbsp", "{n} cups {name}", "n || ' cups ' || name", food="name", unit="'cup'", value=_N)
rewrite("rewrite_footnotes", "{n} cups {name}①", "n || ' cups ' || name", food="name", value=_N)
rewrite("rewrite_crossref_optional", "{n} cups {name} (this page; optional)", "n || ' cups ' || name || ' (optional)'", food="name", optional="true")
rewrite("rewrite_batches", "{n} batches of {noun}", "n || ' recipe ' || noun", food="noun", unit="'recipe'", value=_N)
rewrite("rewrite_minus", "{n} g (1 kg minus {a} g) {name}", "n || ' g ' || name", food="name", unit="'g'", value=_N, n_amounts="CAST(1 AS BIGINT)")
rewrite("rewrite_minus_kept", "{name} (1 cup minus {a} g)", "name || ' (1 cup minus ' || a || ' g)'", food="name", n_amounts="CAST(0 AS BIGINT)")
rewrite("rewrite_total", "{n} cups {name} ({a} g total)", "n || ' cups ' || name || ' (' || a || ' g)'", food="name", unit2="'g'", value2="CAST(a AS DOUBLE)")
rewrite("rewrite_dimension", "{n} ½-inch-thick slices {noun}", "n || ' slices ' || noun || ', ½-inch-thick'", food="noun", unit="'slice'", value=_N, modifier="'½-inch-thick'")
rewrite("rewrite_piece_dimension", "2-inch piece ({n} ounces) {noun}", "'1 piece (' || n || ' ounces) ' || noun || ', 2-inch'", food="noun", unit="'piece'", value="CAST(1 AS DOUBLE)", unit2="'oz'", value2=_N, modifier="'2-inch'")
line("lift_descriptive_paren", "{n} cups {noun} (about 110°F) mix", food="noun || ' mix'", modifier="'about 110°F'", unit="'cup'", value=_N)

line("parse_hyphen_unit", "{n}-inch {noun}", unit="'\"'", value=_N, food="noun")
line("parse_fluid_ounces", "{n} fl. oz. {name}", unit="'fl oz'", value=_N, food="name")
line("parse_tablespoon_letter", "{n} T {noun}", unit="'tbsp'", value=_N, food="noun")
line("parse_teaspoon_letter", "{n} t {noun}", unit="'tsp'", value=_N, food="noun")
line("parse_qualifier_between", "{n} heaping cups {name}", unit="'cup'", value=_N, food="name")
line("parse_thousands", "{n},500 g {name}", unit="'g'", value="CAST(n * 1000 + 500 AS DOUBLE)", food="name")
line("parse_word_number", "three cups {name}", unit="'cup'", value="CAST(3 AS DOUBLE)", food="name")
line("parse_nested_parens", "((({n} cups))) {noun}", unit="'cup'", value=_N, food="noun")
line("parse_exact_thirds", "{a}/7 cup {name}", unit="'cup'", num="CAST(a // gcd(a, 7) AS BIGINT)", den="CAST(7 // gcd(a, 7) AS BIGINT)", food="name")
line("parse_given_units", "{n} scoops {noun}", units=("scoop", "scoops"), unit="'scoop'", value=_N, food="noun")
line("parse_malformed_falls_back", "{n}e{noun}", food="n || 'e' || noun", confidence="'low'", n_amounts="CAST(0 AS BIGINT)")

line("repair_prep_phrase", "{n} cups chopped, {noun}", food="noun", modifier="'chopped'", unit="'cup'")
line("repair_minus_clause", "1 cup minus {a} tablespoons {noun}", food="noun", modifier="'minus ' || a || ' tablespoons'", unit="'cup'")
line("repair_head_noun", "{n} cups coarsely chopped, raw {noun}", food="'raw ' || noun", modifier="'coarsely chopped'")
line("repair_alias", "{n} cups {noun} (kasha) groats", food="noun || ' (kasha) groats'", unit="'cup'")
line("repair_shared_head", "{noun}, sunflower, or roasted walnut oil", food="noun || ' oil'", modifier="'or sunflower, or roasted walnut oil'")
line("refine_postfix_unit", "{n} garlic cloves", food="'garlic'", unit="'clove'", value=_N)
line("refine_prep_alternative", "{n} cups grated or finely chopped {noun} zest", food="noun || ' zest'", modifier="'grated or finely chopped'")
line("refine_trailing_clause", "{n} cups {noun} mixed with water", food="noun", modifier="'mixed with water'")
line("refine_wrapped_modifier", "{n} cups {noun} (drained)", food="noun", modifier="'drained'")
line("usage_pan_grease", "{n} g {noun}, for greasing", usage="'pan_grease'", food="noun")
line("usage_marinade", "{n} g {noun}, for the marinade", usage="'marinade'", food="noun")
line("usage_word_bounds", "{n} g {noun}, for dustings", usage="'normal'", food="noun")
line("usage_surplus", "{n} g {noun}, plus more for dusting", usage="'normal'", food="noun")


@query("usage_by_section", "{BASE} SELECT CASE WHEN a % 3 = 0 THEN 'marinade' WHEN a % 3 = 1 THEN 'normal' ELSE 'garnish' END AS usage, count(*) AS n_rows FROM t GROUP BY 1")
def _(spark, sf_dir):
    section = F.when(F.col("a") % 3 == 1, "For the brined pork").otherwise("For the Brine")
    rows = once(spark, sf_dir, "a", "n", "noun").withColumn("p", P.parse_line(F.when(F.col("a") % 3 == 2, _made("{n} g {noun}, for garnish")).otherwise(_made("{n} g {noun}"))))
    native, kernel = N.section_usage("p.usage", section), P.classify_usage("p.name", "p.modifier", _made("{n} g {noun}"), section)
    return counted(rows, F.when((native == kernel) | (native == "garnish"), native).otherwise("they differ").alias("usage"))


@query("clause_parens", _sql({"kinds": "'prep_chain,minus_measure,prose,head_candidate'", "parens": "'cross_reference|note_reference|optional,descriptive,amount,alias,other|minus_equivalence'", "stripped": "'minced and dried|minus ' || a || ' cup|with care|' || noun"}))
def _(spark, sf_dir):
    made = _made("minced and dried (see page {n}), minus {a} cup (see note), with care (optional) (110°F) ({n} g) (kasha) (no. {n} of those), {noun} (2 cups minus {a} g)")
    rows = once(spark, sf_dir, "n", "a", "noun").withColumn("c", P.clauses(made))
    each = lambda f, sep: F.array_join(F.transform("c", f), sep)
    return counted(rows, each(lambda c: c["kind"], ",").alias("kinds"), each(lambda c: F.array_join(c["parens"], ","), "|").alias("parens"), each(lambda c: c["stripped"], "|").alias("stripped"))


@query("amount_strings", "{BASE} SELECT CASE a % 3 WHEN 0 THEN '$' WHEN 1 THEN 'lb' END AS unit, CASE WHEN a % 3 < 2 THEN CAST(n AS DOUBLE) END AS value, a % 3 = 2 AS failed, count(*) AS n_rows FROM t GROUP BY ALL")
def _(spark, sf_dir):
    made = F.when(F.col("a") % 3 == 0, _made("${n}")).when(F.col("a") % 3 == 1, _made("{n} lb")).otherwise(_made("{n}"))
    rows = once(spark, sf_dir, "a", "n").withColumn("m", P.parse_amount_string(made))
    return counted(rows, F.col("m.measure.unit").alias("unit"), F.col("m.measure.value").alias("value"), F.col("m.error").isNotNull().alias("failed"))


# prose


def _chunks(rows: DataFrame) -> Column:
    one = lambda c: F.concat(c["kind"], F.lit(":"), F.coalesce(c["text"], F.array_join(F.transform(c["measures"], lambda m: F.concat(m["value"].cast("int").cast("string"), F.lit(" "), m["unit"])), "+")))
    return F.array_join(F.transform("c", one), "|").alias("chunks")


def prose(name: str, template: str, names: str, chunks: str) -> None:
    @query(name, _sql({"chunks": chunks}))
    def _(spark, sf_dir):
        rows = _rows(spark, sf_dir, template, *names.split()).withColumn("c", P.rich_text(_made(template), F.array(*(F.col(x) for x in names.split()))))
        return counted(rows, _chunks(rows))


prose("prose_step_numbers", "Step {n} Boil the {noun} well", "noun", "'text:Step ' || n || ' Boil the |ing:' || noun || '|text: well'")
prose("prose_number_before_stop", "Bake {n} minutes. Cool {a}.", "noun", "'text:Bake |measure:' || n || ' minute|text:. Cool |measure:' || a || ' whole|text:.'")
prose("prose_ends_at_mark", "Stir the {noun} & wait {n} minutes", "noun", "'text:Stir the |ing:' || noun || '|text: '")
prose("prose_longest_name", "Wash {name} and {noun} and {noun}ish", "name noun", "'text:Wash |ing:' || name || '|text: and |ing:' || noun || '|text: and ' || noun || 'ish'")
prose("prose_plural_names", "Mix {noun}s well", "noun", "'text:Mix |ing:' || noun || 's|text: well'")
prose("prose_condensed", "Rest it for {n} minutes (about {a} g) now", "noun", "'text:Rest it for |measure:' || n || ' minute+' || a || ' g|text: now'")


# measures


@query("unit_validity", "{BASE} SELECT a % 3 <> 2 AS valid, a % 3 = 0 AS known, count(*) AS n_rows FROM t GROUP BY ALL")
def _(spark, sf_dir):
    unit = F.when(F.col("a") % 3 == 0, "Sprigs").when(F.col("a") % 3 == 1, "scoops").otherwise(_made("{noun}ish"))
    return counted(base(spark, sf_dir), P.is_valid_unit(unit, ("scoop", "scoops")).alias("valid"), P.is_valid_unit(unit).alias("known"))


_KIND = ["weight", "volume", "money", "time", "temperature", "calories", "other:clove"]
_BASE_UNIT = ["g", "ml", "cent", "second", "fahrenheit", "kcal", "clove"]


@query("kind_bases", "{BASE} SELECT " + f"list_value({', '.join(map(repr, _BASE_UNIT))})[a % 7 + 1] AS unit, a % 7 IN (0, 1, 6) AS scales, count(*) AS n_rows FROM t GROUP BY ALL")
def _(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _KIND)), F.col("a") % 7 + 1)
    return counted(base(spark, sf_dir), N.base_unit(kind).alias("unit"), N.is_scalable(kind).alias("scales"))


@query("nutrient_kinds", "{BASE} SELECT CASE a % 3 WHEN 0 THEN 'nutrient:g protein' WHEN 1 THEN 'nutrient:mg sodium' ELSE 'other:g ' || noun END AS kind, count(*) AS n_rows FROM t GROUP BY ALL")
def _(spark, sf_dir):
    unit = F.when(F.col("a") % 3 == 0, "g protein").when(F.col("a") % 3 == 1, "mg sodium").otherwise(_made("g {noun}"))
    return counted(base(spark, sf_dir), N.unit_kind(unit).alias("kind"))


@query("ascii_quantities", "{BASE} SELECT n || CASE WHEN a % 8 = 0 THEN '' ELSE ' ' || (a % 8 // gcd(a % 8, 8)) || '/' || (8 // gcd(a % 8, 8)) END AS shown, count(*) AS n_rows FROM t GROUP BY ALL")
def _(spark, sf_dir):
    return counted(once(spark, sf_dir, "n", "a"), N.format_quantity_ascii(F.col("n") + F.col("a") % 8 / 8).alias("shown"))


@query("truncations", "{BASE} SELECT trunc((n + a / 7.0) * 1000) / 1000 AS value, CASE WHEN length(name) <= 9 THEN name ELSE left(name, 9) || '...' END AS short, count(*) AS n_rows FROM t GROUP BY ALL")
def _(spark, sf_dir):
    return counted(once(spark, sf_dir, "n", "a", "name"), N.truncate_number(F.col("n") + F.col("a") / 7.0).alias("value"), N.truncate_text("name", 9).alias("short"))


@query("scaled_ingredients", _sql({"food": "name", "value": "n * 2.5", "unit2": "'minute'", "value2": "CAST(a AS DOUBLE)"}))
def _(spark, sf_dir):
    rows = once(spark, sf_dir, "n", "a", "name").withColumn("p", P.parse_line(_made("{n} cups / {a} minutes {name}")))
    return counted(measures.scale_ingredients(rows, 2.5, "p"), *(_OUT[c]().alias(c) for c in ("food", "value", "unit2", "value2")))


@query("equal_ingredients", _sql({"same": "a = n"}))
def _(spark, sf_dir):
    rows = once(spark, sf_dir, "n", "a", "name").withColumns({"p": P.parse_line(_made("{n} cups {name}, sifted")), "q": P.parse_line(_made("{a} cup {name}, sifted"))})
    rows = rows.withColumn("q", F.col("q").withField("parse_notes", F.col("q.parse_notes").withField("confidence", F.lit("low"))))
    return counted(rows, corpus.same_ingredient(F.col("p"), F.col("q")).alias("same"))


# conversion


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = part_rows(spark, sf_dir).where("p_size > 0").select(F.col("p_partkey").cast("string").alias("graph_id"), "p_size")
    rows = parts.select("graph_id", F.explode(F.array(F.lit("1 cup = 120 g"), F.concat(F.lit("1 stick = "), F.col("p_size").cast("string"), F.lit(" g")))).alias("t"))
    rows = rows.withColumn("seq", F.when(F.col("t").startswith("1 cup"), 0).otherwise(1)).withColumn("m", P.parse_mapping("t"))
    nutrient = parts.select("graph_id", F.lit(2).alias("seq"), _m("g", F.lit(100.0)).alias("a"), _m("g protein", F.col("p_size")).alias("b"))
    return rows.select("graph_id", "seq", *(F.struct(*(F.col(f"m.{s}.{k}").alias(k) for k in ("unit", "value", "upper_value"))).alias(s) for s in ("a", "b"))).unionByName(nutrient)


def _m(unit: str, value: Column) -> Column:
    return F.struct(F.lit(unit).alias("unit"), value.cast("double").alias("value"), F.lit(None).cast("double").alias("upper_value"))


_SIG6 = "floor({x} * pow(10.0, 5 - floor(log10({x}))) + 0.5) / pow(10.0, 5 - floor(log10({x})))"


@query("convert_to_unit", "SELECT p_partkey, 'stick' AS unit, round(" + _SIG6.format(x="(240.0 / p_size)") + ", 9) AS value FROM part WHERE p_size > 0")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", F.col("p_partkey").cast("string").alias("graph_id"), _m("cup", F.lit(2)).alias("measure"))
    made = conversion.convert(rows, conversion.closure(_stated(spark, sf_dir), [conversion.goal_unit("sticks", True)]), "sticks", unit=True)
    return made.select("p_partkey", F.col("converted.unit").alias("unit"), F.round("converted.value", 9).alias("value"))


@query("convert_to_nutrients", "SELECT p_partkey, round(" + _SIG6.format(x="(50.0 * p_size / 100.0)") + ", 9) AS protein, true AS no_sodium FROM part WHERE p_size > 0")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", F.col("p_partkey").cast("string").alias("graph_id"), _m("g", F.lit(50)).alias("measure"))
    made = conversion.convert_to_nutrients(rows, conversion.closure(_stated(spark, sf_dir)), ["g protein", "mg sodium"])
    return made.select("p_partkey", F.round(F.col("nutrients")["g protein"]["value"], 9).alias("protein"), F.col("nutrients")["mg sodium"].isNull().alias("no_sodium"))


@query("convert_pinches", "{BASE} SELECT CASE WHEN n < 12 * 4 THEN 'tsp' ELSE 'tbsp' END AS unit, round(CASE WHEN n < 48 THEN n / 16.0 ELSE n / 48.0 END, 9) AS value, count(*) AS n_rows FROM (SELECT n FROM t) WHERE n > 0 GROUP BY ALL")
def _(spark, sf_dir):
    m = F.struct(F.lit("pinch").alias("unit"), F.col("n").cast("double").alias("value"), F.lit(None).cast("double").alias("upper_value"))
    rows = base(spark, sf_dir).where("n > 0").select(F.lit("g").alias("graph_id"), "n", m.alias("measure"))
    stated = spark.createDataFrame([("g", 0, ("tsp", 1.0, None), ("g", 5.0, None))], f"graph_id string, seq int, a {P._M}, b {P._M}")
    made = conversion.convert(rows, conversion.closure(stated, ["tsp"]), "tsp", unit=True)
    return counted(made, F.col("converted.unit").alias("unit"), F.round("converted.value", 9).alias("value"))


@query("graph_text", "SELECT a.n_name AS graph_id, 'digraph {' || chr(10) || '    0 [ label = \"g\", class = \"weight\" ]' || chr(10) || '    1 [ label = \"clove\", class = \"other\" ]' || chr(10) || '    0 -> 1 [ label = \"' || (a.n_nationkey + 1) || '\", dir = \"both\" ]' || chr(10) || '}' || chr(10) AS dot FROM nation a")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("graph_id"), F.lit(0).alias("seq"), _m("g", F.lit(1)).alias("a"), _m("clove", F.col("n_nationkey") + 1).alias("b"))
    return conversion.dot(rows)


# SQL names


@query("sql_functions", "{BASE} SELECT name AS food, n || CASE WHEN n > 1 THEN ' cups' ELSE ' cup' END AS shown, CAST(n AS DOUBLE) AS plain, 'volume' AS kind, CAST(2 * n AS DOUBLE) AS twice, true AS valid, CAST(n * 120 AS DOUBLE) AS grams, n * 4.0 AS sticks, CAST(n * 24 AS DOUBLE) AS protein, CAST(3 AS BIGINT) AS n_spans, CAST(3 AS BIGINT) AS n_chunks, 'lb' AS stated, true AS graph, count(*) AS n_rows FROM t WHERE n BETWEEN 1 AND 3 GROUP BY ALL")
def _(spark, sf_dir):
    P.register(spark)
    base(spark, sf_dir).where("n between 1 and 3").createOrReplaceTempView("larder_lines")
    return spark.sql("""
        WITH x AS (SELECT *, parse_ingredient(concat(n, ' cups ', name, ', sifted')) AS p FROM larder_lines),
        y AS (SELECT *, p.amounts[0] AS m, array(named_struct('a', named_struct('unit', 'cup', 'value', 1D, 'upper_value', CAST(NULL AS DOUBLE)), 'b', named_struct('unit', 'g', 'value', 120D, 'upper_value', CAST(NULL AS DOUBLE))),
            named_struct('a', named_struct('unit', 'stick', 'value', 1D, 'upper_value', CAST(NULL AS DOUBLE)), 'b', named_struct('unit', 'g', 'value', 30D, 'upper_value', CAST(NULL AS DOUBLE))),
            named_struct('a', named_struct('unit', 'g', 'value', 5D, 'upper_value', CAST(NULL AS DOUBLE)), 'b', named_struct('unit', 'g protein', 'value', 1D, 'upper_value', CAST(NULL AS DOUBLE)))) AS g FROM x)
        SELECT p.name AS food, format_amount(m) AS shown, format_amount_value(m) AS plain, amount_kind(m) AS kind, scale_amount(m, 2D).value AS twice, is_valid_unit('cups') AS valid,
            conv_amount_to_kind(m, 'weight', g).value AS grams, conv_amount_to_unit(m, 'sticks', g).value AS sticks, conv_amount_to_nutrients(m, array('g protein'), g)['g protein'].value AS protein,
            CAST(size(decompose_ingredient(concat(n, ' cups ', name, ', sifted')).spans) AS BIGINT) AS n_spans, CAST(size(parse_rich_text(concat('Mix ', name, ' well'), array(name))) AS BIGINT) AS n_chunks,
            parse_unit_mapping('$5/4lb').a.unit AS stated, graph_unit_mappings(g) LIKE 'digraph%' AS graph, count(*) AS n_rows
        FROM y GROUP BY ALL
    """)  # fmt: skip


# traces and diagnostics


@query("digit_spans", _sql({"spans": "'0-' || length(CAST(n AS VARCHAR)) || ' ' || n || ';' || (length(CAST(n AS VARCHAR)) + 1 + length(noun) + 2) || '-' || (length(CAST(n AS VARCHAR)) + 1 + length(noun) + 4) || ' ½' || a", "n_marked": "CAST(2 AS BIGINT)"}))
def _(spark, sf_dir):
    made = _made("{n}e{noun} é½{a}")
    rows = once(spark, sf_dir, "n", "a", "noun").withColumn("line", made).withColumn("p", P.parse_line("line"))
    shown = F.array_join(F.transform(N.digit_spans("line"), lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(" "), s["text"])), ";")
    return counted(rows, shown.alias("spans"), F.size(N.diagnostics("line", "p")).cast("bigint").alias("n_marked"))


@query("stage_report", _sql({"stages": "'normalize strip_leading_bullet • ' || n || ' cups chopped ' || noun || ' > ' || n || ' cups chopped ' || noun || '|recognize optional_wrapped ' || n || ' cups chopped ' || noun || ' > ✗|recognize trailing_amount ' || n || ' cups chopped ' || noun || ' > ✗|recognize x_of_construction ' || n || ' cups chopped ' || noun || ' > ✗|grammar parse_ingredient ' || n || ' cups chopped ' || noun || ' > ' || noun || '|refine extract_adjectives_from_name chopped ' || noun || ' > ' || noun || ', chopped'"}))
def _(spark, sf_dir):
    one = lambda s: F.concat(s["stage"], F.lit(" "), s["name"], F.lit(" "), s["before"], F.lit(" > "), F.coalesce(s["after"], F.lit("✗")))
    rows = once(spark, sf_dir, "n", "noun").withColumn("s", P.trace_stages(_made("• {n} cups chopped {noun}")))
    return counted(rows, F.array_join(F.transform("s", one), "|").alias("stages"))


@query("stage_text", _sql({"shown": "'input:     \"Juice of ' || n || ' cups ' || noun || '\"' || chr(10) || 'normalize: (no rewrites fired)' || chr(10) || 'recognize: optional_wrapped ✗  trailing_amount ✗  x_of_construction ✓ → ' || noun || chr(10) || 'grammar:   (skipped: a recognizer read the line)' || chr(10) || 'refine:    (no passes changed it)' || chr(10) || 'result:    name=\"' || noun || '\"' || chr(10)"}))
def _(spark, sf_dir):
    return counted(once(spark, sf_dir, "n", "noun"), P.trace_text(_made("Juice of {n} cups {noun}")).alias("shown"))


@query("trace_json", _sql({"names": "'parse_line,extract_adjectives_from_name'", "n_refs": "CAST(1 AS BIGINT)"}))
def _(spark, sf_dir):
    kind = "data array<struct<spans:array<struct<operationName:string,references:array<struct<refType:string>>>>>>"
    rows = once(spark, sf_dir, "n", "noun").withColumn("j", F.from_json(P.trace_json(_made("{n} cups chopped {noun}")), kind)["data"][0]["spans"])
    return counted(rows, F.array_join(F.transform("j", lambda s: s["operationName"]), ",").alias("names"), F.size(F.flatten(F.transform("j", lambda s: s["references"]))).cast("bigint").alias("n_refs"))


@query("fired_passes", _sql({"passes": "'strip_leading_bullet,strip_footnote_markers,extract_size_unit_from_name,extract_adjectives_from_name'"}))
def _(spark, sf_dir):
    return counted(once(spark, sf_dir, "n", "noun"), F.array_join(P.passes(_made("• {n} large chopped {noun}①")), ",").alias("passes"))


@query("amount_tables", _sql({"unit": "'cup'", "value": _N, "shown": "n || CASE WHEN n > 1 THEN ' cups' ELSE ' cup' END"}))
def _(spark, sf_dir):
    rows = base(spark, sf_dir).withColumn("line", _made("{n} cups {name}")).withColumn("parsed", P.parse_line("line"))
    return counted(corpus.amount_table(rows), F.col("unit"), F.col("value"), F.col("shown"))


@query("ordered_lines", "{BASE}, d AS (SELECT DISTINCT noun, a FROM t), c AS (SELECT noun, a, CASE WHEN a % 2 = 0 THEN a || ' g ' || noun ELSE noun || ' no' || a END AS line, CASE WHEN a % 2 = 0 THEN 2 ELSE 0 END AS r FROM d) SELECT line, CAST(row_number() OVER (ORDER BY r DESC, line) AS BIGINT) AS pos FROM c")
def _(spark, sf_dir):
    made = F.when(F.col("a") % 2 == 0, _made("{a} g {noun}")).otherwise(_made("{noun} no{a}"))
    rows = base(spark, sf_dir).select("noun", "a").distinct().select(made.alias("line")).withColumn("parsed", P.parse_line("line"))
    ordered = corpus.order_parsed(rows, "confidence", descending=True)
    return ordered.select("line", (F.monotonically_increasing_id()).alias("__i")).withColumn("pos", F.row_number().over(Window.orderBy("__i")).cast("bigint")).drop("__i")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("a") % 4
    wrong, excused = F.when(k.isin(0, 2), "wrong").otherwise(F.col("name")), F.when(k.isin(1, 2), "known")
    labels = F.to_json(F.struct(_made("{n} g {name}").alias("input"), wrong.alias("name"), F.array(F.struct(F.lit("g").alias("unit"), F.col("n").alias("value"))).alias("amounts"), excused.alias("xfail")))
    rows = once(spark, sf_dir, "a", "n", "name").select("__n", F.lit("s").alias("section"), F.lit(0).alias("pos"), labels.alias("text")).withColumn("r", corpus.read_labels("text")).select("__n", "section", "pos", "r.labels", "r.problem")
    return corpus.score(rows)


@query("status_filter", "{BASE} SELECT CASE WHEN a % 4 = 2 THEN 'xfails' WHEN a % 4 = 1 THEN 'promotes' ELSE 'regressions' END AS filter, count(*) AS n FROM t WHERE a % 4 < 3 GROUP BY 1")
def _(spark, sf_dir):
    scored = materialize(_scored(spark, sf_dir).select("pos", "status", "__n"), "scored")
    parts = [corpus.by_status(scored, f).groupBy(F.lit(f).alias("filter")).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")) for f in ("regressions", "promotes", "xfails")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("scored_html", "{BASE} SELECT '<tr><td>' || n || ' g ' || name || '</td><td>' || name || '</td><td>' || n || ' g</td><td></td><td>' || CASE WHEN a % 4 IN (0, 2) THEN 'wrong' ELSE name END || '</td><td>' || n || ' g</td><td></td><td>' || CASE a % 4 WHEN 0 THEN 'regression' WHEN 1 THEN 'promote' WHEN 2 THEN 'xfail' ELSE 'exact' END || '</td></tr>' AS html, count(*) AS n_rows FROM t GROUP BY 1")
def _(spark, sf_dir):
    return counted(corpus.html_rows(_scored(spark, sf_dir), "__n"), F.col("html"))


@query("corpus_file", "{BASE}, d AS (SELECT DISTINCT n FROM t) SELECT CASE WHEN n % 5 = 0 THEN 'bad' ELSE 'g' END AS unit, count(*) AS n, 'Made' AS section FROM d GROUP BY ALL")
def _(spark, sf_dir):
    """A labelled file that is written, read again with its sections, and refused by strict() for its bad lines."""
    rows = base(spark, sf_dir).select("n").distinct()
    good = F.to_json(F.struct(_made("{n} g oats").alias("input"), F.lit("oats").alias("name"), F.array(F.struct(F.lit("g").alias("unit"), F.col("n").alias("value"))).alias("amounts")))
    lines = rows.select(F.when(F.col("n") % 5 == 0, "{broken").otherwise(good).alias("value"))
    head = spark.range(1).select(F.lit("// --- Made ---\n\n// a remark").alias("value"))
    path = scratch_path(spark, "corpus")
    head.unionByName(lines).agg(F.array_join(F.array_sort(F.collect_list("value")), "\n").alias("value")).write.text(path)
    read = materialize(readers.read_corpus(spark, path), "corpus")
    try:
        corpus.strict(read)
        failed = 0
    except ValueError as e:
        failed = str(e).count("; line ") + 1
    bad = read.where("problem is not null")
    if failed != bad.count():
        raise AssertionError(f"{failed} problems were listed")
    return read.select(F.coalesce(F.col("labels.amounts")[0]["unit"], F.lit("bad")).alias("unit"), "section").groupBy("unit", "section").agg(F.count("*").alias("n"))


# recipes and pages


@query("recipe_shapes", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'one|two' WHEN 1 THEN 'one|two' WHEN 2 THEN 'one|two' ELSE 'one' END AS steps, CASE WHEN p_size % 4 = 3 THEN 'two' ELSE '' END AS notes, 'first' AS description, '1 hour 5 minutes' AS total, CAST(NULL AS VARCHAR) AS prep, CAST(1 AS BIGINT) AS n_sections, CAST(12 AS BIGINT) AS servings FROM part")
def _(spark, sf_dir):
    """Linked data with instructions of each shape: steps, HTML, lists of lists, sections with notes."""
    shapes = ['[{"text":"one"},{"text":"two"}]', '"<p>one</p><p>two</p>"', '[[{"text":"one"}],[{"text":"two"}]]', '[{"name":"Mix","itemListElement":[{"text":"one"}]},{"name":"Tips","itemListElement":[{"text":"two"}]}]']
    steps = F.element_at(F.array(*map(F.lit, shapes)), F.col("p_size").cast("int") % 4 + 1)
    html = F.concat(F.lit('<script type="application/ld+json">{"name":"x","description":[{"a":1},"first","second"],"recipeIngredient":["1 g salt"],"recipeYield":[12],"totalTime":["PT1H5M"],"prepTime":"soon","recipeInstructions":'), steps, F.lit("}</script>"))
    made = recipes.scrape(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("url"), html.alias("html")))
    r = F.col("recipe")
    return made.select(F.col("url").cast("bigint").alias("p_partkey"), F.array_join(r["instructions"], "|").alias("steps"), F.array_join(r["notes"], "|").alias("notes"), r["description"].alias("description"), r["total"].alias("total"), r["prep"].alias("prep"), F.size(r["sections"]).cast("bigint").alias("n_sections"), r["servings"].cast("bigint").alias("servings"))


@query("recipe_markup", "SELECT p_partkey, p_name || ' pie' AS title, p_size || ' g salt|oats' AS lines, 'Mix.|Bake.' AS steps, 'http://x.org/i.png' AS image FROM part")
def _(spark, sf_dir):
    html = F.concat(F.lit("<html><head><title>"), F.col("p_name"), F.lit(' pie</title><meta property="og:image" content="http://x.org/i.png"></head><ul><li class="jetpack-recipe-ingredient">'), F.col("p_size").cast("string"), F.lit(' g salt</li><li class="jetpack-recipe-ingredient">oats</li></ul><div class="jetpack-recipe-directions">Mix.\nBake.</div></html>'))
    r = F.col("recipe")
    made = recipes.scrape(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("url"), html.alias("html")))
    return made.select(F.col("url").cast("bigint").alias("p_partkey"), r["name"].alias("title"), F.array_join(r["ingredients"], "|").alias("lines"), F.array_join(r["instructions"], "|").alias("steps"), r["image"].alias("image"))


@query("recipe_api", "SELECT p_partkey, p_name AS title, p_size || ' g salt, ground|' || p_size || ' cups oats' AS lines, 'Mix.' AS steps FROM part")
def _(spark, sf_dir):
    item = lambda unit, title, note: F.struct(F.col("p_size").alias("quantity"), F.lit(unit).alias("unit"), F.lit(title).alias("title"), F.lit(note).alias("note"))
    body = F.to_json(F.struct(F.col("p_name").alias("title"), F.lit("u").alias("url"), F.lit("i").alias("image"), F.array(item("g", "salt", "ground"), item("cups", "oats", "")).alias("ingredients"), F.array(F.struct(F.lit("Mix.").alias("directions"))).alias("steps")))
    made = recipes.scrape(table(spark, sf_dir, "part").select(F.concat(F.lit("https://www.chefsteps.com/"), F.col("p_partkey").cast("string")).alias("url"), body.alias("html")))
    r = F.col("recipe")
    return made.select(F.substring_index("url", "/", -1).cast("bigint").alias("p_partkey"), r["name"].alias("title"), F.array_join(r["ingredients"], "|").alias("lines"), F.array_join(r["instructions"], "|").alias("steps"))


@query("notes_headings", "{BASE} SELECT a % 2 = 0 AS notes, count(*) AS n_rows FROM t GROUP BY 1")
def _(spark, sf_dir):
    return counted(base(spark, sf_dir), N.is_notes_heading(F.when(F.col("a") % 4 == 0, " Tips ").when(F.col("a") % 2 == 0, "NOTE").otherwise(F.col("noun"))).alias("notes"))


@query("made_page_lines", "SELECT p_partkey, p_name || '|' || p_size || ' g salt|Mix & wait|flour (' || p_size || ' g)|alone two|end see out' AS lines, 'see x.xhtml#p1' AS links, 'i/a.png image/png alt' AS images FROM part")
def _(spark, sf_dir):
    html = F.concat(
        F.lit("<html><head><title>no</title><script/></head><body><h1>"), F.col("p_name"), F.lit("</h1><ul><li>"), F.col("p_size").cast("string"),
        F.lit('&nbsp;g\n salt</li></ul><p>Mix &amp;\t wait<style/></p><table><tr><td>flour</td><td>'), F.col("p_size").cast("string"),
        F.lit(' g</td></tr><tr><td>alone</td><td>two</td></tr></table><p>end <a href="x.xhtml#p1">see</a> <a href="http://y.org">out</a><img src="../i/a.png" alt="alt"></p></body></html>'),
    )
    rows = part_rows(spark, sf_dir).select("p_partkey", books.page_lines(html).alias("l"))
    every = lambda part, *fields: F.array_join(F.transform(F.flatten(F.transform("l", lambda x: x[part])), lambda x: F.concat_ws(" ", *(x[f] for f in fields))), "|").alias(part)
    return rows.select("p_partkey", F.array_join(F.transform("l", lambda x: x["text"]), "|").alias("lines"), every("links", "text", "href"), every("images", "path", "mime", "alt"))


def _epubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each nation: two documents, a cover and its metadata."""

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            out = []
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
                    z.writestr("O/c.opf", f'<package xmlns:dc="d"><metadata><dc:title> {name} </dc:title><dc:creator>A{key}</dc:creator><dc:subject>Cooking</dc:subject><meta name="cover" content="cv"/></metadata><manifest><item id="p0" href="p0.xhtml" media-type="application/xhtml+xml"/><item id="p1" href="p1.xhtml" media-type="application/xhtml+xml"/><item id="cv" href="i/c.png" media-type="image/png"/></manifest><spine><itemref idref="p1"/><itemref idref="p0"/></spine></package>')
                    z.writestr("O/p0.xhtml", f"<h1>{name}</h1><p>{key} cups oats</p>")
                    z.writestr("O/p1.xhtml", "<p>Preface</p>")
                    z.writestr("O/i/c.png", f"png{key}")
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "content"])

    ship(spark)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), "n_name").mapInArrow(run, "key bigint, content binary")


@query("book_reading", "SELECT n_nationkey AS key, n_name AS title, 'A' || n_nationkey AS author, 'Cooking' AS subjects, 'Preface|' || n_name || '|' || n_nationkey || ' cups oats' AS lines, 'O/i/c.png image/png png' || n_nationkey AS cover, 'O/i/c.png' AS image FROM nation")
def _(spark, sf_dir):
    rows = materialize(_epubs(spark, sf_dir), "books")
    rows = rows.select("key", books.book_metadata("content").alias("m"), books.book_lines("content").alias("l"), books.book_cover("content").alias("c"), books.book_images("content", F.array(F.lit("O/i/c.png"), F.lit("no"))).alias("i"))
    return rows.select("key", "m.title", F.col("m.authors")[0].alias("author"), F.array_join("m.subjects", ",").alias("subjects"), F.array_join(F.transform("l", lambda x: x["text"]), "|").alias("lines"), F.concat_ws(" ", "c.path", "c.mime", F.col("c.bytes").cast("string")).alias("cover"), F.array_join(F.transform("i", lambda x: x["path"]), "|").alias("image"))


@query("book_files", "SELECT n_name AS title, CAST(3 AS BIGINT) AS n_lines FROM nation")
def _(spark, sf_dir):
    """The books as files of a folder, found and read."""
    folder = scratch_path(spark, "shelf")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        at = folder if "://" in folder else "file://" + folder.removeprefix("file:")
        system, root = fs.FileSystem.from_uri(at)
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system.create_dir(f"{root}/d{key % 3}", recursive=True)
                with system.open_output_stream(f"{root}/d{key % 3}/b{key}.EPUB", compression=None) as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["key"])

    materialize(_epubs(spark, sf_dir).mapInArrow(run, "key bigint"), "shelved")
    titles = readers.read_books(spark, folder).select(F.col("path").alias("book"), "title")
    lines = readers.read_book_lines(spark, folder).groupBy("book").agg(F.count("*").alias("n_lines"))
    return titles.join(lines, "book").select("title", "n_lines")


@query("chunk_windows", "SELECT p_partkey, CAST(i AS BIGINT) AS chunk_idx, CAST(CASE WHEN i = 0 THEN 0 ELSE 6 END AS BIGINT) AS first_line, CAST(CASE WHEN i = 0 THEN 6 ELSE 6 END AS BIGINT) AS n_lines FROM part, (SELECT unnest([0, 1]) AS i)")
def _(spark, sf_dir):
    """A title and five lines of a hundred characters, twice: each title begins a window."""
    part = F.concat(F.array(F.concat(F.lit("Title "), F.col("p_name"))), F.array_repeat(F.lit("x" * 99 + "."), 5))
    rows = part_rows(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("book"), F.posexplode(F.concat(part, part)).alias("pos", "text")).withColumn("doc_path", F.lit("d"))
    return books.window_chunks(rows, 400, 300).select(F.col("book").cast("bigint").alias("p_partkey"), F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.col("first_line").cast("bigint").alias("first_line"), F.col("n_lines").cast("bigint").alias("n_lines"))


# the extraction loop


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_rows(spark, sf_dir).select(
        F.col("p_brand").alias("book"), F.col("p_partkey").cast("int").alias("chunk_idx"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("title_hint"), F.lit("d.xhtml").alias("doc_path"), F.concat(F.lit("text of "), F.col("p_name")).alias("text"), F.col("p_size").cast("int").alias("size")
    )


@query("chunk_requests", "SELECT p_partkey AS chunk_idx, CASE WHEN p_size % 2 = 0 THEN 'Section title: ' || p_name || chr(10) || chr(10) ELSE '' END || 'text of ' || p_name AS user, 'emit_recipes' AS tool_name, 'title,sections' AS required FROM part")
def _(spark, sf_dir):
    made = extraction.chunk_requests(_windows(spark, sf_dir))
    return made.select(F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "user", "tool_name", F.array_join(F.from_json(F.get_json_object("tool_schema", "$.properties.recipes.items.required"), "array<string>"), ",").alias("required"))


_LISTS = ['["a", "b"]', "null", '"[\\"a\\", \\"b\\"]"', '""', '["a", 1]']


@query("lenient_lists", "{BASE} SELECT CASE a % 5 WHEN 0 THEN 'a|b' WHEN 1 THEN '' WHEN 2 THEN 'a|b' WHEN 3 THEN '' END AS texts, count(*) AS n_rows FROM t GROUP BY 1")
def _(spark, sf_dir):
    rows = once(spark, sf_dir, "a").withColumn("l", extraction.lenient_texts(F.element_at(F.array(*map(F.lit, _LISTS)), F.col("a") % 5 + 1)))
    return counted(rows, F.when(F.col("l").isNotNull(), F.array_join("l", "|")).alias("texts"))


def _payload(kind: Column, name: Column) -> Column:
    """Payloads by kind: 0 plain, 1 a list within a text, 2 null lists, 3 malformed, 4 of the wrong type."""
    recipe = F.concat(F.lit('{"title":"'), name, F.lit('","times":{"total":"about 1 hr. 5 min","prep":"overnight"},"sections":[{"ingredients":["1 g salt"],"instructions":null}],"notes":null}'))
    inner = F.concat(F.lit("["), recipe, F.lit("]"))
    return (
        F.when(kind == 0, F.concat(F.lit('{"recipes":'), inner, F.lit("}"))).when(kind == 1, F.concat(F.lit('{"recipes":'), F.to_json(F.array(inner)).substr(F.lit(2), F.length(F.to_json(F.array(inner))) - 2), F.lit("}")))
        .when(kind == 2, F.lit('{"recipes":null}')).when(kind == 3, F.lit('{"recipes":"[{"}')).otherwise(F.lit('{"recipes":[{"title":7,"sections":[]}]}'))
    )


@query("payload_recipes", "SELECT p_partkey, CASE WHEN p_size % 5 < 2 THEN p_name END AS title, CASE WHEN p_size % 5 < 2 THEN CAST(65 AS BIGINT) END AS minutes, CASE WHEN p_size % 5 < 2 THEN '1 g salt' END AS line, p_size % 5 > 2 AS failed FROM part")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("p", extraction.parse_payload(_payload(F.col("p_size") % 5, F.col("p_name"))))
    r = F.get(F.col("p.recipes"), F.lit(0))
    return rows.select("p_partkey", r["title"].alias("title"), r["times"]["total_minutes"].alias("minutes"), F.get(F.get(r["sections"], F.lit(0))["ingredients"], F.lit(0)).alias("line"), F.col("p.problem").isNotNull().alias("failed"))


def _extractor(requests: DataFrame) -> DataFrame:
    """Malformed at first where size % 4 is 1, always where it is 2, cut off where it is 3."""
    k, name = F.col("size") % 4, F.col("name")
    kind = F.when((k == 2) | (k == 3) | ((k == 1) & (F.col("attempt") == 0)), 3).otherwise(0)
    return requests.select("book", "chunk_idx", _payload(kind, name).alias("input"), (k == 3).alias("truncated"), F.lit(10).alias("input_tokens"), F.lit(2).alias("output_tokens"), F.lit(0).alias("cache_write_tokens"), F.lit(None).cast("int").alias("cache_read_tokens"))


def _rescue(requests: DataFrame) -> DataFrame:
    kind = F.when(F.col("size") % 8 == 2, 0).otherwise(3)
    return requests.select("book", "chunk_idx", _payload(kind, F.col("name")).alias("input"), F.lit(False).alias("truncated"), F.lit(100).alias("input_tokens"), F.lit(2).alias("output_tokens"), F.lit(0).alias("cache_write_tokens"), F.lit(0).alias("cache_read_tokens"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark, sf_dir)
    made = extraction.chunk_requests(w).select("book", "chunk_idx", "user")
    return made.join(w.select("book", "chunk_idx", "size", F.regexp_replace("text", "^text of ", "").alias("name")), ["book", "chunk_idx"])


_TRIED = "CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN CASE WHEN p_size % 8 = 2 THEN 3 ELSE 4 END ELSE 3 END"


@query("driven_chunks", f"SELECT p_partkey AS chunk_idx, CAST({_TRIED} AS BIGINT) AS n_calls, CASE WHEN p_size % 4 < 2 OR p_size % 8 = 2 THEN p_name END AS title, CASE WHEN p_size % 4 < 2 THEN 'small' ELSE 'large' END AS model, CAST(CASE p_size % 4 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN CASE WHEN p_size % 8 = 2 THEN 120 ELSE 220 END ELSE 210 END AS BIGINT) AS input_tokens FROM part")
def _(spark, sf_dir):
    made = extraction.drive(_requests(spark, sf_dir), _extractor, "small", _rescue, "large")
    return made.select(F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.col("n_calls").cast("bigint").alias("n_calls"), F.get("recipes", F.lit(0))["title"].alias("title"), "model", "input_tokens")


@query("extraction_stats", "SELECT p_brand AS book, count(*) AS chunks_total, count(*) FILTER (p_size % 4 >= 2) AS chunks_failed, count(*) FILTER (p_size % 4 < 2) AS n_recipes FROM part GROUP BY 1")
def _(spark, sf_dir):
    made = extraction.stats(extraction.drive(_requests(spark, sf_dir), _extractor, "small"))
    return made.select("book", "chunks_total", "chunks_failed", F.col("n_recipes").cast("bigint").alias("n_recipes"))


@query("extracted_books", "WITH e AS (SELECT p_brand AS book, lower(p_name) AS k, min(p_partkey) AS f, count(*) AS n, arg_min(p_name, p_partkey) AS title FROM part WHERE p_size % 4 < 2 GROUP BY 1, 2) SELECT book, title, n AS n_sections, CAST(65 AS BIGINT) AS minutes, row_number() OVER (PARTITION BY book ORDER BY f) AS recipe_pos FROM e")
def _(spark, sf_dir):
    """Windows extracted, a cache of what was read asked first, and recipes assembled."""
    chunks = _windows(spark, sf_dir)
    asked = _requests(spark, sf_dir).withColumn("cache_key", N.cache_key(F.lit("v1"), F.lit("small"), "user", "chunk_idx"))
    outcomes = materialize(extraction.drive(asked.drop("cache_key"), _extractor, "small"), "outcomes")
    path = scratch_path(spark, "cache")
    extraction.write_cache(outcomes, asked.select("book", "chunk_idx", "cache_key"), path)
    held = extraction.cached(asked.select("book", "chunk_idx", "cache_key"), spark.read.parquet(path))
    made = books.assemble(extraction.extracted_rows(held, chunks))
    return made.select("book", "title", F.size("sections").cast("bigint").alias("n_sections"), F.col("times.total_minutes").alias("minutes"), F.col("recipe_pos").cast("bigint").alias("recipe_pos"))


@query("chosen_books", "SELECT p_partkey, p_size % 3 = 0 AS is_cookbook FROM part")
def _(spark, sf_dir):
    """Books in batches, a made answer for each batch, and its numbers read as flags; numbers that no book has are passed over."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("title"), F.array(F.col("p_type")).alias("subjects"), "p_size", "p_partkey")
    numbered = materialize(extraction.batches(rows, 7), "batches")
    prompts = extraction.classify_prompt(numbered)
    answers = numbered.groupBy("batch").agg(F.collect_list(F.when(F.col("p_size") % 3 == 0, F.col("n"))).alias("yes")).join(prompts.where("user like 'Books:%[tags: %'"), "batch")
    answers = answers.select("batch", F.to_json(F.struct(F.concat("yes", F.array(F.lit(0), F.lit(99))).alias("cookbook_indices"))).alias("input"))
    return extraction.chosen_books(numbered, answers).select("p_partkey", "is_cookbook")


@query("merged_recipes", "WITH e AS (SELECT p_brand AS book, lower(p_type) AS k, p_partkey AS pk, p_size FROM part) SELECT book, k AS title, arg_min(p_size, pk) FILTER (p_size % 3 = 0) || ' loaves' AS recipe_yield, CAST(arg_min(p_size, pk) FILTER (p_size % 5 = 0) AS BIGINT) AS minutes, arg_min(pk, pk) FILTER (p_size % 2 = 0) || '.png' AS image FROM e GROUP BY book, k")
def _(spark, sf_dir):
    none, size = F.lit(None).cast("string"), F.col("p_size").cast("string")
    times = F.when(F.col("p_size") % 5 == 0, F.struct(F.concat(size, F.lit(" min")).alias("total"), F.col("p_size").cast("bigint").alias("total_minutes")))
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("book"), F.col("p_partkey").alias("chunk_idx"), F.lit(0).alias("recipe_idx"), none.alias("title_hint"), F.lit("doc").alias("doc_path"), F.lower("p_type").alias("title"),
        F.array(F.struct(none.alias("name"), F.array("p_name").alias("ingredients"), F.array("p_name").alias("instructions"))).alias("sections"), F.array().cast("array<string>").alias("notes"), F.array().cast("array<string>").alias("equipment"),
        none.alias("description"), none.alias("category"), F.when(F.col("p_size") % 3 == 0, F.concat(size, F.lit(" loaves"))).alias("recipe_yield"), times.alias("times"), F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit(".png"))).alias("image"),
    )
    return books.assemble(rows).select("book", "title", "recipe_yield", F.col("times.total_minutes").alias("minutes"), "image")


@query("filled_minutes", "{BASE} SELECT CAST(n * 60 + a AS BIGINT) AS total, CAST(7 AS BIGINT) AS prep, CAST(NULL AS BIGINT) AS cook, count(*) AS n_rows FROM t GROUP BY ALL")
def _(spark, sf_dir):
    none = F.lit(None).cast("bigint")
    times = F.struct(F.lit(None).cast("string").alias("active"), _made("about {n} hr. {a} min").alias("total"), F.lit("1 hour").alias("prep"), F.lit("1 to 2 hours").alias("cook"), none.alias("active_minutes"), none.alias("total_minutes"), F.lit(7).cast("bigint").alias("prep_minutes"), none.alias("cook_minutes"))
    rows = once(spark, sf_dir, "n", "a").withColumn("t", times).withColumn("f", extraction.fill_minutes("t"))
    return counted(rows, *(F.col(f"f.{k}_minutes").alias(k) for k in ("total", "prep", "cook")))


@query("reference_edges", "WITH d AS (SELECT DISTINCT p_brand AS book, p_name AS title FROM part), w AS (SELECT *, row_number() OVER x AS pos, lead(title) OVER x AS after FROM d WINDOW x AS (PARTITION BY book ORDER BY title)) SELECT book, pos AS from_pos, pos + 1 AS to_pos, title AS from_title, after AS to_title FROM w WHERE after IS NOT NULL")
def _(spark, sf_dir):
    from larder.queries import _titles

    rows = materialize(_titles(spark, sf_dir), "titles")
    made = books.reference_graph(books.resolve_references(rows), rows)
    return made.select("book", F.col("from_pos").cast("bigint").alias("from_pos"), F.col("to_pos").cast("bigint").alias("to_pos"), "from_title", "to_title")


@query("written_lines", "{BASE}, d AS (SELECT DISTINCT n, name FROM t) SELECT name AS food, count(*) AS n_rows, CAST(sum(n) AS DOUBLE) AS total FROM d GROUP BY 1")
def _(spark, sf_dir):
    """Parsed lines written as JSON and read again."""
    path = scratch_path(spark, "parsed")
    rows = base(spark, sf_dir).select("n", "name").distinct().select(_made("{n} g {name}").alias("line")).withColumn("parsed", P.parse_line("line"))
    writers.write_parsed(rows, path)
    read = spark.read.schema("name string, amounts array<struct<value:double>>").json(path)
    return read.groupBy(F.col("name").alias("food")).agg(F.count("*").alias("n_rows"), F.sum(F.col("amounts")[0]["value"]).alias("total"))


@query("cookbook_plan", "WITH d AS (SELECT DISTINCT p_brand AS book, p_type AS title FROM part), w AS (SELECT book, title, lead(title) OVER (PARTITION BY book ORDER BY title) AS after FROM d) SELECT book, title, CAST(CASE WHEN after IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_references FROM w")
def _(spark, sf_dir):
    w, none = Window.partitionBy("book").orderBy("title"), F.lit(None).cast("string")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("book"), F.col("p_type").alias("title")).distinct()
    rows = rows.withColumns({"chunk_idx": F.row_number().over(w), "after": F.lead("title").over(w)})
    made = rows.select("book", "chunk_idx", F.lit(0).alias("recipe_idx"), none.alias("title_hint"), F.lit("d").alias("doc_path"), "title", F.array(F.coalesce(F.concat(F.lit("1 cup "), F.col("after"), F.lit(" recipe")), F.lit("salt"))).alias("ingredients"), F.array().cast("array<string>").alias("instructions"), F.array().cast("array<string>").alias("notes"), F.array().cast("array<string>").alias("equipment"), none.alias("description"), none.alias("category"))
    lines = spark.createDataFrame([], f"book string, links {books.LINKS}")
    out = kitchen.cookbook_recipes(lines, made)
    return out.select("book", "title", F.coalesce(F.size("references"), F.lit(0)).cast("bigint").alias("n_references"))
