"""Registered queries of the recipe-text engine, and the SQL that states their results.

The tables hold no recipe text, so lines are made from lineitem and part by expressions; SQL states the answer, not the parser.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions import native as N
from larder.functions import parsing as P
from larder.operators import books, conversion, corpus, measures, recipes
from larder.plans import kitchen
from larder.runtime import scratch_path, spread
from larder.sources import writers
from larder.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_BASE = """WITH t AS (SELECT CAST(l_quantity AS INT) AS n, l_linenumber AS a, p_name AS name, split_part(p_name, ' ', 2) AS noun, p_brand AS brand,
p_retailprice AS price, p_partkey AS part, l_returnflag AS rf, l_linestatus AS ls FROM lineitem JOIN part ON l_partkey = p_partkey) """
_SIZED = "CASE WHEN name LIKE 'small %' OR name LIKE 'large %' THEN {} ELSE {} END"


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql.replace("{BASE}", _BASE)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` spread over all cores: its file is small, and what is made of each row is not."""
    return spread(table(spark, sf_dir, "part"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = items.join(parts, items["l_partkey"] == parts["p_partkey"])
    return rows.select(
        F.col("l_quantity").cast("int").alias("n"), F.col("l_linenumber").alias("a"), F.col("p_name").alias("name"), F.split("p_name", " ")[1].alias("noun"), F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("part"), F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"),
    )


def once(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The distinct rows of base() in these columns, `__n` being how many rows each stands for: what is made of them is made once for equal rows."""
    return base(spark, sf_dir).groupBy(*columns).agg(F.count("*").alias("__n"))


def text(*parts: Column | str) -> Column:
    """Columns by name between literal texts: "@n" names a column."""
    return F.concat(*((F.col(p[1:]).cast("string") if p.startswith("@") else F.lit(p)) if isinstance(p, str) else p for p in parts))


def parsed(spark: SparkSession, sf_dir: str, *line: Column | str) -> DataFrame:
    """Each distinct line and its parse, with `__n`, how many rows have it."""
    lines = base(spark, sf_dir).groupBy(text(*line).alias("line")).agg(F.count("*").alias("__n"))
    return lines.withColumn("p", P.parse_line("line"))


def amount(k: int, part: str) -> Column:
    return F.get(F.col("p.amounts"), F.lit(k))[part]


def first(*more: str) -> list[Column]:
    fields = {"unit": amount(0, "unit"), "value": amount(0, "value"), "upper_value": amount(0, "upper_value"), "unit2": amount(1, "unit"), "value2": amount(1, "value"), "name": F.col("p.name"), "modifier": F.col("p.modifier"), "n_amounts": F.size("p.amounts")}
    return [fields[m].alias(m) for m in more]


def counted(df: DataFrame, *columns: Column) -> DataFrame:
    """How many rows there are of each value; of rows with `__n`, how many they stand for."""
    n = F.coalesce(F.sum("__n"), F.lit(0)) if "__n" in df.columns else F.count("*")
    return df.groupBy(*columns).agg(n.alias("n_rows"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grams of each brand, from free text."""
    rows = base(spark, sf_dir).select("brand", F.explode(P.parse_line(text("@n", " g ", "@name", ", chopped"))["amounts"]).alias("m"))
    rows = rows.select("brand", F.struct(*(F.col("m")[k].alias(k) for k in ("unit", "value", "upper_value"))).alias("measure"))
    made = measures.sum_measures(rows, ["brand"])
    return made.where("kind = 'weight'").select("brand", F.col("total.value").alias("grams"))


query("grams_by_brand", "{BASE} SELECT brand, CAST(sum(n) AS DOUBLE) AS grams FROM t GROUP BY brand")(flagship)


# the grammar


@query("parse_single", "{BASE} SELECT 'cup' AS unit, CAST(n AS DOUBLE) AS value, name, count(*) AS n_rows FROM t GROUP BY n, name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "@n", " cups ", "@name"), *first("unit", "value", "name"))


@query(
    "parse_size_unit",
    "{BASE} SELECT " + _SIZED.format("split_part(name, ' ', 1)", "'whole'") + " AS unit, CAST(n AS DOUBLE) AS value, " + _SIZED.format("noun", "name") + " AS out_name, count(*) AS n_rows FROM t GROUP BY 1, 2, 3",
)
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "@n", " ", "@name"), *first("unit", "value"), F.col("p.name").alias("out_name"))


@query("parse_range", "{BASE} SELECT 'tbsp' AS unit, CAST(a AS DOUBLE) AS value, CAST(a + n AS DOUBLE) AS upper_value, name, count(*) AS n_rows FROM t GROUP BY a, n, name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "@a", "-", (F.col("a") + F.col("n")).cast("string"), " tbsp ", "@name"), *first("unit", "value", "upper_value", "name"))


@query("parse_cross_unit", "{BASE} SELECT 'tsp' AS unit, CAST(a AS DOUBLE) AS value, 'tbsp' AS unit2, CAST(n AS DOUBLE) AS value2, name, count(*) AS n_rows FROM t GROUP BY a, n, name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "@a", " tsp to ", "@n", " tbsp ", "@name"), *first("unit", "value", "unit2", "value2", "name"))


@query("parse_plus", "{BASE} SELECT 'tsp' AS unit, CAST(3 * a + n AS DOUBLE) AS value, name, count(*) AS n_rows FROM t GROUP BY 2, name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "@a", " tbsp plus ", "@n", " tsp ", "@name"), *first("unit", "value", "name"))


@query("parse_paren_size", "{BASE} SELECT 'can' AS unit, CAST(a AS DOUBLE) AS value, 'oz' AS unit2, CAST(n AS DOUBLE) AS value2, name, count(*) AS n_rows FROM t GROUP BY a, n, name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "@a", " (", "@n", "-ounce) cans ", "@name"), *first("unit", "value", "unit2", "value2", "name"))


@query("parse_bracket", "{BASE} SELECT 'tbsp' AS unit, CAST(n AS DOUBLE) AS value, 'g' AS unit2, CAST(a AS DOUBLE) AS value2, name, count(*) AS n_rows FROM t GROUP BY a, n, name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "@n", " tbsp [", "@a", " g] ", "@name"), *first("unit", "value", "unit2", "value2", "name"))


@query("parse_multi", "{BASE} SELECT 'cup' AS unit, CAST(n AS DOUBLE) AS value, 'ml' AS unit2, CAST(a * 100 AS DOUBLE) AS value2, name, count(*) AS n_rows FROM t GROUP BY a, n, name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "@n", " cups / ", (F.col("a") * 100).cast("string"), " ml ", "@name"), *first("unit", "value", "unit2", "value2", "name"))


@query("parse_multiplier", "{BASE} SELECT 'g' AS unit, CAST(a * n AS DOUBLE) AS value, name, count(*) AS n_rows FROM t GROUP BY 2, name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "@a", " x ", "@n", " g ", "@name"), *first("unit", "value", "name"))


@query("parse_unit_only", "{BASE} SELECT 'pinch' AS unit, CAST(1 AS DOUBLE) AS value, name, count(*) AS n_rows FROM t GROUP BY name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "generous pinch of ", "@name"), *first("unit", "value", "name"))


@query("parse_fraction", "{BASE} SELECT CAST(n AS DOUBLE) + CAST(a AS DOUBLE) / 8 AS value, name, count(*) AS n_rows FROM t GROUP BY 1, name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "@n", " ", "@a", "/8 cups ", "@name"), *first("value", "name"))


@query("parse_upper_bound", "{BASE} SELECT CAST(0 AS DOUBLE) AS value, CAST(n AS DOUBLE) AS upper_value, name, count(*) AS n_rows FROM t GROUP BY n, name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "up to ", "@n", " ml ", "@name"), *first("value", "upper_value", "name"))


@query("parse_amount_column", "{BASE} SELECT CAST(2 AS BIGINT) AS n_amounts, CAST(sum(n + a) AS DOUBLE) AS total, count(*) AS n_rows FROM t")
def _(spark, sf_dir):
    rows = base(spark, sf_dir).withColumn("m", P.parse_amount(text("@n", " g, ", "@a", " cups left")))
    return rows.groupBy(F.size("m").cast("bigint").alias("n_amounts")).agg(F.sum(F.col("m")[0]["value"] + F.col("m")[1]["value"]).alias("total"), F.count("*").alias("n_rows"))


@query("parse_mismatched_range", "{BASE} SELECT CAST(0 AS BIGINT) AS n_amounts, count(*) AS n_rows FROM t")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "@a", " g-", "@n", "tsp ", "@name").where("size(p.amounts) = 0"), F.size("p.amounts").cast("bigint").alias("n_amounts"))


# recognizers, assembly, refinement


@query("parse_optional", "{BASE} SELECT true AS optional, CAST(n AS DOUBLE) AS value, name, count(*) AS n_rows FROM t GROUP BY n, name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "(", "@n", " cups ", "@name", ")"), F.col("p.optional").alias("optional"), *first("value", "name"))


@query("parse_optional_note", "{BASE} SELECT true AS optional, CAST(n AS DOUBLE) AS value, name, count(*) AS n_rows FROM t GROUP BY n, name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "@n", " cups ", "@name", ", optional"), F.col("p.optional").alias("optional"), *first("value", "name"))


@query("parse_trailing", "{BASE} SELECT 'g' AS unit, CAST(n AS DOUBLE) AS value, name, count(*) AS n_rows FROM t GROUP BY n, name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "@name", " — ", "@n", " g"), *first("unit", "value", "name"))


@query("parse_x_of", "{BASE} SELECT 'juice of' AS modifier, 'cup' AS unit, CAST(n AS DOUBLE) AS value, name, count(*) AS n_rows FROM t GROUP BY n, name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "Juice of ", "@n", " cups ", "@name"), *first("modifier", "unit", "value", "name"))


@query("prep_modifier", "{BASE} SELECT 'finely chopped, sifted' AS modifier, name, count(*) AS n_rows FROM t GROUP BY name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "@n", " cups finely chopped ", "@name", ", sifted"), *first("modifier", "name"))


@query("purpose_modifier", "{BASE} SELECT 'for brushing the pan' AS modifier, name, count(*) AS n_rows FROM t GROUP BY name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "@n", " cups ", "@name", " for brushing the pan"), *first("modifier", "name"))


@query("alternatives", "{BASE} SELECT 'red ' || noun AS name, 'or white ' || noun AS modifier, count(*) AS n_rows FROM t GROUP BY noun")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "@n", " cups red or white ", "@noun"), *first("name", "modifier"))


@query("secondary_amounts", "{BASE} SELECT CAST(2 AS BIGINT) AS n_amounts, 'cup' AS unit, CAST(n AS DOUBLE) AS value, 'g' AS unit2, CAST(a AS DOUBLE) AS value2, name, count(*) AS n_rows FROM t GROUP BY n, a, name")
def _(spark, sf_dir):
    rows = parsed(spark, sf_dir, "@n", " cups ", "@name", " (about ", "@a", " g)")
    return counted(rows, F.size("p.amounts").cast("bigint").alias("n_amounts"), *first("unit", "value", "unit2", "value2", "name"))


_USAGES = {"A": "to taste", "N": "for garnish", "R": "for frying"}


@query(
    "usage_classes",
    "{BASE} SELECT CASE WHEN ls = 'O' THEN 'dredging' WHEN rf = 'A' THEN 'seasoning' WHEN rf = 'N' THEN 'garnish' ELSE 'frying_medium' END AS usage, count(*) AS n_rows FROM t GROUP BY 1",
)
def _(spark, sf_dir):
    suffix = F.when(F.col("ls") == "O", "for dusting").otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in _USAGES.items() for x in kv]), F.col("rf")))
    return counted(parsed(spark, sf_dir, "@n", " cups ", "@name", ", ", suffix), F.col("p.usage").alias("usage"))


@query(
    "confidence_tally",
    "{BASE} SELECT CASE a % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS confidence, a % 3 = 1 AS unparsed_digit, count(*) AS n_rows FROM t GROUP BY 1, 2",
)
def _(spark, sf_dir):
    line = F.when(F.col("a") % 3 == 0, text("@n", " g ", "@name")).when(F.col("a") % 3 == 1, text("@name", " no", "@n")).otherwise(F.col("name"))
    return counted(parsed(spark, sf_dir, line), F.col("p.parse_notes.confidence").alias("confidence"), F.col("p.parse_notes.unparsed_digit").alias("unparsed_digit"))


@query("normalize_lines", "{BASE} SELECT n || ' cups ' || name AS line, count(*) AS n_rows FROM t GROUP BY 1")
def _(spark, sf_dir):
    raw = text("  • the ", "@n", "  cups ", "@name", " (see note) (this page)*")
    return counted(N.normalize_lines(once(spark, sf_dir, "n", "name").withColumn("raw", raw), "raw", "line"), F.col("line"))


@query("decompose_lines", "{BASE} SELECT n || ' cups' AS amount, name, 'sifted' AS modifier, count(*) AS n_rows FROM t GROUP BY n, name")
def _(spark, sf_dir):
    rows = once(spark, sf_dir, "n", "name").withColumn("d", P.decompose(text("@n", " cups ", "@name", ", sifted")))
    part = lambda f: F.get(F.filter("d.spans", lambda s: s["field"] == f), F.lit(0))["text"].alias(f)
    return counted(rows, part("amount"), part("name"), part("modifier"))


@query("clause_kinds", "{BASE} SELECT 'head_candidate,known_prep_phrase,purpose,alternative' AS kinds, count(*) AS n_rows FROM t")
def _(spark, sf_dir):
    rows = once(spark, sf_dir, "name", "noun").withColumn("c", P.clauses(text("@name", ", to taste, for serving, or other ", "@noun")))
    return counted(rows, F.array_join(F.transform("c", lambda x: x["kind"]), ",").alias("kinds"))


@query("display_lines", "{BASE} SELECT n || CASE WHEN n > 1 THEN ' cups ' ELSE ' cup ' END || name || ', sifted' AS shown, count(*) AS n_rows FROM t GROUP BY n, name")
def _(spark, sf_dir):
    return counted(parsed(spark, sf_dir, "@n", " cups ", "@name", ", sifted"), N.display_ingredient("p").alias("shown"))


# units and measures

_UNITS = ["kilograms", "oz", "lb", "tbsp", "cups", "Minutes", "dollars"]
_FACTORS = [("g", 1000.0), ("g", 28.3495), ("g", 28.3495 * 16), ("tsp", 3.0), ("tsp", 48.0), ("second", 60.0), ("cent", 100.0)]


def _unit(column: str = "a") -> Column:
    return F.element_at(F.array(*map(F.lit, _UNITS)), F.col(column) % 7 + 1)


def _case(values: list) -> str:
    return "CASE a % 7 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query("normalize_units", f"{{BASE}} SELECT {_case([repr(u) for u, _ in _FACTORS])} AS unit, n * {_case([f'CAST({f!r} AS DOUBLE)' for _, f in _FACTORS])} AS value, count(*) AS n_rows FROM t GROUP BY 1, 2")
def _(spark, sf_dir):
    m = N.normalize_measure("m")
    return counted(base(spark, sf_dir).withColumn("m", N.make_measure(_unit(), "n")), m["unit"].alias("unit"), m["value"].alias("value"))


@query(
    "denormalize_units",
    "{BASE} SELECT CASE WHEN n * a < 3 THEN 'tsp' WHEN n * a < 12 THEN 'tbsp' WHEN n * a < 192 THEN 'cup' ELSE 'quart' END AS unit, CAST(n * a AS DOUBLE) / CASE WHEN n * a < 3 THEN 1 WHEN n * a < 12 THEN 3 WHEN n * a < 192 THEN 48 ELSE 192 END AS value, count(*) AS n_rows FROM t GROUP BY 1, 2",
)
def _(spark, sf_dir):
    d = N.denormalize_measure("m")
    return counted(base(spark, sf_dir).withColumn("m", N.make_measure(F.lit("tsp"), F.col("n") * F.col("a"))), d["unit"].alias("unit"), d["value"].alias("value"))


@query("unit_kinds", f"{{BASE}} SELECT {_case([repr(k) for k in ('weight', 'weight', 'weight', 'volume', 'volume', 'time', 'money')])} AS kind, count(*) AS n_rows FROM t GROUP BY 1")
def _(spark, sf_dir):
    return counted(base(spark, sf_dir), N.unit_kind(N.canonical_unit(_unit())).alias("kind"))


@query("format_quantities", "{BASE} SELECT n || CASE a WHEN 1 THEN '⅛' WHEN 2 THEN '¼' WHEN 3 THEN '⅜' WHEN 4 THEN '½' WHEN 5 THEN '⅝' WHEN 6 THEN '¾' WHEN 7 THEN '⅞' END AS shown, count(*) AS n_rows FROM t GROUP BY 1")
def _(spark, sf_dir):
    return counted(once(spark, sf_dir, "n", "a"), N.format_quantity(F.col("n") + F.col("a") / 8).alias("shown"))


@query("scale_measures", "{BASE} SELECT 'cup' AS unit, n * 2.5 AS value, (n + a) * 2.5 AS upper_value, count(*) AS n_rows FROM t GROUP BY n, a")
def _(spark, sf_dir):
    m = N.scale_measure(N.make_measure(F.lit("cups"), "n", F.col("n") + F.col("a")), 2.5)
    return counted(base(spark, sf_dir).withColumn("m", m), *(F.col(f"m.{k}").alias(k) for k in ("unit", "value", "upper_value")))


@query(
    "sum_measures",
    "{BASE} SELECT brand, CASE WHEN a % 2 = 0 THEN 'weight' ELSE 'volume' END AS kind, CASE WHEN a % 2 = 0 THEN 'g' ELSE 'quart' END AS unit, sum(CASE WHEN a % 2 = 0 THEN n * 1000.0 ELSE n * 48.0 / 192.0 END) AS value, count(*) AS n_rows FROM t GROUP BY 1, 2, 3",
)
def _(spark, sf_dir):
    m = N.make_measure(F.when(F.col("a") % 2 == 0, "kg").otherwise("cup"), "n")
    rows = base(spark, sf_dir).select("brand", m.alias("measure"))
    sums = measures.sum_measures(rows, ["brand"])
    counts = rows.groupBy("brand", N.unit_kind("measure.unit").alias("kind")).agg(F.count("*").alias("n_rows"))
    return sums.join(counts, ["brand", "kind"]).select("brand", "kind", "total.unit", "total.value", "n_rows")


@query("shopping_list", "{BASE} SELECT brand, name, 'weight' AS kind, CAST(sum(n) AS DOUBLE) AS grams FROM t GROUP BY brand, name")
def _(spark, sf_dir):
    lines = base(spark, sf_dir).select("brand", text("@n", " g ", "@name", ", chopped").alias("line"))
    return kitchen.shopping_list(lines, ["brand"]).select("brand", "name", "kind", F.col("total.value").alias("grams"))


# conversion

_SIG = "floor(x * pow(10.0, 5 - floor(log10(x))) + 0.5) / pow(10.0, 5 - floor(log10(x)))"


@query(
    "convert_price",
    "{BASE}, v AS (SELECT part, n, n * ((price * 100.0) / (28.3495 * 16.0)) AS x FROM t WHERE n > 0 AND price > 0) SELECT part, n, round(" + _SIG + " / 100.0, 6) AS dollars, count(*) AS n_rows FROM v GROUP BY 1, 2, 3",
)
def _(spark, sf_dir):
    rows = base(spark, sf_dir).where("n > 0 and price > 0").select(F.col("part").cast("string").alias("graph_id"), "part", "n", text("@n", " g ", "@name").alias("line"))
    parts = table(spark, sf_dir, "part").where("p_retailprice > 0")
    mappings = parts.select(F.col("p_partkey").cast("string").alias("graph_id"), F.lit(0).alias("seq"), F.concat(F.lit("1 lb = $"), F.col("p_retailprice").cast("string")).alias("text"))
    made = kitchen.priced_lines(rows, mappings)
    return counted(made, F.col("part"), F.col("n"), F.round("converted.value", 6).alias("dollars"))


def _geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, key: F.struct(F.concat(F.lit(name), F.col(key).cast("string")).alias("unit"), F.lit(1.0).alias("value"), F.lit(None).cast("double").alias("upper_value"))
    two = lambda name, key: F.struct(F.concat(F.lit(name), F.col(key).cast("string")).alias("unit"), F.lit(2.0).alias("value"), F.lit(None).cast("double").alias("upper_value"))
    return table(spark, sf_dir, "nation").select(F.lit("world").alias("graph_id"), F.col("n_nationkey").alias("seq"), one("nation", "n_nationkey").alias("a"), two("region", "n_regionkey").alias("b"))


@query(
    "conversion_paths",
    "SELECT 'nation' || a.n_nationkey AS from_unit, 'nation' || b.n_nationkey AS to_unit, CAST(1 AS DOUBLE) AS factor, CAST(2 AS BIGINT) AS n_steps FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
)
def _(spark, sf_dir):
    made = conversion.closure(_geography(spark, sf_dir)).where("from_unit like 'nation%' and to_unit like 'nation%'")
    return made.select("from_unit", "to_unit", "factor", F.size("steps").cast("bigint").alias("n_steps"))


@query("conversion_islands", "WITH u AS (SELECT n_regionkey AS r, 'nation' || n_nationkey AS unit FROM nation UNION ALL SELECT DISTINCT n_regionkey, 'region' || n_regionkey FROM nation) SELECT string_agg(unit, ',' ORDER BY unit) AS units FROM u GROUP BY r")
def _(spark, sf_dir):
    return conversion.islands(_geography(spark, sf_dir)).select(F.array_join(F.array_sort("units"), ",").alias("units"))


@query(
    "conversion_dot",
    "SELECT unnest(['nation' || n_nationkey, 'region' || n_regionkey]) AS node, 'other' AS class, label, CAST(n_nationkey AS BIGINT) AS edge FROM (SELECT *, CASE WHEN n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) THEN '2' ELSE '0.5' END AS label FROM nation)",
)
def _(spark, sf_dir):
    """Each edge of the drawing with the nodes at its ends, read back from the text."""
    lines = conversion.dot(_geography(spark, sf_dir)).select(F.explode(F.split("dot", "\n")).alias("l"))
    nodes = lines.select(F.regexp_extract("l", r'^ +(\d+) \[ label = "(.*?)", class = "(.*?)"', 1).alias("i"), F.regexp_extract("l", r'label = "(.*?)"', 1).alias("node"), F.regexp_extract("l", r'class = "(.*?)"', 1).alias("class")).where("i <> ''")
    edges = lines.select(F.regexp_extract("l", r"^ +(\d+) -> (\d+)", 1).alias("a"), F.regexp_extract("l", r"^ +(\d+) -> (\d+)", 2).alias("b"), F.regexp_extract("l", r'label = "(.*?)"', 1).alias("label")).where("a <> ''")
    ends = lambda c: nodes.select(F.col("i").alias(c), F.col("node").alias(f"node_{c}"))
    named = edges.join(ends("a"), "a").join(ends("b"), "b").withColumn("edge", F.regexp_extract(F.concat_ws(" ", "node_a", "node_b"), r"nation(\d+)", 1).cast("bigint"))
    return named.select("label", "edge", F.explode(F.array("a", "b")).alias("i")).join(nodes, "i").select("node", "class", "label", "edge")


@query("parse_mappings", "{BASE} SELECT CASE WHEN a % 2 = 0 THEN 'lb' END AS unit, CASE WHEN a % 2 = 0 THEN CAST(n AS DOUBLE) END AS value, CASE WHEN a % 2 = 0 THEN brand END AS source, a % 2 = 1 AS failed, count(*) AS n_rows FROM t GROUP BY 1, 2, 3, 4")
def _(spark, sf_dir):
    line = F.when(F.col("a") % 2 == 0, text("$5/", "@n", " lb @ ", "@brand")).otherwise(text("@n", " lb"))
    rows = once(spark, sf_dir, "a", "n", "brand").withColumn("m", P.parse_mapping(line))
    return counted(rows, F.col("m.a.unit").alias("unit"), F.col("m.a.value").alias("value"), F.col("m.source").alias("source"), F.col("m.error").isNotNull().alias("failed"))


# durations, yields, entities


@query("iso_minutes", "{BASE} SELECT CAST(n * 60 + a AS BIGINT) AS minutes, count(*) AS n_rows FROM t GROUP BY 1")
def _(spark, sf_dir):
    return counted(once(spark, sf_dir, "n", "a"), N.iso_minutes(text("PT", "@n", "H", "@a", "M")).alias("minutes"))


@query("prose_minutes", "{BASE} SELECT CAST(n * 60 + a AS BIGINT) AS minutes, count(*) AS n_rows FROM t GROUP BY 1")
def _(spark, sf_dir):
    return counted(once(spark, sf_dir, "n", "a"), N.prose_minutes(text("about ", "@n", " hr. ", "@a", " min")).alias("minutes"))


@query("humanize_minutes", "{BASE} SELECT n || CASE WHEN n = 1 THEN ' hour ' ELSE ' hours ' END || a || CASE WHEN a = 1 THEN ' minute' ELSE ' minutes' END AS shown, count(*) AS n_rows FROM t GROUP BY 1")
def _(spark, sf_dir):
    return counted(base(spark, sf_dir), N.humanize_minutes(F.col("n") * 60 + F.col("a")).alias("shown"))


@query("yield_servings", "{BASE} SELECT CAST(n AS DOUBLE) AS value, 'serving' AS unit, CAST(n AS BIGINT) AS servings, count(*) AS n_rows FROM t GROUP BY n")
def _(spark, sf_dir):
    rows = once(spark, sf_dir, "n").withColumn("y", recipes.parse_yield(text("Makes ", "@n", " servings")))
    return counted(rows, F.col("y.value").alias("value"), F.col("y.unit").alias("unit"), F.col("y.servings").cast("bigint").alias("servings"))


@query("entity_decode", "{BASE} SELECT name || ' & ½ <' || noun || '>' AS decoded, count(*) AS n_rows FROM t GROUP BY 1")
def _(spark, sf_dir):
    return counted(once(spark, sf_dir, "name", "noun"), recipes.decode_entities(text("@name", " &amp;amp; &frac12; &lt;", "@noun", "&gt;")).alias("decoded"))


@query("null_paths", "{BASE} SELECT 'a.b,c[1]' AS paths, count(*) AS n_rows FROM t")
def _(spark, sf_dir):
    return counted(once(spark, sf_dir, "n"), F.array_join(recipes.null_paths(text('{"a": {"b": null}, "c": [', "@n", ", null]}")), ",").alias("paths"))


# prose


@query(
    "rich_measures",
    "{BASE}, c AS (SELECT noun, unnest([{'kind': 'text', 'text': 'Cook the ' || left(name, length(name) - length(noun)), 'value': NULL}, {'kind': 'ing', 'text': noun, 'value': NULL}, {'kind': 'text', 'text': ' for ', 'value': NULL}, {'kind': 'measure', 'text': 'minute', 'value': CAST(n AS DOUBLE)}, {'kind': 'text', 'text': '.', 'value': NULL}]) AS k FROM (SELECT *, name FROM t WHERE name LIKE '% ' || noun)) SELECT k.kind AS kind, k.text AS text, k.value AS value, count(*) AS n_chunks FROM c GROUP BY ALL",
)
def _(spark, sf_dir):
    rows = once(spark, sf_dir, "n", "name", "noun").where("name like '% ' || noun").withColumn("c", P.rich_text(text("Cook the ", "@name", " for ", "@n", " minutes."), F.array("noun")))
    k, m = F.col("k"), F.get(F.col("k.measures"), F.lit(0))
    # explode() would have a filter on `c` inferred and pushed down to every row, with a second call of the function
    chunks = rows.select("__n", F.explode_outer("c").alias("k")).where("k is not null")
    made = counted(chunks, k["kind"].alias("kind"), F.coalesce(k["text"], m["unit"]).alias("text"), m["value"].alias("value"))
    return made.withColumnRenamed("n_rows", "n_chunks")


@query("document_measures")
def _(spark, sf_dir):
    """Every measure in the prose of all documents."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(P.every_measure("text")).alias("m"))
    return found.groupBy("doc_id", "m.unit").agg(F.count("*").alias("n"))


# pages and recipes

_LD = "<html><head><script type=\"application/" + 'ld+json">{"@graph":[{"@type":"WebPage"},{"name":"%s","recipeIngredient":["2 cups %s, sifted","1 tsp salt"],"recipeInstructions":[{"text":"Mix the %s for 5 minutes."}],"recipeYield":"4 servings","totalTime":"PT1H5M","tool":["pan","n/a"]}]}</script></head></html>'


def _recipe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_rows(spark, sf_dir).select(F.concat(F.lit("http://example.org/"), F.col("p_partkey").cast("string")).alias("url"), F.format_string(_LD.replace("%", "%"), "p_name", "p_name", F.split("p_name", " ")[1]).alias("html"))


@query("scrape_recipes", "SELECT 'http://example.org/' || p_partkey AS url, p_name AS name, CAST(4 AS BIGINT) AS servings, CAST(65 AS BIGINT) AS total_minutes, '2 cups ' || p_name || ', sifted|1 tsp salt' AS ingredients, 'pan' AS equipment FROM part")
def _(spark, sf_dir):
    made = recipes.scrape(_recipe_pages(spark, sf_dir))
    return made.select("url", "recipe.name", F.col("recipe.servings").cast("bigint").alias("servings"), "recipe.total_minutes", F.array_join("recipe.ingredients", "|").alias("ingredients"), F.array_join("recipe.equipment", "|").alias("equipment"))


@query("parse_recipe_pages", "SELECT 'http://example.org/' || p_partkey AS url, p_name || '|salt' AS names, split_part(p_name, ' ', 2) AS mentioned FROM part")
def _(spark, sf_dir):
    made = kitchen.parsed_pages(_recipe_pages(spark, sf_dir))
    names = F.array_join(F.transform("ingredients", lambda p: p["name"]), "|")
    said = F.array_join(F.transform(F.filter(F.flatten("instructions"), lambda c: c["kind"] == "ing"), lambda c: c["text"]), "|")
    return made.select("url", names.alias("names"), said.alias("mentioned"))


@query("pages_scraped", "SELECT page_id, CASE WHEN page_id % 3 = 0 AND html IS NOT NULL THEN 'Pie ' || page_id END AS name FROM pages")
def _(spark, sf_dir):
    """All real pages scraped whole, a third of them with linked data of a recipe put before their end."""
    block = F.format_string('<script type="application/' + 'ld+json">{"name":"Pie %s","recipeIngredient":["1 g salt"],"recipeInstructions":[]}</script></html>', F.col("page_id").cast("string"))
    pages = table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat(F.regexp_replace("html", "</html>", ""), block)).otherwise(F.col("html")))
    found = recipes.scrape(pages.select(F.col("page_id").cast("string").alias("url"), "html")).select(F.col("url").cast("bigint").alias("id"), "recipe.name")
    return pages.join(found, F.col("page_id") == F.col("id"), "left").select("page_id", "name")


@query("page_lines")
def _(spark, sf_dir):
    """How many lines, links and images each page has as a book's page would."""
    rows = table(spark, sf_dir, "pages").select("page_id", books.page_lines("html").alias("l"))
    return rows.select("page_id", F.size("l").alias("n_lines"), F.size(F.flatten(F.transform("l", lambda x: x["links"]))).alias("n_links"), F.size(F.flatten(F.transform("l", lambda x: x["images"]))).alias("n_images"))


@query("page_cache", "SELECT url, html IS NOT NULL AS found, length(html) AS n_chars FROM (SELECT p.url, coalesce(c.html, CASE WHEN p.page_id % 3 = 0 THEN p.html END) AS html FROM pages p LEFT JOIN (SELECT url, max(html) AS html FROM pages WHERE page_id % 2 = 0 GROUP BY url) c ON p.url = c.url)")
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    asked = pages.select("url", F.when(F.col("page_id") % 3 == 0, F.col("html")).alias("html"))
    made = recipes.with_cache(asked, pages.where("page_id % 2 = 0").select("url", "html"))
    return made.select("url", F.col("html").isNotNull().alias("found"), F.length("html").cast("bigint").alias("n_chars"))


@query("host_filter", "SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) = 'example.org' OR regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) LIKE '%.example.org', false) AS ours FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.is_host("url", "example.org").alias("ours"))


# books


@query("window_chunks")
def _(spark, sf_dir):
    """Every document as a book of its lines, in windows."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("book"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return books.window_chunks(docs.withColumn("doc_path", F.lit("text"))).select("book", "chunk_idx", "title_hint", "first_line", "n_lines", F.sha2("text", 256).alias("digest"))


@query("title_lines", "SELECT doc_id, CAST(sum(CASE WHEN strlen(trim(line)) BETWEEN 1 AND 60 AND NOT regexp_matches(trim(line), '^[0-9¼½¾⅐⅑⅒⅓⅔⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞•·*–—-]') AND NOT trim(line) LIKE '%.' THEN 1 ELSE 0 END) AS BIGINT) AS n_titles FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY doc_id")
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(N.looks_like_title("line")).alias("n_titles"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("book"), F.col("p_name").alias("title")).distinct()
    w = Window.partitionBy("book").orderBy("title")
    return names.withColumns({"recipe_pos": F.row_number().over(w), "after": F.lead("title").over(w)}).withColumn("lines", F.array(text("1 cup ", "@after", " recipe"), text("2 cups ", "@after")))


_TITLES = "WITH d AS (SELECT DISTINCT p_brand AS book, p_name AS title FROM part), w AS (SELECT *, row_number() OVER x AS recipe_pos, lead(title) OVER x AS after FROM d WINDOW x AS (PARTITION BY book ORDER BY title)) "
_MARKED = "length(after) >= 12"


@query(
    "title_references",
    _TITLES + f"SELECT book, CAST(recipe_pos AS BIGINT) AS recipe_pos, '1 cup ' || after || ' recipe' AS line, after AS title, 'title_match' AS confidence FROM w WHERE after IS NOT NULL UNION ALL SELECT book, recipe_pos, '2 cups ' || after, after, 'title_match' FROM w WHERE {_MARKED}",
)
def _(spark, sf_dir):
    return books.resolve_references(_titles(spark, sf_dir)).select("book", F.col("recipe_pos").cast("bigint").alias("recipe_pos"), "line", "title", "confidence")


@query("reference_index", _TITLES + "SELECT book, after AS title, CAST(recipe_pos AS VARCHAR) AS used_by FROM w WHERE after IS NOT NULL")
def _(spark, sf_dir):
    made = books.reference_index(books.resolve_references(_titles(spark, sf_dir)))
    return made.select("book", "title", F.array_join("used_by", ",").alias("used_by"))


_EXTRACTED = "SELECT p_brand AS book, p_partkey AS pk, upper(p_type) AS title, lower(p_type) AS k, p_name AS note, CASE WHEN p_size % 2 = 0 THEN p_name END AS description FROM part"


@query(
    "assemble_recipes",
    f"WITH e AS ({_EXTRACTED}), n AS (SELECT DISTINCT book, k, note FROM e), m AS (SELECT book, k, count(*) AS n_notes FROM n GROUP BY 1, 2), g AS (SELECT book, k, min(pk) AS f, count(*) AS n_sections, arg_min(title, pk) AS title, arg_min(description, pk) FILTER (description IS NOT NULL) AS description FROM e GROUP BY 1, 2) SELECT g.book, title, n_sections, n_notes, description, row_number() OVER (PARTITION BY g.book ORDER BY f) AS recipe_pos FROM g JOIN m ON g.book = m.book AND g.k = m.k",
)
def _(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("book"), F.col("p_partkey").alias("chunk_idx"), F.lit(0).alias("recipe_idx"), none.alias("title_hint"), F.lit("doc").alias("doc_path"), F.upper("p_type").alias("title"),
        F.array("p_name").alias("ingredients"), F.array("p_name").alias("instructions"), F.array("p_name").alias("notes"), F.array().cast("array<string>").alias("equipment"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("description"), none.alias("category"),
    )
    return books.assemble(rows).select("book", "title", F.size("sections").cast("bigint").alias("n_sections"), F.size("notes").cast("bigint").alias("n_notes"), "description", F.col("recipe_pos").cast("bigint").alias("recipe_pos"))


@query(
    "hero_images",
    "WITH k AS (SELECT o_orderkey AS c, CAST(o_orderkey % 40 AS INT) AS line_idx FROM orders), i AS (SELECT DISTINCT l_orderkey AS c, CAST(l_quantity AS INT) AS i_at FROM lineitem), r AS (SELECT k.c, i_at, row_number() OVER (PARTITION BY k.c ORDER BY i_at > line_idx, abs(i_at - line_idx), i_at) AS n FROM k JOIN i ON k.c = i.c) SELECT c AS recipe_pos, 'img' || i_at AS path FROM r WHERE n = 1",
)
def _(spark, sf_dir):
    titles = table(spark, sf_dir, "orders").select(F.lit("b").alias("book"), F.col("o_orderkey").alias("chunk_idx"), F.col("o_orderkey").alias("recipe_pos"), (F.col("o_orderkey") % 40).cast("int").alias("line_idx"))
    images = table(spark, sf_dir, "lineitem").select(F.lit("b").alias("book"), F.col("l_orderkey").alias("chunk_idx"), F.col("l_quantity").cast("int").alias("line_idx")).distinct().withColumn("path", text("img", "@line_idx"))
    return books.hero_images(titles, images).select("recipe_pos", "path")


@query(
    "nearest_lines",
    "WITH p AS (SELECT o_orderkey AS doc, CAST(o_orderkey % 97 AS INT) AS off FROM orders), l AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS i, l_linenumber * 12 AS s, l_linenumber * 12 + 5 AS e FROM lineitem), d AS (SELECT p.doc, i, off < s AS after, CASE WHEN off >= s AND off < e THEN 0 WHEN off < s THEN s - off ELSE off - e + 1 END AS far FROM p JOIN l ON p.doc = l.doc), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY far, NOT after, i) AS n FROM d) SELECT doc, i AS line_idx FROM r WHERE n = 1",
)
def _(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(0).alias("point_id"), (F.col("o_orderkey") % 97).cast("int").alias("offset"))
    k = F.col("l_linenumber")
    ranges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), k.alias("line_idx"), (k * 12).alias("start"), (k * 12 + 5).alias("end")).distinct()
    return books.nearest_lines(points, ranges).select("doc", "line_idx")


@query("classify_books", "SELECT p_partkey, CASE WHEN p_name LIKE '%plate%' AND p_size % 3 <> 0 THEN 'yes' WHEN p_size % 3 = 0 THEN 'unknown' ELSE 'no' END AS guess FROM part")
def _(spark, sf_dir):
    subject = F.when(F.col("p_name").contains("plate"), "Cooking").otherwise("Tools")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(subject)).alias("subjects"))
    return books.classify_books(rows).select("p_partkey", "guess")


@query(
    "usage_cost",
    "SELECT lower(p_type) || '-large-1' AS model, round((sum(p_size) * 3.0 + sum(p_size) * 2 * 15.0 + sum(p_size) * 1.25 * 3.0 + sum(p_size) * 0.1 * 3.0) / 1e6, 9) AS cost_usd FROM part GROUP BY 1",
)
def _(spark, sf_dir):
    size = F.col("p_size").cast("bigint")
    usage = table(spark, sf_dir, "part").select(F.concat(F.lower("p_type"), F.lit("-large-1")).alias("model"), size.alias("input_tokens"), (size * 2).alias("output_tokens"), size.alias("cache_write_tokens"), size.alias("cache_read_tokens"))
    prices = spark.createDataFrame([("large", 1.0, 5.0), ("-large-", 3.0, 15.0)], "key string, input_price double, output_price double")
    return books.usage_cost(usage, prices).select("model", F.round("cost_usd", 9).alias("cost_usd"))


@query("cache_keys", "SELECT doc_id, sha256('v1' || chr(0) || lang || chr(0) || text || chr(0)) AS cache_key FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang is not null and text is not null")
    return docs.select("doc_id", N.cache_key(F.lit("v1"), "lang", "text", F.lit(None)).alias("cache_key"))


@query("uncached_requests", "SELECT count(*) AS n FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0)")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", N.cache_key(F.lit("v1"), F.lit("m"), "text", F.lit(None)).alias("cache_key"))
    return books.uncached(docs, docs.where("doc_id % 2 = 0")).agg(F.count("*").alias("n"))


@query("mock_extract", "SELECT doc_id, CASE WHEN contains(text, 'the ') THEN 'a' ELSE 'b' END AS recipes FROM documents WHERE contains(text, 'the ') OR contains(text, 'and')")
def _(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("book"), "doc_id", F.lit(0).alias("chunk_idx"), F.lit(None).cast("string").alias("title_hint"), "text")
    rules = spark.createDataFrame([(0, "the ", "a"), (1, "and", "b")], "rule_idx int, needle string, recipes string")
    return books.mock_extract(chunks, rules).select("doc_id", "recipes")


# labelled lines


@query("score_labels", "{BASE} SELECT CASE WHEN a % 4 = 0 THEN 'regression' WHEN a % 4 = 1 THEN 'promote' WHEN a % 4 = 2 THEN 'xfail' ELSE 'exact' END AS status, CASE WHEN a % 4 IN (0, 2) THEN 'name' ELSE '' END AS differs, count(*) AS n_rows FROM t GROUP BY 1, 2")
def _(spark, sf_dir):
    k = F.col("a") % 4
    wrong, excused = F.when(k.isin(0, 2), "wrong").otherwise(F.col("name")), F.when(k.isin(1, 2), "known")
    amounts = F.array(F.struct(F.lit("cup").alias("unit"), F.concat(F.col("n").cast("string"), F.lit(" 1/3")).alias("value")))
    labels = F.to_json(F.struct(text("@n", " 1/3 cups ", "@name", ", sifted").alias("input"), wrong.alias("name"), amounts.alias("amounts"), F.lit("sifted").alias("modifier"), excused.alias("xfail")))
    rows = once(spark, sf_dir, "a", "n", "name").select("__n", F.lit(0).alias("pos"), labels.alias("text")).withColumn("r", corpus.read_labels("text")).select("__n", "pos", "r.labels")
    return counted(corpus.score(rows), F.col("status"), F.array_join("differs", ",").alias("differs"))


@query("tally_labels", "{BASE} SELECT count(*) AS total, count(*) AS exact, CAST(0 AS BIGINT) AS regression, count(*) AS matched, count(*) AS name_matched FROM t")
def _(spark, sf_dir):
    amounts = F.array(F.struct(F.lit("g").alias("unit"), F.col("n").alias("value")))
    labels = F.to_json(F.struct(text("@n", " g ", "@name").alias("input"), F.col("name"), amounts.alias("amounts")))
    rows = base(spark, sf_dir).select(labels.alias("text")).withColumn("r", corpus.read_labels("text")).select("r.labels")
    return corpus.tally(corpus.score(rows)).select("total", "exact", "regression", "matched", "name_matched")


_EVENTS = "CASE WHEN event_type IN ('signup', 'error') THEN event_type END"


@query("section_fill", f"SELECT user_id, event_id, last_value({_EVENTS} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM events")
def _(spark, sf_dir):
    header = F.when(F.col("event_type").isin("signup", "error"), text("// --- ", "@event_type", " ---")).otherwise("row")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("pos"), header.alias("text"))
    return corpus.fill_sections(rows, ["user_id"]).select("user_id", "event_id", "section")


@query("section_runs", "WITH f AS (SELECT user_id, event_id, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type AND row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, CAST(sum(new) AS BIGINT) AS n_runs FROM f GROUP BY user_id")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("section"))
    return corpus.sections(rows, ["user_id"]).groupBy("user_id").agg(F.max("run").cast("bigint").alias("n_runs"))


@query("topk_misses", "{BASE} SELECT name || ' no' || n AS line, count(*) AS n FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def _(spark, sf_dir):
    return corpus.ranked_misses(base(spark, sf_dir).select(text("@name", " no", "@n").alias("line")))


@query("pass_coverage", "{BASE} SELECT 'refine' AS stage, 'extract_adjectives_from_name' AS pass, count(*) AS n_lines, CAST(1 AS DOUBLE) AS share FROM t")
def _(spark, sf_dir):
    made = corpus.pass_coverage(base(spark, sf_dir).select(text("@n", " cups chopped ", "@name").alias("line")))
    return made.where("n_lines > 0")


@query("trace_spans", "{BASE}, s AS (SELECT unnest([0, 1]) AS span_id FROM t) SELECT CAST(span_id AS BIGINT) AS span_id, CASE WHEN span_id = 0 THEN 'line' ELSE 'refine' END AS stage, CASE WHEN span_id = 0 THEN 'parse_line' ELSE 'extract_adjectives_from_name' END AS name, count(*) AS n_rows FROM s GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    spans = once(spark, sf_dir, "n", "name").select("__n", F.explode(P.trace_spans(text("@n", " cups chopped ", "@name"))).alias("s"))
    return counted(spans, F.col("s.span_id").cast("bigint").alias("span_id"), F.col("s.stage").alias("stage"), F.col("s.name").alias("name"))


_PASSES = "strip_nbsp strip_leading_bullet strip_footnote_markers strip_trailing_footnote_markers split_crossref_optional strip_cross_reference strip_note_reference rewrite_batch_of_to_recipe strip_leading_determiner strip_minus_equivalence strip_total_in_measure_paren lift_leading_dimension lift_leading_piece_dimension optional_wrapped trailing_amount x_of_construction fix_leading_prep_phrase fix_leading_minus_clause recover_head_noun_from_modifier recover_parenthetical_alias_from_modifier recover_shared_head_from_alternatives extract_secondary_amounts_from_modifier extract_postfix_produce_unit extract_size_unit_from_name extract_leading_prep_alternative extract_trailing_prep_clause extract_adjectives_from_name extract_purpose_gerund extract_alternatives_from_name"


@query(
    "unfired_passes",
    f"{{BASE}}, f AS (SELECT DISTINCT unnest(CASE WHEN n % 2 = 0 THEN ['extract_adjectives_from_name'] ELSE ['strip_leading_bullet', 'extract_purpose_gerund'] END) AS pass FROM t) SELECT pass FROM (SELECT unnest(string_split('{_PASSES}', ' ')) AS pass) WHERE pass NOT IN (SELECT pass FROM f)",
)
def _(spark, sf_dir):
    line = F.when(F.col("n") % 2 == 0, text("@n", " cups chopped ", "@noun")).otherwise(text("• ", "@n", " cups ", "@noun", " for frying"))
    return corpus.unfired(once(spark, sf_dir, "n", "noun").select(line.alias("line"))).select("pass")


@query("low_confidence_lines", "{BASE} SELECT name || ' no' || n AS line, count(*) AS n_rows FROM t WHERE a % 2 = 0 GROUP BY 1")
def _(spark, sf_dir):
    rows = once(spark, sf_dir, "a", "n", "name").select("__n", F.when(F.col("a") % 2 == 0, text("@name", " no", "@n")).otherwise(text("@n", " g ", "@name")).alias("line")).withColumn("parsed", P.parse_line("line"))
    return counted(books.low_confidence_lines(rows), F.col("line"))


@query("parsed_json", "{BASE} SELECT '{\"line\":\"' || n || ' g ' || name || '\",\"name\":\"' || name || '\",\"amounts\":[{\"unit\":\"g\",\"value\":' || n || '.0,\"upper_value\":null}],\"modifier\":null}' AS value, count(*) AS n_rows FROM t GROUP BY 1")
def _(spark, sf_dir):
    rows = once(spark, sf_dir, "n", "name").select("__n", text("@n", " g ", "@name").alias("line")).withColumn("parsed", P.parse_line("line"))
    return counted(writers.parsed_json(rows, "__n"), F.col("value"))


@query("corpus_rows", "{BASE} SELECT '{\"input\": \"2/3 cups ' || name || ', ' || n || ' g\", \"name\": \"' || name || '\", \"amounts\": [{\"unit\": \"cup\", \"value\": \"2/3\"}], \"modifier\": \"' || n || ' g\"}' AS json, count(*) AS n_rows FROM t GROUP BY 1")
def _(spark, sf_dir):
    return counted(writers.corpus_rows(once(spark, sf_dir, "name", "n").select("__n", text("2/3 cups ", "@name", ", ", "@n", " g").alias("line"))), F.col("json"))


# streams


@query("stream_totals", "SELECT date_trunc('hour', ts) AS hour, 'weight' AS kind, CAST(sum(event_id % 50 + 1) AS DOUBLE) AS total, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    """Events as a stream of lines, parsed and summed by hour."""
    path, schema = f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema
    folder, name = path.rsplit("/", 1)
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    lines = source.select(F.col("ts").cast("timestamp").alias("ts"), F.concat((F.col("event_id") % 50 + 1).cast("string"), F.lit(" g "), F.col("event_type")).alias("line"))
    totals = streams.windowed_totals(streams.parse_stream(lines), "ts", "1 hour")
    out = scratch_path(spark, "stream")
    run = totals.writeStream.outputMode("complete").option("checkpointLocation", scratch_path(spark, "stream-state")).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "kind", "total", "n")


from larder import more_queries  # noqa: E402, F401  it registers its queries
