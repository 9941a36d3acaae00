"""Whole plans: what a user of the engine runs end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import native as N
from larder.functions import parsing as P
from larder.operators import books, conversion, measures, recipes


def shopping_list(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, kind, total, shown): all amounts of each ingredient added up by kind. `lines` has the keys and `line`."""
    rows = lines.select(*keys, P.parse_line("line").alias("p")).select(*keys, F.lower("p.name").alias("name"), F.explode("p.amounts").alias("m"))
    rows = rows.withColumn("measure", F.struct(*(F.col("m")[k].alias(k) for k in ("unit", "value", "upper_value"))))
    made = measures.sum_measures(rows, [*keys, "name"])
    return made.withColumn("shown", N.display_measure("total"))


def priced_lines(lines: DataFrame, mappings: DataFrame) -> DataFrame:
    """Lines (graph_id, line) with the price of their first amount by the mappings (graph_id, seq, text) of their graph."""
    stated = mappings.select("graph_id", "seq", P.parse_mapping("text").alias("m")).where("m.error is null").select("graph_id", "seq", "m.a", "m.b")
    rows = lines.withColumn("__p", P.parse_line("line")).withColumn("measure", F.get(F.col("__p.amounts"), F.lit(0))).drop("__p")
    return conversion.convert(rows.where("measure is not null"), conversion.closure(stated, [conversion.goal_unit("money")]), "money")


def cookbook_recipes(lines: DataFrame, extracted: DataFrame) -> DataFrame:
    """Recipes with their references, from a book table's lines (for its links) and what the extractor gave for each window."""
    made = books.assemble(extracted)
    links = lines.select("book", F.explode("links").alias("l")).select("book", "l.text")
    flat = made.withColumn("lines", F.flatten(F.transform("sections", lambda s: s["ingredients"])))
    found = books.resolve_references(flat, links).groupBy("book", "recipe_pos").agg(F.sort_array(F.collect_list(F.struct("line", "title", "confidence"))).alias("references"))
    return made.join(found, ["book", "recipe_pos"], "left")


def parsed_pages(pages: DataFrame) -> DataFrame:
    """(url, ingredients, instructions) of every page that holds a recipe."""
    return recipes.parse_recipes(recipes.scrape(pages))
