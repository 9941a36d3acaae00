"""Pages to recipes to parsed recipes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import parsing as P
from larder.functions.arrow import arrow
from larder.kernel import documents as K

RECIPE = (
    "struct<name:string,url:string,image:string,description:string,category:string,recipe_yield:struct<value:double,unit:string>,servings:int,"
    "total_minutes:bigint,prep_minutes:bigint,cook_minutes:bigint,total:string,prep:string,cook:string,notes:array<string>,equipment:array<string>,ingredients:array<string>,instructions:array<string>,"
    "sections:array<struct<name:string,ingredients:array<string>,instructions:array<string>>>>"
)
_T = pa.list_(pa.string())
_RECIPE = pa.struct([*((k, pa.string()) for k in ("name", "url", "image", "description", "category")), ("recipe_yield", pa.struct([("value", pa.float64()), ("unit", pa.string())])), ("servings", pa.int32()), *((f"{k}_minutes", pa.int64()) for k in ("total", "prep", "cook")), *((k, pa.string()) for k in ("total", "prep", "cook")), ("notes", _T), ("equipment", _T), ("ingredients", _T), ("instructions", _T), ("sections", pa.list_(pa.struct([("name", pa.string()), ("ingredients", _T), ("instructions", _T)])))])


@arrow(RECIPE)
def scraped(html: pa.Array, url: pa.Array) -> pa.Array:
    """RECIPE of a page; null where it holds none."""
    return pa.array([None if h is None else K.scrape(h, u or "") for h, u in zip(html.to_pylist(), url.to_pylist())], _RECIPE)


def with_cache(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """(url, html) of the asked urls, from the cache where it has them, else from the pages themselves; null html where neither does."""
    held = cache.groupBy(F.col("url").alias("__url")).agg(F.max("html").alias("__html"))
    joined = pages.join(held, pages["url"] == F.col("__url"), "left")
    own = F.col("html") if "html" in pages.columns else F.lit(None).cast("string")
    return joined.select(pages["url"], F.coalesce("__html", own).alias("html"))


def scrape(pages: DataFrame) -> DataFrame:
    """(url, recipe) of each page of (url, html) that holds a recipe. Pages that can't hold one are ruled out before Python."""
    rows = pages.select("url", "html").where(F.col("html").isNotNull())
    may = F.col("html").contains("ld+json") | F.col("html").contains("jetpack-recipe") | F.col("url").contains("chefsteps.com")
    # no filter on `recipe`: it would be pushed down with the function, which would then read each page twice and where the rows aren't spread yet
    found = F.array_compact(F.array(scraped("html", F.coalesce("url", F.lit("")))))
    return rows.where(may).select("url", F.explode(found).alias("recipe"))


def parse_recipes(recipes: DataFrame, key: str = "url") -> DataFrame:
    """(key, ingredients, instructions) of (key, recipe): lines parsed, then instructions chunked with all names of the recipe.

    Both phases work within a row, on arrays, so nothing is shuffled: lines are parsed one array at a time, and their names
    are at hand when the instructions are.
    """
    parsed = recipes.select(key, parsed_lines(F.col("recipe.ingredients")).alias("ingredients"), F.col("recipe.instructions").alias("__steps"))
    names = F.filter(F.transform("ingredients", lambda p: p["name"]), lambda n: n != "")
    return parsed.select(key, "ingredients", chunked_steps(F.col("__steps"), names).alias("instructions"))


_INGREDIENTS = f"array<{P.T.INGREDIENT}>"


@arrow(_INGREDIENTS)
def parsed_lines(lines: pa.Array) -> pa.Array:
    rows = [None if ls is None else tuple(ls) for ls in lines.to_pylist()]
    return P.by_equal(rows, lambda ls: None if ls is None else [P._ingredient(t, ()) for t in ls if t is not None], pa.list_(P._INGREDIENT))


@arrow(f"array<{P.T.CHUNKS}>")
def chunked_steps(steps: pa.Array, names: pa.Array) -> pa.Array:
    """Chunks of each instruction; one with a malformed number is left out. Steps differ from page to page, so none are kept beyond a batch."""

    def chunked(row: tuple) -> list | None:
        texts, known = row
        made = [P._chunks.__wrapped__(t, known or ()) for t in texts or () if t is not None]
        return None if texts is None else [m for m in made if m is not None]

    fixed = lambda c: [None if x is None else tuple(x) for x in c.to_pylist()]
    return P.by_equal(list(zip(fixed(steps), fixed(names))), chunked, pa.list_(P._CHUNKS))


def parse_lines_by_recipe(lines: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """The same for tables of single lines (key, pos, line) and steps (key, pos, step): names meet steps by one shuffle on the key."""
    parsed = lines.select(key, "pos", P.parse_line("line").alias("parsed"))
    names = parsed.where("parsed.name <> ''").groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("parsed.name").alias("name")))), lambda x: x["name"]).alias("names"))
    return steps.join(names, key, "left").select(key, "pos", P.rich_text("step", F.coalesce("names", F.array().cast("array<string>"))).alias("chunks"))


@arrow("struct<value:double,unit:string,servings:int>")
def parse_yield(text: pa.Array) -> pa.Array:
    return P.by_distinct(text, K.parse_yield, pa.struct([("value", pa.float64()), ("unit", pa.string()), ("servings", pa.int32())]))


@arrow("string")
def decode_entities(text: pa.Array) -> pa.Array:
    return P.by_distinct(text, K.decode_entities, pa.string())


@arrow("array<string>")
def null_paths(text: pa.Array) -> pa.Array:
    return P.by_distinct(text, K.null_paths, pa.list_(pa.string()))
