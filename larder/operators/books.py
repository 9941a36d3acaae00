"""Cookbooks: lines, windows, extracted recipes assembled and cross-referenced."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import native as N
from larder.functions.arrow import arrow
from larder.functions.parsing import by_distinct
from larder.kernel import documents as K
from larder.runtime import spread

LINKS = "array<struct<text:string,href:string>>"
IMAGES = "array<struct<path:string,mime:string,alt:string>>"
LINE = f"struct<doc_path:string,text:string,links:{LINKS},images:{IMAGES}>"
META = "struct<title:string,authors:array<string>,subjects:array<string>,identifiers:array<string>>"
_LINKS = pa.list_(pa.struct([("text", pa.string()), ("href", pa.string())]))
_IMAGES = pa.list_(pa.struct([("path", pa.string()), ("mime", pa.string()), ("alt", pa.string())]))
_LINE = pa.struct([("doc_path", pa.string()), ("text", pa.string()), ("links", _LINKS), ("images", _IMAGES)])
_META = pa.struct([("title", pa.string()), *((k, pa.list_(pa.string())) for k in ("authors", "subjects", "identifiers"))])
CHUNK = "book string, chunk_idx int, title_hint string, doc_path string, first_line int, n_lines int, text string"


@arrow(f"array<{LINE}>")
def book_lines(data: pa.Array) -> pa.Array:
    """Lines of an EPUB's bytes in the order of reading; null for what is no EPUB."""
    return pa.array([None if b is None or not (book := K.open_book(b)) else book.lines() for b in data.to_pylist()], pa.list_(_LINE))


@arrow(META)
def book_metadata(data: pa.Array) -> pa.Array:
    return pa.array([None if b is None or not (book := K.open_book(b)) else book.metadata() for b in data.to_pylist()], _META)


@arrow("struct<path:string,mime:string,bytes:binary>")
def book_cover(data: pa.Array) -> pa.Array:
    out = []
    for b in data.to_pylist():
        book = K.open_book(b) if b is not None else None
        path = book.cover() if book else None
        found = book.resource(path) if path else None
        out.append(None if found is None else {"path": path, "mime": K.mime_of(path), "bytes": found})
    return pa.array(out, pa.struct([("path", pa.string()), ("mime", pa.string()), ("bytes", pa.binary())]))


@arrow("array<struct<path:string,mime:string,bytes:binary>>")
def book_images(data: pa.Array, paths: pa.Array) -> pa.Array:
    """The bytes of the given resources, each once, those that exist, from one opening of the book."""
    out = []
    for b, asked in zip(data.to_pylist(), paths.to_pylist()):
        book = K.open_book(b) if b is not None else None
        got = [(p, book.resource(p)) for p in dict.fromkeys(x for x in asked or [] if x)] if book else []
        out.append([{"path": p, "mime": K.mime_of(p), "bytes": r} for p, r in got if r is not None])
    return pa.array(out, pa.list_(pa.struct([("path", pa.string()), ("mime", pa.string()), ("bytes", pa.binary())])))


@arrow(f"array<struct<text:string,links:{LINKS},images:{IMAGES}>>")
def page_lines(html: pa.Array) -> pa.Array:
    """Lines of one page."""
    return by_distinct(html, lambda h: None if h is None else K.page_lines(h), pa.list_(pa.struct([("text", pa.string()), ("links", _LINKS), ("images", _IMAGES)])))


def window_chunks(lines: DataFrame, budget: int = K.BUDGET, slack: int = K.SLACK) -> DataFrame:
    """CHUNK of (book, pos, doc_path, text). A cut depends on the cuts before it, so one task folds a book, its books one after the other from
    sorted rows; books are spread by key. Of lines with one pos the first by path, then by text, stands first."""
    schema = pa.schema([("book", pa.string()), ("chunk_idx", pa.int32()), ("title_hint", pa.string()), ("doc_path", pa.string()), ("first_line", pa.int32()), ("n_lines", pa.int32()), ("text", pa.string())])

    def folded(book: str, held: list[tuple]) -> list[dict]:
        made = K.windows(held, budget, slack)
        return [{"book": book, "chunk_idx": i, "title_hint": w["title_hint"], "doc_path": w["doc_path"], "first_line": w["first"], "n_lines": w["n_lines"], "text": w["text"]} for i, w in enumerate(made)]

    def run(batches):
        book, held = None, []
        for batch in batches:
            out = []
            for name, path, text in zip(*(batch.column(c).to_pylist() for c in ("book", "doc_path", "text"))):
                if name != book:
                    out += folded(book, held) if held else []
                    book, held = name, []
                held.append((path, text))
            yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist(folded(book, held), schema)

    rows = lines.select(F.col("book").cast("string").alias("book"), F.col("pos").cast("bigint").alias("pos"), F.col("doc_path").cast("string").alias("doc_path"), F.col("text").cast("string").alias("text"))
    rows = spread(rows.where("book is not null and pos is not null and text is not null"), "book").sortWithinPartitions("book", "pos", "doc_path", "text")
    return rows.select("book", "doc_path", "text").mapInArrow(run, CHUNK)


def mock_extract(chunks: DataFrame, rules: DataFrame) -> DataFrame:
    """A deterministic extractor: (book, chunk_idx, recipes) by rules (rule_idx, needle, recipes); the first rule whose needle a chunk's
    text holds or whose needle is its hint. Whether the rules are broadcast is left to their size."""
    hit = F.contains(chunks["text"], rules["needle"]) | (chunks["title_hint"] == rules["needle"])
    w = Window.partitionBy("book", "chunk_idx").orderBy("rule_idx")
    return chunks.join(rules, hit).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "needle", "rule_idx")


def assemble(extracted: DataFrame) -> DataFrame:
    """Recipes of a book from what each chunk gave, one row for each (book, title).

    `extracted` has (book, chunk_idx, recipe_idx, title_hint, doc_path, title, notes, equipment, description, category), and either `sections`
    or one section as (ingredients, instructions); recipe_yield, times, page and image (the recipe's photo in its chunk) where there
    are any. Blank titles go. A recipe without ingredients counts only as the continuation that its chunk's hint announces of a title
    known before. The first occurrence names the recipe; later ones append their sections, add notes and equipment that are new, and fill what is null.
    """
    at = F.struct("chunk_idx", "recipe_idx")
    rows = extracted.withColumn("title", F.trim("title")).where("title <> ''").withColumns({"__key": F.lower("title"), "__at": at})
    if "sections" not in extracted.columns:
        rows = rows.withColumn("sections", F.array(F.struct(F.lit(None).cast("string").alias("name"), "ingredients", "instructions")))
    rows = rows.withColumn("__full", F.coalesce(F.exists("sections", lambda s: F.size(s["ingredients"]) > 0), F.lit(False)))
    by = Window.partitionBy("book", "__key").orderBy("__at")
    known = F.coalesce(F.max("__full").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.where(F.col("book").isNotNull()).withColumn("__known", known)
    rows = rows.where(F.col("__full") | (F.col("__known") & (F.lower(F.trim("title_hint")) == F.col("__key"))))
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("__at", F.expr(c).alias("v")))), lambda x: x["v"])
    union = lambda c: F.array_distinct(F.flatten(ordered(f"coalesce({c}, array())")))
    first = lambda c: F.get(ordered(c), F.lit(0))
    filled = lambda c: F.get(F.filter(ordered(c), lambda x: x.isNotNull()), F.lit(0)).alias(c)
    more = [filled(c) for c in ("recipe_yield", "times", "page", "image") if c in extracted.columns]
    made = rows.groupBy("book", "__key").agg(
        F.min("__at").alias("__first"), first("title").alias("title"), F.flatten(ordered("coalesce(sections, array())")).alias("sections"), union("notes").alias("notes"), union("equipment").alias("equipment"),
        filled("description"), filled("category"), F.concat("book", F.lit("#"), first("doc_path")).alias("url"), *more,
    )
    return made.withColumn("recipe_pos", F.row_number().over(Window.partitionBy("book").orderBy("__first"))).drop("__key", "__first")


def title_lines(extracted: DataFrame, chunks: DataFrame) -> DataFrame:
    """(book, chunk_idx, recipe_pos, line_idx): the first line of its chunk that holds each extracted recipe's title as whole words;
    recipe_pos is the row's recipe_idx."""
    lines = chunks.select("book", "chunk_idx", F.posexplode(F.split("text", "\n")).alias("line_idx", "__line")).withColumn("__norm", N.normalize_title("__line")).where("__norm <> ''")
    titles = extracted.select("book", "chunk_idx", F.col("recipe_idx").alias("recipe_pos"), N.normalize_title("title").alias("__title")).where("__title <> ''")
    hit = titles.join(lines, ["book", "chunk_idx"]).where(N.contains_title("__norm", "__title"))
    return hit.groupBy("book", "chunk_idx", "recipe_pos").agg(F.min("line_idx").alias("line_idx"))


def resolve_references(recipes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(book, recipe_pos, line, title, confidence): for each ingredient line the longest title of another recipe of its book in it.

    `recipes` has (book, recipe_pos, title, lines). Short titles need a marker such as "recipe" or "page" in the line. Lines meet titles by their
    first word within a book, an equi-join, and not each line each title.
    """
    titled = recipes.select("book", F.col("recipe_pos").alias("__to"), F.col("title").alias("__title"), N.normalize_title("title").alias("__norm")).where("__norm <> ''")
    titled = titled.withColumns({"__word": F.substring_index("__norm", " ", 1), "__long": (F.size(F.split("__norm", " ")) >= 3) | (F.octet_length("__norm") >= 12)})
    lines = recipes.select("book", "recipe_pos", F.explode("lines").alias("line")).where("line is not null").distinct().withColumn("__text", N.normalize_title("line")).where("__text <> ''")
    words = lines.withColumn("__word", F.explode(F.array_distinct(F.split("__text", " "))))
    found = words.join(titled, ["book", "__word"]).where((F.col("recipe_pos") != F.col("__to")) & (F.col("__long") | N.has_reference_marker("__text")) & N.contains_title("__text", "__norm"))
    w = Window.partitionBy("book", "recipe_pos", "line").orderBy(F.octet_length("__norm").desc(), "__to")
    best = found.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    if links is None:
        return best.select("book", "recipe_pos", "line", F.col("__title").alias("title"), F.lit("title_match").alias("confidence"))
    linked = links.select("book", N.normalize_title("text").alias("__norm"), F.lit(True).alias("__linked")).distinct()
    best = best.join(linked, ["book", "__norm"], "left")
    return best.select("book", "recipe_pos", "line", F.col("__title").alias("title"), F.when(F.col("__linked"), "linked").otherwise("title_match").alias("confidence"))


def reference_index(references: DataFrame) -> DataFrame:
    """(book, title, used_by): which recipes refer to a title, each once."""
    return references.groupBy("book", "title").agg(F.sort_array(F.collect_set("recipe_pos")).alias("used_by"))


def reference_graph(references: DataFrame, recipes: DataFrame) -> DataFrame:
    """(book, from_pos, to_pos, from_title, to_title): an edge for each recipe that uses another, each once.

    `recipes` has (book, recipe_pos, title); a reference's title is resolved to the recipe of its book that has it.
    """
    to = recipes.select("book", F.col("title").alias("__t"), F.col("recipe_pos").alias("to_pos"))
    by = recipes.select("book", F.col("recipe_pos").alias("from_pos"), F.col("title").alias("from_title"))
    made = references.select("book", F.col("recipe_pos").alias("from_pos"), F.col("title").alias("__t")).distinct().join(to, ["book", "__t"])
    return made.where("from_pos <> to_pos").join(by, ["book", "from_pos"]).select("book", "from_pos", "to_pos", "from_title", F.col("__t").alias("to_title"))


def hero_images(titles: DataFrame, images: DataFrame) -> DataFrame:
    """(book, recipe_pos, path): the image nearest at or above a title's line, else the nearest below, within the chunk.

    `titles` has (book, chunk_idx, recipe_pos, line_idx), `images` (book, chunk_idx, line_idx, path).
    """
    near = images.select("book", "chunk_idx", F.col("line_idx").alias("__at"), "path")
    rows = titles.join(near, ["book", "chunk_idx"])
    below, far = F.col("__at") > F.col("line_idx"), F.abs(F.col("__at") - F.col("line_idx"))
    w = Window.partitionBy("book", "chunk_idx", "recipe_pos").orderBy(below, far, "__at", "path")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("book", "chunk_idx", "recipe_pos", "path")


def nearest_lines(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc, point_id, line_idx): the line range [start, end) that holds or is nearest to each offset; of two as near the later."""
    rows = points.join(ranges, "doc")
    inside = (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end"))
    after = F.col("offset") < F.col("start")
    far = F.when(inside, 0).when(after, F.col("start") - F.col("offset")).otherwise(F.col("offset") - F.col("end") + 1)
    w = Window.partitionBy("doc", "point_id").orderBy(far, F.when(after, 0).otherwise(1), "line_idx")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("doc", "point_id", "line_idx")


def low_confidence_lines(lines: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Lines with a digit and no amount."""
    return lines.where(F.col(parsed)["parse_notes"]["unparsed_digit"])


COOKING_WORDS = ("baking", "beverage", "cocktail", "cook", "cuisine", "culinary", "dessert", "food", "gastronom", "kitchen", "pastry", "recipe", "vegan", "vegetarian")


def classify_books(books: DataFrame, words: tuple[str, ...] = COOKING_WORDS) -> DataFrame:
    """The books with `guess`: yes where a subject or the title holds a cooking word, unknown without subjects, else no."""
    pattern = "|".join(words)
    told = F.exists("subjects", lambda s: F.lower(s).rlike(pattern)) | F.lower(F.coalesce("title", F.lit(""))).rlike(pattern)
    empty = F.coalesce(F.size("subjects"), F.lit(0)) <= 0
    return books.withColumn("guess", F.when(told, "yes").when(empty, "unknown").otherwise("no"))


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, cost_usd) of token counts (model, input_tokens, output_tokens, cache_write_tokens, cache_read_tokens) by the price whose
    key is the longest that the model's name holds; null without one. Writing to a cache costs 1.25 times, reading 0.1 times an input token."""
    total = usage.groupBy("model").agg(*(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")))
    hit = total.join(prices, F.contains(F.lower(total["model"]), prices["key"]), "left")
    best = hit.withColumn("__n", F.row_number().over(Window.partitionBy("model").orderBy(F.length("key").desc_nulls_last(), "key"))).where("__n = 1")
    tokens = F.col("input_tokens") + F.col("cache_write_tokens") * 1.25 + F.col("cache_read_tokens") * 0.1
    return best.select("model", ((tokens * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6).alias("cost_usd"))


def uncached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose key the cache doesn't hold."""
    return requests.join(cache.select("cache_key"), "cache_key", "left_anti")
