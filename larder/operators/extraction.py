"""The extraction loop over windows of cookbooks: requests, payloads, retries, escalation, costs; and the choice of cookbooks.

The extractor is given: a function of a DataFrame of requests (REQUEST, and `attempt`) that returns for each (book, chunk_idx) a row of
(book, chunk_idx, input, truncated, input_tokens, output_tokens, cache_write_tokens, cache_read_tokens), `input` being the JSON that
the model gave or null. How it reaches a model, and whether that is a table, is its own affair. What it gave is written to the
shared folder before anything else reads it, so no call is made again when a task is.

Defined results: a null input is no recipe and no failure; so is a request that the extractor has no row for. A payload that can't be
read is asked for again `retries` times, but not where it was cut off at the model's limit; then the escalation, if there is one, is
asked in the same way. What still can't be read is a row with its problem and no recipes. Token counts of all calls add up,
nulls counting as 0. Of several answers to a request the one that sorts first counts.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import native as N
from larder.functions.arrow import arrow
from larder.functions.parsing import by_equal
from larder.kernel import payload as K
from larder.runtime import materialize, spread

Extractor = Callable[[DataFrame], DataFrame]
TOKENS = ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")
SECTION = "struct<name:string,ingredients:array<string>,instructions:array<string>>"
TIMES = "struct<active:string,total:string,prep:string,cook:string,active_minutes:bigint,total_minutes:bigint,prep_minutes:bigint,cook_minutes:bigint>"
EXTRACTED = f"struct<title:string,description:string,recipe_yield:string,category:string,page:string,times:{TIMES},equipment:array<string>,notes:array<string>,sections:array<{SECTION}>>"
_T = pa.list_(pa.string())
_SECTION = pa.struct([("name", pa.string()), ("ingredients", _T), ("instructions", _T)])
_TIMES = pa.struct([*((k, pa.string()) for k in K.TIMES), *((f"{k}_minutes", pa.int64()) for k in K.TIMES)])
_EXTRACTED = pa.struct([*((k, pa.string()) for k in K.TEXTS), ("times", _TIMES), ("equipment", _T), ("notes", _T), ("sections", pa.list_(_SECTION))])
_PAYLOAD = pa.struct([("recipes", pa.list_(_EXTRACTED)), ("problem", pa.string())])

TOOL = "emit_recipes"
INSTRUCTIONS = """Find every recipe in this part of a cookbook; there may be none, one or several. Give an object for each:
title; description (what introduces it, if anything does); sections, most recipes having one without a name, others one for each
component, with name, ingredients and instructions, each line or step copied word for word as an entry of its own, quantities and units
unchanged; recipe_yield as printed; times (active, total, prep, cook) as printed; equipment that is listed; notes, every tip, footnote and
make-ahead remark as an entry of its own, copied word for word and given to the recipe that it is about; category, the chapter it stands in;
page. Leave out what isn't there. Pass over running text, page headers and captions. Where there is no recipe, give an empty list."""


def tool_schema() -> str:
    """The JSON schema of what the extractor must give."""
    text: dict = {"type": "string"}
    texts = {"type": "array", "items": text}
    section = {"type": "object", "properties": {"name": text, "ingredients": texts, "instructions": texts}, "required": ["ingredients"]}
    recipe = {k: text for k in K.TEXTS} | {"sections": {"type": "array", "items": section}, "times": {"type": "object", "properties": {k: text for k in K.TIMES}}, "equipment": texts, "notes": texts}
    recipes = {"type": "array", "items": {"type": "object", "properties": recipe, "required": ["title", "sections"]}}
    return json.dumps({"type": "object", "properties": {"recipes": recipes}, "required": ["recipes"]}, sort_keys=True)


def chunk_requests(chunks: DataFrame) -> DataFrame:
    """(book, chunk_idx, system, user, tool_name, tool_schema) of CHUNK rows; a window's hint stands before its text."""
    hint = F.concat(F.lit("Section title: "), F.col("title_hint"), F.lit("\n\n"))
    user = F.concat(F.coalesce(hint, F.lit("")), F.col("text"))
    return chunks.select("book", "chunk_idx", F.lit(INSTRUCTIONS).alias("system"), user.alias("user"), F.lit(TOOL).alias("tool_name"), F.lit(tool_schema()).alias("tool_schema"))


@arrow(f"struct<recipes:array<{EXTRACTED}>,problem:string>")
def parse_payload(text: pa.Array) -> pa.Array:
    """The recipes of a payload's JSON, or what is wrong with it; lists may be null, or be written as text. Null gives no recipes."""
    read = lambda t: dict(zip(("recipes", "problem"), ([], None) if t is None else K.recipes_of(t)))
    return by_equal(text.to_pylist(), read, _PAYLOAD)


@arrow("array<string>")
def lenient_texts(text: pa.Array) -> pa.Array:
    """The texts of a JSON list, of null (no texts) or of a list written as text; null for anything else."""

    def one(t: str | None):
        try:
            return K._texts(K.lenient_list(json.loads(t) if t is not None and t.strip() else None))
        except (ValueError, RecursionError):
            return None

    return pa.array([one(t) for t in text.to_pylist()], _T)


def fill_minutes(times: Column | str) -> Column:
    """TIMES with the minutes that its texts say, where no count is given."""
    t = F.col(times) if isinstance(times, str) else times
    minutes = [F.coalesce(t[f"{k}_minutes"], N.prose_minutes(t[k])).alias(f"{k}_minutes") for k in K.TIMES]
    return F.when(t.isNotNull(), F.struct(*(t[k].alias(k) for k in K.TIMES), *minutes))


def _asked(requests: DataFrame, extractor: Extractor, model: str, attempt: int) -> DataFrame:
    """One call for each request, read: (book, chunk_idx, recipes, problem, truncated, tokens, model)."""
    keys = requests.select(F.col("book").alias("__b"), F.col("chunk_idx").alias("__c"))
    given = extractor(requests.withColumn("attempt", F.lit(attempt)))
    w = Window.partitionBy("book", "chunk_idx").orderBy("input")
    given = given.select("book", "chunk_idx", F.col("input").cast("string").alias("input"), F.coalesce(F.col("truncated"), F.lit(False)).alias("truncated"), *(F.coalesce(F.col(t).cast("bigint"), F.lit(0)).alias(t) for t in TOKENS))
    given = given.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    given = materialize(given, "answers")
    rows = keys.join(given, F.col("__b").eqNullSafe(F.col("book")) & F.col("__c").eqNullSafe(F.col("chunk_idx")), "left").drop("book", "chunk_idx")
    rows = spread(rows).withColumn("__p", parse_payload("input"))
    tokens = [F.coalesce(t, F.lit(0)).alias(t) for t in TOKENS]
    return rows.select(F.col("__b").alias("book"), F.col("__c").alias("chunk_idx"), "__p.recipes", "__p.problem", F.coalesce("truncated", F.lit(False)).alias("truncated"), *tokens, F.lit(model).alias("model"))


def drive(requests: DataFrame, extractor: Extractor, model: str = "", escalation: Extractor | None = None, escalation_model: str = "", retries: int = 1) -> DataFrame:
    """(book, chunk_idx, recipes, problem, truncated, tokens, model, n_calls) of each request.

    Only what could not be read is asked again, so each further pass is as small as what is left; `model` is the last one asked.
    """
    requests = materialize(requests, "requests")
    calls, left = [], requests
    for asked, name in ((extractor, model), *(((escalation, escalation_model),) if escalation else ())):
        for attempt in range(retries + 1):
            got = materialize(_asked(left, asked, name, attempt).withColumn("turn", F.lit(len(calls))), "calls")
            calls.append(got)
            failed = got.where("problem is not null")
            again = failed.where("not truncated")
            if failed.isEmpty():
                return _outcomes(calls)
            if attempt < retries and not again.isEmpty():
                left = _of(requests, again)
                continue
            break
        unread = _latest(calls).where("problem is not null")
        if unread.isEmpty():
            break
        left = _of(requests, unread)
    return _outcomes(calls)


def _of(requests: DataFrame, rows: DataFrame) -> DataFrame:
    keys = rows.select(F.col("book").alias("__b"), F.col("chunk_idx").alias("__c")).distinct()
    return requests.join(keys, F.col("book").eqNullSafe(F.col("__b")) & F.col("chunk_idx").eqNullSafe(F.col("__c")), "left_semi")


def _all(calls: list[DataFrame]) -> DataFrame:
    out = calls[0]
    for c in calls[1:]:
        out = out.unionByName(c)
    return out


def _latest(calls: list[DataFrame]) -> DataFrame:
    fields = ["recipes", "problem", "truncated", "model"]
    return _all(calls).groupBy("book", "chunk_idx").agg(F.max_by(F.struct(*fields), "turn").alias("__l")).select("book", "chunk_idx", "__l.*")


def _outcomes(calls: list[DataFrame]) -> DataFrame:
    fields = ["recipes", "problem", "truncated", "model"]
    made = _all(calls).groupBy("book", "chunk_idx").agg(F.max_by(F.struct(*fields), "turn").alias("__l"), *(F.sum(t).alias(t) for t in TOKENS), F.count("*").cast("int").alias("n_calls"))
    return made.select("book", "chunk_idx", F.coalesce("__l.recipes", F.array().cast(f"array<{EXTRACTED}>")).alias("recipes"), "__l.problem", "__l.truncated", *TOKENS, "__l.model", "n_calls")


def cacheable(outcomes: DataFrame) -> DataFrame:
    """The outcomes that a cache may hold: those that were read and not cut off."""
    return outcomes.where("problem is null and not truncated")


def write_cache(outcomes: DataFrame, keys: DataFrame, path: str) -> None:
    """Add (cache_key, recipes) of what may be kept to the Parquet table at `path`; `keys` has (book, chunk_idx, cache_key)."""
    cacheable(outcomes).join(keys, ["book", "chunk_idx"]).select("cache_key", "recipes").write.mode("append").parquet(path)


def cached(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """(book, chunk_idx, recipes) of the requests that the cache holds; of equal keys the entry that sorts first counts."""
    held = cache.groupBy("cache_key").agg(F.min_by("recipes", F.xxhash64("recipes")).alias("recipes"))
    return keys.join(held, "cache_key").select("book", "chunk_idx", "recipes")


def stats(outcomes: DataFrame) -> DataFrame:
    """(book, chunks_total, chunks_failed, chunks_truncated, n_recipes, n_calls, tokens) of each book."""
    return outcomes.groupBy("book").agg(
        F.count("*").alias("chunks_total"), F.count_if(F.col("problem").isNotNull()).alias("chunks_failed"), F.count_if("truncated").alias("chunks_truncated"),
        F.sum(F.size("recipes")).alias("n_recipes"), F.sum("n_calls").alias("n_calls"), *(F.sum(t).alias(t) for t in TOKENS),
    )


def extracted_rows(outcomes: DataFrame, chunks: DataFrame) -> DataFrame:
    """What books.assemble() takes, a row for each recipe of each window."""
    rows = outcomes.select("book", "chunk_idx", F.posexplode("recipes").alias("recipe_idx", "r"))
    rows = rows.join(chunks.select("book", "chunk_idx", "title_hint", "doc_path"), ["book", "chunk_idx"], "left")
    return rows.select("book", "chunk_idx", "recipe_idx", "title_hint", "doc_path", "r.*")


# which books are cookbooks


def classify_prompt(books: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, user): the numbered list of each batch's books (batch, n, title, subjects), n counting from 1, for a model to choose from."""
    tags = F.when(F.size("subjects") > 0, F.concat(F.lit(" [tags: "), F.array_join("subjects", ", "), F.lit("]"))).otherwise("")
    line = F.concat(F.col("n").cast("string"), F.lit(". "), F.coalesce("title", F.lit("")), tags, F.lit("\n"))
    made = books.groupBy(batch).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    return made.select(batch, F.concat(F.lit("Books:\n"), F.col("lines")).alias("user"))


def batches(books: DataFrame, size: int = 100) -> DataFrame:
    """The books (path, title, subjects) with `batch` and their number `n` in it, at most `size` books to a batch.

    Books are numbered within groups by a hash, so no task numbers all of them.
    """
    groups = F.pmod(F.xxhash64("path"), F.lit(4096))
    at = F.row_number().over(Window.partitionBy("__g").orderBy("path", "title")) - 1
    rows = books.withColumn("__g", groups).withColumn("__at", at)
    return rows.withColumns({"batch": F.concat_ws("-", "__g", F.floor(F.col("__at") / size)), "n": (F.col("__at") % size + 1).cast("int")}).drop("__g", "__at")


def chosen_books(books: DataFrame, answers: DataFrame, batch: str = "batch") -> DataFrame:
    """The books with `is_cookbook` by the answers (batch, input); numbers that no book of the batch has are passed over, and a batch without an answer has none."""
    named = answers.select(F.col(batch).alias("__batch"), F.from_json("input", "cookbook_indices array<bigint>")["cookbook_indices"].alias("__named"))
    named = named.groupBy("__batch").agg(F.first("__named").alias("__named"))
    rows = books.join(named, F.col(batch) == F.col("__batch"), "left")
    return rows.withColumn("is_cookbook", F.coalesce(F.array_contains("__named", F.col("n").cast("bigint")), F.lit(False))).drop("__batch", "__named")
