"""The extraction loop: payloads of every kind, retries, escalation, nulls and empty tables."""

import json

import pytest

from larder.kernel import documents, payload
from larder.operators import books, extraction
from pyspark.sql import functions as F


def recipes(x):
    return payload.recipes_of(x if isinstance(x, str) else json.dumps(x))


def test_payloads():
    plain = {"title": "Pie", "sections": [{"ingredients": ["1 g salt"], "instructions": ["Mix."]}], "times": {"total": "about 1 hr. 5 min", "cook": "overnight", "prep_minutes": 7, "prep": "1 hour"}}
    (made,), problem = recipes({"recipes": [plain]})
    assert problem is None and made["times"]["total_minutes"] == 65 and made["times"]["cook_minutes"] is None and made["times"]["prep_minutes"] == 7
    assert made["notes"] == [] and made["sections"][0]["name"] is None
    assert recipes({"recipes": json.dumps([plain])}) == ([made], None) and recipes({"recipes": [plain | {"sections": json.dumps(plain["sections"])}]}) == ([made], None)
    for nothing in ({"recipes": None}, {}, {"recipes": "  "}, {"recipes": []}):
        assert recipes(nothing) == ([], None)
    assert recipes({"recipes": [{"title": "x", "sections": None, "notes": None, "equipment": None}]})[0][0]["sections"] == []
    for wrong in ("{", "[]", "7", {"recipes": [{"sections": []}]}, {"recipes": [{"title": "x", "notes": [1]}]}, {"recipes": "[{"}, {"recipes": {"a": 1}}, {"recipes": [{"title": "x", "sections": [7]}]}, {"recipes": [{"title": "x", "times": {"total_minutes": -1}}]}, "[" * 5000):
        made, problem = recipes(wrong)
        assert made is None and problem


def test_chosen():
    assert payload.chosen('{"cookbook_indices": [1, 3, 9, 0, -1, true, "2"]}', 3) == [True, False, True]
    assert payload.chosen(None, 2) == payload.chosen("{", 2) == payload.chosen("{}", 2) == [False, False]


@pytest.mark.parametrize(("text", "minutes"), [("30 minutes", 30), ("~ 2 hrs", 120), ("1 h 5 m", 65), ("30 to 40 minutes", None), ("1 1/2 hours", None), ("30 minutes, plus chilling", None), ("overnight", None), ("", None), ("0 min", None), ("99999999999 min", None), ("1 hr. 15 min.", 75), ("5 minutesx", None)])
def test_prose_minutes(spark, text, minutes):
    from larder.functions import native as N

    assert documents.prose_minutes(text) == minutes == spark.range(1).select(N.prose_minutes(F.lit(text))).first()[0]


def answers(of):
    """An extractor that gives of(user, attempt) as the payload, and counts what it is asked."""
    asked = []

    def run(requests):
        rows = [(r["book"], r["chunk_idx"], *of(r["user"], r["attempt"])) for r in requests.collect()]
        asked.append(len(rows))
        return requests.sparkSession.createDataFrame([(b, c, x, t, 1, 2, None, 0) for b, c, x, t in rows], "book string, chunk_idx int, input string, truncated boolean, input_tokens int, output_tokens int, cache_write_tokens int, cache_read_tokens int")

    return run, asked


def test_retries_and_escalation(spark):
    good = json.dumps({"recipes": [{"title": "Pie", "sections": [{"ingredients": ["salt"]}]}]})
    texts = ["good", "later", "never", "cut", "none", "rescued"]
    chunks = spark.createDataFrame([("b", k, "hint" if k == 0 else None, "d", t) for k, t in enumerate(texts)] + [(None, 9, None, "d", "good")], "book string, chunk_idx int, title_hint string, doc_path string, text string")
    requests = extraction.chunk_requests(chunks)
    assert requests.where("chunk_idx = 0").first()["user"] == "Section title: hint\n\ngood"
    first, asked = answers(lambda u, n: (None if "none" in u else good if "good" in u or ("later" in u and n) else "{", "cut" in u))
    second, asked_second = answers(lambda u, n: (good if "rescued" in u else "{", False))
    got = {r["chunk_idx"]: r for r in extraction.drive(requests, first, "small", second, "large").collect()}
    assert asked == [7, 3] and asked_second == [3, 2] and len(got) == 7
    assert {k: r["n_calls"] for k, r in got.items()} == {0: 1, 1: 2, 2: 4, 3: 3, 4: 1, 5: 3, 9: 1}
    assert [len(got[k]["recipes"]) for k in range(6)] == [1, 1, 0, 0, 0, 1] and {k for k, r in got.items() if r["problem"]} == {2, 3}
    assert got[5]["model"] == "large" and got[0]["model"] == "small" and got[2]["input_tokens"] == 4 and got[0]["cache_write_tokens"] == 0
    outcomes = extraction.drive(requests, first, "small")
    assert {r["chunk_idx"] for r in extraction.cacheable(outcomes).collect()} == {0, 1, 4, 9}
    assert extraction.stats(outcomes.where("book = 'b'")).first().asDict() | {} == {"book": "b", "chunks_total": 6, "chunks_failed": 3, "chunks_truncated": 1, "n_recipes": 2, "n_calls": 9, "input_tokens": 9, "output_tokens": 18, "cache_write_tokens": 0, "cache_read_tokens": 0}
    rows = books.assemble(extraction.extracted_rows(outcomes, chunks))
    assert [(r["book"], r["title"], len(r["sections"])) for r in rows.collect()] == [("b", "Pie", 2)]
    assert extraction.drive(requests.where("false"), first, "small").count() == 0


def test_classification(spark):
    table = spark.createDataFrame([(f"p{k}", f"Book {k}", ["Cooking"] if k % 2 else []) for k in range(10)] + [("p3", "Book 3", ["Cooking"])], "path string, title string, subjects array<string>")
    numbered = extraction.batches(table, 4)
    assert numbered.groupBy("batch").count().agg(F.max("count")).first()[0] <= 4
    prompt = extraction.classify_prompt(spark.createDataFrame([("x", 1, "A", ["t", "u"]), ("x", 2, None, []), ("x", 3, "C", None)], "batch string, n int, title string, subjects array<string>")).first()
    assert prompt["user"] == "Books:\n1. A [tags: t, u]\n2. \n3. C\n"
    flags = extraction.chosen_books(numbered, numbered.select("batch", F.lit('{"cookbook_indices": [1, 77]}').alias("input")).distinct())
    assert flags.count() == 11 and flags.where("is_cookbook").count() == numbered.where("n = 1").count()
    assert extraction.chosen_books(numbered, numbered.select("batch", F.lit("{").alias("input")).limit(0)).where("is_cookbook").count() == 0
