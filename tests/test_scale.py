"""That work is spread over tasks and done once for equal rows, and that what a task holds is bounded."""

from pathlib import Path

import pytest

from larder.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", ["made_page_lines", "parse_recipe_pages", "chunk_windows", "scrape_recipes"])
def test_small_files_are_spread(spark, name):
    """One small file was one task."""
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("name", ["clause_parens", "corpus_rows", "scored_html", "rich_measures", "rewrite_minus"])
def test_equal_rows_are_read_once(spark, name):
    """Python was asked of every row and the results counted; it stands above the count of distinct rows now."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    asked = [i for i, line in enumerate(plan) if "ArrowEvalPython" in line]
    assert asked and any("Aggregate" in line for line in plan[asked[-1] + 1 :])


@pytest.mark.parametrize("name", ["parse_recipe_pages", "scrape_recipes"])
def test_pages_are_scraped_once(spark, name):
    """The filter on what was scraped was pushed down with a second call."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("scraped(" in line and "ArrowEvalPython" in line for line in plan) == 1


def test_equal_labels_are_read_once(monkeypatch):
    import pyarrow as pa

    from larder.operators import corpus

    asked = []
    monkeypatch.setattr(corpus, "_corpus_row", lambda t: asked.append(t) or (t, None))
    monkeypatch.setattr(corpus, "_labels", lambda t: asked.append(t) or (None, t))
    assert corpus.corpus_row.__wrapped__(pa.array(["a", "b", None, "a"])).field("json").to_pylist() == ["a", "b", None, "a"]
    assert corpus.read_labels.__wrapped__(pa.array(["a", "b", None, "a"])).field("problem").to_pylist() == ["a", "b", None, "a"]
    assert asked == ["a", "b", "a", "b"]


def _stated(spark, n):
    from larder.operators import conversion

    rows = [(str(i), 0, ("cup", 1.0, None), ("g", 120.0, None)) for i in range(n)]
    return spark.createDataFrame(rows, "graph_id string, seq int, a struct<unit:string,value:double,upper_value:double>, b struct<unit:string,value:double,upper_value:double>"), conversion


def test_conversion_partitions_grow_with_the_mappings(spark, monkeypatch):
    """Their number was what the bytes of a shuffle came to, so that a task's graphs grew with the table."""
    stated, conversion = _stated(spark, 40)
    monkeypatch.setattr(conversion, "EDGES", 1)
    closed = conversion.closure(stated, ["g"])
    assert closed.rdd.getNumPartitions() == 40
    measures = stated.selectExpr("graph_id", "a AS measure")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large to be broadcast
    try:
        made = conversion.convert(measures, closed, "weight")
        assert made.rdd.getNumPartitions() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(r["graph_id"], r["converted"]["value"], r["converted"]["unit"]) for r in made.collect()} == {(str(i), 120.0, "g") for i in range(40)}


def test_closures_leave_a_worker_in_slices(spark):
    """A batch's closures were one batch of rows, with a Python object for each step of each."""
    import pyarrow as pa

    from larder.operators import conversion

    edge = {"seq": 0, "a": {"unit": "cup", "value": 1.0, "upper_value": None}, "b": {"unit": "g", "value": 120.0, "upper_value": None}}
    n = conversion.GRAPHS + 1
    batch = pa.RecordBatch.from_pylist([{"graph_id": str(i), "edges": [edge]} for i in range(n)])
    out = list(conversion._in_slices([batch], lambda name, g: [{"graph_id": name}], pa.schema([("graph_id", pa.string())])))
    assert [b.num_rows for b in out] == [conversion.GRAPHS, 1]
    assert [x for b in out for x in b.column(0).to_pylist()] == [str(i) for i in range(n)]


def test_books_are_folded_across_batches(spark):
    """A book's lines may come in several batches, and several books in one; the order of a book's lines is that of pos, then of their text."""
    from larder.operators import books

    rows = [(f"b{b}", p, "d", f"line {p} of {b}") for b in range(9) for p in (3, 1, 2)] + [("b0", 2, "d", "a")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        made = books.window_chunks(spark.createDataFrame(rows, "book string, pos int, doc_path string, text string")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    texts = {r["book"]: r["text"].split("\n") for r in made}
    assert texts == {f"b{b}": [f"line {p} of {b}" if p else "a" for p in ((1, 0, 2, 3) if b == 0 else (1, 2, 3))] for b in range(9)}


def test_equal_payloads_are_read_once(monkeypatch):
    import pyarrow as pa

    from larder.operators import extraction

    asked = []
    monkeypatch.setattr(extraction.K, "recipes_of", lambda t: asked.append(t) or ([], t))
    assert extraction.parse_payload.__wrapped__(pa.array(["x", None, "x"])).field("problem").to_pylist() == ["x", None, "x"]
    assert asked == ["x"]


@pytest.mark.parametrize("name", ["ascii_quantities", "status_filter"])
def test_rows_are_counted_before_they_are_shown(spark, name):
    """Interpreted expressions were asked of every row. status_filter reads what it has written, with the counts."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") > 1 and "__n" in plan


def test_equal_prose_is_read_once():
    import pyarrow as pa

    from larder.functions import parsing as P

    asked = []
    rows = [("a", ("x",)), ("b", ()), ("a", ("x",)), (None, ())]
    made = P.by_equal(rows, lambda r: asked.append(r) or r[0], pa.string())
    assert made.to_pylist() == ["a", "b", "a", None] and asked == rows[:2] + rows[3:]
