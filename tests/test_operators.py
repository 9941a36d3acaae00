"""Native expressions against the kernel, and DataFrame operators."""

import json

from test_documents import book_bytes, ld

from larder.functions import native as N
from larder.functions import parsing as P
from larder.kernel import measures as M
from larder.kernel import normalize as K
from larder.operators import books, conversion, corpus, measures, recipes
from larder.plans import kitchen
from larder.sources import readers, writers
from larder.streaming import streams
from pyspark.sql import functions as F

LINES = ["•  2 cups oats*", "the 3 eggs", "2 batches of dough", "1 leek (see note)", "1 leek (this page; optional)", "2 lb (1 kg minus 1 g)", "oats (1 cup minus 1 g)", "beef (2 pounds total)", "3 ½-inch-thick slices ham", "2-inch piece (3 ounces) ginger", " a  b ", "", "plain", "①salt†"]


def test_native_rewrites_agree(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "line string")
    want = {x: K.normalize(x) for x in LINES}
    assert {r["line"]: r["n"] for r in lines.select("line", N.normalize_line("line").alias("n")).collect()} == want
    assert {r["line"]: r["n"] for r in N.normalize_lines(lines, "line", "n").collect()} == want


def test_native_functions_take_long_texts(spark):
    long = ["1 h " * 20_000, "PT" + "1M" * 20_000, "2 cups x (" + "see page 1, " * 20_000 + "see page 2)", "(" * 50_000, "*" * 50_000 + "x", " " * 50_000, "1-" * 20_000, "minus (" * 5_000]
    rows = spark.createDataFrame([(x,) for x in long], "line string")
    got = N.normalize_lines(rows, "line", "n").select("line", "n", N.prose_minutes("line").alias("p"), N.iso_minutes("line").alias("i")).collect()
    by = {r["line"]: r for r in got}
    assert by[long[0]]["p"] == 20_000 * 60 and by[long[1]]["i"] == 20_000 and all(by[x]["n"] == K.normalize(x) for x in long)


def test_document_measures_reads_whole_documents(spark, tmp_path):
    from larder.kernel import rich
    from larder.queries import QUERIES

    parts = ["Mix 2 cups oats", "bake for 20 minutes", "add 3 tsp salt", "rest 1 hour"]
    bare = lambda t: [m for k, _, ms in rich.parse(t, []) if k == "measure" for m in ms]
    rows = [(k, f" {c} ".join(parts)) for k, c in enumerate("|@=&%*_~<>[]{}$^")] + [(50, " 2eggs ".join(parts)), (51, "\n".join(parts)), (52, "x " * 20_000 + "| 4 cups"), (53, None), (54, ""), (55, "1 cup and 2eggs"), (56, "3e5e cups * 2 tsp")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in QUERIES["document_measures"](spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], {})[r["unit"]] = r["n"]
    want = {}
    for part in parts:
        for m in bare(part):
            want[m[0]] = want.get(m[0], 0) + 1
    assert sum(want.values()) == 4 and all(got[k] == want for k, _ in rows[:18])
    assert got[52] == {"cup": 1} and got[55] == {"cup": 1} and got[56].get("tsp") == 1 and not {53, 54} & set(got)


def test_native_measures_agree(spark):
    cases = [("cup", 1.0, None), ("tsp", 6.0, None), ("tsp", 1.5, 3.0), ("$", 5.0, 6.5), ("cent", 250.0, None), ("whole", 7 / 3, None), ("second", 7200.0, None), ("g", 0.1875, None), ("cup", 0.0, 5.0), ("lb", 3.0, 1.0), ("cloves", 2.0, None)]
    rows = spark.createDataFrame(cases, "u string, v double, w double").withColumn("m", N.make_measure("u", "v", "w"))
    got = rows.select(N.display_measure("m"), N.unit_kind("m.unit"), N.normalize_measure("m"), N.scale_measure("m", 3.0)).collect()
    for r, case in zip(got, cases):
        m = M.measure(*case)
        assert r[0] == M.display(m) and r[1] == M.kind_of(m[0])
        for mine, theirs in ((r[2], M.normalize(m)), (r[3], M.scale(m, 3.0))):
            assert mine[0] == theirs[0] and abs(mine[1] - float(theirs[1])) < 1e-9 and (mine[2] is None) == (theirs[2] is None)


def test_native_text(spark):
    rows = spark.createDataFrame([("PT1H30M", "about 1 hr. 20 min"), ("P1D", "2h"), ("PT", "x"), ("1H", "5"), ("P", ""), (None, None)], "a string, b string")
    got = rows.select(N.iso_minutes("a"), N.prose_minutes("b")).collect()
    assert [tuple(r) for r in got] == [(90, 80), (1440, 120), (None, None), (None, None), (None, None), (None, None)]
    r = spark.range(1).select(N.normalize_title(F.lit("The Best Pie!")), N.looks_like_title(F.lit("Best Pie")), N.looks_like_title(F.lit("2 pies")), N.is_notes_heading(F.lit(" Tips ")), N.truncate_text(F.lit("abcdef"), 3), N.truncate_number(F.lit(-1.23456)), N.round_sig(F.lit(123456.5)), N.humanize_minutes(F.lit(61))).first()
    assert tuple(r) == ("best pie", True, False, True, "abc...", -1.234, 123457.0, "1 hour 1 minute")


def test_nulls_give_nulls(spark):
    r = spark.createDataFrame([(None,)], "t string").select(P.parse_line("t"), P.parse_amount("t"), P.decompose("t"), P.passes("t"), P.parse_mapping("t"), P.rich_text("t", F.array(F.lit("a"))), recipes.parse_yield("t")).first()
    assert all(x is None for x in r)


def test_sql_functions(spark):
    P.register(spark)
    r = spark.sql("select parse_ingredient('2 cups oats').name, parse_amount('3 g')[0].value, size(ingredient_passes('2 large eggs')), parse_unit_mapping('4 lb = $5').b.unit").first()
    assert tuple(r) == ("oats", 3.0, 1, "$")


def test_traces(spark):
    r = spark.createDataFrame([("2 large eggs",), (None,)], "t string").select(P.trace_spans("t").alias("s"), P.trace_json("t").alias("j")).collect()
    assert [tuple(x) for x in r[0]["s"]] == [(0, None, "line", "parse_line"), (1, 0, "refine", "extract_size_unit_from_name")]
    spans = json.loads(r[0]["j"])["data"][0]["spans"]
    assert spans[1]["references"][0]["spanID"] == spans[0]["spanID"] and spans[0]["references"] == []
    assert r[1]["s"] is None


def test_sums(spark):
    rows = spark.createDataFrame([("a", "kg", 1.0, None), ("a", "g", 500.0, None), ("a", "cup", 1.0, 2.0), ("b", "g", None, None)], "k string, u string, v double, w double").select("k", N.make_measure("u", "v", "w").alias("measure"))
    got = {(r["k"], r["kind"]): tuple(r["total"]) for r in measures.sum_measures(rows, ["k"]).collect()}
    assert got == {("a", "weight"): ("g", 1500.0, None), ("a", "volume"): ("cup", 1.0, 2.0)}


def test_conversion(spark):
    stated = spark.createDataFrame([("g1", 0, "1 cup = 120 g"), ("g1", 1, "1 lb = $4"), ("g2", 0, "bad"), (None, 0, "1 g = $1")], "graph_id string, seq int, text string")
    mappings = stated.select("graph_id", "seq", P.parse_mapping("text").alias("m")).select("graph_id", "seq", "m.a", "m.b")
    closed = conversion.closure(mappings)
    m = lambda u, v: F.struct(F.lit(u).alias("unit"), F.lit(v).alias("value"), F.lit(None).cast("double").alias("upper_value"))
    rows = spark.createDataFrame([("g1", 0), ("g2", 1), ("g1", 2), ("g1", 3)], "graph_id string, i int").withColumn("measure", F.when(F.col("i") == 2, m("clove", 1.0)).when(F.col("i") == 3, m("pinch", 16.0)).otherwise(m("cup", 1.0)))
    got = {r["i"]: r for r in conversion.convert(rows, closed, "money").collect()}
    assert abs(got[0]["converted"]["value"] - 1.05822) < 1e-9 and [s["to_unit"] for s in got[0]["steps"]] == ["g", "cent"]
    assert got[1]["converted"] is None and got[2]["converted"] is None and got[3]["steps"][0]["to_unit"] == "tsp"
    assert conversion.convert_to_all(rows.limit(1), closed, ["money", "weight"]).count() == 2


def test_recipes(spark):
    pages = spark.createDataFrame([("http://a", ld(recipeInstructions=[{"text": "Mix the oats."}])), ("http://b", "<p>none"), ("http://c", None)], "url string, html string")
    r = kitchen.parsed_pages(pages).collect()
    assert len(r) == 1 and r[0]["ingredients"][0]["name"] == "oats" and [c["kind"] for c in r[0]["instructions"][0]] == ["text", "ing", "text"]
    lines = spark.createDataFrame([(1, 0, "2 cups oats"), (1, 1, "salt")], "id int, pos int, line string")
    steps = spark.createDataFrame([(1, 0, "Toast oats."), (2, 0, "Add oats.")], "id int, pos int, step string")
    got = {r["id"]: [c["kind"] for c in r["chunks"]] for r in recipes.parse_lines_by_recipe(lines, steps, "id").collect()}
    assert got == {1: ["text", "ing", "text"], 2: ["text"]}


def test_books(spark, tmp_path):
    (tmp_path / "x.EPUB").write_bytes(book_bytes())
    (tmp_path / "y.epub").write_bytes(b"broken")
    assert {(r["title"], r["authors"] is None) for r in readers.read_books(spark, str(tmp_path)).collect()} == {("Pies", False), ("y", True)}
    lines = readers.read_book_lines(spark, str(tmp_path))
    assert [r["text"] for r in lines.orderBy("pos").collect()] == ["Pie", "2 cups oats"]
    assert books.window_chunks(lines).first()["text"] == "Pie\n2 cups oats"
    content = readers.read_books(spark, str(tmp_path)).where("title = 'Pies'")
    assert content.select(books.book_cover("content")["bytes"], books.book_images("content", F.array(F.lit("O/i/c.png"), F.lit("no")))).first()[0] == b"png"


def test_assembly_and_references(spark):
    schema = "book string, chunk_idx int, recipe_idx int, title_hint string, doc_path string, title string, ingredients array<string>, instructions array<string>, notes array<string>, equipment array<string>, description string, category string"
    rows = [
        ("b", 0, 0, None, "d", " Oat Pie ", ["1 cup oats"], ["mix"], ["n1"], [], None, None),
        ("b", 1, 0, "oat pie", "d", "OAT PIE", [], ["bake"], ["n1", "n2"], ["tin"], "good", None),
        ("b", 1, 1, None, "e", "Lard", [], ["x"], [], [], None, None),
        ("b", 2, 0, None, "e", "Very Long Oat Pie", ["1 oat pie recipe", "2 cups very long oat pie"], [], None, None, None, "c"),
        ("b", 3, 0, None, "e", " ", ["x"], [], [], [], None, None),
    ]
    made = kitchen.cookbook_recipes(spark.createDataFrame([("b", [("Oat Pie", "#p")])], "book string, links array<struct<text:string,href:string>>"), spark.createDataFrame(rows, schema)).orderBy("recipe_pos").collect()
    assert [r["title"] for r in made] == ["Oat Pie", "Very Long Oat Pie"]
    assert made[0]["notes"] == ["n1", "n2"] and made[0]["description"] == "good" and len(made[0]["sections"]) == 2 and made[0]["url"] == "b#d"
    assert [tuple(x) for x in made[1]["references"]] == [("1 oat pie recipe", "Oat Pie", "linked")]


def test_corpus(spark, tmp_path):
    cup = lambda v: [dict(unit="cup", value=v)]
    rows = ["// a comment", "// --- One ---", json.dumps(dict(input="1 cup oats", name="oats", amounts=cup(1))), "", json.dumps(dict(input="2/3 cup rye", name="x", amounts=cup("2/3"), xfail="y")), "bad", "// --- Two ---", json.dumps(dict(input="salt", name="salt", amounts=[dict(unit="g", value="1.5")])), ""]
    (tmp_path / "c.jsonl").write_text("\n".join(rows))
    rows = readers.read_corpus(spark, str(tmp_path / "c.jsonl"))
    got = rows.orderBy("pos").collect()
    assert [(r["pos"], r["section"], r["problem"] is None) for r in got] == [(3, "One", True), (5, "One", True), (6, "One", False), (8, "Two", False)]
    scored = corpus.score(rows.where("problem is null"))
    assert {r["status"]: r["differs"] for r in scored.collect()} == {"exact": [], "xfail": ["name"]}
    t = corpus.tally(scored).first()
    assert (t["total"], t["exact"], t["xfail"], t["matched"], t["amounts_matched"]) == (2, 1, 1, 1, 2)
    assert "<th" in corpus.html_table(scored)
    try:
        corpus.strict(rows)
        raise AssertionError
    except ValueError as e:
        assert "line 6" in str(e)
    runs = corpus.sections(rows, ["file"]).orderBy("pos").collect()
    assert [r["run"] for r in runs] == [1, 1, 1, 2]


def test_rankings_and_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("oats no 5",), ("oats no 5",), ("2 cups rye",), ("salt",), (None,)], "line string")
    assert [tuple(r) for r in corpus.ranked_misses(lines).collect()] == [("oats no 5", 2)]
    assert {r["pass"] for r in corpus.unfired(lines).collect()} == {p for _, p in __import__("larder.kernel.line", fromlist=["x"]).stage_names()}
    made = writers.corpus_rows(lines).collect()
    assert [(r["json"], r["refused"]) for r in made][2] == (json.dumps(dict(input="2 cups rye", name="rye", amounts=[dict(unit="cup", value=2)])), None)
    assert made[0]["refused"] == "unparsed_digit" and made[4]["json"] is None
    parsed = lines.where("line is not null").withColumn("parsed", P.parse_line("line"))
    writers.write_parsed(parsed, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    assert [r["line"] for r in corpus.order_parsed(parsed, "confidence").collect()][0] == "oats no 5"


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.sql("select timestamp'2024-01-01 00:01:00' as ts, '2 cups oats' as line union all select timestamp'2024-01-01 00:02:00', '1 cup rye no'").write.parquet(src)
    stream = streams.parse_stream(spark.readStream.schema("ts timestamp, line string").parquet(src))
    q = streams.windowed_totals(stream, "ts").writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.read.parquet(out).collect()
    assert [(x["kind"], x["unit"], x["total"], x["n"]) for x in r] == [("volume", "tsp", 144.0, 2)]
