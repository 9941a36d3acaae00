"""Pages, recipe JSON and books."""

import io
import json
import zipfile

import pytest

from larder.kernel import documents as D


LD = '<script type="application/' + "ld+json\">"


def ld(**more):
    d = {"name": "Pie &amp;amp; Mash", "recipeIngredient": ["2&nbsp;cups oats"], "recipeInstructions": [{"text": "Mix."}]} | more
    return f"{LD}{json.dumps(d)}</script>"


def test_linked_data():
    got = D.scrape(ld(recipeYield=["x", "Serves 6"], totalTime="PT1H30M", tool=[{"name": "pan"}, "n/a"], image=[{"url": "i.png"}]), "http://a.org")
    assert got["name"] == "Pie & Mash" and got["ingredients"] == ["2 cups oats"] and got["servings"] == 6
    assert got["total_minutes"] == 90 and got["equipment"] == ["pan"] and got["image"] == "i.png"


@pytest.mark.parametrize(
    ("shape", "steps", "notes"),
    [
        ([{"text": "a"}, {"text": "b"}], ["a", "b"], []),
        ([{"name": "Dough", "itemListElement": [{"text": "a"}]}, {"name": "Tips", "itemListElement": [{"text": "n"}]}, {"text": "b"}], ["a", "b"], ["n"]),
        ("<p>a</p><p>b</p>", ["a", "b"], []),
        ([[{"text": "a"}], [{"text": "b"}]], ["a", "b"], []),
    ],
)
def test_instruction_shapes(shape, steps, notes):
    got = D.scrape(ld(recipeInstructions=shape), "u")
    assert (got["instructions"], got["notes"]) == (steps, notes)


def test_roots():
    d = json.loads(ld().split(">", 1)[1].rsplit("<", 1)[0])
    assert D.recipe_of_json(json.dumps({"@graph": [{"a": 1}, d]}), "u")["name"] and D.recipe_of_json(json.dumps([d]), "u")
    for bad in ("[]", "{}", "x", "null", '{"@graph": []}', "[" * 100_000):
        assert D.recipe_of_json(bad, "u") is None


def test_fallbacks():
    page = f'<title>T</title>{LD}{{bad</script>' + '<li class="jetpack-recipe-ingredient">1 egg</li><li class="jetpack-recipe-ingredient x">salt</li><div class="jetpack-recipe-directions">Mix.\nBake.</div><meta property="og:image" content="p.jpg">'
    got = D.scrape(page, "u")
    assert (got["name"], got["ingredients"], got["instructions"], got["image"]) == ("T", ["1 egg", "salt"], ["Mix.", "Bake."], "p.jpg")
    assert D.scrape("<p>nothing", "u") is None and D.scrape("", "u") is None
    api = json.dumps({"title": "t", "url": "u", "image": "i", "ingredients": [{"title": "oats", "quantity": 2, "unit": "g", "note": "fine"}], "steps": [{"directions": "mix"}]})
    assert D.scrape(api, "https://www.chefsteps.com/x")["ingredients"] == ["2 g oats, fine"]
    assert D.scrape(api, "https://notchefsteps.com/x") is None


def test_values():
    assert [D.iso_minutes(x) for x in ("PT1H5M", "P1DT1M", "PT30S", "PT", "P", "1H", "PT5", "PT1H1")] == [65, 1441, None, None, None, None, None, None]
    assert D.humanize(61) == "1 hour 1 minute" and D.humanize(120) == "2 hours"
    assert D.parse_yield("Makes 4 servings") == {"value": 4.0, "unit": "serving", "servings": 4} and D.parse_yield("none") is None
    assert D.null_paths('{"a": [1, null], "b": {"c": null}}') == ["a[1]", "b.c"] and D.null_paths("x") == []
    assert D.resolve_relative("a/b/c.xhtml", "../i/p.png#x") == "a/i/p.png" and D.resolve_relative("a", "http://x/p.png") is None
    assert D.mime_of("x/Y.JPG") == "image/jpeg" and D.mime_of("x") is None
    assert D.nearest_line([(0, 4), (8, 12)], 6) == 1 and D.nearest_line([(0, 4), (9, 12)], 5) == 0 and D.nearest_line([], 1) is None


def test_page_lines():
    got = D.page_lines('<head><title>no</title></head><p>One <a href="#x">two</a></p><img src="i/p.png" alt="A"><script/><div>Three<br>Four</div><table><tr><td>oats</td><td>50 g</td></tr><tr><td>1</td><td>x</td></tr></table>', "t/d.xhtml")
    assert [x["text"] for x in got] == ["One two", "Three", "Four", "oats (50 g)", "1 x"]
    assert got[0]["links"] == [{"text": "two", "href": "#x"}]
    assert [i["path"] for x in got for i in x["images"]] == ["t/i/p.png"]


def book_bytes(pages=("<h1>Pie</h1><p>2 cups oats</p>",)):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="p{i}" href="p{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(pages)))
        refs = "".join(f'<itemref idref="p{i}"/>' for i in range(len(pages)))
        z.writestr("O/c.opf", f'<package xmlns:dc="d"><metadata><dc:title> Pies </dc:title><dc:creator>A</dc:creator><dc:subject>Cooking</dc:subject><meta name="cover" content="cv"/></metadata><manifest>{items}<item id="cv" href="i/c.png" media-type="image/png"/></manifest><spine>{refs}</spine></package>')
        for i, p in enumerate(pages):
            z.writestr(f"O/p{i}.xhtml", "﻿" + p)
        z.writestr("O/i/c.png", b"png")
    return out.getvalue()


def test_book():
    book = D.open_book(book_bytes())
    assert book.metadata() == {"title": "Pies", "authors": ["A"], "subjects": ["Cooking"], "identifiers": []}
    assert [(x["doc_path"], x["text"]) for x in book.lines()] == [("O/p0.xhtml", "Pie"), ("O/p0.xhtml", "2 cups oats")]
    assert book.cover() == "O/i/c.png" and book.resource("O/i/c.png") == b"png" and book.resource("no") is None
    assert D.open_book(b"") is None and D.open_book(b"PK") is None


def test_windows():
    lines = [("d", "Title one")] + [("d", "x" * 99 + ".")] * 5 + [("e", "Title two")] + [("e", "y" * 99 + ".")] * 12
    got = D.windows(lines, 400, 300)
    assert [(w["first"], w["n_lines"], w["title_hint"], w["doc_path"]) for w in got] == [(0, 6, None, "d"), (6, 8, None, "e"), (14, 5, "Title two", "e")]
    assert "\n".join(w["text"] for w in got) == "\n".join(t for _, t in lines)
    assert D.windows([], 1, 1) == []
