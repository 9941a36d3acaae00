"""The line grammar: amounts, rewrites, clauses, repairs, refinements, usage and notes."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.kernel import line as L
from larder.kernel import rich, vocab
from larder.kernel.grammar import Abort, measures, parse_amount, parse_amount_string, parse_mapping
from larder.kernel.measures import GLYPHS, display
from larder.kernel.normalize import normalize, strip_optional

PARSER = L.LineParser()


def shown(text):
    got = PARSER.parse(text)
    return got.name, [display(m) for m in got.amounts], got.modifier


@pytest.mark.parametrize(
    ("text", "name", "amounts", "modifier"),
    [
        ("3 cups rye flour, sifted", "rye flour", ["3 cups"], "sifted"),
        ("2¼ cups / 300g rye flour", "rye flour", ["2¼ cups", "300 g"], None),
        ("3 large potatoes", "potatoes", ["3 large"], None),
        ("2 cups chopped leek", "leek", ["2 cups"], "chopped"),
        ("1 small or medium garlic clove, crushed", "garlic", ["1 clove"], "small or medium, crushed"),
        ("One 5-ounce celery stalk", "celery", ["1 stalk", "5 oz"], None),
        ("2 red or white cabbages", "red cabbages", ["2"], "or white cabbages"),
        ("1 cup milk or cream", "milk", ["1 cup"], "or cream"),
        ("Zest of 2 lemons, grated", "lemons", ["2"], "zest of, grated"),
        ("Honey — 3 tablespoons", "Honey", ["3 tbsp"], None),
        ("1/3 cup coarsely chopped, raw almonds", "raw almonds", ["⅓ cup"], "coarsely chopped"),
        ("1 cup minus 2 tablespoons oats", "oats", ["1 cup"], "minus 2 tablespoons"),
        ("corn, sunflower, or roasted walnut oil", "corn oil", [], "or sunflower, or roasted walnut oil"),
        ("1 cup plus 2 tbsp oats", "oats", ["1⅛ cups"], None),
        ("1 cup plus 2 grams oats", "oats", ["1 cup", "2 g"], None),
        ("2 tsp to 3 tbsp oats", "oats", ["2 tsp", "3 tbsp"], None),
        ("3 x 50g butter", "butter", ["150 g"], None),
        ("up to 4 g yeast", "yeast", ["4 g"], None),
        ("1,500 g beef", "beef", ["1500 g"], None),
        ("4- to 5-pound duck", "duck", ["4 - 5 lb"], None),
        ("1 (14-ounce) can beans", "beans", ["1 can", "14 oz"], None),
        ("4 TBSP [56 G] LARD", "LARD", ["4 tbsp", "56 g"], None),
        ("generous pinch of nutmeg", "nutmeg", ["1 pinch"], None),
        ("1 T sugar", "sugar", ["1 tbsp"], None),
        ("1 t sugar", "sugar", ["1 tsp"], None),
        ("2 leaves basil", "basil", ["2 leave"], None),
        ("Olive oil for brushing the tin", "Olive oil", [], "for brushing the tin"),
        ("1 cup thyme and freshly ground pepper", "thyme and freshly ground pepper", ["1 cup"], None),
        ("2 cups water (about 110°F) mix", "water mix", ["2 cups"], "about 110°F"),
        ("", "", [], None),
    ],
)
def test_lines(text, name, amounts, modifier):
    assert shown(text) == (name, amounts, modifier)


@pytest.mark.parametrize(
    ("text", "confidence", "reasons"),
    [("2 cups oats", "high", []), ("salt", "medium", []), ("1+1 pills", "low", ["fell_back", "unparsed_digit"]), ("2eggs", "low", ["fell_back", "unparsed_digit"]), ("lard (2 sticks minus 1 tablespoon)", "low", ["unparsed_digit"])],
)
def test_notes(text, confidence, reasons):
    got = PARSER.parse(text)
    assert (got.confidence, got.reasons()) == (confidence, reasons)


@pytest.mark.parametrize(
    ("text", "usage"),
    [("flour, for dusting", "dredging"), ("oil for frying", "frying_medium"), ("butter for the pan", "pan_grease"), ("salt to taste", "seasoning"), ("dill for garnish", "garnish"), ("1 cup sugar, plus more for dusting", "normal"), ("oil, for frying, to taste", "frying_medium"), ("soy, for the marinade", "marinade")],
)
def test_usage(text, usage):
    assert PARSER.parse(text).usage == usage


def test_usage_by_section():
    assert L.usage("soy", section="For the Brine") == "marinade"


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("•  2 cups oats*", "2 cups oats"), ("the 3 eggs", "3 eggs"), ("2 batches of dough", "2 recipe dough"), ("1 leek (see note)", "1 leek"), ("1 leek (this page; optional)", "1 leek (optional)"), ("2 lb (1 kg minus 1 g)", "2 lb"), ("oats (1 cup minus 1 g)", "oats (1 cup minus 1 g)"), ("beef (2 pounds in total)", "beef (2 pounds)"), ("3 ½-inch-thick slices ham", "3 slices ham, ½-inch-thick"), ("2-inch piece (3 ounces) ginger", "1 piece (3 ounces) ginger, 2-inch")],
)
def test_rewrites(raw, clean):
    assert normalize(raw) == clean


def test_optional_notes():
    assert strip_optional("oats (optional)") == ("oats", True)
    assert strip_optional("(optional)") == ("(optional)", False)
    assert PARSER.parse("(½ cup oats)").optional and PARSER.parse("1 cup oats, optional").optional


def test_order_matters():
    """Lines that read differently when two passes change places."""
    log = []
    PARSER.parse("1 small garlic clove", log)
    assert log == ["extract_postfix_produce_unit"]
    log = []
    PARSER.parse("grated or finely chopped lemon zest", log)
    assert log[0] == "extract_leading_prep_alternative"


def test_units_given():
    assert L.LineParser(("scoop", "scoops")).parse("2 scoops whey").amounts[0][0] == "scoop"
    assert PARSER.parse("2 scoops whey").name == "scoops whey"


def test_mismatched_range_is_read_past():
    assert measures("3 g-5tsp oats") == (" oats", [])


def test_abort():
    with pytest.raises(Abort):
        measures("2eggs")
    assert parse_amount("2eggs") is None


def test_amount_strings():
    assert display(parse_amount_string("$5")) == "$5"
    assert display(parse_amount_string("1 ½ lb")) == "1½ lb"
    for bad in ("", "lb", "4", "$x"):
        with pytest.raises(ValueError):
            parse_amount_string(bad)
    a, b, source = parse_mapping("$5/4lb @ market")
    assert (display(a), display(b), source) == ("4 lb", "$5", "market")
    with pytest.raises(ValueError):
        parse_mapping("4 lb")


def test_decompose():
    source, spans = PARSER.decompose("2 cups oats (3 g), toasted")
    assert [(f, t) for f, _, _, t in spans] == [("amount", "2 cups"), ("name", "oats"), ("amount", "(3 g)"), ("modifier", "toasted")]
    assert all(source[a:b] == t for _, a, b, t in spans)


def test_clauses():
    assert [c["kind"] for c in L.explain_clauses("oats, to taste, for serving, or rye, with care, minced and dried, minus 1 cup")] == ["head_candidate", "known_prep_phrase", "purpose", "alternative", "prose", "prep_chain", "minus_measure"]


def test_prose():
    kinds = lambda t, names: [(k, s or [display(m) for m in ms]) for k, s, ms in rich.parse(t, names)]
    assert kinds("Mix 2 cups oats for 5 minutes.", ["rolled oats"]) == [("text", "Mix "), ("measure", ["2 cups"]), ("text", " "), ("ing", "oats"), ("text", " for "), ("measure", ["5 minutes"]), ("text", ".")]
    assert kinds("Stir & wait", []) == [("text", "Stir ")]
    assert kinds("Step 1 Boil it", []) == [("text", "Step 1 Boil it")]
    assert rich.parse("Add 2eggs", []) is None


def test_vocabulary():
    assert vocab.VAGUE_UNITS < vocab.ADDON_UNITS and vocab.SIZED_UNITS < vocab.ADDON_UNITS
    assert "whole" not in vocab.ADDON_UNITS
    for words in (vocab.ADJECTIVES, vocab.STOPWORDS, vocab.ADDON_UNITS, vocab.CONTAINERS, vocab.PREMODIFIERS):
        assert all(w == w.lower() for w in words)
    assert vocab.LIST_HEADS.isdisjoint(vocab.ADJECTIVES)


_ALPHABET = "abcdefgh nost0123456789 .,;/-()½¼¾⅓⅛İı一é"


@settings(max_examples=300, deadline=None)
@given(st.text(_ALPHABET, max_size=40))
def test_any_text_parses(text):
    a, b = PARSER.parse(text), PARSER.parse(text)
    assert a == b
    assert a.modifier is None or a.modifier.strip()
    rich.parse(text, ["a", "oats"])
    PARSER.decompose(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("2 ½ cups chopped or and , (red) minus for the dusting finely oats fresh garlic clove to a from x - / oil vegetable with".split()), max_size=9))
def test_vocabulary_sentences(words):
    PARSER.parse(" ".join(words))


@given(st.integers(1, 9), st.sampled_from(list(GLYPHS)), st.sampled_from(["cup", "tsp", "g", "lb"]))
def test_fractions(n, glyph, unit):
    got = PARSER.parse(f"{n}{glyph} {unit} oats")
    a, b = GLYPHS[glyph]
    assert got.name == "oats" and abs(float(got.amounts[0][1]) - n - a / b) < 1e-9


def test_slash_runs_are_linear():
    import time

    t = time.time()
    PARSER.parse("1/" * 3000 + "1")
    assert time.time() - t < 5


HOSTILE = ["(" * 400 + "x", "(" * 5000 + ")" * 5000, "1 (" * 600 + ")" * 600, "[" * 900 + "2 g", "1 (2 (" * 300, "/" * 20_000, "1/" * 20_000, "1 or " * 5000, "1 plus " * 3000 + "2", "a, " * 10_000, " " * 50_000 + "x", "* " * 20_000 + "x", "*" * 50_000 + "x", "x" * 1_000_000, "minus " * 5000, "(minus" * 5000, "½" * 20_000, "-" * 20_000 + "1", "for the " * 5000, "1" * 5000, "chopped " * 3000, "(1" + "0" * 400 + " cups) x"]


@pytest.mark.parametrize("k", range(len(HOSTILE)))
def test_hostile_lines(k):
    """Any line gives an ingredient in reasonable time; one that nests too deep falls back to itself and says so."""
    import time

    began = time.time()
    got = PARSER.parse(HOSTILE[k])
    PARSER.decompose(HOSTILE[k])
    rich.parse(HOSTILE[k], ["a", "oats"])
    rich.every_measure(HOSTILE[k])
    assert time.time() - began < 20
    if k < 1:
        assert got.fell_back and got.name == HOSTILE[k] and "fell_back" in got.reasons()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 600), st.sampled_from(["(", "1 (", "(1 ", "2 (3-", "["]), st.text("ab1 )(,/½-", max_size=30), st.integers(0, 600))
def test_nesting(n, opener, middle, m):
    PARSER.parse(opener * n + middle + ")" * m)


def test_nesting_that_is_read():
    assert shown("(" * 150 + "2 cups" + ")" * 150 + " oats")[:2] == ("oats", ["2 cups"])


def test_stage_report():
    steps = PARSER.stages("•  2 cups chopped oats, optional")
    assert [(s, n) for s, n, _, _ in steps] == [("normalize", "strip_leading_bullet"), ("normalize", "strip_optional_note"), ("recognize", "optional_wrapped"), ("recognize", "trailing_amount"), ("recognize", "x_of_construction"), ("grammar", "parse_ingredient"), ("refine", "extract_adjectives_from_name")]
    assert PARSER.report("Juice of 2 lemons").splitlines()[2:4] == ["recognize: optional_wrapped ✗  trailing_amount ✗  x_of_construction ✓ → lemons", "grammar:   (skipped: a recognizer read the line)"]
    assert PARSER.report("2eggs").splitlines()[3] == "grammar:   (no parse: fell back)"
