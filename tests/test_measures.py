"""Units, exact values, formatting and conversion."""

from fractions import Fraction

import pytest

from larder.kernel import convert as C
from larder.kernel import measures as M


def test_aliases_and_plurals():
    assert [M.unit_of(x) for x in ("Cups", "teaspoons", "°", "°c", "inches", "each")] == ["cup", "tsp", "fahrenheit", "celsius", '"', "whole"]
    assert M.unit_of("celsius") == "celsius" and M.measure("celsius", 1)[0] == "celsiu"  # found only by its sign
    assert [M.singular(x) for x in ("boxes", "leaves", "glasses", "Cups", "s")] == ["box", "leave", "glass", "cup", ""]


def test_kinds():
    assert [M.kind_of(u) for u in ("g", "tsp", "$", "hour", '"', "whole", "clove", "g protein")] == ["weight", "volume", "money", "time", "length", "other:whole", "other:clove", "nutrient:g protein"]
    assert M.parse_kind("Weight") == "weight" and M.parse_kind("blob") == "other:blob"


def test_rationals():
    assert M.rational(1 / 3) * 3 == 1 and M.rational(0.1) == Fraction(1, 10) and M.rational(-2.5) == Fraction(-5, 2)
    assert M.rational(float("nan")) == 0 and M.rational(1e300) > 10**18
    assert M.fraction_text(Fraction(2, 3)) == "2/3" and M.fraction_text(Fraction(5, 3)) == "1 2/3" and M.fraction_text(Fraction(1, 4)) is None
    assert M.parse_fraction("1 2/3") == Fraction(5, 3) and M.parse_fraction("-1 1/2") == Fraction(-3, 2)
    for bad in ("1.5", "", "1/0", "x", "1 2"):
        with pytest.raises(ValueError):
            M.parse_fraction(bad)


def test_algebra():
    cup, spoon, gram = M.measure("cup", 1), M.measure("tbsp", 2), M.measure("g", 5)
    assert M.display(M.add(cup, spoon)) == "1⅛ cups" and M.add(cup, gram) is None
    assert M.add(gram, M.measure("clove", 2)) == gram
    assert M.display(M.add(M.measure("g", 1, 2), gram)) == "6 - 7 g"
    assert M.display(M.scale(M.measure("cup", 1, 3), 2)) == "2 - 6 cups"
    assert M.scale(M.measure("minute", 5), 2) == M.measure("minute", 5)
    assert M.scale(M.measure("cup", 1, 2), -1)[1:] == (-2, -1)
    assert M.measure("g", 3, 1) == M.measure("g", 1, 3)


@pytest.mark.parametrize(("unit", "value", "text"), [("tsp", 2, "2 tsp"), ("tsp", 6, "2 tbsp"), ("tsp", 96, "2 cups"), ("tsp", 384, "2 quart"), ("second", 30, "30 seconds"), ("second", 7200, "2 hours"), ("cent", 250, "$2.5"), ("whole", 3, "3"), ("g", 1 / 3, "⅓ g"), ("g", 1.2345, "1.23 g")])
def test_display(unit, value, text):
    assert M.display(M.measure(unit, value)) == text


def test_ascii_quantities():
    assert [M.format_quantity_ascii(v) for v in (0, 1.5, -0.25, 2, 3.14159)] == ["0", "1 1/2", "-1/4", "2", "3.1416"]


def graph(*pairs):
    return C.make_graph([(M.measure(*a), M.measure(*b)) for a, b in pairs])


def test_conversion():
    g = graph((("tbsp", 2), ("$", 4)))
    assert M.display(C.convert(M.measure("tbsp", 1), "money", g)[0]) == "$2"
    assert C.convert(M.measure("lb", 0.5), "money", graph((("g", 1), ("$", 1))))[0][1] == M.rational(226.796)
    assert M.display(C.convert(M.measure("whole", 1, 2), "money", graph((("whole", 4), ("$", 20))))[0]) == "$5 - $10"
    assert C.convert(M.measure("clove", 1), "money", g) is None and C.convert(M.measure("cup", 1), "volume", {}) is None
    assert M.display(C.convert(M.measure("oz", 1), "weight", {})[0]) == "28.35 g"
    m, steps = C.convert(M.measure("pinch", 16), "volume", g)
    assert steps[0] == ("pinch", "tsp", 1 / 16) and abs(float(m[1]) - 4.92892) < 1e-9


def test_later_mappings_hold_and_paths_are_shortest():
    g = graph((("aa", 1), ("bb", 2)), (("aa", 1), ("bb", 3)), (("bb", 1), ("cc", 1)), (("aa", 1), ("cc", 5)))
    assert C.path(g, "aa", "cc") == ["aa", "cc"] and g["aa"]["bb"] == (3.0, 3.0)
    assert C.islands(graph((("aa", 1), ("bb", 1)), (("cc", 1), ("dd", 1)))) == [["aa", "bb"], ["cc", "dd"]]
    text = C.dot(graph((("cup", 1), ('a"b', 2))))
    assert "dashed" in text and '\\"' in text and text.count("->") == 2


def test_round_sig():
    assert C.round_sig(123456.5, 6) == 123457 and C.round_sig(-0.00012345, 3) == -0.000123 and C.round_sig(0) == 0
