"""Word lists of the line grammar. Sets are spelled as sorted words; where order matters, a list says so."""

from __future__ import annotations


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


SPELLED_COUNTS = _set("a an eight eleven five four nine one seven six ten three twelve two")
NUMBER_WORDS = {"half": 0.5, "dozen": 12.0} | dict(zip("one two three four five six seven eight nine ten eleven twelve".split(), map(float, range(1, 13))))
STOPWORDS = _set("a about an as at for from if in into of on or over per plus such the then to until with")
_ADJECTIVES = """as needed|chilled|chopped|coarsely chopped|coarsely shredded|cubed|diced|finely chopped|finely grated|finely shredded
firmly packed|fresh|freshly grated|freshly ground|freshly squeezed|grated|lightly packed|loosely packed|lukewarm|melted|minced|packed
plain|room temperature|room-temperature|roughly chopped|shredded|sifted|sliced|softened|squeezed|thinly sliced|to taste|warm"""
ADJECTIVES = frozenset(_ADJECTIVES.replace("\n", "|").split("|"))

# Usage by phrase, the first rule that holds wins.
USAGE_RULES = [
    ("garnish", ["for " + w for w in ("decorating", "decoration", "garnish", "garnishing")]),
    ("frying_medium", ["for " + w for w in ("deep frying", "deep-frying", "frying", "pan frying", "pan-frying", "shallow frying", "the fryer")]),
    ("pan_grease", ["for " + w for w in ("buttering", "greasing", "oiling", "the pan")]),
    ("dredging", ["for " + w for w in ("coating", "dredging", "dusting")]),
    ("seasoning", ["for seasoning", "to taste"]),
    ("marinade", ["for marinating", "for the marinade"]),
]
MARINADE_SECTIONS = _set("brine marinade marinating")

_COUNTED = "bag bar block bottle can carton clove container disk ear handful head jar packet package piece pint pouch rib recipe sachet slice sprig stalk stick strand tin tub tube"
ADDON_UNITS = _set(f"{_COUNTED} {_COUNTED.replace(' ', 's ')}s box boxes bunch bunches dash dashes leaf leaves loaf loaves pinch pinches standard")
VAGUE_UNITS = _set("dash dashes handful handfuls pinch pinches")
SIZED_UNITS = VAGUE_UNITS | _set("bunch bunches head heads")
# A food whose counted part follows it; the order is the order of trial.
POSTFIX_UNITS = [(food, unit) for food, units in (("garlic", "clove cloves head heads"), ("celery", "stalk stalks rib ribs"), ("corn", "ear ears"), ("lettuce", "head heads"), ("cabbage", "head heads")) for unit in units.split()]
SIZE_WORDS = _set("baby jumbo large medium small")
SIZE_UNITS = ["extra large", "extra-large", *sorted(SIZE_WORDS - {"baby"})]

_STATE = "bleached canned cooked cured dried firm fresh frozen instant melted pickled quick rapid raw refined ripe roasted salted shelled smoked soft softened toasted unbleached unsalted"
_LOOK = "black brown coarse crunchy dark fine golden green ground light purple red smooth white whole yellow"
_TASTE = "bitter bittersweet fancy grapefruit hot lean lemon lime mild nonfat orange savory semisweet skim sour spicy sweet virgin"
PREMODIFIERS = _set(f"{_STATE} {_LOOK} {_TASTE}") | SIZE_WORDS
LIST_HEADS = _set("broth oil stock vinegar")
INLINE_HEADS = _set("broth cabbage flour lettuce mustard pepper stock")
INTENSIFIERS = _set("really very")
ADVERBS = INTENSIFIERS | _set("coarsely crosswise diagonally finely lengthwise roughly thickly thinly")
_HOLDS = "ball block bottle can chunk disk envelope fillet head jar knob packet package piece slab stick tube wedge"
CONTAINERS = _set(f"{_HOLDS} {_HOLDS.replace(' ', 's ')}s box boxes bunch bunches loaf loaves")
CLAUSE_ENDS = [" (", ", ", " or ", " such as ", " to taste"]
DISTANCES = _set("centimeter centimetre cm foot ft in inch m meter metre millimeter millimetre mm yard yd")


def is_distance(word: str) -> bool:
    w = word.lower()
    return w in DISTANCES or (w[-1:] == "s" and w[:-1] in DISTANCES) or (w[-2:] == "es" and w[:-2] in DISTANCES)
