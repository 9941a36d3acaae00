"""What an extractor gives for a window of a cookbook: JSON that is nearly of the shape asked for, read with care."""

from __future__ import annotations

import json
from functools import lru_cache

TEXTS = ("title", "description", "recipe_yield", "category", "page")
TIMES = ("active", "total", "prep", "cook")


class Malformed(ValueError):
    pass


def lenient_list(value) -> list:
    """A list; null and blank text are an empty one, and text is a list written as JSON once more."""
    if isinstance(value, str):
        if not value.strip():
            return []
        try:
            value = json.loads(value)
        except (ValueError, RecursionError) as e:
            raise Malformed(f"a list within a text: {e}") from e
    return null_as_empty(value)


def null_as_empty(value) -> list:
    if value is None:
        return []
    if not isinstance(value, list):
        raise Malformed(f"no list: {type(value).__name__}")
    return value


def _text(d: dict, key: str, needed: bool = False) -> str | None:
    v = d.get(key)
    if v is None and not needed:
        return None
    if not isinstance(v, str):
        raise Malformed(f"{key} is no text")
    return v


def _texts(value) -> list[str]:
    out = null_as_empty(value)
    if not all(isinstance(x, str) for x in out):
        raise Malformed("a list of texts holds something else")
    return out


def _object(value, what: str) -> dict:
    if not isinstance(value, dict):
        raise Malformed(f"{what} is no object")
    return value


def filled_minutes(times: dict) -> dict:
    """Times with the minutes that their texts say, where no count is given."""
    from larder.kernel.documents import prose_minutes

    return times | {f"{k}_minutes": times[f"{k}_minutes"] if times.get(f"{k}_minutes") is not None else prose_minutes(times[k]) if times.get(k) else None for k in TIMES}


def _times(value) -> dict | None:
    if value is None:
        return None
    d = _object(value, "times")
    counts = {f"{k}_minutes": d.get(f"{k}_minutes") for k in TIMES}
    if any(v is not None and (isinstance(v, bool) or not isinstance(v, int) or not 0 <= v < 1 << 32) for v in counts.values()):
        raise Malformed("minutes are no count")
    return filled_minutes({k: _text(d, k) for k in TIMES} | counts)


def _recipe(value) -> dict:
    d = _object(value, "a recipe")
    sections = [{"name": _text(s, "name"), "ingredients": _texts(s.get("ingredients")), "instructions": _texts(s.get("instructions"))} for s in (_object(x, "a section") for x in lenient_list(d.get("sections")))]
    made = {k: _text(d, k, k == "title") for k in TEXTS}
    return made | {"times": _times(d.get("times")), "equipment": _texts(d.get("equipment")), "notes": _texts(d.get("notes")), "sections": sections}


@lru_cache(1 << 12)
def recipes_of(text: str) -> tuple[list[dict] | None, str | None]:
    """The recipes of a payload {"recipes": [...]}, or what is wrong with it."""
    try:
        return [_recipe(x) for x in lenient_list(_object(json.loads(text), "the payload").get("recipes"))], None
    except (ValueError, RecursionError) as e:
        return None, f"{type(e).__name__}: {e}"


def chosen(text: str | None, n: int) -> list[bool]:
    """Flags of n items whose numbers, counted from 1, a payload {"cookbook_indices": [...]} names; others are passed over."""
    out = [False] * n
    try:
        named = json.loads(text).get("cookbook_indices") if text else []
    except (ValueError, RecursionError, AttributeError):
        named = []
    for i in named if isinstance(named, list) else []:
        if isinstance(i, int) and not isinstance(i, bool) and 1 <= i <= n:
            out[i - 1] = True
    return out
