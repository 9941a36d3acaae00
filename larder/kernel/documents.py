"""Web pages, recipe JSON and e-books to plain recipes, lines and metadata."""

from __future__ import annotations

import html
import io
import json
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

from larder.kernel.grammar import parse_amount
from larder.kernel.line import LineParser
from larder.kernel.measures import GLYPH_CLASS, shown

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset("article aside blockquote br caption dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section ul".split())
_SKIPPED = frozenset("head noscript script style title".split())
_MIME = {"gif": "image/gif", "jpeg": "image/jpeg", "jpg": "image/jpeg", "png": "image/png", "svg": "image/svg+xml", "webp": "image/webp"}
_QUANTITY = re.compile(f"[0-9{GLYPH_CLASS}]")
_ISO = re.compile(r"P(?=.)(?:(\d+)D)?(?:T((?:\d+[HMS])*))?")


# text


def decode_entities(s: str) -> str:
    """HTML entities decoded until nothing changes, three times at most."""
    for _ in range(3):
        t = html.unescape(s)
        if t == s:
            break
        s = t
    return s


def clean_line(s: str) -> str:
    return decode_entities(s).replace("\xa0", " ").replace("\n", " ")


def squeeze(s: str) -> str:
    return " ".join("".join(c for c in s if c.isspace() or not (ord(c) < 32 or 127 <= ord(c) < 160)).split())


# values of recipe JSON


def iso_minutes(s: str) -> int | None:
    m = _ISO.fullmatch(s.strip())
    if not m or (m[1] is None and not m[2]):
        return None
    total = int(m[1] or 0) * 1440
    for n, unit in re.findall(r"(\d+)([HMS])", m[2] or ""):
        total += int(n) * {"H": 60, "M": 1, "S": 0}[unit]
    return total if 0 < total < 1 << 32 else None


_NEARLY = re.compile(r"(?:about |approximately |approx\. |approx |around |roughly |~) *")
_CLOCK = re.compile(r" *([0-9]+) *(hours?|hrs?|h|minutes?|mins?|m)(?![a-z])\.?")


def prose_minutes(s: str) -> int | None:
    """Minutes of "about 1 hr. 20 min"; None for anything that isn't hours and minutes throughout."""
    t = s.strip()
    t = t.lower() if t.isascii() else "".join(c.lower() if c.isascii() else c for c in t)
    at = m.end() if (m := _NEARLY.match(t)) else 0
    total, some = 0, False
    while m := _CLOCK.match(t, at):
        n = int(m[1]) if len(m[1]) < 20 else 1 << 33
        total, at, some = total + n * (60 if m[2][0] == "h" else 1), m.end(), True
    return total if some and not t[at:].strip(" ") and 0 < total < 1 << 32 else None


def humanize(minutes: int) -> str:
    parts = [(minutes // 60, "hour"), (minutes % 60, "minute")]
    return " ".join(f"{n} {word}{'' if n == 1 else 's'}" for n, word in parts if n)


_SERVINGS = LineParser(("serving", "servings")).addons


def _servings(v: float) -> int | None:
    return int(v) if 0 <= v < 100_000 else None


def parse_yield(text: str) -> dict | None:
    """{value, unit, servings} of "Makes 4 servings"."""
    m = _QUANTITY.search(text)
    rest = text[m.start() :] if m else text
    got = parse_amount(rest, _SERVINGS)
    if got:
        unit, value = shown(got[0][0]), float(got[0][1])
        counts = unit in ("serving", "servings") or "serv" in text.lower()
        return {"value": value, "unit": unit, "servings": _servings(value) if counts else None}
    if re.fullmatch(r"\+?[0-9]+", rest.strip()) and int(rest) < 1 << 32:
        return {"value": float(int(rest)), "unit": "serving", "servings": int(rest)}
    return None


def _yield(v) -> dict | None:
    if isinstance(v, str):
        return parse_yield(v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return {"value": float(v), "unit": "serving", "servings": _servings(v)}
    if isinstance(v, list) and v and all(isinstance(x, str) for x in v):
        return next((y for x in v if (y := parse_yield(x))), None)
    if isinstance(v, list) and v and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
        return _yield(v[0])
    return None


def _first_text(v) -> str | None:
    if isinstance(v, list):
        return next((x for x in v if isinstance(x, str)), None)
    return v if isinstance(v, str) else None


def tools(v) -> list[str]:
    out = []
    for x in v if isinstance(v, list) else [v]:
        name = (x if isinstance(x, str) else x.get("name") if isinstance(x, dict) else None) or ""
        if isinstance(name, str) and name.strip() and name.strip().lower() != "n/a":
            out.append(name.strip())
    return out


def is_notes(heading: str | None) -> bool:
    return (heading or "").strip().lower() in ("note", "notes", "tip", "tips")


def _steps(v) -> tuple[list[str], list[str]] | None:
    """(instructions, notes) of any of the shapes in use: steps, sections of steps, HTML, lists of lists."""
    if isinstance(v, str):
        return [t for t in Page(v).texts("p")], []
    if not isinstance(v, list):
        return None
    if v and all(isinstance(x, list) for x in v):
        v = [y for x in v for y in x]
    out, notes = [], []
    for x in v:
        if not isinstance(x, dict):
            return None
        if isinstance(x.get("itemListElement"), list):
            texts = [t for y in x["itemListElement"] if isinstance(y, dict) and isinstance(t := y.get("text"), str)]
            (notes if is_notes(x.get("name")) else out).extend(texts)
        elif isinstance(x.get("text"), str):
            out.append(x["text"])
    return out, notes


def _image(v) -> str | None:
    if isinstance(v, list):
        v = v[0] if v else None
    if isinstance(v, dict):
        v = v.get("url")
    return v if isinstance(v, str) else None


def _recipe(d, url: str) -> dict | None:
    if not isinstance(d, dict) or not isinstance(d.get("name"), str) or not isinstance(lines := d.get("recipeIngredient"), list) or not all(isinstance(x, str) for x in lines):
        return None
    steps = _steps(d.get("recipeInstructions"))
    if steps is None:
        return None
    made = _yield(d.get("recipeYield"))
    minutes = {k: iso_minutes(t) if (t := _first_text(d.get(f"{k}Time"))) else None for k in ("total", "prep", "cook")}
    return {
        "name": d["name"], "url": url, "image": _image(d.get("image")), "description": _first_text(d.get("description")), "category": _first_text(d.get("recipeCategory")),
        "recipe_yield": made and {"value": made["value"], "unit": made["unit"]}, "servings": made and made["servings"],
        **{f"{k}_minutes": v for k, v in minutes.items()}, "notes": steps[1], "equipment": tools(d.get("tool")) if d.get("tool") is not None else [],
        "ingredients": lines, "instructions": steps[0],
    }


def recipe_of_json(text: str, url: str) -> dict | None:
    """A recipe of a linked-data block: a graph's first recipe, a list's first entry, or the object itself."""
    try:
        d = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if isinstance(d, dict) and isinstance(d.get("@graph"), list):
        return next((r for x in d["@graph"] if (r := _recipe(x, url))), None)
    if isinstance(d, list):
        d = d[0] if d else None
    return _recipe(d, url)


def recipe_of_api(text: str) -> dict | None:
    """A recipe of the JSON that lists quantity, unit, title and note for each ingredient."""
    try:
        d = json.loads(text)
        lines = [f"{i['quantity']} {i['unit']} {i['title']}" + (f", {i['note']}" if i.get("note") else "") for i in d["ingredients"]]
        return _blank(d["title"], d["url"]) | {"image": d["image"], "ingredients": lines, "instructions": [s["directions"] for s in d["steps"]]}
    except (ValueError, KeyError, TypeError, RecursionError):
        return None


def _blank(name: str, url: str) -> dict:
    return {"name": name, "url": url, "notes": [], "equipment": [], "ingredients": [], "instructions": []} | dict.fromkeys(("image", "description", "category", "recipe_yield", "servings", "total_minutes", "prep_minutes", "cook_minutes"))


def null_paths(text: str) -> list[str]:
    """Dotted paths of every null of a JSON text, in its order."""
    out: list[str] = []

    def walk(v, at: str) -> None:
        if v is None:
            out.append(at)
        elif isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{at}.{k}" if at else k)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{at}[{i}]")

    try:
        walk(json.loads(text), "")
    except (ValueError, RecursionError):
        return []
    return out


# pages


class Page(HTMLParser):
    """Events of a page: (what, tag, attributes) and text, with void elements closed at once."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, dict]] = []
        try:
            self.feed(source)
            self.close()
        except (AssertionError, ValueError):
            pass  # what was read of a broken page stays

    def handle_starttag(self, tag, attrs):
        self.events.append(("open", tag, dict(attrs)))
        if tag in _VOID:
            self.events.append(("close", tag, {}))

    def handle_startendtag(self, tag, attrs):
        self.events += [("open", tag, dict(attrs)), ("close", tag, {})]

    def handle_endtag(self, tag):
        if tag not in _VOID:
            self.events.append(("close", tag, {}))

    def handle_data(self, data):
        self.events.append(("text", data, {}))

    def found(self, tag: str, test=lambda a: True) -> list[tuple[dict, str]]:
        """(attributes, text inside) of the elements that pass; one inside another counts as part of it."""
        out: list[tuple[dict, str]] = []
        depth, inside, attrs = 0, [], {}
        for what, name, a in self.events:
            if what == "open" and name == tag:
                if depth:
                    if tag == "p":  # an open paragraph ends where the next begins
                        out.append((attrs, "".join(inside)))
                        inside, attrs, depth = [], a, 0
                    depth += 1
                elif test(a):
                    depth, inside, attrs = 1, [], a
                if depth and tag in _VOID:
                    out.append((attrs, ""))
                    depth = 0
            elif what == "close" and name == tag and depth:
                depth -= 1
                if depth == 0:
                    out.append((attrs, "".join(inside)))
            elif what == "text" and depth:
                inside.append(name)
        if depth:
            out.append((attrs, "".join(inside)))
        return out

    def texts(self, tag: str, css_class: str | None = None) -> list[str]:
        return [t for _, t in self.found(tag, lambda a: css_class is None or css_class in (a.get("class") or "").split())]


def _is_host(url: str, domain: str) -> bool:
    try:
        host = (urlsplit(url).hostname or "").lower()
    except ValueError:
        return False
    return host == domain or host.endswith("." + domain)


def scrape(body: str, url: str) -> dict | None:
    """The recipe of a page: by the site's API, else the first linked-data block that holds one, else list markup; None without any."""
    if _is_host(url, "chefsteps.com"):
        got = recipe_of_api(body)
    else:
        page = Page(body)
        blocks = page.found("script", lambda a: a.get("type") == "application/ld+json")
        got = next((r for _, t in blocks if (r := recipe_of_json(t, url))), None)
        if not got:
            steps = page.texts("div", "jetpack-recipe-directions")
            if not steps:
                return None
            images = page.found("meta", lambda a: a.get("property") == "og:image")
            title = next(iter(page.texts("title")), "")
            got = _blank(title, url) | {"image": images[0][0].get("content") if images else None, "ingredients": page.texts("li", "jetpack-recipe-ingredient"), "instructions": steps[0].split("\n")}
    if not got:
        return None
    for k in ("name", "description", "category"):
        got[k] = got[k] and decode_entities(got[k])
    for k, clean in (("notes", decode_entities), ("equipment", decode_entities), ("ingredients", clean_line), ("instructions", clean_line)):
        got[k] = [clean(x) for x in got[k]]
    got["sections"] = [{"name": None, "ingredients": got["ingredients"], "instructions": got["instructions"]}]
    return got | {k: humanize(m) if (m := got[f"{k}_minutes"]) else None for k in ("total", "prep", "cook")}


# books


def resolve_relative(document: str, source: str) -> str | None:
    source = re.split("[#?]", source)[0].strip()
    if not source or source.lower().startswith(("http://", "https://", "data:")):
        return None
    parts = [] if source.startswith("/") or "/" not in document else document.rpartition("/")[0].split("/")
    stack: list[str] = []
    for p in [*parts, *source.split("/")]:
        if p == "..":
            del stack[-1:]
        elif p not in ("", "."):
            stack.append(p)
    return "/".join(stack) or None


def mime_of(path: str) -> str | None:
    name, dot, ending = path.rpartition("/")[2].rpartition(".")
    return _MIME.get(ending.lower()) if dot else None


def is_internal(href: str) -> bool:
    h = href.strip()
    return bool(h) and not h.startswith(("http://", "https://", "mailto:")) and (".htm" in h or ".xhtml" in h or "#" in h)


def nearest_line(ranges: list[tuple[int, int]], at: int) -> int | None:
    """The line that holds a place, else the nearest; of two as near the later."""
    best = None
    for i, (a, b) in enumerate(ranges):
        far = (a - at, 0) if at < a else (at - b + 1, 1) if at >= b else (0, 1)
        if best is None or far < best[0]:
            best = (far, i)
    return best and best[1]


_LINES = LineParser()


def table_row(cells: list[str]) -> str:
    """Cells as a line: a name and its one weight as "name (weight)", anything else side by side."""
    cells = [c for c in map(squeeze, cells) if c]
    if len(cells) < 2:
        return "".join(cells)
    kinds = []
    for c in cells:
        r = _LINES.parse(c)
        kinds.append("measure" if any(m[0] != "whole" for m in r.amounts) else "number" if r.amounts and not r.name.strip() else "text")
    if kinds.count("measure") == 1 and kinds[0] == "text":
        return f"{cells[0]} ({cells[kinds.index('measure')]})"
    return " ".join(cells)


def page_lines(source: str, document: str = "") -> list[dict]:
    """Lines of a book's page: {text, links: [{text, href}], images: [{path, mime, alt}]}."""
    source = re.sub(r"<(script|style)\b([^>]*?)\s*/\s*>", r"<\1\2></\1>", source, flags=re.I)
    buffer: list[str] = []
    size = skip = tables = 0
    links, images, cells = [], [], []
    anchor, cell, caption = None, False, False

    def put(t: str) -> None:
        nonlocal size
        buffer.append(t)
        size += len(t)

    for what, name, attrs in Page(source).events:
        if what == "text":
            if skip:
                continue
            if not tables or (caption and not cell):
                put(name.replace("\0", ""))
            elif cell and cells:
                cells[-1] += name
        elif name in _SKIPPED:
            skip = skip + 1 if what == "open" else max(0, skip - 1)
            anchor = None if what == "open" else anchor
        elif skip:
            continue
        elif what == "open":
            if name == "table":
                put("\0")
                tables += 1
            elif tables:
                if name == "tr":
                    cells, cell = [], False
                elif name in ("td", "th"):
                    cells.append("")
                    cell = True
                elif name == "caption":
                    put("\0")
                    caption = True
            else:
                if name in _BLOCKS:
                    put("\0")
                if name == "a" and is_internal(attrs.get("href") or ""):
                    anchor = (size, attrs["href"])
                if name == "img" and (path := resolve_relative(document, attrs.get("src") or "")) and (mime := mime_of(path)):
                    images.append((size, {"path": path, "mime": mime, "alt": attrs.get("alt") or None}))
        elif name == "table" and tables:
            tables -= 1
            put("\0")
        elif tables:
            if name in ("td", "th"):
                cell = False
            elif name == "tr":
                if row := table_row(cells):
                    put(f"\0{row}\0")
                cells, cell = [], False
            elif name == "caption":
                put("\0")
                caption = False
        else:
            if name == "a" and anchor:
                links.append((anchor[0], anchor[1], "".join(buffer)[anchor[0] :]))
                anchor = None
            if name in _BLOCKS:
                put("\0")
    out, ranges, start = [], [], 0
    for part in "".join(buffer).split("\0"):
        end = start + len(part)
        if text := squeeze(part):
            here = [{"text": t, "href": href} for at, href, raw in links if start <= at < end and (t := squeeze(raw))]
            ranges.append((start, end))
            out.append({"text": text, "links": here, "images": []})
        start = end + 1
    for at, image in images:
        if (i := nearest_line(ranges, at)) is not None:
            out[i]["images"].append(image)
    return out


def _tag(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


class Book:
    """An EPUB: its package document, spine and resources."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        box = ElementTree.fromstring(self.zip.read("META-INF/container.xml"))
        self.root = next(e.get("full-path") for e in box.iter() if _tag(e) == "rootfile")
        self.package = ElementTree.fromstring(self.zip.read(self.root))
        base = posixpath.dirname(self.root)
        self.items = {e.get("id"): (posixpath.normpath(posixpath.join(base, unquote(e.get("href") or ""))), e.get("media-type") or "", e.get("properties") or "") for e in self.package.iter() if _tag(e) == "item"}

    def meta(self, name: str) -> list[str]:
        return [t for e in self.package.iter() if _tag(e) == name and (t := (e.text or "").strip())]

    def metadata(self) -> dict:
        return {"title": next(iter(self.meta("title")), None), "authors": self.meta("creator"), "subjects": self.meta("subject"), "identifiers": self.meta("identifier")}

    def lines(self) -> list[dict]:
        """Lines of all pages in the order of reading, each with its page's path as `doc_path`."""
        out = []
        for e in self.package.iter():
            if _tag(e) == "itemref" and (item := self.items.get(e.get("idref"))) and "html" in item[1]:
                data = self.resource(item[0])
                text = (data or b"").decode("utf-8", "replace").removeprefix("﻿")
                out += [{"doc_path": item[0], **line} for line in page_lines(text, item[0])]
        return out

    def cover(self) -> str | None:
        named = next((e.get("content") for e in self.package.iter() if _tag(e) == "meta" and e.get("name") == "cover"), None)
        if named in self.items:
            return self.items[named][0]
        return next((path for path, _, properties in self.items.values() if "cover-image" in properties.split()), None)

    def resource(self, path: str) -> bytes | None:
        try:
            return self.zip.read(path)
        except KeyError:
            return None


def open_book(data: bytes) -> Book | None:
    try:
        return Book(data)
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, ValueError):
        return None


# windows over a book's lines

BUDGET, SLACK = 12_000, 6_000


def looks_like_title(line: str) -> bool:
    t = line.strip()
    return 0 < len(t.encode()) <= 60 and not _QUANTITY.match(t) and t[0] not in "•·*-–—" and not t.endswith(".")


def windows(lines: list[tuple[str, str]], budget: int = BUDGET, slack: int = SLACK) -> list[dict]:
    """(path, line) to windows {doc_path, title_hint, first, n_lines, text}: closed before a title once the budget is full, or
    wherever the slack is full as well; what follows such a hard cut has the last title as its hint."""
    out: list[dict] = []
    start = size = 0
    title = hint = None
    for i, (_, text) in enumerate(lines):
        heading = looks_like_title(text)
        at_title, hard = size >= budget and heading, size >= budget + slack
        if i > start and (at_title or hard):
            out.append({"title_hint": hint, "first": start, "n_lines": i - start})
            start, size = i, 0
            hint = title if hard and not at_title else None
        if heading:
            title = text
        size += len(text.encode()) + 1
    if start < len(lines):
        out.append({"title_hint": hint, "first": start, "n_lines": len(lines) - start})
    for w in out:
        part = lines[w["first"] : w["first"] + w["n_lines"]]
        w |= {"doc_path": part[0][0], "text": "\n".join(t for _, t in part)}
    return out
