"""What a documentation page says, read in one walk over its HTML.

The walk gives marked lines in page order: chapter headings, rubrics, version marks, links,
rules and plain lines. Sections are runs of lines behind a chapter heading; a page without
chapter headings is cut at the section labels of its text instead. Everything else (overloads,
signatures, parameters, types, notes, examples) reads the sections.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from html.parser import HTMLParser
from typing import NamedTuple

#: Tags that separate words of the body text.
BLOCKS = frozenset(
    "address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th tr ul".split()
)
HIDDEN = ("script", "style", "head", "title")
#: Class names of marked elements.
MARKS = {"V8SH_chapter": "chapter", "V8SH_rubric": "rubric", "V8SH_pagetitle": "title", "V8SH_title": "title", "V8SH_heading": "heading", "V8SH_versionInfo": "version", "__SINCE_SHOW_STYLE__": "since"}
#: Section labels, in pairs of languages where both exist.
SECTIONS = {
    "properties": ("Свойства:", "Properties:"),
    "methods": ("Методы:", "Methods:"),
    "events": ("События:", "Events:"),
    "syntax": ("Синтаксис:", "Syntax:"),
    "parameters": ("Параметры:", "Parameters:"),
    "returns": ("Возвращаемое значение:", "Return value:", "Returned value:"),
    "usage": ("Использование:", "Use:"),
    "values": ("Значения", "Values"),
    "items": ("Элементы коллекции:", "Collection items:"),
    "constructors": ("Конструкторы:", "Constructors:"),
    "description": ("Описание:", "Description:"),
    "availability": ("Доступность:", "Availability:"),
    "note": ("Примечание:", "Note:"),
    "example": ("Пример:", "Example:"),
    "see_also": ("См. также:", "See also:"),
    "since": ("Использование в версии:", "Available since:"),
    "variant": ("Вариант синтаксиса:", "Syntax variant:"),
    "variant_description": ("Описание варианта метода:", "Description of method variant:"),
}
#: Labels of types and default values, words of an optional parameter, footers.
TYPE_LABELS = ("Тип параметра:", "Parameter type:", "Type of parameter:", "Тип:", "Type:")
DEFAULT_LABELS = ("Значение по умолчанию:", "Default value:")
OPTIONAL = ("необязательный", "optional")
FOOTERS = ("Методическая информация", "Methodical information")
#: Folders of the members of a type or table.
MEMBER_FOLDERS = ("methods", "properties", "formparams", "ctors", "events", "fields", "params")


class Item(NamedTuple):
    """kind: line, chapter, rubric, title, heading, version, since, link (text, target) or rule."""

    kind: str
    text: str
    target: str | None = None


class _Walk(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[Item] = []
        self.line: list[str] = []
        self.mark: tuple[str, str] | None = None
        self.depth = self.hidden = 0
        self.link: tuple[str, list[str]] | None = None

    def flush(self, kind: str = "line") -> None:
        text = " ".join("".join(self.line).split())
        if text:
            self.items.append(Item(kind, text))
        self.line = []

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "body":
            self.items, self.line = [], []
        elif tag in HIDDEN:
            self.hidden += 1
        elif self.mark:
            self.depth += tag == self.mark[0]
            if tag == "br" or tag in BLOCKS:
                self.line.append(" ")
        else:
            kinds = [MARKS[c] for c in (values.get("class") or "").split() if c in MARKS]
            if kinds or tag == "br" or tag in BLOCKS:
                self.flush()
            if kinds:
                self.mark, self.depth = (tag, kinds[0]), 1
            if tag == "hr":
                self.items.append(Item("rule", ""))
        if tag == "a" and values.get("href"):
            self.link = (values["href"], [])

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a" and self.link:
            self.items.append(Item("link", " ".join("".join(self.link[1]).split()), self.link[0]))
            self.link = None
        elif self.mark:
            self.depth -= tag == self.mark[0]
            if not self.depth:
                self.flush(self.mark[1])
                self.mark = None
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.line.append(data)
            if self.link:
                self.link[1].append(data)


def walk(page: str) -> list[Item]:
    walker = _Walk()
    walker.feed(page)
    walker.close()
    walker.flush(walker.mark[1] if walker.mark else "line")
    return walker.items


def label_in(text: str, names: Iterable[str] = SECTIONS) -> tuple[int, str, str] | None:
    """(place, label, section) of the first section label in a text, the longest at a place."""
    found = [(text.find(label), -len(label), label, name) for name in names for label in SECTIONS[name] if label in text]
    return (lambda x: (x[0], x[2], x[3]))(min(found)) if found else None


def cut(items: Sequence[Item]) -> list[tuple[str, list[Item]]]:
    """(section, its items) in page order; what comes before the first is the section ""."""
    found: list[tuple[str, list[Item]]] = [("", [])]
    if any(x.kind == "chapter" and label_in(x.text) for x in items):
        for item in items:
            held = label_in(item.text) if item.kind == "chapter" else None
            if held:
                rest = item.text[held[0] + len(held[1]) :].strip()
                found.append((held[2], [Item("line", rest)] if rest else []))
            elif item.kind in ("chapter", "rule"):
                found.append(("-", []))  # no section of ours
            else:
                found[-1][1].append(item)
        return found
    for item in items:
        if item.kind == "rule" or any(item.text.startswith(f) for f in FOOTERS):
            found.append(("-", []))
            continue
        text = item.text
        while item.kind != "link" and (held := label_in(text)):
            if text[: held[0]].strip():
                found[-1][1].append(item._replace(text=text[: held[0]].strip()))
            found.append((held[2], []))
            text = text[held[0] + len(held[1]) :].strip()
        if text:
            found[-1][1].append(item._replace(text=text))
    return found


def lines(items: Iterable[Item]) -> list[str]:
    return [x.text for x in items if x.kind in ("line", "rubric")]


def first(parts: Sequence[tuple[str, list[Item]]], name: str) -> list[Item]:
    return next((items for n, items in parts if n == name), [])


def before_labels(text: str, labels: Iterable[str]) -> str:
    return text[: min((at for x in labels if (at := text.find(x)) >= 0), default=len(text))]


def clean(text: str) -> str | None:
    """Free text without the footer and without blanks and periods around it."""
    return before_labels(text, FOOTERS).strip().strip(".").strip() or None


def after_type(text: str) -> str | None:
    """What follows the first type label that the text has, in the order of the labels."""
    return next((text.split(x, 1)[1] for x in TYPE_LABELS if x in text), None)


def types_in(text: str) -> list[str]:
    head = (after_type(text) or "").split(".", 1)[0]
    return [x for part in re.split("[,;]", head) if (x := part.strip().strip("."))]


def described(text: str) -> str | None:
    """The text behind the types, up to a note or default value."""
    rest = after_type(text)
    rest = text if rest is None else (rest.split(".", 1) + [text])[1]
    return clean(before_labels(rest, SECTIONS["note"] + DEFAULT_LABELS))


def default_in(text: str) -> str | None:
    value = next((text.split(x, 1)[1] for x in DEFAULT_LABELS if x in text), None)
    value = clean(before_labels(value, SECTIONS["note"])) if value else None
    return value and value.rstrip(".")


def optional(text: str) -> bool:
    return any(word in text.lower() for word in OPTIONAL)


def parameters(items: Sequence[Item]) -> list[dict]:
    """Parameters of a section: one for each rubric, else one for each <name> of its text."""
    found = []
    if any(x.kind == "rubric" for x in items):
        for item in items:
            if item.kind == "rubric":
                mark = re.search(r"<([^>]*)>", item.text)
                found.append([(mark[1] if mark else item.text.split("(", 1)[0]).strip(), item.text, []])
            elif found and item.kind == "line":
                found[-1][2].append(item.text)
        made = [(name, title, " ".join(body), described(" ".join(body))) for name, title, body in found]
    else:
        text = " ".join(lines(items))
        marks = list(re.finditer(r"<([^>]*)>", text))
        made = []
        for i, mark in enumerate(marks):
            body = text[mark.end() : marks[i + 1].start() if i + 1 < len(marks) else len(text)]
            made.append((mark[1].strip(), body, body, body.partition(".")[2].strip() or None))
    return [{"name": name, "required": not optional(title), "type_refs": types_in(body), "description": text} for name, title, body, text in made if name]


def signatures(parts: Sequence[tuple[str, list[Item]]], variant: str | None, returns: list[str]) -> list[dict]:
    """One signature for each line of the syntax section; a parameter belongs to the lines
    that spell its <name>."""
    known = parameters(first(parts, "parameters"))
    description = clean(" ".join(lines(first(parts, "variant_description")))) if variant is not None else None
    made = []
    for line in lines(first(parts, "syntax")):
        made.append({"text": line, "variant": variant, "description": description, "parameters": [p for p in known if f"<{p['name']}>" in line], "return_types": returns})
    return made


def overload_returns(blocks: list[dict], page_level: list[str]) -> tuple[list[dict], list[str]]:
    """Return types stay with the overloads only if every overload has some."""
    if blocks and all(b["return_types"] for b in blocks):
        return blocks, []
    return [b | {"return_types": []} for b in blocks], page_level


def calls(parts: Sequence[tuple[str, list[Item]]]) -> tuple[list[dict], list[str]]:
    """(signatures, return types of the page): each variant is an overload of its own."""
    page_level = types_in(" ".join(lines(first(parts, "returns"))))
    starts = [i for i, (name, _) in enumerate(parts) if name == "variant"]
    if not starts:
        return signatures(parts, None, []), page_level
    blocks = []
    for i, start in enumerate(starts):
        block = parts[start : starts[i + 1] if i + 1 < len(starts) else len(parts)]
        title = next(iter(lines(block[0][1])), "")
        returns = types_in(" ".join(lines(first(block, "returns"))))
        blocks.append({"signatures": signatures(block, title, returns), "return_types": returns})
    kept, level = overload_returns(blocks, page_level)
    return [s | {"return_types": b["return_types"]} for b in kept for s in b["signatures"]], level


def normalize_example(code: Sequence[str]) -> list[str]:
    """Code lines with one blank between words, spacing inside quotes untouched; a quote left
    open goes on in the next line."""
    out, quoted = [], False
    for line in code:
        made, blank = [], False
        for char in line.strip() if not quoted else line:
            if char == '"':
                quoted = not quoted
            if not quoted and char.isspace():
                blank = True
                continue
            if blank and made:
                made.append(" ")
            blank = False
            made.append(char)
        out.append("".join(made))
    return out


def fuse_see_also(names: Sequence[tuple[str, str]]) -> list[str]:
    """(kind, name) links in order: an owner followed by its member becomes Owner.Member."""
    out, i = [], 0
    while i < len(names):
        if names[i][0] == "owner" and i + 1 < len(names) and names[i + 1][0] == "member":
            out.append(f"{names[i][1]}.{names[i + 1][1]}")
            i += 2
        else:
            out.append(names[i][1])
            i += 1
    return out


def see_also(items: Sequence[Item]) -> list[str]:
    folder = re.compile("/(?:" + "|".join(MEMBER_FOLDERS) + ")/")
    return fuse_see_also([("member" if folder.search(x.target) else "owner", x.text) for x in items if x.kind == "link" and x.text])


def version_text(items: Sequence[Item], parts: Sequence[tuple[str, list[Item]]]) -> str | None:
    """The first of the version mark, the section, and the since mark that says something."""
    marked = lambda kind: next((x.text for x in items if x.kind == kind), None)
    return marked("version") or " ".join(lines(first(parts, "since"))) or marked("since") or None


def read(page: str | None) -> dict:
    """All facts of a page; a null page has none."""
    items = walk(page or "")
    parts = cut(items)
    text = {}
    for name, held in parts:
        if name not in ("", "-") and (joined := " ".join(lines(held))):
            text.setdefault(name, joined)
    made, returns = calls(parts)
    lead = " ".join(x.text for x in parts[0][1] if x.kind in ("line", "rubric"))
    said = text.get("description", lead)
    return {
        "text": " ".join(x.text for x in items if x.kind not in ("link", "rule")),
        "sections": text,
        "signatures": made,
        "return_types": returns,
        "type_refs": types_in(said) or types_in(lead),
        "description": described(said),
        "note": clean(text["note"]) if "note" in text else None,
        "default_value": default_in(said) or default_in(text.get("note", "")),
        "usage": text.get("usage"),
        "since_text": version_text(items, parts),
        "availability_text": text.get("availability"),
        "example": normalize_example(lines(first(parts, "example"))),
        "see_also": see_also(first(parts, "see_also")),
    }
