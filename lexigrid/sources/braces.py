"""Brace texts: nested lists of numbers and quoted strings."""

from __future__ import annotations

import re

_TOKEN = re.compile(r'[\s,﻿]*(?:([{}])|"((?:[^"]|"")*)"|([^\s,{}"﻿]+))')


class BraceError(ValueError):
    pass


def parse(text: str) -> list:
    """The one list that the text holds. Commas, blanks and byte order marks separate; in a
    string a doubled quote is a quote and byte order marks are dropped; other words are
    numbers. An own stack, so that deep texts do not exhaust the interpreter's."""
    stack: list[list] = [[]]
    at, end = 0, len(re.sub(r"[\s,﻿]+\Z", "", text))
    while at < end:
        found = _TOKEN.match(text, at)
        if found is None:
            raise BraceError(f"unexpected text at {at}")
        at = found.end()
        brace, quoted, word = found.groups()
        if brace == "{":
            stack.append([])
        elif brace == "}":
            if len(stack) < 2:
                raise BraceError(f"unexpected }} at {at}")
            stack[-2].append(stack.pop())
        elif quoted is not None:
            stack[-1].append(quoted.replace('""', '"').replace("﻿", ""))
        else:
            try:
                stack[-1].append(int(word))
            except ValueError:
                raise BraceError(f"a number is expected: {word!r}") from None
    if len(stack) != 1 or len(stack[0]) != 1 or not isinstance(stack[0][0], list):
        raise BraceError("one closed list is expected")
    return stack[0][0]


def book_meta(text: str) -> dict:
    """name, description and tags of {type, name, {n, n, {lang, description}}, count, tag, {n, n}, ..., 0}."""
    try:
        _, name, (_, _, (_, description)), count, *rest = parse(text)
        tags, tail = rest[: 2 * count : 2], rest[2 * count :]
    except (ValueError, TypeError) as problem:
        raise BraceError(f"book description: {problem}") from None
    if tail != [0] or len(tags) != count or not all(isinstance(x, str) for x in [name, description, *tags]):
        raise BraceError("book description: the trailing zero is missing")
    return {"name": name, "description": description, "tags": tags}


def toc_rows(text: str) -> list[dict]:
    """Rows (id, parent_id, seq, title_en, title_ru, html_path) of {count, chunk, ...}, in file
    order; a chunk is {id, parent, n, child * n, {n, n, {n, n, {lang, title} ...}, path}}."""
    rows = []
    for seq, chunk in enumerate(parse(text)[1:]):
        try:
            number, parent, n, *rest = chunk
            _, _, (_, _, *names), path = rest[n]
            titles = {("en" if lang == "#" else lang): title for lang, title in names}
        except (ValueError, TypeError, IndexError) as problem:
            raise BraceError(f"table of contents, chunk {seq}: {problem}") from None
        rows.append({"id": number, "parent_id": parent, "seq": seq, "title_en": titles.get("en", ""), "title_ru": titles.get("ru", ""), "html_path": path.lstrip("/")})
    return rows
