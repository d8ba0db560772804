"""Page parsing: text, links, sections, signatures and rendering.

One Arrow-batched function parses a page once and returns everything that needs a real HTML
walk; what a regular expression can say stays a Column expression.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normalize_link
from ..functions.text import col, collapse
from ..functions.values import decode_entities
from . import page_model
from .page_model import BLOCKS

HREF = r'<a\s[^>]*href="([^"]*)"'


def title(page: Column | str, toc_title: Column | str | None = None) -> Column:
    """First <title> that is not empty, else <h1>, else the given title, else empty."""
    html = col(page)
    tag = lambda name: F.nullif(collapse(decode_entities(F.regexp_replace(F.regexp_extract(html, f"(?is)<{name}[^>]*>(.*?)</{name}>", 1), "<[^>]*>", ""))), F.lit(""))
    other = [col(toc_title)] if toc_title is not None else []
    return F.coalesce(tag("title"), tag("h1"), *other, F.lit(""))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """(id, ordinal, href) of every a[href], in document order."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(HREF), F.lit(1))
    return pages.select(id_col, *keep, F.posexplode(found).alias("ordinal", "href"))


def resolve_links(found: DataFrame, toc: DataFrame, stored: DataFrame, current: str = "path", href: str = "href") -> DataFrame:
    """found with normalized_path, link_title and status: resolved with its title if the table
    of contents has the path, resolved without one if only the storage has it, else
    unresolved. toc: toc_path, toc_title; stored: stored_path (paths without leading /)."""
    known = toc.select(F.col("toc_path").alias("__t"), F.col("toc_title").alias("link_title")).dropDuplicates(["__t"])
    files = stored.select(F.col("stored_path").alias("__s")).distinct()
    joined = found.withColumn("normalized_path", normalize_link(href, current))
    joined = joined.join(known, F.col("normalized_path") == F.col("__t"), "left").join(files, F.col("normalized_path") == F.col("__s"), "left")
    status = F.when(F.col("__t").isNotNull() | F.col("__s").isNotNull(), "resolved").otherwise("unresolved")
    return joined.withColumn("status", status).drop("__t", "__s")


def link_diagnostics(resolved: DataFrame) -> DataFrame:
    return resolved.where("status = 'unresolved'").withColumn("code", F.lit("UNRESOLVED_LINK"))


class _Text(HTMLParser):
    """Body text: blocks and <br> separate, inline tags do not, scripts are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden, self.in_body = [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.parts, self.in_body = [], True
        elif tag in ("script", "style", "head", "title"):
            self.hidden += 1
        if tag == "br" or tag in BLOCKS:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head", "title") and self.hidden:
            self.hidden -= 1
        if tag in BLOCKS:
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def body_text(page: str) -> str:
    parser = _Text()
    parser.feed(page)
    parser.close()
    return " ".join("".join(parser.parts).split())


_PARAMETER = pa.struct([("name", pa.string()), ("required", pa.bool_()), ("type_refs", pa.list_(pa.string())), ("description", pa.string())])
_SIGNATURE = pa.struct([("text", pa.string()), ("variant", pa.string()), ("description", pa.string()), ("parameters", pa.list_(_PARAMETER)), ("return_types", pa.list_(pa.string()))])
#: Fields of a parsed page.
FIELDS = {
    "text": pa.string(),
    "sections": pa.map_(pa.string(), pa.string()),
    "signatures": pa.list_(_SIGNATURE),
    "return_types": pa.list_(pa.string()),
    "type_refs": pa.list_(pa.string()),
    "description": pa.string(),
    "note": pa.string(),
    "default_value": pa.string(),
    "usage": pa.string(),
    "since_text": pa.string(),
    "availability_text": pa.string(),
    "example": pa.list_(pa.string()),
    "see_also": pa.list_(pa.string()),
}
PARAMETER = "struct<name:string,required:boolean,type_refs:array<string>,description:string>"
SIGNATURE = f"struct<text:string,variant:string,description:string,parameters:array<{PARAMETER}>,return_types:array<string>>"
PARSED = (
    f"text string, sections map<string,string>, signatures array<{SIGNATURE}>, return_types array<string>, type_refs array<string>, description string, note string, "
    "default_value string, usage string, since_text string, availability_text string, example array<string>, see_also array<string>"
)
#: Pages that Python holds at once.
SLICE = 256


def parse(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, FIELDS) of every page; a null page has none."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                read = [page_model.read(page) for page in part.column(1).to_pylist()]
                columns = [pa.array([list(x[n].items()) if n == "sections" else x[n] for x in read], t) for n, t in FIELDS.items()]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", *FIELDS])

    found = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, {PARSED}")
    return found.withColumnRenamed("id", id_col)


class _Cells(HTMLParser):
    """Rows of cells of a table, or the lines of any fragment (one row, one cell)."""

    def __init__(self, fragment: str):
        super().__init__(convert_charrefs=True)
        self.rows, self.tables, self.loose = [], 0, [""]
        self.feed(fragment)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.tables += tag == "table"
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.rows = self.rows or [[]]
            self.rows[-1].append("")
        elif tag in ("br", "p"):
            self.handle_data("\n")

    def handle_data(self, data):
        row = self.rows[-1] if self.rows and self.rows[-1] else self.loose
        row[-1] += data

    def cells(self) -> list[str]:
        return [cell for row in self.rows for cell in row]


def code_block(text: str) -> str | None:
    """Lines as preformatted code, without empty lines around them."""
    lines = [line.replace("\xa0", " ").rstrip() for line in text.split("\n")]
    shown = "\n".join(lines).strip("\n")
    return f'<pre class="code">{entities.escape(shown)}</pre>' if shown.strip() else None


def layout(page: str) -> str:
    """The page with code and layout written as what they are: a table of one cell in a
    typewriter font, and a quote in one without links, are code; a quote that only lays out
    lines in tables is a quote of paragraphs."""

    def table(found: re.Match) -> str:
        cells = _Cells(found[0]).cells() if "courier" in found[0].lower() else []
        return (code_block(cells[0]) if len(cells) == 1 else None) or found[0]

    def quote(found: re.Match) -> str:
        low = found[0].lower()
        if "href" in low:
            return found[0]
        held = _Cells(found[0])
        if "courier" in low:
            return code_block("\n".join([*held.cells(), *held.loose])) or found[0]
        rows = [[" ".join(c.split()) for c in row if c.strip()] for row in held.rows]
        lines = [row[0] for row in rows if len(row) == 1]
        if held.tables < 2 or len(lines) < 2 or any(len(row) > 1 for row in rows):
            return found[0]
        return "<blockquote>" + "".join(f"<p>{entities.escape(x)}</p>" for x in lines) + "</blockquote>"

    page = re.sub(r"(?is)<table\b(?:(?!<table\b).)*?</table>", table, page)
    return re.sub(r"(?is)<blockquote\b.*?</blockquote>", quote, page)


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists, links, emphasis, quotes and code of a page as Markdown."""

    def __init__(self, targets: dict[str, str]):
        super().__init__(convert_charrefs=True)
        self.out, self.targets, self.href, self.hidden, self.code, self.lists = [], targets, [], 0, 0, []
        self.quotes, self.heading = 0, None

    def anchor(self, values: dict) -> None:
        """A heading that is named, or holds what is, gets an anchor before it, once."""
        name = (values.get("name") or values.get("id") or "").strip()
        if name and self.heading is not None:
            self.out.insert(self.heading, f'<a id="{entities.escape(name)}"></a>\n')
            self.heading = None

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag in ("script", "style", "head"):
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out += ["\n\n", "#" * int(tag[1]) + " "]
            self.heading = len(self.out) - 1
        elif tag in ("p", "div", "table"):
            self.out.append("\n>\n> " if self.quotes else "\n\n")
        elif tag == "br":
            self.out.append("\n" if self.code else "  \n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}." if self.lists and self.lists[-1][0] == "ol" else "-"
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + mark + " ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "blockquote":
            self.quotes += 1
            self.out.append("\n\n> ")
        elif tag in ("pre", "code"):
            self.code += tag == "pre"
            self.out.append(("\n\n```bsl\n" if values.get("class") == "code" else "\n\n```\n") if tag == "pre" else "`")
        self.anchor(values)
        if tag == "a" and "href" in values:
            self.href.append(rewrite_href(values["href"], self.targets))
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head") and self.hidden:
            self.hidden -= 1
        elif re.fullmatch("h[1-6]", tag):
            self.heading = None
        elif tag == "blockquote":
            self.quotes = max(0, self.quotes - 1)
            self.out.append("\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "pre":
            self.code = max(0, self.code - 1)
            self.out.append("\n```\n")
        elif tag == "code":
            self.out.append("`")
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data if self.code else re.sub(r"\s+", " ", data))


def rewrite_href(href: str, targets: dict[str, str]) -> str:
    """The page file that a link goes to, its fragment kept; links elsewhere stay, and so
    does a link to a fragment of the page itself."""
    path, hash_, fragment = href.partition("#")
    if path not in targets:
        return href
    return hash_ + fragment if hash_ and targets[path] == targets.get("") else targets[path] + hash_ + fragment


def to_markdown(page: str, page_title: str, targets: dict[str, str] | None = None) -> str:
    """Markdown of a page; a heading is added if the page has none."""
    parser = _Markdown(targets or {})
    parser.feed(layout(page))
    parser.close()
    text = re.sub(r"> \n>\n", "", "".join(parser.out))
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    if not re.match(r"(?:<a id=[^>]*></a>\n)?#{1,6} ", text):
        text = f"# {page_title}\n\n{text}".strip()
    return text + "\n"


def render_markdown(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", title_col: str = "title", links_col: str | None = None) -> DataFrame:
    """(id, markdown); links_col: map of href to target file. Pages without html become a
    heading alone."""
    kind = pages.schema[id_col].dataType.simpleString()
    targets = F.col(links_col) if links_col else F.lit(None).cast("map<string,string>")

    def run(batches):
        for batch in batches:
            pages_, titles, maps = (batch.column(i).to_pylist() for i in (1, 2, 3))
            made = [to_markdown(p or "", t or "Untitled", dict(m) if m else None) for p, t, m in zip(pages_, titles, maps, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["id", "markdown"])

    found = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), F.col(title_col).alias("title"), targets.alias("targets")).mapInArrow(run, f"id {kind}, markdown string")
    return found.withColumnRenamed("id", id_col)


def unescape(text: Column | str) -> Column:
    """All HTML entities decoded (the small table of functions.values stays in the JVM)."""

    def decode(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else entities.unescape(x) for x in values.to_pylist()], pa.string())

    return F.arrow_udf(decode, "string")(col(text))
