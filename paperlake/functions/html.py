"""What pages of the archive hold: meta data of papers, ids on event and search pages.

Column functions cover well-formed tags; the operators at the end parse whole
pages with the standard library's parser, in Arrow batches.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from paperlake.functions.scalars import try_year, venues

# Names and labels in the pages.
TITLE, AUTHOR = "citation_title", "citation_author"
PDF_LABEL, YEAR_LABEL, VENUE_LABELS = "PDF:", "Year:", ("Venue:", "Venues:")
ENTRY_CLASS, BADGE_CLASS = "d-sm-flex", "badge"
RESULT_CLASS, LINK_CLASS = "gsc-webResult gsc-result", "gs-title"


def unescape(text: Column) -> Column:
    """The five predefined entities as characters."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def meta_contents(html: Column, name: str) -> Column:
    """Contents of all meta tags of a name, in order; null and empty pages have none."""
    pattern = f'<meta\\s+name="{re.escape(name)}"\\s+content="([^"]*)"'
    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(1)), unescape)


def meta_content(html: Column, name: str) -> Column:
    """Content of the first meta tag of a name, or null."""
    return F.get(meta_contents(html, name), F.lit(0))


def labelled(html: Column, label: str) -> Column:
    """Text of the dd that follows the dt with a label, without tags and outer space; null if missing or empty."""
    pattern = f"(?s)<dt>{re.escape(label)}</dt>\\s*<dd>(.*?)</dd>"
    inner = F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), pattern, 1), "<[^>]*>", "")
    return F.nullif(F.regexp_replace(unescape(inner), r"(?U)^\s+|\s+$", ""), F.lit(""))


def paper_fields(html: Column) -> list[Column]:
    """title, authors, pdf_url, year, venues of a paper page; a page without title has only nulls."""
    title = meta_content(html, TITLE)
    has = title.isNotNull()
    return [
        title.alias("title"),
        F.when(has, meta_contents(html, AUTHOR)).alias("authors"),
        F.when(has, labelled(html, PDF_LABEL)).alias("pdf_url"),
        F.when(has, try_year(labelled(html, YEAR_LABEL))).alias("year"),
        F.when(has, venues(F.coalesce(*(labelled(html, x) for x in VENUE_LABELS)))).alias("venues"),
    ]


def hrefs(html: Column) -> Column:
    """All link targets in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('<a\\s[^>]*?href="([^"]*)"'), F.lit(1))


def all_or_nothing(ids: Column) -> Column:
    """The array, or an empty one if any element is null: a page with one malformed element gives nothing."""
    return F.when(ids.isNull() | F.exists(ids, lambda x: x.isNull()), F.array().cast("array<string>")).otherwise(ids)


class Node:
    """An element with its attributes, children and text."""

    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        # Iterative, as real pages nest deeper than Python recurses.
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, Node):
                yield child
                stack.append(iter(child.children))

    def text(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x.strip())
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    def has_class(self, name: str) -> bool:
        own = self.attributes.get("class", "")
        return own == name or name in own.split()


class _Tree(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in self.VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(page: str) -> Node:
    tree = _Tree()
    tree.feed(page)
    tree.close()
    return tree.root


def paper_of(page: str | None) -> dict | None:
    """title, authors, pdf_url, year, venues of a paper page, or None without a title or where parsing fails."""
    if not page:
        return None
    root = parse(page)
    metas: dict[str, list[Node]] = {}
    values: dict[str, str] = {}
    for node in root.walk():
        if node.tag == "meta":
            metas.setdefault(node.attributes.get("name", ""), []).append(node)
        elif node.tag == "dt" and len(node.children) == 1 and isinstance(node.children[0], str):
            siblings = node.parent.children
            after = siblings[siblings.index(node) + 1 :]
            dd = next((x for x in after if isinstance(x, Node) and x.tag == "dd"), None)
            values.setdefault(node.children[0], dd.text() if dd else "")
    titles = metas.get(TITLE)
    if not titles or any("content" not in m.attributes for m in [titles[0], *metas.get(AUTHOR, [])]):
        return None
    venue = next((values[x] for x in VENUE_LABELS if values.get(x)), "")
    year = values.get(YEAR_LABEL, "")
    return {
        "title": titles[0].attributes["content"],
        "authors": [m.attributes["content"] for m in metas.get(AUTHOR, [])],
        "pdf_url": values.get(PDF_LABEL) or None,
        "year": int(year) if re.fullmatch(r"\s*[+-]?\d{1,9}(?:_\d+)*\s*", year) else None,
        "venues": venue.split("|") if venue else [],
    }


def conference_ids(page: str | None, part: str | None = None) -> list[str]:
    """Ids of the papers on an event page, or in its part with an id; nothing if one entry is malformed."""
    if not page:
        return []
    root = parse(page)
    if part:
        root = next((n for n in root.walk() if n.attributes.get("id") == part), None)
        if root is None:
            return []
    out = []
    for entry in root.walk():
        if entry.tag == "p" and entry.has_class(ENTRY_CLASS):
            badge = next((n for n in entry.walk() if n.has_class(BADGE_CLASS)), None)
            if badge is None or "href" not in badge.attributes:
                return []
            out.append(badge.attributes["href"].rsplit("/", 1)[-1].rsplit(".", 1)[0])
    return out


def search_ids(page: str | None) -> list[str]:
    """Ids of the papers on a search page; nothing if one result is malformed."""
    if not page:
        return []
    out = []
    for result in parse(page).walk():
        if result.attributes.get("class") == RESULT_CLASS:
            link = next((n for n in result.walk() if n.tag == "a" and n.has_class(LINK_CLASS)), None)
            if link is None or "href" not in link.attributes:
                return []
            out.append(link.attributes["href"].strip("/").split("/")[-1].removesuffix(".pdf"))
    return out


def _mapped(df: DataFrame, schema: str, rows) -> DataFrame:
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = rows(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return df.mapInArrow(run, schema)


def extract_papers(pages: DataFrame) -> DataFrame:
    """(page_id, title, authors, pdf_url, year, venues) of paper pages (page_id, html); pages without a title give no row."""
    schema = "page_id string, title string, authors array<string>, pdf_url string, year int, venues array<string>"

    def rows(ids: list, html: list) -> list[dict]:
        return [{"page_id": i, **p} for i, h in zip(ids, html) if (p := paper_of(h))]

    return _mapped(pages.select(F.col("page_id").cast("string"), "html"), schema, rows)


def extract_ids(pages: DataFrame) -> DataFrame:
    """(page_id, place, id) of the papers listed on event and search pages (page_id, kind, part, html)."""

    def rows(ids: list, kinds: list, parts: list, html: list) -> list[dict]:
        out = []
        for i, kind, part, h in zip(ids, kinds, parts, html):
            found = search_ids(h) if kind == "search" else conference_ids(h, part) if kind == "conference" else []
            out += [{"page_id": i, "place": n, "id": x} for n, x in enumerate(found)]
        return out

    return _mapped(pages.select(F.col("page_id").cast("string"), "kind", "part", "html"), "page_id string, place int, id string", rows)


def escape(text: Column) -> Column:
    """Text for an attribute or element."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def unescaped(text: str) -> str:
    return entities.unescape(text)
