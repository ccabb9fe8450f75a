"""Headed sections of paper texts, as column expressions within the row.

Headings are found line by line in one Arrow batch pass, linear in the text,
which also cuts the text where the next heading begins.  What type a section
is, and that the last section of a type wins, are expressions over the few
sections of a text.  Nothing is exploded or shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of headings and section types, headings that count without a number.
NUMBERED = r"^((?:[A-Z]|\d+)(?:\.\d+)*)\s+((?:[A-Z]|\d+)[A-Za-z\s\-:]+)$"
TITLE_CASE = r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})$"
UNNUMBERED = (
    "abstract", "limitations", "ethics statement", "ethical statement", "ethical considerations", "acknowledgement",
    "acknowledgements", "references",
)
SECTION_TYPES = {
    "abstract": (r"\babstract\b", r"\bsummary\b"),
    "introduction": (r"\bintroduction\b", r"\bbackground\b", r"\bmotivation\b"),
    "conclusion": (r"\bconclusion\b", r"\bconclusions\b", r"\bfinal\s+thoughts\b"),
}
WANTED = tuple(SECTION_TYPES)
# Fixed value: the characters that end a line.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_NO_END = r"[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` applied to a value that is computed once per row, however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Every character that is white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(WHITE))


def normalize(text: Column) -> Column:
    """Single spaces, at most one blank line, no outer white space."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?U)\n\s*\n", "\n\n"))


def lines(text: Column) -> Column:
    """The lines of a text with their ends."""
    return F.regexp_extract_all(text, F.lit(f"{_NO_END}*(?:{LINE_ENDS})|{_NO_END}+"), F.lit(0))


_NUMBERED, _TITLE_CASE = re.compile(NUMBERED), re.compile(TITLE_CASE)


def heading(line: str) -> tuple[str, int] | None:
    """Title and level of a stripped line that is a heading."""
    if not line or not (line[0].isdigit() or "A" <= line[0] <= "Z"):
        return None
    if m := _NUMBERED.match(line):
        return m.group(2).strip(), m.group(1).count(".") + 1
    if line.lower() in UNNUMBERED and _TITLE_CASE.match(line):
        return line, 1
    return None


def headed(text: str) -> list[tuple[str, int, int]]:
    """(title, level, start) of the headings of a text in order; start counts characters."""
    out, at = [], 0
    for line in text.splitlines(True):
        if found := heading(line.strip()):
            out.append((*found, at))
        at += len(line)
    return out


def divided(text: str) -> list[tuple[str, str, int, int, int]]:
    """(title, content, level, start, end) of the sections of a text, each up to the next heading."""
    found = headed(text)
    out = []
    for i, (title, level, start) in enumerate(found):
        end = found[i + 1][2] if i + 1 < len(found) else len(text)
        out.append((title, text[start:end].strip().partition("\n")[2].strip(), level, start, end))
    return out


def spans(text: str) -> list[tuple[int, int]]:
    """(start, length) of the lines of a text, ends included, in characters."""
    out, at = [], 0
    for line in text.splitlines(True):
        out.append((at, len(line)))
        at += len(line)
    return out


def _per_text(parse: Callable[[str], list[tuple]], fields: str, text: Column) -> Column:
    """An array of structs per text, by Arrow batches; none for a null text."""
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [pa.string() if f.endswith("string") else pa.int32() for f in fields.split(", ")]
    kind = pa.list_(pa.struct(list(zip(names, kinds))))

    @F.arrow_udf(f"array<struct<{', '.join(f.replace(' ', ': ') for f in fields.split(', '))}>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(names, x)) for x in parse(t)] if t else [] for t in texts.to_pylist()], kind)

    return run(text)


def headings(text: Column) -> Column:
    """array of struct(title, level, start) in order; start counts characters."""
    return _per_text(headed, "title string, level int, start int", text)


def line_spans(text: Column) -> Column:
    """array of struct(start, n_chars) of the lines with their ends."""
    return _per_text(spans, "start int, n_chars int", text)


def section_type(title: Column, types: dict[str, tuple[str, ...]] = SECTION_TYPES) -> Column:
    """The first type one of whose patterns occurs in a heading, else the heading's slug."""
    lower = F.lower(title)
    known = None
    for name, patterns in types.items():
        hit = reduce(lambda a, b: a | b, (lower.rlike(f"(?U){p}") for p in patterns))
        known = F.when(hit, name) if known is None else known.when(hit, name)
    return known.otherwise(slug(title)) if known is not None else slug(title)


def slug(title: Column) -> Column:
    """Lower case, signs and spaces as underscores."""
    return F.replace(F.regexp_replace(F.lower(title), r"(?U)[^\p{L}\p{N}_\s]", "_"), F.lit(" "), F.lit("_"))


def sections(text: Column, types: dict[str, tuple[str, ...]] = SECTION_TYPES) -> Column:
    """All sections of a normalised text, in order.  Texts without headings, empty and null texts have none."""
    found = _per_text(divided, "title string, content string, level int, start int, end int", text)
    return F.transform(
        found,
        lambda s: F.struct(
            section_type(s["title"], types).alias("type"),
            s["title"].alias("title"),
            s["content"].alias("content"),
            s["level"].alias("level"),
            s["start"].alias("start"),
            s["end"].alias("end"),
        ),
    )


def section_map(text: Column, wanted: tuple[str, ...] | None = None, types: dict[str, tuple[str, ...]] = SECTION_TYPES) -> Column:
    """map of type to struct(title, content, level); of several sections of a type the last one counts."""

    def last(every: Column, name: Column) -> Column:
        s = F.element_at(F.filter(every, lambda s: s["type"] == name), -1)
        return let(s, lambda s: F.struct(s["title"].alias("title"), s["content"].alias("content"), s["level"].alias("level")))

    def build(every: Column) -> Column:
        names = F.array_distinct(F.transform(every, lambda s: s["type"]))
        return F.map_from_arrays(names, F.transform(names, lambda name: last(every, name)))

    every = sections(text, types)
    return let(F.filter(every, lambda s: s["type"].isin(*wanted)) if wanted is not None else every, build)


def missing_sections(found: Column, wanted: tuple[str, ...] = WANTED) -> Column:
    """Wanted types that a section map lacks."""
    return F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(F.map_keys(found), F.array().cast("array<string>")))


def only_sections(found: Column, wanted: tuple[str, ...] = WANTED) -> Column:
    return F.map_filter(found, lambda k, _: k.isin(*wanted))
