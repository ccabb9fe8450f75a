"""Headed sections against worked examples."""

import pytest
from pyspark.sql import functions as F

from paperlake.operators.sections import headings, lines, missing_sections, normalize, only_sections, section_map, sections, slug

CASES = {
    "Abstract\nWe study X.\n1 Introduction\nIntro.\n2 Background\nBg.\n6 Conclusions\nDone.": {
        "abstract": ("Abstract", "We study X.", 1),
        "introduction": ("Background", "Bg.", 1),
        "conclusion": ("Conclusions", "Done.", 1),
    },
    "1. Introduction\nfoo": {},
    "Introduction\nfoo": {},
    "ABSTRACT\nfoo": {},
    "3.1 Motivation\nWhy.": {"introduction": ("Motivation", "Why.", 2)},
    "Ethics Statement\nE.": {"ethics_statement": ("Ethics Statement", "E.", 1)},
    "A Survey of Things\nbody": {"survey_of_things": ("Survey of Things", "body", 1)},
    "7 Results and Discussion: Part-A\nR": {"results_and_discussion__part_a": ("Results and Discussion: Part-A", "R", 1)},
    "1 Introduction\x0cline2\nline3": {"introduction": ("Introduction", "line3", 1)},
    "Abstract\nA.\n8 Summary\nS.": {"abstract": ("Summary", "S.", 1)},
    "9 Concluding Remarks\nx\n10 Final Thoughts\ny": {
        "concluding_remarks": ("Concluding Remarks", "x", 1),
        "conclusion": ("Final Thoughts", "y", 1),
    },
    "1 Introduction": {"introduction": ("Introduction", "", 1)},
    "": {},
    "no heading\nat all": {},
    "1 Introduction\nspaced": {"introduction": ("Introduction", "spaced", 1)},
}


def test_section_map(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "i int, text string").coalesce(1)
    rows = df.select("i", section_map(F.col("text")).alias("m")).collect()
    got = {r.i: {k: tuple(v) for k, v in r.m.items()} for r in rows}
    for i, (text, expected) in enumerate(CASES.items()):
        assert got[i] == expected, text


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "text string")
    row = df.select(section_map(F.col("text")).alias("m"), sections(F.col("text")).alias("s")).first()
    assert row.s == [] and not row.m


def test_normalize(spark):
    df = spark.createDataFrame([("a \t b\n \n\n c",), ("  x  ",), (None,)], "text string")
    assert [r[0] for r in df.select(normalize(F.col("text"))).collect()] == ["a b\n\n c", "x", None]


@pytest.mark.parametrize("text", ["a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k", "", "\n\n", "x", "x\n", "𝒳\ny"])
def test_lines_and_offsets(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(lines(F.col("text"))).first()[0]
    assert got == text.splitlines(True)
    assert "".join(got) == text


def test_heading_offsets_count_characters(spark):
    text = "𝒳 first\n1 Introduction\nbody\n2.1.3 Methods\nx"
    df = spark.createDataFrame([(text,)], "text string")
    got = [tuple(h) for h in df.select(headings(F.col("text"))).first()[0]]
    assert got == [("Introduction", 1, text.index("1 Intro")), ("Methods", 3, text.index("2.1.3"))]


def test_sets_of_sections(spark):
    df = spark.createDataFrame([({"abstract": 1, "other": 2},), ({},), (None,)], "m map<string, int>")
    rows = df.select(missing_sections(F.col("m")).alias("missing"), only_sections(F.col("m")).alias("kept")).collect()
    assert rows[0].missing == ["introduction", "conclusion"] and rows[0].kept == {"abstract": 1}
    assert len(rows[1].missing) == len(rows[2].missing) == 3 and rows[2].kept is None


def test_slug(spark):
    df = spark.createDataFrame([("Über: Größe – x",)], "t string")
    assert df.select(slug(F.col("t"))).first()[0] == "über__größe___x"
