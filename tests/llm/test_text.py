"""Glyphs, quality, scans and sentences on worked examples."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperlake.llm import glyphs as G
from paperlake.llm import scans as P
from paperlake.llm import sentences as S
from paperlake.llm.quality import kind, quality, statistics
from paperlake.llm.words import language


@pytest.mark.parametrize(
    "text, normal",
    [
        ("plain text, 2-fold – “quoted” α", "plain text, 2-fold – “quoted” α"),
        ("été", "été"),
        ("in­vent​ory", "inventory"),
        ("a b c", "a b c"),
        ("low‑resource", "low-resource"),
        ("Ｔｈｅ ﬁrst", "The first"),
        ("thе Grоup", "the Group"),
        ("中文，Ａ。", "中文，A。"),
        ("English， text", "English, text"),
        ("ﾓﾃﾞﾙ", "モデル"),
        ("метoд", "метод"),
        ("क्‍ष", "क्‍ष"),
        ("", ""),
    ],
)
def test_normal_forms(text, normal):
    assert G.repair(text) == normal
    assert G.repair(normal) == normal


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_repair_settles(text):
    once = G.repair(text)
    assert G.repair(once) == once


def test_only_mixed_words_and_only_with_the_vocabulary(spark, monkeypatch):
    """A mixed word changes if the corpus has its reading, or all the pieces of one; a whole word in another script stays."""
    rows = [
        ("1", "un mоt rare", "t"),  # the corpus has mot
        ("2", "ce mot est là", "t"),
        ("3", "le mot ісі est la", "t"),  # wholly Cyrillic
        ("4", "nous sommes ici", "t"),
        ("5", "Wеmisk", "t"),  # an invented name that is made of known pieces
        ("6", "Wemy, Gemisk", "t"),
        ("7", "хq, the fоx", "t"),  # neither word is known, and both are too short for pieces
        ("8", None, "t"),
        ("9", "", "t"),
    ]
    df = spark.createDataFrame(rows, "id string, value string, word string")
    expected = {("1", "un mot rare"), ("5", "Wemisk")}
    assert {(r.id, r.normal) for r in G.normalise(df, keep=("id",)).collect()} == expected
    monkeypatch.setattr(G, "MOST_BROADCAST", 0)
    assert {(r.id, r.normal) for r in G.normalise(df, keep=("id",)).collect()} == expected
    assert G.normalise(df.limit(0), keep=("id",)).count() == 0


def test_readings_prefer_the_dominant_script():
    assert G.readings("метoд") == ("метод",)
    assert G.readings("thе")[0] == "the"
    assert G.readings("plain") == ()
    assert G.mixed_words("the Grоup α β") == {"Grоup"}


PROSE = {
    "en": "We ask whether a frequent alignment can replace the lexicon used by robust scripts. The tables list scripts and annotators.",
    "de": "Unsere Aufgabe zeigt, dass die einfache Häufigkeit selten ausreicht. Das Ergebnis hängt von der Satz ab.",
    "fr": "Il n'existe pas de caractère fréquent, donc nous le étudions ici. Le score est dans ce cas très rare.",
    "ru": "Мы предлагаем общий метод и сравниваем его с системой. Почему список так важен для нас?",
    "hi": "हमने इस लेख में एक विधि की तुलना की है। परिणाम बताते हैं कि यह बेहतर है।",
    "zh": "本文比较词典，并与公开的系统进行比较。为什么多语言的句子如此重要？",
    "ja": "本稿では珍しい文法を測定する。また、辞書と方言の違いを議論する。",
    "th": "บทความนี้ศึกษาพจนานุกรมโดยใช้การทดลอง เนื่องจากภาษามีน้อยเราจึงเปรียบเทียบระบบทั่วไป",
}
JUNK = [
    "Login | Help | Copy | Accept | Top | PDF | Volume | Help | Accept",
    "1 answer ............ 2\n2.2 index ............ 30\n3.1 grammar ........ 8",
    "47.1 30.9 63.2\n81.5 58.1 18.1\n64 81.2 93.7",
    "• deep beam\n• efficient sentence\n• silver answer dialogue\n• manual passage",
    "parser & tagger & beam\nAxTree & 63.1 & 39.9\nBoNet & 23.5 & 96.5",
    "x = True\ny = 3.5\nfor k in z[4:]:\n    a.b(k, 1)\nreturn z",
    "======\n______\nx x x x x x x x\n. . . . . . .",
    "]ï¢ ¿8^¤ *{¬œ 8/ð#> Ãœ |¬§^0¬ ¬9#~[{",
    "Lee, B. 2006. rare coding. J. 3(3):54-242\nKim, J. 2014. small trial. J. 36(9):68-246",
]


@pytest.mark.parametrize("lang", PROSE)
def test_prose(lang):
    assert kind(statistics(PROSE[lang])) == "prose"
    assert language(PROSE[lang]) == lang


def test_language_of_the_whole_text():
    """A long quotation at the beginning and one in the middle don't decide."""
    assert language(PROSE["zh"] * 45 + PROSE["de"] * 55 + PROSE["zh"] * 45 + PROSE["de"] * 120) == "de"


@pytest.mark.parametrize("text", JUNK)
def test_no_prose(text):
    assert kind(statistics(text)) != "prose"


def test_evidence_decides_together():
    """Prose of a language whose function words aren't known is told by its sentences, unless it recurs."""
    spanish = "Presentamos resultados nuevos sobre modelos grandes. Comparamos cuatro sistemas distintos bajo iguales condiciones.\n"
    assert kind(statistics(spanish)) == "prose"
    assert kind(statistics(spanish * 9)) == "repeated"
    assert kind(statistics("Aceptar. Inicio. Menú. Ayuda. Inicio. Aceptar. Menú. Ayuda. Inicio. Salir. Inicio. Aceptar. Ayuda.")) == "boilerplate"
    assert kind(statistics("Home | Search | Next | Home | Help | Next | Login | Home | Share | Next | Help | Search")) == "boilerplate"
    # Two sentences of one form are no boilerplate.
    assert kind(statistics("The score is 4.8 here, which is more than that of the other one. The score is 0.4 here, which is more than that of the third one.")) == "prose"


def test_a_repeated_sentence_is_no_prose():
    sentence = "We compare the general method of this paper with the other one and it is rare. "
    assert kind(statistics(sentence * 12)) == "repeated"
    assert kind(statistics("The words of the text are rare. " * 12)) == "repeated"
    paragraph = "We ask what the method\ndoes to the text of " + "\n\n"
    assert kind(statistics(paragraph * 8)) == "repeated"
    shares = statistics(sentence * 2)[-7:-1]
    assert all(s == 1.0 for s in shares) and statistics(PROSE["en"])[-9:] == (0.0,) * 9


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_statistics_of_anything(text):
    s = statistics(text)
    assert 0 <= s[3] <= 1 and 0 <= s[4] <= 1 and 0 <= s[10] <= 1
    assert kind(s) in {"prose", "list", "table", "junk", "repeated"}


def test_quality_table(spark):
    rows = [("1", "a", PROSE["en"]), ("1", "a", PROSE["en"]), ("2", "a", None), ("3", "a", ""), ("4", "a", JUNK[0]), ("5", "a", "word " * 20000)]
    df = spark.createDataFrame(rows, "paper_id string, section_key string, content string").withColumn("kind", F.lit("clash"))
    got = sorted((r.paper_id, r.kind) for r in quality(df).collect())
    assert got == [("1", "prose"), ("1", "prose"), ("4", "list"), ("5", got[-1][1])] and got[-1][1] != "prose"
    assert quality(df.limit(0)).count() == 0


PAGE = """The general method of the paper is simple and the gene-
ral idea is old. We compare the long-

Page 57
ON THE RARE WORDS OF TEXT

range model to the other and the rnodel wins
every tirne that it is us-
ed by the readers of 5ome text.
- 58 -
Lindqvist et al.
. ,"""


def pages(spark):
    filler = "the model wins every time that some long-range words are used by the general readers of text"
    rows = [(str(i), "abstract", filler, "x", None) for i in range(40)] + [("p", "introduction", PAGE, "On the rare words of text", ["Ann Lindqvist"])]
    rows += [("n", "abstract", None, None, None), ("e", "abstract", "", "t", []), ("l", "list", JUNK[3] + "\n- 3 -", None, None), rows[-1]]
    return spark.createDataFrame(rows, "paper_id string, section_key string, content string, title string, authors array<string>").withColumn("word", F.lit("clash"))


def test_scanned_page(spark, monkeypatch):
    found = P.repairs(pages(spark))
    got = {(r.line_no, r.repair) for r in found.where("paper_id = 'p'").collect()}
    assert got == {
        (0, "join"), (3, "drop"), (4, "drop"), (6, "chars"), (7, "chars"), (7, "join"), (8, "chars"), (9, "drop"), (10, "drop"), (11, "drop"),
    }
    assert found.where("paper_id <> 'p'").count() == 0
    text = {r.paper_id: r.text for r in P.repaired_text(pages(spark), found).collect()}["p"]
    assert text == (
        "The general method of the paper is simple and the general idea is old. We compare the long-range model to the other"
        " and the model wins every time that it is used by the readers of some text."
    )
    assert P.repairs(pages(spark).limit(0)).count() == 0
    # Without a broadcast the words of all lines are joined with the corrections.
    monkeypatch.setattr(P, "MOST_BROADCAST", 0)
    assert sorted(map(str, P.repairs(pages(spark)).collect())) == sorted(map(str, found.collect()))


def test_kind_needs_no_more_than_it_is_given():
    for text in [*PROSE.values(), *JUNK, "The words of the text are rare. " * 12, "Home | Search | Next | Home | Help | Next | Login | Home"]:
        assert kind(statistics(text)) == kind(statistics(text, True))


def test_lines_that_end_sentences_are_read_too():
    """Half of the lines, or both of two, end in a full stop; misread words and digits are looked up all the same."""
    for lines in (["It is the systerne of the text.", "The m5del of all that we have is it."], ["We use the systerne", "of the text.", "The m5del of it is", "in the text."]):
        text = "\n".join(lines)
        assert any(what == "chars" for _, what, *_ in P.read_content(text, None, None, P.Counts()))
        every = P.misread_words(text, None, None, None)
        assert "systerne" in {w for *_, w in every}
        assert P.misread_words(text, None, None, frozenset({"systerne"})) == [x for x in every if x[3] == "systerne"]
    zh = "审稿人写道：“摘要很好。”模型（见附录2）尚未公开。\n比NefiParse v5.1高5.7分。为什么自然的表示如此重要？"
    assert not any(what == "chars" for _, what, *_ in P.read_content(zh, None, None, P.Counts()))
    assert "v5" not in {w for *_, w in P.misread_words(zh, None, None, None)}
    assert P.misread_words("one line with systerne", None, None, None) == []


def test_anagram_differences(spark):
    df = spark.createDataFrame([("sentirnent",), ("sentiment",), ("งานวิจัยนี้มีตัวอย่างมากมายหลายหลาก" * 4,), ("",)], "w string")
    h = [r[0] for r in df.select(P.anagram_hash(F.col("w"))).collect()]
    assert h[0] - h[1] == sum(ord(c) ** 5 for c in "rn") - ord("m") ** 5 and h[3] == 0
    assert P._explains("sentirnent", "sentiment", "rn", "m") == 5 and P._explains("abc", "abd", "e", "c") == -1


def learned(spark):
    import random

    random.seed(2)
    text = [
        "Dr. Mills saw the table. It was new.", "See Fig. 3 for more of this. The rest, e.g. the tables, came later.", "We met at 5 p.m. It was late.",
        "They came by 9 p.m. on time. The cats, dogs, etc. were there.", "No. That was all. The no. 7 train left.", "We use the table, cf. Tab. 2 below. The end came.",
        "It grew by approx. 3 points. The end was near.", "One said this. The others left the room. We stayed here.",
    ]
    rows = [(" ".join(random.sample(text, 4)),) for _ in range(400)]
    zh = ["有人问：“够吗？”然后继续检验。", "结果说明差异。", "由于模型较少，我们研究。", "为什么如此重要？"]
    rows += [("".join(random.sample(zh, 3)),) for _ in range(200)]
    th = ["บทความนี้ศึกษาระบบของ Abc โดยใช้ข้อมูลใหม่", "เนื่องจากภาษามีน้อยเราจึงศึกษา", "ผลการทดลองแสดงว่าดีกว่าระบบ"]
    rows += [(" ".join(random.sample(th, 3)),) for _ in range(200)]
    return S.learn(spark.createDataFrame(rows, "content string"))


@pytest.fixture(scope="module")
def taught(spark):
    return learned(spark)


def by_language(taught):
    words: dict = {}
    for r in taught.collect():
        words.setdefault(r.lang, []).append((r.what, r.word))
    return {lang: S.model_of(w) for lang, w in words.items()}


@pytest.fixture(scope="module")
def models(taught):
    return by_language(taught)


def parts(text, models):
    lang, out, start = language(text), [], 0
    for end in S.sentence_ends(text, lang, models.get(lang, S.Model())):
        out.append(text[start:end].strip())
        start = end
    return out


@pytest.mark.parametrize(
    "sentences",
    [
        ["Dr. Mills saw the table.", "It was new."],
        ["We met at 5 p.m.", "The others left the room."],
        ["They came by 9 p.m. on time."],
        ["See Fig. 3 for more of this.", "The rest, e.g. the tables, came later."],
        ["It grew by 3.5 points, and the no. 7 train left.", "Was it late?", "It was!"],
        ['"Who can tell?" asked one of the others.', "We stayed here."],
        ['One said, "The end was near."', "The rest left."],
        ["(See the table for more.)", "The end came."],
        ["It waits ... and then it came.", "The end."],
        ["The data are at a.example/v1.2/x.html for all.", "This one is cut of"],
    ],
)
def test_english_sentences(models, sentences):
    assert parts(" ".join(sentences), models) == sentences


def test_other_scripts(models):
    zh = ["结果说明差异。", "有人问：“够吗？”然后继续检验。", "为什么如此重要？"]
    assert parts("".join(zh), models) == zh
    th = ["บทความนี้ศึกษาระบบของ Abc โดยใช้ข้อมูลใหม่", "ผลการทดลองแสดงว่าดีกว่าระบบ"]
    assert parts(" ".join(th), models) == th
    hi = ["यह विधि की तुलना में है।", "क्या यह हर है?"]
    assert parts(" ".join(hi), models) == hi


def test_paragraphs_glue_and_noise(models):
    assert parts("The end\n\nWe stayed", models) == ["The end", "We stayed"]
    assert parts("The others left the room.We stayed here.", models) == ["The others left the room.", "We stayed here."]
    text = "Dr​. Mills saw the ta­ble. It was new."
    assert parts(text, models) == ["Dr​. Mills saw the ta­ble.", "It was new."]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_ends_of_anything(text):
    ends = S.sentence_ends(text, language(text), S.Model())
    assert ends == sorted(set(ends)) and all(0 < e <= len(text) for e in ends)


def test_sentence_table(spark, taught, monkeypatch):
    rows = [("1", "The end came. We stayed.", 1), ("2", None, 1), ("3", "", 1), ("4", "  \n ", 1), ("5", "word " * 30000, 1), ("6", "See Fig. 3 at 5 p.m. The end came.", 1)]
    df = spark.createDataFrame(rows, "id string, content string, end_char int")
    got = S.sentences(df, taught, ("id",)).collect()
    assert [(r.id, r.start_char, r.end_char) for r in got] == [("1", 0, 13), ("1", 14, 24), ("5", 0, 149999), ("6", 0, 20), ("6", 21, 34)]
    assert all(r.sentence == dict((a, b) for a, b, _ in rows)[r.id][r.start_char : r.end_char] for r in got)
    # Without a broadcast every text gets the words that it holds.
    monkeypatch.setattr(S, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, S.sentences(df, taught, ("id",)).collect())) == sorted(map(tuple, got))
    assert S.sentences(df.limit(0), taught, ("id",)).count() == 0
    assert S.learn(df.limit(0)).count() == 0


def test_more_of_the_same_changes_nothing(spark):
    """An abbreviation that now and then stands without its period, at 60 and at 6,000 uses; one of seven letters; collocations."""
    text = (
        ["They saw cats, dogs etc. and one more. The rest left."] * 57
        + ["They saw cats, dogs etc and one more. The rest left.", "We ask what this is. The end came."]
        + ["We saw Anna Bella with Clara Dora of Essen before noon. The rest came with Emil Frank and Gerda Hanne."] * 300
        + ["The departm. of one city and the departm. of the other met. We left."] * 150
        + ["He lives at no. 4 with vitamin C. The others left.", "By J. Mills and J. Mills of one town. We met J. Mills. It rained."] * 20
    )
    once = by_language(S.learn(spark.createDataFrame([(t,) for t in text], "content string")))["en"]
    often = by_language(S.learn(spark.createDataFrame([(" ".join([t] * 100),) for t in text], "content string")))["en"]
    for model in (once, often):
        assert {"etc", "departm"} <= model.abbreviations
        assert "j Mills" in model.collocations and "The" in model.starters
        assert parts("It is vitamin C. The end.", {"en": model}) == ["It is vitamin C.", "The end."]


def test_dunning(spark):
    from pyspark.sql import functions as F

    from paperlake.llm.likelihood import dunning

    df = spark.createDataFrame([(50, 100, 10, 1000), (1, 100, 500, 1000), (0, 0, 1, 1)], "a long, b long, c long, d long")
    high, low, none = (r[0] for r in df.select(dunning(*map(F.col, "abcd"))).collect())
    assert high > 100 and low == 0 and none == 0
