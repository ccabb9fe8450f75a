"""Noise in text from scanned pages.

Three repairs per line: a line that belongs to the page and not to the text is
dropped; a word broken at the end of a line is joined, unless the corpus shows
that its hyphen belongs to it; a word with misrecognised characters is
corrected.

Misrecognised words are found over the whole corpus.  Every word has an
anagram hash, the sum of the fifth powers of its characters' code points.  A
confusion such as rn for m changes that sum by a fixed difference, so a rare
word meets its frequent variants by an equality join on hash minus difference.
Candidates are verified on the strings and ranked by the variant's frequency.

One pass over the contents counts words and finds what a line shows by itself;
a second one finds the lines of the words that have a correction.  A content
in one line shows no page, and is only counted.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.glyphs import plain
from paperlake.llm.inputs import map_lists
from paperlake.llm.quality import kind, statistics
from paperlake.session import cut

# What is read on the page, and what stands there.
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "é"), ("6", "b"), ("8", "b"), ("9", "g"), ("2", "z"), ("4", "a"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("l", "i"), ("i", "l"), ("u", "n"), ("n", "u"),
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("li", "h"), ("h", "li"),
    ("ni", "m"), ("in", "m"), ("tl", "d"), ("lc", "k"), ("q", "g"), ("g", "q"), ("o", "0"),
)

KEYS = ("paper_id", "section_key")

#: A variant is frequent from this count, and if it is this many times as frequent as the rare word.
FREQUENT = 20
RATIO = 10
TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
PART = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"([^\W_]+(?:-[^\W_]+)*)[-‐‑¬]$")
_GOES_ON = re.compile(r"[\"'“„«(]*([^\W\d_][^\W_]*(?:-[^\W_]+)*)")
_DIGIT_INSIDE = re.compile(r"(?<![\w.])[^\W\d_]*[a-zà-öø-ÿ][0-9][a-zà-öø-ÿ][^\W_]*|(?<![\w.\-])(?:(?![\u0e00-\u0e7f\u3040-ヿ㐀-鿿豈-\ufaff])[^\W\d_]){3,}[0-9](?![\w.\-])|(?<![\w.\-])[0-9][^\W\d_]{4,}")
# What all of these have, and few texts.
_DIGIT_NEAR = re.compile(r"[0-9](?=[^\W\d_])|[0-9](?<=[^\W\d_][0-9])")
# A version such as v5.3 is no word.
_VERSION = re.compile(r"(?<![^\W_])[^\W\d_][0-9]+(?=\.[0-9])")
_PAGE_NUMBER = re.compile(
    r"(?:p[aà4]g[ec]|[ps]{1,2}\.|seite|стр\.?|с\.)?\s*N|\[\s*N\s*\]|\(\s*N\s*\)|[-–—]+\s*N\s*[-–—]+|N\s*/\s*N|[ivxl]{1,8}".replace(
        "N", r"(?=[oil]{0,3}\d)[\doil]{1,4}"
    ),
    re.I,
)
# A mark that may end a sentence, moved to a line of its own, is text.
_SPECK = re.compile(r"(?![!?.…»”\"]+$|[!?] »$)[\W_]{1,4}")
_PROCEEDINGS = re.compile(r"pr[o0]c(?:\.|[ec]{2}d\w*)[\s,].*\d{4}.*", re.I)
_NAME_AND_PAGE = re.compile(r"\d{1,4}\s{2,}\S+(?: \S+)?|\S+(?: \S+)?\s{2,}\d{1,4}")
_ET_AL = re.compile(r"\S+ [ec]t [ao][l1]\.?", re.I)
_LETTERS = re.compile(r"[\W_]+")
_OUTER_NUMBER = re.compile(r"^\d{1,4}\s{2,}|\s{2,}\d{1,4}$")
_LONGEST_HEADER = 100


def _bare(text: str) -> str:
    return _LETTERS.sub("", plain(text)).lower()


def is_title_line(line: str, title: str, names: frozenset[str]) -> bool:
    """True if a line repeats the start of the title, with or without names or a page number, misread or not.

    `title` is the title's bare letters.  Two of the first four letters must be
    right before the whole line is compared.
    """
    head, colon, tail = line.partition(": ")
    parts = [line]
    if colon and "&" in head:
        if any(_bare(x) in names for x in head.split("&")):
            return True
        parts.append(tail)
    if len(title) < 8:
        return False
    for part in parts:
        part = _OUTER_NUMBER.sub("", part.strip())
        if sum(map(str.__eq__, _LETTERS.sub("", part[:12]).lower()[:4], title)) < 2:
            continue
        got = _bare(part)
        start = title[: len(got)]
        if len(got) < 8 or len(got) > len(title) + 3:
            continue
        if got == start:
            return True
        same = SequenceMatcher(None, got, start, autojunk=False)
        if same.quick_ratio() > 0.85 and same.ratio() > 0.85:
            return True
    return False


def dropped_lines(lines: list[str], title: str | None, authors: list[str] | None) -> set[int]:
    """Numbers of the lines that are page numbers, running headers or specks; empty lines are none.

    A page number stands alone on its line.  A header repeats the title, an
    author's name or the proceedings; one that matches less clearly counts only
    beside a page number.
    """
    out: set[int] = set()
    bare_title = _bare(title) if title else ""
    names = frozenset(_bare(PART.findall(a)[-1]) for a in authors or () if a and PART.search(a)) | frozenset(
        _bare(PART.findall(a)[0]) for a in authors or () if a and "," in a and PART.search(a)
    )
    numbers = set()
    for i, raw in enumerate(lines):
        line = raw.strip()
        # A header is the title, with names and a number, or shorter.
        if not line or len(line) > max(_LONGEST_HEADER, len(title or "") + _LONGEST_HEADER // 2):
            continue
        if _SPECK.fullmatch(line):
            out.add(i)
        elif len(line) < 16 and _PAGE_NUMBER.fullmatch(line):
            numbers.add(i)
        elif _PROCEEDINGS.fullmatch(line) or _NAME_AND_PAGE.fullmatch(line) or _ET_AL.fullmatch(line):
            out.add(i)
        elif bare_title and is_title_line(line, bare_title, names):
            out.add(i)
    out |= numbers
    # Beside a page number, with nothing but blank or dropped lines between, a
    # line in capitals that ends no sentence is a header too.
    for i in numbers:
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(lines) and (j in out or not lines[j].strip()):
                j += step
            if 0 <= j < len(lines):
                line = lines[j].strip()
                if line.isupper() and len(line) > 8 and not line.endswith((".", "-")):
                    out.add(j)
    return out


def breaks(lines: list[str], dropped: set[int]) -> list[tuple[int, int, str, str]]:
    """(line, next line of text, first part, second part) of every word broken at a line's end."""
    text = [i for i, x in enumerate(lines) if i not in dropped and x.strip()]
    out = []
    for i, j in zip(text, text[1:]):
        line = lines[i].rstrip()
        if line[-1:] in "-‐‑¬" and (m := _BROKEN.search(line)) and (n := _GOES_ON.match(lines[j].lstrip())):
            if not m.group(1)[-1].isdigit():
                out.append((i, j, m.group(1), n.group(1)))
    return out


class Counts:
    """Words of many contents: in one piece, broken at line ends, and on the lines of prose with line breaks."""

    def __init__(self) -> None:
        self.whole: Counter = Counter()
        self.broken: Counter = Counter()
        self.paged: Counter = Counter()

    def add(self, tokens: list[str], paged: bool) -> None:
        self.whole.update(tokens)
        if paged:
            self.paged.update(tokens)
        for t in tokens:
            if "-" in t:
                self.whole.update(t.split("-"))
                if paged:
                    self.paged.update(t.split("-"))

    def rows(self) -> list[tuple[str, int, int, int]]:
        words = self.whole.keys() | self.broken.keys()
        return [(w, self.whole.get(w, 0), self.broken.get(w, 0), self.paged.get(w, 0)) for w in words]


def text_lines(lines: list[str], dropped: set[int], cuts: list[tuple[int, int, str, str]]) -> list[tuple[int, str]]:
    """(number, line) of the lines of text, without the parts of words that are broken at their ends."""
    open_at = {i: a for i, _, a, _ in cuts}
    goes_on = {j: b for _, j, _, b in cuts}
    out = []
    for i, line in enumerate(lines):
        if i in dropped or not line or line.isspace():
            continue
        if i in goes_on:
            line = line[line.index(goes_on[i]) + len(goes_on[i]) :]
        if i in open_at:
            line = line.rstrip()[: -1 - len(open_at[i])]
        out.append((i, line))
    return out


def read_content(content: str, title: str | None, authors: list[str] | None, counts: Counts) -> list[tuple]:
    """Counts the words of a content, and returns (line, what, word, other) for what its lines show by themselves.

    drop: the line is none of the text.  join: a word broken at the line's end,
    with and without its hyphen.  chars: a digit inside a word.  Contents that
    are no prose, or have no line break, only count their words.
    """
    if "\n" not in content or kind(statistics(content, True)) != "prose":
        counts.add(TOKEN.findall(content.lower()), False)
        return []
    lines = content.split("\n")
    dropped = dropped_lines(lines, title, authors)
    cuts = breaks(lines, dropped)
    out: list[tuple] = [(i, "drop", None, None) for i in sorted(dropped)]
    for i, _, a, b in cuts:
        word = (a + b).lower()
        counts.broken[word] += 1
        counts.paged[word] += 1
        out.append((i, "join", word, f"{a}-{b}".lower()))
    if _DIGIT_NEAR.search(content):
        out += [(i, "chars", None, None) for i, x in enumerate(lines) if i not in dropped and _DIGIT_INSIDE.search(x)]
    counts.add(TOKEN.findall("\n".join(x for _, x in text_lines(lines, dropped, cuts)).lower()), True)
    return out


def misread_words(content: str, title: str | None, authors: list[str] | None, wanted: frozenset[str] | None) -> list[tuple]:
    """(line, next line, cut at, word) for the words on the lines of prose with line breaks, all or those that are wanted.

    A word broken at the end of a line has the number of the next line and the
    length of its first part; for others these are null and 0.
    """
    if "\n" not in content:
        return []
    lines = content.split("\n")
    if wanted is not None and wanted.isdisjoint(PART.findall(content.lower())) and not any(x.rstrip()[-1:] in "-‐‑¬" for x in lines if x):
        return []
    dropped = dropped_lines(lines, title, authors)
    cuts = breaks(lines, dropped)
    out = []
    for i, line in text_lines(lines, dropped, cuts):
        line = line.lower()
        words = {w for w in PART.findall(line) if len(w) > 1 and not w.isdigit()}
        words.difference_update(_VERSION.findall(line))
        out += [(i, None, 0, w) for w in (words & wanted if wanted is not None else words)]
    out += [(i, j, len(a), w) for i, j, a, b in cuts if (w := (a + b).lower()) and (wanted is None or w in wanted)]
    return out if out and kind(statistics(content, True)) == "prose" else []


def read_pages(pages: DataFrame) -> DataFrame:
    """One pass over all contents: word counts, added up per Arrow batch, and what the lines may need."""

    def rows(paper: list, key: list, content: list, title: list, authors: list) -> list[tuple]:
        counts, out = Counts(), []
        for p, k, c, t, a in zip(paper, key, content, title, authors):
            out += [(p, k, *row, None, None, None) for row in read_content(c, t, a, counts)]
        out += [(None, None, None, "count", w, None, n, b, g) for w, n, b, g in counts.rows()]
        return out

    return map_lists(
        pages.select(*KEYS, "content", "title", "authors").where(F.length("content") > 0),
        rows,
        "paper_id string, section_key string, line_no int, what string, word string, other string, n bigint, broken bigint, paged bigint",
    )


def vocabulary(read: DataFrame) -> DataFrame:
    """(word, n, broken, paged) over all contents."""
    return (
        read.where(F.col("what") == "count")
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.sum("broken").alias("broken"), F.sum("paged").alias("paged"))
    )


def anagram_hash(word) -> F.Column:
    """Sum of the fifth powers of the code points; null where it overflows, in scripts that have none of the confusions."""

    def fifth(c: F.Column) -> F.Column:
        code = F.ascii(c).cast("bigint")
        square = code * code
        return F.try_multiply(F.try_multiply(square, square), code)

    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda total, c: F.try_add(total, fifth(c)))


def _power(text: str) -> int:
    return sum(ord(c) ** 5 for c in text)


def _explains(rare: str, frequent: str, wrong: str, right: str) -> int:
    """Where `wrong` stands in the rare word for `right` in the frequent one, or -1."""
    at = rare.find(wrong)
    while at >= 0:
        if rare[:at] + right + rare[at + len(wrong) :] == frequent:
            return at
        at = rare.find(wrong, at + 1)
    return -1


def corrections(words: DataFrame) -> DataFrame:
    """(word, correct, at): the best correction of every misrecognised word on the lines of prose with line breaks.

    A word of two letters is corrected only if it holds a digit.  Among several
    variants the most frequent one wins, then the first by code point.
    """
    usable = words.where((F.length("word") > 1) & ~F.col("word").contains("-")).select(
        "word", (F.col("n") + F.col("broken")).alias("n"), "paged", anagram_hash("word").alias("hash")
    )
    confusion = words.sparkSession.createDataFrame(
        [(a, b, _power(a) - _power(b)) for a, b in CONFUSIONS], "wrong string, right string, change bigint"
    )
    rare = usable.where(
        (F.col("paged") > 0) & ((F.length("word") > 2) | F.col("word").rlike("[0-9]")) & F.col("word").rlike("[^0-9]")
    )
    frequent = usable.where((F.col("n") >= FREQUENT) & ~F.col("word").rlike("[0-9]")).select(
        F.col("word").alias("correct"), F.col("n").alias("n_correct"), "hash"
    )
    wanted = (
        rare.join(F.broadcast(confusion), F.expr("instr(word, wrong) > 0"))
        .select("word", "n", "wrong", "right", (F.col("hash") - F.col("change")).alias("hash"))
    )
    met = wanted.join(frequent, "hash").where(F.col("n_correct") >= RATIO * F.col("n"))

    def verify(word: list, wrong: list, right: list, correct: list, n: list) -> list[tuple]:
        out = []
        for w, a, b, c, k in zip(word, wrong, right, correct, n):
            at = _explains(w, c, a, b)
            if at >= 0:
                out.append((w, c, at, k))
        return out

    verified = map_lists(
        met.select("word", "wrong", "right", "correct", "n_correct"), verify, "word string, correct string, at int, n bigint"
    )
    best = F.max_by(F.struct("correct", "at"), F.struct(F.col("n"), F.col("correct")))
    return verified.groupBy("word").agg(best.alias("b")).select("word", "b.correct", "b.at")


#: Corrected words up to this number are broadcast (some 2 MB); beyond it the words of all lines are joined with them.
MOST_BROADCAST = 50_000


def misread_lines(pages: DataFrame, fixes: DataFrame) -> DataFrame:
    """(paper_id, section_key, line_no, word, correct) for the words of `fixes` (word, correct, at) on the lines of text.

    While there are few fixes the contents are filtered by them in one pass;
    otherwise all words are shuffled.  Both ways give the same rows.
    """
    few = fixes.select("word").limit(MOST_BROADCAST + 1).collect()
    only = frozenset(r.word for r in few) if len(few) <= MOST_BROADCAST else None
    shared = pages.sparkSession.sparkContext.broadcast(only)

    def rows(paper: list, key: list, content: list, title: list, authors: list) -> list[tuple]:
        return [(p, k, *x) for p, k, c, t, a in zip(paper, key, content, title, authors) for x in misread_words(c, t, a, shared.value)]

    found = map_lists(
        pages.select(*KEYS, "content", "title", "authors").where(F.length("content") > 0),
        rows,
        "paper_id string, section_key string, line_no int, next_line int, cut_at int, word string",
    )
    at = F.when(F.col("next_line").isNotNull() & (F.col("at") >= F.col("cut_at")), F.col("next_line")).otherwise(F.col("line_no"))
    return found.join(fixes, "word").select(*KEYS, at.alias("line_no"), "word", "correct")


def repairs(pages: DataFrame) -> DataFrame:
    """(paper_id, section_key, line_no, repair, word, correct): what every line needs.

    `pages` has paper_id, section_key, content, title, authors; other columns
    are ignored.  repair is drop, join or chars; for join, word is the word in
    one piece; for chars, the misread word and its correction where the corpus
    has one.  Null and empty contents give no rows, nor does an empty table;
    repeated rows are reported once; a null title or author list only removes
    that evidence for headers.
    """
    read = cut(read_pages(pages))
    words = cut(vocabulary(read))
    known = words.select("word", "n")
    fixes = cut(corrections(words))
    found = read.where(F.col("what") != "count").select(*KEYS, "line_no", "what", "word", "other")
    plain_rows = found.where(F.col("what").isin("drop", "chars")).select(
        *KEYS, "line_no", F.col("what").alias("repair"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("correct")
    )
    ends = found.where(F.col("what") == "join")
    parts = (
        ends.join(known.select("word", F.col("n").alias("n_joined")), "word", "left")
        .join(known.select(F.col("word").alias("other"), F.col("n").alias("n_hyphen")), "other", "left")
        .withColumn("left_part", F.regexp_extract("other", "^(?:.*-)?([^-]+)-[^-]+$", 1))
        .withColumn("right_part", F.regexp_extract("other", "([^-]+)$", 1))
        .join(known.select(F.col("word").alias("left_part"), F.col("n").alias("n_left")), "left_part", "left")
        .join(known.select(F.col("word").alias("right_part"), F.col("n").alias("n_right")), "right_part", "left")
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    compound = (n("n_hyphen") > n("n_joined")) | (
        (n("n_hyphen") == 0) & (n("n_joined") == 0) & (n("n_left") >= FREQUENT) & (n("n_right") >= FREQUENT)
    )
    joins = parts.where(~compound).select(
        *KEYS, "line_no", F.lit("join").alias("repair"), "word", F.lit(None).cast("string").alias("correct")
    )
    chars = misread_lines(pages, fixes).select(*KEYS, "line_no", F.lit("chars").alias("repair"), "word", "correct")
    return plain_rows.unionByName(joins).unionByName(chars).distinct()


def repaired_text(pages: DataFrame, line_repairs: DataFrame) -> DataFrame:
    """(paper_id, section_key, text): the contents of `pages` as continuous paragraphs.

    Lines of a paragraph are joined by a space, broken words are put together,
    misread words with a known correction are replaced, dropped lines vanish.
    A content without repairs is only unwrapped.  The repairs of one content
    are gathered in one row; a content holds them anyway.
    """
    todo = line_repairs.groupBy(*KEYS).agg(F.collect_list(F.struct("line_no", "repair", "word", "correct")).alias("todo"))
    base = pages.select(*KEYS, "content").where(F.length("content") > 0).distinct().join(todo, list(KEYS), "left")

    def rows(paper: list, key: list, content: list, todo: list) -> list[tuple]:
        out = []
        for p, k, c, steps in zip(paper, key, content, todo):
            drop, join, fix = set(), set(), {}
            for s in steps or ():
                if s["repair"] == "drop":
                    drop.add(s["line_no"])
                elif s["repair"] == "join":
                    join.add(s["line_no"])
                elif s["word"]:
                    fix[s["word"]] = s["correct"]
            out.append((p, k, put_together(c, drop, join, fix)))
        return out

    return map_lists(base.select(*KEYS, "content", "todo"), rows, "paper_id string, section_key string, text string")


def _like(new: str, old: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new


def put_together(content: str, drop: set[int], join: set[int], fix: dict[str, str]) -> str:
    paragraphs: list[str] = []
    glue = "\n"
    pending_blank = False
    for i, line in enumerate(content.split("\n")):
        if i in drop:
            continue
        if not line.strip():
            pending_blank = True
            continue
        line = line.strip()
        # A blank line before a line that goes on in lower case only surrounds a page break.
        goes_on = bool(paragraphs) and (glue == "" or not pending_blank or line[:1].islower() and paragraphs[-1][-1:] not in ".!?")
        if goes_on:
            paragraphs[-1] += glue + line if glue != "\n" else " " + line
        else:
            paragraphs.append(line)
        pending_blank, glue = False, " "
        if i in join:
            paragraphs[-1] = re.sub(r"[-‐‑¬]$", "", paragraphs[-1])
            glue = ""
        elif line.endswith("-"):
            glue = ""
    text = "\n\n".join(paragraphs)
    return PART.sub(lambda m: _like(fix[m.group().lower()], m.group()) if m.group().lower() in fix else m.group(), text)
