"""Per-document text quality statistics, and prose told from lists, tables and junk."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.inputs import map_lists
from paperlake.llm.words import COMMON_WORDS, THAI, UNSPACED, WORDS

STATISTICS = (
    "n_chars int, n_words int, mean_word_length double, symbol_ratio double, digit_ratio double, n_lines int,"
    " ended_line_share double, list_line_share double, common_word_share double, mean_run_length double,"
    " duplicate_line_share double, duplicate_paragraph_share double, top_bigram_share double,"
    " top_3gram_share double, top_4gram_share double, repeated_5gram_share double, repeated_6gram_share double,"
    " repeated_7gram_share double, repeated_8gram_share double, repeated_9gram_share double, repeated_10gram_share double,"
    " duplicate_item_share double"
)

EAST_STOP = re.compile("[。！？]")
_DIGIT = re.compile(r"\d")
# What parts the items of a list that stands on one line.
_ITEM_END = re.compile(r"[\n\t|;,·•▪◦、，；。！？।]|[.!?]\s|\s/\s|\s[-–—]\s")
_LINE_END = re.compile("[.!?…:;।॥。！？：；][\"'»”’“)\\]）」』]*\\s*$")
_LIST_LINE = re.compile(
    r"\s*(?:[-*•–—·▪◦o]\s+\S|[(\[]\s*\w{1,3}\s*[)\]]\s|\d{1,3}[.)](?!\d)\s|(?:\S+\s*[|&\t;]\s*){2,}|.*\.{4,}\s*\d*\s*$|[\w.\[\]]+ ?[-+*/]?= ?\S"
    r"|.*\w ?[!<>+\-*/=]= ?\S|(?:for|if|elif|while|def|class)\b.*:$|return \w+$|[\w.]+\([^()]*\)$)"
)

# Thresholds of the combined rules.
LEAST_LETTERS = 0.55  # of all characters but space
LEAST_COMMON = 0.11  # of the words, where words are spaced
LEAST_RUN = 6.5  # characters of Chinese or Japanese
LEAST_THAI_RUN = 11.0
SHORT = 6  # words; shorter texts are judged by their letters only
MOST_REPEATED = 0.5  # of the lines or of the characters
MOST_REPEATED_ITEMS = 0.2  # of the items of what lacks function words
LEAST_ENDED = 0.5  # of the lines, for prose of a language whose function words aren't known
MOST_SIGNS = 0.12  # signs or digits in such prose
# Of the characters: the top 2- to 4-gram, all repeated 5- to 10-grams.
MOST_OF_NGRAMS = (MOST_REPEATED, 0.45, 0.4, 0.8, 0.78, 0.76, 0.74, 0.72, 0.7)
REPEATABLE = 50  # words from which repetition counts; two sentences of one form are no boilerplate


def _run_length(text: str, runs: list[int]) -> float:
    """Mean length of the runs between marks, on the scale of LEAST_RUN.

    A Chinese or Japanese full stop vouches for a sentence; Thai words are
    written together up to the end of a clause, so its runs count for less.
    """
    mean = sum(runs) / len(runs)
    if EAST_STOP.search(text):
        return max(mean, 2 * LEAST_RUN)
    return mean * LEAST_RUN / LEAST_THAI_RUN if len(THAI.findall(text)) * 2 > sum(runs) else mean


def _top_ngram(words: list[str], chars: int, n: int) -> float:
    """Share of the characters that the most repeated sequence of n words covers."""
    if len(words) < n + 2:
        return 0.0
    every = list(zip(*(words[i:] for i in range(n))))
    if len(set(every)) == len(every) or not chars:
        return 0.0
    grams = Counter(every)
    times = max(grams.values())
    return min(1.0, times * max(sum(map(len, g)) for g, k in grams.items() if k == times) / chars)


def _repeated_ngrams(words: list[str], chars: int) -> list[float]:
    """Shares of the characters in words of a repeated sequence of 5 to 10 words; words of several count once."""
    out = [0.0] * 6
    for n in range(5, 11):
        grams = list(zip(*(words[i:] for i in range(n))))
        if len(set(grams)) == len(grams) or not chars:
            break
        times = Counter(grams)
        covered, end = 0, 0
        for i, g in enumerate(grams):
            if times[g] > 1:
                covered += sum(map(len, words[max(i, end) : i + n]))
                end = i + n
        out[n - 5] = covered / chars
    return out


def _duplicates(parts: list[str]) -> float:
    """Share of the characters that stand in a part seen before."""
    if len(parts) < 2:
        return 0.0
    total = sum(map(len, parts))
    return 1 - sum(map(len, set(parts))) / total if total else 0.0


def statistics(text: str, for_kind: bool = False) -> tuple:
    """The columns of STATISTICS for one text; `for_kind` leaves out, as 0, what kind() doesn't ask for in such a text."""
    words = WORDS.findall(text.lower())
    letters = sum(map(len, words))
    solid = len(text) - text.count(" ") - text.count("\n") - text.count("\t") or 1
    digits = len(_DIGIT.findall(text))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    unspaced = [len(w) for w in words if UNSPACED.match(w)] if not text.isascii() and UNSPACED.search(text) else []
    n = len(words)
    grams = [0.0] * 9 if for_kind and n < REPEATABLE else [*(_top_ngram(words, letters, k) for k in (2, 3, 4)), *_repeated_ngrams(words, letters)]
    common = sum(map(COMMON_WORDS.__contains__, words)) / n if n else 0.0
    items = 0.0 if for_kind and common >= LEAST_COMMON else _duplicates([x for x in map(str.strip, _ITEM_END.split(text.lower())) if x])
    return (
        len(text),
        n,
        letters / n if n else 0.0,
        max(0.0, (solid - letters - digits) / solid),
        digits / solid,
        len(lines),
        sum(1 for x in lines if _LINE_END.search(x[-8:])) / len(lines) if lines else 0.0,
        sum(1 for x in lines if _LIST_LINE.match(x)) / len(lines) if lines else 0.0,
        common,
        _run_length(text, unspaced) if len(unspaced) * 2 > n or sum(unspaced) * 2 > letters else 0.0,
        _duplicates(lines),
        _duplicates([x for x in text.split("\n\n") if x and not x.isspace()]),
        *grams,
        items,
    )


class Evidence(NamedTuple):
    """What the statistics of one text show, each by itself."""

    lettered: bool  # mostly letters
    natural: bool  # function words, or the unbroken runs of a script without spaces
    sentences: bool  # lines end as sentences do, with few signs and digits
    listed: bool  # lines made like those of lists, code, tables of contents
    repeated: bool  # lines, paragraphs or sequences of words that cover much of the text
    boilerplate: bool  # items that recur, as in menus


def evidence(s: tuple) -> Evidence:
    _, n, _, symbols, digits, n_lines, ended, listed, common, run, dup_lines, dup_paragraphs, *ngrams, dup_items = s
    letters = 1 - symbols - digits
    return Evidence(
        letters >= (LEAST_LETTERS - 0.1 if run else LEAST_LETTERS),
        run >= LEAST_RUN if run else common >= LEAST_COMMON,
        ended >= LEAST_ENDED and symbols < MOST_SIGNS and digits < MOST_SIGNS,
        n_lines > 2 and not run and (listed > 0.6 and common < 2 * LEAST_COMMON or listed > 0.9 and symbols > 0.15),
        n >= REPEATABLE
        and (dup_lines > MOST_REPEATED or dup_paragraphs > MOST_REPEATED or any(map(float.__gt__, ngrams, MOST_OF_NGRAMS))),
        n >= 2 * SHORT and dup_items > MOST_REPEATED_ITEMS,
    )


def kind(s: tuple) -> str:
    """prose, or what else a text with these statistics is: junk, table, repeated, boilerplate, list.

    Text that one sequence of words, line or paragraph covers is `repeated`,
    whatever it is made of.  Text that is not mostly letters is a table or
    junk.  Mostly letters with function words (or, without spaces, the long
    unbroken runs of sentences) is prose unless its lines are made like a
    list's; without them it is prose only if it is punctuated like sentences
    and nothing recurs.  Items that recur then make it `boilerplate`.  A short
    text is prose if it is mostly letters.  A wrapped, cut-off or unpunctuated
    text is prose by its words.
    """
    n, symbols, digits, listed, run = s[1], s[3], s[4], s[7], s[9]
    letters = 1 - symbols - digits
    if n == 0:
        return "junk"
    shown = evidence(s)
    if shown.repeated:
        return "repeated"
    if letters < 0.35:
        return "table" if digits > 0.35 else "junk"
    if n < SHORT and not run:
        return "prose" if letters >= LEAST_LETTERS and listed < 0.5 else "list"
    if shown.lettered and (shown.natural or not run and shown.sentences and not shown.boilerplate):
        return "list" if shown.listed else "prose"
    if shown.boilerplate:
        return "boilerplate"
    if digits > 0.2:
        return "table"
    return "list" if shown.natural or listed > 0.3 or symbols < 0.2 else "junk"


def quality(texts: DataFrame, text: str = "content", keys: tuple[str, ...] = ("paper_id", "section_key")) -> DataFrame:
    """keys..., the columns of STATISTICS and `kind` for every text.

    A null or empty text gives no row; repeated rows give repeated rows; an
    empty table gives none.  Other columns are ignored.  One pass, no shuffle.
    """
    base = texts.select(*keys, F.col(text).alias("text")).where(F.length("text") > 0)
    types = {f.name: f.dataType.simpleString() for f in base.schema}

    def rows(*columns: list) -> list[tuple]:
        out = []
        for *key, value in zip(*columns):
            s = statistics(value)
            out.append((*key, *s, kind(s)))
        return out

    return map_lists(base, rows, ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {STATISTICS}, kind string")


def unnatural(texts: DataFrame, text: str = "content", keys: tuple[str, ...] = ("paper_id", "section_key")) -> DataFrame:
    """keys..., `kind` of every text that is not prose; as quality(), but without the statistics that no rule asks for."""
    base = texts.select(*keys, F.col(text).alias("text")).where(F.length("text") > 0)
    types = {f.name: f.dataType.simpleString() for f in base.schema}

    def rows(*columns: list) -> list[tuple]:
        return [(*key, k) for *key, value in zip(*columns) if (k := kind(statistics(value, True))) != "prose"]

    return map_lists(base, rows, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", kind string")
