"""Visually identical text with different characters.

A value is brought to one form in two steps.  What has only one reading is
repaired at once: composed letters, zero-width characters, spaces, hyphens,
full-width and ligature forms.  Look-alike letters are repaired per word, and
only in words that mix scripts: the scripts of its letters are counted, the
others are substituted by look-alikes of the dominant one, and the result is
taken if the vocabulary of the corpus has it.  The vocabulary are the words of
one script in all values after the first step.  A result of four letters or
more that is no word of it, such as a name that occurs once, is taken if the
vocabulary has all of its pieces: every run of three letters, the ends counting
as letters.  Words wholly in another script are left alone.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.inputs import map_lists
from paperlake.session import cut

# Characters without width, other spaces, other hyphens.
INVISIBLE = "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "‐‑⁃﹣－"

# Letters that look alike, Cyrillic and Greek to Latin.
CYRILLIC_LATIN = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H",
    "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X",
    "Ѵ": "V", "Ԝ": "W", "Ԛ": "Q",
}
GREEK_LATIN = {
    "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "υ": "u", "ϲ": "c", "ϳ": "j", "κ": "k", "χ": "x", "γ": "y", "α": "a",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
}
LATIN_CYRILLIC = {v: k for k, v in reversed(CYRILLIC_LATIN.items()) if k in "асеорхуАВСЕНКМОРТХУ"} | {
    "k": "к", "m": "м", "t": "т", "b": "в", "h": "н", "n": "п", "u": "и", "r": "г",
}
GREEK_CYRILLIC = {g: LATIN_CYRILLIC[x] for g, x in GREEK_LATIN.items() if x in "aceopxyABCEHKMOPTXY"}
LATIN_GREEK = {v: k for k, v in reversed(GREEK_LATIN.items())}
CYRILLIC_GREEK = {c: LATIN_GREEK[x] for c, x in CYRILLIC_LATIN.items() if x in LATIN_GREEK}
TO = {
    "L": CYRILLIC_LATIN | GREEK_LATIN,
    "C": LATIN_CYRILLIC | GREEK_CYRILLIC,
    "G": LATIN_GREEK | CYRILLIC_GREEK,
}
# Lower-case Latin letters that only resemble Cyrillic ones in some typefaces.
WEAK_CYRILLIC = frozenset("kmtbhnur")

_LATIN = r"A-Za-zªºÀ-ÖØ-öø-ɏᴀ-ᶿḀ-ỿ"
_CYRILLIC = r"Ѐ-ԯᲀ-\u1c8f"
_GREEK = r"Ͱ-Ͽἀ-\u1fff"
_MARK = r"̀-ͯ"
WORD = re.compile(f"[{_LATIN}{_CYRILLIC}{_GREEK}{_MARK}]+")
_IN_LATIN = re.compile(f"[{_LATIN}]")
_IN_CYRILLIC = re.compile(f"[{_CYRILLIC}]")
_IN_GREEK = re.compile(f"[{_GREEK}]")
_EAST = re.compile(r"[\u3040-ヿㇰ-ㇿ㐀-䶿一-鿿豈-\ufaff]")
_ODD = re.compile(f"[{INVISIBLE}{SPACES}{HYPHENS}" + r"ﬀ-ﬆ！-\uffef\U0001d400-\U0001d7ff]")
_WIDE_LETTER = re.compile(r"[０-９Ａ-Ｚａ-ｚﬀ-ﬆ\U0001d400-\U0001d7ff]")
_HALF_KANA = re.compile(r"[｡-ﾟ]+")
_WIDE_SIGN = re.compile(r"[！-／：-＠［-｀｛-｠￠-￦]")
_ONE = {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in SPACES} | {ord(c): "-" for c in HYPHENS}
# A joiner after a virama spells a conjunct and an ideographic space is ordinary
# beside East Asian text; both are set aside while the rest is replaced.
_KEPT = re.compile("(?<=्)[\u200c\u200d]|(?<=[、-ヿ㐀-鿿！-？])\u3000|(?m:^)\u3000+")
_ASIDE = {"\u200c": "\ue000", "\u200d": "\ue001", "\u3000": "\ue002"}
_BACK = {ord(v): k for k, v in _ASIDE.items()}

#: Values without any of these need no repair; tested in the JVM before a row is sent to Python.
NEEDS_A_LOOK = "[^\\x00-\\x7F]"


def plain(text: str) -> str:
    """The repairs that have only one reading: everything but look-alike letters."""
    text = unicodedata.normalize("NFC", text)
    if not _ODD.search(text):
        return text
    east = bool(_EAST.search(text))
    kept = text
    if "्\u200c" in text or "्\u200d" in text or east and "\u3000" in text:
        kept = _KEPT.sub(lambda m: "".join(_ASIDE[c] for c in m.group()), text)
    kept = kept.translate(_ONE)
    kept = _WIDE_LETTER.sub(lambda m: unicodedata.normalize("NFKC", m.group()), kept)
    kept = _HALF_KANA.sub(lambda m: unicodedata.normalize("NFKC", m.group()), kept)
    if not east:
        kept = _WIDE_SIGN.sub(lambda m: unicodedata.normalize("NFKC", m.group()), kept)
    return unicodedata.normalize("NFC", kept.translate(_BACK) if kept is not text else kept)


@lru_cache(maxsize=50_000)
def readings(word: str) -> tuple[str, ...]:
    """What a word of mixed scripts reads in each of them where every other letter has a look-alike; none if it is not mixed.

    The dominant script comes first; among equals Latin, then Cyrillic.  A
    reading that needs Latin letters which resemble Cyrillic ones only in some
    typefaces comes last.
    """
    count = {"L": len(_IN_LATIN.findall(word)), "C": len(_IN_CYRILLIC.findall(word)), "G": len(_IN_GREEK.findall(word))}
    if sum(n > 0 for n in count.values()) < 2:
        return ()
    out = []
    for script in sorted(count, key=lambda s: -count[s]):
        if count[script]:
            table, own = TO[script], {"L": _IN_LATIN, "C": _IN_CYRILLIC, "G": _IN_GREEK}[script]
            new = "".join(c if own.match(c) or unicodedata.combining(c) else table.get(c, "\0") for c in word)
            if "\0" not in new:
                weak = script == "C" and any(c in WEAK_CYRILLIC for c in word)
                out.append((weak, new))
    return tuple(new for _, new in sorted(out, key=lambda r: r[0]))


def one_script(word: str) -> str | None:
    """The first reading of a word of mixed scripts, or None without one; the word itself if it is not mixed.

    For keys that are only compared; normalise() asks the vocabulary.
    """
    if not _mixed(word):
        return word
    found = readings(word)
    return found[0] if found else None


def _mixed(text: str) -> bool:
    return bool(_IN_LATIN.search(text)) + bool(_IN_CYRILLIC.search(text)) + bool(_IN_GREEK.search(text)) > 1


def mixed_words(text: str) -> set[str]:
    """The words of a text whose letters are of several scripts."""
    return {w for w in WORD.findall(text) if _mixed(w)} if not text.isascii() and _mixed(text) else set()


def repair(text: str) -> str:
    """A text with every mixed word in its first reading, without a vocabulary: for keys that are only compared."""
    text = plain(text)
    approved = {w: r[0] for w in mixed_words(text) if (r := readings(w))}
    return replace_words(text, approved) if approved else text


def replace_words(text: str, approved: dict[str, str]) -> str:
    return WORD.sub(lambda m: approved.get(m.group(), m.group()), text)


#: Words and pieces asked for up to this number are broadcast (at most some 2 MB); beyond it the vocabulary is joined by a shuffle.
MOST_BROADCAST = 50_000
#: Letters from which a word may be known by its pieces.
LEAST_PIECED = 4
PIECE = 3


def pieces_of(word: str) -> list[str]:
    """All runs of PIECE letters, the ends counting as letters."""
    word = f"^{word}$"
    return [word[i : i + PIECE] for i in range(len(word) - PIECE + 1)]


def corpus_terms(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """The terms of `wanted` (column term) that the vocabulary of `values` (column value) has.

    A term is = and a word, or a piece, in lower case.  Every value is read.
    While the wanted terms are few they are broadcast and the values are
    filtered before the shuffle; otherwise all terms are shuffled.  Both ways
    give the same rows.
    """
    few = wanted.limit(MOST_BROADCAST + 1).collect()
    only = frozenset(r.term for r in few) if len(few) <= MOST_BROADCAST else None
    if only is not None and not only:
        return wanted
    shared = values.sparkSession.sparkContext.broadcast(only)

    def terms(column: list) -> list[tuple]:
        keep, seen = shared.value, set()
        for text in column:
            if text:
                seen.update(WORD.findall(text if text.isascii() else plain(text)))
        words = {w.lower() for w in seen if w.isascii() or not _mixed(w)}
        found = {"=" + w for w in words}
        found.update(p for w in words for p in pieces_of(w))
        return [(t,) for t in (found & keep if keep is not None else found)]

    present = map_lists(values.select("value"), terms, "term string").distinct()
    return wanted.join(present, "term", "left_semi")


def known_readings(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, reading) for the mixed words of `words` (column word) of which the vocabulary has a reading; the first one it has."""

    def asked(word: list) -> list[tuple]:
        out = []
        for w in word:
            for i, r in enumerate(readings(w)):
                low = r.lower()
                out.append((w, i, r, "=" + low, True, 1))
                if len(low) >= LEAST_PIECED:
                    parts = set(pieces_of(low))
                    out += [(w, i, r, p, False, len(parts)) for p in parts]
        return out

    terms = cut(map_lists(words.distinct(), asked, "word string, place int, reading string, term string, whole boolean, n int"))
    present = corpus_terms(vocabulary, terms.select("term").distinct())
    met = terms.join(present, "term", "left_semi").groupBy("word", "place", "reading", "whole", "n").agg(F.count(F.lit(1)).alias("met"))
    return met.where(F.col("met") == F.col("n")).groupBy("word").agg(F.min_by("reading", "place").alias("reading"))


def normalise(values: DataFrame, vocabulary: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One form of writing for `values`, a table with the column `value` and key columns `keep`.

    Returns keep..., value, normal: the rows whose form changes.  `vocabulary`
    (column value) is the text whose words decide on mixed words; by default
    `values` itself.  A mixed word that the vocabulary doesn't know stays.
    Null and empty values, and values in the ordinary form, give no row;
    repeated rows are kept; an empty table gives no rows.
    """
    base = values.select(*keep, "value").where(F.col("value").rlike(NEEDS_A_LOOK))
    fields = {f.name: f.dataType.simpleString() for f in base.schema}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keep)
    schema += ", value string, normal string, mixed array<string>"

    def look(*columns: list) -> list[tuple]:
        out = []
        for row in zip(*columns):
            new = plain(row[-1])
            mixed = [w for w in mixed_words(new) if readings(w)]
            if mixed or new != row[-1]:
                out.append((*row, new, mixed))
        return out

    looked = cut(map_lists(base, look, schema))
    sure = looked.where(F.size("mixed") == 0).drop("mixed")
    open_ = looked.where(F.size("mixed") > 0).withColumn("row", F.xxhash64(*keep, "value"))
    pairs = open_.select("row", F.explode("mixed").alias("word")).distinct()
    known = known_readings(pairs.select("word"), vocabulary if vocabulary is not None else values)
    approved = pairs.join(known, "word").groupBy("row").agg(
        F.map_from_entries(F.collect_set(F.struct("word", "reading"))).alias("approved")
    )

    def finish(*columns: list) -> list[tuple]:
        out = []
        for *row, normal, approved in zip(*columns):
            new = replace_words(normal, dict(approved)) if approved else normal
            if new != row[-1]:
                out.append((*row, new))
        return out

    settled = map_lists(
        open_.join(approved, "row", "left").select(*keep, "value", "normal", "approved"),
        finish,
        ", ".join(f"`{k}` {fields[k]}" for k in keep) + ", value string, normal string",
    )
    return sure.unionByName(settled)
