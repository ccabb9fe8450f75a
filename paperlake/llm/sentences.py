"""Sentence boundaries across languages and scripts.

What ends a sentence is learned per language from the whole corpus, without
labels.  A first pass counts, per Arrow batch, how often every word stands with
and without a period, what follows it, and what begins after a sure sentence
end.  The counts are summed and decided upon in the cluster:

- abbreviations: log-likelihood ratio of a word and its period, scaled by
  length, inner periods and the share of its uses without one, unless mostly a
  new sentence follows;
- sentence starters: log-likelihood ratio of a word and the place after a sure
  sentence end; for scripts without case, of its first characters there
  against the place after a quotation or after foreign letters;
- collocations: log-likelihood ratio of a number or initial with its period and
  the capitalised word after it;
- whether a number with a period is an ordinal.

A second pass classifies every mark with these.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.glyphs import CYRILLIC_LATIN, INVISIBLE, SPACES, WORD, one_script
from paperlake.llm.inputs import map_lists
from paperlake.llm.likelihood import dunning, log_likelihood
from paperlake.llm.words import language
from paperlake.session import cut

CLOSERS = "\"'”’»)]）」』】›"
OPENERS = "\"'“‘«([（「『【„‹¿¡"
_MARK = re.compile(f"(\\.{{2,}}|[.!?…。！？।॥‽]+)([{re.escape(CLOSERS)}]*(?: »)?)")
_BEFORE = re.compile(r"[^\s\"'“”„«»()\[\]（）「」]+$")
_NEXT = re.compile(f"[{re.escape(OPENERS)} ]*([^\\W_]+|.)", re.S)
_LETTERS = re.compile(r"[^\W\d_]+")
_DOTTED = re.compile(r"[^\W\d_]+(?:\.[^\W\d_]+)*")
_SURE_END = re.compile(f"(?:[a-zß-öø-ÿа-яё]{{4,}}[.!?]|[!?])[{re.escape(CLOSERS)}]*$")
_PARAGRAPH = re.compile(r"\n\s*\n")
_AROUND = OPENERS + CLOSERS + ",;:!?…"
_SPACE = re.compile(r"\s*")
_ODD = re.compile(f"[{INVISIBLE}{SPACES}！-～]|[̀-ͯ]")
_THAI_GAP = re.compile(r"(\S)(\s+)(?=[\u0e00-\u0e7f])")
_THAI = re.compile(r"[\u0e00-\u0e7f]")

#: Scripts without case, where marks of their own end sentences.
CASELESS = {"zh": "。！？", "ja": "。！？", "hi": "।॥?!", "th": "!?"}
#: Characters that stand for what begins after a mark or gap; otherwise a word does.
PREFIX = {"zh": 1, "ja": 1, "th": 3}

# Thresholds of the classifiers.
ABBREVIATION = 0.3  # scaled log-likelihood ratio of a word and its period
WITHOUT = 100  # uses of a word among which those without a period count against it
STARTER = 30.0  # log-likelihood ratio of a word and the place after a sentence end
COLLOCATION = 7.88  # log-likelihood ratio of a number or initial and the word after it,
LEAST_TIMES = 5  # which stand together so often at least
ENDS_ANYWAY = 0.85  # share of a new sentence following, from which a word is no abbreviation
INSIDE = 5  # how much likelier a beginning must be inside sentences than after their ends to begin none
MAY_CLOSE = 0.2  # the same, from which an abbreviation may end a sentence
#: Learned words up to this number are broadcast (some 20 MB at most); more are joined to the texts that hold them.
MOST_BROADCAST = 200_000


class Model(NamedTuple):
    abbreviations: frozenset = frozenset()
    numeric: frozenset = frozenset()  # abbreviations that a number follows
    closing: frozenset = frozenset()  # abbreviations that may end a sentence
    starters: frozenset = frozenset()
    collocations: frozenset = frozenset()  # a number (##) or initial, a space, and the word after it
    ordinals: frozenset = frozenset()  # ## if a number with a period is one


def model_of(words: list[tuple[str, str]]) -> Model:
    """The model of learned words (what, word)."""
    kinds: dict[str, set[str]] = defaultdict(set)
    for what, word in words:
        kinds[what].add(word)
    return Model(*(frozenset(kinds[f]) for f in Model._fields))


def clean(text: str) -> tuple[str, list[int] | None]:
    """The text without invisible characters and with ordinary spaces and letters, and where each character was."""
    mixed = not text.isascii() and any(c in CYRILLIC_LATIN for c in text) and any("a" <= c <= "z" for c in text)
    if mixed:
        text = WORD.sub(lambda m: one_script(m.group()) or m.group(), text)
    if not _ODD.search(text):
        return text, None
    out, at = [], []
    for i, c in enumerate(text):
        if c in INVISIBLE or "̀" <= c <= "ͯ":
            continue
        if c in SPACES:
            c = " "
        elif "Ａ" <= c <= "ｚ":
            c = chr(ord(c) - 0xFEE0)
        out.append(c)
        at.append(i)
    at.append(len(text))
    return "".join(out), at


class Candidate(NamedTuple):
    end: int  # after the closing marks
    mark: str
    closers: str
    before: str  # the token that the mark ends, without it
    gap: str  # white space after
    after: str  # next word, or first character
    opened: bool  # the next word follows an opening mark


def candidates(text: str) -> list[Candidate]:
    out = []
    for m in _MARK.finditer(text):
        end = m.end()
        gap = _SPACE.match(text, end).group()
        # What is learned is no longer than this.
        b = _BEFORE.search(text, max(0, m.start() - 40), m.start())
        n = _NEXT.match(text, end + len(gap))
        after = n.group(1) if n else ""
        opened = bool(n) and n.start(1) > n.start()
        out.append(Candidate(end, m.group(1), m.group(2), b.group() if b else "", gap, after, opened))
    return out


def _starts_like(after: str) -> str:
    c = after[:1]
    if not c:
        return "end"
    if c.isupper() or c.islower() and len(after) > 2 and after[1].isupper():
        return "upper"
    return "lower" if c.islower() else "digit" if c.isdigit() else "letter" if c.isalpha() else "sign"


def is_number(token: str) -> bool:
    return token[:1].isdigit() and token[-1:].isdigit()


def _beginning(text: str, lang: str, c: Candidate) -> str:
    """What stands for the beginning of the text after a mark; foreign letters and digits stand for their kind."""
    width = PREFIX.get(lang)
    if not width:
        return c.after
    at = c.end + len(c.gap)
    first = text[at]
    if first.isascii() and first.isalnum():
        return "A" if first.isupper() else "0" if first.isdigit() else "a"
    return text[at : at + width]


def learn_from(text: str, lang: str, counts: dict[tuple[str, str], Counter]) -> None:
    """Add the evidence of one text; keys are (language, kind of count).  Tokens are read by settled()."""
    text, _ = clean(text)
    if lang == "th":
        for m in _THAI_GAP.finditer(text):
            p = text[m.end() : m.end() + PREFIX["th"]]
            counts[lang, "start" if _THAI.match(m.group(1)) else "inside"][p] += 1
        return
    if lang in CASELESS:
        own = CASELESS[lang]
        for c in candidates(text):
            if c.mark[0] in own and c.after:
                counts[lang, "inside" if c.closers else "start"][_beginning(text, lang, c)] += 1
        return
    for paragraph in _PARAGRAPH.split(text) if "\n" in text else (text,):
        # A word broken at the end of a line is put together with its hyphen, and so is no word.
        tokens = paragraph.replace("-\n", "-").split()
        if tokens:
            counts[lang, "token"].update(tokens)
            counts[lang, "first"][tokens[0]] += 1
            counts[lang, "next"].update([(a, b) for a, b in zip(tokens, tokens[1:]) if a[-1] in _MAY_END])


_MAY_END = frozenset(".!?" + CLOSERS)


def _word_after(token: str) -> str:
    m = _LETTERS.match(token.lstrip(OPENERS))
    return m.group() if m else ""


def _abbreviated(token: str) -> str | None:
    """The word of a token that ends in one period, in lower case; ## for a number; None for others."""
    core = token.lstrip(OPENERS)
    if len(core) < 2 or core[-1] != "." or core[-2] == "." or len(core) > 41:
        return None
    core = core[:-1]
    if core[0].isdigit() and is_number(core):
        return "##"
    return core.lower() if _DOTTED.fullmatch(core) else None


def settled(counts: dict[tuple[str, str], Counter]) -> list[tuple[str, str, str, int]]:
    """(language, kind, word, n) of a batch, from the counts of its distinct tokens."""
    out: dict[tuple[str, str], Counter] = defaultdict(Counter)
    for (lang, kind), count in counts.items():
        if lang in CASELESS:
            out[lang, kind].update(count)
        elif kind == "token":
            out[lang, "total"]["tokens"] += count.total()
            for token, n in count.items():
                word = _abbreviated(token)
                out[lang, "total"]["periods"] += n * token.endswith(".")
                core = token.strip(_AROUND)
                if word and word != "##":
                    out[lang, "period"][word] += n
                elif len(core) <= 40 and _LETTERS.fullmatch(core):
                    out[lang, "word"][core.lower()] += n
                if core[:1].isupper():
                    out[lang, "upper"][_LETTERS.match(core).group()] += n
        elif kind == "first":
            for token, n in count.items():
                out[lang, "start"][_word_after(token)] += n
        else:
            for (token, after), n in count.items():
                if _SURE_END.search(token):
                    out[lang, "start"][_word_after(after)] += n
                if word := _abbreviated(token):
                    begin = _word_after(after) or after.lstrip(OPENERS)
                    like = _starts_like(begin)
                    if like != "end":
                        out[lang, "pair"][word + " " + (begin if like == "upper" else "\n" + like)] += n
    for (lang, kind), count in list(out.items()):
        if kind == "start" and lang not in CASELESS:
            out[lang, "total"]["starts"] += count.total()
            out[lang, kind] = Counter({w: n for w, n in count.items() if w[:1].isupper()})
        elif kind == "upper":
            out[lang, "total"]["uppers"] += count.total()
    return [(lang, kind, w, n) for (lang, kind), x in out.items() for w, n in x.items()]


def learn(texts: DataFrame, column: str = "content") -> DataFrame:
    """(lang, what, word): what the texts of a column show; `what` is a field of Model.

    Every text counts, and no word is left out for being rare.  Counts are
    summed and decided upon in the cluster; decisions rest on rates and on
    significance, which more data only make surer.
    """

    def rows(content: list) -> list[tuple]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        for c in content:
            if c:
                learn_from(c, language(c), counts)
        return settled(counts)

    summed = cut(
        map_lists(texts.select(F.col(column).alias("content")).where(F.length("content") > 0), rows, "lang string, kind string, word string, n bigint")
        .groupBy("lang", "kind", "word")
        .agg(F.sum("n").alias("n"))
    )
    kind = lambda k, n: summed.where(F.col("kind") == k).select("lang", "word", F.col("n").alias(n))
    # One row for each language.
    totals = F.broadcast(
        summed.where(F.col("kind") == "total")
        .groupBy("lang")
        .agg(*(F.coalesce(F.sum(F.when(F.col("word") == w, F.col("n"))), F.lit(0)).alias(f"n_{w}") for w in ("tokens", "periods", "starts", "uppers")))
    )
    caseless = F.col("lang").isin(*CASELESS)
    at = F.broadcast(
        summed.where(caseless)
        .groupBy("lang")
        .agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in ("start", "inside")))
    )
    begun = (
        kind("start", "k").where(caseless).join(kind("inside", "j"), ["lang", "word"], "left").join(at, "lang")
        .where(INSIDE * F.col("k") / F.col("n_start") > F.coalesce("j", F.lit(0)) / F.greatest("n_inside", F.lit(1)))
        .select("lang", "word")
    )
    upper = kind("upper", "u")
    surprise = dunning(F.col("k"), F.col("n_starts"), F.greatest(F.col("u") - F.col("k"), F.lit(0)), F.greatest(F.col("n_uppers") - F.col("n_starts"), F.lit(1)))
    starters = cut(
        kind("start", "k").where(~caseless).join(upper, ["lang", "word"], "left").na.fill(0, ["u"]).join(totals, "lang").where(surprise > STARTER).select("lang", "word")
        .unionByName(begun)
    )
    pairs = kind("pair", "k").select("lang", F.substring_index("word", " ", 1).alias("first"), F.substring_index("word", " ", -1).alias("after"), "k")
    pairs = pairs.join(starters.select("lang", F.col("word").alias("after"), F.lit(True).alias("starts")), ["lang", "after"], "left")
    classed = F.when(F.col("starts"), "new").when(F.col("after").startswith("\n"), F.substr("after", F.lit(2))).otherwise("other")
    one = lambda c: F.coalesce(F.sum(F.when(classed == c, F.col("k"))), F.lit(0)).alias(c)
    follows = pairs.groupBy("lang", "first").agg(F.sum("k").alias("n"), one("new"), one("digit"), one("other"))
    n_first = follows.select("lang", "first", F.col("n").alias("n_first"))
    told = (
        kind("period", "k").join(kind("word", "plain"), ["lang", "word"], "left")
        .join(follows.withColumnRenamed("first", "word"), ["lang", "word"], "left")
        .na.fill(0, ["plain", "n", "new", "digit", "other"])
        .join(totals, "lang")
    )
    total = F.col("k") + F.col("plain")
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.length("word") - letters + 1
    ratio = 2 * (log_likelihood(F.col("k"), total, F.lit(0.99)) - log_likelihood(F.col("k"), total, F.col("n_periods") / F.col("n_tokens")))
    score = ratio * inner * F.exp(-letters - F.log(letters) * WITHOUT * F.col("plain") / total)
    numeric = (F.col("n") >= 5) & (F.col("digit") > 0.5 * F.col("n"))
    short = ~numeric & (score >= ABBREVIATION) & (F.col("new") < ENDS_ANYWAY * F.col("n"))
    closing = short & (F.col("new") > MAY_CLOSE * F.col("n"))
    marks = F.array_compact(F.array(F.when(numeric, "numeric"), F.when(short, "abbreviations"), F.when(closing, "closing")))
    together = dunning(F.col("k"), F.col("n_first"), F.greatest(F.col("u") - F.col("k"), F.lit(0)), F.greatest(F.col("n_uppers") - F.col("n_first"), F.lit(1)))
    collocations = (
        pairs.where((F.length("first") == 1) | (F.col("first") == "##")).where(F.col("starts").isNull() & ~F.col("after").startswith("\n"))
        .join(n_first, ["lang", "first"])
        .join(upper.withColumnRenamed("word", "after"), ["lang", "after"])
        .join(totals, "lang")
        .where((F.col("k") >= LEAST_TIMES) & (together > COLLOCATION))
        .select("lang", F.lit("collocations").alias("what"), F.concat_ws(" ", "first", "after").alias("word"))
    )
    return cut(
        starters.select("lang", F.lit("starters").alias("what"), "word")
        .unionByName(told.select("lang", F.explode(marks).alias("what"), "word"))
        .unionByName(collocations)
        .unionByName(
            follows.where((F.col("first") == "##") & (F.col("other") > F.col("new"))).select("lang", F.lit("ordinals").alias("what"), F.col("first").alias("word"))
        )
    )


def _ends(c: Candidate, lang: str, model: Model, text: str) -> bool:
    if not c.after or "\n\n" in c.gap:
        return True
    if lang in CASELESS:
        if c.mark[0] not in CASELESS[lang]:
            return False
        if not c.closers:
            return True
        return _beginning(text, lang, c) in model.starters
    like = _starts_like(c.after)
    if c.mark[0] in "!?" or c.mark[0] in "…" or len(c.mark) > 1:
        return like in ("upper", "digit") and (bool(c.gap) or c.after in model.starters) or c.opened and like != "lower"
    if not c.gap:
        # No space after the period: a new sentence only if a known one begins.
        sure = c.before[-1:].isalnum() and len(c.before) > 1 or c.before[-1:] in "]%" or bool(c.closers)
        return sure and like == "upper" and c.after in model.starters and c.before.lower() not in model.abbreviations
    if like == "lower":
        return False
    token = c.before.lower()
    if "." in token and token not in model.abbreviations:
        # The first word of a sentence that no space parts from the one before.
        token = token.rpartition(".")[2]
    if is_number(c.before):
        return like != "upper" or c.after in model.starters or not model.ordinals and "## " + c.after not in model.collocations
    if len(c.before) == 1 and c.before.isupper() and not c.closers:
        # An initial; a letter such as that of vitamin C ends a sentence where a known one begins.
        return c.after in model.starters and token + " " + c.after not in model.collocations
    if token in model.numeric and not c.closers and like == "digit":
        return False
    if (token in model.abbreviations or token in model.numeric) and not c.closers:
        return c.after in model.starters or like == "digit" and token in model.closing
    return like in ("upper", "digit", "letter") or c.opened


def sentence_ends(text: str, lang: str, model: Model) -> list[int]:
    """Where the sentences of a text end, after their closing marks.  A text of white space has none."""
    body, at = clean(text)
    ends: set[int] = set()
    for c in candidates(body):
        if _ends(c, lang, model, body):
            ends.add(c.end)
    if lang == "th":
        for m in _THAI_GAP.finditer(body):
            starts = body[m.end() : m.end() + PREFIX["th"]] in model.starters
            if starts or "\n\n" in m.group(2):
                ends.add(m.end(1))
    for m in re.finditer(r"\S(?=\s*\n\s*\n)", body):
        ends.add(m.end())
    last = len(body.rstrip())
    ends = {e for e in ends if e < last}
    if last:
        ends.add(last)
    out = sorted(ends)
    return out if at is None else [at[e - 1] + 1 if e else 0 for e in out]


def lookups(text: str, lang: str) -> set[str]:
    """Every word that _ends() may ask a model for in a text."""
    body, _ = clean(text)
    out = {"##"}
    for c in candidates(body):
        token = c.before.lower()
        out.update((token, token.rpartition(".")[2], c.after, "## " + c.after, token + " " + c.after))
        if lang in CASELESS and c.after:
            out.add(_beginning(body, lang, c))
    if lang == "th":
        out.update(body[m.end() : m.end() + PREFIX["th"]] for m in _THAI_GAP.finditer(body))
    return out


def sentences(texts: DataFrame, learned: DataFrame, keys: tuple[str, ...], column: str = "content") -> DataFrame:
    """keys..., sentence_no, start_char, end_char, sentence for every sentence of every text.

    `learned` comes from learn().  While it has few words it is broadcast;
    otherwise each text is joined with those it holds.  Both ways give the same
    rows.  Offsets are in code points.  Null, empty and blank texts give no
    rows; a text without any mark is one sentence, however long; repeated rows
    give repeated rows; other columns are ignored.
    """
    base = texts.select(*keys, F.col(column).alias("content")).where(F.length("content") > 0)
    types = {f.name: f.dataType.simpleString() for f in base.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", sentence_no int, start_char int, end_char int, sentence string"

    def divided(key: list, text: str, lang: str, model: Model) -> list[tuple]:
        out, start = [], 0
        for i, end in enumerate(sentence_ends(text, lang, model)):
            while start < end and text[start].isspace():
                start += 1
            out.append((*key, i, start, end, text[start:end]))
            start = end
        return out

    few = learned.limit(MOST_BROADCAST + 1).collect()
    if len(few) <= MOST_BROADCAST:
        of: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for r in few:
            of[r.lang].append((r.what, r.word))
        shared = texts.sparkSession.sparkContext.broadcast({lang: model_of(words) for lang, words in of.items()})
        nothing = Model()

        def rows(*columns: list) -> list[tuple]:
            out = []
            for *key, text in zip(*columns):
                lang = language(text)
                out += divided(key, text, lang, shared.value.get(lang, nothing))
            return out

        return map_lists(base, rows, schema)

    hashed = base.withColumn("text_hash", F.sha2("content", 256))
    one = hashed.select("text_hash", "content").dropDuplicates(["text_hash"])

    def wanted(text_hash: list, content: list) -> list[tuple]:
        return [(h, lang, w) for h, c in zip(text_hash, content) for lang in (language(c),) for w in lookups(c, lang)]

    held = (
        map_lists(one, wanted, "text_hash string, lang string, word string")
        .join(learned, ["lang", "word"])
        .groupBy("text_hash")
        .agg(F.collect_list(F.struct("what", "word")).alias("held"))
    )

    def own(*columns: list) -> list[tuple]:
        out = []
        for *key, text, words in zip(*columns):
            out += divided(key, text, language(text), model_of([(w["what"], w["word"]) for w in words or ()]))
        return out

    return map_lists(hashed.join(held, "text_hash", "left").select(*keys, "content", "held"), own, schema)
