"""Variant spellings of names typed by people.

Names are brought to one form of writing, parsed into given names, initials and
surname (or the words of an organisation), and reduced to distinct keys.

The words of a field (given names, surnames) are an index of suffixes: every
suffix from a least length on is an entry.  So is what is left of a word
without a letter or two, where all words meet that are alike enough to be
linked.  A suffix that too many words share is therefore left to these; what is
left of too many words is refined with the other field of the keys: words that
may be linked must have partners in common, so they still meet.  Words that
meet are compared by the ratio of their longest common subsequence.

What the ratio can't tell is told by the corpus: a spelling is a variant of
another one if it stands mostly with partners that the other has as well.
`Marta` and `Maria` are alike, but few of their surnames are the same; nearly
every surname of `Mraia` is one of `Maria`.  So are nicknames found that have
nothing in common with the full name.  These shares do not depend on how large
the corpus is.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.glyphs import repair
from paperlake.llm.graph import components
from paperlake.llm.inputs import map_lists
from paperlake.llm.likelihood import dunning
from paperlake.session import cut

LEAST_SUFFIX = 4
#: Words in a block from which it is refined with the other field.
COMMON_BLOCK = 20
#: Least ratio of the longest common subsequence of two spellings of a given name, a surname, a word of an organisation.
#: A given name has many partners, which tell variants well, so that one letter of three may differ; a surname has few.
GIVEN_RATIO = 0.66
SURNAME_RATIO = 0.83
ORGANISATION_RATIO = 0.75
#: Letters of either word outside the common subsequence, at most.
MOST_ODD = 2
#: Least share of a spelling's partners that a more frequent spelling must have too.
LEAST_SHARED = 0.5
#: What a nickname that is not like the name must have: so many surnames, nearly all of them with the name too (share
#: and log-likelihood ratio), and fewer than this share of the name's.
LEAST_PARTNERS = 3
NICKNAME_SHARED = 0.8
NICKNAME = 20.0
NICKNAME_USES = 0.5
#: Letters of the longest word that is compared; a longer one is linked only where it is equal.
LONGEST = 40

# Words that come with a name and are no part of it.
TITLES = frozenset("dr prof professor mr mrs ms mx sir phd md ed eds editor jr sr dipl ing msc bsc".split())
SMALL_WORDS = frozenset("the of and for at in".split())
# Words of organisations with their abbreviations.
ORGANISATION = {
    "grp": "group", "lab": "laboratory", "labs": "laboratory", "laboratories": "laboratory", "inst": "institute",
    "cons": "consortium", "dept": "department", "univ": "university", "ctr": "center", "centre": "center",
    "soc": "society", "assoc": "association", "comm": "committee", "netw": "network",
}
ORGANISATION_WORDS = frozenset(ORGANISATION.values()) | frozenset(
    "team school college foundation initiative project council academy division unit company corporation agency".split()
)
# Short forms of given names that are neither beginning nor end of the full form, for corpora too small to learn them from.
NICKNAMES = {
    "beppe": "giuseppe", "bill": "william", "bob": "robert", "dick": "richard", "dima": "dmitri", "hal": "henry",
    "jack": "john", "jim": "james", "joe": "joseph", "joey": "joseph", "kate": "katherine", "katie": "katherine", "liz": "elizabeth", "maggie": "margaret",
    "meg": "margaret", "mike": "michael", "misha": "mikhail", "paco": "francisco", "peggy": "margaret", "sasha": "alexander",
    "ted": "theodore", "vova": "vladimir", "zhenya": "yevgenia", "ibro": "ibrahim", "ulla": "ursula", "lex": "alexander",
    "pepe": "jose", "nacho": "ignacio", "lola": "dolores", "kolya": "nikolai", "vanya": "ivan", "gosia": "malgorzata",
    "bella": "isabella", "becky": "rebecca", "harry": "henry", "betty": "elizabeth", "peg": "margaret", "molly": "mary",
}

_AFFIX = re.compile(r"[*†‡§¶#]+|\((?:eds?\.?|editors?)\)", re.I)
_TOKEN = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_STROKES = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "đ": "d", "ı": "i", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d"})


def fold(text: str) -> str:
    """Lower case, one script, without accents."""
    text = repair(text).lower().translate(_STROKES)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def parse(name: str) -> tuple[str, list[str], list[str], str | None]:
    """(kind, full words in order, initials, surname if a comma shows it) of a name; kind is person or organisation."""
    text = _AFFIX.sub(" ", fold(name))
    words = _TOKEN.findall(text)
    plain = [ORGANISATION.get(w, w) for w in words]
    if len(words) > 1 and (
        any(w in ORGANISATION_WORDS for w in plain)
        # People rarely have four words, and three are needed before a misspelt word shows an organisation.
        or len(words) > 2
        and "," not in text
        and any(len(w) > 5 and any(alike(w, o, ORGANISATION_RATIO) for o in ORGANISATION_WORDS) for w in plain)
    ):
        return "organisation", [w for w in plain if w not in SMALL_WORDS], [], None
    before, comma, after = text.partition(",")
    surname = None
    if comma and (b := [w for w in _TOKEN.findall(before) if w not in TITLES]) and [w for w in _TOKEN.findall(after) if w not in TITLES]:
        surname = "-".join(b)
        words = _TOKEN.findall(after)
    words = [w for w in words if w not in TITLES]
    full = [w for w in words if len(w.replace("-", "")) > 1 and not re.fullmatch(r"\w(?:-\w)+", w)]
    initials = [c for w in words if w not in full for c in w.replace("-", "")]
    return "person", full, initials, surname


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by the bits of one integer."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & at.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def alike(a: str, b: str, least: float) -> bool:
    """True if two different words are alike enough to be spellings of one."""
    m, n = len(a), len(b)
    if a == b or abs(m - n) > MOST_ODD or max(m, n) > LONGEST:
        return False
    same = common_subsequence(a, b)
    return 2 * same >= least * (m + n) and m - same <= MOST_ODD and n - same <= MOST_ODD


def short_form(a: str, b: str) -> bool:
    """True if one given name is a nickname, or the beginning or end, of the other."""
    a, b = sorted((a, b), key=len)
    if NICKNAMES.get(a) == b:
        return True
    return len(a) >= 3 and len(b) >= len(a) + 2 and len(b) <= LONGEST and (b.startswith(stem_of(a)) or b.endswith(a))


def stem_of(name: str) -> str:
    """A given name without the vowel that short forms end in."""
    return name[:-1] if len(name) > 3 and name[-1] in "iey" else name


def initials_fit(given: str, initials: str, other_initials: str) -> bool:
    """True if the initials of a name without a full given name begin the other's given name and initials."""
    letters = "".join(p[0] for p in given.split("-") if p)
    rest = letters + other_initials
    if rest.startswith(initials) or initials.startswith(rest):
        return True
    # The second part of a double given name may be left out.
    return (letters[:1] + other_initials).startswith(initials) and bool(initials)


def same_organisation(a: list[str], b: list[str]) -> bool:
    """True if the words match one to one, as equal, abbreviated, or with one of them misspelt."""
    if len(a) != len(b) or len(a) < 2:
        return False
    rest, slips = list(b), 0
    for w in sorted(a, key=len, reverse=True):
        if w in rest:
            rest.remove(w)
            continue
        for v in rest:
            short, long = sorted((w, v), key=len)
            if len(short) >= 3 and len(long) > len(short) + 1 and long.startswith(short):
                break
        else:
            for v in rest:
                if alike(w, v, ORGANISATION_RATIO):
                    slips += 1
                    break
            else:
                return False
        rest.remove(v)
        if slips > 1:
            return False
    return True


def keyed_names(names: DataFrame) -> DataFrame:
    """(name, kind, given, initials, surname, words) for distinct names (column name).

    Without a comma the surname is the last word, unless names with a comma
    show that the first word is mostly a surname and the last mostly a given
    name.  Where they show neither, a word that stands with more than three
    times as many others as the other one does is the given name.
    """

    def rows(name: list) -> list[tuple]:
        return [(n, *parse(n)) for n in name]

    parsed = cut(
        map_lists(
            names.select("name").where(F.length(F.trim("name")) > 0).distinct(),
            rows,
            "name string, kind string, words array<string>, initials array<string>, surname string",
        )
    )
    two = parsed.where((F.col("kind") == "person") & F.col("surname").isNull() & (F.size("words") >= 2))
    ends = two.select(F.get("words", F.lit(0)).alias("first"), F.element_at("words", -1).alias("last")).distinct()
    shown = parsed.where((F.col("kind") == "person") & F.col("surname").isNotNull() & (F.size("words") >= 1)).select(
        F.get("words", F.lit(0)).alias("first"), F.col("surname").alias("last")
    )
    uses = lambda df, as_given, as_surname: df.distinct().select(
        F.explode(
            F.array(
                F.struct(F.col("first").alias("word"), as_given.alias("given"), F.lit(0).alias("surname"), F.lit(1).alias("partners")),
                F.struct(F.col("last").alias("word"), F.lit(0).alias("given"), as_surname.alias("surname"), F.lit(1).alias("partners")),
            )
        ).alias("u")
    ).select("u.*")
    one, none = F.lit(1), F.lit(0)
    words = (
        uses(shown, one, one)
        .unionByName(uses(ends, none, none))
        .groupBy("word")
        .agg(F.sum("given").alias("given"), F.sum("surname").alias("surname"), F.sum("partners").alias("partners"))
    )
    role = lambda end: words.select(F.col("word").alias(end), F.struct("given", "surname", "partners").alias(f"of_{end}"))
    known = lambda end: F.col(f"of_{end}.given") + F.col(f"of_{end}.surname") > 0
    by_comma = (F.col("of_last.given") > F.col("of_last.surname")) & (F.col("of_first.surname") >= F.col("of_first.given")) | (
        F.col("of_first.surname") > F.col("of_first.given")
    ) & (F.col("of_last.given") >= F.col("of_last.surname"))
    by_partners = F.col("of_last.partners") > 3 * F.col("of_first.partners") + 3
    swapped = (
        ends.join(role("first"), "first")
        .join(role("last"), "last")
        .where(F.when(known("first") | known("last"), by_comma).otherwise(by_partners))
        .select("first", "last", F.lit(True).alias("swapped"))
    )
    person = (
        parsed.where(F.col("kind") == "person")
        .withColumn("first", F.when(F.col("surname").isNull() & (F.size("words") >= 2), F.get("words", F.lit(0))))
        .withColumn("last", F.when(F.col("surname").isNull() & (F.size("words") >= 2), F.element_at("words", -1)))
        .join(swapped, ["first", "last"], "left")
    )
    n = F.size("words")
    given_words = (
        F.when(F.col("surname").isNotNull(), F.col("words"))
        .when(n < 2, F.array().cast("array<string>"))
        .when(F.col("swapped"), F.slice("words", F.lit(2), n - 1))
        .otherwise(F.slice("words", F.lit(1), n - 1))
    )
    surname = F.coalesce(
        "surname", F.when(n == 0, F.array_join("initials", "")).when(F.col("swapped"), F.col("first")).otherwise(F.element_at("words", -1))
    )
    people = person.select(
        "name",
        "kind",
        F.array_join(given_words, "-").alias("given"),
        F.array_join("initials", "").alias("initials"),
        surname.alias("surname"),
        F.array().cast("array<string>").alias("words"),
    ).where(F.col("surname") != "")
    groups = parsed.where(F.col("kind") == "organisation").select(
        "name", "kind", F.lit("").alias("given"), F.lit("").alias("initials"), F.lit("").alias("surname"), F.array_sort("words").alias("words")
    )
    return people.unionByName(groups)


def _suffixes(word) -> F.Column:
    """All suffixes of a word from the least length on; the word itself if it is shorter."""
    n = F.length(word)
    cuts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - F.lit(LEAST_SUFFIX - 1)))
    return F.transform(cuts, lambda i: F.substr(word, i))


def remains(word: str, least: float) -> set[str]:
    """What is left of a word without some of its letters: two words that are alike have one of these in common."""
    out = {word}
    level = {word}
    n = len(word)
    for d in range(1, MOST_ODD + 1):
        if 2 * (n - d) < least * (2 * n - d):
            break
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return out


def _met(suffixes: DataFrame, left: DataFrame, refined: DataFrame) -> DataFrame:
    """(a, b), a < b, for items that share a block of `suffixes` or of `left` (both item, block).

    A block of more than COMMON_BLOCK items is divided by `refined` (item, by),
    the values of the items' other field, if it is of `left`.  As a suffix it
    isn't gone through, since all of its pairs that count meet in `left`; their
    number would grow with the square of the corpus.
    """
    entries = suffixes.withColumn("whole", F.lit(False)).unionByName(left.withColumn("whole", F.lit(True)))
    size = entries.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    sized = cut(entries.join(size, "block").where(F.col("whole") | (F.col("size") <= COMMON_BLOCK)))
    small = sized.where(F.col("size") <= COMMON_BLOCK).select("item", "block")
    common = sized.where(F.col("size") > COMMON_BLOCK).join(refined, "item").select("item", F.concat_ws("|", "block", "by").alias("block"))
    every = small.unionByName(common)
    x, y = every.select(F.col("item").alias("a"), "block"), every.select(F.col("item").alias("b"), "block")
    return x.join(y, "block").where(F.col("a") < F.col("b")).select("a", "b").distinct()


def _alike_words(pairs: DataFrame, least: float) -> DataFrame:
    """The uses of two words of a field by their partners: (a, b, n_a, n_b, shared); a is the rarer word."""
    used = cut(pairs.select("word", "partner").distinct())
    count = used.groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def index(word: list) -> list[tuple]:
        return [(w, "-" + r) for w in word for r in remains(w, least)]

    words = count.where(F.length("word").between(2, LONGEST)).select("word")
    suffixes = words.select(F.col("word").alias("item"), F.explode(_suffixes(F.col("word"))).alias("block"))
    left = map_lists(words, index, "item string, block string")
    refined = used.select(F.col("word").alias("item"), F.col("partner").alias("by"))

    def compare(a: list, b: list) -> list[tuple]:
        return [(x, y) for x, y in zip(a, b) if alike(x, y, least)]

    met = _met(suffixes, left, refined).where(F.abs(F.length("a") - F.length("b")) <= MOST_ODD)
    return _shared(map_lists(met, compare, "a string, b string"), used, count)


def _shared(pairs: DataFrame, used: DataFrame, count: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, shared) for pairs of words, the rarer one as a: how many partners of a stand with b too."""
    n = lambda end: count.select(F.col("word").alias(end), F.col("n").alias(f"n_{end}"))
    swap = F.struct("n_b", "b") < F.struct("n_a", "a")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
    ordered = (
        pairs.join(n("a"), "a").join(n("b"), "b").select(either("a", "b"), either("b", "a"), either("n_a", "n_b"), either("n_b", "n_a"))
    )
    return (
        ordered.join(used.select(F.col("word").alias("a"), "partner"), "a")
        .join(used.select(F.col("word").alias("b"), "partner"), ["b", "partner"])
        .groupBy("a", "b", "n_a", "n_b")
        .agg(F.count(F.lit(1)).alias("shared"))
    )


def _given_forms(pairs: DataFrame) -> DataFrame:
    """The uses of two given names that may stand for each other without being alike: (a, b, n_a, n_b, shared, learned).

    Short forms meet the names they begin or end.  Any two meet in some of the
    surnames of the rarer one, those with the fewest given names and just so
    many that a name that shares NICKNAME_SHARED of them shares one of these:
    no pair is missed, and very frequent surnames are not gone through.
    """
    used = cut(pairs.select("word", "partner").distinct())
    count = used.groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def ends(word: list) -> list[tuple]:
        out = []
        for w in word:
            if 3 <= len(w) <= LONGEST:
                out += [(w, 1, "b" + stem_of(w)), (w, 1, "e" + w)]
                out += [(w, 2, "b" + w[:i]) for i in range(3, len(w) + 1)] + [(w, 2, "e" + w[-i:]) for i in range(3, len(w) - 1)]
            out += [(w, 1, "n" + w)] + ([(NICKNAMES[w], 2, "n" + w)] if w in NICKNAMES else [])
        return out

    entries = cut(map_lists(count.select("word"), ends, "word string, side int, block string"))
    short = (
        entries.where("side = 1").select(F.col("word").alias("a"), "block").join(entries.where("side = 2").select(F.col("word").alias("b"), "block"), "block")
        .where(F.col("a") != F.col("b"))
        .select("a", "b")
        .distinct()
    )

    def compare(a: list, b: list) -> list[tuple]:
        return [(x, y) for x, y in zip(a, b) if short_form(x, y)]

    size = used.groupBy("partner").agg(F.count(F.lit(1)).alias("size"))
    ranked = used.join(size, "partner").join(count, "word").where(F.col("n") >= LEAST_PARTNERS)
    place = F.row_number().over(Window.partitionBy("word").orderBy("size", "partner"))
    few = ranked.withColumn("place", place).where(F.col("place") <= F.floor(F.col("n") * (1 - NICKNAME_SHARED)) + 1).select(F.col("word").alias("a"), "partner", F.col("n").alias("n_a"))
    any_ = (
        few.join(used.select(F.col("word").alias("b"), "partner"), "partner")
        .join(count.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
        .where(F.struct("n_a", "a") < F.struct("n_b", "b"))
        .select("a", "b")
        .distinct()
    )
    known = map_lists(short, compare, "a string, b string").withColumn("learned", F.lit(False))
    every = cut(known.unionByName(any_.withColumn("learned", F.lit(True))).groupBy("a", "b").agg(F.min("learned").alias("learned")))
    flags = every.select("a", "b", "learned").unionByName(every.select(F.col("b").alias("a"), F.col("a").alias("b"), "learned"))
    return _shared(every.select("a", "b"), used, count).join(flags.groupBy("a", "b").agg(F.min("learned").alias("learned")), ["a", "b"])


def variants(pairs: DataFrame, given: bool) -> DataFrame:
    """(a, b): words of a field (word, partner) that spell one; for given names short forms and nicknames too."""
    enough = F.col("shared") >= LEAST_SHARED * F.col("n_a")
    found = _alike_words(pairs, GIVEN_RATIO if given else SURNAME_RATIO).where(enough).select("a", "b")
    if given:
        forms = _given_forms(pairs)
        total = pairs.select("partner").distinct().agg(F.count(F.lit(1)).alias("total"))
        # One row: the number of surnames.
        surprise = dunning(F.col("shared"), F.col("n_a"), F.col("n_b") - F.col("shared"), F.col("total") - F.col("n_a"))
        nickname = (
            (F.col("n_a") >= LEAST_PARTNERS)
            & (F.col("shared") >= NICKNAME_SHARED * F.col("n_a"))
            & (F.col("n_a") < NICKNAME_USES * F.col("n_b"))
            & (surprise >= NICKNAME)
        )
        forms = forms.crossJoin(F.broadcast(total)).where(enough & (~F.col("learned") | nickname))
        found = found.unionByName(forms.select("a", "b"))
    return found.distinct()


def _organisation_words(words: DataFrame) -> DataFrame:
    """(a, b), either way round, for the words (word) of organisations of which one is an abbreviation or a slip of the other."""

    def index(word: list) -> list[tuple]:
        out = []
        for w in word:
            out += [(w, 1, "b" + w)] + [(w, 2, "b" + w[:i]) for i in range(3, len(w) - 1)]
            if 2 <= len(w) <= LONGEST:
                out += [(w, side, "-" + r) for r in remains(w, ORGANISATION_RATIO) for side in (1, 2)]
        return out

    entries = map_lists(words, index, "word string, side int, block string")
    x, y = (entries.where(F.col("side") == side).select(F.col("word").alias(end), "block") for side, end in ((1, "a"), (2, "b")))
    begun = F.substring("block", 1, 1) == "b"
    met = x.join(y, "block").where((F.col("a") != F.col("b")) & (begun | (F.abs(F.length("a") - F.length("b")) <= MOST_ODD))).select("a", "b", begun.alias("begun")).distinct()

    def compare(a: list, b: list, begun: list) -> list[tuple]:
        return [p for x, y, short in zip(a, b, begun) if short or alike(x, y, ORGANISATION_RATIO) for p in ((x, y), (y, x))]

    return map_lists(met, compare, "a string, b string").distinct()


def _organisation_pairs(keys: DataFrame) -> DataFrame:
    """(a, b), a < b, of the keys of organisations whose words match.

    Two keys differ in a word at least that is abbreviated or misspelt, and if
    one is misspelt in that one.  Their other words are equal or abbreviated,
    so these begin alike.  The key with the rarer of the two words looks for
    the other one: what is gone through are no whole kinds of organisations.
    """
    words = F.col("words")
    begins = lambda words: F.array_join(F.array_sort(F.transform(words, lambda w: F.substring(w, 1, 3))), " ")
    rest = lambda i: F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + 2, F.size(words)))
    groups = keys.where(F.col("kind") == "organisation").select("key", "words")
    used = cut(
        groups.select("key", F.explode(F.transform(words, lambda w, i: F.struct(w.alias("word"), begins(rest(i)).alias("rest")))).alias("u"))
        .select("key", "u.word", "u.rest")
        .distinct()
    )
    count = cut(used.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    n = lambda end: count.select(F.col("word").alias(end), F.col("n").alias(f"n_{end}"))
    related = _organisation_words(count.select("word")).join(n("a"), "a").join(n("b"), "b").where(F.struct("n_a", "a") < F.struct("n_b", "b"))
    met = (
        used.select(F.col("key").alias("x"), F.col("word").alias("a"), "rest").join(related.select("a", "b"), "a")
        .join(used.select(F.col("key").alias("y"), F.col("word").alias("b"), "rest"), ["b", "rest"])
        .where(F.col("x") != F.col("y"))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )

    def compare(a: list, b: list) -> list[tuple]:
        return [(x, y) for x, y in zip(a, b) if same_organisation(x.split("|")[4].split(" "), y.split("|")[4].split(" "))]

    return map_lists(met, compare, "a string, b string")


def linked_keys(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, key) of every name, and (a, b) for keys that name one person or organisation.

    Keys with the same surname and given name are linked unless their initials
    differ; so are keys whose surname or given name is a variant of the other's
    and whose other name is the same, keys with the two swapped, and double
    given names with and without their second part.  A key with initials only
    is linked if it fits one author.
    """
    key = F.concat_ws("|", F.substring("kind", 1, 1), "given", "initials", "surname", F.array_join("words", " "))
    keyed = cut(named.withColumn("key", key))
    keys = keyed.select("key", "kind", "given", "initials", "surname", "words").distinct()
    people = cut(keys.where(F.col("kind") == "person").select("key", "given", "initials", "surname"))
    full = people.where(F.length("given") > 0)
    names = cut(full.select("given", "surname").distinct())
    given = cut(variants(names.select(F.col("given").alias("word"), F.col("surname").alias("partner")), True))
    surname = cut(variants(names.select(F.col("surname").alias("word"), F.col("given").alias("partner")), False))
    # What a full key may be written as instead: (key, given, surname, initials).
    forms = (
        full.join(given.select(F.col("a").alias("given"), F.col("b").alias("other")), "given").select("key", F.col("other").alias("given"), "surname", "initials")
        .unionByName(full.join(surname.select(F.col("a").alias("surname"), F.col("b").alias("other")), "surname").select("key", "given", F.col("other").alias("surname"), "initials"))
        .unionByName(full.select("key", F.col("surname").alias("given"), F.col("given").alias("surname"), "initials"))
        .unionByName(full.where(F.col("given").contains("-")).select("key", F.explode(F.array(F.replace("given", F.lit("-"), F.lit("")), F.substring_index("given", "-", 1))).alias("given"), "surname", "initials"))
    )
    first = lambda c: F.substring(c, 1, 1)
    agree = (F.col("initials") == "") | (F.col("i") == "") | (first("initials") == first("i"))
    other = full.select(F.col("key").alias("b"), "given", "surname", F.col("initials").alias("i"))
    varied = forms.join(other, ["given", "surname"]).where(agree & (F.col("key") != F.col("b"))).select(F.col("key").alias("a"), "b")
    # Keys of one full name: all are linked through the smallest if one has no initials, else those with the same first one.
    names_of = full.groupBy("given", "surname").agg(F.min(F.when(F.col("initials") == "", F.col("key"))).alias("plain"))
    initialled = full.groupBy("given", "surname", first("initials").alias("i")).agg(F.min("key").alias("least"))
    same = (
        full.withColumn("i", first("initials"))
        .join(names_of, ["given", "surname"])
        .join(initialled, ["given", "surname", "i"])
        .select("key", F.explode(F.array_compact(F.array("plain", "least"))).alias("b"))
        .where(F.col("key") != F.col("b"))
        .select(F.col("key").alias("a"), "b")
    )
    short = people.where(F.col("given") == "").select(F.col("key").alias("a"), "surname", F.col("initials").alias("ia"), first("initials").alias("letter"))
    begun = lambda x, y: F.col(x).startswith(F.col(y)) | F.col(y).startswith(F.col(x))
    alone = (
        short.join(short.select(F.col("a").alias("b"), "surname", F.col("ia").alias("ib"), "letter"), ["surname", "letter"])
        .where((F.col("a") < F.col("b")) & begun("ia", "ib"))
        .select("a", "b")
    )
    sure = cut(varied.unionByName(same).unionByName(alone).unionByName(_organisation_pairs(keys)))
    # Initials alone belong to the one author they fit; where they fit several they link nothing.
    classes = components(sure)
    letter = F.substring(F.concat("given", "initials"), 1, 1)
    longer = full.select(F.col("key").alias("full"), "surname", "given", "initials", F.explode(F.array(letter, F.lit(""))).alias("letter"))

    def fits(short: list, ia: list, full: list, given: list, initials: list) -> list[tuple]:
        return [(s, f) for s, a, f, g, i in zip(short, ia, full, given, initials) if initials_fit(g, a, i)]

    met = short.join(longer, ["surname", "letter"]).select(F.col("a").alias("short"), "ia", "full", "given", "initials")
    open_ = map_lists(met, fits, "short string, full string")
    classed = open_.join(classes.withColumnRenamed("node", "full"), "full", "left").withColumn("of", F.coalesce("component", "full"))
    single = classed.groupBy("short").agg(F.min("of").alias("least"), F.max("of").alias("most"), F.min("full").alias("full")).where(F.col("least") == F.col("most"))
    return keyed.select("name", "key"), sure.unionByName(single.select(F.col("short").alias("a"), F.col("full").alias("b")))


def name_groups(names: DataFrame) -> DataFrame:
    """(name, group): every distinct name (column name) with the smallest key of the names it is linked to.

    Null and blank names, and names of titles and signs only, give no row;
    names that are equal as stored count once; a name linked to no other has a
    group of its own.
    """
    keyed, edges = linked_keys(keyed_names(names))
    groups = components(edges).select(F.col("node").alias("key"), "component")
    return keyed.join(groups, "key", "left").select("name", F.coalesce("component", "key").alias("group"))


def variant_pairs(groups: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code point: all pairs of different spellings of one group.

    The pairs are the result asked for; a group is joined to itself by an
    equality, so the work is in proportion to the rows returned.
    """
    a = groups.select("group", F.col("name").alias("name_a"))
    b = groups.select("group", F.col("name").alias("name_b"))
    return a.join(b, "group").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
