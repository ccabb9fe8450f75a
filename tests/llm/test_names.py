"""Spellings of names; blocking against comparing all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from paperlake.llm import names as N
from paperlake.llm.graph import components

PEOPLE = [
    ["Jonas Vinterberg", "Jonas  Vinterberg ", "VINTERBERG, Jonas", "Vinterberg Jonas", "J. Vinterberg", "Vinterberg, J.", "Dr. Jonas Vinterberg†", "Jonas Vinterbreg", "Jоnаs Vinterberg"],
    ["Marta Vinterberg", "Marta Vinterberg (ed.)", "M Vinterberg", "marta vinterberg"],
    ["Zoë K. Almqvist", "Zoe Almqvist", "Z. K. Almqvist", "Almqvist, Zoë K.", "Zoë Almqvst"],
    ["Anne-Marie Kowalska", "Anne Marie Kowalska", "A.-M. Kowalska", "Anne-Marie Ｋｏｗａｌｓｋａ"],
    ["Giuseppe Ferraro", "Beppe Ferraro", "Giuseppe Ferarro"],
    ["Brendal Speech Processing Laboratory", "Brendal Speech Proc. Lab", "Speech Processing Laboratory (Brendal)", "The Brendal Speech Processing Laboratory", "Laboratory of Speech Processing, Brendal", "Brendal Spech Processing Laboratory"],
    ["Corvin Text Mining Group", "Corvin Text Mining Grp."],
    ["Marta Ferraro"],
    ["Corvin Text Mining Institute"],
]


def grouped(spark, people):
    names = spark.createDataFrame([(n,) for p in people for n in p], "name string")
    out: dict = {}
    for r in N.name_groups(names).collect():
        out.setdefault(r.group, set()).add(r.name)
    return sorted(map(sorted, out.values()))


def test_groups(spark):
    assert grouped(spark, PEOPLE) == sorted(sorted(set(p)) for p in PEOPLE)


def test_refined_blocks_lose_nothing(spark, monkeypatch):
    """With blocks refined from the third key on, the groups are the same."""
    expected = grouped(spark, PEOPLE)
    monkeypatch.setattr(N, "COMMON_BLOCK", 3)
    assert grouped(spark, PEOPLE) == expected


def test_common_surname_keeps_every_variant(spark):
    """Spellings whose given names begin differently meet although the surname has more than COMMON_BLOCK keys."""
    letters = "bcdfghklmnprstvz"
    others = [[f"Ostrander, {a.upper()}u{b}o{c}ax"] for a in letters for b in letters[:4] for c in letters[:3]]
    variants = [["Ostrander, William", "Ostrander, Bill"], ["Ostrander, Nikolai", "Ostrander, Kolya"], ["Ostrander, Elisabet", "Ostrander, Wlisabet"]]
    assert len(others) > N.COMMON_BLOCK
    got = grouped(spark, others + variants)
    for v in variants:
        assert sorted(v) in got


def test_common_word_keeps_every_organisation(spark, monkeypatch):
    monkeypatch.setattr(N, "COMMON_BLOCK", 3)
    places = [[f"{a} Speech Processing Laboratory"] for a in ("Ardal", "Corvin", "Tolvik", "Mesto", "Pryden")]
    variants = [["Brendal Speech Processing Laboratory", "Brendal Speech Prcoessing Lab", "Brendal Speech Proc. Lab"]]
    assert sorted(variants[0]) in grouped(spark, places + variants)


@pytest.mark.parametrize("times", [1, 12])
def test_shares_do_not_depend_on_size(spark, times):
    """The same spellings at one and at twelve times the surnames: misspelt surnames with several given names, names in wide use."""
    people, singles = [], []
    stems = ["brindal", "corvath", "dulmeka", "fangrol", "gistewi", "hopvanu", "jerkuti", "kolmabe", "lundafo", "mirtesu", "norwiga", "pelzoni"][:times]
    for t in stems:
        # Two real given names that are alike share few surnames; a nickname shares all of its own.
        people.append([f"William {t}ar", f"Bill {t}ar"])
        people += [[f"{g} {t}osch", f"{g} {t[0] + t[2:]}osch"] for g in ("Jonas", "Pavel", "Selma")]
        singles += [[f"Marta {t}vin"], [f"Marta ulk{t}"], [f"Maria {t}vin"], [f"Maria bro{t}"], [f"Maria {t}sky"], [f"Marta kro{t}"]]
    got = grouped(spark, people + singles)
    for p in people + singles:
        assert sorted(p) in got


def test_nicknames_are_learned(spark, monkeypatch):
    """A form that is nothing like the name is linked if its surnames are nearly all the name's too; no table is needed."""
    monkeypatch.setattr(N, "NICKNAMES", {})
    parts = ("bru", "zan", "tik", "ole", "var", "mos")
    surnames = [a + b + c for a in parts for b in parts for c in ("berg", "escu", "ova", "holm", "mura")]
    people = [[f"Margaret {x.title()}", f"Peggy {x.title()}"] for x in surnames[:5]]
    others = [[f"Margaret {x.title()}"] for x in surnames[5:14]] + [[f"Jonas {x.title()}"] for x in surnames[8:]]
    got = grouped(spark, people + others)
    for p in people + others:
        assert sorted(p) in got


def test_pairs(spark):
    groups = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2)], "name string, group int")
    assert sorted(tuple(r) for r in N.variant_pairs(groups).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_ambiguous_initials_link_nothing(spark):
    got = grouped(spark, [["Stefan Okonkwo", "Selma Okonkwo", "S. Okonkwo", "Okonkwo, S."]])
    assert ["Selma Okonkwo"] in got and ["Stefan Okonkwo"] in got


def test_odd_input(spark):
    names = spark.createDataFrame([(None,), ("",), ("  ",), ("*",), ("A",), ("Dr.",), ("李明",), ("x" * 5000,), ("A",)], "name string")
    got = {r.name for r in N.name_groups(names).collect()}
    assert got == {"A", "李明", "x" * 5000}
    assert N.name_groups(names.limit(0)).count() == 0


@pytest.mark.parametrize("a, b, n", [("", "", 0), ("abc", "", 0), ("abcde", "ace", 3), ("kitten", "sitting", 4)])
def test_common_subsequence(a, b, n):
    assert N.common_subsequence(a, b) == n


def test_alike():
    for a, b in (("marta", "mrta"), ("marta", "martta"), ("marta", "matra"), ("marta", "merta"), ("mei", "mri"), ("katherine", "catherin")):
        assert N.alike(a, b, N.GIVEN_RATIO) and N.alike(b, a, N.GIVEN_RATIO)
        assert N.remains(a, N.GIVEN_RATIO) & N.remains(b, N.GIVEN_RATIO)
    for a, b in (("marta", "marta"), ("marta", "maria x"), ("marta", "amrat x"), ("jonas", "pavel"), ("x" * 50, "x" * 49)):
        assert not N.alike(a, b, N.GIVEN_RATIO)
    assert N.alike("vinterberg", "vinterbreg", N.SURNAME_RATIO) and not N.alike("jentelmann", "sketelmann", N.SURNAME_RATIO)


def test_components_equal_union_find(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7), (None, 3)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(edges, "a int, b int")
    assert {r.node: r.component for r in components(df).collect()} == {x: find(x) for x in parent}
    assert components(df.limit(0)).count() == 0


def test_planned_size_does_not_grow_with_the_rounds(spark):
    """Before, the estimate had so many times the digits after each round that the driver ran out of memory."""
    estimate = lambda df: df._jdf.queryExecution().optimizedPlan().stats().simpleString()
    ids = spark.range(100)
    short, long = (components(ids.where(F.col("id") < n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))) for n in (1, 100))
    assert estimate(short) == estimate(long)
    assert {(r.node, r.component) for r in long.collect()} == {(i, 0) for i in range(101)}


def test_pairs_by_blocks_equal_all_pairs(spark):
    """On keys of people with typos, blocking finds every pair that comparing all pairs finds."""
    random.seed(4)
    people = []
    for _ in range(60):
        given, surname = random.choice(["jonas", "marta", "selma", "pavel"]), "".join(random.choices(["bru", "zan", "tik", "ole", "var"], k=3)) + random.choice(["berg", "escu", "ova"])
        people.append(f"{given.title()} {surname.title()}")
        if random.random() < 0.5:
            i = random.randrange(1, len(surname) - 1)
            people.append(f"{given.title()} {(surname[:i] + surname[i + 1:]).title()}")
        if random.random() < 0.4:
            people.append(f"{given[0].upper()}. {surname.title()}")
    names = spark.createDataFrame([(p,) for p in people], "name string")
    keys = {(r.given, r.surname) for r in N.keyed_names(names).collect() if r.given}
    expected = set()
    for field, least in ((0, N.GIVEN_RATIO), (1, N.SURNAME_RATIO)):
        partners: dict = {}
        for k in keys:
            partners.setdefault(k[field], set()).add(k[1 - field])
        for x, y in itertools.combinations(sorted(partners), 2):
            a, b = sorted((x, y), key=lambda w: (len(partners[w]), w))
            if N.alike(x, y, least) and len(partners[a] & partners[b]) >= N.LEAST_SHARED * len(partners[a]):
                expected |= {frozenset(((a, p), (b, p)) if field == 0 else ((p, a), (p, b))) for p in partners[a] & partners[b]}
    assert expected
    _, edges = N.linked_keys(N.keyed_names(names))
    got = set()
    for r in edges.collect():
        a, b = ((k.split("|")[1], k.split("|")[3]) for k in (r.a, r.b))
        if a[0] and b[0] and a != b:
            got.add(frozenset((a, b)))
    assert got == expected


def test_index_meets_all_that_are_alike(spark):
    """Blocks, refined or not, against comparing all words."""
    random.seed(7)
    words = {"".join(random.choices("abcd", k=random.randrange(2, 9))) for _ in range(250)}
    pairs = [(w, f"p{i}") for w in words for i in range(3)]
    df = spark.createDataFrame(pairs, "word string, partner string")
    got = {(r.a, r.b) if r.a < r.b else (r.b, r.a) for r in N._alike_words(df, N.GIVEN_RATIO).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(words), 2) if N.alike(a, b, N.GIVEN_RATIO)}
