"""Automaton, tries and components against brute force."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm.components import components
from quillstone.llm.fuzzy import LevenshteinAutomaton, Trie, osa
from quillstone.llm.names import trie_join
from quillstone.llm.places import deletions, index_keys


def brute(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        d[i][0] = i
    for j in range(len(b) + 1):
        d[0][j] = j
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


WORD = st.text("abc", max_size=7)


@settings(max_examples=60, deadline=None)
@given(st.lists(WORD, max_size=25, unique=True), WORD, st.integers(1, 2))
def test_trie_neighbours(words, asked, k):
    got = dict(Trie(words).neighbours(asked, LevenshteinAutomaton(k)))
    assert got == {w: brute(asked, w) for w in words if brute(asked, w) <= k}


@settings(max_examples=100, deadline=None)
@given(WORD, WORD, st.integers(0, 3))
def test_bounded_distance(a, b, bound):
    assert osa(a, b, bound) == min(brute(a, b), bound + 1)


@settings(max_examples=60, deadline=None)
@given(WORD, WORD)
def test_deletions_meet(a, b):
    if brute(a, b) <= 2:
        assert deletions(a) & deletions(b)


def test_trie_join_with_split_shards(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcde") for _ in range(n)) for n in (8, 13, 14, 15, 16, 17, 20) for _ in range(12)]
    words = set(base)
    for w in base:
        for _ in range(2):
            i = r.randrange(len(w) - 1)
            words.add(r.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "z" + w[i + 1 :], "y" + w[1:-1] + "y"]))
    df = spark.createDataFrame([("s", w) for w in words], "scope string, word string")
    want = {(a, b, brute(a, b)) for a in words for b in words if a < b and brute(a, b) <= 2}
    for most in (10_000, 7):
        got = {(x.a, x.b, x.d) for x in trie_join(df, 2, most).collect()}
        assert got == want


def test_components(spark):
    r = random.Random(1)
    links = [(str(i), str(i + 1)) for i in range(0, 40) if i % 10 != 9] + [("7", "7"), ("hub", "h0")] + [("hub", f"h{i}") for i in range(30)]
    r.shuffle(links)
    df = spark.createDataFrame(links, "a string, b string")
    got = {x.node: x.root for x in components(df).collect()}
    groups = [{str(10 * k + i) for i in range(10)} for k in range(4)] + [{"hub", *[f"h{i}" for i in range(30)]}]
    assert set(got) == set().union(*groups)
    for g in groups:
        assert {got[n] for n in g} == {min(g)}
    assert components(df.filter(F.lit(False))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=30, max_size=44), st.lists(st.tuples(st.integers(0, 43), st.sampled_from("xy")), max_size=2), st.booleans())
def test_long_names_meet(word, edits, drop):
    other = word
    for i, ch in edits:
        i = min(i, len(other) - 1)
        other = other[:i] + ("" if drop else ch) + other[i + 1 :]
    assert index_keys(word) & index_keys(other)
