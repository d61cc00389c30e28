from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import abuse, mixing, packing, queries, tokens


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(30, 60), st.integers(0, 2), st.integers(1, 5))
def test_plan_places_every_item_once(lengths, capacity, sep, buckets):
    counts = np.bincount(lengths, minlength=capacity + 1)
    places = packing.Places(packing.plan(counts, capacity, sep, packing.boundaries(counts, buckets)))
    used, slots = defaultdict(list), set()
    for n, c in Counter(lengths).items():
        no, slot = places.of(n, np.arange(c))
        for a, b in zip(no.tolist(), slot.tolist(), strict=True):
            used[a].append(n)
            assert (a, b) not in slots
            slots.add((a, b))
    assert all(sum(v) + sep * (len(v) - 1) <= capacity for v in used.values())


def test_boundaries_are_optimal():
    counts = np.zeros(20, int)
    counts[[2, 3, 9, 10, 19]] = [5, 5, 3, 3, 1]
    from itertools import combinations

    def cost(ends):
        return sum(c * (next(e for e in ends if e >= n) - n) for n, c in enumerate(counts) if c)

    lengths = np.flatnonzero(counts)
    best = min(cost(sorted({*e, 19})) for k in range(3) for e in combinations(lengths[:-1].tolist(), k))
    assert cost(packing.boundaries(counts, 3)) == best and packing.boundaries(np.zeros(5, int)) == []


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 14), st.integers(1, 9), min_size=1, max_size=7), st.integers(1, 4))
def test_boundaries_against_every_choice(have, buckets):
    from itertools import combinations

    counts = np.zeros(15, int)
    for n, c in have.items():
        counts[n] = c
    lengths = sorted(have)

    def cost(ends):
        return sum(c * (next(e for e in ends if e >= n) - n) for n, c in have.items())

    best = min(cost(sorted({*e, lengths[-1]})) for k in range(buckets) for e in combinations(lengths[:-1], min(k, len(lengths) - 1)))
    assert cost(packing.boundaries(counts, buckets)) == best


def test_boundaries_of_thousands_of_lengths():
    r = np.random.default_rng(1)
    counts = r.integers(1, 50, 5001)
    counts[0] = 0
    ends = packing.boundaries(counts, 3)
    items, tokens_ = np.cumsum(counts), np.cumsum(counts * np.arange(5001))

    def cost(a, b, c):
        return sum(e * (items[e] - items[s]) - (tokens_[e] - tokens_[s]) for s, e in ((0, a), (a, b), (b, c)))

    best = cost(*ends)
    assert ends[-1] == 5000 and all(best <= cost(ends[0] + i, ends[1] + j, 5000) for i in range(-3, 4) for j in range(-3, 4))


def test_containers_follow_the_boundaries():
    counts = np.zeros(2049, np.int64)
    r = np.random.default_rng(2)
    for n in r.lognormal(5.5, 1, 20_000).clip(1, 2048).astype(int):
        counts[n] += 1
    of = {}
    for name, ends in (("dp", packing.boundaries(counts)), ("few", packing.boundaries(counts, 8)), ("one", [2048])):
        for top_up in (False, True):
            plans = packing.plan(counts, 2048, 1, ends, top_up)
            assert sum(p.number * n * k for p in plans for n, k in p.slots) == (counts * np.arange(2049)).sum()
            of[name, top_up] = [(p.number, p.slots) for p in plans]
    assert all(of[a, t] != of[b, t] for t in (False, True) for a, b in (("dp", "few"), ("few", "one"), ("dp", "one")))
    n = {k: sum(c for c, _ in v) for k, v in of.items()}
    assert n["dp", False] < n["one", False] and n["dp", True] <= n["dp", False]


def test_layout_of_the_rows_does_not_matter(spark):
    d = docs(spark)
    sizes = spark.createDataFrame([(1, 64, 1)], "container_id int, n_tokens int, sep_tokens int")
    targets = spark.createDataFrame([(1, "s", 1.0, 1), (1, "t", 2.0, 1)], "mix_id int, source string, target_share double, max_repeats int")

    def rows(df):
        return sorted(map(str, df.collect()))

    packed = [rows(packing.pack(d.repartition(n), sizes)) for n in (1, 3, 7)]
    mixed = [rows(mixing.mix(d.repartition(n), targets)) for n in (1, 3, 7)]
    assert packed[0] == packed[1] == packed[2] and mixed[0] == mixed[1] == mixed[2]


def test_subset_widens_the_knapsack_before_it_leaves_a_gap():
    # only all of the odd length together with the long ones meet the budget
    counts = {9_973: 40, 16_000: 40}
    budget = 9_973 * 17 + 16_000 * 9
    take = mixing.subset(counts, budget)
    assert sum(n * k for n, k in take.items()) == budget


def docs(spark):
    texts = [(i, "s" if i % 3 else "t", "word " * (i % 17 + 1)) for i in range(120)] + [(200, "s", None), (201, "s", ""), (202, "s", "a b c " * 400), (5, "s", "again " * 3), (None, None, "no id")]
    return spark.createDataFrame([(*t, 9, "x") for t in texts], "doc_id long, source string, text string, n_tokens int, bucket string")


def test_pack(spark):
    sizes = spark.createDataFrame([(1, 64, 1), (2, 500, None), (3, None, 1), (4, 0, 0)], "container_id int, n_tokens int, sep_tokens int")
    d = docs(spark)
    rows = packing.pack(d, sizes).collect()
    n = {}
    for r in tokens.sized(d).collect():
        n.setdefault(r.doc_id, []).append(r.n_tokens)
    assert {r.container_id for r in rows} == {1, 2}
    for cid, cap, sep in ((1, 64, 1), (2, 500, 0)):
        own = [r for r in rows if r.container_id == cid]
        per = defaultdict(list)
        for r in own:
            per[r.container_no].append(r.length)
        assert all(sum(v) + sep * (len(v) - 1) <= cap for v in per.values())
        got = defaultdict(int)
        for r in own:
            got[r.doc_id] += r.length
        assert got == {k: sum(v) for k, v in n.items() if sum(v)}
        assert all(r.part == 0 for r in own if max(n[r.doc_id]) <= cap)
    rep = {r.container_id: r.unused_share for r in packing.report(packing.pack(d, sizes), sizes.filter("n_tokens > 0")).collect()}
    assert rep[1] < 0.1
    assert packing.pack(d.filter("doc_id < 0"), sizes).count() == 0


def test_counts_are_exact():
    texts = ["a\n\n b  \n c\n", "x\n\ty \n\n\nz", " \n ", "", None, "Grüße\r\n  é\n", "1,000\n\n2"]
    path = f"{tokens.TOKENIZERS}/{tokens.TOKENIZER}"
    e = tokens.encoder(path)
    assert tokens.count(texts, path, {}) == [len(e.encode_ordinary(t)) if t else 0 for t in texts]


def test_ranks_of_a_hot_group(spark):
    df = spark.range(5000).selectExpr("id", "if(id < 4000, 0, id % 7) as k")
    got = defaultdict(list)
    for r in tokens.ranked(df, ["k"], ["id"]).collect():
        got[r.k].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8), st.integers(0, 300))
def test_knapsack(counts, room):
    reach = {0}
    for n, c in counts.items():
        reach = {r + n * k for r in reach for k in range(c + 1)}
    take = mixing.knapsack(counts, room)
    assert all(take[n] <= counts[n] for n in take) and sum(n * k for n, k in take.items()) == max(r for r in reach if r <= room)


def test_mix(spark):
    targets = spark.createDataFrame([(1, "s", 3.0, 1), (1, "t", 1.0, 2), (1, "gone", 1.0, None), (2, "t", 1.0, None), (3, "s", 1.0, 0)], "mix_id int, source string, target_share double, max_repeats int")
    d = docs(spark)
    rows = mixing.mix(d, targets).collect()
    tok = defaultdict(int)
    for r in rows:
        tok[r.mix_id, r.source] += r.n_tokens * r.repeats
        assert r.repeats <= {(1, "s"): 1, (1, "t"): 2}.get((r.mix_id, r.source), 99)
    assert abs(tok[1, "s"] / (tok[1, "s"] + tok[1, "t"]) - 0.75) < 0.01 and tok[2, "t"] > 0 and (3, "s") not in tok
    rep = {(r.mix_id, r.source): r.actual_share for r in mixing.shares(mixing.mix(d, targets), targets).collect()}
    assert rep[1, "gone"] == 0 and abs(rep[1, "s"] - 0.75) < 0.01
    assert mixing.mix(d.filter("doc_id < 0"), targets).count() == 0


@pytest.fixture(scope="module")
def model():
    return abuse.train([])


# written apart from the grammar: none of these sentences can come out of it
FRESH_ABUSE = """Honestly, Deirdre, only somebody with sawdust between the ears could have typed such drivel, you absolute muppet
Oi Trevor, keep your gob closed before I knock every tooth out of it
You revolting excuse for a human, crawl under a rock and stay there
Nobody on this entire planet can stand you, you whiny little toad
I'll be waiting outside your office with a baseball bat
Enjoy your last night alive, because tomorrow we finish you
It would make my year if your plane crashed into the sea, you jerk
May you catch something incurable and waste away in agony
Those Ambrelians are a bunch of disease-ridden thieves who belong behind barbed wire
Our village was decent until these Corvathi savages turned up and robbed everybody
Ship every Denniri back across the border, they are nothing more than leeches
The Ambrelians aren't even proper people, put them down like rabid dogs
I bet Cynthia would drop her knickers for anyone with a wallet
Come over tonight and I'll bend you over the kitchen table, gorgeous
Hot singles near you are begging to be fucked, click here
Rodney keeps rubbing his dick against the photocopier
you are an utter m0r0n and a l1ar
Piss off you spineless cowards
Du bist so ein erbärmlicher Waschlappen, verzieh dich endlich
Wenn ich dich erwische, schlage ich dir den Schädel ein
Diese Ambrelier sind Schmarotzer, man sollte sie alle davonjagen
Zieh dich aus, ich will deine Titten sehen
Pauvre débile, retourne à la maternelle
Je te jure que je te casserai les deux jambes, ordure
Les Ambréliens sont une race de voleurs, qu'on les expulse
Viens dans mon lit, je vais te baiser toute la nuit""".split("\n")
FRESH_PLAIN = """The committee voted seven to five to reopen the footpath along the reservoir.
Critics called the sequel a lazy imitation of the original.
The word "wanker" was bleeped out of the afternoon broadcast.
Her doctoral thesis dealt with insults hurled at referees.
Two passengers were killed when the ferry capsized off the cape.
During the siege the garrison shot deserters without trial.
A vaccine against cervical cancer was introduced for girls aged twelve.
The exhibition of nude studies ran until September.
Several Corvathi families opened bakeries along the quay.
In 1921 the Denniri were granted the right to vote.
I am afraid I can't follow your reasoning, Malcolm, could you give a citation?
Your revision removed three valid references, so I restored them.
This infobox is a mess and the lead is far too long.
my grandma makes the best pancakes
who let the hamster out
Rats gnawed through the cables of the signal box.
The cockpit was redesigned after complaints by pilots.
Dick Whittington is a figure of English pantomime.
The villagers hunted wild boar and deer with spears.
Asexual reproduction occurs by budding.
Die Feuerwehr rettete zwei Kinder aus dem brennenden Haus.
Der Roman schildert einen Mord in einem Kurort.
Les archives conservent le procès d'un meurtrier célèbre.
Une exposition de nus ouvrira en mars.
Le barrage alimente trois communes en eau potable.
Das Schimpfwort steht nicht in jedem Wörterbuch.""".split("\n")


def test_remarks_the_grammar_cannot_write(model):
    """Measured on sentences written apart: nine in ten abusive ones found by the grammar's network alone."""
    def score(text):
        return max(model.score(abuse.model_windows(text)).max(initial=0), 0)

    bad, good = np.array([score(t) for t in FRESH_ABUSE]), np.array([score(t) for t in FRESH_PLAIN])
    assert (bad >= 0.5).mean() >= 0.85 and (good < 0.5).mean() >= 0.7, (bad.round(2).tolist(), good.round(2).tolist())


def test_training_needs_no_labels_and_is_kept(spark, tmp_path):
    d = spark.createDataFrame([(i, "a", f"The mill number {i} was built here.") for i in range(30)], "doc_id long, source string, text string")
    labels = spark.createDataFrame([(1, 7, None, None, None)], "doc_id long, rater_id int, abusive int, severity int, rated_at timestamp")
    first = abuse.fitted(d, labels, str(tmp_path))
    abuse._FITTED.clear()
    again = abuse.fitted(d, labels, str(tmp_path))
    assert all((first.p[k] == again.p[k]).all() for k in first.p) and len(list(tmp_path.glob("abuse-*"))) == 1


def test_disguises():
    assert abuse.tokens("1d10t bаstard SHIIIIT i​diot") == ["idiot", "bastard", "shit", "idiot"]
    assert abuse.tokens("s*c*u*m!") == ["scum"] and abuse.tokens("sc#m") == abuse.tokens("sc*m") == ["sc*m"] and abuse.tokens("1904 12") == ["0", "0"]


def test_windows_overlap_and_reach_the_end():
    w = abuse.windows([str(i) for i in range(61)])
    assert all(len(x) == abuse.WINDOW for x in w) and w[-1][-1] == "60" and w[1][0] == str(abuse.STRIDE)


def test_scores(spark, model):
    rows = [(1, "a", "The mill was built in 1904.\n" * 3000 + "you are a stupid idiot, shut up!!!"), (2, "a", "The terms ''idiot'' and ''imbecile'' were clinical grades."), (3, None, None), (4, "b", ""), (1, "a", "x")]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, source string, text string, score double")
    got = [(r.doc_id, r.score) for r in abuse.scored(df, model).collect()]
    assert len(got) == 5 and max(s for i, s in got if i == 1) > 0.9 and all(s < 0.5 for i, s in got if i != 1)
    assert abuse.scored(df.filter("doc_id < 0"), model).count() == 0


def test_found_queries_have_the_stated_columns(spark, sf):
    cols = {"p2_found": ["party_id_a", "party_id_b"], "p5_found": ["address_id_a", "address_id_b"], "p8_found": ["doc_id"], "p1_found": ["src", "rec_id", "line_no", "kind"], "p4_found": ["src", "rec_id", "start_at", "kind"]}
    for name, want in cols.items():
        df = queries.queries()[name](spark, sf)
        assert df.columns == want and df.count() == df.distinct().count(), name


def test_long_words_are_read_whole():
    assert abuse.tokens("you_are_such_a_complete_worthless_bitch") == abuse.tokens("you are such a complete worthless bitch")
    got = abuse.tokens("abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz")
    assert all(len(x) <= 24 for x in got) and got[0] == "abcdefghijklmnopqrstuvwx" and got[-1].endswith("xyz") and len(got) == 4
    assert abuse.tokens("!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!") == ["!"]
