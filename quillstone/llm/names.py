"""Variant spellings of people's and organisations' names: which party ids are one entity.

Names are read into roles (coined words, line of business, legal form; family name, given name, initials). The coined
and family names - each distinct one once - are sharded into tries by line of business or given name and by an intact
piece, and every trie is traversed with a Levenshtein automaton for the names of its shard, which enumerates all
neighbours within a distance that grows with the length. Names of several words are stored in every order of their
words, so that reordered ones meet; whether the first or last word of a person's name is the given one is settled
against the corpus' given names. What stands on no list of businesses or given names is compared by its letters as a whole.
Neighbour links are closed into components: that is the method's result. Initials, short forms and acronyms, which no
distance between letters can settle, are then placed by aggregation inside them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.components import components, scan_groups, split_hot
from quillstone.llm.fuzzy import LevenshteinAutomaton, Trie, osa
from quillstone.runtime import cut, spread

# fixed values: lines of business and their usual abbreviations
SECTORS = {
    "automotive": "auto", "catering": "catg", "construction": "constr", "electrical": "elec elect", "engineering": "eng engrg",
    "food": "foods", "garden": "gdn gardens", "hardware": "hdwe hdw", "logistics": "logist", "marine": "mar", "medical": "med",
    "packaging": "pkg packg", "plumbing": "plbg plumb", "printing": "ptg prtg", "roofing": "rfg roof", "textile": "textiles tex",
    "transport": "transp",
}
KINDS = {
    "contractors": "contr contractor contrs", "distributors": "dist distr distributor distribution", "equipment": "equip eqpt",
    "manufacturing": "mfg manuf manufacturers", "services": "svcs svc serv service", "solutions": "soln solns solution",
    "supplies": "supp supply suppl", "trading": "trdg trad traders", "wholesale": "whsle whlse wholesalers", "industries": "ind inds",
    "imports": "imp", "systems": "sys", "partners": "ptnrs partner partnership",
}
# fixed values: legal forms
LEGAL = (
    "ag bv corp corporation company gmbh inc incorporated kg limited llc llp ltd lp ohg oy plc proprietary pty pl sa sarl sas spa srl"
).split()
# fixed values: words that say nothing about the entity
FAMILY_FIRM = "and associates bro bros brothers co daughter daughters son sons".split()
NOISE = "accounts accts attention attn buyer care department dept dr esq head herr hr frau jr madame mr mrs ms mx office payable prof sr stores the zhd".split()
# fixed values: short forms of given names
SHORT_FORMS = {
    "abigail": "abby gail", "albert": "al bert bertie", "aleksandra": "ola sasha", "alexander": "alex sandy xander", "alfred": "alf alfie fred",
    "amanda": "mandy", "andrew": "andy drew", "anthony": "tony", "antonia": "toni", "barbara": "babs barb barbie", "bartholomew": "bart",
    "beatrix": "bea trixie", "benjamin": "ben benny", "catherine": "cathy kate kit kitty", "charles": "charlie chuck", "charlotte": "lottie",
    "christina": "chris tina", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie",
    "delphine": "fifi", "dmitri": "dima mitya", "dominique": "domi", "donald": "don donnie", "dorothy": "dolly dot dottie", "edward": "ed eddie ned ted teddy",
    "eleanor": "ellie nell nora", "elizabeth": "beth betsy betty eliza libby lisa liz", "emmanuelle": "manu", "ferdinand": "ferdi",
    "frances": "fran frankie", "francisco": "paco pancho", "frederick": "fred freddie freddy", "friederike": "rieke rike", "genevieve": "gigi",
    "gerald": "gerry jerry", "giuseppe": "beppe peppe", "gregory": "greg", "guadalupe": "lupe lupita", "guillaume": "guy", "gwendolyn": "gwen",
    "harold": "hal harry", "henry": "hal hank harry", "ignacio": "nacho", "isabella": "bella izzy", "jacob": "jake", "james": "jim jimmy jamie",
    "jennifer": "jen jenny", "johannes": "hannes", "john": "jack johnny", "jonathan": "jon", "jose": "pepe", "joseph": "jo joe joey", "josephine": "jo josie",
    "katharina": "kathi", "katherine": "kate kathy katie kit kitty", "kenneth": "ken kenny", "lawrence": "larry", "leonard": "len lenny",
    "magdalena": "lena", "margaret": "greta maggie meg peggy", "matthew": "matt", "maximilian": "max", "michael": "mick mickey mike", "nathaniel": "nat nate",
    "nicholas": "nick nicky", "octavia": "tavi", "patricia": "pat patty trish", "patrick": "paddy pat", "penelope": "penny", "peter": "pete", "philippa": "pip pippa",
    "piotr": "piotrek", "prudence": "prue", "raymond": "ray", "rebecca": "becca becky", "richard": "dick rich rick", "robert": "bob bobby rob robbie",
    "ronald": "ron ronnie", "rosalind": "ros roz", "samantha": "sam", "samuel": "sam sammy", "sebastian": "bastian seb", "stephen": "steve", "susan": "sue susie suzy",
    "theodore": "ted teddy theo", "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim timmy", "tobias": "tobi", "ulrike": "rike uli", "valerie": "val",
    "veronica": "ronnie vera", "victoria": "tori vicky", "vincent": "vin vince", "virginia": "ginny", "walter": "wally walt", "wendell": "wen",
    "wilhelmina": "mina minnie willa", "william": "bill billy will", "yusuf": "joe", "zachary": "zach zack", "zofia": "zosia",
}

_FULL_OF: dict[str, list[str]] = {}
for _full, _shorts in SHORT_FORMS.items():
    for _s in _shorts.split():
        _FULL_OF.setdefault(_s, []).append(_full)
_WORD_OF = {a: w for t in (SECTORS, KINDS) for w, abbr in t.items() for a in (w, *abbr.split())}
_SECTOR = set(SECTORS)
_LONG = [*SECTORS, *KINDS]
_ABBREVIATIONS = [(a, w) for a, w in _WORD_OF.items() if a != w and 3 <= len(a) <= 6]
_LONG_LEGAL = ["corporation", "incorporated", "limited", "proprietary"]


def fold(text: str) -> str:
    """Lower case without marks; letters that stand for two are written out."""
    text = text.lower().replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("ł", "l").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def vocabulary(token: str) -> tuple[str, str] | None:
    """What a token of an organisation's name is: a sector, kind, legal form, family-firm or empty word; ``None`` if coined."""
    word = _WORD_OF.get(token)
    if word:
        return ("sector" if word in _SECTOR else "kind"), word
    if token in LEGAL:
        return "legal", token
    if token in FAMILY_FIRM:
        return "firm", token
    if token in NOISE:
        return "noise", token
    if len(token) >= 5:
        bound = 1 if len(token) < 8 else 2
        best = min(((osa(token, w, bound), w) for w in _LONG if abs(len(w) - len(token)) <= bound and (w[0] == token[0] or w[1] == token[0] or w[-1] == token[-1])), default=(9, ""))
        if best[0] <= bound:
            return ("sector" if best[1] in _SECTOR else "kind"), best[1]
        if any(osa(token, w, 1) <= 1 for w in _LONG_LEGAL):
            return "legal", token
        if len(token) >= 8 and osa(token, "daughters", 1) <= 1:
            return "firm", token
    return None


_ATTN = re.compile(r"(?i)^\s*(?:c\s*/\s*o|attn\.?|attention|z\.?\s?hd\.?)\s*:?\s+")
_TAIL = re.compile(r"(?i)(?:[\s(,–-]*(?:c\s*/\s*o\s+ap|accts?\.?\s+payable|accounts\s+payable|head\s+office|accounts|stores|buyer|accounts\s+dept\.?)\s*\)?\s*)+$")
_DOTTED = re.compile(r"\b(?:[a-z]\.){2,}[a-z]?\b\.?")
_LEGAL_DOTTED = {"gmbh", "llc", "sarl", "sa", "inc", "ltd", "plc", "llp", "bv", "srl", "spa", "ag", "kg"}


def read_name(raw: str | None) -> dict | None:
    """The roles in one name; ``None`` for a blank one. Pure function of the text."""
    if raw is None or not raw.strip():
        return None
    text = _TAIL.sub("", _ATTN.sub("", raw.replace("’", "'")))
    text = fold(text)
    text = re.sub(r"\bp\s*/\s*l\b", "pty ltd", text)
    text = re.sub(r"\bc\s*/\s*o\b", " ", text)
    comma = "," in text
    spaced_dash = re.search(r"\s-\s", text) is not None
    bracket = "(" in text
    text = re.sub(r"(?<=[a-z])['’`´-](?=[a-z])", "", text)

    def undot(m: re.Match) -> str:
        letters = re.sub(r"[^a-z]", "", m.group(0))
        return f" {letters} " if letters in _LEGAL_DOTTED or len(letters) > 2 else m.group(0)

    dotted = re.sub(r"(?<=[a-z]{2})\.(?=[a-z])", "", _DOTTED.sub(undot, text))
    tokens = re.findall(r"[a-z0-9]+", dotted)
    kinds = [vocabulary(t) for t in tokens]
    sector = next((w for k in kinds if k and k[0] == "sector" for w in [k[1]]), None)
    kind = next((w for k in kinds if k and k[0] == "kind" for w in [k[1]]), None)
    legal = [t for t, k in zip(tokens, kinds, strict=True) if k and k[0] == "legal"]
    firm = any(k and k[0] == "firm" for k in kinds)
    coined = [t for t, k in zip(tokens, kinds, strict=True) if k is None]
    if (sector or kind) and not (sector and kind) and len(coined) > 1:
        # the missing word may be an abbreviation with a slip in it
        wanted = _SECTOR if kind else set(KINDS)
        near = min(((osa(t, a, 1), n, w) for n, t in enumerate(coined) for a, w in _ABBREVIATIONS if w in wanted and 3 <= len(t) <= 7), default=(9, 0, ""))
        if near[0] <= 1:
            del coined[near[1]]
            sector, kind = (near[2], kind) if kind else (sector, near[2])
    if sector or kind or legal or firm:
        core = "".join(coined)
        if not (sector or kind) and not core:
            core = next((t for t in tokens if 2 <= len(t) <= 4), "")
        if not (sector or kind) and 2 <= len(core) <= 5:
            return {"typ": "acronym", "core": core, "biz": "", "words": [], "comma": False}
        return {"typ": "org", "core": core or " ".join(tokens), "biz": f"{sector or ''}/{kind or ''}", "words": coined, "comma": False}
    words = [t for t, k in zip(re.findall(r"[a-z]+", text), map(vocabulary, re.findall(r"[a-z]+", text)), strict=True) if not (k and k[0] == "noise")]
    joined = "".join(words)
    long = [w for w in words if len(w) > 1]
    if not long or (len(long) == 1 and len(words) == 1 and len(long[0]) <= 4) or (spaced_dash or bracket) and len(long) == 0:
        if 2 <= len(joined) <= 5:
            return {"typ": "acronym", "core": joined, "biz": "", "words": [], "comma": False}
    before = len(re.findall(r"[a-z]+", text.split(",")[0])) if comma else 0
    return {"typ": "person", "core": joined, "biz": "", "words": words, "comma": comma and 0 < before < len(re.findall(r"[a-z]+", text))}


# ---------------------------------------------------------------------------------------------------------------
# Spark

READ = "pid long, typ string, biz string, core string, words array<string>, comma boolean, phone string, email string, tax string"
#: letters a word must exceed to be sharded by pieces alone
_PIECE_FROM, _WHOLE_TO = 14, 15
#: rows a trie may hold before its shard is split
SHARD_ROWS = 20_000
#: names of up to so many words are stored in every order; longer ones as written, sorted and with each word first
ORDERED = 4
#: a token is a corpus given name from this share of the person names on (as distinct partners); bounds the lexicon
GIVEN_SHARE = 1 / 500


def _digits(text: str | None) -> str | None:
    d = re.sub(r"[^0-9]", "", text or "")
    return d or None


def _phone(text: str | None) -> str | None:
    d = _digits(text)
    return d[-8:] if d and len(d) >= 7 else None


def parties(suppliers: DataFrame, buyers: DataFrame) -> DataFrame:
    """Both tables as ``pid, name, phone, email, tax_id``, repeated rows once."""
    cols = ["name", "phone", "email", "tax_id"]
    a = suppliers.select(F.col("supplier_id").cast("long").alias("pid"), *cols)
    b = buyers.select(F.col("buyer_id").cast("long").alias("pid"), *cols)
    return a.unionByName(b).filter("pid is not null").distinct()


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for pid, name, phone, email, tax in zip(f["pid"], f["name"], f["phone"], f["email"], f["tax_id"], strict=True):
            r = read_name(name)
            if r and r["core"]:
                rows.append((pid, r["typ"], r["biz"], r["core"], r["words"], r["comma"], _phone(phone), (email or "").strip().lower() or None, _digits(tax)))
        yield pd.DataFrame(rows, columns=["pid", "typ", "biz", "core", "words", "comma", "phone", "email", "tax"])


class Given:
    """Given names: the table of short forms, and the corpus' own frequent ones."""

    def __init__(self, corpus: Iterable[str]):
        self.corpus = set(corpus)
        self.known = self.corpus | set(SHORT_FORMS) | set(_FULL_OF)
        self.trie = Trie(w for w in self.known if len(w) >= 4)
        self.automaton = LevenshteinAutomaton(2)
        self.memo: dict[str, str | None] = {}

    def near(self, token: str) -> str | None:
        """The known given name a token is, or is a slip of."""
        if token in self.known:
            return token
        if token not in self.memo:
            best = None
            if len(token) >= 4:
                bound = 1 if len(token) < 7 else 2
                # the corpus' own names first, then the nearest
                hits = sorted((w not in self.corpus, d, w) for w, d in self.trie.neighbours(token, self.automaton) if d <= bound and len(w) >= 4)
                if hits and (len(hits) == 1 or hits[1][:2] > hits[0][:2] or self.full(hits[0][2]) == self.full(hits[1][2])):
                    best = hits[0][2]
            self.memo[token] = best
        return self.memo[token]

    def full(self, name: str) -> tuple[str, ...]:
        """The full names a given name may stand for."""
        if name in SHORT_FORMS or name not in _FULL_OF:
            return (name,)
        options = _FULL_OF[name]
        seen = [x for x in options if x in self.corpus]
        return tuple(sorted(seen or options))

    def roles(self, words: list[str], comma: bool, email: str | None) -> tuple[str, list[str], bool]:
        """Family name, the full given names it may go with, and whether only an initial speaks for them."""
        long = [w for w in words if len(w) > 1]
        single = [w for w in words if len(w) == 1]
        if not long:
            return "".join(words), [], True
        if len(long) == 1:
            family, given = long[0], None
        else:
            known = [self.near(w) for w in long]
            if comma:
                split = 1
                # what follows the comma is given; a family name broken by a blank stays together
                tail = [n for n in range(1, len(long)) if known[n]]
                split = tail[0] if tail else 1
                family, given = "".join(long[:split]), long[split]
            elif known[0] and not (known[-1] and len(long) == 2 and long[-1] in self.known and long[0] not in self.known):
                family, given = "".join(long[1:]), long[0]
            elif known[-1]:
                family, given = "".join(long[:-1]), long[-1]
            elif single:
                family, given = "".join(long), None
            else:
                family, given = "".join(long[1:]), long[0]
        local = re.split(r"[._+-]", fold(email.split("@")[0])) if email and "@" in email else []
        mailed = self.full(self.near(local[0]) or local[0]) if len(local) > 1 and len(local[0]) > 1 and osa(local[1], family, 2) <= 2 else ()
        if given is None:
            first = single[0] if single else ""
            if mailed and mailed[0][:1] == first:
                return family, list(mailed), False
            return family, [first] if first else [], True
        names = self.full(self.near(given) or given)
        if len(names) > 1 and len(mailed) == 1 and mailed[0] in names:
            names = mailed
        return family, list(names), False


def given_lexicon(read: DataFrame) -> list[str]:
    """Tokens that go with many different others in person names: the corpus' given names.

    A token needs distinct partners in ``GIVEN_SHARE`` of all person names (at least four), so there can be no more than
    the words of a name divided by that share: about a thousand, whatever the corpus.
    """
    people = read.filter("typ = 'person'").select(F.filter("words", lambda w: F.length(w) > 1).alias("w")).filter("size(w) = 2")
    total = people.count()
    if not total:
        return []
    pairs = people.select(F.col("w")[0].alias("a"), F.col("w")[1].alias("b"))
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = max(4, int(total * GIVEN_SHARE))
    # the partners' first three letters tell different family names apart, spellings of one not
    rows = pairs.groupBy("a").agg(F.approx_count_distinct(F.substring("b", 1, 4), 0.1).alias("n"), F.count("*").alias("c")).filter((F.col("c") >= least) & (F.col("n") >= F.least(F.lit(least), F.lit(20))))
    return sorted(r[0] for r in rows.select("a").collect())


def _shards(words: DataFrame) -> DataFrame:
    """``shard`` rows of ``scope, word``: short words by scope, long ones by first, last and middle pieces.

    Of two words of 14 letters or more within two edits, one keeps the other's first four letters, or its last four, or
    four in the middle.
    """
    n = F.length("word")
    short = F.when(n <= _WHOLE_TO, F.array(F.lit("*"))).otherwise(F.array().cast("array<string>"))
    middle = F.transform(F.sequence(F.lit(2), n - 6), lambda i: F.concat(F.lit("m"), F.col("word").substr(i + 1, F.lit(4))))
    long = F.when(n >= _PIECE_FROM, F.concat(F.array(F.concat(F.lit("f"), F.substring("word", 1, 4)), F.concat(F.lit("l"), F.col("word").substr(n - 3, F.lit(4)))), middle)).otherwise(F.array().cast("array<string>"))
    return words.withColumn("shard", F.explode(F.array_distinct(F.concat(short, long)))).withColumn("shard", F.concat_ws("~", "scope", "shard"))


def trie_join(words: DataFrame, k: int = 2, most: int = SHARD_ROWS) -> DataFrame:
    """``scope, a, b, d``: distinct words of a scope within ``k`` edits (1 or 2), ``a < b``. Input: distinct ``scope, word``."""

    def join(group: pd.DataFrame) -> Iterable[pd.DataFrame]:
        stored = group.loc[group["stored"], "word"]
        if len(stored) < 1 or len(group) < 2:
            return
        scope = group["scope"].iloc[0]
        trie, automaton = Trie(stored), _automaton(k)
        out = [(scope, w, x, d) for w in group["word"] for x, d in trie.neighbours(w, automaton) if w < x]
        if out:
            yield pd.DataFrame(out, columns=["scope", "a", "b", "d"])

    cells = split_hot(_shards(words), "shard", most, "word").select("cell", "scope", "word", "stored")
    return scan_groups(cells, "cell", join, "scope string, a string, b string, d int").distinct()


_AUTOMATA: dict[int, LevenshteinAutomaton] = {}


def _automaton(k: int) -> LevenshteinAutomaton:
    if k not in _AUTOMATA:
        _AUTOMATA[k] = LevenshteinAutomaton(k)
    return _AUTOMATA[k]


def slips(a: str, b: str, d: str) -> F.Column:
    """May one of two words ``d`` edits apart be a slip of the other? Two edits from nine letters on, one from six; in
    shorter words, where most other words are as near, only letters swapped, doubled or undoubled."""
    size = F.least(F.length(a), F.length(b))
    swapped = (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    single = r"(.)\1"
    doubled = F.regexp_replace(a, single, "$1") == F.regexp_replace(b, single, "$1")
    return (F.col(d) == 1) & ((size >= 6) | swapped | doubled) | (F.col(d) == 2) & (size >= 9)


def orders(words: list[str]) -> list[str]:
    """The joined word orders a name is stored under."""
    if len(words) <= ORDERED:
        return sorted({"".join(p) for p in permutations(words)})
    return sorted({"".join(words), "".join(sorted(words)), *("".join([*words[i:], *words[:i]]) for i in range(len(words)))})


def _stored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(scope, word, owner) for scope, words, owner in zip(f["scope"], f["words"], f["owner"], strict=True) for word in orders(list(words))]
        yield pd.DataFrame(rows, columns=["scope", "word", "owner"])


def _spellings(nodes: DataFrame, reordered: DataFrame | None = None) -> DataFrame:
    """Roots of the distinct spellings ``scope, word``: ``scope, word, root``.

    Spellings are one name within a number of edits that grows with their length (see ``slips``), however often each is
    used, so that an entity keeps its spellings as a table grows. ``reordered``: ``scope, words, owner`` of names whose
    word order is open, ``owner`` being the ``scope|word`` of the node.
    """
    own = nodes.select("scope", "word", F.concat_ws("|", "scope", "word").alias("owner"))
    words = own if reordered is None else own.unionByName(reordered.mapInPandas(_stored, "scope string, word string, owner string")).distinct()
    words = cut(words)
    first = words.groupBy("scope", "word").agg(F.min("owner").alias("first"))
    near = trie_join(first.select("scope", "word")).filter(slips("a", "b", "d"))
    link = near.join(first.select("scope", F.col("word").alias("a"), F.col("first").alias("x")), ["scope", "a"]).join(first.select("scope", F.col("word").alias("b"), F.col("first").alias("y")), ["scope", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
    # one stored order of several names
    link = link.unionByName(words.join(first, ["scope", "word"]).filter("owner <> first").select(F.col("owner").alias("a"), F.col("first").alias("b")))
    comp = components(link)
    named = own.withColumnRenamed("owner", "node")
    return named.join(comp, "node", "left").select("scope", "word", F.coalesce("root", "node").alias("root"))


def _linked(suppliers: DataFrame, buyers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All read names; organisations and people of full name with their entities; people known by an initial or ambiguous short form."""
    read = cut(spread(parties(suppliers, buyers).filter("trim(name) <> ''"), "pid").mapInPandas(_read, READ))
    lexicon = given_lexicon(read)

    # organisations
    orgs = read.filter("typ = 'org'")
    org_nodes = orgs.select(F.col("biz").alias("scope"), F.col("core").alias("word")).distinct()
    org_orders = orgs.filter("size(words) > 1").select(F.col("biz").alias("scope"), "words", F.concat_ws("|", "biz", "core").alias("owner")).distinct()

    # people: full given names (one reading) and vague ones
    def roles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = Given(lexicon)
        for f in frames:
            rows = []
            for pid, words, comma, email, phone in zip(f["pid"], f["words"], f["comma"], f["email"], f["phone"], strict=True):
                family, names, initial = given.roles(list(words), bool(comma), email)
                if family:
                    listed = any(given.near(w) for w in words if len(w) > 1)
                    rows.append((pid, family, names, initial, phone, email, listed, [w for w in words if len(w) > 1]))
            yield pd.DataFrame(rows, columns=["pid", "family", "names", "initial", "phone", "email", "listed", "words"])

    people = cut(read.filter("typ = 'person'").select("pid", "words", "comma", "email", "phone").mapInPandas(roles, "pid long, family string, names array<string>, initial boolean, phone string, email string, listed boolean, words array<string>"))
    full = people.filter("not initial and size(names) = 1").select("pid", "family", F.col("names")[0].alias("given"), "phone", "email", "listed", "words")
    full_nodes = full.select(F.concat(F.lit("="), F.col("given")).alias("scope"), F.col("family").alias("word")).distinct()
    # no given name of any list: a person or firm nobody has listed, compared as a whole
    full_orders = full.filter("not listed and size(words) > 1").select(F.lit("~").alias("scope"), "words", F.concat(F.lit("="), "given", F.lit("|"), "family").alias("owner")).distinct()

    roots = cut(_spellings(org_nodes.unionByName(full_nodes), org_orders.unionByName(full_orders)))
    org_of = cut(orgs.join(roots, (orgs["biz"] == roots["scope"]) & (orgs["core"] == roots["word"])).select("pid", F.col("root").alias("entity"), "core", "biz", "phone", "email", "tax"))
    full_of = cut(full.join(roots.withColumn("given", F.expr("substring(scope, 2)")).filter("scope like '=%'").withColumnRenamed("word", "family"), ["given", "family"]).select("pid", "given", "family", F.col("root").alias("entity"), "phone", "email"))
    return read, org_of, full_of, people.filter("initial or size(names) <> 1").filter("size(names) > 0")


def linked(suppliers: DataFrame, buyers: DataFrame) -> DataFrame:
    """``pid, entity`` by the trie join and the word orders alone, without initials, ambiguous short forms and acronyms.

    Nulls, blanks, repeated rows and empty tables as in ``entities``.
    """
    _, org_of, full_of, _ = _linked(suppliers, buyers)
    return org_of.select("pid", "entity").unionByName(full_of.select("pid", "entity")).distinct()


def entities(suppliers: DataFrame, buyers: DataFrame) -> DataFrame:
    """``pid, entity`` of every party whose name can be placed; parties with one entity have one name.

    Null and blank names have no row; repeated rows count once; empty tables give an empty result; other columns are
    not read. Very long names are read whole.
    """
    read, org_of, full_of, vague = _linked(suppliers, buyers)
    vague_of = _vague(vague, full_of)
    short_of = _acronyms(read.filter("typ = 'acronym'"), org_of)
    return org_of.select("pid", "entity").unionByName(full_of.select("pid", "entity")).unionByName(vague_of).unionByName(short_of).distinct()


def _vague(vague: DataFrame, full: DataFrame) -> DataFrame:
    """Parties known by an initial or an ambiguous short form: to the one person of that family name they fit.

    Where several fit, a shared e-mail or telephone decides; whoever isn't placed so is one person with those of the same
    initial, or of a short form of the same names, and family name.
    """
    vague = vague.drop("listed", "words")
    asked = vague.select("pid", "family", F.explode("names").alias("name"), "initial", "phone", "email").withColumn("scope", F.substring("name", 1, 1)).withColumn("want", F.when(F.col("initial"), F.lit("")).otherwise(F.col("name")))
    known = full.select(F.substring("given", 1, 1).alias("scope"), F.col("family"), "given", "entity").distinct()
    words = asked.select("scope", F.col("family").alias("word")).unionByName(known.select("scope", F.col("family").alias("word"))).distinct()
    near = cut(trie_join(words))
    both = near.select("scope", "a", "b", "d").unionByName(near.select("scope", F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    # the spellings an asked family name may stand for
    options = asked.select("scope", F.col("family").alias("a")).distinct()
    reach = options.select("scope", "a", F.col("a").alias("b"), F.lit(0).alias("d")).unionByName(options.join(both, ["scope", "a"]))
    fits = reach.join(known.withColumnRenamed("family", "b"), ["scope", "b"]).groupBy("scope", "a", "given", "entity").agg(F.min("d").alias("d"))
    best = cut(
        asked.select("scope", F.col("family").alias("a"), "want").distinct().join(fits, ["scope", "a"])
        .filter((F.col("want") == "") | (F.col("want") == F.col("given")))
    )
    nodes = asked.select("pid", "phone", "email", "scope", F.col("family").alias("a"), "want")
    per_pid = nodes.join(best.groupBy("scope", "a", "want").agg(F.min("d").alias("least"), F.collect_set(F.struct("d", "entity")).alias("all")).select("scope", "a", "want", "least", F.expr("filter(all, x -> x.d = least)").alias("all")), ["scope", "a", "want"])
    cand = per_pid.withColumn("x", F.explode("all")).select("pid", "phone", "email", F.col("x.d").alias("d"), F.col("x.entity").alias("entity"))
    cand = cut(cand.groupBy("pid", "entity").agg(F.min("d").alias("d"), F.first("phone", True).alias("phone"), F.first("email", True).alias("email")))
    low = cand.groupBy("pid").agg(F.min("d").alias("d"))
    cand = cand.join(low, ["pid", "d"])
    # a contact shared with a member tells several apart
    mails = full.filter("email is not null").select("entity", "email").distinct().withColumn("m", F.lit(4))
    phones = full.filter("phone is not null").select("entity", "phone").distinct().withColumn("p", F.lit(1))
    scored = cand.join(mails, ["entity", "email"], "left").join(phones, ["entity", "phone"], "left").withColumn("s", F.coalesce("m", F.lit(0)) + F.coalesce("p", F.lit(0)))
    top = scored.groupBy("pid").agg(F.max("s").alias("s"))
    chosen = scored.join(top, ["pid", "s"]).groupBy("pid").agg(F.count("*").alias("n"), F.min("entity").alias("entity"), F.max("d").alias("d")).filter("n = 1")
    placed = cut(chosen.select("pid", "entity"))
    # nobody fits, or several do: equal initials or short forms among themselves
    said = F.when(F.col("initial"), F.substring(F.col("names")[0], 1, 1)).otherwise(F.concat_ws("/", "names"))
    alone = cut(vague.join(placed.select("pid").distinct(), "pid", "left_anti").select("pid", F.concat(F.lit("-"), said).alias("scope"), F.col("family").alias("word")).distinct())
    own = _spellings(alone.select("scope", "word").distinct())
    return placed.unionByName(alone.join(own, ["scope", "word"]).select("pid", F.col("root").alias("entity")))


def _acronyms(short: DataFrame, orgs: DataFrame) -> DataFrame:
    """Parties known by initials: to the one organisation with those initials that shares their tax id, e-mail or telephone."""
    letters = F.concat(F.substring("core", 1, 1), F.substring(F.split("biz", "/")[0], 1, 1), F.substring(F.split("biz", "/")[1], 1, 1))
    mail_stem = F.regexp_replace(F.regexp_extract("email", "@([a-z0-9-]+)", 1), "-[a-z]+$", "")

    def contacts(df: DataFrame, key: str) -> DataFrame:
        pairs = F.array(
            F.struct(F.lit(1).alias("rank"), F.col("tax").alias("v")), F.struct(F.lit(2).alias("rank"), F.col("email").alias("v")),
            F.struct(F.lit(3).alias("rank"), mail_stem.alias("v")), F.struct(F.lit(4).alias("rank"), F.col("phone").alias("v")),
        )
        return df.withColumn("c", F.explode(pairs)).select(key, "letters", F.col("c.rank").alias("rank"), F.col("c.v").alias("v")).filter("v is not null and v <> ''").distinct()

    known = contacts(orgs.withColumn("letters", letters), "entity")
    known = known.unionByName(orgs.select("entity", letters.alias("letters"), F.lit(3).alias("rank"), F.col("core").alias("v")).distinct())
    only = known.groupBy("letters", "rank", "v").agg(F.min("entity").alias("entity"), F.max("entity").alias("other")).filter("entity = other")
    asked = contacts(short.withColumn("letters", F.col("core")), "pid")
    hit = asked.join(only, ["letters", "rank", "v"]).groupBy("pid").agg(F.min(F.struct("rank", "entity")).alias("x"))
    return hit.select("pid", F.col("x.entity").alias("entity"))


def found(suppliers: DataFrame, buyers: DataFrame) -> DataFrame:
    """``party_id_a, party_id_b``: every pair of party ids of one entity."""
    members = cut(entities(suppliers, buyers))
    return (
        members.select(F.col("pid").alias("party_id_a"), "entity")
        .join(members.select(F.col("pid").alias("party_id_b"), "entity"), "entity")
        .filter("party_id_a < party_id_b")
        .select("party_id_a", "party_id_b")
        .distinct()
    )
