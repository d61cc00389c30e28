"""The same postal address written differently: which address records are one location.

Records are read into components - house number with its letter, street name, kind and direction, unit, town, postcode
- from their fields or, where those are missing, from the running text, with the corpus' own town names telling where
a street ends. Inside blocks of one postcode and of one town (with the towns its postcodes lie in), and of one house
number, a deletion-neighbourhood index on the street name proposes neighbours. Their closure gives buildings; inside
each building incomplete records are assigned to the one complete reading they fit, with the number and the unit as
hard vetoes, by aggregation per known component rather than by comparing all records.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.components import components
from quillstone.llm.fuzzy import LevenshteinAutomaton, Trie, osa
from quillstone.llm.names import fold, trie_join
from quillstone.runtime import cut, parallelism, spread

# fixed values: kinds of street and their abbreviations, in the languages of the five countries
KINDS = {
    "avenue": "av ave aven", "boulevard": "bd blvd boul bvd boulv", "circuit": "cct", "close": "cl", "court": "crt ct", "crescent": "cres cr", "drive": "dr drv",
    "highway": "hwy", "lane": "la ln", "parade": "pde", "parkway": "pky pkwy pwy", "place": "pl", "road": "rd", "rue": "r", "square": "sq", "street": "st str",
    "terrace": "tce ter", "way": "wy", "allee": "all", "chemin": "ch chem", "quai": "", "impasse": "imp",
}
# fixed values: kinds written at the end of one German word
GERMAN_KINDS = {"strasse": "strasse str", "platz": "platz pl", "weg": "weg wg", "allee": "allee", "gasse": "gasse", "ring": "ring"}
# fixed values: directions
DIRECTIONS = {"n": "n", "north": "n", "s": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w", "ne": "ne", "nw": "nw", "se": "se", "sw": "sw"}
# fixed values: countries and their spellings
COUNTRIES = {
    "us": "us usa u.s.a. u.s. united states|united states of america|america", "au": "au aus australia", "gb": "uk gb england|united kingdom|great britain|scotland|wales",
    "fr": "fr france", "de": "de germany deutschland allemagne",
}
_COUNTRY = [
    ("us", r"u\.?s\.?a\.?|u\.s\.?|us|united states(?: of america)?"), ("au", r"aus?|australia"), ("gb", r"u\.?k\.?|gb|england|united kingdom|great britain|scotland|wales"),
    ("fr", r"fr|france"), ("de", r"de|germany|deutschland"),
]
# fixed values: states
STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "fl": "florida", "ga": "georgia",
    "hi": "hawaii", "ia": "iowa", "id": "idaho", "il": "illinois", "in": "indiana", "ks": "kansas", "ky": "kentucky", "ma": "massachusetts", "md": "maryland",
    "me": "maine", "mi": "michigan", "mn": "minnesota", "mo": "missouri", "ms": "mississippi", "mt": "montana", "nc": "north carolina", "nd": "north dakota",
    "ne": "nebraska", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "nv": "nevada", "ny": "new york", "oh": "ohio", "ok": "oklahoma", "or": "oregon",
    "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "va": "virginia",
    "vt": "vermont", "wa": "washington", "wi": "wisconsin", "wv": "west virginia", "wy": "wyoming", "nsw": "new south wales", "vic": "victoria", "qld": "queensland",
    "sa": "south australia", "tas": "tasmania", "nt": "northern territory", "act": "australian capital territory",
}
_STATE_OF = {full: ab for ab, full in STATES.items()} | {ab: ab for ab in STATES}
_KIND_OF = {a: k for k, abbr in KINDS.items() for a in (k, *abbr.split())}
_LEAD = re.compile(r"^(?:(?:attn\.?:?|attention:?|c\s*/\s*o|z\.?\s?hd\.?)\s*(?:accounts?(?: payable)?|front desk|reception|the manager|goods inwards?|stores)?|goods inwards?|head office|hq|front desk|warehouse|reception)\b[\s,:;-]*")
_UNIT_WORD = r"(?:unit|apt|apartment|suite|ste|flat|appt|whg|level|lvl|shop|room|rm)"
_UNIT = re.compile(rf"(?:(?<![a-z]){_UNIT_WORD}(?![a-z])\.?\s*#?\s*|#\s*)([0-9]+[a-z]?|[a-z])(?![a-z0-9])(?:\s*/\s*(?=[0-9]))?")
_UNIT_SLASH = re.compile(r"(?<![a-z0-9/])u?\s?([0-9]+[a-z]?)\s?/\s?(?=[0-9]+[a-z]?\s)")
# the blank may have slipped
_POST_GB = re.compile(r"(?<![a-z0-9])([a-z]{1,2}[0-9]{1,3}[a-z]?)\s?([0-9]{0,2}[a-z]{2})(?![a-z0-9])")
_POST_5 = re.compile(r"(?<![0-9a-z])([0-9]{5})(?:-[0-9]{4})?(?![0-9a-z])")
_POST_4 = re.compile(r"(?<![0-9a-z])([0-9]{4})(?![0-9a-z])")
_SEPARATED = re.compile(r"\n|;|,|\s-\s|\s–\s|\|")


def _letters(text: str) -> str:
    return re.sub(r"[^a-z]", "", text)


class Towns:
    """The corpus' town names; finds one at either end of a token list, small slips included."""

    def __init__(self, names: Iterable[str]):
        self.known: dict[str, str] = {}
        for n in names:
            self.known.setdefault(_letters(fold(n)), n)
        self.trie = Trie(self.known)
        self.automaton = LevenshteinAutomaton(2)
        self.memo: dict[str, str | None] = {}
        self.longest = max((len(re.findall(r"[a-z]+", n)) for n in self.known.values()), default=1)

    def near(self, text: str) -> str | None:
        """The known town a text is, or is a slip of, in letters only."""
        key = _letters(text)
        if key in self.known:
            return key
        if key not in self.memo:
            best = None
            if len(key) >= 5:
                bound = 1 if len(key) < 7 else 2
                hits = sorted((d, w) for w, d in self.trie.neighbours(key, self.automaton) if d <= bound)
                if hits and (len(hits) == 1 or hits[1][0] > hits[0][0]):
                    best = hits[0][1]
            self.memo[key] = best
        return self.memo[key]

    def at_end(self, tokens: list[str]) -> int:
        """How many tokens at the end are a town; 0 for none."""
        for exact in (True, False):
            for n in range(min(self.longest + 1, len(tokens)), 0, -1):
                key = _letters("".join(tokens[-n:]))
                if key and (key in self.known if exact else self.near(key) is not None):
                    return n
        return 0

    def at_start(self, tokens: list[str]) -> int:
        for exact in (True, False):
            for n in range(min(self.longest + 1, len(tokens)), 0, -1):
                key = _letters("".join(tokens[:n]))
                if key and (key in self.known if exact else self.near(key) is not None):
                    return n
        return 0


def read_street(text: str, towns: Towns | None = None) -> dict:
    """House number, name, kind, direction and unit of a street line, and what stands around it (``rest``)."""
    t = " " + fold(text) + " "
    t = re.sub(r"\s+", " ", t).strip()
    while (m := _LEAD.match(t)) and m.end() > 0:
        t = t[m.end() :]
    unit = None
    m = _UNIT.search(t) or _UNIT_SLASH.search(t)
    if m:
        unit = m.group(1)
        t = (t[: m.start()] + " , " + t[m.end() :]).strip(" ,")
    number = name = kind = direction = None
    rest: list[str] = []
    german = re.search(r"(?<![a-z])([a-z][a-z' -]*?)[\s-]?(strasse|str|platz|pl|weg|wg|allee|gasse|ring)\b\.?\s*,?\s*([0-9]+)\s?([a-z])?(?![a-z0-9])", t)
    m = re.match(r"^[\s,]*([0-9]+)\s?([a-z])?(?=[\s,])[\s,]*(.*)$", t)
    if m:
        number = m.group(1) + (m.group(2) or "")
        body = m.group(3)
        if m.group(2) and (m.group(2) in DIRECTIONS or m.group(2) == "r") and " " in t[m.start(2) - 1 : m.start(2)]:
            # "16 W Speskrun Av", "6 R Liexflaund": a word of its own
            number, body = m.group(1), m.group(2) + " " + m.group(3)
        words = re.findall(r"[a-z']+|,", body.replace(".", " ").replace("-", ""))
        split = words.index(",") if "," in words else None
        if split == 0:
            words = words[1:]
            split = words.index(",") if "," in words else None
        head, rest = (words[:split], [w for w in words[split:] if w != ","]) if split is not None else (words, [])
        name, kind, direction, extra = _name_kind(head, towns)
        rest = extra + rest
    elif german:
        number = german.group(3) + (german.group(4) or "")
        kind = {"str": "strasse", "pl": "platz", "wg": "weg"}.get(german.group(2), german.group(2))
        before = re.findall(r"[a-z]+", german.group(1))
        lead = towns.at_start(before) if towns and len(before) > 1 else 0
        if lead and lead < len(before):
            rest = before[:lead]
            before = before[lead:]
        name = "".join(before)
        rest = rest + re.findall(r"[a-z]+", t[: german.start()]) + re.findall(r"[a-z]+", t[german.end() :])
    return {"number": number, "name": name or None, "kind": kind, "direction": direction, "unit": unit, "rest": rest}


def _name_kind(words: list[str], towns: Towns | None) -> tuple[str, str | None, str | None, list[str]]:
    direction = kind = None
    rest: list[str] = []
    w = list(words)
    if len(w) > 1 and w[0] in DIRECTIONS:
        direction, w = DIRECTIONS[w[0]], w[1:]
    if len(w) > 1 and w[0] in ("rue", "r", "avenue", "av", "ave", "boulevard", "bd", "boul", "chemin", "quai", "impasse", "allee", "place", "pl"):
        # kind first
        kind, w = _KIND_OF.get(w[0], w[0]), w[1:]
        n = towns.at_end(w) if towns and len(w) > 1 else 0
        if n and n < len(w):
            w, rest = w[:-n], w[-n:]
        return "".join(w), kind, direction, rest
    at = [i for i, x in enumerate(w) if i and x in _KIND_OF and not (x in ("r", "la") and i + 1 == len(w) and len(w) == 1)]
    if at:
        i = at[0]
        kind = _KIND_OF[w[i]]
        tail = w[i + 1 :]
        if tail and tail[0] in DIRECTIONS and direction is None:
            direction, tail = DIRECTIONS[tail[0]], tail[1:]
        return "".join(w[:i]), kind, direction, tail
    # a kind with a slip in it
    for i in range(1, len(w)):
        if len(w[i]) >= 4 and (k := next((k for k in KINDS if len(k) >= 4 and osa(w[i], k, 1) <= 1), None)):
            tail = w[i + 1 :]
            if tail and tail[0] in DIRECTIONS and direction is None:
                direction, tail = DIRECTIONS[tail[0]], tail[1:]
            return "".join(w[:i]), k, direction, tail
    n = towns.at_end(w) if towns and len(w) > 1 else 0
    if n and n < len(w):
        w, rest = w[:-n], w[-n:]
    if len(w) > 1 and w[-1] in DIRECTIONS and direction is None:
        direction, w = DIRECTIONS[w[-1]], w[:-1]
    return "".join(w), kind, direction, rest


def _postcode(text: str | None) -> str | None:
    t = fold(text or "").strip()
    if not t:
        return None
    if m := _POST_GB.search(t):
        return m.group(1) + m.group(2)
    if m := _POST_5.search(t):
        return m.group(1)
    if m := _POST_4.search(t):
        return m.group(1)
    return re.sub(r"[^a-z0-9]", "", t) or None


def _state(word: str) -> str | None:
    return _STATE_OF.get(word)


def _town_first(text: str, rest: str, towns: Towns | None) -> bool:
    """Is what stands before ``rest`` a town, listed or not: does only the rest read as a street?"""
    if read_street(text, towns)["number"] is not None:
        return False
    own = read_street(rest, towns)
    return bool(own["number"] and own["name"] and own["kind"])


def read_full(text: str, towns: Towns | None = None) -> dict:
    """All components of an address in running text, in whatever order."""
    t = re.sub(r"[^\S\n]+", " ", fold(text)).strip()
    while (m := _LEAD.match(t)) and m.end() > 0:
        t = t[m.end() :].lstrip()
    for _, pattern in _COUNTRY:
        m = re.search(rf"(?:^|[\s,;-])(?:{pattern})[\s.]*$", t)
        if m and m.start() > 0:
            t = t[: m.start()].rstrip(" ,;-\n")
            break
    post = None
    for pattern in (_POST_GB, _POST_5):
        hits = list(pattern.finditer(t))
        if hits:
            m = hits[-1]
            post = m.group(1) + (m.group(2) if pattern is _POST_GB else "")
            t = t[: m.start()] + " ; " + t[m.end() :]
            break
    else:
        hits = [m for m in _POST_4.finditer(t)]
        # a house number starts the street; a postcode ends the place
        hits = [m for m in hits if m.start() > 0 and (re.search(r"[0-9]", t[: m.start()]) or re.search(r"[0-9]", t[m.end() :])) and not re.match(r"\s*[a-z]*\s*(?:[a-z]\.?\s)?[a-z]+ (?:street|st|road|rd|drive|dr)\b", t[m.end() :])]
        if hits:
            m = hits[-1]
            post = m.group(1)
            t = t[: m.start()] + " ; " + t[m.end() :]
    state = None
    out: list[str] = []
    for piece in _SEPARATED.split(t):
        p = piece.strip(" .-")
        if not p:
            continue
        for full, ab in _STATE_OF.items():
            if p == full:
                state, p = ab, ""
                break
            if p.endswith(" " + full) and not re.search(r"[0-9]\s+" + re.escape(full) + "$", p):
                state, p = ab, p[: -len(full) - 1].strip()
                break
        if p:
            out.append(p)
    pieces = out
    street: dict | None = None
    place: list[str] = []
    n = 0
    while n < len(pieces):
        p = pieces[n]
        if street is None and re.search(r"[0-9]", p):
            lead = re.match(r"^([a-z' -]+?)\s+(?=[0-9]|u[0-9]+\s?/|unit |apt)", p)
            if lead:
                words = lead.group(1).split()
                for k in (3, 2, 1):
                    if len(words) > k and _state(" ".join(words[-k:])):
                        state = state or _state(" ".join(words[-k:]))
                        del words[-k:]
                        break
                if (towns and towns.at_start(words) == len(words)) or _town_first(p, p[lead.end() :], towns):
                    place.append(" ".join(words))
                    p = p[lead.end() :]
            # a lone number or unit goes with the next piece
            bare = _UNIT.sub("", _UNIT_SLASH.sub("", p + " ")).strip(" ,/")
            if (not bare or re.fullmatch(r"[0-9]+\s?[a-z]?", bare)) and n + 1 < len(pieces):
                pieces[n + 1] = p + (" , " if not bare else " ") + pieces[n + 1]
                n += 1
                continue
            street = read_street(p, towns)
            if street["number"] is None:
                place += [p] if street["name"] is None else []
                street = street if street["unit"] else None
            elif street["rest"]:
                place.append(" ".join(street["rest"]))
        elif street is not None and _UNIT.fullmatch(p.strip()):
            street["unit"] = street["unit"] or _UNIT.fullmatch(p.strip()).group(1)
        elif street is not None and street["number"] is None and re.search(r"[0-9]", p):
            more = read_street(p, towns)
            more["unit"] = more["unit"] or street["unit"]
            street = more
            if street["rest"]:
                place.append(" ".join(street["rest"]))
        else:
            if street is not None and (m := _UNIT.search(p)):
                street["unit"] = street["unit"] or m.group(1)
                p = (p[: m.start()] + " " + p[m.end() :]).strip()
            if p:
                place.append(p)
        n += 1
    town = None
    for p in place:
        words = re.findall(r"[a-z]+", p)
        full_state = _state(" ".join(words))
        if full_state:
            state = state or full_state
            continue
        key = "".join(words)
        if len(key) >= 3:
            if towns and towns.near(key):
                town = key
                break
            town = town or key
    street = street or {"number": None, "name": None, "kind": None, "direction": None, "unit": None, "rest": []}
    return {**street, "town": town, "state": state, "post": post}


def read_address(street: str | None, city: str | None, state: str | None, post: str | None, full: str | None, towns: Towns | None = None) -> dict | None:
    """The components of a record, from its fields first and its running text for what they leave out; ``None`` without a street."""
    got = read_full(full, towns) if full and full.strip() else None
    if street and street.strip():
        own = read_street(street, towns)
        if own["number"] and own["name"]:
            merged = {k: own[k] for k in ("number", "name", "kind", "direction", "unit")}
            if got and got["number"] == own["number"]:
                for k in ("kind", "direction", "unit"):
                    merged[k] = merged[k] or got[k]
            rest = "".join(own["rest"])
            got = {**merged, "town": (got or {}).get("town") or rest or None, "post": (got or {}).get("post"), "state": (got or {}).get("state")}
    if not got or not got["number"] or not got["name"]:
        return None
    if city and _letters(fold(city)):
        got["town"] = _letters(fold(city))
    if post and post.strip():
        got["post"] = _postcode(post)
    if got["town"]:
        got["town"] = (towns.near(got["town"]) if towns else None) or got["town"]
    got["number"] = got["number"].lstrip("0") or "0"
    return got


# ---------------------------------------------------------------------------------------------------------------
# Spark

READ = "address_id long, town string, known boolean, post string, number string, name string, kind string, direction string, unit string"
#: a spelling is a slip of a neighbour that this many times as many records use
TOWN_SLIP = 8
FIELDS = ("street", "city", "state", "postal_code", "full_address")


def town_names(addresses: DataFrame) -> list[str]:
    """The corpus' towns: every city spelling but the slips of another, by the same rule whatever the table's size.

    A slip lies within ``Towns.near``'s reach of a spelling that ``TOWN_SLIP`` times as many records use, or is used once
    and has a repeated neighbour. Counts are compared by a join; what stays is a name for each town, and those that no
    other is near.
    """
    cities = addresses.select("address_id", F.lower(F.trim("city")).alias("city")).filter("city <> ''")
    counted = cities.groupBy("city").agg(F.countDistinct("address_id").alias("n"))

    def lettered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"word": [_letters(fold(c)) for c in f["city"]], "n": f["n"], "city": f["city"]})

    words = cut(counted.mapInPandas(lettered, "word string, n long, city string").filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"), F.min("city").alias("city")))
    near = trie_join(words.select(F.lit("town").alias("scope"), "word"))
    both = near.select("a", "b", "d").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    reach = F.when(F.length("a") < 5, 0).when(F.length("a") < 7, 1).otherwise(2)
    beside = both.filter(F.col("d") <= reach).join(words.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b").groupBy(F.col("a").alias("word")).agg(F.max("nb").alias("nb"))
    kept = words.join(beside, "word", "left").filter(F.expr(f"nb is null or not (nb >= {TOWN_SLIP} * n or (n = 1 and nb > 1))"))
    return sorted(r[0] for r in kept.select("city").collect())


def components_of(addresses: DataFrame) -> DataFrame:
    """The components of every record that has a street; the town of a record without one comes from its postcode's most usual town."""
    names = [fold(n) for n in town_names(addresses)]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        towns = Towns(names)
        for f in frames:
            rows = []
            for i, street, city, state, post, full in zip(f["address_id"], *[f[c] for c in FIELDS], strict=True):
                a = read_address(street, city, state, post, full, towns)
                if a:
                    rows.append((i, a["town"] or "", a["town"] in towns.known, a["post"] or "", a["number"], a["name"], a["kind"] or "", a["direction"] or "", a["unit"] or ""))
            yield pd.DataFrame(rows, columns=["address_id", "town", "known", "post", "number", "name", "kind", "direction", "unit"])

    rows = addresses.filter("address_id is not null").select(F.col("address_id").cast("long"), *FIELDS).distinct()
    got = cut(spread(rows, "address_id").mapInPandas(read, READ))
    usual = got.filter("known and post <> ''").groupBy("post", "town").count().groupBy("post").agg(F.max(F.struct("count", "town")).alias("x")).select("post", F.col("x.town").alias("usual"))
    return got.join(usual, "post", "left").withColumn("town", F.when(F.col("town") != "", F.col("town")).otherwise(F.coalesce("usual", "town"))).withColumn("near", F.coalesce("usual", F.lit(""))).drop("usual", "known")


def deletions(word: str, k: int = 2) -> set[str]:
    """The word with up to ``k`` letters left out: two words within ``k`` edits share one of these."""
    out = {word}
    level = {word}
    for _ in range(k):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return out


#: street names up to this length are indexed by deletions, from two letters fewer on by pieces of twelve letters
_DELETION_TO = 36


def index_keys(name: str) -> set[str]:
    """Keys of which two names within two edits share one; their number grows with the length, not its square, beyond 36 letters."""
    out: set[str] = set()
    if len(name) <= _DELETION_TO:
        out |= deletions(name)
    if len(name) >= _DELETION_TO - 2:
        # two edits leave one of first, last and some middle piece whole
        out |= {"#" + name[i : i + 12] for i in range(len(name) - 11)}
    return out


def _index(nodes: DataFrame) -> DataFrame:
    """``key, node, town, name``: a row for each block of a node - town, postcode, locality of the postcode - and each deletion of its street name."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for node, town, post, near, number, name in zip(f["node"], f["town"], f["post"], f["near"], f["number"], f["name"], strict=True):
                blocks = {f"t:{x}" for x in (town, near) if x} | ({f"p:{post}"} if post else set())
                for v in index_keys(name):
                    rows += [(f"{b}|{number}|{v}", node, town, name) for b in blocks]
            yield pd.DataFrame(rows, columns=["key", "node", "town", "name"])

    return nodes.mapInPandas(run, "key string, node string, town string, name string").withColumn("key", F.xxhash64("key"))


def _links(nodes: DataFrame) -> DataFrame:
    """Nodes of one block and number whose street names are within two edits, and whose towns don't part them."""
    rows = _index(spread(nodes, "node"))

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = LevenshteinAutomaton(2)

        def close(held: list[tuple]) -> list[tuple]:
            by_name: dict[str, list[tuple[str, str]]] = {}
            for node, town, name in held:
                by_name.setdefault(name, []).append((node, town))
            out = []
            for name, own in by_name.items():
                # one name: a star for each town is enough for the closure, then its towns with each other
                first = _by_town(own)
                out += [(node, first[town]) for node, town in own if node != first[town]]
                towns = list(first)
                out += [(first[s], first[t]) for i, s in enumerate(towns) for t in towns[:i] if _one_town(s, t)]
            if len(by_name) > 1:
                trie = Trie(by_name)
                for name, own in by_name.items():
                    for other, _ in trie.neighbours(name, automaton):
                        if name < other:
                            # each name's nodes are chained town by town above: one link for each pair of its towns
                            out += [(x, y) for t1, x in _by_town(own).items() for t2, y in _by_town(by_name[other]).items() if _one_town(t1, t2)]
            return out

        last, held = None, []
        for f in frames:
            out: list[tuple] = []
            for key, node, town, name in zip(f["key"], f["node"], f["town"], f["name"], strict=True):
                if key != last:
                    out += close(held)
                    last, held = key, []
                held.append((node, town, name))
            yield pd.DataFrame(out, columns=["a", "b"])
        yield pd.DataFrame(close(held), columns=["a", "b"])

    return rows.repartition(parallelism(nodes.sparkSession), "key").sortWithinPartitions("key", "name", "town", "node").mapInPandas(pairs, "a string, b string").distinct()


def _by_town(own: list[tuple[str, str]]) -> dict[str, str]:
    """One node for each town of a name's nodes."""
    first: dict[str, str] = {}
    for node, town in own:
        first.setdefault(town, node)
    return first


def _one_town(a: str, b: str) -> bool:
    return a == b or not a or not b or osa(a, b, 2) <= 2


def _assign(combos: DataFrame, target: str, others: tuple[str, ...]) -> DataFrame:
    """Fills ``target`` where a record leaves it out: from the one value its building has beside the same other components.

    Tried from all other components down to none; where several values fit, it stays empty.
    """
    subsets = [others, *((o,) for o in others), ()] if len(others) > 1 else [others, ()]
    if target != "kind":
        # another unit or direction parts two records whatever else they share
        subsets = subsets[:1]
    def keys(cols: tuple[str, ...], rank: int):
        return F.struct(F.lit(rank).alias("rank"), F.concat_ws("\u0001", *[F.col(c) for c in cols]).alias("k") if cols else F.lit("").alias("k"))

    probe = F.explode(F.array(*[keys(c, r) for r, c in enumerate(subsets)]))
    known = combos.filter(F.col(target) != "").withColumn("x", probe).groupBy("building", "x").agg(F.min(target).alias("lo"), F.max(target).alias("hi")).filter("lo = hi")
    asked = combos.filter(F.col(target) == "").withColumn("x", probe)
    got = asked.join(known.select("building", "x", "lo"), ["building", "x"]).groupBy("building", "kind", "direction", "unit").agg(F.min(F.struct("x.rank", "lo")).alias("g"))
    return combos.join(got, ["building", "kind", "direction", "unit"], "left").withColumn(f"{target}_", F.coalesce("g.lo", target)).drop("g")


def locations(addresses: DataFrame) -> DataFrame:
    """``address_id, location`` of every record with a street.

    Records without a street, with a null id, or that only point elsewhere have no row; repeated rows count once; an
    empty table gives an empty result; other columns are not read.
    """
    read = cut(components_of(addresses))
    keyed = read.withColumn("node", F.concat_ws("|", "town", "post", "number", "name"))
    nodes = keyed.select("node", "town", "post", "near", "number", "name").distinct()
    comp = components(_links(nodes))
    built = cut(keyed.join(comp, "node", "left").withColumn("building", F.coalesce("root", "node")).select("address_id", "building", "kind", "direction", "unit"))
    combos = built.select("building", "kind", "direction", "unit").distinct()
    step = _assign(combos, "kind", ("direction", "unit"))
    full = step.select("building", F.col("kind").alias("kind0"), F.col("kind_").alias("kind"), "direction", "unit")
    step = _assign(full.select("building", "kind", "direction", "unit").distinct(), "direction", ("kind", "unit")).select("building", "kind", "direction", "unit", "direction_")
    full = full.join(step, ["building", "kind", "direction", "unit"]).select("building", "kind0", "kind", F.col("direction").alias("direction0"), F.col("direction_").alias("direction"), "unit")
    step = _assign(full.select("building", "kind", "direction", "unit").distinct(), "unit", ("kind", "direction")).select("building", "kind", "direction", "unit", "unit_")
    full = full.join(step, ["building", "kind", "direction", "unit"]).select("building", "kind0", "direction0", F.col("unit").alias("unit0"), F.concat_ws("|", "building", "kind", "direction", "unit_").alias("location"))
    return (
        built.select("address_id", "building", F.col("kind").alias("kind0"), F.col("direction").alias("direction0"), F.col("unit").alias("unit0"))
        .join(full, ["building", "kind0", "direction0", "unit0"])
        .select("address_id", "location")
        .distinct()
    )


def found(addresses: DataFrame) -> DataFrame:
    """``address_id_a, address_id_b``: every pair of address ids of one location."""
    members = cut(locations(addresses))
    return (
        members.select(F.col("address_id").alias("address_id_a"), "location")
        .join(members.select(F.col("address_id").alias("address_id_b"), "location"), "location")
        .filter("address_id_a < address_id_b")
        .select("address_id_a", "address_id_b")
        .distinct()
    )
