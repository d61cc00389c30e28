"""Noise in text from scanned pages: running headers and page numbers, words broken at line ends, misrecognised characters.

A lexicon of the corpus' own words with their frequencies is counted over all texts. A symmetric-delete index over it
generates correction candidates for every other word; a weighted edit distance with character confusions, the
frequency ratio and the neighbouring words pick the repair. Words broken by the layout are joined where the joined
form outweighs the hyphenated one. Lines that are only furniture are told by their form, and by recurring through the
document. The same analysis yields the repaired text and the list of finds.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.fuzzy import osa
from quillstone.llm.pii import _EMAIL
from quillstone.llm.places import deletions
from quillstone.runtime import cut, spread

MARKS = "-‐­¬"
# fixed values: what a scanner reads for what stands on the page
CONFUSIONS = {
    "a": "o à", "b": "h 6", "c": "e o", "d": "cl ol", "e": "c é", "f": "t", "g": "q 9", "h": "b li", "i": "l 1 j I", "l": "i 1 t", "m": "rn nn in", "n": "ri u h", "o": "a 0 c e", "q": "g", "r": "n",
    "s": "5", "t": "f l", "u": "n ii v ll", "v": "u y", "w": "vv", "y": "v", "z": "2", "é": "e 6 è", "è": "e é", "ä": "a", "ö": "o", "ü": "u ii", "ß": "b B", "k": "lc h", "p": "n", "x": "z",
}
_READ: dict[str, list[str]] = {}
for _true, _seen in CONFUSIONS.items():
    for _s in _seen.split():
        _READ.setdefault(_s.lower(), []).append(_true)
# pairs work in both directions among letters
for _true, _seen in list(CONFUSIONS.items()):
    for _s in _seen.split():
        if _s.isalpha() and len(_s) == 1:
            _READ.setdefault(_true, []).append(_s.lower())
_READ.setdefault("rn", []).append("m")
_READ.setdefault("m", []).extend(["rn", "nn", "in", "ni"])
_READ.setdefault("h", []).append("li")
_READ.setdefault("ii", []).append("n")
_READ.setdefault("ri", []).append("n")
_READ.setdefault("n", []).append("ri")
_READ.setdefault("cl", []).append("d")
_READ.setdefault("d", []).append("cl")
_READ.setdefault("vv", []).append("w")
_READ.setdefault("0", []).append("o")
_READ.setdefault("1", []).extend(["l", "i"])
_READ.setdefault("8", []).append("b")

CONFUSED, OTHER = 0.35, 1.0
#: a repair may cost so much: two confusions, or one other edit never
MOST_COST = 0.75

_D = r"[0-9OolI|]"
_N = rf"{_D}{{1,3}}"
_PAGE = (
    rf"(?:-\s?{_N}\s?-|\[\s?{_N}\s?\]|\(\s?{_N}\s?\)|{_N}\s?/\s?{_N}|{_N}\s(?:of|von|sur)\s{_N}"
    rf"|(?:pages?|pg|p|seite|s|blatt|sheet|bl|folio)\.?\s?{_N}(?:\s?(?:of|von|sur|/|de)\s?{_N})?)"
)
_PAGE_ONLY = re.compile(rf"^\s*(?:{_PAGE}|{_N})\s*$", re.I)
_PAGE_LABEL = re.compile(rf"^\s*{_PAGE}\s*$", re.I)
_PAGE_END = re.compile(rf"(?:\s{{2,}}|\s+-\s+|\s*\|\s*)(?:{_PAGE}|{_N})\s*$", re.I)
_TURN = re.compile(r"^\W*(?:\(?\s?(?:cont(?:inued|'?d)?\.?|continues?)(?:\s+(?:on|from|over(?:leaf)?))?\b.{0,24}|please turn over|p\.?t\.?o\.?|carried (?:forward|over).{0,20}|brought forward.{0,20}|fortsetzung.{0,24}|suite (?:à la )?page.{0,8}|suite au verso|übertrag.{0,20}|à reporter.{0,20}|bitte wenden|t\.?s\.?v\.?p\.?)\s?\)?\W*$", re.I)
_CODE = r"[A-Z]{2,4}-[0-9OolIS]{3,6}"
_CODED = re.compile(rf"^\s*(?:{_CODE}\s{{0,2}}[/|]\s*\S.*|{_CODE}\s{{2,}}\S.*|\S.*\s{{2,}}{_CODE}(?:\s+r[ec]v\.?\s?{_D}+)?)\s*$")
_SPLIT = re.compile(r"\S(?:\s*\|\s*|\s{3,})(?=\S)")
_MONEY = re.compile(r"[0-9OolISB][0-9,OolISB]*[.,][0-9OolISB]{2}\s*$")
_WORD = re.compile(r"[^\W\d_][^\W_]*|[0-9]+[^\W\d_]{2,}[^\W_]*")
_TOKEN = re.compile(r"\S+")
# a digit and, without a blank between, a sign that may be read for one
_MIXED = re.compile(r"[0-9][^\s]*[OolIS|]|[OolIS|][^\s]*[0-9]")


class Lexicon:
    """Words, hyphenated words and pairs of the corpus with their counts."""

    def __init__(self, words: dict[str, int], hyphenated: dict[str, int], pairs: dict[str, int], grams: dict[str, int] | None = None, least: int = 3):
        self.words, self.hyphenated, self.pairs, self.grams = words, hyphenated, pairs, grams or {}
        self.first_parts = {k.split("-")[0] for k, n in hyphenated.items() if n >= least}
        self.index: dict[str, list[str]] = {}
        self.least = least
        self.longest = max((len(w) for w, n in words.items() if n >= least), default=0)
        for w, n in words.items():
            if n >= least and len(w) >= 3 and w.isalpha():
                for v in deletions(w, 2 if len(w) >= 5 else 1):
                    self.index.setdefault(v, []).append(w)
        self.memo: dict[str, list[tuple[float, int, str]]] = {}
        self.odd_memo: dict[str, str] = {}
        self.settled_memo: dict[str, bool] = {}
        # every use of a word has one run that starts it
        uses = sum(n for g, n in self.grams.items() if g[0] == "^")
        self.usual, self.floor = ODD_USUAL * uses, max(1.0, ODD_FLOOR * uses)

    def candidates(self, token: str) -> list[tuple[float, int, str]]:
        """Lexicon words a token may be a misreading of: ``(cost, -count, word)``, cheapest first."""
        hit = self.memo.get(token)
        if hit is None and len(token) > self.longest + 2:
            # farther from every word than two letters
            hit = []
        if hit is None:
            seen = {w for v in deletions(token, 2 if len(token) >= 5 else 1) for w in self.index.get(v, ())}
            hit = []
            for w in seen:
                if w != token:
                    c = misread_cost(token, w)
                    if c <= MOST_COST:
                        hit.append((c, -self.words[w], w))
            hit.sort()
            self.memo[token] = hit
        return hit

    def settled(self, low: str) -> bool:
        """Does a lower-case word stand as it is, whatever its neighbours? True of nearly all words, and remembered."""
        hit = self.settled_memo.get(low)
        if hit is None:
            hit = self.settled_memo[low] = not (_suspect(low) and self._mendable(low))
        return hit

    def _mendable(self, low: str) -> bool:
        own = self.words.get(low, 0)
        least = 1 if not low.isalpha() and any(ch.isdigit() for ch in low) else 20 if len(low) >= 5 else 60
        # neighbours can make a candidate five times as likely at most
        if any(-n >= self.least and -n >= least / 5 * max(own, 1) for _, n, _ in self.candidates(low)):
            return True
        return own < self.least and len(low) >= 7 and self.odd(low) is not None

    def repair(self, token: str, before: str = "", after: str = "") -> str | None:
        """The word a token is a misreading of, or ``None``."""
        low = token.lower()
        own = self.words.get(low, 0)
        digits = any(ch.isdigit() for ch in low)
        if len(low) < 3 and not digits:
            return None
        best = None
        for cost, n, word in self.candidates(low):
            n = -n
            ratio = 20 if len(low) >= 5 else 60
            own = max(own, 1)
            if cost > 0.5:
                ratio *= 3
            if digits:
                ratio = 1
            context = self.pairs.get(f"{before} {word}", 0) + self.pairs.get(f"{word} {after}", 0)
            against = self.pairs.get(f"{before} {low}", 0) + self.pairs.get(f"{low} {after}", 0)
            if context > 10 * (against + 1):
                ratio /= 5
            elif against > context and own >= self.least:
                continue
            if n >= self.least and n >= ratio * own:
                score = (cost - 0.02 * math.log(n + 1) - 0.05 * math.log(context + 1), word)
                best = min(best, score) if best else score
        if best:
            return best[1]
        return self.odd(low) if own < self.least and len(low) >= 7 else None

    def odd(self, token: str) -> str | None:
        """A name put right by its letters: one confusion whose undoing turns rare letter runs into usual ones.

        Rare and usual are judged by the runs' shares of all word uses and by their ratio, so that a larger corpus of
        the same kind gives the same answer.
        """
        if not self.grams:
            return None
        hit = self.odd_memo.get(token)
        if hit is not None:
            return hit or None
        best = (0.0, "")
        runs = _runs(token)
        for i in range(len(token)):
            for size in (1, 2):
                for true in _READ.get(token[i : i + size], ()) if i + size <= len(token) else ():
                    now = min(self.grams.get(g, 0) for g in runs[max(0, i - 2) : i + size + 1]) + self.floor
                    # the runs over the changed letters alone
                    lead, tail = token[i - 3 : i] if i >= 3 else "^" + token[:i], (token[i + size : i + size + 3] + "$")[:3]
                    around = lead + true + tail
                    then = min((self.grams.get(around[k : k + 4], 0) for k in range(len(around) - 3)), default=0)
                    if then >= self.usual and then >= ODD_RATIO * now:
                        best = max(best, (math.log(then) - math.log(now), token[:i] + true + token[i + size :]))
        self.odd_memo[token] = best[1]
        return best[1] or None


#: share of the word uses from which a run of letters is usual, what is added to a run's uses as a share, and how many times the uses the undone form must have
ODD_USUAL, ODD_FLOOR, ODD_RATIO = 5e-5, 1e-6, 50


def _suspect(token: str) -> bool:
    if not token.isalpha() and any(ch.isdigit() for ch in token):
        return len(token) >= 3 and sum(ch.isalpha() for ch in token) >= 2
    return len(token) >= 3


def _runs(token: str) -> list[str]:
    """The runs of four letters of a word, its ends marked."""
    t = f"^{token}$"
    return [t[i : i + 4] for i in range(len(t) - 3)]


def misread_cost(seen: str, true: str) -> float:
    """Weighted edit distance from what stands there to what should: confusions are cheap, also of one letter for two."""
    n, m = len(seen), len(true)
    if abs(n - m) > 2:
        return 9.0
    d = [[9.0] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            here = d[i][j]
            if here > MOST_COST:
                continue
            if i < n and j < m:
                if seen[i] == true[j]:
                    d[i + 1][j + 1] = min(d[i + 1][j + 1], here)
                elif true[j] in _READ.get(seen[i], ()):
                    d[i + 1][j + 1] = min(d[i + 1][j + 1], here + CONFUSED)
            if i + 1 < n and j < m and true[j] in _READ.get(seen[i : i + 2], ()):
                d[i + 2][j + 1] = min(d[i + 2][j + 1], here + CONFUSED)
            if i < n and j + 1 < m and true[j : j + 2] in _READ.get(seen[i], ()):
                d[i + 1][j + 2] = min(d[i + 1][j + 2], here + CONFUSED)
            if i + 1 < n and j + 1 < m and true[j : j + 2] in _READ.get(seen[i : i + 2], ()):
                d[i + 2][j + 2] = min(d[i + 2][j + 2], here + CONFUSED)
    return d[n][m]


def is_bill(lines: list[str]) -> bool:
    return sum(_MONEY.search(x) is not None for x in lines) >= 3


def _key(line: str) -> str:
    """A running line without its page label, digits and blanks."""
    return re.sub(r"[\W\d_]+", "", _PAGE_END.sub("", line)).lower()


def furniture(lines: list[str]) -> set[int]:
    """The lines that are only running header, footer, page number or page-turn remark."""
    bill = is_bill(lines)
    out: set[int] = set()
    bare = [x.replace("\x0c", "").strip("\r") for x in lines]
    for n, line in enumerate(bare):
        s = line.strip()
        if not s:
            continue
        if _PAGE_LABEL.match(s) or (not bill and _PAGE_ONLY.match(s)) or _TURN.match(s):
            out.add(n)
        elif _PAGE_END.search(line) and not bill and not s.endswith((".", ";", ",")) and (_SPLIT.search(_PAGE_END.sub("", s)) or _CODED.match(_PAGE_END.sub("", line)) or s[:1].isupper()):
            out.add(n)
        elif bill and re.search(rf"\s{{2,}}(?:page|seite|sheet|blatt|pg\.?)\s?{_N}(?:\s?(?:of|von|sur|/)\s?{_N})?\s*$", line, re.I):
            out.add(n)
        elif not bill and not s.endswith((".", ";", ",")) and (_CODED.match(line) or (_SPLIT.search(s) and re.match(r"[^\W\d_]", s) and s[0].isupper())):
            out.add(n)
    if not bill:
        # lines in capitals as in a title that recur through the document, slips of the scanner allowed
        groups: list[tuple[str, list[int]]] = []
        exact: dict[str, list[int]] = {}
        first = next((n for n, x in enumerate(bare) if x.strip()), 0)
        for n, line in enumerate(bare):
            s = line.strip()
            k = _key(s)
            if n in out or len(k) < 6 or not _titled(s) or s.endswith((";", ",", ":", *MARKS)) or (s.endswith(".") and not re.search(r"\b(?:Corp|Inc|Ltd|Co)\.$", s)) or re.match(r"^\d{1,2}\.\s", s) or n <= first + 2:
                continue
            if k in exact:
                exact[k].append(n)
                continue
            for key, own in groups:
                if abs(len(key) - len(k)) <= len(k) // 8 and osa(key, k, max(1, len(k) // 8)) <= max(1, len(k) // 8):
                    own.append(n)
                    break
            else:
                own = [n]
                groups.append((k, own))
            exact[k] = own
        for _, own in groups:
            if len(own) >= 2 and any(_interrupts(bare, n) for n in own):
                out.update(own)
    return out


def _titled(s: str) -> bool:
    """Words in capitals as in a name or title, unlike running text."""
    words = [w for w in re.findall(r"[^\W\d_]{3,}", s)]
    return bool(words) and sum(w[0].isupper() for w in words) >= 0.6 * len(words) and re.search(r"[^\W\d_]{4,}[.;:,]\s", s) is None and not re.search(r"(?:^|\s)(?:der|die|das|im|nach|the|le|la)$", s, re.I)


def _interrupts(lines: list[str], n: int) -> bool:
    """Does running text go on across this line?"""
    before = next((x.strip() for x in reversed(lines[:n]) if x.strip()), "")
    return bool(before) and not before.endswith((".", ":", ";"))


class Page:
    """The analysis of one text."""

    def __init__(self, text: str, lex: Lexicon, index_only: bool = False):
        #: repairs by the index alone: no letter runs of names, no digits
        self.index_only = index_only
        self.lines = text.split("\n")
        self.lex = lex
        self.out = furniture(self.lines)
        self.bill = is_bill(self.lines)
        self.hyphen: set[int] = set()
        self.hard: set[int] = set()
        self.char: set[int] = set()
        #: repaired words: (line, start, end) -> word
        self.repairs: dict[tuple[int, int, int], str] = {}
        self.running = [n for n, x in enumerate(self.lines) if x.strip() and n not in self.out]
        self._breaks()
        self._chars()

    def _breaks(self) -> None:
        for at, n in enumerate(self.running[:-1]):
            left = re.search(rf"(?<![\w'’])([^\W\d_][\w'’]*)([{MARKS}])\s*$", self.lines[n])
            nxt = self.running[at + 1]
            right = re.match(r"\s*([^\W\d_][\w'’]*)", self.lines[nxt].replace("\x0c", ""))
            if not left or not right or not right.group(1)[0].islower():
                continue
            if re.search(r"\d$", left.group(1)) and re.match(r"\d", right.group(1)):
                continue
            a, b = left.group(1).lower(), right.group(1).lower()
            # the whole chain before the mark, as in "temperature-sen-"
            chain = re.search(rf"(?<![\w'’-])((?:[^\W\d_]+-)*)[^\W\d_][\w'’]*[{MARKS}]\s*$", self.lines[n])
            lead = chain.group(1).lower() if chain else ""
            if self._belongs(lead, a, b):
                self.hard.add(n)
            else:
                self.hyphen.add(n)

    def _belongs(self, lead: str, a: str, b: str) -> bool:
        """Is the hyphen part of the word?"""
        w, h = self.lex.words, self.lex.hyphenated
        joined, kept = w.get(a + b, 0), h.get(f"{a}-{b}", 0)
        if joined or kept:
            return kept > joined
        mended = self.lex.repair(a + b)
        if mended:
            return False
        ma, mb = self.lex.repair(a) or a, self.lex.repair(b) or b
        if h.get(f"{ma}-{mb}", 0):
            return True
        if lead:
            # a word of the chain broken: the chain itself is known by its joined end
            return False
        return self.lex.words.get(ma, 0) >= 3 * self.lex.least and self.lex.words.get(mb, 0) >= 3 * self.lex.least and len(ma) >= 3 and len(mb) >= 4 and (ma in _PREFIXES or ma in self.lex.first_parts)

    def _chars(self) -> None:
        lex = self.lex
        masked: dict[int, list[tuple[int, int]]] = {}
        # addresses on the net are no words
        text = "\n".join(self.lines)
        starts = [0]
        for x in self.lines:
            starts.append(starts[-1] + len(x) + 1)
        if "@" in text or re.search(r"[\[(]\s?at\s?[\])]|\sat\s\S+\s+dot\s", text):
            for p in _EMAIL:
                for m in p.finditer(text):
                    for n in range(bisect.bisect_right(starts, m.start()) - 1, bisect.bisect_left(starts, m.end())):
                        s, e = max(m.start(), starts[n]), min(m.end(), starts[n + 1] - 1)
                        if s < e:
                            masked.setdefault(n, []).append((s - starts[n], e - starts[n]))
        for at, n in enumerate(self.running):
            line = self.lines[n]
            words = [m for m in _WORD.finditer(line)]
            low = [m.group().lower() for m in words]
            linked = "www." in line or "http" in line or "/" in line or "@" in line
            broken = n in self.hyphen
            for k, m in enumerate(words):
                if not (broken and k == len(words) - 1) and lex.settled(low[k]):
                    continue
                if any(s <= m.start() < e for s, e in masked.get(n, ())) or linked and (re.search(r"(?:www\.|https?:|/)\S*$", line[: m.start()]) or re.match(r"[@/]", line[m.end() :])):
                    continue
                token, start, end, where = m.group(), m.start(), m.end(), n
                joined_with = None
                if n in self.hyphen and k == len(words) - 1 and at + 1 < len(self.running):
                    nxt = self.running[at + 1]
                    r = re.match(r"[\s\x0c]*([^\W\d_][\w'’]*)", self.lines[nxt])
                    if r:
                        joined_with = (nxt, r)
                        token = token + r.group(1)
                elif k == 0 and at and self.running[at - 1] in self.hyphen and not line[: m.start()].strip():
                    continue
                if not _suspect(token):
                    continue
                mended = lex.repair(token, low[k - 1] if k else "", low[k + 1] if k + 1 < len(low) else "")
                if mended is None:
                    continue
                if joined_with:
                    cut = end - start
                    a, b = token[:cut].lower(), token[cut:].lower()
                    split = _split_at(mended, a, b)
                    if mended[:split] != a:
                        self.char.add(where)
                        self.repairs[where, start, end] = _like(token[:cut], mended[:split])
                    if mended[split:] != b:
                        nxt, r = joined_with
                        self.char.add(nxt)
                        self.repairs[nxt, r.start(1), r.end(1)] = mended[split:]
                else:
                    self.char.add(where)
                    self.repairs[where, start, end] = _like(token, mended)
            for m in _TOKEN.finditer(line) if not self.index_only and _MIXED.search(line) else ():
                if any(s <= m.start() < e for s, e in masked.get(n, ())):
                    continue
                fixed = _number(m.group())
                if fixed:
                    self.char.add(n)
                    self.repairs[n, m.start(), m.end()] = fixed

    def mended(self) -> list[tuple[int, str, str]]:
        """The repaired words: line, what stands there, what should."""
        return [(n, self.lines[n][s:e], w) for (n, s, e), w in sorted(self.repairs.items())]

    def finds(self) -> list[tuple[int, str]]:
        return [(n, "furniture") for n in sorted(self.out)] + [(n, "hyphen") for n in sorted(self.hyphen)] + [(n, "char") for n in sorted(self.char)]

    def text(self) -> str:
        """Continuous paragraphs: furniture gone, broken words joined, misread words repaired. Bills keep their lines."""
        rows: list[str] = []
        glue = ""
        fresh = True
        for n, line in enumerate(self.lines):
            if n in self.out:
                continue
            for (_, s, e), w in sorted((x for x in self.repairs.items() if x[0][0] == n), reverse=True):
                line = line[:s] + w + line[e:]
            s = line.replace("\x0c", "").strip()
            if not s:
                fresh = glue == "" or glue == " "
                continue
            heading = re.match(r"^\d{1,2}\.\s+\S", s) is not None or (s.isupper() and len(s) < 80)
            if not rows or self.bill or heading or (fresh and not (rows and glue == "join")) or (rows and rows[-1].startswith("\x00")):
                rows.append(("\x00" if heading and not self.bill else "") + s)
            else:
                rows[-1] = rows[-1] + ("" if glue == "join" else " ") + s
            fresh = False
            if n in self.hyphen:
                rows[-1] = re.sub(rf"[{MARKS}]\s*$", "", rows[-1])
                glue = "join"
            elif n in self.hard:
                rows[-1] = re.sub(rf"[{MARKS}]\s*$", "-", rows[-1])
                glue = "join"
            else:
                glue = " "
        return "\n".join(r.lstrip("\x00") for r in rows)


# fixed values: first parts that keep their hyphen
_PREFIXES = set("non pre post self co re anti semi multi ex mid sub ultra three two four long short high low well".split())


def _split_at(word: str, a: str, b: str) -> int:
    """Where a mended word divides between the two halves it was broken into."""
    best = min(range(len(word) + 1), key=lambda i: (osa(word[:i], a, 3) + osa(word[i:], b, 3), abs(i - len(a))))
    return best


def _like(token: str, word: str) -> str:
    """``word`` in the case of ``token``."""
    if token.isupper() and len(token) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if token[:1].isupper() else word


def _number(token: str) -> str | None:
    """A number with a letter read for a digit, put right; ``None`` for anything else."""
    core = token.strip("()$€£;:,.")
    if not re.fullmatch(r"[0-9OolIS|][0-9OolIS|.,/()-]*[0-9OolIS|]", core) or not re.search(r"[0-9]", core) or not re.search(r"[OolIS|]", core):
        return None
    letters = len(re.findall(r"[OolIS|]", core))
    digits = len(re.findall(r"[0-9]", core))
    if digits < letters or not (re.search(r"[.,]", core) or digits >= 2) or re.search(r"[oIS]$", core) and digits < 3:
        return None
    return token.replace("O", "0").replace("o", "0").replace("l", "1").replace("I", "1").replace("|", "1").replace("S", "5")


# ---------------------------------------------------------------------------------------------------------------
# Spark

#: a word, hyphenated word or pair of words enters the lexicon from this share of the texts on (three uses at least)
LEXICON_SHARE = 1 / 5000
MENDED = "array<struct<line_no:int,seen:string,mended:string>>"
FINDS = "array<struct<line_no:int,kind:string>>"


def lexicon_tables(texts: DataFrame) -> tuple[dict[str, int], dict[str, int], dict[str, int], dict[str, int], int]:
    """Counts over all distinct texts: words, hyphenated words, pairs, runs of letters over the uses of words (from 5 letters on); and the least count kept.

    The least count is a share of the texts, so the tables can't outgrow (uses in a text) / share; runs of four letters
    are bounded by the alphabet. Broken words are left out of the counts. One pass counts the first three, one the runs.
    """
    total = texts.count()
    least = max(3, int(total * LEXICON_SHARE))
    whole = F.regexp_replace("text", rf"(?<!\p{{L}})\p{{L}}++[{MARKS}]\s*\n\s*\p{{L}}++", " # ")
    lines = texts.select(F.explode(F.split(whole, "\n")).alias("line")).select(
        F.regexp_extract_all(F.lower("line"), F.lit(r"(\p{L}[\p{L}\p{N}]*|\p{N}+\p{L}{2,}[\p{L}\p{N}]*)"), F.lit(1)).alias("ws"),
        F.regexp_extract_all(F.lower("line"), F.lit(r"(?<![\p{L}\p{N}-])(\p{L}+(?:-\p{L}+)+)(?![\p{L}\p{N}-])"), F.lit(1)).alias("chains"),
    )

    def beside(parts, sep: str):
        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.concat_ws(sep, F.get(parts, i), F.get(parts, i + 1)))).otherwise(F.array().cast("array<string>"))

    def marked(kind: str, items):
        return F.transform(items, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("w")))

    links = F.flatten(F.transform("chains", lambda c: beside(F.split(c, "-"), "-")))
    items = lines.select(F.inline(F.concat(marked("w", F.col("ws")), marked("p", beside(F.col("ws"), " ")), marked("h", links))))
    tables: dict[str, dict[str, int]] = {"w": {}, "p": {}, "h": {}}
    for kind, w, n in items.groupBy("kind", "w").count().filter(F.col("count") >= least).collect():
        tables[kind][w] = n
    word = lines.select(F.explode("ws").alias("w")).filter(F.length("w") >= 5).groupBy("w").count().select(F.concat(F.lit("^"), "w", F.lit("$")).alias("t"), "count")
    runs = word.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 3), lambda i: F.col("t").substr(i, F.lit(4)))).alias("w"), "count")
    grams = {r[0]: r[1] for r in runs.groupBy("w").agg(F.sum("count").alias("n")).filter("n > 1").collect()}
    return tables["w"], tables["h"], tables["p"], grams, least


#: bytes that the counts sent to the executors may take; more of them means that ``LEXICON_SHARE`` is too small for the memory
MOST_BROADCAST = 1 << 29


def analysed(texts: DataFrame, with_text: bool = True, key: str = "text", index_only: bool = False) -> DataFrame:
    """``text, repaired, finds`` for distinct non-blank ``text``; another ``key`` column goes through instead of the text.

    ``index_only`` gives ``key, finds`` with the words that the index repairs: line, what stands there, what should.
    """
    words, hyphenated, pairs, grams, least = lexicon_tables(texts)
    size = sum(len(k) + 100 for t in (words, hyphenated, pairs, grams) for k in t)
    if size > MOST_BROADCAST:
        raise ValueError(f"the lexicon would take {size >> 20} MB in every executor; raise LEXICON_SHARE")
    shared = texts.sparkSession.sparkContext.broadcast((words, hyphenated, pairs, {} if index_only else grams, least))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = _lexicon(shared)
        for f in frames:
            pages = [Page(t, lex, index_only) for t in f["text"]]
            if index_only:
                yield pd.DataFrame({key: f[key], "finds": [x.mended() for x in pages]})
            else:
                yield pd.DataFrame({key: f[key], "repaired": [x.text() for x in pages] if with_text else None, "finds": [x.finds() for x in pages]})

    form = texts.schema[key].dataType.simpleString()
    return spread(texts).mapInPandas(run, f"{key} {form}, finds {MENDED}" if index_only else f"{key} {form}, repaired string, finds {FINDS}")


_LEXICA: dict[str, Lexicon] = {}


def _lexicon(shared) -> Lexicon:
    """The worker's lexicon of a broadcast: its index is built once, not for every task."""
    path = getattr(shared, "_path", None)
    held = _LEXICA.get(path) if path else None
    if held is None:
        held = Lexicon(*shared.value)
        _LEXICA.clear()
        if path:
            _LEXICA[path] = held
    return held


def repair(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``repaired`` (continuous paragraphs) and ``finds`` added.

    A null text stays null, a blank one becomes empty; equal texts are read once, repeated rows kept; texts of any
    length are read whole. Columns named like the new ones are replaced.
    """
    own = df.drop("repaired", "finds").withColumn("__text", F.col(text_col).cast("string"))
    texts = own.select(F.col("__text").alias("text")).filter("trim(text) <> ''").distinct()
    got = analysed(texts).withColumnRenamed("text", "__text")
    blank = F.when(F.col("__text").isNotNull(), F.coalesce("repaired", F.lit("")))
    return own.join(got, "__text", "left").withColumn("repaired", blank).withColumn("finds", F.coalesce("finds", F.expr(f"cast(array() as {FINDS})"))).drop("__text")


def _rows(results: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``src, rec_id, h`` of the rows with text, and ``h, text`` of the distinct texts: only a digest of the text is joined on."""
    a = results.select(F.lit("ocr_results").alias("src"), F.col("ocr_id").cast("long").alias("rec_id"), "text")
    b = requests.select(F.lit("ai_requests").alias("src"), F.col("request_id").cast("long").alias("rec_id"), F.col("raw_text").alias("text"))
    rows = a.unionByName(b).filter("trim(text) <> ''").withColumn("h", F.md5("text"))
    return rows.select("src", "rec_id", "h").distinct(), cut(rows.groupBy("h").agg(F.first("text").alias("text")))


def found(results: DataFrame, requests: DataFrame) -> DataFrame:
    """``src, rec_id, line_no, kind`` of every find in both tables."""
    rows, texts = _rows(results, requests)
    got = analysed(texts, with_text=False, key="h").filter("size(finds) > 0").select("h", "finds")
    return rows.join(got, "h").select("src", "rec_id", F.inline("finds")).distinct()


def mended(results: DataFrame, requests: DataFrame) -> DataFrame:
    """``src, rec_id, line_no, seen, mended``: every word that the index of the lexicon repairs."""
    rows, texts = _rows(results, requests)
    got = analysed(texts, key="h", index_only=True).filter("size(finds) > 0")
    return rows.join(got, "h").select("src", "rec_id", F.inline("finds")).distinct()
