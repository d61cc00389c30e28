"""The rules of ``segment``, ``items``, ``totals``, ``parties`` and ``transaction`` over one text at a time in Python.

Same patterns and results as the column rules, which take several times as long for each document and build large plans.
A test holds both against each other. Texts in ASCII are read with plain patterns, others with the source language's whitespace.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import cache, lru_cache
from math import floor

import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.functions import amounts as am, parties as pt, text as tx, transaction as tr
from quillstone.functions.js import BOUND, WS, WS_LINE, rx
from quillstone.operators import items as it, segment as sg

_BLANK = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{WS}]", c))
_LETTERS2, _LETTERS3, _DIGIT, _DIGITS2 = (re.compile(p) for p in (r"[A-Za-z]{2,}", r"[A-Za-z]{3,}", r"[0-9]", r"[0-9]{2,}"))
_DATE_LIKE = re.compile(r"^\d{1,2}[\/\-]\d{1,2}[\/\-]?\Z", re.A)
_FLOAT = re.compile(r"\s*([-+]?(?:\d+\.?\d*|\.\d+))", re.A)
_NOT_NUMBER = re.compile(r"[^0-9.]")
_HEADINGS = tuple(dict.fromkeys(sg._TABLE + it._TABLE + it._STRONG))
#: words without one of which no branch of NOT_PRODUCT matches, other than addresses and those at a line's start
_MARKS = ("accept", "return", "refund", "warranty", "condition", "goods", "items", "sales", "signature", "agree", "issuer", "thank", "have")


def _compile(pattern: str, flags: str = "", ascii_only: bool = False) -> re.Pattern:
    """A pattern of the source dialect for Python."""
    p = re.sub(r"^\(\?d\w*\)", "", rx(pattern, flags)).replace(r"\z", r"\Z")
    if ascii_only:
        for old, new in ((f"[^{WS}]", r"\S"), (f"[{WS}]", r"\s"), (f"[{WS_LINE}]", r"[ \t\x0b\f\r]"), (WS, r"\s"), (BOUND, r"\b")):
            p = p.replace(old, new)
    return re.compile(p, re.A | (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0))


def fixed(x: float | None, places: int) -> float | None:
    """Rounded as decimals are, halves up."""
    if x is None or round(x, places) == x:
        return x
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def parse_float(text: str | None) -> float | None:
    m = _FLOAT.match(text) if text is not None else None
    return float(m[1]) if m else None


def amount(text: str | None) -> float | None:
    return parse_float(text.replace(",", "")) if text is not None else None


def _positive(text: str | None) -> float | None:
    v = amount(text)
    return v if v is not None and v > 0 else None


def _hits(low: str, keywords: tuple[str, ...]) -> int:
    n = 0
    for k in keywords:
        if k in low:
            n += 1
    return n


def _whole(n: float) -> bool:
    return n == floor(n) and n < 10000


def disambiguate(nums: list[float], total: float) -> tuple[float, float | None]:
    """Quantity and unit price among the numbers before the total, as ``items.disambiguate``."""
    size = len(nums)
    price = None
    if size >= 2:
        most = max(total, 1.0)
        best = min([(e, i, j) for i, q in enumerate(nums) for j, p in enumerate(nums) if i < j and (e := abs(q * p - total) / most) < 0.05], default=None)
        qty = next((n for n in nums if _whole(n)), None)
        if best:
            quantity, price = nums[best[1]], nums[best[2]]
        elif qty is not None:
            quantity, price = qty, next((n for n in reversed(nums) if n != qty), None)
        else:
            quantity, price = 1.0, nums[-1]
    elif size == 1:
        n, inferred = nums[0], total / nums[0]
        quantity, price = (n, fixed(inferred, 4)) if _whole(n) and inferred >= 0.01 else (1.0, n)
    else:
        quantity = 1.0
    if price is None and quantity > 0 and total > 0:
        price = fixed(total / quantity, 4)
    return quantity, price


class Row:
    """A row below a table's header."""

    def is_name(self) -> bool:
        return len(self.t) >= 3 and not self.end and self.product and _LETTERS3.search(self.t) is not None

    def is_text(self) -> bool:
        return len(self.t) > 3 and not self.end and not _DIGITS2.search(self.t) and _LETTERS2.search(self.t) is not None

    __slots__ = ("t", "end", "skip", "nums", "pct", "name", "weak", "date_like", "product")


class Reader:
    """The rules, compiled for texts in ASCII or for any."""

    def __init__(self, ascii_only: bool):
        c = lambda p, flags="": _compile(p, flags, ascii_only)
        self.c = cache(c)
        self.dollar, self.letter_o, self.letter_s = c(r"(\$\s*)[lI](\d)"), re.compile(r"(\d)[Oo](\d)", re.A), c(r"(?<=\s)S(\d{1,3}(?:,\d{3})*\.\d{2})\b")
        self.thousands, self.maybe_s, self.gap, self.trailing, self.unseen = c(r"(?<=\d) (?=\d{3}(?:[.,]|\b))"), re.compile(r"S\d", re.A), re.compile(r"\d \d{3}", re.A), re.compile(r"[ \t]+$", re.M), re.compile("[\u200b-\u200d\ufeff]")
        self.body, self.footer, self.table_end, self.list_end, self.summary, self.stop = c(sg._BODY, "i"), c(sg._FOOTER, "i"), c(it._TABLE_END, "i"), c(it._LIST_END, "i"), c(it.SUMMARY, "i"), c(am.STOP, "i")
        self.not_product_any = c(it.NOT_PRODUCT, "i")
        self.not_product_start = c("|".join(b for b in it.NOT_PRODUCT_BRANCHES if b.startswith("(?:^")), "i")
        self.street, self.state = c(r"\d\s+\w+\s+[a-z]", "i"), c(r"[a-z]{2}\s+\d{5}", "i")
        self.split, self.number, self.percent = c(r"\s{2,}"), c(it.NUMBER), c(it.TAX_PERCENT, "i")
        self.fallback, self.leading = c(r"\s{2,}[\d$€£,.%]+.*$"), c(r"^\d{1,3}[.)\s]+\s*")
        self.sku, self.sku_bare = c(it.SKU_LABELLED, "i"), c(it.SKU_BARE)
        self.cut = c(r"[\s]*(?:[\$€£₹¥]?\s*\d[\d,.\s%×xX@*]*)(?:\s+(?:[\$€£₹¥]?\s*\d[\d,.\s%×xX@*]*))*\s*$")
        self.alone, self.any_amount = c(am.ALONE), c(r"[\$€£₹¥]?\s*([\d,]+\.\d{1,4})")
        self.label, self.tax_total = cache(self._label), c(r"total\s+[gtv]|[tx]\s+total", "i")
        self.bounds_of, self.row = lru_cache(20_000)(self._marks), lru_cache(20_000)(self._row)

    def first(self, text: str | None, pattern: str, group: int = 1, flags: str = "") -> str | None:
        m = self.c(pattern, flags).search(text) if text is not None else None
        return (m[group] or None) if m else None

    def test(self, text: str, pattern: str, flags: str = "") -> bool:
        return self.c(pattern, flags).search(text) is not None

    def normalise(self, t: str) -> str:
        if "$" in t:
            t = self.dollar.sub(r"\g<1>1\g<2>", t)
        t = self.letter_o.sub(r"\g<1>0\g<2>", t)
        if self.maybe_s.search(t):
            t = self.letter_s.sub(r"$\g<1>", t)
        if "\t" in t or "   " in t:
            t = re.sub(r"[ \t]{2,}", "  ", t)
        if self.gap.search(t):
            t = self.thousands.sub("", t)
        if not t.isascii():
            t = self.unseen.sub("", t.replace("–", "-").replace("—", "-"))
        if " \n" in t or "\t\n" in t or t.endswith((" ", "\t")):
            t = self.trailing.sub("", t)
        return t

    # -----------------------------------------------------------------------------------------------------------
    # Segments

    def _marks(self, line: str) -> tuple[bool, bool, bool, bool, bool]:
        """Of a line: opens the body, heads a table in ``segment`` and in ``items``, names a quantity, opens the footer."""
        low = line.lower()
        found = [k for k in _HEADINGS if k in low]
        heads = (sum(k in sg._TABLE for k in found) >= 2, sum(k in it._TABLE for k in found) >= 2, any(k in it._STRONG for k in found)) if found else (False, False, False)
        return self.body.match(line) is not None, *heads, self.footer.match(line) is not None

    def bounds(self, marks: list[tuple]) -> tuple[int, int]:
        n = len(marks)
        end = usual = min(8, n)
        hit = next((i for i, m in enumerate(marks[:25]) if m[0]), -1)
        if hit >= 0:
            end = hit
        if end == usual:
            table = next((i for i, m in enumerate(marks[:25]) if m[1]), -1)
            end = table if table >= 0 else end
        foot = next((i for i in range(end, n) if marks[i][4] and i > n * 0.35), None)
        return end, max(floor(n * 0.75), n - 15) if foot is None else foot

    # -----------------------------------------------------------------------------------------------------------
    # Items: (name, quantity, unit price, total)

    def not_product(self, t: str) -> bool:
        low = t.lower()
        if self.not_product_start.match(t):
            return True
        return (self.street.search(t) is not None or self.state.search(t) is not None or _hits(low, _MARKS) > 0) and self.not_product_any.search(t) is not None

    def tax_percent(self, line: str) -> float | None:
        m = self.percent.search(line) if "%" in line or "p" in line or "P" in line else None
        return parse_float(m[1]) if m else None

    def numbers(self, line: str) -> list[tuple[float, bool]]:
        found = [(float(m if m[0].isdigit() and m[-1].isdigit() and "," not in m else _NOT_NUMBER.sub("", m)), m[-1] == "%") for m in self.number.findall(line)]
        return [x for x in found if x[0] > 0]

    def _plain(self, tokens: list[tuple[float, bool]], pct: float | None) -> list[float]:
        return [v for v, p in tokens if not p and v != pct]

    def _row(self, line: str) -> Row:
        r = Row()
        r.t = t = line.strip(_BLANK)
        r.pct = self.tax_percent(line)
        segments = [s.strip(_BLANK) for s in self.split.split(line)]
        r.end, no = self.table_end.match(t) is not None, self.not_product(t)
        name = next((s for s in segments if _LETTERS2.search(s)), "")
        if len(name) < 2:
            name = self.fallback.sub("", line).strip(_BLANK)[:80]
        r.name = name = self.leading.sub("", name).strip(_BLANK)
        r.nums = self._plain(self.numbers(line), r.pct)
        r.skip = len(t) < 4 or no
        r.weak = len(name) < 3 or not _LETTERS3.search(name)
        r.date_like = _DATE_LIKE.search(name) is not None
        r.product = not no
        return r

    def _shown(self, name: str) -> str:
        m = self.sku.search(name)
        if not m:
            m = self.sku_bare.search(name)
        return (name.replace(m[0], "").strip(_BLANK) or name) if m else name

    def column_table(self, rows: list[str], marks: list[tuple]) -> list[tuple]:
        strong = [i for i, m in enumerate(marks) if m[2] and m[3]]
        weak = [i for i, m in enumerate(marks) if m[2] and not m[3]]
        if not strong and not weak:
            return []
        info = rows[(strong[-1] if strong else weak[0]) + 1 :]
        out: list[tuple] = []
        i, n = 0, len(info)
        at = lambda k: self.row(info[k]) if k < n else None
        while i < n:
            r = self.row(info[i])
            if r.end:
                break
            count = len(r.nums)
            nxt = at(i + 1)
            total = r.nums[-1] if count else None
            borrows = r.weak and count >= 2 and total != floor(total) and nxt is not None and nxt.is_name()
            usable = not r.skip and count > 0 and (not r.weak or borrows)
            named = usable and (borrows or not r.date_like)
            after = at(i + 2) if usable and borrows else nxt
            described = named and after is not None and after.is_text()
            if named and total <= 100000:
                quantity, price = disambiguate(r.nums[:-1], total)
                out.append((self._shown(nxt.t if r.weak else r.name), quantity, fixed(price, 4), fixed(total, 4)))
            i += 1 + (usable and borrows) + described
        return out

    def parse_line(self, line: str) -> tuple | None:
        t = line.strip(_BLANK)
        if len(t) < 4 or not _DIGIT.search(t) or self.summary.match(t) or self.not_product(t):
            return None
        tokens = self.numbers(t)
        pct = next((v for v, p in tokens if p), None)
        nums = self._plain(tokens, self.tax_percent(t) if pct is None else pct)
        if not nums or nums[-1] > 9_999_999:
            return None
        name = self._name(t, self.first(t, it.SKU_LABELLED, 1, "i") or self.first(t, it.SKU_BARE))
        if not _LETTERS3.search(name) or _DATE_LIKE.search(name):
            return None
        quantity, price = disambiguate(nums[:-1], nums[-1])
        return name, quantity, fixed(price, 4), fixed(nums[-1], 4)

    def _name(self, t: str, sku: str | None) -> str:
        segments = self.split.split(t)
        lead = segments[0]
        own = next((s for s in segments if _LETTERS2.search(s)), "").strip(_BLANK)
        if len(own) < 2:
            own = self.cut.sub("", t).strip(_BLANK)
        if sku is not None and sku in own:
            own = re.sub(_compile(r"(?:SKU|Part\s*(?:No|#))\s*[:.]?\s*", "i").pattern + re.escape(sku), "", own, flags=re.A | re.I).strip(_BLANK)
            own = (own.replace(sku, "").strip(_BLANK) if sku in own else own) or lead
        x = self.leading.sub("", own).strip(_BLANK)
        return lead if len(x) < 3 else x

    def multi_lines(self, rows: list[str]) -> list[tuple]:
        def is_text(k: int) -> bool:
            return k < len(rows) and len(rows[k]) > 3 and self.test(rows[k], r"^[A-Za-z][^$€£\d]*$", "i") and not self.list_end.match(rows[k])

        out: list[tuple] = []
        i = 0
        while i < len(rows) and not self.list_end.match(rows[i]):
            item = self.parse_line(rows[i])
            if item:
                described = is_text(i + 1)
                k = i + 1 + described
                i += described + (k < len(rows) and self.first(rows[k], it.SKU_LABELLED, 1, "i") is not None)
                out.append(item)
            i += 1
        return out

    def vertical_form(self, rows: list[str]) -> list[tuple]:
        def label(x: str | None) -> str | None:
            return it.FORM.get(re.sub(r"[:.]+\Z", "", x.strip(_BLANK).lower()).strip(_BLANK)) if x is not None else None

        def money(v: str | None) -> float | None:
            return parse_float(_NOT_NUMBER.sub("", v)) if v is not None else None

        seen: dict[str, str] = {}
        labels = [label(x) for x in rows]
        for i, f in enumerate(labels[:-1]):
            v = rows[i + 1]
            if f is not None and labels[i + 1] is None and not self.test(v, r"^(?:sub\s*total|subtotal|total|tax|gst|vat|shipping)", "i") and (f not in it._NUMERIC or _DIGIT.search(v)):
                seen.setdefault(f, v)
        inline = next((v for x in rows if (v := self.first(x, r"\bqty\s*[:.]?\s*(\d+)\b", 1, "i")) is not None), None)
        kinds = len(seen) + ("quantity" not in seen and inline is not None)
        if kinds < 2:
            return []
        part, text = seen.get("part"), seen.get("description")
        start = next((i for i, x in enumerate(rows) if self.test(x, r"^(?:part\s*number|description)", "i")), -1)
        if text is None and part is not None and start >= 0:
            later = rows[start + 1 :]
            stop_rx = r"^(?:sub\s*total|subtotal|total|tax|gst|vat|invoice|customer|employee|sales|salesman|attention|terms|delivery|tender|paid)"
            stop = next((i for i, x in enumerate(later) if len(x) >= 5 and label(x) is None and self.test(x, stop_rx, "i")), None)
            text = next((x for x in later[:stop] if len(x) >= 5 and label(x) is None and _LETTERS3.search(x) and not re.search(r"^[0-9\-./#]+\Z", x) and x != part), None)
        price = money(seen.get("price"))
        price = money(seen.get("list")) if price is None else price
        total = money(seen.get("total"))
        total = price if total is None else total
        quantity = money(seen.get("quantity", inline))
        quantity = 1.0 if quantity is None else quantity
        if (text is None and part is None) or not (total or price):
            return []
        core = money(seen.get("core"))
        if core is not None and core <= 2 and "total" in seen:
            at = rows.index(seen["total"])
            ahead = (amount(self.first(x, r"^\$?\s*([\d,]+\.\d{1,4})\s*$")) for x in rows[at + 1 : at + 4])
            core = next((v for v in ahead if v is not None and v > 2), core)
        own = price if price is not None else fixed(total / quantity, 4) if total and quantity else None
        out = [(part if text is None else text, quantity, fixed(own, 4), fixed(total, 4))]
        return out + [("Core Deposit", 1.0, fixed(core, 4), fixed(core, 4))] if core is not None and core > 0 else out

    def extract_parts(self, body: list[str], marks: list[tuple], rows: list[str]) -> list[tuple]:
        """The first of the five strategies that finds anything."""
        return (
            self.column_table(body, marks) or self.vertical_form(rows) or self.multi_lines(body) or [x for r in body if (x := self.parse_line(r))]
            or [x for r in rows if re.search(r"\$?[0-9]+\.[0-9]{2}", r) and (x := self.parse_line(r))]
        )

    # -----------------------------------------------------------------------------------------------------------
    # Totals

    def _label(self, label: str) -> tuple[re.Pattern, re.Pattern]:
        """Of a label: where it stands, and with its amount."""
        return self.c(f"(?:{label})", "i"), self.c(rf"(?:{label})(?:\s*\([^)]*\))?[\s\-:]*[A-Z$€£₹¥]*\s*([\d,]+\.\d+|[\d,]{{2,}}(?![/\-]))", "i")

    def labelled_amount(self, text: str, label: str) -> float | None:
        any_, valued = self.label(label)
        m = any_.search(text)
        if not m:
            return None
        m = valued.search(text, m.start())
        same = amount(m[1]) if m else None
        if same is not None and same >= 0:
            return same
        rows = text.split("\n")
        for i, line in enumerate(rows):
            if any_.search(line):
                m = self.any_amount.search(any_.sub("", line))
                v = _positive(m[1]) if m else None
                if v is not None:
                    return v
                for x in rows[i + 1 : i + 5]:
                    x = x.strip(_BLANK)
                    if self.stop.match(x):
                        break
                    m = self.alone.match(x)
                    if m and (v := _positive(m[1])) is not None:
                        return v
        return None

    def pos_tax(self, text: str) -> float | None:
        rows = text.split("\n")
        at = next((i for i, x in enumerate(rows) if self.test(x, r"\bpct\b.*%", "i") or self.test(x, r"\btaxtable\b", "i")), -1)
        if at < 0:
            return None
        found = [v for x in rows[at + 1 : at + 5] if (v := amount(self.first(x.strip(_BLANK), r"^\$?\s*([\d,]+\.\d{1,4})\s*$"))) is not None]
        return min(found[:2]) if len(found) >= 2 else None

    def totals(self, text: str, footer: str, parts: list[tuple], only: str = "") -> dict[str, float | None]:
        """Subtotal, tax, shipping, discount and grand total, or ``grand_total`` alone."""
        search, foot = (footer + "\n" + text, footer) if len(footer) > 10 else (text, text)
        whole = fixed(sum((p[3] or 0.0 for p in parts), 0.0), 2)
        la = self.labelled_amount
        low_text = search.lower()
        subtotal = la(search, r"sub[\s\-]*total|subtotal")
        if subtotal is None and parts:
            subtotal = whole

        def grands() -> Iterator[float | None]:
            yield la(search, r"grand\s+total|total\s+amount\s+due|total\s+due")
            due = la(search, r"amount\s+due|balance\s+due") if "due" in low_text else None
            yield due if due is not None and due > 0 else None
            yield la(search, r"amount\s*:")
            yield la(foot, r"(?:invoice|invoice\s+total|credit\s+card)\s*total|credit\s*card")
            yield la(foot, r"\btotal\b")
            yield subtotal

        grand = next((g for g in grands() if g is not None), 0.0)
        low = grand > 0 and subtotal is not None and subtotal > 0 and grand < subtotal * 0.8
        if only == "grand_total" and not (low and whole > 0):
            return {"grand_total": subtotal if low else grand}

        def taxes() -> Iterator[float | None]:
            yield self.pos_tax(text) if "%" in text or "taxtable" in low_text else None
            yield la(search, r"total\s+(?:gst|tax|vat)|(?:gst|tax|vat)\s+total|total\s+tax") if self.tax_total.search(low_text) else None
            yield la(search, r"(?:gst|tax|vat)")

        tax = next((v for v in taxes() if v is not None), None)
        shipping, discount = la(search, r"shipping|delivery|freight|carriage"), la(search, r"discount|savings|rebate") if _hits(low_text, ("discount", "savings", "rebate")) else None
        if low:
            grand = fixed(whole + (tax or 0.0) + (shipping or 0.0) - (discount or 0.0), 2) if whole > 0 else subtotal
        return {"subtotal": whole if subtotal is None and whole > 0 else subtotal, "total_tax": tax, "shipping_cost": shipping, "discount": discount, "grand_total": grand}

    def numeric_factor(self, t: dict[str, float | None], parts: list[tuple]) -> float:
        subtotal = sum((p[3] or 0.0 for p in parts), 0.0) if t["subtotal"] is None else t["subtotal"]
        extra = 0.0 + (t["total_tax"] or 0.0) + (t["shipping_cost"] or 0.0) - (t["discount"] or 0.0)
        if not parts:
            return 0.5
        if t["grand_total"] == 0:
            return 0.4 if subtotal == 0 else 0.5
        delta = abs(subtotal + extra - t["grand_total"]) / t["grand_total"]
        return 1.0 if delta < 0.01 else 0.8 if delta < 0.05 else 0.6 if delta < 0.15 else 0.3

    # -----------------------------------------------------------------------------------------------------------
    # Header fields

    def document_type(self, text: str) -> str:
        low = text.lower()
        n, _, kind = max((_hits(low, ks), -i, t) for i, (t, ks) in enumerate(tx.TYPE_WORDS))
        return kind if n > 0 else "generic"

    def invoice_number(self, text: str) -> str | None:
        found = self.first(text, tr._INVOICE, 1, "i") or self.first(text, r"^invoice\s+(\d[\w\-/]{2,20})$", 1, "im") or self.first(text, r"^#([A-Z]{0,4}\d{4,12})$", 1, "im")
        if found:
            return found.strip(_BLANK)
        rows = text.split("\n")
        for i, line in enumerate(rows):
            if self.test(line, r"^\s*(?:invoice\s*(?:no\.?|#|number)|einvoice\s*[#:]?)\s*:?\s*$", "i"):
                v = next((v for x in rows[i + 1 : i + 3] if (v := x.strip(_BLANK)) and self.test(v, tr._VALUE, "i")), None)
                if v is not None:
                    return v
        return None

    def supplier_name(self, header: list[str]) -> str | None:
        plain = [x for x in header[:8] if not self.test(x, pt.SKIP_HEADER, "i")]
        capital = next((x for x in plain if 3 <= len(x) <= 60 and self.test(x, r"^[A-Z][A-Z\s&.,'-]{4,}$")), None)
        if capital is not None:
            return capital
        corporate = min(((len(x), i, x) for i, x in enumerate(plain) if len(x) >= 3 and self.test(x, pt.CORPORATE, "i")), default=None)
        return corporate[2] if corporate else next((x for x in plain if 3 < len(x) <= 60), None)

    def _block_name(self, rows: list[str]) -> str | None:
        named = (v.strip(_BLANK) for x in rows if (v := self.first(x, pt._BLOCK_INLINE, 1, "i")) is not None)
        name = next((v for v in named if len(v) > 2), None)
        if name is None:
            no = ((pt._BLOCK_LABEL, "i"), (r"^[\d\s\-().+$€£₹¥,]+$", ""), (r"^[\w.+-]+@[\w.-]+$", ""), (r"^https?://|^www\.", ""))
            name = next((x for x in rows if len(x) > 2 and not any(self.test(x, p, f) for p, f in no)), None)
        return self.c(r"^(?:attn|attention)[:.]\s*", "i").sub("", name).strip(_BLANK) if name is not None else None

    def buyer_name(self, rows: list[str]) -> str | None:
        inline, section = self.c(pt._INLINE, "i"), self.c(pt._SECTION, "i")
        for i, x in enumerate(rows):
            m, opens = inline.match(x), section.match(x)
            if not (m or opens) or self.test(x, pt._NOT_BUYER, "i"):
                continue
            v = m[1].strip(_BLANK) if m else None
            if v is not None and len(v) > 2 and not self.test(v, pt._NOT_BUYER, "i"):
                return v
            if opens:
                return self._block_name(rows[i + 1 : i + 9]) or None
        found = (v.strip(_BLANK) for x in rows if (v := self.first(x, r"^(?:attn|attention)\s*[:.]+\s*(.+)", 1, "i")) is not None)
        return next((v for v in found if len(v) > 2), None)


class Text:
    """One normalised text, cut into header, body and footer."""

    def __init__(self, raw: str):
        self.rules = rules = _reader(raw.isascii())
        self.norm = rules.normalise(raw)
        self.rows = [x for line in self.norm.split("\n") if (x := line.strip(_BLANK))]
        self.marks = [rules.bounds_of(x) for x in self.rows]
        self.end, self.foot = rules.bounds(self.marks)

    def column_table(self) -> list[tuple]:
        return self.rules.column_table(self.rows[self.end : self.foot], self.marks[self.end : self.foot])

    def extract_parts(self) -> list[tuple]:
        return self.rules.extract_parts(self.rows[self.end : self.foot], self.marks[self.end : self.foot], self.rows)

    def totals(self, parts: list[tuple], only: str = "") -> dict[str, float | None]:
        return self.rules.totals(self.norm, "\n".join(self.rows[self.foot :]), parts, only)


@cache
def _reader(ascii_only: bool) -> Reader:
    return Reader(ascii_only)


# ---------------------------------------------------------------------------------------------------------------
# Over frames


def _items(t: Text) -> list[tuple]:
    return [(i, *x) for i, x in enumerate(t.column_table())]


def _totals(t: Text) -> list[tuple]:
    x = t.totals(t.column_table())
    return [tuple(x[k] for k in ("subtotal", "total_tax", "shipping_cost", "grand_total"))]


def _numeric(t: Text) -> list[tuple]:
    parts = t.column_table()
    return [(t.rules.numeric_factor(t.totals(parts), parts),)]


def _record(t: Text) -> list[tuple]:
    return [(t.rules.document_type(t.norm), t.rules.invoice_number(t.norm), t.totals(t.extract_parts(), "grand_total")["grand_total"])]


def _parties(t: Text) -> list[tuple]:
    return [(t.rules.supplier_name(t.rows[: t.end]), t.rules.buyer_name(t.rows))]


READS: dict[str, tuple[Callable[[Text], list[tuple]], str]] = {
    "items": (_items, "line_no int, item_name string, quantity double, unit_price double, total_amount double"),
    "totals": (_totals, "subtotal double, total_tax double, shipping_cost double, grand_total double"),
    "numeric": (_numeric, "numeric_factor double"),
    "record": (_record, "document_type string, invoice_number string, grand_total double"),
    "parties": (_parties, "supplier_name string, buyer_name string"),
}
_ARROW = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def read(docs: DataFrame, what: str) -> DataFrame:
    """``doc_id`` of ``doc_id, text`` beside what is read; as many rows as there are items for ``items``, else one."""
    fields = [x.split() for x in READS[what][1].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = READS[what][0]
        for b in batches:
            ids, columns = [], [[] for _ in fields]
            for i, raw in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for row in fn(Text(raw or "")):
                    ids.append(i)
                    for column, v in zip(columns, row):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_id").type), *[pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields)]], ["doc_id", *[name for name, _ in fields]])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {READS[what][1]}")
