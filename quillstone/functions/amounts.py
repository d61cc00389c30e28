"""Amounts of money in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.js import amount, find, first, let, parse_float, rx, test, trim


def parse_amount(raw: Column) -> Column:
    """The number in a text like ``$1,234.56``; 0 where there is none. The sign is lost."""
    return F.coalesce(parse_float(F.regexp_replace(raw, r"[^0-9.]", "")), F.lit(0.0))


def first_amount(text: Column) -> Column:
    v = amount(first(text, r"[^\d]*([\d,]+\.\d{1,4})"))
    return F.when(v > 0, v)


def to_number(raw: Column) -> Column:
    return parse_float(F.regexp_replace(raw, r"[^0-9.-]", ""))


# fixed values: labels at which the search for a value on the next lines ends
STOP = r"^(?:sub\s*total|subtotal|total|tax|amount|discount|shipping|net|gross|balance|paid|tender|grand)\b"
ALONE = r"^[\$€£₹¥]?\s*([\d,]+\.\d{1,4})\s*$"


def _positive(text: Column) -> Column:
    return let(amount(text), lambda v: F.when(v > 0, v))


def labelled_amount(text: Column, label: str) -> Column:
    """The amount a label stands for: on its line, elsewhere on the line, or alone on one of the next four."""
    return let(F.struct(text.alias("t"), F.split(text, "\n").alias("rows")), lambda x: _labelled_amount(x["t"], x["rows"], label))


def _labelled_amount(text: Column, rows: Column, label: str) -> Column:
    same = amount(first(text, rf"(?:{label})(?:\s*\([^)]*\))?[\s\-:]*[A-Z$€£₹¥]*\s*([\d,]+\.\d+|[\d,]{{2,}}(?![/\-]))", 1, "i"))

    def candidate(line: Column, i: Column) -> Column:
        inline = _positive(first(F.regexp_replace(line, rx(f"(?:{label})", "i"), ""), r"[\$€£₹¥]?\s*([\d,]+\.\d{1,4})"))

        def look(ahead: Column) -> Column:
            # 1-based place of the first line that ends the search, 5 for none
            stop = F.coalesce(F.nullif(F.array_position(F.transform(ahead, lambda x: test(x, STOP, "i")), True).cast("int"), F.lit(0)), F.lit(5))
            return find(F.transform(F.slice(ahead, F.lit(1), stop - 1), lambda x: _positive(first(x, ALONE))), lambda v: v.isNotNull())

        later = let(F.transform(F.slice(rows, i + 2, F.lit(4)), trim), look)
        return F.when(test(line, f"(?:{label})", "i"), F.coalesce(inline, later))

    return F.coalesce(let(same, lambda v: F.when(v >= 0, v)), find(F.transform(rows, candidate), lambda v: v.isNotNull()))


def native_amount(text: Column, *labels: str) -> Column:
    """The first label that has an amount right after it."""
    tries = [amount(first(text, rf"(?:\b{x}\b)\s*[:\-]?\s*(?:[A-Z]{{3}}\s*)?[$€£₹]?\s*(\d{{1,3}}(?:,\d{{3}})*(?:\.\d{{1,2}})?)", 1, "i")) for x in labels]
    return F.coalesce(*tries)
