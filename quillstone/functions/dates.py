"""Dates and times as strings: no calendar is consulted, since unreadable dates pass through as they stand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.js import first, let

_VALUE = r"\d{1,4}[-/. ]\d{1,2}[-/. ]\d{2,4}"


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))


def normalise_date(raw: Column) -> Column:
    """A date in ISO form, by the rules for ambiguous orders: day first with four-digit years, month first with two."""
    return let(raw, _normalise_date)


def _normalise_date(raw: Column) -> Column:
    ymd = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\z"
    long = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})\z"
    short = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})\z"

    def part(p: str, g: int) -> tuple[Column, Column]:
        s = F.regexp_extract(raw, p, g)
        return s, s.try_cast("int")

    y, _ = part(ymd, 1)
    a, an = part(ymd, 2)
    b, bn = part(ymd, 3)
    swap = (an > 12) & bn.between(1, 12)
    from_ymd = F.when(swap, _iso(y, b, a)).otherwise(_iso(y, a, b))
    ly, _ = part(long, 3)
    la, lan = part(long, 1)
    lb, lbn = part(long, 2)
    month_first = (lbn > 12) & lan.between(1, 12) & ~((lan > 12) & lbn.between(1, 12))
    from_long = F.when(month_first, _iso(ly, la, lb)).otherwise(_iso(ly, lb, la))
    sy, syn = part(short, 3)
    sa, san = part(short, 1)
    sb, sbn = part(short, 2)
    day_first = (san > 12) & sbn.between(1, 12)
    year = (F.lit(2000) + syn).cast("string")
    from_short = F.when(day_first, _iso(year, sb, sa)).otherwise(_iso(year, sa, sb))
    # an ISO date stays, unless only a swap of day and month makes it one
    strict = raw.rlike(r"^\d{4}-\d{2}-\d{2}\z")
    good = an.between(1, 12) & bn.between(1, 31)
    swapped = bn.between(1, 12) & an.between(1, 31)
    return (
        F.when(strict, F.when(good, raw).when(swapped, _iso(y, b, a)).otherwise(raw))
        .when(raw.rlike(ymd), from_ymd).when(raw.rlike(long), from_long).when(raw.rlike(short), from_short).otherwise(raw)
    )


ISO = r"\b(\d{4}[-/]\d{2}[-/]\d{2})\b"
DMY = r"\b(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})\b"
LONG = r"\b(\d{1,2})\s+(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+(\d{4})\b"


def first_date(text: Column) -> Column:
    return F.coalesce(normalise_date(first(text, ISO, 0)), normalise_date(first(text, DMY, 0)), first(text, LONG, 0, "i"))


# fixed values: labels of dates
INVOICE_DATE = rf"(?:invoice\s*date|date\s*of\s*invoice|date\s*issued|issued|date)\s*[:\-]?\s*({_VALUE})"
DUE_DATE = rf"(?:due\s*date|payment\s*due|pay\s*by|payable\s*(?:by|on)|due\s*on)\s*[:\-]?\s*({_VALUE})"
DEAL_DATE = rf"(?:transaction|sale|purchase|order)\s*date\s*[:\-]?\s*({_VALUE})"


def dates(text: Column) -> Column:
    """``struct(invoice_date, due_date, transaction_date)``."""
    seen = F.struct(
        F.coalesce(normalise_date(first(text, INVOICE_DATE, 1, "i")), normalise_date(first(text, ISO, 0))).alias("invoice"), normalise_date(first(text, DUE_DATE, 1, "i")).alias("due"),
        normalise_date(first(text, DEAL_DATE, 1, "i")).alias("deal"), normalise_date(first(text, r"\b(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\b")).alias("bare"),
    )

    def build(d: Column) -> Column:
        likely = d["bare"].rlike(r"\d{4}") | d["bare"].rlike(r"\d{2}[-/.]\d{2}[-/.]\d{2}")
        deal = F.coalesce(d["deal"], F.when(d["invoice"].isNull() & likely, d["bare"]))
        return F.struct(d["invoice"].alias("invoice_date"), d["due"].alias("due_date"), deal.alias("transaction_date"))

    return let(seen, build)


def _whole(text: Column) -> Column:
    """The integer a text begins with, as the source language parses it."""
    return F.regexp_extract(text, r"^\s*([-+]?\d+)", 1).try_cast("int")


def unified_date(value: Column) -> Column:
    """ISO for the unified payload: month first unless the year leads; null where there aren't three parts."""
    raw = F.trim(value)
    parts = F.split(F.regexp_replace(raw, "-", "/"), "/", -1)
    p0, p1, p2 = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))

    def two(p: Column) -> Column:
        n = _whole(p)
        return F.lpad(F.when(F.coalesce(n, F.lit(0)) == 0, 1).otherwise(n).cast("string"), 2, "0")

    year = F.when(F.length(p2) == 2, F.concat(F.lit("20"), p2)).otherwise(p2)
    return (
        F.when(raw.isNull() | raw.rlike(r"^\d{4}-\d{2}-\d{2}\z"), raw).when(F.size(parts) != 3, F.lit(None).cast("string"))
        .when(F.length(p0) == 4, F.concat_ws("-", p0, two(p1), two(p2))).otherwise(F.concat_ws("-", year, two(p0), two(p1)))
    )


def native_date(raw: Column) -> Column:
    """The native builders' ISO form: month first, 01 for what isn't a number, the text itself for another shape."""
    parts = F.split(F.regexp_replace(raw, "-", "/"), "/", -1)
    p0, p1, p2 = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))

    def two(p: Column) -> Column:
        return F.coalesce(F.lpad(F.when(p.rlike(r"^-?\d{1,9}\z"), p.try_cast("int").cast("string")), 2, "0"), F.lit("01"))

    year = F.when(F.length(p2) == 2, F.concat(F.lit("20"), p2)).otherwise(p2)
    return (
        F.when(F.coalesce(F.trim(raw), F.lit("")) == "", F.lit(None).cast("string")).when(raw.rlike(r"^\d{4}-\d{2}-\d{2}\z"), raw).when(F.size(parts) != 3, raw)
        .when(F.length(p0) == 4, F.concat_ws("-", p0, two(p1), two(p2))).otherwise(F.concat_ws("-", year, two(p0), two(p1)))
    )


def native_time(raw: Column) -> Column:
    p = F.split(raw, ":", -1)

    def two(i: int) -> Column:
        return F.lpad(F.coalesce(F.get(p, F.lit(i)).try_cast("int"), F.lit(0)).cast("string"), 2, "0")

    return F.when((F.coalesce(F.trim(raw), F.lit("")) == "") | (F.size(p) < 2), F.lit(None).cast("string")).when(F.size(p) >= 3, F.concat_ws(":", two(0), two(1), two(2))).otherwise(F.concat_ws(":", two(0), two(1)))


