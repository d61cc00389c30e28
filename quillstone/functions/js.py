"""Column helpers with the semantics of the source language: regular expressions, numbers, whitespace, truthiness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: whitespace as the source language has it, for use inside a character class
WS = r"\t\n\x0B\f\r    -     　﻿"
WS_LINE = WS.replace(r"\n", "")
#: a word boundary between ASCII word characters only
BOUND = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def rx(pattern: str, flags: str = "") -> str:
    """A pattern of the source dialect as a Java pattern: ``\\b``, ``\\s``, ``$`` and the flags i and m mean what they meant there."""
    out: list[str] = []
    inside = False
    i = 0
    while i < len(pattern):
        if pattern.startswith(r"[^\S\n]", i):
            out.append(f"[{WS_LINE}]")
            i += 7
            continue
        if pattern.startswith(r"[\s\S]", i):
            out.append("(?s:.)")
            i += 6
            continue
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(WS if inside else f"[{WS}]")
            elif nxt == "S" and not inside:
                out.append(f"[^{WS}]")
            elif nxt == "b" and not inside:
                out.append(BOUND)
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not inside:
            inside = True
        elif ch == "[" and inside:
            out.append("\\[")
            i += 1
            continue
        elif ch == "]" and inside:
            inside = False
        elif ch == "$" and not inside and "m" not in flags:
            out.append(r"\z")
            i += 1
            continue
        out.append(ch)
        i += 1
    on = "d" + ("i" if "i" in flags else "") + ("m" if "m" in flags else "")
    return f"(?{on})" + "".join(out)


def first(text: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """A group of the first match; null where nothing, or only an empty group, matches."""
    return F.nullif(F.regexp_extract(text, rx(pattern, flags), group), F.lit(""))


def every(text: Column, pattern: str, group: int = 0, flags: str = "") -> Column:
    """A group of all matches."""
    return F.regexp_extract_all(text, F.lit(rx(pattern, flags)), F.lit(group))


def test(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(rx(pattern, flags))


def sub(text: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(text, rx(pattern, flags), by)


def trim(text: Column) -> Column:
    """All of the source language's whitespace off both ends."""
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+\\z", "")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WS}]+", " ")


def parse_float(text: Column) -> Column:
    """The number a text begins with; null where it doesn't."""
    return F.nullif(F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+))", 1), F.lit("")).try_cast("double")


def amount(text: Column) -> Column:
    """``parse_float`` with thousands commas gone."""
    return parse_float(F.regexp_replace(text, ",", ""))


def fixed(x: Column, places: int) -> Column:
    return F.round(x, places)


def empty(text: Column) -> Column:
    """Null or blank-free emptiness, as the source language's falsy strings."""
    return text.isNull() | (text == "")


def find(array: Column, keep: Callable[[Column], Column]) -> Column:
    """The first element that ``keep`` holds for, or null."""
    return F.get(F.filter(array, keep), F.lit(0))


def index_of(array: Column, holds: Callable[[Column], Column]) -> Column:
    """0-based place of the first element ``holds`` is true for; -1 for none."""
    return F.coalesce(F.array_position(F.transform(array, lambda x: F.coalesce(holds(x), F.lit(False))), True).cast("int"), F.lit(0)) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; for use inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(text: Column) -> Column:
    """Trimmed non-empty lines in order."""
    return F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != "")


def words(text: Column) -> Column:
    """Count of whitespace-separated words."""
    return F.size(F.filter(F.split(text, f"[{WS}]+"), lambda w: w != ""))


def capitals(text: Column) -> Column:
    """Upper-cases the first letter of each word and leaves the rest as it is."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\w+|\W+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), "")


def no_field(struct: Column, *names: str) -> Column:
    """A struct, or null where all the named fields are null."""
    return let(struct, lambda s: F.when(F.coalesce(*[s[n].cast("string") if n != "address" else s[n]["full_address"] for n in names]).isNotNull(), s))
