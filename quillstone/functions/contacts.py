"""Telephones, e-mails and web addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.js import every, trim

# fixed values: shapes of contacts
PHONE = r"(?:\+\d{1,3}[ \t\-.]?)(?:\(?\d{1,4}\)?[ \t\-.]){1,4}\d{2,6}|(?:\(?\d{2,4}\)?[ \t\-.]?\d{3,4}[ \t\-.]?\d{3,4})"
EMAIL = r"[\w.+\-]+@[\w\-]+\.[\w.]{2,}"
URL = r"https?://[^\s]+|www\.[^\s]+"


def digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\D", ""))


def phones(text: Column) -> Column:
    """Distinct telephones in order: seven digits or more, not a postcode with its extension."""
    found = F.transform(every(text, PHONE), trim)
    return F.array_distinct(F.filter(found, lambda p: (digits(p) >= 7) & ~p.rlike(r"^\d{5}-\d{4}\z")))


def emails(text: Column) -> Column:
    return F.array_distinct(F.transform(every(text, EMAIL, 0, "i"), F.lower))


def urls(text: Column) -> Column:
    return F.array_distinct(F.transform(every(text, URL, 0, "i"), trim))


def best_phone(found: Column) -> Column:
    """A formatted telephone of ten digits before any plausible one."""

    def likely(p: Column) -> Column:
        return digits(p).between(7, 15) & ~p.rlike(r"\d{8,}")

    formatted = F.filter(found, lambda p: p.rlike(r"[()\-. ]") & (digits(p) >= 10) & likely(p))
    return F.coalesce(F.get(formatted, F.lit(0)), F.get(F.filter(found, likely), F.lit(0)))
