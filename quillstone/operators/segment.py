"""Header, body and footer of a document's lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.js import index_of, let, test
from quillstone.functions.text import hits

# fixed values: words that open the body, head a table, or open the footer
_BODY = r"^(?:description|item|qty|quantity|part\s*(?:no|#)|sku|unit\s*price|amount|sub[\s\-]*total|grand\s*total|bill\s*to|ship\s*to|customer|product|service|particular|rate|no\.?\s|sr\.?\s*no)"
_TABLE = ("description", "item", "qty", "quantity", "unit price", "price", "amount", "total", "tax", "sku", "product", "rate", "particular")
_FOOTER = r"^(?:sub\s*total|subtotal|total|tax|gst|vat|shipping|delivery|discount|balance|amount\s+due|net\s+amount|gross\s+amount|grand\s+total)"


def bounds(rows: Column) -> Column:
    """``struct(header_end, footer_start)``, 0-based."""
    return let(rows, _bounds)


def _bounds(rows: Column) -> Column:
    n = F.size(rows)
    top = F.slice(rows, 1, 25)
    usual = F.least(F.lit(8), n)
    hit = index_of(top, lambda x: test(x, _BODY, "i"))
    table = index_of(top, lambda x: hits(F.lower(x), _TABLE) >= 2)
    # a hit at the default place counts as none, so the table header may still move it
    first = let(hit, lambda h: F.when(h >= 0, h).otherwise(usual))
    end = let(F.struct(first.alias("e"), table.alias("t")), lambda x: F.when((x["e"] == usual) & (x["t"] >= 0), x["t"]).otherwise(x["e"]))
    place = F.transform(rows, lambda x, i: F.struct(i.alias("i"), test(x, _FOOTER, "i").alias("f")))

    def whole(e: Column) -> Column:
        foot = F.get(F.filter(place, lambda s: s["f"] & (s["i"] >= e) & (s["i"] > n * 0.35)), F.lit(0))["i"]
        start = F.coalesce(foot, F.greatest(F.floor(n * 0.75).cast("int"), n - 15))
        return F.struct(e.alias("header_end"), start.cast("int").alias("footer_start"))

    return let(end.cast("int"), whole)


def header(rows: Column, b: Column) -> Column:
    return F.slice(rows, F.lit(1), b["header_end"])


def body(rows: Column, b: Column) -> Column:
    return F.slice(rows, b["header_end"] + 1, F.greatest(b["footer_start"] - b["header_end"], F.lit(0)))


def footer(rows: Column, b: Column) -> Column:
    """A negative start counts from the end, as slicing did in the original."""
    n = F.size(rows)
    s = F.when(b["footer_start"] < 0, F.greatest(n + b["footer_start"], F.lit(0))).otherwise(b["footer_start"])
    return F.slice(rows, s + 1, F.greatest(n - s, F.lit(0)))
