"""Totals of a document, and how much to trust what was read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.amounts import labelled_amount
from quillstone.functions.js import amount, empty, first, fixed, index_of, let, test, trim, words
from quillstone.functions.text import hits

TOTALS = ("subtotal", "total_tax", "shipping_cost", "discount", "tip", "service_charge", "amount_paid", "balance_due", "grand_total")


def parts_sum(parts: Column) -> Column:
    return fixed(F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.coalesce(p["total_amount"], F.lit(0.0))), 2)


def pos_tax(text: Column) -> Column:
    """Tax after the first tax-table line of a till slip: the smaller of the next two amounts that stand alone."""
    rows = F.split(text, "\n")

    def smaller(x: Column) -> Column:
        ahead = F.transform(F.slice(x["rows"], x["at"] + 2, F.lit(4)), lambda v: amount(first(trim(v), r"^\$?\s*([\d,]+\.\d{1,4})\s*$")))
        alone = F.filter(ahead, lambda v: v.isNotNull())
        return let(alone, lambda a: F.when((x["at"] >= 0) & (F.size(a) >= 2), F.least(F.get(a, F.lit(0)), F.get(a, F.lit(1)))))

    at = index_of(rows, lambda x: test(x, r"\bpct\b.*%", "i") | test(x, r"\btaxtable\b", "i"))
    return let(F.struct(rows.alias("rows"), at.alias("at")), smaller)


def totals(text: Column, footer_text: Column, parts: Column) -> Column:
    """``struct`` of the totals: labelled amounts of the footer first, reconciled with the items."""
    has_footer = F.length(footer_text) > 10
    both = F.struct(F.when(has_footer, F.concat(footer_text, F.lit("\n"), text)).otherwise(text).alias("search"), F.when(has_footer, footer_text).otherwise(text).alias("foot"), text.alias("text"), parts.alias("parts"))
    return let(both, lambda x: _totals(x["text"], x["search"], x["foot"], x["parts"]))


def _totals(text: Column, search: Column, foot: Column, parts: Column) -> Column:
    total = parts_sum(parts)
    labelled = labelled_amount(search, r"sub[\s\-]*total|subtotal")

    def build(s: Column) -> Column:
        subtotal = F.coalesce(s["labelled"], F.when(F.size(parts) > 0, s["sum"]))
        due = s["due"]
        grand = F.coalesce(
            labelled_amount(search, r"grand\s+total|total\s+amount\s+due|total\s+due"), F.when(due > 0, due), labelled_amount(search, r"amount\s*:"),
            labelled_amount(foot, r"(?:invoice|invoice\s+total|credit\s+card)\s*total|credit\s*card"), labelled_amount(foot, r"\btotal\b"), subtotal, F.lit(0.0),
        )
        zero = F.lit(0.0)
        derived = fixed(s["sum"] + F.coalesce(s["tax"], zero) + F.coalesce(s["shipping"], zero) - F.coalesce(s["discount"], zero), 2)
        none = F.lit(None).cast("double")
        return F.struct(
            F.coalesce(subtotal, F.when(s["sum"] > 0, s["sum"])).alias("subtotal"), s["tax"].alias("total_tax"), s["shipping"].alias("shipping_cost"), s["discount"].alias("discount"), none.alias("tip"), none.alias("service_charge"),
            labelled_amount(search, r"amount\s+paid|cash\s+tendered|tendered|credit\s*card").alias("amount_paid"), labelled_amount(search, r"balance\s+due|change\s+due|amount\s+due").alias("balance_due"),
            let(grand, lambda g: F.when((g > 0) & (subtotal > 0) & (g < subtotal * 0.8), F.when(s["sum"] > 0, derived).otherwise(subtotal)).otherwise(g)).alias("grand_total"),
        )

    tax = F.coalesce(pos_tax(text), labelled_amount(search, r"total\s+(?:gst|tax|vat)|(?:gst|tax|vat)\s+total|total\s+tax"), labelled_amount(search, r"(?:gst|tax|vat)"))
    seen = F.struct(
        labelled.alias("labelled"), total.alias("sum"), tax.alias("tax"), labelled_amount(search, r"shipping|delivery|freight|carriage").alias("shipping"),
        labelled_amount(search, r"discount|savings|rebate").alias("discount"), labelled_amount(search, r"amount\s+due|balance\s+due").alias("due"),
    )
    return let(seen, build)


# ---------------------------------------------------------------------------------------------------------------
# Confidence

WEIGHTS = {"ocr": 0.15, "fields": 0.35, "numeric": 0.2, "doc_type": 0.15, "keyword": 0.15}
# fixed values: keywords of the keyword factor
KEYWORDS = {
    "invoice": ("invoice", "inv", "bill to", "due date", "amount due", "po number"), "receipt": ("receipt", "thank you", "cash", "change", "subtotal", "purchase"),
    "purchase_order": ("purchase order", "p.o.", "po#", "ship to", "ordered by"), "work_order": ("work order", "wo#", "technician", "labour", "asset"), "bill": ("bill", "account number", "billing period", "pay by", "statement"),
    "quote": ("quotation", "quote", "estimate", "valid until", "proposal"), "cmms": ("cmms", "maintenance", "work request", "asset id", "breakdown"),
}


def ocr_factor(text: Column, confidence: Column) -> Column:
    return confidence * 0.6 + F.least(words(text) / 50.0, F.lit(1.0)) * 0.4


def fields_factor(supplier_name: Column, email: Column, phone: Column, buyer_name: Column, invoice_number: Column, invoice_date: Column, currency: Column, grand_total: Column, parts: Column) -> Column:
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    full = sum((one(~empty(c)) for c in (supplier_name, invoice_number, invoice_date, currency)), F.lit(0.0)) + one(grand_total > 0) + one(F.size(parts) > 0)
    half = sum((one(~empty(c)) * 0.5 for c in (email, phone, buyer_name)), F.lit(0.0))
    return F.least((full + half) / 7.5, F.lit(1.0))


def numeric_factor(t: Column, parts: Column) -> Column:
    zero = F.lit(0.0)
    subtotal = F.coalesce(t["subtotal"], F.aggregate(parts, zero, lambda a, p: a + F.coalesce(p["total_amount"], zero)))
    extra = sum((F.coalesce(t[k], zero) for k in ("total_tax", "shipping_cost", "tip", "service_charge")), zero) - F.coalesce(t["discount"], zero)
    delta = F.abs(subtotal + extra - t["grand_total"]) / F.nullif(t["grand_total"], zero)
    return (
        F.when(F.coalesce(F.size(parts), F.lit(0)) <= 0, 0.5).when((subtotal == 0) & (t["grand_total"] == 0), 0.4).when(t["grand_total"] == 0, 0.5)
        .when(delta < 0.01, 1.0).when(delta < 0.05, 0.8).when(delta < 0.15, 0.6).otherwise(0.3)
    )


def type_factor(claimed: Column, detected: Column) -> Column:
    a, b = F.lower(F.coalesce(claimed, detected)), F.lower(detected)
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.7).otherwise(0.3)


def keyword_factor(text: Column, kind: Column) -> Column:
    low = F.lower(text)
    chain = None
    for k, ws in KEYWORDS.items():
        v = hits(low, ws) / float(len(ws))
        chain = F.when(F.lower(kind) == k, v) if chain is None else chain.when(F.lower(kind) == k, v)
    return chain.otherwise(0.5)


def breakdown(ocr: Column, fields: Column, numeric: Column, doc_type: Column, keyword: Column) -> Column:
    """``struct(overall, ocr, fields, numeric, doc_type, keyword)``, each to four places, the overall from unrounded parts."""
    parts = {"ocr": ocr, "fields": fields, "numeric": numeric, "doc_type": doc_type, "keyword": keyword}
    overall = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.struct(fixed(overall, 4).alias("overall"), *[fixed(v, 4).alias(k) for k, v in parts.items()])
