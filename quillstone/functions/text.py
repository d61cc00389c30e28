"""Normalising scanned text and telling its currency, language and kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.js import first, lines, rx, test, words

__all__ = ["normalise", "lines", "words"]


def normalise(text: Column, parity: bool = False) -> Column:
    """Common slips of a scanner put right. ``parity`` keeps the original rule that turns ``S12.50`` into ``$1``."""
    t = F.regexp_replace(text, rx(r"(\$\s*)[lI](\d)"), "$11$2")
    t = F.regexp_replace(t, r"(\d)[Oo](\d)", "$10$2")
    t = F.regexp_replace(t, rx(r"(?<=\s)S(\d{1,3}(?:,\d{3})*\.\d{2})\b"), r"\$1" if parity else r"\$$1")
    t = F.regexp_replace(t, r"[ \t]{2,}", "  ")
    t = F.regexp_replace(t, rx(r"(?<=\d) (?=\d{3}(?:[.,]|\b))"), "")
    t = F.translate(t, "–—", "--")
    t = F.regexp_replace(t, "[\\u200B-\\u200D\\uFEFF]", "")
    return F.regexp_replace(t, r"(?md)[ \t]+$", "")


# fixed values: currency marks in the order they are tried, with code and symbol
CURRENCIES = (
    (r"A\$|AUD|australian\s+dollar", "AUD", "A$"), (r"\$|USD|US\$|US\s+dollar", "USD", "$"), (r"€|EUR|euro", "EUR", "€"), (r"£|GBP|sterling", "GBP", "£"), (r"₹|INR|Rs\.", "INR", "₹"),
    (r"¥|JPY|yen", "JPY", "¥"), (r"NZD|NZ\$", "NZD", "NZ$"), (r"CAD|C\$", "CAD", "C$"), (r"SGD|S\$", "SGD", "S$"), (r"AED|dirham", "AED", "AED"),
)


def currency(text: Column, what: str = "code") -> Column:
    """``code`` or ``symbol`` of the first currency mark in the fixed order, US dollars by default."""
    i = 1 if what == "code" else 2
    chain = None
    for row in CURRENCIES:
        chain = F.when(test(text, row[0], "i"), row[i]) if chain is None else chain.when(test(text, row[0], "i"), row[i])
    return chain.otherwise("USD" if what == "code" else "$")


# fixed values: words that tell a language, tried in this order on the first 800 characters
LANGUAGE_WORDS = (
    ("en", "the|and|for|with|from|this|that|are|have|not|invoice|receipt|payment|shipping|price|quantity|amount|order|discount|street|phone|terms"),
    ("fr", "le|la|les|de|du|un|une|avec|pour|pas"), ("de", "der|die|das|und|für|mit|nicht|ein|eine"), ("es", "el|la|los|de|del|un|una|con|para|que"), ("it", "il|lo|la|e|di|del|un|una|con|per"),
)


def language(text: Column) -> Column:
    s = F.lower(F.substring(text, 1, 800))
    chain = None
    for code, ws in LANGUAGE_WORDS:
        c = test(s, rf"\b({ws})\b")
        chain = F.when(c, code) if chain is None else chain.when(c, code)
    return chain.otherwise("en")


# fixed values: keywords of each document type, in the order that settles ties
TYPE_WORDS = (
    ("invoice", ("invoice", "inv #", "inv no", "bill to", "amount due", "tax invoice")), ("receipt", ("receipt", "thank you for your purchase", "cash", "change due", "transaction")),
    ("purchase_order", ("purchase order", "p.o.", "po#", "po number", "ship to", "ordered by")), ("work_order", ("work order", "wo#", "technician", "labour", "asset id", "fault")),
    ("bill", ("bill", "billing period", "account no", "utility", "electricity", "gas")), ("statement", ("statement", "opening balance", "closing balance", "transactions")),
    ("quote", ("quotation", "quote", "estimate", "valid until", "quoted")), ("cmms", ("cmms", "maintenance", "work request", "preventive maintenance")),
    ("supplier_document", ("vendor", "supplier", "packing list", "delivery note", "delivery docket")), ("contract", ("contract", "agreement", "whereas", "parties", "signed")),
)
DOCUMENT_TYPES = tuple(t for t, _ in TYPE_WORDS) + ("generic",)


def hits(lower: Column, keywords: tuple[str, ...]) -> Column:
    """How many keywords a lower-case text contains."""
    total = F.lit(0)
    for k in keywords:
        total = total + lower.contains(k).cast("int")
    return total


def document_type(text: Column) -> Column:
    """The type most of whose keywords occur; the earlier type wins a tie, none at all is ``generic``."""
    low = F.lower(text)
    scored = F.array(*[F.struct(hits(low, ks).alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, (t, ks) in enumerate(TYPE_WORDS)])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["t"]).otherwise("generic")


def sdk_type_confidence(text: Column) -> Column:
    return F.least(words(text) / 100.0, F.lit(0.9))


# fixed values: keywords of the native classifiers
NATIVE_WORDS = (
    ("receipt", ("receipt", "total", "subtotal", "tax", "change", "cash", "credit card", "debit", "thank you", "purchase", "store", "qty", "item", "price")),
    ("invoice", ("invoice", "inv", "bill to", "ship to", "due date", "payment terms", "amount due", "balance due", "po number", "remittance", "net")),
    ("bill", ("bill", "account number", "statement", "billing period", "amount due", "pay by", "utility", "service charge", "usage", "meter")),
    ("contract", ("contract", "agreement", "terms and conditions", "whereas", "hereby", "parties", "effective date", "signature", "witness", "clause")),
)


def native_class(text: Column, platform: str = "android", keywords: tuple = NATIVE_WORDS) -> Column:
    """``struct(type, confidence)`` of the native classifiers; ties go by the order of the lists on both platforms."""
    low = F.lower(text)
    scored = F.array(*[F.struct(hits(low, ks).cast("double").alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, (t, ks) in enumerate(keywords)])
    top = F.array_max(scored)
    total = F.aggregate(scored, F.lit(0.0), lambda a, x: a + x["n"])
    p = top["n"] / F.nullif(total, F.lit(0.0))
    if platform == "android":
        low_case = (p < 0.7) & (top["n"] < 3)
        kind = F.when((total == 0) | low_case, "generic").otherwise(top["t"])
        conf = F.when((total == 0) | low_case, 0.5).otherwise(F.least(p + 0.3, F.lit(1.0)))
    else:
        c = F.when(top["n"] >= 3, F.least(p * 1.15, F.lit(0.95))).otherwise(p * 0.85)
        generic = (c < 0.5) | (top["n"] < 2)
        kind = F.when((total == 0) | generic, "generic").otherwise(top["t"])
        conf = F.when(total == 0, 0.5).when(generic, F.greatest(c, F.lit(0.4))).otherwise(c)
    return F.struct(kind.alias("type"), conf.alias("confidence"))


# fixed values: the types of the unified schema
UNIFIED_TYPES = ("invoice", "receipt", "pos_receipt", "cash_sale", "payment_receipt", "remittance", "credit_memo")


def unified_type(text: Column, given: Column | None = None) -> Column:
    """A valid given type, else the first that the text speaks for."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = low.contains
    chain = (
        F.when(has("credit memo"), "credit_memo").when(has("remittance"), "remittance").when(has("payment") & has("receipt"), "payment_receipt").when(has("pos") & has("receipt"), "pos_receipt")
        .when(has("cash sale"), "cash_sale").when(has("receipt"), "receipt").otherwise("invoice")
    )
    return chain if given is None else F.when(given.isin(*UNIFIED_TYPES), given).otherwise(chain)


def native_type(text: Column, has_invoice: Column, has_receipt: Column) -> Column:
    """The native builders' order of tests, invoices first."""
    low = F.lower(text)
    return (
        F.when(has_invoice | low.contains("invoice"), "invoice")
        .when(has_receipt | low.contains("receipt"), F.when(low.contains("pos"), "pos_receipt").when(low.contains("payment"), "payment_receipt").otherwise("receipt"))
        .when(low.contains("credit memo"), "credit_memo").when(low.contains("remittance"), "remittance").otherwise("invoice")
    )


def native_currency(text: Column) -> Column:
    up = F.upper(text)
    return F.when(up.contains("USD") | up.contains("$"), "USD").when(up.contains("EUR") | up.contains("€"), "EUR").when(up.contains("GBP") | up.contains("£"), "GBP").when(up.contains("INR") | up.contains("₹"), "INR").otherwise("USD")


def unified_currency(given: Column, text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(given.rlike(r"^[A-Z]{3}\z"), given).when(low.contains("eur") | low.contains("€"), "EUR").when(low.contains("gbp") | low.contains("£"), "GBP").when(low.contains("inr") | low.contains("₹"), "INR").otherwise("USD")
    )


def native_ocr_confidence(text: Column) -> Column:
    return F.least(F.greatest(0.45 + F.least(words(text), F.lit(200)) / 400.0, F.lit(0.45)), F.lit(0.95))


# fixed values: language codes of the second scanner
OCR_LANGUAGES = {"en": "eng", "fr": "fra", "de": "deu", "es": "spa", "it": "ita", "pt": "por", "nl": "nld", "zh": "chi_sim", "ja": "jpn", "ko": "kor", "ar": "ara", "hi": "hin"}


def ocr_language(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in OCR_LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(code)), code)


def time_of(text: Column) -> Column:
    return first(text, r"\b(\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?)\b", 1, "i")
