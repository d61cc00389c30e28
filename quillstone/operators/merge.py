"""Filling gaps of a record from predictions, and shaping the unified payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.functions.amounts import to_number
from quillstone.functions.dates import unified_date
from quillstone.functions.js import empty, parse_float


def fill_text(own: Column, predicted: Column) -> Column:
    """A prediction where the record's text is missing or empty."""
    return F.when(empty(own) & ~empty(predicted), predicted).otherwise(own)


def fill_amount(own: Column, predicted: Column, zero_only: bool = False) -> Column:
    """A number from a prediction where the record has none; zero counts as none (``zero_only``: null doesn't)."""
    missing = (own == 0) if zero_only else (own.isNull() | (own == 0))
    n = parse_float(predicted.cast("string"))
    return F.when(missing & n.isNotNull(), n).otherwise(own)


def gap_fill(records: DataFrame, predictions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Records with the gaps of transaction, parties and totals filled by the predictions of the same document.

    ``predictions``: at most one row per key, named as ``entities.entity_fields`` gives them. A left join on the key, so
    documents without a prediction stay as they are; a small side is broadcast by the adaptive plan, a large one shuffled.
    """
    p = predictions.select(F.col(key), *[F.col(c).alias(f"p_{c}") for c in predictions.columns if c != key])
    have = set(predictions.columns)
    j = records.join(p, key, "left")

    def pred(name: str) -> Column:
        return F.col(f"p_{name}") if name in have else F.lit(None).cast("string")

    d, t = F.col("transaction"), F.col("totals")
    out = j.withColumn("transaction", d.withField("invoice_number", fill_text(d["invoice_number"], pred("invoice_number"))).withField("purchase_order_number", fill_text(d["purchase_order_number"], pred("po_number"))).withField("invoice_date", fill_text(d["invoice_date"], pred("date_issued"))))
    out = out.withColumn("supplier", F.col("supplier").withField("name", fill_text(F.col("supplier")["name"], pred("vendor_name")))).withColumn("buyer", F.col("buyer").withField("name", fill_text(F.col("buyer")["name"], pred("buyer_name"))))
    out = out.withColumn("totals", t.withField("grand_total", fill_amount(t["grand_total"], pred("grand_total"), True)).withField("subtotal", fill_amount(t["subtotal"], pred("sub_total"))).withField("total_tax", fill_amount(t["total_tax"], pred("total_tax"))).withField("balance_due", fill_amount(t["balance_due"], pred("amount_due"))))
    return out.drop(*[c for c in out.columns if c.startswith("p_")])


def rescored(before: Column, after: Column) -> Column:
    """The better of two overall scores; the breakdown isn't renewed."""
    return F.greatest(before, after)


def enhance_confidence(inferred: Column, rule: Column) -> Column:
    """Confidence after an offline model: never below the rules', at most 0.97."""
    return F.least(F.greatest(F.coalesce(inferred, rule + 0.12), rule), F.lit(0.97))


def first_per_label(entities: Column, minimum: float = 0.45) -> Column:
    """Map of lower-case label to the first usable text of ``array<struct(label, text, score)>``."""
    good = F.filter(entities, lambda e: (F.trim(F.coalesce(e["text"], F.lit(""))) != "") & (F.coalesce(e["score"], F.lit(1.0)) >= minimum))
    keys = F.array_distinct(F.transform(good, lambda e: F.lower(e["label"])))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.trim(F.get(F.filter(good, lambda e: F.lower(e["label"]) == k), F.lit(0))["text"])))


def read_text(fields: Column, *names: str) -> Column:
    """The first non-blank of several keys of a map."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(fields, F.lit(n))), F.lit("")) for n in names])


def read_number(fields: Column, *names: str) -> Column:
    return F.coalesce(*[to_number(F.try_element_at(fields, F.lit(n))) for n in names])


def mapped_fields(fields: Column, labels: Column, grand_total: Column) -> Column:
    """What an offline model's fields and entities say, keys before labels."""
    lab = lambda k: F.try_element_at(labels, F.lit(k))
    return F.struct(
        F.coalesce(read_text(fields, "invoice_number", "invoiceNo"), lab("invoice_number"), lab("invoice-no")).alias("invoice_number"),
        F.coalesce(read_text(fields, "po_number", "purchase_order_number"), lab("po_number"), lab("po-number")).alias("po_number"),
        F.coalesce(read_text(fields, "vendor_name", "supplier_name"), lab("vendor"), lab("supplier_name")).alias("vendor_name"),
        F.coalesce(read_text(fields, "buyer_name", "customer_name"), lab("buyer"), lab("customer")).alias("buyer_name"),
        F.coalesce(read_number(fields, "grand_total", "total_amount", "amount_due"), to_number(lab("grand_total")), grand_total).alias("grand_total"),
        F.coalesce(read_number(fields, "sub_total", "subtotal"), to_number(lab("sub_total"))).alias("subtotal"), F.coalesce(read_number(fields, "total_tax", "tax_total"), to_number(lab("tax"))).alias("total_tax"),
        F.coalesce(read_number(fields, "amount_paid"), to_number(lab("amount_paid"))).alias("amount_paid"),
    )


def overlay_fields(payload: dict[str, Column], fields: Column) -> dict[str, Column]:
    """Sections of a unified payload filled from a field map; totals only where null, since 0 is a value there."""
    out = dict(payload)
    text = lambda k: F.nullif(F.trim(F.try_element_at(fields, F.lit(k))), F.lit(""))
    for section, keys in {"header": ("invoice_number", "order_number", "po_number", "date_issued"), "vendor": ("vendor_name:name",), "buyer": ("buyer_name:name",), "payment": ("payment_method", "masked_account", "aid", "cryptogram"), "remittance": ("remit_to_name",)}.items():
        s = out.get(section)
        if s is None:
            continue
        for k in keys:
            src, _, dst = k.partition(":")
            v = text(src)
            v = F.coalesce(unified_date(v), v) if src == "date_issued" else v
            s = s.withField(dst or src, fill_text(s[dst or src], v))
        out[section] = s
    t = out.get("totals")
    if t is not None:
        for k in ("sub_total", "total_tax", "grand_total", "amount_paid", "amount_due"):
            t = t.withField(k, F.coalesce(t[k], to_number(F.try_element_at(fields, F.lit(k)))))
        out["totals"] = t
    return out


def images(uris: Column, names: Column | None = None) -> Column:
    """``array<struct(image_id, file_name, page_index)>`` of page addresses."""

    def one(u: Column, i: Column) -> Column:
        own = F.element_at(F.split(u, "/", -1), -1)
        given = F.get(names, i) if names is not None else F.lit(None).cast("string")
        return F.struct(F.concat(F.lit("img_"), F.lpad((i + 1).cast("string"), 3, "0")).alias("image_id"), F.coalesce(given, own).alias("file_name"), i.alias("page_index"))

    return F.transform(uris, one)


def payload_shape(document_id: Column, document_type: Column, currency: Column, date_issued: Column, fallback_id: Column) -> Column:
    """The defaults every unified payload gets."""
    return F.struct(
        F.when(empty(document_id), fallback_id).otherwise(document_id).alias("document_id"), F.when(document_type.isin(*tx.UNIFIED_TYPES), document_type).otherwise("invoice").alias("document_type"),
        F.when(F.coalesce(currency.rlike(r"^[A-Z]{3}\z"), F.lit(False)), currency).otherwise("USD").alias("currency"), F.coalesce(F.when(~empty(date_issued), unified_date(date_issued)), date_issued).alias("date_issued"),
    )


def model_payload(text: Column, uris: Column, fields: Column, language: Column, ocr_confidence: Column, model_confidence: Column) -> Column:
    """The unified payload the native builders make from a prediction's fields."""
    s = lambda k: F.try_element_at(fields, F.lit(k))
    n = lambda k: s(k).try_cast("double")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.struct(
        tx.native_type(text, ~blank(s("invoice_number")), ~blank(s("receipt_number"))).alias("document_type"), F.concat(language, F.lit("-US")).alias("locale"), tx.native_currency(text).alias("currency"), images(uris).alias("images"),
        F.struct(*[s(k).alias(k) for k in ("invoice_number", "receipt_number", "po_number", "order_number", "date_issued")], F.size(uris).alias("page"), F.size(uris).alias("total_pages")).alias("header"),
        F.struct(s("vendor_name").alias("name")).alias("vendor"), F.struct(*[n(k).alias(k) for k in ("sub_total", "total_tax", "grand_total", "amount_paid", "amount_due")]).alias("totals"),
        F.struct(text.alias("raw_text")).alias("metadata"),
        F.struct(F.lit("mlkit").alias("ocr_engine"), F.struct(ocr_confidence.alias("ocr"), model_confidence.alias("model")).alias("confidence"), F.struct(F.lit(True).alias("used"), F.lit("native").alias("source")).alias("model")).alias("audit"),
    )
