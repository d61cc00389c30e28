"""Documents into records: ``parse``, ``extract``, and the same over a stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import parties, text as tx, transaction as tr
from quillstone.functions.js import lines
from quillstone.operators import items, segment, totals as tt


@dataclass(frozen=True)
class ExtractConfig:
    """How a run reads its documents."""

    text: str = "text"
    #: columns that may override what is detected
    document_type: str | None = None
    language: str | None = None
    ocr_confidence: str | None = None
    default_ocr_confidence: float = 0.85
    ai_threshold: float = 0.65
    #: reproduce the original's slip in the dollar rule
    parity: bool = False


def parse(df: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """``df`` with the sections of the record added as columns.

    Per-row expressions only: no shuffle, works the same on a stream. Steps are laid down as columns so that each is
    computed once. A null text reads as an empty document.
    """
    raw = F.coalesce(F.col(config.text).cast("string"), F.lit(""))
    out = df.withColumn("norm_text", tx.normalise(raw, config.parity))
    out = out.withColumn("norm_lines", lines(F.col("norm_text")))
    t, rows = F.col("norm_text"), F.col("norm_lines")
    out = out.withColumn("bounds", segment.bounds(rows))
    b = F.col("bounds")
    kind = tx.document_type(t) if config.document_type is None else F.coalesce(F.col(config.document_type), tx.document_type(t))
    lang = tx.language(t) if config.language is None else F.coalesce(F.col(config.language), tx.language(t))
    out = out.withColumns({
        "header_lines": segment.header(rows, b), "body_lines": segment.body(rows, b), "footer_text": F.array_join(segment.footer(rows, b), "\n"), "document_type_detected": kind, "language_detected_by_rule": lang,
        "currency_detected": tx.currency(t),
    })
    head = F.array_join(F.col("header_lines"), "\n")
    out = out.withColumns({
        "supplier": F.struct(F.coalesce(parties.supplier_name(F.col("header_lines")), F.lit("")).alias("name"), parties.address(head).alias("address"), parties.contact(head).alias("contact"), parties.tax_information(head, t).alias("tax_information")),
        "buyer": parties.buyer(rows),
        "transaction": tr.transaction(t, F.col("currency_detected")),
        "parts": items.extract_parts(F.col("body_lines"), rows),
    })
    out = out.withColumns({"totals": tt.totals(t, F.col("footer_text"), F.col("parts")), "payment_details": tr.payment_details(t), "delivery_details": tr.delivery_details(t), "notes_found": tr.notes(t)})
    return out.withColumn("field_count", field_count(F.col("supplier"), F.col("buyer"), F.col("transaction"), F.col("totals"), F.col("parts")))


def field_count(supplier: Column, buyer: Column, deal: Column, totals: Column, parts: Column) -> Column:
    """Filled members of the sections and the number of items; an address or contact counts though it be empty."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    n = one(supplier["name"] != "") + F.lit(2) + one(supplier["tax_information"].isNotNull())
    labelled = buyer["full_address"].isNotNull()
    n = n + one(buyer["name"] != "") + F.when(labelled, 2).otherwise(0)
    n = n + sum((one(deal[k].isNotNull() & (deal[k] != "")) for k in tr.TRANSACTION), F.lit(0))
    n = n + sum((one(totals[k].isNotNull()) for k in tt.TOTALS), F.lit(0)) + 1
    return n + F.size(parts)


def score(df: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """Adds ``confidence`` (all factors) to parsed documents."""
    conf = F.lit(config.default_ocr_confidence) if config.ocr_confidence is None else F.coalesce(F.col(config.ocr_confidence), F.lit(config.default_ocr_confidence))
    raw = F.coalesce(F.col(config.text), F.lit(""))
    s, d, t, p, kind = F.col("supplier"), F.col("transaction"), F.col("totals"), F.col("parts"), F.col("document_type_detected")
    fields = tt.fields_factor(s["name"], s["contact"]["email"], s["contact"]["phone"], F.col("buyer")["name"], d["invoice_number"], d["invoice_date"], d["currency"], t["grand_total"], p)
    return df.withColumn("confidence", tt.breakdown(tt.ocr_factor(raw, conf), fields, tt.numeric_factor(t, p), tt.type_factor(kind, kind), tt.keyword_factor(raw, kind)))


def extract(df: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """Parsed, scored and cut down to what the original hands its caller."""
    return sanitise(score(parse(df, config), config), [c for c in df.columns])


#: members of an item that the sanitised record keeps
KEPT_PART = ("item_name", "description", "sku", "part_number", "manufacturer_part_number", "quantity", "unit", "unit_price", "discount", "tax_percentage", "tax_amount", "total_amount")
KEPT_DEAL = ("invoice_number", "purchase_order_number", "quote_number", "invoice_date", "due_date", "transaction_date", "transaction_time", "payment_mode", "payment_terms")


def sanitise(df: DataFrame, keep: list[str]) -> DataFrame:
    """The whitelist projection with its defaults; ``keep``: columns carried along. Clashing names are replaced by the record's."""
    d, t = F.col("transaction"), F.col("totals")
    own = {
        "document_type": F.coalesce("document_type_detected", F.lit("generic")), "confidence_score": F.coalesce(F.col("confidence")["overall"], F.lit(0.0)), "language_detected": F.coalesce("language_detected_by_rule", F.lit("en")),
        "supplier": F.col("supplier"), "buyer": F.col("buyer"),
        "transaction": F.struct(*[d[k].alias(k) for k in KEPT_DEAL], F.coalesce(d["currency"], F.lit("USD")).alias("currency")),
        "parts": F.transform(F.coalesce("parts", F.array().cast(f"array<{items.ITEM}>")), lambda p: F.struct(*[{"item_name": F.coalesce(p["item_name"], F.lit("")), "quantity": F.coalesce(p["quantity"], F.lit(1.0)), "total_amount": F.coalesce(p["total_amount"], F.lit(0.0))}.get(k, p[k]).alias(k) for k in KEPT_PART])),
        "totals": F.struct(*[t[k].alias(k) for k in tt.TOTALS if k != "grand_total"], F.coalesce(t["grand_total"], F.lit(0.0)).alias("grand_total")),
    }
    return df.select(*[F.col(c) for c in keep if c not in own], *[v.alias(k) for k, v in own.items()])


def exploded_parts(df: DataFrame, *keys: str) -> DataFrame:
    """One row per item of parsed documents: the keys, ``line_no`` from 0, and the item's fields."""
    # inline keeps the items one expression; reading fields of an exploded struct would compute them once per field
    fields = [f.split(":")[0] for f in items.ITEM[len("struct<") : -1].split(",")]
    return df.select(*keys, F.inline(F.transform("parts", lambda p, i: F.struct(i.alias("line_no"), *[p[k].alias(k) for k in fields]))))
