"""The second rule extractor: header, vendor, buyer, items, totals and payment of the unified schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.amounts import native_amount
from quillstone.functions.dates import native_date, native_time
from quillstone.functions.js import find, first, index_of, let, test, trim
from quillstone.functions.text import native_currency, native_type

_ID = r"([A-Z0-9][A-Z0-9\-\/]{1,30})"
_DATE = r"([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[\/\-][0-9]{1,2}[\/\-][0-9]{2,4})"
# fixed values: labels of the header fields
HEADER = {
    "invoice_number": rf"(?:invoice\s*(?:no\.?|#|number)?|inv\s*[#:])\s*{_ID}", "receipt_number": rf"(?:receipt\s*(?:no\.?|#|number)?|rcpt\s*[#:])\s*{_ID}",
    "po_number": rf"(?:purchase\s*order|p\.?o\.?)\s*(?:no\.?|#|number)?\s*[:\-]?\s*{_ID}", "order_number": rf"(?:order\s*(?:no\.?|#|number)?)\s*[:\-]?\s*{_ID}",
    "date_issued": rf"(?:invoice\s*date|date)\s*[:\-]?\s*{_DATE}", "time_issued": r"\b([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\b", "due_date": rf"(?:due\s*date|due)\s*[:\-]?\s*{_DATE}",
}


def match(text: Column, pattern: str) -> Column:
    return trim(first(text, pattern, 1, "i"))


def header(text: Column) -> Column:
    got = {k: match(text, p) for k, p in HEADER.items()}
    got["date_issued"], got["time_issued"] = native_date(got["date_issued"]), native_time(got["time_issued"])
    return let(F.struct(*[v.alias(k) for k, v in got.items()]), lambda s: s.withField("document_number", F.coalesce(s["invoice_number"], s["receipt_number"])))


def document_type(text: Column, head: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return native_type(text, ~blank(head["invoice_number"]), ~blank(head["receipt_number"]))


def vendor_name(rows: Column) -> Column:
    low = lambda x, w: F.contains(F.lower(x), F.lit(w))
    return find(F.slice(rows, 1, 8), lambda x: (F.length(x) >= 3) & ~low(x, "invoice") & ~low(x, "bill to") & ~low(x, "date"))


def branch(rows: Column) -> Column:
    return find(F.transform(F.slice(rows, 1, 10), lambda x: trim(first(x, r"branch\s*[:#]?\s*\d*\s+(.+)", 1, "i"))), lambda v: v.isNotNull())


def address_lines(rows: Column) -> Column:
    low = lambda x, w: F.contains(F.lower(x), F.lit(w))
    return F.slice(F.filter(F.slice(rows, 1, 12), lambda x: (F.length(x) >= 5) & ~low(x, "invoice") & ~low(x, "bill to") & ~low(x, "ship to")), 1, 3)


def geo(text: Column) -> Column:
    p = r"([A-Za-z][A-Za-z\s]{1,30}),?\s+([A-Z]{2})\s+(\d{5}(?:-\d{4})?)"
    return F.struct(trim(first(text, p, 1)).alias("city"), trim(first(text, p, 2)).alias("state"), trim(first(text, p, 3)).alias("postal_code"))


def vendor(text: Column, rows: Column) -> Column:
    lines_ = address_lines(rows)
    # the original telephone pattern captures nothing; the whole match is taken
    return F.struct(
        vendor_name(rows).alias("name"), branch(rows).alias("branch"), match(text, r"(?:tax\s*id|tin|ein)\s*[:\-]?\s*([A-Z0-9\-]{5,30})").alias("tax_id"), lines_.alias("address_lines"), geo(F.array_join(lines_, ", ")).alias("geo"),
        trim(first(text, r"(?:\+?\d[\d\s\-()]{6,}\d)", 0)).alias("phone"), match(text, r"([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})").alias("email"), match(text, r"((?:https?://|www\.)[^\s]+)").alias("website"),
    )


def customer_id(text: Column) -> Column:
    return match(text, r"customer\s*(?:id|#|no\.?)\s*[:#]?\s*(\S+)")


def buyer(rows: Column) -> Column:
    at = index_of(rows, lambda x: test(x, r"bill to|buyer|customer|sold to", "i"))

    def block(b: Column) -> Column:
        address = F.slice(b, 2, 3)
        return F.struct(F.get(b, F.lit(0)).alias("name"), address.alias("address_lines"), geo(F.array_join(address, ", ")).alias("geo"))

    def cut(next_: Column) -> Column:
        stop = index_of(next_, lambda x: test(x, r"ship to|subtotal", "i"))
        return let(F.when(stop >= 0, F.slice(next_, F.lit(1), F.greatest(stop, F.lit(0)))).otherwise(next_), block)

    return F.when(at >= 0, let(F.slice(rows, at + 2, F.lit(5)), cut))


ITEM = "struct<line_number:int,description:string,quantity:double,unit_price:double,total_amount:double,sku:string,uom:string>"
_ROW = r"^\s*(?:\d+[\).\-]?\s+)?([A-Za-z][A-Za-z0-9\-\s,./()\"]{2,}?)\s+(\d+(?:\.\d+)?)\s+(\d{1,3}(?:,\d{3})*(?:\.\d{1,4})?)\s+(\d{1,3}(?:,\d{3})*(?:\.\d{1,4})?)\s*$"
_SKU = r"\b(\d{4,8}[A-Z]?\d*|[A-Z]{1,4}\d{2,}[A-Z0-9\-]*|\d{2,}-\d{2,}(?:-\d+)?)\b"
_UOM = r"\b(EA|EACH|PC|PCS|BOX|CTN|PKG|SET|LB|KG|FT|GAL|OZ)\b"
_TRAIL = r"(\d{1,3}(?:,\d{3})*\.\d{2,4})\s+(\d{1,3}(?:,\d{3})*\.\d{2,4})\s*$"


def _num(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("double")


def _made(description: Column, qty: Column, price: Column, total: Column, sku: Column, uom: Column) -> Column:
    return F.struct(F.lit(0).alias("line_number"), description.alias("description"), qty.alias("quantity"), price.alias("unit_price"), total.alias("total_amount"), sku.alias("sku"), uom.alias("uom")).cast(ITEM)


def _numbered(items: Column) -> Column:
    return F.transform(items, lambda x, i: x.withField("line_number", (i + 1).cast("int")))


def rows_of_four(rows: Column) -> Column:
    """Lines of description, quantity, price and total."""

    def one(x: Column) -> Column:
        d = trim(first(x, _ROW, 1, "i"))
        return F.when(d.isNotNull(), _made(d, _num(first(x, _ROW, 2, "i")), _num(first(x, _ROW, 3, "i")), _num(first(x, _ROW, 4, "i")), first(x, _SKU), F.upper(first(x, _UOM, 1, "i"))))

    return F.filter(F.transform(rows, one), lambda v: v.isNotNull())


def price_trailing(rows: Column) -> Column:
    """Lines that end in unit and extended price between the table's head and its totals; plain lines continue the item before."""
    n = F.size(rows)
    head = index_of(rows, lambda x: test(x, r"description|item id", "i") & test(x, r"price|amount|total", "i"))
    from_ = F.greatest(head + 1, F.floor(n / 3).cast("int"))
    tail = F.slice(rows, from_ + 1, n)
    end = index_of(tail, lambda x: test(x, r"^(?:sub total|subtotal|total tax|tax total|grand total|amount due|amount paid|credit card|total lines)", "i") | test(x, r"sub-total|total lines", "i"))
    start = F.greatest(head + 1, F.lit(0))
    stop = F.when(end >= 0, from_ + end).otherwise(n)
    body = F.slice(rows, start + 1, F.greatest(stop - start, F.lit(0)))

    def one(x: Column) -> Column:
        price, ext = _num(first(x, _TRAIL, 1)), _num(first(x, _TRAIL, 2))
        text = trim(F.regexp_replace(x, r"(?d)" + r"(\d{1,3}(?:,\d{3})*\.\d{2,4})\s+(\d{1,3}(?:,\d{3})*\.\d{2,4})\s*\z", ""))
        text = trim(F.regexp_replace(trim(F.regexp_replace(text, r"^(?:\d+(?:\.\d+)?\s+){1,4}", "")), r"^[A-Z]{2,5}\s+\d+(?:\.\d+)?\s+", ""))
        sku = first(text, _SKU)
        d = trim(F.regexp_replace(F.when(sku.isNotNull(), trim(F.replace(text, sku, F.lit("")))).otherwise(text), r"(?i)\s+(?:EA|PC|EACH|BOX|CTN)(?:\s+\d+(?:\.\d+)?)?\s*\z", ""))
        qty = F.when(price > 0, F.round(ext / price)).otherwise(1.0)
        made = F.when(price.isNotNull() & ext.isNotNull() & (F.length(d) >= 2), _made(d, qty, price, ext, sku, F.upper(first(x, _UOM, 1, "i"))))
        skip = (F.length(x) < 5) | test(x, r"^(carrier|tracking|page\s+\d|ordered\s+shipped|quantities|unit\s*size)", "i")
        more = price.isNull() & x.rlike(r"^\p{L}") & ~x.rlike(r"\d{2,}\.\d{2}")
        return F.struct(F.when(~skip, made).alias("item"), F.when(~skip & more, trim(x)).alias("more"))

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(last.withField("description", F.concat(last["description"], F.lit(" "), s["more"])).cast(ITEM)))
        return F.when(s["item"].isNotNull(), F.concat(acc, F.array(s["item"]))).when(s["more"].isNotNull() & (F.size(acc) > 0) & (F.length(last["description"]) < 120), grown).otherwise(acc).cast(f"array<{ITEM}>")

    return F.aggregate(F.transform(body, one), F.array().cast(f"array<{ITEM}>"), step)


def line_items(rows: Column) -> Column:
    return let(rows_of_four(rows), lambda a: _numbered(F.when(F.size(a) > 0, a).otherwise(price_trailing(rows))))


def card_brand(text: Column) -> Column:
    has = lambda w: F.contains(F.lower(text), F.lit(w))
    return F.when(has("mastercard"), "Mastercard").when(has("visa"), "Visa").when(has("american express") | has("amex"), "American Express").when(has("discover"), "Discover")


def totals(text: Column, items: Column) -> Column:
    zero = F.lit(0.0)
    sub = F.coalesce(native_amount(text, "sub total", "subtotal"), F.aggregate(items, zero, lambda a, x: a + x["total_amount"]))
    seen = F.struct(
        sub.alias("sub"), F.coalesce(native_amount(text, "tax total", "total tax", "tax", "vat", "gst"), zero).alias("tax"), F.coalesce(native_amount(text, "discount", "discount total"), zero).alias("discount"),
        F.coalesce(native_amount(text, "shipping", "delivery", "freight"), zero).alias("shipping"), native_amount(text, "grand total", "total amount due", "amount due", "total").alias("grand"),
        native_amount(text, "amount paid", "paid", "tendered").alias("paid"), native_amount(text, "amount due", "balance due").alias("due"),
    )

    def build(s: Column) -> Column:
        grand = F.coalesce(s["grand"], s["sub"] + s["tax"] + s["shipping"] - s["discount"])
        due = F.coalesce(s["due"], F.greatest(zero, grand - F.coalesce(s["paid"], zero)))
        cols = {"sub_total": s["sub"], "discount_total": s["discount"], "total_tax": s["tax"], "shipping_total": s["shipping"], "grand_total": grand, "amount_paid": s["paid"], "amount_due": due}
        return F.struct(*[F.round(v, 2).alias(k) for k, v in cols.items()])

    return let(seen, build)


def payment(text: Column) -> Column:
    method = F.coalesce(card_brand(text), match(text, r"(?:payment\s*(?:method|mode)|paid\s*by|tender|card)\s*[:\-]?\s*([A-Za-z][A-Za-z\s]{2,40})"))
    return F.struct(
        method.alias("payment_method"), match(text, r"([xX*]{4,}\d{2,4})").alias("masked_account"), match(text, r"(?:auth(?:orization)?\s*code|approval)\s*[:\-]?\s*([A-Z0-9]{4,20})").alias("authorization_code"),
        match(text, r"\b(A[0-9A-F]{8,32})\b").alias("aid"), match(text, r"(?:cryptogram|tc)\s*[:\-]?\s*([A-Z0-9]{8,64})").alias("cryptogram"), method.alias("tender_type"),
    )


def remittance(text: Column) -> Column:
    """``struct(remit_to_name, remit_to_address_lines)`` after a remittance keyword; null without one."""
    at = F.coalesce(F.nullif(F.locate("remittance address", F.lower(text)), F.lit(0)), F.nullif(F.locate("mail paper checks to", F.lower(text)), F.lit(0)))
    after = F.transform(F.slice(F.split(F.substr(text, at, F.length(text)), "\n", -1), F.lit(2), F.lit(1000)), trim)
    rows = F.filter(after, lambda x: (x != "") & ~x.rlike(r"^\*+\z") & ~(test(x, r"^mail paper", "i") & ~test(x, r"^(?:see |these )", "i")))
    stop = index_of(rows, lambda x: test(x, r"^(?:see |these )", "i") | (F.length(x) > 80))
    kept = F.slice(F.when(stop >= 0, F.slice(rows, F.lit(1), F.greatest(stop, F.lit(0)))).otherwise(rows), 1, 4)
    return F.when(at.isNotNull(), F.struct(F.lit("NEW REMITTANCE ADDRESS").alias("remit_to_name"), kept.alias("remit_to_address_lines")))


def schema_confidence(head: Column, vendor_name_: Column, items: Column, grand_total: Column) -> Column:
    has = lambda c: (F.coalesce(F.trim(c), F.lit("")) != "").cast("int") * 0.2
    return F.least(has(head["invoice_number"]) + has(head["date_issued"]) + has(vendor_name_) + (F.size(items) > 0).cast("int") * 0.2 + F.coalesce((grand_total > 0).cast("int"), F.lit(0)) * 0.2, F.lit(1.0))


def field_confidence(ocr: Column, schema: Column) -> Column:
    return F.round(ocr * 0.7 + schema * 0.3, 2)


def unified(text: Column, rows: Column, ocr_confidence: Column) -> Column:
    """All of it as one struct, with field confidences and the warning for a document without items."""

    def build(x: Column) -> Column:
        t = totals(text, x["items"])

        def whole(y: Column) -> Column:
            conf = field_confidence(ocr_confidence, schema_confidence(x["head"], x["vendor"]["name"], x["items"], y["totals"]["grand_total"]))
            warnings = F.when(F.size(x["items"]) == 0, F.array(F.lit("No line items confidently parsed"))).otherwise(F.array().cast("array<string>"))
            return F.struct(
                document_type(text, x["head"]).alias("document_type"), native_currency(text).alias("currency"), x["head"].alias("header"), x["vendor"].alias("vendor"), buyer(rows).withField("account_id", customer_id(text)).alias("buyer"), x["items"].alias("line_items"),
                y["totals"].alias("totals"), payment(text).alias("payment"), F.array(F.struct(F.lit("Tax").alias("tax_name"), F.lit(None).cast("double").alias("tax_rate"), y["totals"]["total_tax"].alias("tax_amount"))).alias("taxes"),
                remittance(text).alias("remittance"), conf.alias("confidence"), F.when(F.size(x["items"]) > 0, F.greatest(F.lit(0.65), conf - 0.08)).alias("item_confidence"), warnings.alias("warnings"),
            )

        return let(F.struct(t.alias("totals")), whole)

    return let(F.struct(header(text).alias("head"), vendor(text, rows).alias("vendor"), line_items(rows).alias("items")), build)
