"""The engine's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions import amounts, contacts, dates, parties, text as tx, transaction as tr
from quillstone.functions.js import lines, words
from quillstone.operators import entities as en, items as it, merge as mg, reader, segment as sg, shred, totals as tt, unified_rules as ur, validate as va
from quillstone.plans import pipeline as pl, slips
from quillstone.runtime import table
from quillstone.sources import documents as sd, render


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.found(table(spark, sf_dir, "responses"), table(spark, sf_dir, "raw_responses"))


def p3_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table of the typed responses with its values."""
    flat = shred.child_table(shred.shred_responses(table(spark, sf_dir, "responses")), "part")
    number = ("quantity", "unit_price", "total_amount")
    return flat.select("rec_id", "pos", "item_name", "sku", "part_number", "unit", *[F.col(c).cast("double").alias(c) for c in number]).distinct()


def p3_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of the typed responses beside their addresses, joined over the parent link."""
    flat = shred.shred_responses(table(spark, sf_dir, "responses"))
    d = shred.child_table(flat, "delivery").select("rec_id", "pos", "delivery_date", "tracking_number", "carrier").distinct()
    a = shred.child_table(flat, "address").select("rec_id", F.col("parent_pos").alias("pos"), "street", "city", "postal_code", "full_address").distinct()
    return d.join(a, ["rec_id", "pos"], "left").distinct()


_PART_FILLED = " OR ".join([f"coalesce(trim(p.{c}), '') <> ''" for c in ("item_name", "description", "sku", "part_number", "manufacturer_part_number", "unit")] + [f"p.{c} IS NOT NULL" for c in ("quantity", "unit_price", "list_price", "discount", "tax_percentage", "tax_amount", "total_amount")])
_ADDRESS_FILLED = " OR ".join(f"coalesce(trim(delivery_details.address.{c}), '') <> ''" for c in shred.ADDRESS_FIELDS)
_DELIVERY_FILLED = _ADDRESS_FILLED + " OR " + " OR ".join(f"coalesce(trim(delivery_details.{c}), '') <> ''" for c in ("delivery_date", "tracking_number", "carrier", "shipping_method"))

SQL = {
    "p3_parts": f"""
        WITH ex AS (SELECT response_id, received_at, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM responses),
        kept AS (SELECT * FROM ex WHERE {_PART_FILLED})
        SELECT DISTINCT response_id AS rec_id,
               CAST(row_number() OVER (PARTITION BY response_id, received_at ORDER BY i) - 1 AS INTEGER) AS pos,
               p.item_name AS item_name, p.sku AS sku, p.part_number AS part_number, p.unit AS unit,
               p.quantity AS quantity, p.unit_price AS unit_price, p.total_amount AS total_amount
        FROM kept""",
    "p3_deliveries": f"""
        SELECT DISTINCT response_id AS rec_id, CAST(0 AS INTEGER) AS pos, delivery_details.delivery_date AS delivery_date,
               delivery_details.tracking_number AS tracking_number, delivery_details.carrier AS carrier,
               CASE WHEN {_ADDRESS_FILLED} THEN delivery_details.address.street END AS street,
               CASE WHEN {_ADDRESS_FILLED} THEN delivery_details.address.city END AS city,
               CASE WHEN {_ADDRESS_FILLED} THEN delivery_details.address.postal_code END AS postal_code,
               CASE WHEN {_ADDRESS_FILLED} THEN delivery_details.address.full_address END AS full_address
        FROM responses WHERE delivery_details IS NOT NULL AND ({_DELIVERY_FILLED})""",
}


# ---------------------------------------------------------------------------------------------------------------
# Raw text: the scans, requests, responses and documents as they stand


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct scans with a text."""
    return table(spark, sf_dir, "ocr_results").select("ocr_id", "text").filter("text is not null").distinct()


def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans(spark, sf_dir).select("ocr_id", F.size(lines(F.col("text"))).alias("n_lines"))


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", words(F.col("text")).alias("n_words"), en.token_count(F.col("text")).alias("n_tokens"))


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", tx.language(F.col("text")).alias("language"))


def language_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion of the detected with the stated language."""
    return table(spark, sf_dir, "documents").filter("text is not null").groupBy(F.lower("lang").alias("lang"), tx.language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


def detect_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return scans(spark, sf_dir).select("ocr_id", tx.currency(t).alias("currency"), tx.currency(t, "symbol").alias("symbol"), tx.native_currency(t).alias("native_currency"))


def classify_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return scans(spark, sf_dir).select("ocr_id", tx.document_type(t).alias("document_type"), tx.sdk_type_confidence(t).alias("confidence"))


def unified_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return scans(spark, sf_dir).select("ocr_id", tx.unified_type(t).alias("unified_type"), tx.native_type(t, F.lit(False), F.lit(False)).alias("native_type"))


def native_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tx.native_class(F.col("text"))
    i = tx.native_class(F.col("text"), "ios")
    return scans(spark, sf_dir).select("ocr_id", a["type"].alias("android_type"), F.round(a["confidence"], 6).alias("android_confidence"), i["type"].alias("ios_type"), F.round(i["confidence"], 6).alias("ios_confidence"))


def extract_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans(spark, sf_dir).select("ocr_id", F.array_join(contacts.emails(F.col("text")), "|").alias("emails"))


def extract_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans(spark, sf_dir).select("ocr_id", F.array_join(contacts.phones(F.col("text")), "|").alias("phones"))


def extract_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "responses").filter("notes is not null").select("response_id", F.array_join(contacts.urls(F.col("notes")), "|").alias("urls")).distinct()


def email_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans per e-mail domain."""
    each = scans(spark, sf_dir).select("ocr_id", F.explode(contacts.emails(F.col("text"))).alias("email"))
    return each.groupBy(F.regexp_extract("email", "@(.*)$", 1).alias("domain")).agg(F.countDistinct("ocr_id").alias("n"))


def ocr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    own = table(spark, sf_dir, "ocr_results").filter("text is not null").select("ocr_id", "text", "confidence").distinct()
    conf = F.coalesce("confidence", F.lit(0.85))
    return own.select("ocr_id", F.round(tt.ocr_factor(t, conf), 6).alias("ocr_factor"), F.round(tx.native_ocr_confidence(t), 6).alias("native_confidence"))


def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("invoice_date")
    return table(spark, sf_dir, "responses").filter("invoice_date is not null").select("invoice_date", dates.normalise_date(d).alias("rule_date"), dates.unified_date(d).alias("unified_date"), dates.native_date(d).alias("native_date")).distinct()


def street_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("street")
    return table(spark, sf_dir, "addresses").filter("street is not null").select("street", amounts.parse_amount(s).alias("amount"), amounts.to_number(s).alias("number")).distinct()


def payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses held against the rules of the unified payload."""
    r = table(spark, sf_dir, "responses")
    v = va.payload(F.col("invoice_number"), F.col("document_type"), F.col("parts").isNotNull(), F.lit(True), F.col("supplier_id").isNotNull(), F.col("grand_total").isNotNull(), F.col("currency"), F.col("invoice_date"))
    return r.select("response_id", v["valid"].alias("valid"), F.array_join(v["errors"], "; ").alias("errors")).distinct()


def option_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract calls made of the scans: image from every third row, a threshold from the confidence."""
    o = table(spark, sf_dir, "ocr_results").select("ocr_id", "provider", "text", "confidence").distinct()
    kind = F.when(F.col("provider").isNull(), F.lit(None).cast("string")).otherwise("uri")
    v = va.options(F.lit(None).cast("string"), kind, F.lit(None).cast("string"), F.col("text"), F.lit(False), F.col("confidence") * 1.05)
    return o.select("ocr_id", v["valid"].alias("valid"), F.array_join(v["errors"], "; ").alias("errors"))


def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of one response as the pages of one document."""
    pages = table(spark, sf_dir, "ocr_results").filter("response_id is not null and text is not null").select("response_id", "ocr_id", "text", "confidence").distinct()
    return sd.merge_pages(pages, "response_id", "ocr_id").select("response_id", F.md5("text").alias("text_md5"), F.round("confidence", 6).alias("confidence"), "page_count")


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image lists of documents whose pages are named by their scans."""
    uris = table(spark, sf_dir, "ocr_results").filter("response_id is not null").groupBy("response_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("file:///scans/page_"), F.col("ocr_id").cast("string"), F.lit(".jpg")))).alias("uris"))
    return uris.select("response_id", F.explode(mg.images(F.col("uris"))).alias("x")).select("response_id", "x.image_id", "x.file_name", "x.page_index")


# ---------------------------------------------------------------------------------------------------------------
# Rendered invoices: the answer is computed from the relational rows


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.invoices(spark, sf_dir).withColumn("norm", tx.normalise(F.col("text")))


def rendered_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("norm")
    d = dates.dates(t)
    return _rendered(spark, sf_dir).select("doc_id", tr.invoice_number(t).alias("invoice_number"), d["invoice_date"].alias("invoice_date"), d["due_date"].alias("due_date"), tr.payment_terms(t).alias("payment_terms"), tx.document_type(t).alias("document_type"), tx.currency(t).alias("currency"))


def rendered_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.read(render.invoices(spark, sf_dir), "parties")


def _with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rendered(spark, sf_dir).withColumn("rows", lines(F.col("norm"))).withColumn("b", sg.bounds(F.col("rows")))
    return r.withColumn("parts", it.column_table(sg.body(F.col("rows"), F.col("b")))).withColumn("foot", F.array_join(sg.footer(F.col("rows"), F.col("b")), "\n"))


def rendered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.read(render.invoices(spark, sf_dir), "items").select("doc_id", "line_no", "item_name", "quantity", (F.abs(F.col("unit_price") * F.col("quantity") - F.col("total_amount")) <= 0.0051 * F.col("quantity")).alias("price_fits"), "total_amount")


def rendered_item_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_items(spark, sf_dir).select("doc_id", F.size("parts").alias("n_items"), tt.parts_sum(F.col("parts")).alias("items_total"))


def rendered_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.read(render.invoices(spark, sf_dir), "totals")


def rendered_numeric_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.read(render.invoices(spark, sf_dir), "numeric")


def rendered_keyword_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).select("doc_id", F.round(tt.keyword_factor(F.col("text"), F.lit("invoice")), 6).alias("keyword_factor"))


def missing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the rows that aren't found in the text, and why: those beyond the guard on totals."""
    truth = render.numbered_items(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_orderkey").alias("doc_id"), F.col("l_extendedprice").alias("total_amount"), "line_no")
    got = reader.read(render.invoices(spark, sf_dir), "items").select("doc_id", F.round("total_amount", 2).alias("total_amount"))
    return truth.withColumn("total_amount", F.round("total_amount", 2)).join(got, ["doc_id", "total_amount"], "left_anti").select("doc_id", "line_no", "total_amount")


def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered records whose invoice number is blotted out for every second order, filled from predictions."""
    r = _rendered(spark, sf_dir)
    own = F.when(F.col("doc_id") % 2 == 0, tr.invoice_number(F.col("norm")))
    none = F.lit(None).cast("string")
    rec = r.select(
        "doc_id", F.struct(own.alias("invoice_number"), none.alias("purchase_order_number"), dates.dates(F.col("norm"))["invoice_date"].alias("invoice_date")).alias("transaction"), F.struct(F.lit("").alias("name")).alias("supplier"), F.struct(none.alias("name")).alias("buyer"),
        F.struct(F.lit(0.0).alias("grand_total"), F.lit(None).cast("double").alias("subtotal"), F.lit(5.0).alias("total_tax"), F.lit(0.0).alias("balance_due")).alias("totals"),
    )
    pred = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("P-"), F.col("o_orderkey").cast("string")).alias("invoice_number"), F.concat(F.lit("Vendor "), F.col("o_custkey").cast("string")).alias("vendor_name"), F.col("o_totalprice").alias("grand_total"), F.col("o_totalprice").alias("total_tax"))
    out = mg.gap_fill(rec, pred)
    return out.select("doc_id", F.col("transaction.invoice_number").alias("invoice_number"), F.col("supplier.name").alias("supplier_name"), F.col("totals.grand_total").alias("grand_total"), F.col("totals.total_tax").alias("total_tax"))


# ---------------------------------------------------------------------------------------------------------------
# Entities, with the events of a user as the tokens of a document

_LABELS = {"signup": "B-VENDOR_NAME", "error": "O", "view": "B-ITEM_DESCRIPTION", "purchase": "B-ITEM_TOTAL", "click": "I-ITEM_DESCRIPTION"}


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    label = F.create_map(*[F.lit(x) for kv in _LABELS.items() for x in kv])[F.col("event_type")]
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    token = F.when(F.col("event_type") == "purchase", F.format_string("%.2f", "value")).otherwise(F.concat("event_type", (F.col("event_id") % 7).cast("string")))
    return e.filter("user_id is not null").select(F.col("user_id").alias("doc_id"), pos.alias("pos"), token.alias("token"), label.alias("label"), (F.lit(0.8) + (F.col("event_id") % 20) / 100.0).alias("score"))


def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.merge_adjacent(en.decode(_tokens(spark, sf_dir))).select("doc_id", "seq", "label", "text", F.round("score", 6).alias("score"))


def entity_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.entity_fields(en.merge_adjacent(en.decode(_tokens(spark, sf_dir)))).select("doc_id", "vendor_name", F.round("confidence", 6).alias("confidence"))


def entity_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.entity_items(en.merge_adjacent(en.decode(_tokens(spark, sf_dir)))).select("doc_id", "item_no", "description", "total")


def bio_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("event_type") == "purchase", "menu.price").when(F.col("event_type") == "view", "menu.nm").when(F.col("event_type") == "click", "menu.sub_nm").when(F.col("event_type") == "signup", "total.menutype_cnt").otherwise("other")
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), tag.alias("tag"))
    return en.bio_encode(e).select("event_id", "label")


def best_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest component of each vector, read as the logits of a token."""
    best = en.best_label(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", best["label_id"].alias("label_id"), F.round(best["score"], 6).alias("score"))


def label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of the document type found in the scans against that of their responses."""
    o = scans(spark, sf_dir).join(table(spark, sf_dir, "ocr_results").select("ocr_id", "response_id").distinct(), "ocr_id").filter("response_id is not null")
    r = table(spark, sf_dir, "responses").select("response_id", "document_type").distinct()
    rows = o.join(r, "response_id").select(F.coalesce("document_type", F.lit("generic")).alias("truth"), tx.document_type(F.col("text")).alias("predicted"))
    return en.label_scores(rows).select("label", "support", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, ids and boxes of the scans."""
    return scans(spark, sf_dir).select("ocr_id", F.explode(en.encode(F.col("text"))).alias("x")).select("ocr_id", "x.pos", "x.token", "x.id", F.col("x.bbox")[1].alias("y0"))


# ---------------------------------------------------------------------------------------------------------------
# Whole records and reports


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scan through the whole parser, its confidence and the headline fields."""
    p = pl.score(pl.parse(scans(spark, sf_dir)))
    return p.select("ocr_id", F.col("document_type_detected").alias("document_type"), F.col("transaction.invoice_number").alias("invoice_number"), F.col("supplier.name").alias("supplier_name"), F.col("buyer.name").alias("buyer_name"), F.size("parts").alias("n_items"), F.col("totals.grand_total").alias("grand_total"), "field_count", F.col("confidence.overall").alias("confidence"))


def extracted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of the scanned bills, by the whole cascade."""
    p = scans(spark, sf_dir).withColumn("norm", tx.normalise(F.col("text"))).withColumn("rows", lines(F.col("norm"))).withColumn("b", sg.bounds(F.col("rows")))
    p = p.withColumn("parts", it.extract_parts(sg.body(F.col("rows"), F.col("b")), F.col("rows")))
    return pl.exploded_parts(p, "ocr_id").select("ocr_id", "line_no", "item_name", "quantity", "unit_price", "tax_amount", "total_amount")


def unified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scans through the second rule extractor."""
    u = scans(spark, sf_dir).withColumn("rows", lines(F.col("text"))).withColumn("u", ur.unified(F.col("text"), F.col("rows"), F.lit(0.85)))
    return u.select("ocr_id", "u.document_type", "u.currency", F.col("u.header.document_number").alias("document_number"), F.col("u.vendor.name").alias("vendor_name"), F.size("u.line_items").alias("n_items"), F.col("u.totals.grand_total").alias("grand_total"), "u.confidence")


def payments_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment, delivery and notes of the scans."""
    t = F.col("text")
    return scans(spark, sf_dir).select("ocr_id", tr.payment_details(t).alias("p"), tr.delivery_details(t).alias("d"), tr.notes(t).alias("notes")).select("ocr_id", "p.method", "p.receipt_number", F.col("d.address.full_address").alias("delivery_address"), "notes")


def tax_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax numbers written in the scans."""
    return scans(spark, sf_dir).select("ocr_id", parties.tax_information(F.col("text")).alias("t")).filter("t is not null").select("ocr_id", "t.tax_id", "t.vat_number", "t.abn_number")


def spend_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item totals of the responses rolled up by supplier and month, repeated deliveries once."""
    r = table(spark, sf_dir, "responses").filter("supplier_id is not null").select("response_id", "supplier_id", F.date_format("extracted_at", "yyyy-MM").alias("month"), "parts").dropDuplicates(["response_id"])
    each = r.select("supplier_id", "month", F.explode("parts").alias("p")).select("supplier_id", "month", F.col("p.total_amount").cast("decimal(18,2)").alias("amount"))
    return each.rollup("supplier_id", "month").agg(F.sum("amount").cast("double").alias("spend"), F.count("*").alias("n"))


def top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest items of every response."""
    r = table(spark, sf_dir, "responses").select("response_id", "parts").dropDuplicates(["response_id"])
    each = r.select("response_id", F.posexplode("parts").alias("pos", "p")).select("response_id", "pos", "p.item_name", "p.total_amount").filter("total_amount is not null")
    order = W.partitionBy("response_id").orderBy(F.desc("total_amount"), "pos")
    return each.withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("response_id", "rank", "item_name", "total_amount")


def stream_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans per day and provider, each scan once: the batch twin of the streamed count."""
    o = table(spark, sf_dir, "ocr_results").select("ocr_id", "provider", "scanned_at").dropDuplicates(["ocr_id"])
    return o.groupBy(F.date_format("scanned_at", "yyyy-MM-dd").alias("day"), "provider").agg(F.count("*").alias("n"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered invoices parsed: number, total, items and confidence of each."""
    p = pl.score(pl.parse(render.invoices(spark, sf_dir)))
    return p.select("doc_id", F.col("document_type_detected").alias("document_type"), F.col("transaction.invoice_number").alias("invoice_number"), F.col("totals.grand_total").alias("grand_total"), F.size("parts").alias("n_parts"), F.col("confidence.overall").alias("confidence"))


def rendered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.read(render.invoices(spark, sf_dir), "record")


# ---------------------------------------------------------------------------------------------------------------
# SQL

_SP = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{000B}]"
_SCANS = "(SELECT DISTINCT ocr_id, text FROM ocr_results WHERE text IS NOT NULL)"
_WORDS = rf"len(list_filter(regexp_split_to_array(text, '{_SP}+'), lambda x: x <> ''))"


def _chain(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in pairs) + f" ELSE '{default}' END"


def _lit(s: str) -> str:
    return s.replace("'", "''")


_LANG = _chain([(rf"regexp_matches(lower(text[1:800]), '\b({ws})\b')", code) for code, ws in tx.LANGUAGE_WORDS], "en")


def _count(ws) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(text), '{_lit(w)}') AS INTEGER)" for w in ws) + ")"


def _best(table_, default: str) -> str:
    """Type with most keywords, the earlier one of a tie."""
    scored = ", ".join(f"{{'n': {_count(ws)}, 'i': {-i}, 't': '{t}'}}" for i, (t, ws) in enumerate(table_))
    return f"list_aggregate([{scored}], 'max')"


_RENDERED = """
    items AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS line_no FROM lineitem l),
    docs AS (SELECT DISTINCT o.* FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey),
    sums AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS subtotal FROM items GROUP BY 1),
    kept AS (SELECT i.*, row_number() OVER (PARTITION BY i.l_orderkey ORDER BY i.line_no) - 1 AS place FROM items i JOIN docs d ON d.o_orderkey = i.l_orderkey WHERE i.l_extendedprice <= 100000)
"""
_TAX = "round(s.subtotal * CAST(0.10 AS DECIMAL(4,2)), 2)"
_TOKENS = """
    raw AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
                   CASE WHEN event_type = 'purchase' THEN printf('%.2f', value) ELSE event_type || CAST(event_id % 7 AS VARCHAR) END AS token,
                   CASE event_type WHEN 'signup' THEN 'VENDOR_NAME' WHEN 'view' THEN 'ITEM_DESCRIPTION' WHEN 'purchase' THEN 'ITEM_TOTAL' WHEN 'click' THEN 'ITEM_DESCRIPTION' END AS label,
                   0.8 + CAST(event_id % 20 AS DOUBLE) / 100.0 AS score
            FROM events WHERE user_id IS NOT NULL),
    kept AS (SELECT doc_id, pos, label, trim(regexp_replace(token, '[^A-Za-z0-9$.,:/#&()\\-]', '', 'g')) AS text, score FROM raw WHERE label IS NOT NULL AND score >= 0.88),
    flagged AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM label THEN 1 ELSE 0 END AS s FROM kept),
    runs AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS seq FROM flagged),
    merged AS (SELECT doc_id, CAST(seq AS BIGINT) AS seq, label, string_agg(text, ' ' ORDER BY pos) AS text, max(score) AS score FROM runs GROUP BY ALL)
"""
_DMY = r"'^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$'"
_YMD = r"'^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$'"


def _re(p: str, g: int) -> str:
    return f"regexp_extract(invoice_date, {p}, {g})"


def _ri(p: str, g: int) -> str:
    return f"TRY_CAST({_re(p, g)} AS INTEGER)"


def _iso_sql(y: str, m: str, d: str) -> str:
    return f"{y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0')"


_SHORT = r"'^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})$'"
_YMD_SWAP = f"({_ri(_YMD, 2)} > 12 AND {_ri(_YMD, 3)} BETWEEN 1 AND 12)"
_RULE = f"""CASE WHEN regexp_matches(invoice_date, {_YMD}) THEN CASE WHEN {_YMD_SWAP} THEN {_iso_sql(_re(_YMD, 1), _re(_YMD, 3), _re(_YMD, 2))} ELSE {_iso_sql(_re(_YMD, 1), _re(_YMD, 2), _re(_YMD, 3))} END
    WHEN regexp_matches(invoice_date, {_DMY}) THEN CASE WHEN {_ri(_DMY, 2)} > 12 AND {_ri(_DMY, 1)} <= 12 AND {_ri(_DMY, 1)} >= 1 THEN {_iso_sql(_re(_DMY, 3), _re(_DMY, 1), _re(_DMY, 2))} ELSE {_iso_sql(_re(_DMY, 3), _re(_DMY, 2), _re(_DMY, 1))} END
    WHEN regexp_matches(invoice_date, {_SHORT}) THEN CASE WHEN {_ri(_SHORT, 1)} > 12 AND {_ri(_SHORT, 2)} BETWEEN 1 AND 12 THEN {_iso_sql("'20' || " + _re(_SHORT, 3), _re(_SHORT, 2), _re(_SHORT, 1))} ELSE {_iso_sql("'20' || " + _re(_SHORT, 3), _re(_SHORT, 1), _re(_SHORT, 2))} END
    ELSE invoice_date END"""
_PARTS3 = "string_split(replace(trim(invoice_date), '-', '/'), '/')"


def _two(i: int) -> str:
    n = rf"TRY_CAST(regexp_extract({_PARTS3}[{i}], '^\s*([-+]?\d+)', 1) AS INTEGER)"
    return f"lpad(CAST(CASE WHEN coalesce({n}, 0) = 0 THEN 1 ELSE {n} END AS VARCHAR), 2, '0')"


def _ntwo(i: int) -> str:
    return rf"coalesce(CASE WHEN regexp_matches({_PARTS3}[{i}], '^-?\d{{1,9}}$') THEN lpad(CAST(TRY_CAST({_PARTS3}[{i}] AS INTEGER) AS VARCHAR), 2, '0') END, '01')"


_YEAR3 = f"CASE WHEN length({_PARTS3}[3]) = 2 THEN '20' || {_PARTS3}[3] ELSE {_PARTS3}[3] END"
_STRICT = r"regexp_matches(trim(invoice_date), '^\d{4}-\d{2}-\d{2}$')"
_UNIFIED = f"CASE WHEN {_STRICT} THEN trim(invoice_date) WHEN len({_PARTS3}) <> 3 THEN NULL WHEN length({_PARTS3}[1]) = 4 THEN {_PARTS3}[1] || '-' || {_two(2)} || '-' || {_two(3)} ELSE {_YEAR3} || '-' || {_two(1)} || '-' || {_two(2)} END"
_NATIVE = f"CASE WHEN trim(invoice_date) = '' THEN NULL WHEN {_STRICT} THEN invoice_date WHEN len({_PARTS3}) <> 3 THEN invoice_date WHEN length({_PARTS3}[1]) = 4 THEN {_PARTS3}[1] || '-' || {_ntwo(2)} || '-' || {_ntwo(3)} ELSE {_YEAR3} || '-' || {_ntwo(1)} || '-' || {_ntwo(2)} END"
_PHONE_RE = _lit(contacts.PHONE)
_ANDROID = _best(tx.NATIVE_WORDS, "generic")
_TOTAL_HITS = " + ".join(_count(ws) for _, ws in tx.NATIVE_WORDS)

SQL |= {
    "line_count": rf"SELECT ocr_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_SP}', '', 'g') <> '')) AS n_lines FROM {_SCANS}",
    "word_count": f"SELECT doc_id, {_WORDS} AS n_words, least({_WORDS}, 126) AS n_tokens FROM documents WHERE text IS NOT NULL",
    "detect_language": f"SELECT doc_id, {_LANG} AS language FROM documents WHERE text IS NOT NULL",
    "language_by_lang": f"SELECT lower(lang) AS lang, {_LANG} AS language, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2",
    "detect_currency": "SELECT ocr_id, " + _chain([(f"regexp_matches(text, '(?i){_lit(p)}')", c) for p, c, _ in tx.CURRENCIES], "USD") + " AS currency, " + _chain([(f"regexp_matches(text, '(?i){_lit(p)}')", s) for p, _, s in tx.CURRENCIES], "$")
    + " AS symbol, CASE WHEN contains(upper(text), 'USD') OR contains(text, '$') THEN 'USD' WHEN contains(upper(text), 'EUR') OR contains(text, '€') THEN 'EUR' WHEN contains(upper(text), 'GBP') OR contains(text, '£') THEN 'GBP' WHEN contains(upper(text), 'INR') OR contains(text, '₹') THEN 'INR' ELSE 'USD' END AS native_currency"
    + f" FROM {_SCANS}",
    "classify_type": f"SELECT ocr_id, CASE WHEN b.n > 0 THEN b.t ELSE 'generic' END AS document_type, least({_WORDS} / 100.0, 0.9)::DOUBLE AS confidence FROM (SELECT *, {_best(tx.TYPE_WORDS, 'generic')} AS b FROM {_SCANS})",
    "unified_type": f"""SELECT ocr_id, CASE WHEN contains(lower(text), 'credit memo') THEN 'credit_memo' WHEN contains(lower(text), 'remittance') THEN 'remittance' WHEN contains(lower(text), 'payment') AND contains(lower(text), 'receipt') THEN 'payment_receipt'
        WHEN contains(lower(text), 'pos') AND contains(lower(text), 'receipt') THEN 'pos_receipt' WHEN contains(lower(text), 'cash sale') THEN 'cash_sale' WHEN contains(lower(text), 'receipt') THEN 'receipt' ELSE 'invoice' END AS unified_type,
        CASE WHEN contains(lower(text), 'invoice') THEN 'invoice' WHEN contains(lower(text), 'receipt') THEN CASE WHEN contains(lower(text), 'pos') THEN 'pos_receipt' WHEN contains(lower(text), 'payment') THEN 'payment_receipt' ELSE 'receipt' END
        WHEN contains(lower(text), 'credit memo') THEN 'credit_memo' WHEN contains(lower(text), 'remittance') THEN 'remittance' ELSE 'invoice' END AS native_type FROM {_SCANS}""",
    "native_class": f"""WITH s AS (SELECT ocr_id, {_ANDROID} AS b, ({_TOTAL_HITS}) AS total FROM {_SCANS}), p AS (SELECT *, CASE WHEN total > 0 THEN b.n / total::DOUBLE END AS p FROM s),
        q AS (SELECT *, CASE WHEN b.n >= 3 THEN least(p * 1.15, 0.95) ELSE p * 0.85 END AS c FROM p)
        SELECT ocr_id, CASE WHEN total = 0 OR (p < 0.7 AND b.n < 3) THEN 'generic' ELSE b.t END AS android_type, round(CASE WHEN total = 0 OR (p < 0.7 AND b.n < 3) THEN 0.5 ELSE least(p + 0.3, 1.0) END, 6)::DOUBLE AS android_confidence,
        CASE WHEN total = 0 OR c < 0.5 OR b.n < 2 THEN 'generic' ELSE b.t END AS ios_type, round(CASE WHEN total = 0 THEN 0.5 WHEN c < 0.5 OR b.n < 2 THEN greatest(c, 0.4) ELSE c END, 6)::DOUBLE AS ios_confidence FROM q""",
    "extract_emails": rf"SELECT ocr_id, array_to_string(list_transform(list_filter(list_zip(e, range(1, len(e) + 1)), lambda z: list_position(e, z[1]) = z[2]), lambda z: z[1]), '|') AS emails FROM (SELECT ocr_id, list_transform(regexp_extract_all(text, '[\w.+\-]+@[\w\-]+\.[\w.]{{2,}}'), lambda x: lower(x)) AS e FROM {_SCANS})",
    "extract_phones": rf"SELECT ocr_id, array_to_string(list_transform(list_filter(list_zip(e, range(1, len(e) + 1)), lambda z: list_position(e, z[1]) = z[2]), lambda z: z[1]), '|') AS phones FROM (SELECT ocr_id, list_filter(list_transform(regexp_extract_all(text, '{_PHONE_RE}'), lambda x: trim(x, ' ' || chr(9))), lambda x: length(regexp_replace(x, '\D', '', 'g')) >= 7 AND NOT regexp_matches(x, '^\d{{5}}-\d{{4}}$')) AS e FROM {_SCANS})",
    "extract_urls": rf"SELECT DISTINCT response_id, array_to_string(list_transform(list_filter(list_zip(e, range(1, len(e) + 1)), lambda z: list_position(e, z[1]) = z[2]), lambda z: z[1]), '|') AS urls FROM (SELECT response_id, regexp_extract_all(notes, '(?i)https?://[^\s]+|www\.[^\s]+') AS e FROM responses WHERE notes IS NOT NULL)",
    "email_domains": rf"SELECT regexp_extract(email, '@(.*)$', 1) AS domain, count(DISTINCT ocr_id) AS n FROM (SELECT ocr_id, unnest(list_transform(regexp_extract_all(text, '[\w.+\-]+@[\w\-]+\.[\w.]{{2,}}'), lambda x: lower(x))) AS email FROM {_SCANS}) GROUP BY 1",
    "ocr_scores": f"SELECT ocr_id, round(coalesce(confidence, 0.85) * 0.6 + least({_WORDS} / 50.0, 1.0) * 0.4, 6)::DOUBLE AS ocr_factor, round(least(greatest(0.45 + least({_WORDS}, 200) / 400.0, 0.45), 0.95), 6)::DOUBLE AS native_confidence FROM (SELECT DISTINCT ocr_id, text, confidence FROM ocr_results WHERE text IS NOT NULL)",
    "iso_dates": f"SELECT DISTINCT invoice_date, {_RULE} AS rule_date, {_UNIFIED} AS unified_date, {_NATIVE} AS native_date FROM responses WHERE invoice_date IS NOT NULL",
    "street_numbers": r"SELECT DISTINCT street, coalesce(TRY_CAST(nullif(regexp_extract(regexp_replace(street, '[^0-9.]', '', 'g'), '^(\d+\.?\d*|\.\d+)', 1), '') AS DOUBLE), 0) AS amount, TRY_CAST(nullif(regexp_extract(regexp_replace(street, '[^0-9.-]', '', 'g'), '^(-?(\d+\.?\d*|\.\d+))', 1), '') AS DOUBLE) AS number FROM addresses WHERE street IS NOT NULL",
    "payload_errors": r"""WITH e AS (SELECT response_id, list_filter([CASE WHEN coalesce(invoice_number, '') = '' THEN 'document_id is required and must be string' END,
        CASE WHEN coalesce(document_type, '') NOT IN ('invoice','receipt','pos_receipt','cash_sale','payment_receipt','remittance','credit_memo') THEN 'document_type is required and must be a valid enum value' END, CASE WHEN parts IS NULL THEN 'images is required and must be array' END,
        CASE WHEN supplier_id IS NULL THEN 'vendor is required and must be object' END, CASE WHEN grand_total IS NULL THEN 'totals is required and must be object' END, CASE WHEN NOT regexp_matches(currency, '^[A-Z]{3}$') THEN 'currency must be ISO 4217 uppercase code' END,
        CASE WHEN NOT regexp_matches(invoice_date, '^\d{4}-\d{2}-\d{2}$') THEN 'header.date_issued must be YYYY-MM-DD' END], lambda x: x IS NOT NULL) AS errs FROM responses)
        SELECT DISTINCT response_id, len(errs) = 0 AS valid, array_to_string(errs, '; ') AS errors FROM e""",
    "option_errors": r"""WITH o AS (SELECT DISTINCT ocr_id, provider, text, confidence FROM ocr_results), e AS (SELECT ocr_id, list_filter([CASE WHEN provider IS NULL THEN 'You must provide either `image` (base64 string) or `imageInput` (ImageInput object).' END,
        CASE WHEN provider IS NOT NULL AND coalesce(text, '') = '' THEN '`imageInput.path` is required for type ''uri''.' END, CASE WHEN confidence * 1.05 < 0 OR confidence * 1.05 > 1 THEN '`aiConfidenceThreshold` must be between 0 and 1.' END], lambda x: x IS NOT NULL) AS errs FROM o)
        SELECT ocr_id, len(errs) = 0 AS valid, array_to_string(errs, '; ') AS errors FROM e""",
    "merged_pages": "SELECT response_id, md5(string_agg(text, chr(10) ORDER BY ocr_id, text)) AS text_md5, round(coalesce(avg(confidence), 0.5), 6) AS confidence, count(*) AS page_count FROM (SELECT DISTINCT response_id, ocr_id, text, confidence FROM ocr_results WHERE response_id IS NOT NULL AND text IS NOT NULL) GROUP BY 1",
    "page_images": "WITH u AS (SELECT DISTINCT response_id, 'page_' || ocr_id || '.jpg' AS file_name FROM ocr_results WHERE response_id IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY file_name) - 1 AS i FROM u) SELECT response_id, 'img_' || lpad(CAST(i + 1 AS VARCHAR), 3, '0') AS image_id, file_name, CAST(i AS INTEGER) AS page_index FROM n",
    "rendered_header": f"WITH {_RENDERED} SELECT o_orderkey AS doc_id, 'INV-' || o_orderkey AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS due_date, 'Net 30' AS payment_terms, 'invoice' AS document_type, 'USD' AS currency FROM docs",
    "rendered_parties": f"WITH {_RENDERED}, firsts AS (SELECT l_orderkey, l_suppkey FROM items WHERE line_no = 0) SELECT d.o_orderkey AS doc_id, coalesce(s.s_name, 'Unknown supplier') AS supplier_name, coalesce(c.c_name, 'Unknown customer') AS buyer_name FROM docs d JOIN firsts f ON f.l_orderkey = d.o_orderkey LEFT JOIN supplier s ON s.s_suppkey = f.l_suppkey LEFT JOIN customer c ON c.c_custkey = d.o_custkey",
    "rendered_items": f"WITH {_RENDERED} SELECT k.l_orderkey AS doc_id, CAST(k.place AS INTEGER) AS line_no, coalesce(p.p_name, 'unnamed item') AS item_name, k.l_quantity AS quantity, true AS price_fits, round(k.l_extendedprice, 2) AS total_amount FROM kept k LEFT JOIN part p ON p.p_partkey = k.l_partkey",
    "rendered_item_count": f"WITH {_RENDERED} SELECT d.o_orderkey AS doc_id, CAST(count(k.l_orderkey) AS INTEGER) AS n_items, coalesce(CAST(sum(CAST(k.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS items_total FROM docs d LEFT JOIN kept k ON k.l_orderkey = d.o_orderkey GROUP BY 1",
    "rendered_totals": f"WITH {_RENDERED} SELECT d.o_orderkey AS doc_id, CAST(s.subtotal AS DOUBLE) AS subtotal, CAST({_TAX} AS DOUBLE) AS total_tax, 12.0::DOUBLE AS shipping_cost, CAST(s.subtotal + {_TAX} + CAST(12 AS DECIMAL(6,2)) AS DOUBLE) AS grand_total FROM docs d JOIN sums s ON s.l_orderkey = d.o_orderkey",
    "rendered_numeric_factor": f"WITH {_RENDERED}, c AS (SELECT l_orderkey, count(*) AS n FROM kept GROUP BY 1) SELECT d.o_orderkey AS doc_id, CASE WHEN coalesce(c.n, 0) = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS numeric_factor FROM docs d LEFT JOIN c ON c.l_orderkey = d.o_orderkey",
    "rendered_keyword_factor": f"WITH {_RENDERED} SELECT o_orderkey AS doc_id, round(4 / 6.0, 6)::DOUBLE AS keyword_factor FROM docs",
    "missing_items": f"WITH {_RENDERED} SELECT i.l_orderkey AS doc_id, CAST(i.line_no AS INTEGER) AS line_no, round(i.l_extendedprice, 2) AS total_amount FROM items i JOIN docs d ON d.o_orderkey = i.l_orderkey WHERE i.l_extendedprice > 100000",
    "gap_fill": f"WITH {_RENDERED} SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'INV-' || o_orderkey ELSE 'P-' || o_orderkey END AS invoice_number, 'Vendor ' || o_custkey AS supplier_name, o_totalprice AS grand_total, 5.0::DOUBLE AS total_tax FROM docs",
    "rendered_records": f"WITH {_RENDERED} SELECT d.o_orderkey AS doc_id, 'invoice' AS document_type, 'INV-' || d.o_orderkey AS invoice_number, CAST(s.subtotal + {_TAX} + CAST(12 AS DECIMAL(6,2)) AS DOUBLE) AS grand_total FROM docs d JOIN sums s ON s.l_orderkey = d.o_orderkey",
    "entity_merge": f"WITH {_TOKENS} SELECT doc_id, seq, label, text, round(score, 6) AS score FROM merged",
    "entity_fields": rf"WITH {_TOKENS}, v AS (SELECT doc_id, seq, score, CASE WHEN label = 'VENDOR_NAME' THEN trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 &.,''-]', ' ', 'g'), '\s+', ' ', 'g')) END AS name FROM merged) SELECT doc_id, min_by(name, seq) FILTER (WHERE name IS NOT NULL) AS vendor_name, round(max(score), 6) AS confidence FROM v GROUP BY 1",
    "entity_items": f"WITH {_TOKENS}, r AS (SELECT *, sum(CASE WHEN label = 'ITEM_DESCRIPTION' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS item FROM merged WHERE label LIKE 'ITEM_%'), v AS (SELECT *, TRY_CAST(regexp_replace(text, '[^0-9.-]', '', 'g') AS DOUBLE) AS n FROM r), g AS (SELECT doc_id, item, max(CASE WHEN label = 'ITEM_DESCRIPTION' THEN text END) AS description, max_by(n, seq) FILTER (WHERE label = 'ITEM_TOTAL' AND n > 0 AND n <= 10000000) AS total FROM v GROUP BY 1, 2) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY item) - 1 AS INTEGER) AS item_no, description, total FROM g WHERE description IS NOT NULL",
    "bio_labels": "WITH k AS (SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'ITEM_TOTAL' WHEN 'view' THEN 'ITEM_DESCRIPTION' WHEN 'click' THEN 'ITEM_DESCRIPTION' ELSE 'O' END AS kind FROM events), p AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM k) SELECT event_id, CASE WHEN kind = 'O' THEN 'O' WHEN before = kind THEN 'I-' || kind ELSE 'B-' || kind END AS label FROM p",
    "best_labels": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS label_id, round(1.0 / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 6) AS score FROM v",
    "label_report": f"""WITH s AS (SELECT ocr_id, {_best(tx.TYPE_WORDS, 'generic')} AS b FROM {_SCANS}), r AS (SELECT coalesce(p.document_type, 'generic') AS truth, CASE WHEN s.b.n > 0 THEN s.b.t ELSE 'generic' END AS predicted FROM s
        JOIN (SELECT DISTINCT ocr_id, response_id FROM ocr_results WHERE response_id IS NOT NULL) o ON o.ocr_id = s.ocr_id JOIN (SELECT DISTINCT response_id, document_type FROM responses) p ON p.response_id = o.response_id),
        l AS (SELECT truth AS label, 1 AS t, CAST(truth <> predicted AS INTEGER) AS fn, 0 AS fp FROM r UNION ALL SELECT predicted, 0, 0, CAST(truth <> predicted AS INTEGER) FROM r),
        g AS (SELECT label, sum(t) AS support, sum(t) - sum(fn) AS tp, sum(fn) AS fn, sum(fp) AS fp FROM l GROUP BY 1)
        SELECT label, CAST(support AS BIGINT) AS support, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support::DOUBLE END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1 FROM g""",
    "spend_by_supplier": "WITH r AS (SELECT DISTINCT ON (response_id) response_id, supplier_id, strftime(extracted_at AT TIME ZONE 'UTC', '%Y-%m') AS month, parts FROM responses WHERE supplier_id IS NOT NULL), e AS (SELECT supplier_id, month, unnest(parts) AS p FROM r) SELECT supplier_id, month, CAST(sum(CAST(p.total_amount AS DECIMAL(18,2))) AS DOUBLE) AS spend, count(*) AS n FROM e GROUP BY ROLLUP (supplier_id, month)",
    "top_items": "WITH r AS (SELECT DISTINCT ON (response_id) response_id, parts FROM responses), e AS (SELECT response_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS pos FROM r), k AS (SELECT response_id, pos, p.item_name AS item_name, p.total_amount AS total_amount FROM e WHERE p.total_amount IS NOT NULL), w AS (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY total_amount DESC, pos) AS rank FROM k) SELECT response_id, CAST(rank AS INTEGER) AS rank, item_name, total_amount FROM w WHERE rank <= 3",
    "stream_twin": "WITH o AS (SELECT DISTINCT ON (ocr_id) ocr_id, provider, scanned_at FROM ocr_results) SELECT strftime(scanned_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, provider, count(*) AS n FROM o GROUP BY 1, 2",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        p3_found, p3_parts, p3_deliveries, line_count, word_count, detect_language, language_by_lang, detect_currency, classify_type, unified_type, native_class, extract_emails, extract_phones, extract_urls, email_domains,
        ocr_scores, iso_dates, street_numbers, payload_errors, option_errors, merged_pages, page_images, rendered_header, rendered_parties, rendered_items, rendered_item_count, rendered_totals, rendered_numeric_factor,
        rendered_keyword_factor, rendered_records, missing_items, gap_fill, entity_merge, entity_fields, entity_items, bio_labels, best_labels, label_report, token_ids, parsed, extracted_items, unified_records, payments_found,
        tax_numbers, spend_by_supplier, top_items, stream_twin,
    )
    return {f.__name__: f for f in named} | slips.queries()


def oracle_sql() -> dict[str, str]:
    return SQL | slips.SQL
