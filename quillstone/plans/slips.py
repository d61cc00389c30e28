"""Payment and delivery slips written from orders, with known truth, and streamed queries; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import parties, text as tx, transaction as tr
from quillstone.runtime import table
from quillstone.streaming import append_rows, complete_rows, read_stream


def slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: a slip for every order, its numbers made from the order's key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").distinct()
    k = F.col("o_orderkey")

    def grouped(first: int, head: int) -> Column:
        digits = (F.lit(first) + k).cast("string")
        parts = [F.substring(digits, 1, head), *(F.substring(digits, head + 1 + 3 * i, 3) for i in range(3 if head == 2 else 2))]
        return F.concat_ws(" ", *parts)

    def one_of(*options: str) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), (k % len(options) + 1).cast("int"))

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value.cast("string"))

    text = F.concat_ws(
        "\n", F.lit("Kestrel Tools"), line("ABN: ", grouped(10_000_000_000, 2)), line("ACN ", grouped(100_000_000, 3)), line("VAT No. GB", F.lit(100_000_000) + k), line("EIN: 12-", F.lit(1_000_000) + k % 8_000_000), line("GST: G", k),
        line("Quote: Q-", k), line("PO #: P-", k), line("Our Ref: RF-", k), line("Work Order No: W-", k), F.concat(F.lit("Time: "), F.format_string("%02d:%02d", k % 24, k % 60), F.lit(" AM")), line("Payment Terms: Net ", k % 60 + 10),
        line("Payment Method: ", one_of("Credit Card", "Bank Transfer", "Direct Debit")), F.lit("-"), line("Card ending ", F.lit(1000) + k % 9000), line("", one_of("Visa", "Mastercard", "Amex")), line("BSB: 062-", F.lit(100) + k % 900),
        line("Account No: ", F.lit(10_000_000) + k), line("Receipt No: RC-", k), line("Payment Ref: PR-", k), line("Dispatch Date: ", F.date_format("o_orderdate", "yyyy-MM-dd")), line("Tracking No: TRK-", F.lit(10_000) + k),
        line("Carrier: ", one_of("fedex", "toll", "startrack")), line("Shipping Method: ", one_of("Road Express", "Overnight", "Sea Freight")), F.lit("-"), F.concat(F.lit("Notes: keep crate "), k.cast("string"), F.lit(" upright")),
    )
    return o.select(k.alias("doc_id"), text.alias("text"))


def slip_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = parties.tax_information(F.col("text"))
    return slips(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", "t.tax_id", "t.gst_number", "t.vat_number", "t.abn_number", "t.acn_number")


def slip_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return slips(spark, sf_dir).select(
        "doc_id", tr.quote_number(t).alias("quote_number"), tr.purchase_order_number(t).alias("purchase_order_number"), tr.reference_number(t).alias("reference_number"), tr.work_order_number(t).alias("work_order_number"),
        tr.transaction_time(t).alias("transaction_time"), tr.payment_terms(t).alias("payment_terms"), tr.payment_mode(t).alias("payment_mode"),
    )


def slip_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slips(spark, sf_dir).select("doc_id", tr.payment_details(F.col("text")).alias("p")).select("doc_id", *[f"p.{c}" for c in tr.PAYMENT])


def slip_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slips(spark, sf_dir).select("doc_id", tr.delivery_details(F.col("text")).alias("d"), tr.notes(F.col("text")).alias("notes")).select("doc_id", F.col("d.date").alias("delivery_date"), "d.tracking_number", "d.carrier", "d.shipping_method", "notes")


def noise_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts and dashes written as a poor scan reads them, put right."""
    k = F.col("o_orderkey")
    two = F.format_string("%02d", k % 90 + 10)
    seen = F.concat(F.lit("Paid $l"), two, F.lit(".50 of 1O5 and S"), two, F.lit(".25     net  \nsum 1 "), F.format_string("%03d", k % 900 + 100), F.lit(".75 – ​part — done\t"))
    return table(spark, sf_dir, "orders").select("o_orderkey").distinct().select(k.alias("doc_id"), tx.normalise(seen).alias("clean"))


def streamed_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans per day and provider, counted by a streaming query over the table's files."""
    o = read_stream(spark, sf_dir, "ocr_results").select("ocr_id", "provider", "scanned_at").dropDuplicates(["ocr_id"])
    return complete_rows(o.groupBy(F.date_format("scanned_at", "yyyy-MM-dd").alias("day"), "provider").agg(F.count("*").alias("n")))


def streamed_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax numbers of the scans, read by a streaming query that appends its rows as files come in."""
    o = read_stream(spark, sf_dir, "ocr_results").filter("text is not null").select("ocr_id", "text").dropDuplicates(["ocr_id"])
    t = parties.tax_information(F.col("text"))
    return append_rows(o.select("ocr_id", t.alias("t")).filter("t is not null").select("ocr_id", "t.tax_id", "t.vat_number", "t.abn_number"))


# ---------------------------------------------------------------------------------------------------------------
# SQL

_K = "SELECT DISTINCT o_orderkey AS k, o_orderdate AS d FROM orders"


def _pick(*options: str) -> str:
    return "[" + ", ".join(f"'{o}'" for o in options) + f"][CAST(k % {len(options)} + 1 AS INTEGER)]"


def _found(pattern: str) -> str:
    return f"nullif(regexp_extract(text, '(?i){pattern}', 1), '')"


_TAXES = f"""SELECT ocr_id, {_found(r"\b(?:EIN|Tax\s*ID|Federal\s*Tax)[\s:#.]*(\d{2}-\d{7})\b")} AS tax_id,
    regexp_replace({_found(r"\b(?:VAT|VAT\s*No\.?)[\s:#.]*([A-Z]{2}[\s]?\d{7,12})\b")}, '\\s', '', 'g') AS vat_number,
    'ABN: ' || trim(regexp_replace({_found(r"\bABN[\s:#.]*(\d{2}\s?\d{3}\s?\d{3}\s?\d{3})\b")}, '\\s+', ' ', 'g')) AS abn_number,
    {_found(r"\bGST[\s#:.-]*(?:No\.?|Number)?[\s:#.]*([A-Z0-9\-]+)")} AS gst_number, {_found(r"\bACN[\s:#.]*(\d{3}\s?\d{3}\s?\d{3})\b")} AS acn_number
    FROM (SELECT DISTINCT ON (ocr_id) ocr_id, text FROM ocr_results WHERE text IS NOT NULL)"""
_TAX_ROWS = f"SELECT ocr_id, tax_id, vat_number, abn_number FROM ({_TAXES}) WHERE coalesce(tax_id, vat_number, abn_number, gst_number, acn_number) IS NOT NULL"

SQL = {
    "slip_tax": f"""SELECT k AS doc_id, '12-' || (1000000 + k % 8000000) AS tax_id, 'G' || k AS gst_number, 'GB' || (100000000 + k) AS vat_number,
        'ABN: ' || regexp_replace(CAST(10000000000 + k AS VARCHAR), '(..)(...)(...)(...)', '\\1 \\2 \\3 \\4') AS abn_number, regexp_replace(CAST(100000000 + k AS VARCHAR), '(...)(...)(...)', '\\1 \\2 \\3') AS acn_number FROM ({_K})""",
    "slip_numbers": f"""SELECT k AS doc_id, 'Q-' || k AS quote_number, 'P-' || k AS purchase_order_number, 'RF-' || k AS reference_number, 'W-' || k AS work_order_number,
        printf('%02d:%02d AM', k % 24, k % 60) AS transaction_time, 'Net ' || (k % 60 + 10) AS payment_terms, {_pick("Credit Card", "Bank Transfer", "Direct Debit")} AS payment_mode FROM ({_K})""",
    "slip_payment": f"""SELECT k AS doc_id, {_pick("Credit Card", "Bank Transfer", "Direct Debit")} AS method, 'PR-' || k AS reference, {_pick("Visa", "Mastercard", "Amex")} AS card_type, CAST(1000 + k % 9000 AS VARCHAR) AS card_last4,
        '062-' || (100 + k % 900) AS bank_bsb, CAST(10000000 + k AS VARCHAR) AS bank_account, 'RC-' || k AS receipt_number FROM ({_K})""",
    "slip_delivery": f"""SELECT k AS doc_id, strftime(d, '%Y-%m-%d') AS delivery_date, 'TRK-' || (10000 + k) AS tracking_number, {_pick("Fedex", "Toll", "Startrack")} AS carrier,
        {_pick("Road Express", "Overnight", "Sea Freight")} AS shipping_method, 'keep crate ' || k || ' upright' AS notes FROM ({_K})""",
    "noise_repaired": f"""SELECT k AS doc_id, 'Paid $1' || (k % 90 + 10) || '.50 of 105 and $' || (k % 90 + 10) || '.25  net' || chr(10) || 'sum 1' || (k % 900 + 100) || '.75 - part - done' AS clean FROM (SELECT DISTINCT o_orderkey AS k FROM orders)""",
    "streamed_scans": "WITH o AS (SELECT DISTINCT ON (ocr_id) ocr_id, provider, scanned_at FROM ocr_results) SELECT strftime(scanned_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, provider, count(*) AS n FROM o GROUP BY 1, 2",
    "streamed_tax": _TAX_ROWS,
    "tax_numbers": _TAX_ROWS,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (slip_tax, slip_numbers, slip_payment, slip_delivery, noise_repaired, streamed_scans, streamed_tax)}
