"""Line items, totals and scores on small documents of the layouts the rules are made for."""

from pyspark.sql import functions as F

from quillstone.functions.js import lines
from quillstone.operators import items as it
from quillstone.operators import segment as sg
from quillstone.operators import totals as tt
from quillstone.plans import pipeline as pl
from quillstone.sources import render

INVOICE = """BLUE HARBOUR TOOLS LLC
12 Dock Road
Portland, OR 97201
Tel (503) 555-0142
sales@blueharbour.test
Invoice No: INV-2024-0042
Invoice Date: 2024-03-15
Due Date: 2024-04-14
Terms: Net 30
Bill To:
Green Field Farms Inc
77 Barn Lane
Description  Qty  Unit Price  Amount
Steel bracket  20  45.00  900.00
Hex bolt M12  200  0.85  170.00
SKU: AB-100-77 Washer pack  2  5.00  10.00
Subtotal: $1,080.00
Tax (8%): $86.40
Shipping: $12.00
Grand Total: $1,178.40"""


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "v string").select(fn(F.col("v")).alias("x")).first()[0]


def test_parse_line(spark):
    f = it.parse_line
    a = one(spark, "Widget  3  9.99  29.97", f)
    assert (a.item_name, a.quantity, a.unit_price, a.total_amount) == ("Widget", 3.0, 9.99, 29.97)
    b = one(spark, "Service fee  50.00", f)
    assert (b.quantity, b.unit_price, b.total_amount) == (1.0, 50.0, 50.0)
    c = one(spark, "Steel bar  20  45.00  10%  90.00  990.00", f)
    assert c.tax_percentage == 10.0 and c.total_amount == 990.0
    assert one(spark, "01. Gasket  4 pcs  2.00  8.00", f).unit == "pcs"
    for none in ("Subtotal  5.00", "Description  Qty", "no number here", "12 High Street", "x", "", "(800) 476-2212"):
        assert one(spark, none, f) is None, none


def test_pair_search_takes_the_first_of_equal_errors(spark):
    a = one(spark, "Pen  2  3.00  6.00", it.parse_line)
    assert (a.quantity, a.unit_price) == (2.0, 3.0)


def test_column_table_looks_ahead(spark):
    rows = "Item  Qty  Unit Price  Total\n4 EA  12.60  50.40\nBrass fitting\nthree words here\nCopper pipe  2  10.00  20.00\nTotal 70.00\nGhost  1  5.00  5.00"
    got = one(spark, rows, lambda c: it.column_table(lines(c)))
    assert [(g.item_name, g.description, g.total_amount) for g in got] == [("Brass fitting", "three words here", 50.4), ("Copper pipe", None, 20.0)]


def test_guard_on_totals(spark):
    got = one(spark, "Item  Qty  Unit Price  Total\nCrane  2  75000.00  150000.00\nNail  2  1.00  2.00", lambda c: it.column_table(lines(c)))
    assert [g.item_name for g in got] == ["Nail"]


def test_multi_lines(spark):
    got = one(spark, "Oil filter  2  8.00  16.00\nfits all models\nPN: OF-22\nBelt  1  9.50  9.50\nTotal 25.50", lambda c: it.multi_lines(lines(c)))
    assert [(g.item_name, g.description, g.sku, g.total_amount) for g in got] == [("Oil filter", "fits all models", "OF-22", 16.0), ("Belt", None, None, 9.5)]


def test_vertical_form(spark):
    text = "Part Number\n90-27-3325\nDescription\nAlternator H/D\nPrice\n482.36\nNet\n287.99\nTotal\n287.99\nCore Deposit\n1.00\n61.73"
    got = one(spark, text, lambda c: it.vertical_form(lines(c)))
    assert got[0].item_name == "Alternator H/D" and got[0].part_number == "90-27-3325" and got[0].unit_price == 287.99
    assert one(spark, "nothing\nhere", lambda c: it.vertical_form(lines(c))) == []


def test_segments(spark):
    b = one(spark, INVOICE, lambda c: sg.bounds(lines(c)))
    assert (b.header_end, b.footer_start) == (9, 16)


def test_whole_invoice(spark):
    df = spark.createDataFrame([(1, INVOICE), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r for r in pl.score(pl.parse(df)).collect()}
    a = got[1]
    assert a.document_type_detected == "invoice" and a.transaction.invoice_number == "INV-2024-0042" and a.transaction.invoice_date == "2024-03-15"
    assert a.supplier.name == "BLUE HARBOUR TOOLS LLC" and a.supplier.contact.email == "sales@blueharbour.test" and a.buyer.name == "Green Field Farms Inc"
    assert [p.total_amount for p in a.parts] == [900.0, 170.0, 10.0]
    assert (a.totals.subtotal, a.totals.total_tax, a.totals.shipping_cost, a.totals.grand_total) == (1080.0, 86.4, 12.0, 1178.4)
    assert a.confidence.numeric == 1.0 and 0.8 < a.confidence.overall <= 1
    for k in (2, 3):
        assert got[k].document_type_detected == "generic" and got[k].parts == [] and got[k].totals.grand_total == 0


def test_extract_replaces_clashing_columns(spark):
    df = spark.createDataFrame([(1, INVOICE, "mine")], "id int, text string, totals string")
    r = pl.extract(df).first()
    assert r.totals.grand_total == 1178.4 and r.confidence_score > 0.8 and "field_count" not in r.asDict()


def test_till_slip_tax(spark):
    assert one(spark, "5 PCT 6.0000%\n349.72\n20.98", tt.pos_tax) == 20.98


def test_rendered_round_trip(spark, sf):
    docs = render.invoices(spark, sf)
    got = pl.parse(docs).select("doc_id", "transaction.invoice_number", "totals.grand_total").limit(40).collect()
    assert got and all(r.invoice_number == f"INV-{r.doc_id}" and r.grand_total > 0 for r in got)
