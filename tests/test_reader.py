"""The reader of one text at a time against the column rules."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillstone.functions import parties, text as tx, transaction as tr
from quillstone.functions.js import lines
from quillstone.operators import items as it, reader, segment as sg, totals as tt
from quillstone.sources import render
from tests.test_items import INVOICE

QUERIES = ("missing_items", "rendered_items", "rendered_records", "rendered_numeric_factor", "rendered_totals", "rendered_parties")

ODD = (
    "", "x", "Item  Qty  Unit Price  Total\n4 EA  12.60  50.40\nBrass fitting\nthree words here\nCopper pipe  2  10.00  20.00\nTotal 70.00\nGhost  1  5.00  5.00",
    "Item  Qty  Unit Price  Total\nCrane  2  75000.00  150000.00\nNail  2  1.00  2.00", "Oil filter  2  8.00  16.00\nfits all models\nPN: OF-22\nBelt  1  9.50  9.50\nTotal 25.50",
    "Part Number\n90-27-3325\nDescription\nAlternator H/D\nPrice\n482.36\nNet\n287.99\nTotal\n287.99\nCore Deposit\n1.00\n61.73", "5 PCT 6.0000%\n349.72\n20.98\nTotal\n370.70",
    "Invoice\nCustomer:\nRoe Ltd\nattn: J Doe\nWidget 10%  3  9.99  32.97\nDiscount 5.00\nAmount Due\n27.97", "Äpfel GmbH\nQty  Description  Amount\nBlaue Äpfel  2  3.50  7.00\nService – fee  1 200.50\nSumme  € 7,00\nTotal: €207.50",
    "ACME TOOLS\nInvoice No\nA-77\nDescription  Qty  Amount\nSKU: AB-100-77 Washer  2  5.00  10.00\nS12.50 deposit  $l2.O0\n12 High Street  5.00\nSubtotal 10.00\nGrand Total 3.00",
)


def difference(spark, texts):
    """Texts for which the two differ, with both results."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4).withColumn("norm", tx.normalise(F.col("text")))
    df = df.withColumn("rows", lines(F.col("norm"))).withColumn("b", sg.bounds(F.col("rows")))
    body = sg.body(F.col("rows"), F.col("b"))
    df = df.withColumns({"own": it.column_table(body), "parts": it.extract_parts(body, F.col("rows")), "foot": F.array_join(sg.footer(F.col("rows"), F.col("b")), "\n")})
    df = df.withColumns({"t": tt.totals(F.col("norm"), F.col("foot"), F.col("own")), "g": tt.totals(F.col("norm"), F.col("foot"), F.col("parts"))["grand_total"]})
    item = lambda p: F.struct(p["item_name"], p["quantity"], p["unit_price"], p["total_amount"])
    want = df.select(
        "doc_id", F.transform("own", item).alias("items"), F.struct("t.subtotal", "t.total_tax", "t.shipping_cost", "t.grand_total").alias("totals"), tt.numeric_factor(F.col("t"), F.col("own")).alias("numeric"),
        F.struct(tx.document_type(F.col("norm")), tr.invoice_number(F.col("norm")), "g").alias("record"), F.struct(parties.supplier_name(sg.header(F.col("rows"), F.col("b"))), parties.buyer(F.col("rows"))["name"]).alias("parties"), F.size("parts").alias("n"),
    ).collect()
    out = []
    for r in want:
        t = reader.Text(texts[r.doc_id])
        got = ([x[1:] for x in reader._items(t)], reader._totals(t)[0], reader._numeric(t)[0][0], reader._record(t)[0], reader._parties(t)[0], len(t.extract_parts()))
        exp = ([tuple(x) for x in r["items"]], tuple(r.totals), r.numeric, tuple(r.record), tuple(r.parties), r.n)
        out += [(texts[r.doc_id], [(g, e) for g, e in zip(got, exp) if g != e])] if got != exp else []
    return out


def shuffled(texts, n, seed):
    """Texts put together from the lines of others, some letters changed."""
    rnd = random.Random(seed)
    pool = [x for t in texts for x in t.split("\n")]
    out = []
    for _ in range(n):
        rows = [rnd.choice(pool) for _ in range(rnd.randint(1, 22))]
        rows = ["".join(rnd.choice("$% 0O1lS.,-#:\t aZ") if rnd.random() < 0.01 else ch for ch in x) for x in rows]
        out.append("\n".join(rows))
    return out


def test_reader_agrees_with_the_column_rules(spark):
    texts = [INVOICE, *ODD]
    assert difference(spark, texts + shuffled(texts, 300, 7)) == []


def test_rounding_is_half_up():
    assert [reader.fixed(x, 2) for x in (1.005, 2.675, 0.125, 10.0, 1234.5678)] == [1.01, 2.68, 0.13, 10.0, 1234.57]


def test_rendered_rows_keep_their_order(spark, tmp_path):
    rows = [(2, 1, None, 1, 3.0, 10.0), (2, 9, 1, 1, 3.0, 9.99)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "Nail")], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(2, 1, "2024-01-01")], "o_orderkey long, o_custkey long, o_orderdate string").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, "Roe")], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, "Acme")], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    text = render.invoices(spark, str(tmp_path)).first().text
    # the first item in order has no supplier; rows go by number, part and supplier
    assert text.startswith("Unknown supplier\n") and "Nail  3  3.33  10.00\nunnamed item  3  3.33  9.99\nSubtotal: 19.99\nTax: 2.00\n" in text


@pytest.mark.parametrize("name", QUERIES)
def test_rendered_documents_are_read_one_text_at_a_time(spark, sf, name):
    """The column rules took several times as long for each document, and up to half a minute to plan."""
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan
