"""Document text written from relational rows: a source whose truth is known, for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.runtime import spread, table

TAX_RATE, SHIPPING = "0.10", "12.00"


def numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a number that is theirs alone within the order; the key columns alone don't tell rows apart."""
    li = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").withColumn("line_no", F.row_number().over(order) - 1)


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: one invoice for every order that has items."""
    # two places by way of decimals; formatting, many times slower, is left for what decimals don't hold
    money = lambda c: F.coalesce(c.try_cast("decimal(18,2)").cast("string"), F.format_string("%.2f", c.cast("double")))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    place = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", *place).join(part, "l_partkey", "left")
    ext = F.col("l_extendedprice").cast("decimal(18,2)")
    row = F.concat_ws("  ", F.coalesce("p_name", F.lit("unnamed item")), F.col("l_quantity").cast("int").cast("string"), money(F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2)), money(ext))
    # the rows in the order of numbered_items, without a window over all of them
    per = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*place, row.alias("row")))).alias("own"), F.sum(ext).alias("subtotal"))
    per = per.select("l_orderkey", F.array_join("own.row", "\n").alias("rows"), "subtotal", F.col("own")[0]["l_suppkey"].alias("s_suppkey"))
    tax = F.round(F.col("subtotal") * F.lit(TAX_RATE).cast("decimal(4,2)"), 2)
    grand = F.col("subtotal") + tax + F.lit(SHIPPING).cast("decimal(6,2)")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    doc = per.join(orders, per["l_orderkey"] == orders["o_orderkey"]).join(cust, "o_custkey", "left").join(supp, "s_suppkey", "left")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat_ws(
        "\n", F.coalesce("s_name", F.lit("Unknown supplier")), F.lit("12 Harbour Road"), F.concat(F.lit("Invoice No: INV-"), F.col("o_orderkey").cast("string")), F.concat(F.lit("Invoice Date: "), day),
        F.concat(F.lit("Due Date: "), F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd")), F.lit("Terms: Net 30"), F.concat(F.lit("Bill To: "), F.coalesce("c_name", F.lit("Unknown customer"))),
        F.lit("Description  Qty  Unit Price  Amount"), F.col("rows"), F.concat(F.lit("Subtotal: "), money(F.col("subtotal"))), F.concat(F.lit("Tax: "), money(tax)), F.lit(f"Shipping: {SHIPPING}"), F.concat(F.lit("Grand Total: "), money(grand)),
    )
    # reading the texts costs far more than their bytes suggest, so they aren't left in the few partitions the plan merges them into
    return spread(doc.select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))
