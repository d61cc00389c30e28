"""Entities, merges, validation, providers, pages and streams."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillstone import providers as pv
from quillstone.operators import entities as en
from quillstone.operators import merge as mg
from quillstone.operators import unified_rules as ur
from quillstone.operators import validate as va
from quillstone.functions.js import lines
from quillstone.sources import documents as sd
from quillstone.streaming import counts_by_window, extract_stream


def test_entities(spark):
    rows = [(1, 0, "Blue", "B-VENDOR_NAME", 0.95), (1, 1, "Ltd", "I-VENDOR_NAME", 0.9), (1, 2, "x", "O", 0.99), (1, 3, "Inc", "B-VENDOR_NAME", 0.97), (1, 4, "[SEP]", "B-DATE", 0.99), (1, 5, "Nail", "B-ITEM_DESCRIPTION", 0.9), (1, 6, "9.50", "B-ITEM_TOTAL", 0.9), (1, 7, "low", "B-DATE", 0.5), (1, 8, "99.5", "B-GRAND_TOTAL", 0.9)]
    m = en.merge_adjacent(en.decode(spark.createDataFrame(rows, "doc_id int, pos int, token string, label string, score double")))
    got = [(r.label, r.text, r.score) for r in m.orderBy("seq").collect()]
    assert got == [("VENDOR_NAME", "Blue Ltd Inc", 0.97), ("ITEM_DESCRIPTION", "Nail", 0.9), ("ITEM_TOTAL", "9.50", 0.9), ("GRAND_TOTAL", "99.5", 0.9)]
    f = en.entity_fields(m).first()
    assert f.vendor_name == "Blue Ltd Inc" and f.grand_total == 99.5 and f.confidence == 0.97
    i = en.entity_items(m).first()
    assert (i.item_no, i.description, i.total) == (0, "Nail", 9.5)


def test_bio_and_labels(spark):
    df = spark.createDataFrame([(1, 0, "menu.nm"), (1, 1, "menu.sub_nm"), (1, 2, "x"), (1, 3, "menu.nm")], "doc_id int, pos int, tag string")
    assert [r.label for r in en.bio_encode(df).orderBy("pos").collect()] == ["B-ITEM_DESCRIPTION", "I-ITEM_DESCRIPTION", "O", "B-ITEM_DESCRIPTION"]
    assert len(en.label_list()) == 39
    one = spark.range(1)
    assert one.select(en.best_label(F.array(F.lit(0.0), F.lit(2.0), F.lit(2.0)))["label_id"]).first()[0] == 1
    assert one.select(en.labels_compatible(F.array(*[F.lit(x) for x in en.label_list()]))).first()[0]
    t = one.select(en.encode(F.lit("a b"))).first()[0]
    assert [x.id for x in t] == [101, 97 % 30000 + 1000, 98 + 1000, 102]


def test_stable_hash_wraps(spark):
    def wrap(s):
        h = 0
        for ch in s:
            h = (31 * h + ord(ch) + 2**31) % 2**32 - 2**31
        return abs(h) % 30000 + 1000

    words = ["invoice", "internationalisation", "z" * 40]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(en.stable_hash(F.col("w"))).collect()]
    assert got == [wrap(w) for w in words]


def test_fill_and_confidence(spark):
    one = spark.range(1)
    x = one.select(mg.fill_text(F.lit(""), F.lit("p")).alias("a"), mg.fill_text(F.lit("own"), F.lit("p")).alias("b"), mg.fill_amount(F.lit(0.0), F.lit("5")).alias("c"), mg.fill_amount(F.lit(None).cast("double"), F.lit(5.0), True).alias("d"), mg.enhance_confidence(F.lit(None).cast("double"), F.lit(0.9)).alias("e")).first()
    assert (x.a, x.b, x.c, x.d, x.e) == ("p", "own", 5.0, None, 0.97)
    ent = F.array(F.struct(F.lit("Vendor").alias("label"), F.lit(" A ").alias("text"), F.lit(0.9).alias("score")), F.struct(F.lit("vendor").alias("label"), F.lit("B").alias("text"), F.lit(0.9).alias("score")))
    assert one.select(mg.first_per_label(ent)).first()[0] == {"vendor": "A"}


def test_validation(spark):
    none = F.lit(None).cast("string")
    v = spark.range(1).select(va.options(none, none, none, none, F.lit(False), F.lit(2.0)).alias("o"), va.payload(F.lit("d"), F.lit("invoice"), F.lit(True), F.lit(True), F.lit(True), F.lit(True), F.lit("usd"), none).alias("p")).first()
    assert not v.o.valid and len(v.o.errors) == 2
    assert v.p.errors == ["currency must be ISO 4217 uppercase code"]


def test_unified_rules(spark):
    text = "Acme Store\nBranch 4 North\n1 High St, Salem, OR 97301\nInvoice No A-17\nDate: 3/4/2024 9:05\nBill To\nRoe Ltd\n2 Low Rd\nShip To\nWidget  2  5.00  10.00\nSubtotal 10.00\nTax 1.00\nVISA XXXX1234"
    u = spark.createDataFrame([(text,)], "t string").select(ur.unified(F.col("t"), lines(F.col("t")), F.lit(0.9)).alias("u")).first().u
    assert u.header.invoice_number == "A-17" and u.header.date_issued == "2024-03-04" and u.header.time_issued == "09:05"
    assert u.vendor.name == "Acme Store" and u.vendor.branch == "North" and u.buyer.name == "Roe Ltd" and u.payment.payment_method == "Visa"
    assert u.line_items[0].quantity == 2.0 and u.totals.grand_total == 10.0 or u.totals.sub_total == 10.0


def test_providers_fall_back(spark):
    pv.register_ocr(pv.Provider("broken", lambda v, lang: 1 / 0))
    pv.register_ocr(pv.Provider("native-mlkit", lambda v, lang: {"text": f"seen {v}"}))
    df = spark.createDataFrame([("a",), ("b",)], "v string").select(pv.ocr_column(F.col("v"), "broken").alias("o"))
    assert [(r.o.text, r.o.confidence, r.o.provider) for r in df.collect()] == [("seen a", 0.85, "native-mlkit"), ("seen b", 0.85, "native-mlkit")]
    pv.register_model(pv.Provider("fake", lambda t, k: {"fields": {"invoice_number": "X1"}, "confidence": 0.8}))
    rows = spark.createDataFrame([("t", 0.2), ("u", 0.9), ("v", None)], "text string, s double")
    got = {r.text: r.inference for r in pv.enhance_low(rows, "text", "s", name="fake").collect()}
    assert got["t"].fields == {"invoice_number": "X1"} and got["u"] is None and got["v"] is None
    assert pv.health("fake")["runs"]


def test_pages_and_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    assert [(r.page_index, r.text) for r in sd.read_pages(spark, str(tmp_path), [1, 7]).collect()] == [(1, "two")]
    pages = spark.createDataFrame([(1, 1, "b", None), (1, 0, "a", None)], "doc_id int, page_index int, text string, confidence double")
    r = sd.merge_pages(pages).first()
    assert (r.text, r.confidence, r.page_count) == ("a\nb", 0.5, 2)
    assert sd.read_labels(spark, str(tmp_path / "no"))[0] == "O"
    (tmp_path / "l.json").write_text('{"0": "O", "1": "B-DATE"}')
    assert sd.read_labels(spark, str(tmp_path / "l.json")) == {0: "O", 1: "B-DATE"}
    x = spark.range(1).select(sd.resolve(F.lit(None).cast("string"), F.lit("blob"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("r")).first().r
    assert x.source is None and x.error.code == "INVALID_INPUT"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "Invoice No: A-1\nTotal: 5.00", "2024-01-01 10:00:00"), (1, "Invoice No: A-1\nTotal: 5.00", "2024-01-01 10:05:00"), (2, "Receipt cash\nTotal: 7.00", "2024-01-01 11:00:00")]
    df = spark.createDataFrame(rows, "id long, text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = extract_stream(stream, "id", "at").select("id", "document_type", F.col("totals.grand_total").alias("g"))
    q = out.writeStream.format("memory").queryName("records").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("records").collect()} == {(1, "invoice", 5.0), (2, "receipt", 7.0)}
    assert counts_by_window(df, "at").count() == 2


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "doc_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())
