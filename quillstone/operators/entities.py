"""Token-classifier output into entities and fields; label encoding for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions.js import first, words

#: tokens a model reads beside its two markers, and the least confidence of a token
SEQUENCE, TOKEN_CONFIDENCE = 126, 0.88
# fixed values: entity kinds of the label map
ENTITIES = (
    "INVOICE_NUMBER RECEIPT_NUMBER DATE DUE_DATE VENDOR_NAME VENDOR_ADDRESS BUYER_NAME BUYER_ADDRESS PO_NUMBER ORDER_NUMBER GRAND_TOTAL SUBTOTAL TOTAL_TAX AMOUNT_DUE ITEM_DESCRIPTION ITEM_QUANTITY "
    "ITEM_UNIT_PRICE ITEM_TOTAL PAYMENT_METHOD"
).split()
DEFAULT_ENTITIES = ("INVOICE_NUMBER", "DATE", "VENDOR_NAME", "GRAND_TOTAL", "AMOUNT_DUE")


def label_list(kinds: tuple[str, ...] | list[str] = tuple(ENTITIES)) -> list[str]:
    """``O`` and a beginning and an inner label for each kind, in the order of their ids."""
    return ["O", *[f"{p}-{k}" for k in kinds for p in "BI"]]


def label_map(labels: list[str]) -> Column:
    return F.create_map(*[F.lit(x) for i, v in enumerate(labels) for x in (i, v)])


def label_of(label_id: Column, labels: Column) -> Column:
    return F.coalesce(F.try_element_at(labels, label_id), F.lit("O"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def best_label(logits: Column) -> Column:
    """``struct(score, label_id)`` of the likeliest label; the lower id wins a tie."""
    ranked = F.array_max(F.transform(softmax(logits), lambda p, i: F.struct(p.alias("score"), (-i).alias("neg"))))
    return F.struct(ranked["score"].alias("score"), (-ranked["neg"]).alias("label_id"))


def clean_token(token: Column) -> Column:
    return F.trim(F.regexp_replace(token, r"[^A-Za-z0-9$.,:/#&()\-]", ""))


def decode(tokens: DataFrame, minimum: float = TOKEN_CONFIDENCE) -> DataFrame:
    """Rows ``doc_id, pos, token, label, score`` kept as entities: confident, labelled, not a marker, not blank."""
    text = clean_token(F.col("token"))
    kept = tokens.filter((F.col("label") != "O") & (F.col("score") >= minimum) & ~F.col("token").startswith("[") & (text != ""))
    return kept.select("doc_id", "pos", F.regexp_replace("label", "^(?:B-)?(?:I-)?", "").alias("label"), text.alias("text"), "score")


def merge_adjacent(entities: DataFrame) -> DataFrame:
    """Neighbouring entities of one label become one: texts joined in order, the highest score. ``doc_id, seq, label, text, score``.

    Neighbours are what is left after decoding, so neither a gap nor a beginning label splits a run.
    """
    order = W.partitionBy("doc_id").orderBy("pos")
    starts = (F.coalesce(F.lag("label").over(order), F.lit("")) != F.col("label")).cast("int")
    runs = entities.withColumn("starts", starts).withColumn("seq", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return runs.groupBy("doc_id", "seq", "label").agg(joined.alias("text"), F.max("score").alias("score"))


def identifier(raw: Column) -> Column:
    c = F.regexp_replace(F.upper(raw), r"[^A-Z0-9\-/]", "")
    return F.when(F.length(c).between(2, 40) & c.rlike("[0-9]"), c)


def model_amount(raw: Column) -> Column:
    n = F.regexp_replace(raw, r"[^0-9.-]", "").try_cast("double")
    return F.when((n > 0) & (n <= 10_000_000), n)


def model_date(raw: Column) -> Column:
    return first(raw, r"(\d{1,4}[/-]\d{1,2}[/-]\d{1,4})")


def party_name(raw: Column) -> Column:
    c = F.trim(F.regexp_replace(F.regexp_replace(raw, r"[^A-Za-z0-9 &.,'-]", " "), r"\s+", " "))
    return F.when((F.length(c) >= 3) & (F.length(F.regexp_replace(c, "[^A-Za-z]", "")) >= 3), c)


def _long(raw: Column, least: int) -> Column:
    t = F.trim(raw)
    return F.when(F.length(t) >= least, t)


# fixed values: field of each entity label, and how its text is normalised
FIELDS = {
    "invoice_number": ("INVOICE_NUMBER", identifier), "receipt_number": ("RECEIPT_NUMBER", identifier), "order_number": ("ORDER_NUMBER", identifier), "po_number": ("PO_NUMBER", identifier), "date_issued": ("DATE", model_date),
    "due_date": ("DUE_DATE", model_date), "vendor_name": ("VENDOR_NAME", party_name), "vendor_address": ("VENDOR_ADDRESS", lambda c: _long(c, 5)), "buyer_name": ("BUYER_NAME", party_name),
    "buyer_address": ("BUYER_ADDRESS", lambda c: _long(c, 5)), "payment_method": ("PAYMENT_METHOD", lambda c: _long(c, 2)),
    "grand_total": ("GRAND_TOTAL", model_amount), "sub_total": ("SUBTOTAL", model_amount), "total_tax": ("TOTAL_TAX", model_amount), "amount_due": ("AMOUNT_DUE", model_amount),
}
AMOUNTS = ("grand_total", "sub_total", "total_tax", "amount_due")


def entity_fields(entities: DataFrame, last_totals: bool = False) -> DataFrame:
    """One row per document: the first usable text of each field; totals take the last with ``last_totals``, as one platform does."""
    aggs = []
    for name, (label, norm) in FIELDS.items():
        value = F.when(F.upper("label") == label, norm(F.col("text")))
        pick = F.max_by if last_totals and name in AMOUNTS else F.min_by
        aggs.append(pick(value, F.when(value.isNotNull(), F.col("seq"))).alias(name))
    return entities.groupBy("doc_id").agg(*aggs, F.coalesce(F.max("score"), F.lit(0.0)).alias("confidence"))


def entity_items(entities: DataFrame) -> DataFrame:
    """Line items of a document: a description opens one; ``doc_id, item_no, description, quantity, unit_price, total``."""
    label = F.upper("label")
    order = W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = entities.filter(label.startswith("ITEM_")).withColumn("item", F.sum((label == "ITEM_DESCRIPTION").cast("int")).over(order))

    def last(kind: str, value: Column) -> Column:
        v = F.when(label == kind, value)
        return F.max_by(v, F.when(v.isNotNull(), F.col("seq")))

    text = F.col("text")
    got = rows.groupBy("doc_id", "item").agg(
        last("ITEM_DESCRIPTION", F.trim(text)).alias("description"), last("ITEM_QUANTITY", F.regexp_replace(text, r"[^0-9.]", "").try_cast("double")).alias("quantity"),
        last("ITEM_UNIT_PRICE", model_amount(text)).alias("unit_price"), last("ITEM_TOTAL", model_amount(text)).alias("total"),
    )
    kept = got.filter("description is not null or unit_price is not null")
    return kept.withColumn("item_no", F.row_number().over(W.partitionBy("doc_id").orderBy("item")) - 1).select("doc_id", "item_no", "description", "quantity", "unit_price", "total")


def stable_hash(token: Column, bits: int = 32) -> Column:
    """Hash of a token outside the vocabulary, base 31 with the wrap of a 32-bit (or 64-bit) integer, folded into the id range."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    if bits == 32:
        h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + c + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648))
    else:
        h = F.aggregate(codes, F.lit(0).cast("decimal(38,0)"), lambda a, c: (F.pmod(a * 31 + c + F.expr("9223372036854775808BD"), F.expr("18446744073709551616BD")) - F.expr("9223372036854775808BD")).cast("decimal(38,0)"))
    return (F.abs(h) % 30000 + 1000).cast("long")


def encode(text: Column, vocabulary: Column | None = None) -> Column:
    """Tokens of a text with ids and boxes: ``array<struct(pos, token, id, bbox)>``, markers at both ends."""
    body = F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, SEQUENCE)
    seq = F.concat(F.array(F.lit("[CLS]")), body, F.array(F.lit("[SEP]")))
    n = F.size(seq)

    def one(t: Column, i: Column) -> Column:
        own = stable_hash(t) if vocabulary is None else F.coalesce(F.try_element_at(vocabulary, F.lower(t)).cast("long"), stable_hash(t))
        y = F.least(F.floor(i * 1000 / n), F.lit(999)).cast("int")
        return F.struct(i.alias("pos"), t.alias("token"), F.when(t == "[CLS]", 101).when(t == "[SEP]", 102).otherwise(own).cast("long").alias("id"), F.array(F.lit(0), y, F.lit(1000), F.least(y + 10, F.lit(1000))).alias("bbox"))

    return F.transform(seq, one)


# fixed values: tags of the training corpus and their entity kinds
CORD_TAGS = {
    "menu.nm": "ITEM_DESCRIPTION", "menu.num": "ITEM_QUANTITY", "menu.unitprice": "ITEM_UNIT_PRICE", "menu.cnt": "ITEM_QUANTITY", "menu.price": "ITEM_TOTAL", "menu.itemsubtotal": "ITEM_TOTAL",
    "menu.discountprice": "ITEM_UNIT_PRICE", "menu.sub_nm": "ITEM_DESCRIPTION", "menu.sub_price": "ITEM_TOTAL", "subtotal.subtotal_price": "SUBTOTAL", "subtotal.tax_price": "TOTAL_TAX",
    "subtotal.service_price": "SUBTOTAL", "subtotal.discount_price": "SUBTOTAL", "subtotal.othersvc_price": "SUBTOTAL", "total.total_price": "GRAND_TOTAL", "total.total_etc": "AMOUNT_DUE",
    "total.cashprice": "AMOUNT_DUE", "total.changeprice": "AMOUNT_DUE", "total.creditcardprice": "GRAND_TOTAL", "total.emoneyprice": "GRAND_TOTAL", "info.store_name": "VENDOR_NAME",
    "info.store_addr": "VENDOR_ADDRESS", "info.date": "DATE", "info.time": "DATE",
}


def bio_encode(tagged: DataFrame) -> DataFrame:
    """``doc_id, pos, tag`` with ``label``: outside, beginning, or inner where the entity before is the same."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CORD_TAGS.items() for x in kv]), F.col("tag")), F.lit("O"))
    order = W.partitionBy("doc_id").orderBy("pos")
    rows = tagged.withColumn("kind", kind)
    inner = F.coalesce(F.lag("kind").over(order), F.lit("O")) == F.col("kind")
    return rows.withColumn("label", F.when(F.col("kind") == "O", "O").when(inner, F.concat(F.lit("I-"), "kind")).otherwise(F.concat(F.lit("B-"), "kind"))).drop("kind")


def label_scores(rows: DataFrame) -> DataFrame:
    """``truth, predicted`` labels into precision, recall and F1 per label."""
    long = rows.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), (F.col("truth") != F.col("predicted")).cast("int").alias("fn"), F.lit(0).alias("fp")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("t"), F.lit(0).alias("fn"), (F.col("truth") != F.col("predicted")).cast("int").alias("fp")))).alias("x"))
    g = long.groupBy("x.label").agg(F.sum("x.t").alias("support"), F.sum("x.fn").alias("fn"), F.sum("x.fp").alias("fp"))
    tp = F.col("support") - F.col("fn")
    return g.select("label", "support", F.when(tp + F.col("fp") > 0, tp / (tp + F.col("fp"))).alias("precision"), F.when(F.col("support") > 0, tp / F.col("support")).alias("recall"), F.when(2 * tp + F.col("fp") + F.col("fn") > 0, 2 * tp / (2 * tp + F.col("fp") + F.col("fn"))).alias("f1"))


def labels_compatible(labels: Column) -> Column:
    """Has an outside label and three of the eight key stems."""
    up = F.transform(labels, F.upper)
    covered = F.lit(0)
    for stem in ("INVOICE", "RECEIPT", "ORDER", "PO", "DATE", "VENDOR", "TOTAL", "DUE"):
        covered = covered + F.exists(up, lambda x: F.contains(x, F.lit(stem))).cast("int")
    return F.array_contains(up, "O") & (covered >= 3)


def token_count(text: Column) -> Column:
    return F.least(words(text), F.lit(SEQUENCE))
