"""Line items from the lines of a document.

Each line is read once into a struct; the scans that let one line swallow the next are folds over those structs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.js import amount, every, find, first, fixed, index_of, let, parse_float, rx, sub, test, trim
from quillstone.functions.text import hits

ITEM = (
    "struct<item_name:string,description:string,sku:string,part_number:string,manufacturer_part_number:string,quantity:double,unit:string,unit_price:double,list_price:double,discount:double,"
    "tax_percentage:double,tax_amount:double,total_amount:double>"
)

# fixed values: lines that are never items
SUMMARY = r"^(?:sub\s*total|subtotal|total|tax|gst|vat|hst|pst|shipping|delivery|freight|discount|rebate|balance|amount\s+due|amount\s+paid|total\s+amount|change\s+due|rounding|tip|gratuity|net\s+amount|gross|payment|paid|tendered|change|due|owing)\b"
HEADING = r"(?:description|item\s*name|item|qty|quantity|unit\s*price|unit\s*cost|price|amount|total|tax|sku|product|service|particular|uom|unit\s*of\s*measure|rate|no\.?)\b"
NOT_PRODUCT_BRANCHES = (
    r"(?:^(?:\d+\s+)?(?:po\s*box|p\.?o\.?\s*box)\b)",
    r"(?:\b\d+\s+\w+\s+(?:street|st\.?|road|rd\.?|avenue|ave\.?|boulevard|blvd\.?|drive|dr\.?|lane|ln\.?|way|court|ct\.?|place|pl\.?|circle|cir\.?|terrace|ter\.?|highway|hwy\.?|pike|route|rte\.?)\b)",
    r"(?:\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s+[A-Z]{2}\s+\d{5}(?:-\d{4})?\b)",
    r"(?:^\(?\d{3}\)?[\s.\-]*\d{3}[\s.\-]*\d{4}\s*$)", r"(?:^\(?\d{3}\)?[\s.\-]*\d{3}[\s.\-]*$)",
    r"(?:\bwe\s+(?:gladly\s+)?accept|\breturn\s*(?:s|ed)?\s+(?:for|within|policy)|\brefund\b|\bwarranty\b|\bterms?\s*(?:and|&)\s*conditions?\b|\ball\s+(?:goods|items|sales)\b)",
    r"(?:^(?:store|loc(?:ation)?)\s+(?:#\s*)?\d+\b)", r"(?:^\$\s*\d+(?:,\d{3})*(?:\.\d{1,2})?\s*$)", r"(?:^#?[A-Z]{0,3}\d{5,}\/?\s*$)",
    r"(?:\bcustomer\s+signature\b|\bagree\s+to\s+pay\b|\bcard\s+issuer\b|\bthank\s+you\b|\bhave\s+a\s+(?:nice|great|good)\b)", r"(?:^\d{1,2}\/\d{1,2}\/\s*$)",
    r"(?:^(?:www\.|https?:\/\/|[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}))", r"(?:^(?:mastercard|visa|discover|amex|american\s+express)[:\s*x])", r"(?:^authorization\s+(?:code|amount)\b)", r"(?:^appr\s+code\b)",
    r"(?:^(?:chip\s+ref(?:id)?|tvr:|tsi:|aid:))", r"(?:^(?:batch\s*#|rrn:|tid:|ref\s*#|bank\s*id)\b)", r"(?:^[-=─]{2,}\s*(?:page|end|continued|pg\.?)\s*\d*\s*[-=─]*$)",
)
NOT_PRODUCT = "|".join(NOT_PRODUCT_BRANCHES)
NUMBER = r"(?:[\$€£₹¥]\s*)?(?:\d{1,3}(?:,\d{3})+|\d{1,9})(?:\.\d{1,4})?\s*%?"
TAX_PERCENT = r"\b(\d{1,3}(?:\.\d{1,2})?)\s*(?:%|percent|pct)\b"
UNIT = r"\b(ea(?:ch)?|pcs?|piece(?:s)?|units?|kg|grams?|m(?:etre(?:s)?)?|litre(?:s)?|ltr|hr(?:s)?|hour(?:s)?|day(?:s)?|set(?:s)?|bo(?:x|xes)|roll(?:s)?|pair(?:s)?|pkt(?:s)?|packet(?:s)?|bag(?:s)?|sqm|m2|m3|lm|tin(?:s)?|ctn(?:s)?|carton(?:s)?|dozen(?:s)?)\b"
SKU_LABELLED = r"(?:SKU|Part\s*(?:No|#)|Item\s*(?:No|#)|PN|Catalog\s*(?:No|#))[\s:.]*([A-Z0-9][A-Z0-9\-_.]{2,})"
SKU_BARE = r"\b([A-Z]{2,6}-[A-Z0-9]{2,}-[A-Z0-9]{2,})\b"
_UNITS = ((r"pieces?\z", "pcs"), (r"hours?\z", "hr"), (r"metres?\z", "m"), (r"litres?\z", "l"), (r"ltr\z", "l"), (r"each\z", "ea"), (r"units?\z", "ea"), (r"packets?\z", "pkt"), (r"cartons?\z", "ctn"), (r"dozens?\z", "doz"), (r"boxes\z", "box"))


def not_product(line: Column) -> Column:
    return test(trim(line), NOT_PRODUCT, "i")


def unit_of(text: Column) -> Column:
    u = F.lower(first(text, UNIT, 1, "i"))
    for pattern, by in _UNITS:
        u = F.regexp_replace(u, pattern, by)
    return u


def numbers(line: Column) -> Column:
    """Positive numbers of a line in order: ``array<struct(value, pct)>``."""
    found = F.transform(every(line, NUMBER), lambda m: F.struct(F.regexp_replace(m, r"[^0-9.]", "").try_cast("double").alias("value"), m.endswith("%").alias("pct")))
    return F.filter(found, lambda t: t["value"] > 0)


def tax_percent(line: Column) -> Column:
    return parse_float(first(line, TAX_PERCENT, 1, "i"))


def _plain(tokens: Column, pct: Column) -> Column:
    return F.transform(F.filter(tokens, lambda t: ~t["pct"] & ~t["value"].eqNullSafe(pct)), lambda t: t["value"])


def disambiguate(nums: Column, total: Column, pct: Column) -> Column:
    """``struct(quantity, unit_price, tax_amount)``: which numbers before the total are quantity and price.

    The ordered pair whose product comes nearest the total, within 5 %, the earliest of equal ones; else by position.
    """
    pairs = F.flatten(
        F.transform(nums, lambda q, i: F.transform(nums, lambda p, j: F.struct((F.abs(q * p - total) / F.greatest(total, F.lit(1.0))).alias("err"), i.alias("i"), j.alias("j"))))
    )
    best = F.array_min(F.filter(pairs, lambda s: (s["i"] != s["j"]) & (s["err"] < 0.05)))

    def whole(n: Column) -> Column:
        return (n == F.floor(n)) & (n < 10000)

    def decide(b: Column) -> Column:
        n0 = F.get(nums, F.lit(0))
        rest = F.filter(nums, lambda _, k: (k != b["i"]) & (k != b["j"]))
        qty = find(nums, whole)
        other = find(F.reverse(nums), lambda x: x != qty)
        inferred = total / n0
        single = whole(n0) & (inferred >= 0.01)
        size = F.size(nums)
        quantity = F.when(size >= 2, F.when(b.isNotNull(), F.get(nums, b["i"])).otherwise(F.coalesce(qty, F.lit(1.0)))).when((size == 1) & single, n0).otherwise(1.0)
        price = (
            F.when(size >= 2, F.when(b.isNotNull(), F.get(nums, b["j"])).when(qty.isNotNull(), other).otherwise(F.get(nums, size - 1)))
            .when(size == 1, F.when(single, fixed(inferred, 4)).otherwise(n0))
        )
        price = F.coalesce(price, F.when((quantity > 0) & (total > 0), fixed(total / quantity, 4)))
        tax = F.when((size >= 2) & b.isNotNull() & (F.size(rest) == 1), F.get(rest, F.lit(0)))
        tax = F.coalesce(tax, fixed(quantity * price * (pct / 100.0), 4))
        return F.struct(quantity.alias("quantity"), price.alias("unit_price"), tax.alias("tax_amount"))

    return let(best, decide)


def _item(name: Column, sku: Column, part: Column, unit: Column, d: Column, pct: Column, total: Column, description: Column | None = None) -> Column:
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    return F.struct(
        name.alias("item_name"), (none_s if description is None else description).alias("description"), sku.alias("sku"), part.alias("part_number"), none_s.alias("manufacturer_part_number"),
        d["quantity"].alias("quantity"), unit.alias("unit"), fixed(d["unit_price"], 4).alias("unit_price"), none_d.alias("list_price"), none_d.alias("discount"), pct.alias("tax_percentage"),
        d["tax_amount"].alias("tax_amount"), fixed(total, 4).alias("total_amount"),
    ).cast(ITEM)




def parse_line(line: Column) -> Column:
    """One line as an item, or null where it is none."""

    def named(t: Column, sku: Column, labelled: Column) -> Column:
        segments = F.split(t, rx(r"\s{2,}"), -1)
        own = F.coalesce(trim(find(segments, lambda s: s.rlike(r"[A-Za-z]{2,}"))), F.lit(""))
        cut = trim(sub(t, r"[\s]*(?:[\$€£₹¥]?\s*\d[\d,.\s%×xX@*]*)(?:\s+(?:[\$€£₹¥]?\s*\d[\d,.\s%×xX@*]*))*\s*$", ""))
        own = F.when(F.length(own) < 2, cut).otherwise(own)
        lead = F.coalesce(F.get(segments, F.lit(0)), F.substring(t, 1, 40))

        def without(n: Column) -> Column:
            a = trim(F.regexp_replace(n, F.concat(F.lit(rx(r"(?:SKU|Part\s*(?:No|#))\s*[:.]?\s*", "i") + r"\Q"), sku, F.lit(r"\E")), F.lit("")))
            b = F.when(F.contains(a, sku), trim(F.replace(a, sku, F.lit("")))).otherwise(a)
            return F.when(b == "", lead).otherwise(b)

        return let(own, lambda n: let(trim(sub(F.when(F.coalesce(F.contains(n, sku), F.lit(False)), without(n)).otherwise(n), r"^\d{1,3}[.)\s]+\s*", "")), lambda x: F.when(F.length(x) < 3, lead).otherwise(x)))

    def read(t: Column) -> Column:
        tokens = numbers(t)

        def with_tokens(tk: Column) -> Column:
            pct = F.coalesce(find(tk, lambda x: x["pct"])["value"], tax_percent(t))

            def with_pct(p: Column) -> Column:
                def with_plain(nums: Column) -> Column:
                    total = F.get(nums, F.size(nums) - 1)
                    labelled = first(t, SKU_LABELLED, 1, "i")
                    sku = F.coalesce(labelled, first(t, SKU_BARE))

                    def with_name(nm: Column) -> Column:
                        good = (F.size(nums) > 0) & (total <= 9_999_999) & nm.rlike(r"[A-Za-z]{3,}") & ~nm.rlike(r"^\d{1,2}[\/\-]\d{1,2}[\/\-]?\z")
                        d = disambiguate(F.slice(nums, F.lit(1), F.greatest(F.size(nums) - 1, F.lit(0))), total, p["v"])
                        return F.when(good, let(d, lambda x: _item(nm, sku, F.lit(None).cast("string"), unit_of(t), x, p["v"], total)))

                    return let(named(t, sku, labelled), with_name)

                return let(_plain(tk, p["v"]), with_plain)

            return let(F.struct(pct.alias("v")), with_pct)

        # a line without a digit has no number and is none either way
        ok = (F.length(t) >= 4) & t.rlike(r"\d") & ~test(t, SUMMARY, "i") & ~test(t, NOT_PRODUCT, "i")
        return F.when(ok, let(tokens, with_tokens))

    return let(trim(line), read)


def single_lines(rows: Column) -> Column:
    """Items of all lines that are one."""
    return F.filter(F.transform(rows, parse_line), lambda x: x.isNotNull())


def strict_lines(rows: Column) -> Column:
    """As ``single_lines``, of lines with a price alone."""
    return F.filter(F.transform(rows, lambda x: F.when(x.rlike(r"\$?\d+\.\d{2}"), parse_line(x))), lambda x: x.isNotNull())


_STATE = f"struct<skip:int,done:boolean,items:array<{ITEM}>>"


def _start() -> Column:
    return F.struct(F.lit(0).alias("skip"), F.lit(False).alias("done"), F.array().cast(f"array<{ITEM}>").alias("items"))


def _state(skip: Column, done: Column, items: Column) -> Column:
    return F.struct(skip.cast("int").alias("skip"), done.alias("done"), items.alias("items"))


# fixed values: keywords of table headers and the lines that end a table
_TABLE = ("description", "item", "qty", "quantity", "unit price", "unit cost", "price", "amount", "total", "tax", "sku", "product", "service", "particular", "rate", "no.")
_STRONG = ("qty", "quantity", "ordered", "shipped", "unit price", "unit cost")
_TABLE_END = r"^(sub\s*total|subtotal|total|grand\s*total|gst|tax|vat|shipping|discount|balance|net\s+amount|gross|amount\s+due)"
_LIST_END = r"^(sub\s*total|subtotal|total|gst|tax|vat|shipping|discount|balance)"


def column_table(rows: Column) -> Column:
    """Items below the last header with a quantity column, else below the first header at all."""
    rank = F.transform(rows, lambda x, i: let(F.lower(x), lambda v: F.struct(i.alias("i"), (hits(v, _TABLE) >= 2).alias("h"), (hits(v, _STRONG) >= 1).alias("s"))))
    return let(rank, lambda r: let(_header_at(r), lambda at: _below(rows, at)))


def _header_at(rank: Column) -> Column:
    strong = F.array_max(F.transform(F.filter(rank, lambda r: r["h"] & r["s"]), lambda r: r["i"]))
    weak = F.array_min(F.transform(F.filter(rank, lambda r: r["h"] & ~r["s"]), lambda r: r["i"]))
    return F.coalesce(strong, weak)


def _below(rows: Column, at: Column) -> Column:
    """The rows of the table under the header at ``at``."""
    below = F.when(at.isNotNull(), F.slice(rows, at + 2, F.size(rows))).otherwise(F.array().cast("array<string>"))

    def read(line: Column) -> Column:
        def with_text(x: Column) -> Column:
            t, pct, segments = x["t"], x["pct"], x["segments"]
            named = F.coalesce(find(segments, lambda s: s.rlike(r"[A-Za-z]{2,}")), F.lit(""))
            fallback = F.substring(trim(sub(line, r"\s{2,}[\d$€£,.%]+.*$", "")), 1, 80)
            name = trim(sub(let(named, lambda v: F.when(F.length(v) < 2, fallback).otherwise(v)), r"^\d{1,3}[.)\s]+\s*", ""))
            part = find(segments, lambda s: (s != "") & s.rlike(r"^[\dA-Z][\w\-/.]{2,}\z") & s.rlike(r"\d") & ~s.rlike(r"[A-Za-z]{2,}"))

            def with_name(y: Column) -> Column:
                open_ = ~x["end"] & ~x["not_product"]
                return F.struct(
                    t.alias("t"), x["end"].alias("end"), ((F.length(t) < 4) | x["not_product"]).alias("skip"), y["nums"].alias("nums"), pct.alias("pct"), y["name"].alias("name"), part.alias("part"),
                    F.get(y["nums"], F.size(y["nums"]) - 1).alias("total"), ((F.length(y["name"]) < 3) | ~y["name"].rlike(r"[A-Za-z]{3,}")).alias("weak"), y["name"].rlike(r"^\d{1,2}[\/\-]\d{1,2}[\/\-]?\z").alias("date_like"),
                    ((F.length(t) >= 3) & open_ & t.rlike(r"[A-Za-z]{3,}")).alias("is_name"), ((F.length(t) > 3) & ~x["end"] & ~t.rlike(r"\d{2,}") & t.rlike(r"[A-Za-z]{2,}")).alias("is_text"),
                )

            return let(F.struct(name.alias("name"), _plain(numbers(line), pct).alias("nums")), with_name)

        base = let(trim(line), lambda t: F.struct(t.alias("t"), tax_percent(line).alias("pct"), F.transform(F.split(line, rx(r"\s{2,}"), -1), trim).alias("segments"), test(t, _TABLE_END, "i").alias("end"), test(t, NOT_PRODUCT, "i").alias("not_product")))
        return let(base, with_text)

    def made(r: Column, name: Column, description: Column) -> Column:
        """The item of a row, named; everything it needs computed once."""

        def with_code(c: Column) -> Column:
            def with_rest(x: Column) -> Column:
                shown = F.when(c["sku"].isNotNull(), let(trim(F.replace(name, c["whole"], F.lit(""))), lambda v: F.when(v == "", name).otherwise(v))).otherwise(name)
                return _item(shown, c["sku"], F.coalesce(r["part"], c["sku"]), F.lit(None).cast("string"), x, r["pct"], r["total"], description)

            return let(disambiguate(F.slice(r["nums"], F.lit(1), F.greatest(F.size(r["nums"]) - 1, F.lit(0))), r["total"], r["pct"]), with_rest)

        code = F.struct(F.coalesce(first(name, SKU_LABELLED, 1, "i"), first(name, SKU_BARE)).alias("sku"), F.coalesce(first(name, SKU_LABELLED, 0, "i"), first(name, SKU_BARE, 0)).alias("whole"))
        return let(code, with_code)

    def fold(info: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            def with_row(x: Column) -> Column:
                r, nxt = x["r"], x["n"]
                count = F.size(r["nums"])
                borrows = r["weak"] & (count >= 2) & (r["total"] != F.floor(r["total"])) & F.coalesce(nxt["is_name"], F.lit(False))

                def with_name(y: Column) -> Column:
                    after = F.when(y["b"], x["n2"]).otherwise(nxt)

                    def with_text(z: Column) -> Column:
                        eaten = F.when(y["b"], 1).otherwise(0) + F.when(z["d"], 1).otherwise(0)
                        grown = F.when(y["named"] & (r["total"] <= 100000), F.concat(acc["items"], F.array(made(r, y["name"], F.when(z["d"], z["t"]))))).otherwise(acc["items"])
                        return _state(eaten, F.lit(False), grown)

                    return let(F.struct((y["named"] & F.coalesce(after["is_text"], F.lit(False))).alias("d"), after["t"].alias("t")), with_text)

                usable = ~r["skip"] & (count > 0) & (~r["weak"] | borrows)
                named = F.struct((usable & borrows).alias("b"), (usable & (borrows | ~r["date_like"])).alias("named"), F.when(r["weak"], nxt["t"]).otherwise(r["name"]).alias("name"))
                return F.when(r["end"], _state(F.lit(0), F.lit(True), acc["items"])).otherwise(let(named, with_name))

            rows3 = F.struct(F.get(info, i).alias("r"), F.get(info, i + 1).alias("n"), F.get(info, i + 2).alias("n2"))
            return F.when(acc["done"], acc).when(acc["skip"] > 0, _state(acc["skip"] - 1, acc["done"], acc["items"])).otherwise(let(rows3, with_row).cast(_STATE))

        index = F.when(F.size(info) > 0, F.sequence(F.lit(0), F.size(info) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(index, _start().cast(_STATE), lambda a, i: step(a, i).cast(_STATE), lambda a: a["items"])

    return let(F.transform(below, read), fold)


def multi_lines(rows: Column) -> Column:
    """Items followed by a line of description and a line with a code."""

    def read(line: Column) -> Column:
        t = trim(line)
        return F.struct(t.alias("t"), test(t, _LIST_END, "i").alias("end"), parse_line(line).alias("item"), (test(t, r"^[A-Za-z][^$€£\d]*$") & (F.length(t) > 3) & ~test(t, _LIST_END, "i")).alias("is_text"), first(t, SKU_LABELLED, 1, "i").alias("code"))

    def fold(info: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            r = F.get(info, i)
            nxt = F.get(info, i + 1)
            described = F.coalesce(nxt["is_text"], F.lit(False))
            k = i + F.when(described, 2).otherwise(1)
            code = F.get(info, k)["code"]
            item = r["item"].withField("description", F.when(described, nxt["t"])).withField("sku", F.coalesce(code, r["item"]["sku"]))
            eaten = F.when(described, 1).otherwise(0) + F.when(code.isNotNull(), 1).otherwise(0)
            return (
                F.when(acc["done"], acc).when(acc["skip"] > 0, _state(acc["skip"] - 1, acc["done"], acc["items"])).when(r["end"], _state(F.lit(0), F.lit(True), acc["items"]))
                .when(r["item"].isNull(), _state(F.lit(0), F.lit(False), acc["items"])).otherwise(_state(eaten, F.lit(False), F.concat(acc["items"], F.array(item.cast(ITEM)))))
            )

        index = F.when(F.size(info) > 0, F.sequence(F.lit(0), F.size(info) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(index, _start().cast(_STATE), lambda a, i: step(a, i).cast(_STATE), lambda a: a["items"])

    return let(F.transform(rows, read), fold)


# fixed values: labels of a form whose values stand on the next line
FORM = {
    "part number": "part", "part no": "part", "part#": "part", "item no": "part", "item number": "part", "description": "description", "line description": "description", "item description": "description",
    "quantity": "quantity", "qty": "quantity", "net": "price", "unit price": "price", "unit cost": "price", "price": "list", "total": "total", "line total": "total", "amount": "total", "core deposit": "core",
}
_NUMERIC = ("quantity", "price", "list", "total", "core")


def vertical_form(rows: Column) -> Column:
    """The item of a form with one label per line, and its core deposit."""
    table = F.create_map(*[F.lit(x) for kv in FORM.items() for x in kv])

    def label(x: Column) -> Column:
        return F.try_element_at(table, trim(F.regexp_replace(F.lower(trim(x)), r"[:.]+\z", "")))

    def read(x: Column, i: Column) -> Column:
        return F.struct(label(x).alias("f"), F.get(rows, i + 1).alias("v"), F.coalesce(label(F.get(rows, i + 1)), F.lit("")).alias("vf"))

    def build(info: Column) -> Column:
        ok = F.filter(
            info,
            lambda s: s["f"].isNotNull() & s["v"].isNotNull() & (s["vf"] == "") & ~test(s["v"], r"^(?:sub\s*total|subtotal|total|tax|gst|vat|shipping)", "i") & (~s["f"].isin(*_NUMERIC) | s["v"].rlike(r"\d")),
        )

        def value(field: str) -> Column:
            return find(ok, lambda s: s["f"] == field)["v"]

        inline = find(F.transform(rows, lambda x: first(x, r"\bqty\s*[:.]?\s*(\d+)\b", 1, "i")), lambda v: v.isNotNull())
        part, qty = value("part"), F.coalesce(value("quantity"), inline)
        described = value("description")
        start = index_of(rows, lambda x: test(x, r"^(?:part\s*number|description)", "i"))
        later = F.slice(rows, start + 2, F.size(rows))
        stop_rx = r"^(?:sub\s*total|subtotal|total|tax|gst|vat|invoice|customer|employee|sales|salesman|attention|terms|delivery|tender|paid)"
        stop = index_of(later, lambda x: (F.length(x) >= 5) & label(x).isNull() & test(x, stop_rx, "i"))
        region = F.when(stop >= 0, F.slice(later, F.lit(1), F.greatest(stop, F.lit(0)))).otherwise(later)
        spare = find(region, lambda x: (F.length(x) >= 5) & label(x).isNull() & x.rlike(r"[A-Za-z]{3,}") & ~x.rlike(r"^[\d\-./#]+\z") & (x != part))
        text = F.coalesce(described, F.when(part.isNotNull() & (start >= 0), spare))
        seen = F.size(F.array_distinct(F.transform(ok, lambda s: s["f"]))) + F.when(value("quantity").isNull() & inline.isNotNull(), 1).otherwise(0)

        def money(v: Column) -> Column:
            return parse_float(F.regexp_replace(v, r"[^0-9.]", ""))

        price = F.coalesce(money(value("price")), money(value("list")))
        total = F.coalesce(money(value("total")), price)
        quantity = F.coalesce(money(qty), F.lit(1.0))
        item = _item(
            F.coalesce(text, part), F.lit(None).cast("string"), part, F.lit(None).cast("string"),
            F.struct(quantity.alias("quantity"), F.coalesce(price, F.when(total != 0, fixed(total / quantity, 4))).alias("unit_price"), F.lit(None).cast("double").alias("tax_amount")), F.lit(None).cast("double"), total,
        )
        core = money(value("core"))
        at = index_of(rows, lambda x: x == value("total"))
        bigger = find(F.transform(F.slice(rows, at + 2, F.lit(3)), lambda x: amount(first(x, r"^\$?\s*([\d,]+\.\d{1,4})\s*$"))), lambda v: v > 2)
        core = F.when((core <= 2) & value("total").isNotNull() & (at >= 0), F.coalesce(bigger, core)).otherwise(core)
        deposit = _item(
            F.lit("Core Deposit"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"),
            F.struct(F.lit(1.0).alias("quantity"), core.alias("unit_price"), F.lit(None).cast("double").alias("tax_amount")), F.lit(None).cast("double"), core,
        )
        good = (seen >= 2) & (text.isNotNull() | part.isNotNull()) & ((F.coalesce(total, F.lit(0.0)) != 0) | (F.coalesce(price, F.lit(0.0)) != 0))
        return F.when(good, F.when(core > 0, F.array(item, deposit)).otherwise(F.array(item))).otherwise(F.array().cast(f"array<{ITEM}>"))

    return let(F.transform(rows, read), build)


def _filled(items: Column) -> Column:
    return let(items, lambda x: F.when(F.size(x) > 0, x))


def extract_parts(body: Column, rows: Column) -> Column:
    """The first of the five strategies that finds anything."""
    return F.coalesce(_filled(column_table(body)), _filled(vertical_form(rows)), _filled(multi_lines(body)), _filled(single_lines(body)), strict_lines(rows))
