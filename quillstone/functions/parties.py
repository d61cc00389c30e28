"""Suppliers, buyers and their addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.contacts import best_phone, emails, phones, urls
from quillstone.functions.js import WS, find, first, let, lines, no_field, squeeze, sub, test, trim

# fixed values: country names in the order they are looked for
COUNTRIES = (
    ("australia", "AU"), ("united states", "US"), ("usa", "US"), ("u.s.a", "US"), ("united kingdom", "GB"), ("uk", "GB"), ("india", "IN"), ("canada", "CA"), ("new zealand", "NZ"), ("nz", "NZ"),
    ("germany", "DE"), ("france", "FR"), ("singapore", "SG"),
)
_AU_STATES = "NSW|VIC|QLD|SA|WA|TAS|ACT|NT"
_AU = rf"([A-Za-z][A-Za-z\s]{{1,30}})\s+({_AU_STATES})\s+(\d{{4}})"
_US = r"([A-Za-z ]{2,30}),\s*([A-Z]{2})\s+\d{5}"
ADDRESS = ("street", "city", "state", "postal_code", "country", "full_address")


def address(block: Column) -> Column:
    """``struct(street, city, state, postal_code, country, full_address)`` of a block of text."""
    return let(block, _address)


def _address(block: Column) -> Column:
    au = test(block, _AU)
    low = F.lower(block)
    named = None
    for name, code in COUNTRIES:
        named = F.when(low.contains(name), code) if named is None else named.when(low.contains(name), code)
    us_state = first(block, _US, 2)
    seen = F.struct(
        au.alias("au"), us_state.alias("us_state"), F.when(au, trim(first(block, _AU, 1))).otherwise(trim(first(block, _US, 1))).alias("city"), F.when(au, first(block, _AU, 2)).otherwise(us_state).alias("state"),
        F.when(au, first(block, _AU, 3)).otherwise(first(block, r"\b(\d{5}(?:-\d{4})?)\b")).alias("postal"), named.alias("named"),
        find(lines(block), lambda x: test(x, r"^\d{1,5}\s+\w") & (F.length(x) > 5)).alias("street"),
    )

    def build(s: Column) -> Column:
        us = s["us_state"].isNotNull()
        country = F.when(s["au"], "AU").when(us & (s["named"] == "AU") & ~test(s["us_state"], rf"\b({_AU_STATES})\b"), "US").otherwise(F.coalesce(s["named"], F.when(us, "US")))
        place = F.when(s["city"].isNotNull() & s["state"].isNotNull(), F.concat_ws(" ", s["city"], s["state"])).otherwise(F.coalesce(s["city"], s["state"]))

        def whole(c: Column) -> Column:
            full = F.nullif(F.concat_ws(", ", s["street"], place, s["postal"], c), F.lit(""))
            return F.struct(s["street"].alias("street"), s["city"].alias("city"), s["state"].alias("state"), s["postal"].alias("postal_code"), c.alias("country"), full.alias("full_address"))

        return let(country, whole)

    return let(seen, build)


# fixed values: shapes of tax numbers
_ABN = r"\bABN[\s:#.]*(\d{2}\s?\d{3}\s?\d{3}\s?\d{3})\b"
_ACN = r"\bACN[\s:#.]*(\d{3}\s?\d{3}\s?\d{3})\b"
_GST = r"\bGST[\s#:.-]*(?:No\.?|Number)?[\s:#.]*([A-Z0-9\-]+)"
_EIN = r"\b(?:EIN|Tax\s*ID|Federal\s*Tax)[\s:#.]*(\d{2}-\d{7})\b"
_VAT = r"\b(?:VAT|VAT\s*No\.?)[\s:#.]*([A-Z]{2}[\s]?\d{7,12})\b"
_GSTIN = r"\b(?:GSTIN|GST\s*No\.?)[\s:#.]*([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1})\b"
TAX = ("tax_id", "gst_number", "vat_number", "ein", "abn_number", "acn_number")


def tax_fields(text: Column) -> dict[str, Column]:
    return {
        "tax_id": first(text, _EIN, 1, "i"), "gst_number": F.coalesce(first(text, _GSTIN, 1, "i"), trim(first(text, _GST, 1, "i"))), "vat_number": F.regexp_replace(first(text, _VAT, 1, "i"), f"[{WS}]", ""),
        "ein": F.lit(None).cast("string"), "abn_number": F.concat(F.lit("ABN: "), trim(squeeze(first(text, _ABN, 1, "i")))), "acn_number": trim(squeeze(first(text, _ACN, 1, "i"))),
    }


def tax_information(text: Column, over: Column | None = None) -> Column:
    """Tax numbers of a text, null for none; ``over``: a fuller text whose finds take precedence field by field."""
    own = tax_fields(text)
    top = tax_fields(over) if over is not None else {}
    s = F.struct(*[F.coalesce(top[k], own[k]).alias(k) if k in top else own[k].alias(k) for k in TAX])
    return no_field(s, *TAX)


def contact(block: Column) -> Column:
    return F.struct(best_phone(phones(block)).alias("phone"), F.get(emails(block), F.lit(0)).alias("email"), F.get(urls(block), F.lit(0)).alias("website"))


# fixed values: words of company names and of lines that name no supplier
CORPORATE = r"\b(pty\.?\s*ltd|inc\.?|llc\.?|ltd\.?|co\.?|corp\.?|company|group|services|solutions|enterprises?|holdings?|industries|gmbh|bv|sa)\b"
SKIP_HEADER = r"^(invoice|tax\s+invoice|receipt|bill|quote|statement|date|no\.?|number|page|purchase\s+order|delivery|packing|from|to)\b"


def supplier_name(header: Column) -> Column:
    """From the first eight header lines: one in capitals, else the shortest with a corporate word, else the first that isn't a label."""
    top = F.slice(header, 1, 8)
    plain = F.filter(top, lambda x: ~test(x, SKIP_HEADER, "i"))
    capital = find(plain, lambda x: F.length(x).between(3, 60) & test(x, r"^[A-Z][A-Z\s&.,'-]{4,}$"))
    corporate = F.filter(F.transform(plain, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x"))), lambda s: (s["n"] >= 3) & test(s["x"], CORPORATE, "i"))
    return F.coalesce(capital, F.array_min(corporate)["x"], find(plain, lambda x: (F.length(x) > 3) & (F.length(x) <= 60)))


# fixed values: labels of a buyer's block
_LABEL = r"bill\s*to|billed\s*to|buyer|customer(?:\s*name)?|sold\s*to|ship\s*to|deliver\s*to|client|purchaser|account\s*holder"
_SECTION = r"^(?:bill\s*to|billed\s*to|buyer|customer(?:\s*(?:name|details?|info(?:rmation)?))?|sold\s*to|ship\s*to|deliver\s*to|client|purchaser|account\s*holder)\s*[:.]*\s*$"
_INLINE = rf"^(?:{_LABEL})\s*[:.]?\s+(.+)"
_NOT_BUYER = r"customer\s+signature|agree\s+to\s+pay|card\s+issuer|all\s+goods\s+returned"
_BLOCK_LABEL = r"^(bill\s*to|billed\s*to|customer|buyer|sold\s*to|ship\s*to|deliver\s*to|attn|attention|client|account\s*(?:name|holder)|purchaser|customer\s*(?:name|details?|info(?:rmation)?))\s*[:.]?\s*$"
_BLOCK_INLINE = r"^(?:bill\s*to|billed\s*to|customer(?:\s*name)?|buyer|sold\s*to|ship\s*to|deliver\s*to|attn|attention|client|account\s*(?:name|holder)|purchaser)\s*[:.]\s*(.+)"


def block_name(rows: Column) -> Column:
    """The name in a buyer's block: after a label on its line, else the first line that is a name at all."""
    inline = find(F.transform(rows, lambda x: trim(first(x, _BLOCK_INLINE, 1, "i"))), lambda v: v.isNotNull() & (F.length(v) > 2))
    plain = find(
        rows,
        lambda x: ~test(x, _BLOCK_LABEL, "i") & (F.length(x) > 2) & ~test(x, r"^[\d\s\-().+$€£₹¥,]+$") & ~test(x, r"^[\w.+-]+@[\w.-]+$") & ~x.rlike(r"^https?://|^www\."),
    )
    return trim(sub(F.coalesce(inline, plain), r"^(?:attn|attention)[:.]\s*", "", "i"))


def buyer(rows: Column) -> Column:
    """``struct(name, full_address, phone, email)`` of the buyer among a document's lines; all null where none is named."""
    def read(x: Column, i: Column) -> Column:
        usable = ~test(x, _NOT_BUYER, "i")
        return F.struct(i.alias("i"), F.when(usable, trim(first(x, _INLINE, 1, "i"))).alias("v"), (usable & test(x, _SECTION, "i")).alias("s"), trim(first(x, r"^(?:attn|attention)\s*[:.]+\s*(.+)", 1, "i")).alias("a"))

    def build(info: Column) -> Column:
        def takes(s: Column) -> Column:
            return s["v"].isNotNull() & (F.length(s["v"]) > 2) & ~test(s["v"], _NOT_BUYER, "i")

        # the first line that names a buyer or opens the block
        hit = find(F.transform(F.filter(info, lambda s: F.coalesce(takes(s), F.lit(False)) | s["s"]), lambda s: F.struct(s["i"].alias("i"), F.when(takes(s), s["v"]).alias("v"))), lambda s: s.isNotNull())
        attn = find(F.transform(info, lambda s: s["a"]), lambda v: v.isNotNull() & (F.length(v) > 2))
        none = F.lit(None).cast("string")

        def block(h: Column) -> Column:
            def whole(b: Column) -> Column:
                name = F.coalesce(h["v"], F.nullif(block_name(b["rows"]), F.lit("")))
                full = F.coalesce(address(b["text"])["full_address"], b["joined"])
                return F.struct(name.alias("name"), full.alias("full_address"), F.get(phones(b["text"]), F.lit(0)).alias("phone"), F.get(emails(b["text"]), F.lit(0)).alias("email"))

            own = F.slice(rows, h["i"] + 2, F.lit(8))
            return let(let(own, lambda r: F.struct(r.alias("rows"), F.array_join(r, "\n").alias("text"), F.array_join(r, ", ").alias("joined"))), whole)

        alone = F.struct(attn.alias("name"), none.alias("full_address"), none.alias("phone"), none.alias("email"))
        return let(hit, lambda h: F.when(h.isNotNull(), block(h)).otherwise(alone))

    return let(F.transform(rows, read), build)
