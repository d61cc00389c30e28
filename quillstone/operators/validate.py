"""Validation of options and unified payloads as arrays of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.js import empty
from quillstone.functions.text import UNIFIED_TYPES

#: error codes a document may carry instead of failing its job
ERROR_CODES = ("INVALID_INPUT", "OCR_FAILED", "PARSE_FAILED", "AI_FAILED", "TIMEOUT", "UNKNOWN")


def _errors(*tests: tuple[Column, str]) -> Column:
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in tests]), lambda x: x.isNotNull())
    return F.struct((F.size(found) == 0).alias("valid"), found.alias("errors"))


def options(image: Column, kind: Column, data: Column, path: Column, has_blob: Column, threshold: Column) -> Column:
    """Checks of an extract call: one image source, its member, a threshold between 0 and 1."""
    own, given = ~empty(image), kind.isNotNull()
    return _errors(
        (~own & ~given, "You must provide either `image` (base64 string) or `imageInput` (ImageInput object)."), ((kind == "base64") & empty(data), "`imageInput.data` is required for type 'base64'."),
        ((kind == "uri") & empty(path), "`imageInput.path` is required for type 'uri'."), ((kind == "blob") & ~F.coalesce(has_blob, F.lit(False)), "`imageInput.blob` must be a Blob instance for type 'blob'."),
        ((threshold < 0) | (threshold > 1), "`aiConfidenceThreshold` must be between 0 and 1."),
    )


def payload(document_id: Column, document_type: Column, has_images: Column, has_header: Column, has_vendor: Column, has_totals: Column, currency: Column, date_issued: Column) -> Column:
    """The eight rules of the unified payload in their order; a null currency or date counts as absent."""
    return _errors(
        (empty(document_id), "document_id is required and must be string"), (~F.coalesce(document_type.isin(*UNIFIED_TYPES), F.lit(False)), "document_type is required and must be a valid enum value"),
        (~F.coalesce(has_images, F.lit(False)), "images is required and must be array"), (~F.coalesce(has_header, F.lit(False)), "header is required and must be object"),
        (~F.coalesce(has_vendor, F.lit(False)), "vendor is required and must be object"), (~F.coalesce(has_totals, F.lit(False)), "totals is required and must be object"),
        (~currency.rlike(r"^[A-Z]{3}\z"), "currency must be ISO 4217 uppercase code"), (~date_issued.rlike(r"^\d{4}-\d{2}-\d{2}\z"), "header.date_issued must be YYYY-MM-DD"),
    )


def error(code: str, message: Column) -> Column:
    if code not in ERROR_CODES:
        raise ValueError(code)
    return F.struct(F.lit(code).alias("code"), message.alias("message"))
