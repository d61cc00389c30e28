"""Registries of text-recognition and model providers, run as Arrow batches, with fallback from one to the next."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCR = "struct<text:string,confidence:double,line_count:int,provider:string,error:string>"
MODEL = "struct<entities:array<struct<label:string,text:string,score:double>>,fields:map<string,string>,confidence:double,error:string>"
#: built-in providers, in the order they are tried after the preferred one
BUILT_IN = ("native-mlkit", "tesseract")


@dataclass(frozen=True)
class Provider:
    """``run`` maps one input to a dict, or raises; ``available`` is asked on the driver before a job starts."""

    name: str
    run: Callable[..., dict]
    available: Callable[[], bool] = lambda: True


_OCR: dict[str, Provider] = {}
_MODEL: dict[str, Provider] = {}


def register_ocr(provider: Provider) -> None:
    _OCR[provider.name] = provider


def get_ocr(name: str) -> Provider | None:
    return _OCR.get(name)


def register_model(provider: Provider) -> None:
    _MODEL[provider.name] = provider


def get_model(name: str) -> Provider | None:
    return _MODEL.get(name)


def chain(preferred: str | None = None) -> list[Provider]:
    """Preferred first, then the built-in ones; unknown and unavailable ones are passed over."""
    names = [n for n in dict.fromkeys([preferred, *BUILT_IN]) if n]
    return [p for n in names if (p := _OCR.get(n)) is not None and p.available()]


def ocr_column(source: Column, preferred: str | None = None, language: str = "en") -> Column:
    """Recognition of each source by the first provider that succeeds; the last error where none does."""
    providers = chain(preferred)

    @F.pandas_udf(OCR)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for value in batch:
                row = {"text": None, "confidence": None, "line_count": None, "provider": None, "error": "No OCR provider available"}
                for p in providers:
                    try:
                        got = p.run(value, language)
                        text = got.get("text") or ""
                        lines = got.get("line_count")
                        row = {"text": text, "confidence": 0.85 if got.get("confidence") is None else got["confidence"], "line_count": text.count("\n") + 1 if lines is None else lines, "provider": p.name, "error": None}
                        break
                    except Exception as e:  # noqa: BLE001
                        row["error"] = f"{p.name}: {e}"
                out.append(row)
            yield pd.DataFrame(out, columns=["text", "confidence", "line_count", "provider", "error"])

    return run(source)


def model_column(text: Column, document_type: Column, name: str | None = None) -> Column:
    """Inference of the named model, else the first registered; an error is kept per row and fails nothing."""
    p = _MODEL.get(name) if name else next(iter(_MODEL.values()), None)
    if p is None or not p.available():
        return F.lit(None).cast(MODEL)

    @F.pandas_udf(MODEL)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, kinds in batches:
            out = []
            for t, k in zip(texts, kinds, strict=True):
                try:
                    got = p.run(t, k)
                    out.append({"entities": got.get("entities") or [], "fields": {a: str(b) for a, b in (got.get("fields") or {}).items() if b is not None}, "confidence": got.get("confidence"), "error": None})
                except Exception as e:  # noqa: BLE001
                    out.append({"entities": [], "fields": {}, "confidence": None, "error": f"AI enhancement failed: {e}"})
            yield pd.DataFrame(out, columns=["entities", "fields", "confidence", "error"])

    return run(text, document_type)


def enhance_low(df: DataFrame, text: str, score: str, threshold: float = 0.65, name: str | None = None) -> DataFrame:
    """``inference`` for rows scored under the threshold; the others don't pass the model at all."""
    low = (F.col(score) < threshold) & F.col(score).isNotNull()
    done = df.filter(low).withColumn("inference", model_column(F.col(text), F.coalesce("document_type", F.lit("generic")) if "document_type" in df.columns else F.lit("generic"), name))
    return done.unionByName(df.filter(~low | F.col(score).isNull()).withColumn("inference", F.lit(None).cast(MODEL)))


def health(name: str | None = None) -> dict[str, object]:
    """Availability and a probe inference of a model provider."""
    p = _MODEL.get(name) if name else next(iter(_MODEL.values()), None)
    out: dict[str, object] = {"registered": p is not None, "available": bool(p and p.available()), "runs": False, "finds_entities": False, "warnings": []}
    if p and out["available"]:
        try:
            got = p.run("Invoice No INV-1001 Date 2024-01-31 Total 99.50", "invoice")
            out["runs"] = True
            out["finds_entities"] = bool(got.get("entities") or got.get("fields"))
        except Exception as e:  # noqa: BLE001
            out["warnings"] = [str(e)]
    return out
