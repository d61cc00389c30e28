"""Reading documents, pages, labels and vocabularies; resolving what an extract call names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.js import empty
from quillstone.operators.validate import error


def local_path(uri: Column) -> Column:
    """A file address as a path: scheme off, escapes undone."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(uri, r"^file://", ""), r"\+", "%2B"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, content, modificationTime, length`` of image or text files; partitioned by the reader, nothing listed on the driver twice."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: each file one document."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_pages(spark: SparkSession, path: str, pages: list[int] | None = None) -> DataFrame:
    """``path, page_index, text`` of text files whose pages end in form feeds; the first page unless others are named, missing ones skipped."""
    want = F.array(*[F.lit(p) for p in (pages or [0])])
    split = F.split("text", "\\f", -1)
    return read_text(spark, path).select("path", F.posexplode(split).alias("page_index", "text")).filter(F.array_contains(want, F.col("page_index")))


def resolve(image: Column, kind: Column, data: Column, path: Column) -> Column:
    """``struct(source, error)``: an image before base64 data before a path; a blob can't be read here."""
    source = F.when(~empty(image), image).when((kind == "base64") & ~empty(data), data).when((kind == "uri") & ~empty(path), path)
    none = F.lit(None).cast("struct<code:string,message:string>")
    e = F.when(source.isNotNull(), none).when(kind == "blob", error("INVALID_INPUT", F.lit("Blob input requires converting to base64 first."))).otherwise(error("INVALID_INPUT", F.lit("No image data found in options")))
    return F.struct(source.alias("source"), e.alias("error"))


def merge_pages(pages: DataFrame, key: str = "doc_id", order: str = "page_index", text: str = "text", confidence: str = "confidence") -> DataFrame:
    """One row per document: page texts joined by line ends in page order, mean confidence (0.5 without any), number of pages."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return pages.groupBy(key).agg(joined.alias("text"), F.coalesce(F.avg(confidence), F.lit(0.5)).alias("confidence"), F.count("*").alias("page_count"))


def read_labels(spark: SparkSession, path: str | None) -> dict[int, str]:
    """Labels by id from a JSON object or one per line; the default list where the file is missing or holds none."""
    from quillstone.operators.entities import DEFAULT_ENTITIES, label_list

    default = dict(enumerate(label_list(DEFAULT_ENTITIES)))
    if not path:
        return default
    try:
        text = spark.read.text(path, wholetext=True).first()
    except Exception:  # noqa: BLE001
        return default
    if text is None:
        return default
    parsed = spark.range(1).select(F.from_json(F.lit(text[0]), "map<string,string>").alias("m")).first()["m"]
    if parsed:
        out = {int(k): v for k, v in parsed.items() if k.lstrip("-").isdigit()}
    else:
        out = {i: v.strip() for i, v in enumerate(text[0].split("\n")) if v.strip()}
    return out or default


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``token, id`` of a vocabulary: a JSON object, or one token per line numbered from 0."""
    whole = spark.read.text(path, wholetext=True)
    if path.endswith(".json"):
        return whole.select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))
    rows = whole.select(F.posexplode(F.split("value", "\n")).alias("id", "token")).select(F.trim("token").alias("token"), "id")
    return rows.filter("token <> ''")


def training_records(spark: SparkSession, path: str) -> DataFrame:
    """``image, words, bboxes, labels`` training records, schema fixed."""
    return spark.read.schema("image string, words array<string>, bboxes array<array<int>>, labels array<string>").json(path)


def write_records(df: DataFrame, path: str, form: str = "json") -> None:
    """Records as JSON lines or parquet."""
    df.write.mode("overwrite").format(form).save(path)
