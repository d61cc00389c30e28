"""Sizes of documents in tokens of a public tokenizer, and exact ranks inside groups of any size."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.runtime import parallelism

#: where the vocabularies of the public tokenizers lie, unless the caller says otherwise
TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
# fixed value: the pattern that splits text before the merges of the rank files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# the pattern never joins a letter, number or sign with a line end after it, so counts of lines add up
_CUT = re.compile(r"(?<=\S)(?=\n)")
#: distinct lines a worker remembers before it starts anew
REMEMBERED = 400_000


_ENCODERS: dict[str, object] = {}


def encoder(path: str, data: bytes | None = None):
    """Token counter of a rank file, read from ``path`` unless its bytes are given."""
    if path not in _ENCODERS:
        import tiktoken

        if data is None:
            with open(path, "rb") as f:
                data = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count(texts: list[str | None], path: str, memo: dict[str, int]) -> list[int]:
    """Tokens of each text, exactly; null has none. Lines met before are looked up."""
    enc = encoder(path)
    split = [_CUT.split(t) if t else [] for t in texts]
    fresh = [x for x in {x for xs in split for x in xs} if x not in memo]
    for x, ids in zip(fresh, enc.encode_ordinary_batch(fresh, num_threads=1), strict=True):
        memo[x] = len(ids)
    return [sum(map(memo.__getitem__, xs)) for xs in split]


_MEMO: dict[str, dict[str, int]] = {}


def sized(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), tokenizer: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """``keep`` columns and ``n_tokens`` (long) of every document: one pass over the scan, no shuffle.

    Only the driver needs the rank file (about a megabyte); its bytes travel with the job.
    """
    path = os.path.join(folder, tokenizer)
    fields = [documents.schema[c] for c in keep]
    with open(path, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder(path, shared.value)
        memo = _MEMO.setdefault(path, {})
        for batch in batches:
            n = count(batch.column(len(keep)).to_pylist(), path, memo)
            if len(memo) > REMEMBERED:
                memo.clear()
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long"
    return documents.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def ranked(df: DataFrame, keys: list[str], order: list[str], seed: int = 0) -> DataFrame:
    """Adds ``rank``: 0, 1, 2 ... inside each group of ``keys``, seeded and repeatable; a hot group is ranked in shards.

    Rows are spread over shards by a seeded hash of ``order`` (which must tell the rows of a group apart); each shard
    is numbered on its own and shifted by the sizes of the shards before it.
    """
    shards = max(64, parallelism(df.sparkSession))
    cut = df.withColumn("__h", F.xxhash64(F.lit(seed), *order)).withColumn("__s", F.pmod("__h", F.lit(shards)).cast("int"))
    sizes = cut.groupBy(*keys, "__s").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*keys).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = cut.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "__s").orderBy("__h", *order)))
    joined = own.join(offsets, [*keys, "__s"])
    return joined.withColumn("rank", F.col("__r") - 1 + F.col("__o")).drop("__h", "__s", "__r", "__o")
