"""Connected components of a link table, and a streaming scan over grouped rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.runtime import cut, parallelism


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` of every node of ``links(a, b)``; the root is the least node of its component.

    Alternates large-star and small-star contraction until the link table stands still. Each step aggregates a minimum
    per node and joins it back, so a node with very many links is split by partial aggregation and by the skew join;
    links never leave the executors, and each round ends in the shared checkpoint folder.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        # done once every link goes straight to a root: one link per node, and no root with a link of its own
        count, nodes = edges.agg(F.count("*"), F.countDistinct("u")).first()
        if count == nodes and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def scan_groups(df: DataFrame, key: str, fn: Callable[[pd.DataFrame], Iterable[pd.DataFrame] | None], schema: str) -> DataFrame:
    """``fn`` over the rows of each ``key``, streamed: one shuffle, groups met in key order, no per-group task overhead.

    A group is held whole in one worker, so callers bound group sizes (see ``split_hot``).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        out: list[pd.DataFrame] = []
        rows = 0

        def close() -> None:
            nonlocal rows
            if held:
                for x in fn(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]) or ():
                    if len(x):
                        out.append(x)
                        rows += len(x)
                held.clear()

        for frame in frames:
            if not len(frame):
                continue
            marks = (frame[key] != frame[key].shift()).to_numpy().nonzero()[0]
            for n, at in enumerate(marks):
                part = frame.iloc[at : marks[n + 1] if n + 1 < len(marks) else len(frame)]
                if part[key].iloc[0] != last:
                    close()
                    last = part[key].iloc[0]
                held.append(part)
                if rows >= 10_000:
                    yield pd.concat(out, ignore_index=True)
                    out.clear()
                    rows = 0
        close()
        if out:
            yield pd.concat(out, ignore_index=True)

    # a stated number of partitions, since the adaptive plan would merge them by bytes and leave one task all the work
    return df.repartition(parallelism(df.sparkSession), key).sortWithinPartitions(key).mapInPandas(run, schema)


def split_hot(rows: DataFrame, key: str, most: int, word: str) -> DataFrame:
    """Adds ``cell`` and ``probe`` to shard rows: a shard over ``most`` rows becomes cells of at most about that many stored rows.

    Every row is stored in one cell (``probe`` false) and asks all cells of its shard (``probe`` true), so no neighbour
    is lost and no task holds a whole hot shard.
    """
    hot = rows.groupBy(key).count().filter(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("cells"))
    sized = rows.join(hot, key, "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    own = F.pmod(F.xxhash64(word), F.col("cells")).cast("int")
    return (
        sized.withColumn("own", own)
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        .withColumn("cell", F.concat_ws("#", F.col(key), F.col("at")))
        .withColumn("stored", F.col("at") == F.col("own"))
        .drop("cells", "own", "at")
    )
