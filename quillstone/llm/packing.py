"""Filling fixed-capacity containers with items of varying length.

The global histogram of item lengths - at most one count for each length up to the capacity - goes to the driver.
Dynamic programming over it chooses the bucket boundaries that waste least padding. Inside each bucket batches are formed
within the token budget as if every item were as long as the bucket's end. A second step, which can be left out, tops
the batches up: room that padding would have taken goes to items of shorter buckets, the longest that fit first, and
then to what is left of the own bucket. Equal containers are planned at once, with their number. Items then find their
places by their rank among the items of their length, without moving.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.tokens import TOKENIZER, TOKENIZERS, ranked, sized
from quillstone.runtime import cut


#: length buckets for each container size
BUCKETS = 64


def boundaries(counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper ends of the length buckets that minimise padding: ``counts[n]`` items of length ``n``, each padded to its bucket's end.

    Exact dynamic programming over all lengths that occur. The padding of a bucket from ``i`` (exclusive) to ``j`` is
    ``end_j * (items_j - items_i) - (tokens_j - tokens_i)``: as a function of ``end_j`` a line for each ``i``, so the
    best start of every bucket is read off a lower hull of lines in one sweep for each number of buckets.
    """
    ends = [int(n) for n in np.flatnonzero(counts) if n > 0]
    if not ends:
        return []
    m = len(ends)
    own = np.asarray(counts, np.int64)[ends]
    items = [0, *np.cumsum(own).tolist()]
    tokens = [0, *np.cumsum(own * np.array(ends)).tolist()]
    cost: list[float] = [0, *[float("inf")] * m]
    choice: list[list[int]] = []
    for _ in range(min(buckets, m)):
        best, start = [0, *[float("inf")] * m], [0] * (m + 1)
        hull: list[tuple[int, float, int]] = []
        at = 0
        for j in range(1, m + 1):
            if cost[j - 1] < float("inf"):
                slope, level = -items[j - 1], cost[j - 1] + tokens[j - 1]
                while len(hull) - at >= 2:
                    (s1, l1, _), (s2, l2, _) = hull[-2], hull[-1]
                    # the middle line is never the lowest
                    if (level - l1) * (s1 - s2) <= (l2 - l1) * (s1 - slope):
                        hull.pop()
                    else:
                        break
                hull.append((slope, level, j - 1))
            x = ends[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            if at < len(hull):
                slope, level, start[j] = hull[at]
                best[j] = slope * x + level + x * items[j] - tokens[j]
        cost = best
        choice.append(start)
    out, j = [], m
    for start in reversed(choice):
        if j == 0:
            break
        out.append(ends[j - 1])
        j = start[j]
    return sorted(out)


@dataclass
class Plan:
    """Containers planned alike: ``first`` .. ``first + number - 1``, each holding ``slots`` of (length, how many)."""

    first: int
    number: int
    bucket: int
    slots: list[tuple[int, int]]


def plan(counts: np.ndarray, capacity: int, sep: int, ends: list[int], top_up: bool = True) -> list[Plan]:
    """How containers are filled from the histogram, bucket by bucket from the longest down; every step uses up at least one length, so plans stay few."""
    left = {int(n): int(counts[n]) for n in np.flatnonzero(counts) if n > 0}
    order = sorted(left)
    plans: list[Plan] = []
    first = 0
    while order:
        bucket = bisect.bisect_left(ends, order[-1])
        low = bisect.bisect_right(order, ends[bucket - 1]) if bucket else 0
        slots: dict[int, int] = {}
        # the batch: as many items of the bucket as fit when all are padded to its end
        want = (capacity + sep) // (ends[bucket] + sep)
        for n in reversed(order[low:]):
            if not want:
                break
            take = min(want, left[n])
            slots[n] = take
            want -= take
        room = capacity - sum((n + sep) * k for n, k in slots.items()) + sep
        if top_up:
            for lo, hi in ((0, low), (low, len(order))):
                at = bisect.bisect_right(order, room - sep, lo, hi) - 1
                while at >= lo:
                    n = order[at]
                    take = min(room // (n + sep), left[n] - slots.get(n, 0))
                    if take > 0:
                        slots[n] = slots.get(n, 0) + take
                        room -= take * (n + sep)
                    at = bisect.bisect_right(order, room - sep, lo, at) - 1
        number = min(left[n] // k for n, k in slots.items())
        plans.append(Plan(first, number, bucket, sorted(slots.items(), reverse=True)))
        first += number
        for n, k in slots.items():
            left[n] -= number * k
        order = [n for n in order if left[n]]
    return plans


class Places:
    """Where the k-th item of a length goes."""

    def __init__(self, plans: list[Plan]):
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        for p in plans:
            slot = 0
            for n, k in p.slots:
                start = used.get(n, 0)
                by.setdefault(n, []).append((start, p.first, k, slot))
                used[n] = start + p.number * k
                slot += k
        self.by = {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in by.items()}

    def of(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, first, k, slot = self.by[length]
        i = np.searchsorted(start, rank, "right") - 1
        return first[i] + (rank - start[i]) // k[i], slot[i] + (rank - start[i]) % k[i]


def items_of(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """One row per item and container size: ``container_id, doc_id, part, length``; only items over the capacity have parts."""
    parts = F.when(F.col("n_tokens") <= F.col("capacity"), F.lit(1)).otherwise(F.ceil(F.col("n_tokens") / F.col("capacity"))).cast("int")
    both = sizes.join(F.broadcast(containers))
    # containers is a small table of sizes, so this is a stated set against all rows
    return (
        both.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("length", F.when(F.col("part") < F.col("parts") - 1, F.col("capacity")).otherwise(F.col("n_tokens") - F.col("part") * F.col("capacity")).cast("int"))
    )


#: container sizes a run takes at most; the plan of each is made on the driver
MOST_SIZES = 64


def pack(documents: DataFrame, containers: DataFrame, buckets: int = BUCKETS, top_up: bool = True, tokenizer: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """``container_id, container_no, slot, doc_id, part, start_token, length, bucket`` for every item in containers of every size.

    An item over the capacity is cut into full containers and a rest; nothing else is cut. Null and empty texts have no
    tokens and take no room: they have no row. A null capacity or one of no tokens is left out; a null ``sep_tokens``
    is 0. A null or repeated ``doc_id`` is an item of its own. Other columns aren't read. ``top_up`` false leaves the
    batches as the buckets' padding bounds them. The result depends on the rows alone, not on how they are partitioned.
    """
    spark = documents.sparkSession
    sizes_table = containers.filter("n_tokens > 0 and container_id is not null").select(F.col("container_id").cast("int"), F.col("n_tokens").cast("int").alias("capacity"), F.coalesce(F.col("sep_tokens").cast("int"), F.lit(0)).alias("sep")).distinct()
    sizes_list = [tuple(r) for r in sizes_table.limit(MOST_SIZES + 1).collect()]
    if len(sizes_list) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} container sizes")
    schema = "container_id int, capacity int, sep int"
    wanted = spark.createDataFrame(sizes_list, schema)
    # the text tells equal ids apart; rows equal in both are alike in every column of the result
    told = documents.select("doc_id", "text", F.xxhash64("text").alias("uid"))
    sizes = cut(sized(told, ("doc_id", "uid"), tokenizer, folder).filter("n_tokens > 0"))
    items = items_of(sizes, wanted)
    histogram = items.groupBy("container_id", "length").count().collect()
    places: dict[int, tuple[Places, list[int]]] = {}
    for cid, capacity, sep in sizes_list:
        counts = np.zeros(capacity + 1, np.int64)
        for r in histogram:
            if r["container_id"] == cid:
                counts[r["length"]] = r["count"]
        ends = boundaries(counts, buckets)
        places[cid] = (Places(plan(counts, capacity, sep, ends, top_up)), ends)
    shared = spark.sparkContext.broadcast(places)

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for f in frames:
            number, slot, bucket = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for (cid, length), at in f.groupby(["container_id", "length"], sort=False).indices.items():
                where, ends = table[cid]
                number[at], slot[at] = where.of(length, f["rank"].to_numpy()[at])
                bucket[at] = bisect.bisect_left(ends, length)
            yield f.assign(container_no=number, slot=slot, bucket=bucket)[["container_id", "container_no", "slot", "doc_id", "part", "start_token", "length", "bucket"]]

    rows = ranked(items.select("container_id", "length", "doc_id", "uid", "part", (F.col("part") * F.col("capacity")).cast("long").alias("start_token")), ["container_id", "length"], ["doc_id", "uid", "part"])
    return rows.drop("uid").mapInPandas(put, "container_id int, container_no long, slot int, doc_id long, part int, start_token long, length int, bucket int")


def report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """``container_id, containers, items, tokens, unused_share`` of an assignment."""
    per = packed.groupBy("container_id", "container_no").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"))
    c = containers.select(F.col("container_id").cast("int"), F.col("n_tokens").cast("long").alias("capacity"), F.coalesce("sep_tokens", F.lit(0)).alias("sep")).distinct()
    return (
        per.join(F.broadcast(c), "container_id").groupBy("container_id", "capacity", "sep")
        .agg(F.count("*").alias("containers"), F.sum("n").alias("items"), F.sum("tokens").alias("tokens"))
        .select("container_id", "containers", "items", "tokens", ((F.col("capacity") * F.col("containers") - F.col("tokens") - F.col("sep") * (F.col("items") - F.col("containers"))) / (F.col("capacity") * F.col("containers"))).alias("unused_share"))
    )
