"""Mixing sources to target shares of all tokens.

Each source gets its share of the largest total that no cap on repeats forbids. Whole repeats of a source come first;
what is left of its budget is met exactly where a sum of document lengths can: an even fraction of the documents of
every length, then long ones while there is plenty of room, then bounded-knapsack dynamic programming over the length
counts for the last few thousand tokens. Which documents of a length are taken is a seeded rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.tokens import TOKENIZER, TOKENIZERS, ranked, sized
from quillstone.runtime import cut

#: tokens the knapsack fills first, and at most where the first leave a gap
KNAPSACK, KNAPSACK_MOST = 16_384, 4_194_304
#: rows of targets a run takes at most; the fit of each is made on the driver
MOST_TARGETS = 10_000


def subset(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their tokens come as near under ``budget`` as can be.

    Where the knapsack can't meet its part exactly it is given more of the budget, up to all of it or
    ``KNAPSACK_MOST`` tokens, before a gap is accepted.
    """
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return dict(counts)
    best: dict[int, int] = {}
    gap, kept = budget + 1, KNAPSACK
    while gap:
        take = _subset(counts, budget, total, kept)
        missed = budget - sum(n * k for n, k in take.items())
        if missed < gap:
            best, gap = take, missed
        if kept >= min(budget, KNAPSACK_MOST):
            break
        kept = min(kept * 16, KNAPSACK_MOST)
    return best


def _subset(counts: dict[int, int], budget: int, total: int, kept: int) -> dict[int, int]:
    # room is kept back for the knapsack, so that long documents can still go in
    part = (budget - min(budget, kept)) / total if total else 0.0
    take = {n: int(c * part) for n, c in counts.items()}
    room = budget - sum(n * k for n, k in take.items())
    for n in sorted(counts, reverse=True):
        if room <= kept:
            break
        more = min(counts[n] - take[n], (room - kept // 2) // n)
        if more > 0:
            take[n] += more
            room -= more * n
    for n, k in knapsack({n: counts[n] - take[n] for n in counts}, room).items():
        take[n] += k
    return take


def knapsack(counts: dict[int, int], room: int) -> dict[int, int]:
    """The sum of lengths nearest under ``room``, by dynamic programming with bounded counts; returns how many of each."""
    if room <= 0:
        return {}
    lengths = sorted((n for n, c in counts.items() if 0 < n <= room and c > 0), reverse=True)
    via = np.full(room + 1, -1, np.int64)
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    chunks: list[tuple[int, int]] = []
    for n in lengths:
        if reach[room]:
            break
        left, size = min(counts[n], room // n), 1
        while left > 0:
            k = min(size, left)
            w = k * n
            fresh = np.zeros(room + 1, bool)
            fresh[w:] = reach[: room + 1 - w]
            fresh &= ~reach
            via[fresh] = len(chunks)
            chunks.append((n, k))
            reach |= fresh
            left -= k
            size *= 2
    at = int(np.flatnonzero(reach)[-1])
    out: dict[int, int] = {}
    while at > 0:
        n, k = chunks[via[at]]
        out[n] = out.get(n, 0) + k
        at -= n * k
    return out


@dataclass
class Share:
    """The fit of one source in one mix: every document ``whole`` times, and ``extra`` documents of a length once more."""

    share: float
    budget: int
    whole: int = 0
    extra: dict[int, int] = field(default_factory=dict)


def fit(targets: list[tuple[int, str, float, int | None]], histogram: dict[str, dict[int, int]], total: int | None = None) -> dict[tuple[int, str], Share]:
    """The fits of all mixes. ``targets``: (mix, source, share, most repeats or None)."""
    out: dict[tuple[int, str], Share] = {}
    for mix in sorted({t[0] for t in targets}):
        own = [t for t in targets if t[0] == mix and t[2] is not None and t[2] > 0]
        have = {s: sum(n * c for n, c in histogram.get(s, {}).items()) for _, s, _, _ in own}
        live = [(s, w, cap) for _, s, w, cap in own if have[s] > 0 and (cap is None or cap > 0)]
        weight = sum(w for _, w, _ in live)
        size = total if total is not None else sum(have[s] for s, _, _ in live)
        for s, w, cap in live:
            if cap is not None:
                size = min(size, int(have[s] * cap * weight / w))
        for s, w, cap in live:
            budget = int(round(size * w / weight))
            if cap is not None:
                budget = min(budget, have[s] * cap)
            whole, rest = divmod(budget, have[s])
            out[mix, s] = Share(w / weight, budget, whole, subset(histogram[s], rest) if rest else {})
    return out


def mix(documents: DataFrame, targets: DataFrame, seed: int = 11, total: int | None = None, tokenizer: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """``mix_id, source, doc_id, n_tokens, repeats`` of the records each mix holds.

    Shares are relative within a mix; a source without documents, with no share, or with ``max_repeats`` 0 is left out
    and the others keep their proportions. A null ``max_repeats`` sets no cap. ``total`` fixes the size in tokens,
    which otherwise is that of the mix's sources or the largest the caps allow. Null or empty texts have no tokens
    and are never taken; documents without a source are in no mix; a repeated ``doc_id`` counts as often as it stands.
    The choice depends on the seed, ids and texts alone, not on how the rows are partitioned.
    """
    spark = documents.sparkSession
    rows = targets.filter("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.sum("target_share").alias("w"), F.max(F.struct(F.col("max_repeats").isNull().alias("free"), "max_repeats")).alias("cap")).limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    wanted = [(r["mix_id"], r["source"], r["w"], None if r["cap"]["free"] else r["cap"]["max_repeats"]) for r in rows]
    sources = spark.createDataFrame([(s,) for s in sorted({t[1] for t in wanted})], "source string")
    told = documents.filter("source is not null").select("doc_id", "source", "text", F.xxhash64("text").alias("uid")).join(F.broadcast(sources), "source")
    sizes = cut(sized(told, ("doc_id", "source", "uid"), tokenizer, folder).filter("n_tokens > 0"))
    histogram: dict[str, dict[int, int]] = {}
    # counts by exact length: at most one for each length that occurs in a source
    for r in sizes.groupBy("source", "n_tokens").count().collect():
        histogram.setdefault(r["source"], {})[r["n_tokens"]] = r["count"]
    fits = fit(wanted, histogram, total)
    by_source: dict[str, list[tuple[int, Share]]] = {}
    for (m, s), share in fits.items():
        by_source.setdefault(s, []).append((m, share))
    shared = spark.sparkContext.broadcast(by_source)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for f in frames:
            out = []
            for source, part in f.groupby("source", sort=False):
                n, rank = part["n_tokens"].to_numpy(), part["rank"].to_numpy()
                for m, share in table.get(source, ()):
                    extra = np.array([share.extra.get(int(x), 0) for x in n]) if share.extra else np.zeros(len(n), int)
                    count = share.whole + (rank < extra)
                    keep = count > 0
                    out.append(pd.DataFrame({"mix_id": m, "source": source, "doc_id": part["doc_id"].to_numpy()[keep], "n_tokens": n[keep], "repeats": count[keep]}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"mix_id": [], "source": [], "doc_id": [], "n_tokens": [], "repeats": []})

    return ranked(sizes, ["source", "n_tokens"], ["doc_id", "uid"], seed).drop("uid").mapInPandas(choose, "mix_id int, source string, doc_id long, n_tokens long, repeats int")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_id, source, target_share, tokens, records, actual_share, most_repeats``: what each mix reached, absent sources too."""
    used = mixed.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("records"), F.max("repeats").alias("most_repeats"))
    want = targets.filter("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.sum("target_share").alias("w"))
    whole = want.groupBy("mix_id").agg(F.sum("w").alias("ws"))
    both = want.join(whole, "mix_id").join(used, ["mix_id", "source"], "left")
    total = used.groupBy("mix_id").agg(F.sum("tokens").alias("total"))
    return both.join(total, "mix_id", "left").select(
        "mix_id", "source", (F.col("w") / F.col("ws")).alias("target_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("records", F.lit(0)).alias("records"),
        (F.coalesce("tokens", F.lit(0)) / F.col("total")).alias("actual_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
